"""Sparse spectrum features: binned histograms, moments, group means."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom import fixed

CHANNELS = ("fragment", "loss")


def histogram(spectra: DataFrame, keys: list[str], peaks: str = "peaks", precursor: str = "precursor_mz") -> DataFrame:
    """(keys, channel, bin, value, moment): root-intensity histogram of unit bins and its fractional moment.

    Both measures are divided by the L2 norm of the channel's raw bins, summed
    in a window of at most 2,048 bins. A window and an aggregate on the keys
    share one partitioning, so rows of a spectrum move once at most.
    """
    p = F.filter(F.col(peaks), lambda x: (x["i"] > 0) & (x["mz"] < F.col(precursor) - F.lit(fixed.REFERENCE_MARGIN)))
    both = F.flatten(F.array(
        F.transform(p, lambda x: F.struct(F.lit(0).alias("channel"), x["mz"].alias("v"), F.sqrt(x["i"]).alias("w"))),
        F.transform(p, lambda x: F.struct(F.lit(1).alias("channel"), (F.col(precursor) - x["mz"]).alias("v"),
                                          F.sqrt(x["i"]).alias("w")))))
    rows = spectra.select(*keys, F.explode(both).alias("e")).select(
        *keys, "e.channel", F.floor("e.v").cast("int").alias("bin"), F.col("e.v").alias("v"), F.col("e.w").alias("w"))
    bins = rows.filter((F.col("bin") >= 0) & (F.col("bin") < fixed.BINS)).groupBy(*keys, "channel", "bin").agg(
        F.sum("w").alias("raw"), F.sum(F.col("w") * (F.col("v") - F.col("bin"))).alias("raw_moment"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(*keys, "channel")))
    scale = F.greatest(norm, F.lit(1e-12))
    return bins.select(
        *keys, "channel", "bin", (F.col("raw") / scale).alias("value"), (F.col("raw_moment") / scale).alias("moment"))


def metadata(energies: Column | str, precursor: str = "precursor_mz", neutral: str = "neutral", z: str = "z") -> list[Column]:
    """The eight scaled acquisition features."""
    e = F.filter(F.col(energies) if isinstance(energies, str) else energies,
                 lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    has = F.size(e) > 0
    mean = F.aggregate(e, F.lit(0.0), lambda a, v: a + v) / F.size(e)
    zero = F.lit(0.0)
    return [
        (F.col(neutral) / 1200).alias("f_neutral"), (F.col(precursor) / 1200).alias("f_precursor"),
        (F.col(z) > 0).cast("double").alias("f_positive"), (F.col(z) < 0).cast("double").alias("f_negative"),
        F.when(has, F.array_min(e) / 200).otherwise(zero).alias("f_energy_min"),
        F.when(has, F.array_max(e) / 200).otherwise(zero).alias("f_energy_max"),
        F.when(has, mean / 200).otherwise(zero).alias("f_energy_mean"),
        has.cast("double").alias("f_has_energy")]


def group_mean(features: DataFrame, spectra: DataFrame, group: str, spectrum: str = "spectrum_id",
               value: str = "value") -> DataFrame:
    """Mean over all spectra of a group; a bin a spectrum lacks counts as zero."""
    size = spectra.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    members = spectra.select(spectrum, group)
    total = features.join(members, spectrum).groupBy(group, "channel", "bin").agg(F.sum(value).alias("__s"))
    return total.join(size, group).select(group, "channel", "bin", (F.col("__s") / F.col("__n")).alias("value"))


def corpus_totals(features: DataFrame, spectra: DataFrame, structure: str, neutral: str = "neutral",
                  spectrum: str = "spectrum_id") -> tuple[DataFrame, DataFrame]:
    """(mean feature rows, per-structure count and mean observed mass): partial then final sums, one division."""
    stats = spectra.groupBy(structure).agg(F.count(F.lit(1)).alias("count"), F.avg(neutral).alias("observed"))
    return group_mean(features, spectra, structure, spectrum), stats


def active_features(features: DataFrame, columns: list[str] = ("channel", "bin")) -> DataFrame:
    """Feature positions that are non-zero in any row."""
    return features.filter(F.col("value") != 0).select(*columns).distinct()


def bit_prevalence(fingerprints: DataFrame, bits: str = "bits") -> DataFrame:
    """Per bit: share of rows that set it, clipped to [.005, .995], and its class weight."""
    n = fingerprints.agg(F.count(F.lit(1))).scalar()
    per_bit = fingerprints.select(F.explode(bits).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("c"))
    share = F.least(F.greatest(F.col("c") / n, F.lit(0.005)), F.lit(0.995))
    return per_bit.select("bit", share.alias("prevalence")).withColumn(
        "weight", F.least(F.lit(20.0), (1 - F.col("prevalence")) / F.col("prevalence")))
