"""Peak lists: array<struct<mz, i>> expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom import fixed
from massloom.functions.numeric import col, finite, let


def peak(mz: Column, i: Column) -> Column:
    return F.struct(mz.alias("mz"), i.alias("i"))


def zip_peaks(mz: Column | str, intensity: Column | str) -> Column:
    return F.zip_with(col(mz), col(intensity), lambda m, i: peak(m.cast("double"), i.cast("double")))


def total(peaks: Column | str) -> Column:
    return F.aggregate(col(peaks), F.lit(0.0), lambda acc, p: acc + p["i"])


def base_peak(peaks: Column | str) -> Column:
    return F.array_max(F.transform(col(peaks), lambda p: p["i"]))


def normalise(peaks: Column | str) -> Column:
    """Intensities divided by their sum; an empty list stays empty, peaks without a positive sum give null."""
    return let(col(peaks), lambda p: let(total(p), lambda s: F.when((s > 0) | (F.size(p) == 0), F.transform(p, lambda x: peak(x["mz"], F.try_divide(x["i"], s))))))


def merge_equal(peaks: Column | str) -> Column:
    """Positive peaks ordered by m/z, intensities of equal m/z added."""
    def merged(p: Column) -> Column:
        masses = F.array_distinct(F.transform(p, lambda x: x["mz"]))
        added = F.transform(masses, lambda m: peak(m, total(F.filter(p, lambda x: x["mz"] == m))))
        return F.when(F.size(masses) == F.size(p), p).otherwise(added)

    return let(F.array_sort(F.filter(col(peaks), lambda x: x["i"] > 0)), merged)


def collect_peaks(df: DataFrame, key: str, normalised: bool = True) -> DataFrame:
    """Peak rows -> one normalised list per key.

    Equal m/z are added before the lists are gathered, so a key repeated across
    many rows reaches its task as distinct masses only.
    """
    merged = df.filter(F.col("intensity") > 0).groupBy(key, "mz").agg(F.sum("intensity").alias("i"))
    lists = merged.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("mz", "i"))).alias("peaks"))
    return lists.withColumn("peaks", normalise("peaks")) if normalised else lists


def valid_arrays(mz: Column | str, intensity: Column | str) -> Column:
    """Equal length, non-empty, finite, m/z > 0, intensity >= 0, at least one positive."""
    m, i = col(mz), col(intensity)
    ok = (
        m.isNotNull() & i.isNotNull() & (F.size(m) == F.size(i)) & (F.size(m) > 0)
        & F.forall(m, lambda x: finite(x) & (x > 0))
        & F.forall(i, lambda x: finite(x) & (x >= 0))
        & F.exists(i, lambda x: finite(x) & (x > 0))
    )
    return F.coalesce(ok, F.lit(False))


def below(peaks: Column | str, precursor: Column | str, margin: float) -> Column:
    """Peaks strictly below precursor - margin."""
    return F.filter(col(peaks), lambda p: p["mz"] < col(precursor) - F.lit(margin))


def relative_floor(peaks: Column | str, floor: float) -> Column:
    return let(col(peaks), lambda p: let(F.lit(floor) * base_peak(p), lambda m: F.filter(p, lambda x: x["i"] >= m)))


def neutral_loss(peaks: Column | str, precursor: Column | str) -> Column:
    """Losses ascending, paired with their intensities."""
    return F.array_sort(F.transform(col(peaks), lambda p: peak(col(precursor) - p["mz"], p["i"])))


def clean(peaks: Column | str, precursor: Column | str, margin: float = fixed.FORWARD_MARGIN) -> Column:
    """Below the window, merged and renormalised."""
    return normalise(merge_equal(below(peaks, precursor, margin)))


def strongest(peaks: Column | str, n: int) -> Column:
    """The n most intense peaks (ties: lower m/z), re-ordered by m/z."""
    by_intensity = F.array_sort(F.transform(
        col(peaks), lambda p: F.struct((-p["i"]).alias("k"), p["mz"].alias("mz"))))
    return F.array_sort(F.transform(F.slice(by_intensity, 1, n), lambda p: peak(p["mz"], -p["k"])))


def pack(peaks: Column | str, precursor: Column | str, n: int = 100) -> Column:
    """Precursor row (precursor, 1.1), the n strongest in input order scaled to the base peak, zero padding.

    Equal intensities at the cut keep the later peak.
    """
    p = col(peaks)
    indexed = F.transform(p, lambda x, i: F.struct((-x["i"]).alias("k"), (-i).alias("j"), x["mz"].alias("mz")))
    kept = F.slice(F.array_sort(indexed), 1, n)
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct((-x["j"]).alias("j"), x["mz"].alias("mz"),
                                                               (-x["k"]).alias("i"))))
    scaled = let(base_peak(p), lambda m: F.transform(ordered, lambda x: peak(x["mz"], F.try_divide(x["i"], m))))
    head = F.array(peak(col(precursor), F.lit(1.1)))
    pad = F.array_repeat(peak(F.lit(0.0), F.lit(0.0)), F.greatest(F.lit(n) - F.size(scaled), F.lit(0)))
    return F.concat(head, scaled, pad)


def anchored_merge(peaks: Column | str, tolerance: float = 0.005) -> Column:
    """One survivor per anchored cluster.

    Peaks ascend in m/z; a peak opens a new cluster when it lies at least
    ``tolerance`` above the cluster's first mass. The most intense peak of a
    cluster survives, the lower m/z on ties. The anchor depends on earlier
    decisions, hence a fold rather than a gap rule.
    """
    ordered = F.transform(
        F.array_sort(F.transform(col(peaks), lambda p: F.struct(p["mz"].alias("mz"), (-p["i"]).alias("k")))),
        lambda p: peak(p["mz"], -p["k"]))
    empty = F.filter(ordered, lambda p: F.lit(False))
    start = F.struct(empty.alias("done"), F.lit(None).cast("double").alias("anchor"),
                     F.lit(None).cast("struct<mz:double,i:double>").alias("best"))

    def step(acc: Column, p: Column) -> Column:
        fresh = acc["anchor"].isNull() | (p["mz"] - acc["anchor"] >= F.lit(tolerance))
        done = F.when(fresh & acc["anchor"].isNotNull(), F.concat(acc["done"], F.array(acc["best"]))) \
            .otherwise(acc["done"])
        best = F.when(fresh | (p["i"] > acc["best"]["i"]), p).otherwise(acc["best"])
        return F.struct(done.alias("done"), F.when(fresh, p["mz"]).otherwise(acc["anchor"]).alias("anchor"),
                        best.alias("best"))

    return F.aggregate(ordered, start, step, lambda acc: F.when(
        acc["anchor"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["best"]))))


def scale_to_base(peaks: Column | str) -> Column:
    return let(col(peaks), lambda p: let(base_peak(p), lambda m: F.transform(p, lambda x: peak(x["mz"], F.try_divide(x["i"], m)))))


def fixed_point(c: Column, digits: int) -> Column:
    """Value scaled to an integer as text: identical in every engine."""
    return F.round(c * F.lit(float(10**digits))).cast("bigint").cast("string")


def signature(adduct: Column | str, precursor: Column | str, peaks: Column | str) -> Column:
    """Digest that ignores peak order and intensity scale (precursor and m/z 1e-4, intensity 1e-6).

    Null where no intensity is positive.
    """
    return let(F.array_sort(normalise(peaks)), lambda p: F.when(p.isNotNull(), F.sha2(F.concat_ws(
        "|", col(adduct), fixed_point(col(precursor), 4),
        F.array_join(F.transform(p, lambda x: fixed_point(x["mz"], 4)), ","),
        F.array_join(F.transform(p, lambda x: fixed_point(x["i"], 6)), ",")), 256)))


def fine_digest(adduct: Column | str, precursor: Column | str, peaks: Column | str, energies: Column | str) -> Column:
    """As ``signature`` at 1e-8 / 1e-12 and including the collision energies."""
    return let(F.array_sort(normalise(peaks)), lambda p: F.when(p.isNotNull(), F.sha2(F.concat_ws(
        "|", col(adduct), fixed_point(col(precursor), 8),
        F.array_join(F.transform(p, lambda x: fixed_point(x["mz"], 8)), ","),
        F.array_join(F.transform(p, lambda x: fixed_point(x["i"], 12)), ","),
        F.array_join(F.transform(col(energies), lambda e: fixed_point(e.cast("double"), 6)), ",")), 256)))


TOKEN_FIELDS = (
    "mz", "loss", "root", "log", "neutral", "precursor", "mz_frac", "loss_frac",
    "mz_sin", "mz_cos", "loss_sin", "loss_cos", "positive", "negative", "energy_mean", "energy_spread",
)


def peak_tokens(peaks: Column | str, precursor: Column | str, neutral: Column | str, z: Column | str,
                energies: Column | str, n: int = 32) -> Column:
    """Sixteen scaled features for each of the n strongest peaks below the precursor window."""
    prec, neu, charge, e = col(precursor), col(neutral), col(z), col(energies)
    mean = F.when(F.size(e) > 0, F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / F.size(e) / 200).otherwise(F.lit(0.0))
    spread = F.when(F.size(e) > 0, (F.array_max(e) - F.array_min(e)) / 200).otherwise(F.lit(0.0))
    two_pi = F.lit(6.283185307179586)

    def token(p: Column) -> Column:
        loss = prec - p["mz"]
        fm, fl = p["mz"] - F.floor(p["mz"]), loss - F.floor(loss)
        values = (
            p["mz"] / 2048, loss / 2048, F.sqrt(p["i"]), F.log1p(100 * p["i"]) / F.log(F.lit(101.0)),
            neu / 1200, prec / 1200, fm, fl, F.sin(two_pi * fm), F.cos(two_pi * fm), F.sin(two_pi * fl),
            F.cos(two_pi * fl), (charge > 0).cast("double"), (charge < 0).cast("double"), mean, spread)
        return F.struct(*[v.alias(f) for v, f in zip(values, TOKEN_FIELDS)])

    return F.transform(strongest(below(peaks, prec, fixed.REFERENCE_MARGIN), n), token)
