"""Sub-formula and fragment-hypothesis evidence as joins over derived tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom import fixed
from massloom.functions.numeric import tolerance
from massloom.operators.ranges import max_in_window, range_join

ATOM = "array<struct<element:string,count:int>>"


def states(composition: str):
    """Number of sub-compositions, as a double so that it cannot overflow."""
    return F.aggregate(F.col(composition), F.lit(1.0), lambda acc, a: acc * (a["count"] + 1))


def subformula_masses(formulas: DataFrame, key: str, composition: str, max_states: float = 2e6) -> DataFrame:
    """(key, mass): distinct masses of all sub-compositions of each distinct formula within budget.

    The budget is tested on a column before anything is generated. Each element
    multiplies the rows in place by its possible counts, so the only exchange is
    the final removal of duplicates.
    """
    def count(element: str):
        hit = F.filter(composition, lambda a: a["element"] == element)
        return F.coalesce(F.get(hit, 0)["count"], F.lit(0)).alias(f"n_{element}")

    elements = sorted(fixed.FORMULA_ELEMENTS)
    out = formulas.filter(states(composition) <= max_states).select(
        key, *[count(e) for e in elements]).distinct().withColumn("mass", F.lit(0.0))
    for e in elements:
        out = out.withColumn("k", F.explode(F.sequence(F.lit(0), F.col(f"n_{e}")))).withColumn(
            "mass", F.col("mass") + F.col("k") * F.lit(fixed.ELEMENT_MASS[e]))
    return out.select(key, "mass").distinct()


def fragment_peaks(spectra: DataFrame, keys: list[str], relative_floor: float = 0.01, ppm: float = 5.0,
                   da: float = 0.001) -> DataFrame:
    """Prepared peaks of the supported adducts: (keys, neutral, tol, weight), weights summing to 1 per spectrum."""
    from massloom.functions import peaks as pk

    s = spectra.filter(F.col("adduct").isin(*fixed.FORWARD_ADDUCTS))
    kept = pk.relative_floor(pk.merge_equal(pk.below("peaks", "precursor_mz", fixed.FORWARD_MARGIN)), relative_floor)
    shift = F.when(F.col("adduct") == "[M+H]+", F.lit(fixed.PROTON)).otherwise(F.lit(-fixed.PROTON))
    usable = F.filter(kept, lambda p: p["mz"] - shift > 0)
    norm = F.aggregate(F.col("__p"), F.lit(0.0), lambda acc, p: acc + F.sqrt(p["i"]))
    return (s.withColumn("__p", usable).withColumn("__shift", shift).withColumn("__norm", norm)
            .select(*keys, "__shift", "__norm", F.explode("__p").alias("p"))
            .select(*keys, (F.col("p.mz") - F.col("__shift")).alias("neutral"),
                    tolerance("p.mz", ppm, da).alias("tol"), (F.sqrt("p.i") / F.col("__norm")).alias("weight")))


def formula_evidence(peaks: DataFrame, masses: DataFrame, spectrum: list[str], formula: list[str],
                     width: float = 1.0) -> DataFrame:
    """Per (spectrum, formula): share of peak weight explained, mean share under three fixed shifts, clipped excess.

    ``peaks`` carries the formula key of every candidate it is tested against.
    """
    shifts = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(v).alias("d"))
                       for i, v in enumerate((0.0, *fixed.FORMULA_CONTROL_SHIFTS))])
    t = peaks.withColumn("__x", F.explode(shifts)).withColumn("__target", F.col("neutral") + F.col("__x.d")) \
        .withColumn("__s", F.col("__x.s")).drop("__x")
    ids = [*spectrum, *formula]
    probe = t.filter(F.col("__target") > 0).withColumn("__lo", F.col("__target") - F.col("tol")) \
        .withColumn("__hi", F.col("__target") + F.col("tol"))
    hit = range_join(probe, masses.withColumnRenamed("mass", "__mass"), "__lo", "__hi", "__mass", width, formula) \
        .select(*ids, "__s", "__target", "weight").distinct()
    share = hit.groupBy(*ids, "__s").agg(F.sum("weight").alias("share"))
    base = peaks.select(*ids).distinct()
    per = share.groupBy(*ids).agg(
        F.sum(F.when(F.col("__s") == 0, F.col("share")).otherwise(0.0)).alias("explained"),
        (F.sum(F.when(F.col("__s") > 0, F.col("share")).otherwise(0.0)) / len(fixed.FORMULA_CONTROL_SHIFTS)).alias("chance"))
    return base.join(per, ids, "left").fillna(0.0, ["explained", "chance"]).withColumn(
        "excess", F.least(F.greatest(F.col("explained") - F.col("chance"), F.lit(0.0)), F.lit(1.0)))


def group_formula_evidence(peaks: DataFrame, groups: DataFrame, formulas: DataFrame, group: str, spectrum: str, key: str, composition: str,
                           max_states: float = 2e6, width: float = 1.0) -> DataFrame:
    """Evidence for one formula per group, over all the group's spectra, whatever its outcome.

    ``groups`` names every spectrum of a group with the group's formula (group,
    spectrum, key), ``peaks`` the usable peaks (spectrum, neutral, tol, weight),
    ``formulas`` the compositions. A group without a usable spectrum is
    ``no_supported_spectra`` before its formula is looked at; then comes
    ``formula_budget_exceeded``. Else explained and chance are means over the
    supported spectra and the excess is that of the means.
    """
    known = formulas.select(key, composition).dropDuplicates([key]).withColumn("__fits", states(composition) <= max_states)
    masses = subformula_masses(known.where("__fits"), key, composition, max_states)
    size = masses.groupBy(key).agg(F.count(F.lit(1)).alias("subformula_states"))
    usable = peaks.select(spectrum).distinct().withColumn("__usable", F.lit(True))
    spectra = groups.select(group, spectrum, key).distinct().join(usable, spectrum, "left").join(known.select(key, "__fits"), key)
    total = spectra.groupBy(group, key).agg(F.count(F.lit(1)).alias("total_spectra"), F.count("__usable").alias("supported_spectra"), F.first("__fits").alias("__fits"))
    tested = peaks.join(spectra.where("__fits and __usable").select(group, spectrum, key), spectrum)
    per = formula_evidence(tested, masses, [group, spectrum], [key], width).groupBy(group, key).agg(
        F.avg("explained").alias("explained"), F.avg("chance").alias("chance"))
    status = F.when(F.col("supported_spectra") == 0, "no_supported_spectra").when(~F.col("__fits"), "formula_budget_exceeded").otherwise("scored")
    scored = F.col("status") == "scored"
    return (total.join(per, [group, key], "left").join(size, key, "left").withColumn("status", status)
            .select(group, key, "status", F.when(scored, F.col("supported_spectra")).otherwise(F.lit(0)).alias("supported_spectra"), "total_spectra",
                    F.when(scored, F.col("subformula_states")).otherwise(F.lit(0)).alias("subformula_states"), "explained", "chance",
                    F.when(scored, F.least(F.greatest(F.col("explained") - F.col("chance"), F.lit(0.0)), F.lit(1.0))).alias("excess")))


def fragment_hypotheses(fragments: DataFrame, key: list[str], hydrogen_shift: int = 1) -> DataFrame:
    """(key, hyp_mass, hyp_value, cuts): fragment masses under bounded hydrogen transfer.

    ``fragments``: mass, cuts, fragment_h, parent_h. A transfer may not exceed the
    number of cuts nor leave [0, parent_h]; its value is 1 / (cuts + |shift|).
    """
    limit = F.least(F.lit(hydrogen_shift), F.col("cuts"))
    h = fragments.withColumn("dh", F.explode(F.sequence(-limit, limit))).filter(
        (F.col("fragment_h") + F.col("dh")).between(F.lit(0), F.col("parent_h")))
    mass = F.col("mass") + F.col("dh") * F.lit(fixed.ELEMENT_MASS["H"])
    return (h.withColumn("hyp_mass", mass).filter(F.col("hyp_mass") > 0)
            .withColumn("hyp_value", 1.0 / (F.col("cuts") + F.abs("dh")).cast("double"))
            .groupBy(*key, "hyp_mass", "cuts").agg(F.max("hyp_value").alias("hyp_value")))


def hypothesis_score(peaks: DataFrame, hypotheses: DataFrame, key: list[str], spectrum: list[str], width: float = 1.0,
                     out: str = "score") -> DataFrame:
    """Sum over peaks of weight times the best hypothesis in the window, per (key, spectrum)."""
    best = max_in_window(peaks, hypotheses.select(*key, "hyp_mass", "hyp_value"), key, "neutral", "tol", width,
                         peak_key=spectrum)
    return best.groupBy(*key, *spectrum).agg(F.sum(F.col("weight") * F.col("best")).alias(out))


def theoretical_explanation(peaks: DataFrame, theoretical: DataFrame, key: list[str], spectrum: list[str],
                            ppm: float = 20.0, da: float = 0.01, width: float = 1.0) -> DataFrame:
    """Explained intensity share with a penalty for dense theoretical lists.

    ``peaks``: key, spectrum, mz, i (already below the precursor window);
    ``theoretical``: key, mass (already shifted and filtered).
    """
    ids = [*key, *spectrum]
    tol = tolerance("mz", ppm, da)
    probe = peaks.withColumn("__lo", F.col("mz") - tol).withColumn("__hi", F.col("mz") + tol)
    hit = range_join(probe, theoretical.select(*key, F.col("mass").alias("__mass")).distinct(),
                     "__lo", "__hi", "__mass", width, key).select(*ids, "mz", "i").distinct()
    got = hit.groupBy(*ids).agg(F.sum("i").alias("__got"))
    size = theoretical.select(*key, "mass").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    tot = peaks.groupBy(*ids).agg(F.sum("i").alias("__all"))
    return tot.join(got, ids, "left").join(size, key, "left").select(
        *ids, (F.coalesce("__got", F.lit(0.0)) / F.col("__all") / (1 + 0.002 * F.coalesce("__n", F.lit(0)))).alias("explained"))
