"""Evidence over all spectra of a molecule: means, counts and the order of what can go wrong."""
import pytest
from pyspark.sql import functions as F

from massloom.functions import similarity
from massloom.operators import evidence

ACQUIRED = "g string, peaks array<struct<mz:double,i:double>>, precursor double, adduct string, ce array<double>"
GRID = "g string, adduct string, grid array<struct<energy:double,peaks:array<struct<mz:double,i:double>>>>"


def pooled(spark, acquired, grid):
    made = similarity.pool_acquisitions(spark.createDataFrame(acquired, ACQUIRED), spark.createDataFrame(grid, GRID), ["g"], "peaks", "precursor", "adduct", "ce", "grid")
    return {r.g: r for r in made.collect()}


def test_pooling_takes_every_supported_acquisition(spark):
    two = [(10.0, [(20.0, 1.0)]), (40.0, [(30.0, 1.0)])]
    got = pooled(spark, [
        ("both", [(20.0, 1.0)], 100.0, "[M+H]+", [10.0]), ("both", [(30.0, 1.0)], 100.0, "[M+H]+", [10.0]), ("both", [(30.0, 1.0)], 100.0, "[M+Na]+", [10.0]),
        ("mix", [(20.0, 1.0)], 100.0, "[M+H]+", [10.0, 40.0]), ("none", [(20.0, 1.0)], 100.0, "[M+Na]+", [20.0]), ("gridless", [(20.0, 1.0)], 100.0, "[M-H]-", None),
        ("odd", [(20.0, 1.0)], 100.0, "[M+H]+", [float("nan"), -3.0, None, 12.0]), ("unknown", [(20.0, 1.0)], 100.0, "[M+H]+", [float("inf")])],
        [(g, "[M+H]+", two) for g in ("both", "mix", "gridless", "odd", "unknown")] + [("none", "[M+Na]+", two)])
    b = got["both"]
    assert (b.supported_spectra, b.total_spectra) == (2, 3)
    assert b.cosine_nearest == pytest.approx(0.5) and b.cosine_max == pytest.approx(1.0)
    assert got["mix"].cosine_nearest == pytest.approx(2 ** -0.5)
    for g in ("none", "gridless"):
        assert (got[g].supported_spectra, got[g].total_spectra, got[g].cosine_max) == (0, 1, None)
    assert got["odd"].cosine_nearest == pytest.approx(1.0)
    assert got["unknown"].cosine_nearest == pytest.approx(2 ** -0.5)  # no energy left: the whole grid


def test_an_empty_side_matches_nothing(spark):
    d = spark.createDataFrame([([(20.0, 1.0)], [(99.9, 1.0)], 100.0), ([], [(20.0, 1.0)], 100.0), ([(20.0, 0.0)], [(20.0, 1.0)], 100.0)],
                              "a array<struct<mz:double,i:double>>, b array<struct<mz:double,i:double>>, p double")
    for r in d.select(similarity.compare_spectra("a", "b", "p").alias("s")).collect():
        assert tuple(r.s) == (0.0, 0.0, 0.0, 0)


def test_formula_evidence_of_a_group(spark):
    water, methane = 18.0105646863, 16.0313001284
    peaks = spark.createDataFrame([(1, water, 0.001, 0.5), (1, 500.0, 0.001, 0.5), (2, methane, 0.001, 1.0), (3, water, 0.001, 1.0), (6, water, 0.001, 1.0)],
                                  "s int, neutral double, tol double, weight double")
    groups = spark.createDataFrame([("a", 1, "CH6O"), ("a", 2, "CH6O"), ("a", 9, "CH6O"), ("b", 4, "BIG"), ("c", 6, "BIG"), ("d", 5, "CH6O"), ("a", 1, "CH6O")],
                                   "g string, s int, f string")
    formulas = spark.createDataFrame([("CH6O", [("C", 1), ("H", 6), ("O", 1)]), ("BIG", [("C", 100), ("H", 200)])], f"f string, atoms {evidence.ATOM}")
    got = {r.g: r for r in evidence.group_formula_evidence(peaks, groups, formulas, "g", "s", "f", "atoms", max_states=1000).collect()}
    a = got["a"]
    assert (a.status, a.supported_spectra, a.total_spectra) == ("scored", 2, 3)
    assert a.explained == pytest.approx(0.75) and a.chance == pytest.approx(0.0) and a.excess == pytest.approx(0.75)
    assert a.subformula_states == 2 * 7 * 2
    # A group without usable peaks says so even where its formula is beyond the budget.
    assert (got["b"].status, got["b"].explained, got["b"].total_spectra) == ("no_supported_spectra", None, 1)
    assert (got["c"].status, got["c"].excess) == ("formula_budget_exceeded", None)
    assert (got["d"].status, got["d"].excess) == ("no_supported_spectra", None)
    assert not {r.g for r in evidence.group_formula_evidence(peaks.where("false"), groups.where(F.lit(False)), formulas, "g", "s", "f", "atoms").collect()}
