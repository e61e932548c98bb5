"""Golden rows, invariances and brute-force twins for peak expressions."""
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from massloom import fixed
from massloom.functions import peaks as pk
from massloom.functions import similarity as sim
from massloom.operators.anchored import merge_peak_rows
from massloom.operators.features import group_mean, histogram

PEAKS = "array<struct<mz:double,i:double>>"


def one(spark, schema, row, expr):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


def pairs(p):
    return [(x["mz"], x["i"]) for x in p]


def test_equal_masses_merge_and_normalise(spark):
    v = one(spark, f"p {PEAKS}", ([(31.0, 4.0), (20.0, 0.0), (31.0, 5.0)],), pk.normalise(pk.merge_equal("p")))
    assert pairs(v) == [(31.0, 1.0)]


def test_signature_ignores_order_and_scale(spark):
    rows = [([(10.0, 1.0), (20.0, 3.0)],), ([(20.0, 30.0), (10.0, 10.0)],), ([(20.0, 30.0), (10.0, 11.0)],)]
    d = spark.createDataFrame(rows, f"p {PEAKS}").select(pk.signature(F.lit("[M+H]+"), F.lit(100.0), "p").alias("s")).collect()
    assert d[0].s == d[1].s != d[2].s


def greedy_reference(a, b, ppm, da, tie):
    edges = []
    for i, (m, x) in enumerate(a):
        for j, (n, y) in enumerate(b):
            if abs(m - n) <= max(da, m * ppm * 1e-6):
                w = math.sqrt(x) * math.sqrt(y)
                edges.append((-w, i, j) if tie == "low" else (-w, -i, -j))
    left, right, total = set(), set(), 0.0
    for w, i, j in sorted(edges):
        if i not in left and j not in right:
            left.add(i), right.add(j)
            total -= w
    norm = math.sqrt(sum(x for _, x in a)) * math.sqrt(sum(y for _, y in b))
    return min(1.0, total / norm) if norm else 0.0


@pytest.mark.parametrize("tie", ["low", "high"])
def test_cosine_against_brute_force(spark, tie):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        make = lambda: sorted({round(rng.uniform(50, 60), 2): rng.choice([1.0, 2.0, 3.0]) for _ in range(rng.randint(0, 7))}.items())
        rows.append((k, make(), make()))
    d = spark.createDataFrame(rows, f"k int, a {PEAKS}, b {PEAKS}")
    got = {r.k: r.v for r in d.select("k", sim.spectral_cosine("a", "b", 20.0, 0.6, tie).alias("v")).collect()}
    for k, a, b in rows:
        assert got[k] == pytest.approx(greedy_reference(a, b, 20.0, 0.6, tie), abs=1e-12)


def test_cosine_golden(spark):
    a, scaled, far, half = [(20.0, 4.0), (31.0, 9.0)], [(20.0, 200.0), (31.0, 450.0)], [(50.0, 1.0)], [(20.0, 1.0)]
    for other, check in ((a, lambda v: v == pytest.approx(1)), (scaled, lambda v: v == pytest.approx(1)),
                         (far, lambda v: v == 0), (half, lambda v: 0 < v < 1)):
        assert check(one(spark, f"a {PEAKS}, b {PEAKS}", (a, other), sim.spectral_cosine("a", "b")))


def test_nearest_mixture_golden(spark):
    grid = [(10.0, [(20.0, 1.0)]), (40.0, [(30.0, 1.0)])]
    schema = f"p {PEAKS}, e array<double>, g array<struct<energy:double,peaks:{PEAKS}>>"
    v = one(spark, schema, ([(20.0, 1.0)], [10.0, 40.0], grid), sim.pooled_forward("p", F.lit(100.0), "e", "g"))
    assert v["cosine_nearest"] == pytest.approx(2**-0.5)
    assert v["cosine_max"] == pytest.approx(1.0)


def test_histogram_golden_and_scale(spark):
    rows = [("a", 100.0, [(20.0, 4.0), (31.0, 9.0)]), ("b", 100.0, [(20.0, 40.0), (31.0, 90.0)])]
    h = histogram(spark.createDataFrame(rows, f"spectrum_id string, precursor_mz double, peaks {PEAKS}"), ["spectrum_id"])
    v = {(r.spectrum_id, r.channel, r.bin): r.value for r in h.collect()}
    assert v["a", 0, 20] == pytest.approx(2 / math.sqrt(13))
    assert all(v["a", c, b] == pytest.approx(v["b", c, b]) for _, c, b in [k for k in v if k[0] == "a"])


def test_group_mean_counts_absent_bins_as_zero(spark):
    f = spark.createDataFrame([(1, 0, 5, 1.0)], "spectrum_id int, channel int, bin int, value double")
    s = spark.createDataFrame([(1, "m"), (2, "m")], "spectrum_id int, g string")
    assert group_mean(f, s, "g").first()["value"] == 0.5


def anchored_reference(pairs_, tol):
    pairs_ = sorted(pairs_, key=lambda p: (p[0], -p[1]))
    out, i = [], 0
    while i < len(pairs_):
        j, best = i + 1, pairs_[i]
        while j < len(pairs_) and pairs_[j][0] - pairs_[i][0] < tol:
            if pairs_[j][1] > best[1]:
                best = pairs_[j]
            j += 1
        out.append(best)
        i = j
    return out


def test_anchored_merge_expression_and_rows(spark):
    rng = random.Random(3)
    rows = [(k, [(round(rng.uniform(0, 3), 3), rng.choice([1.0, 2.0, 5.0])) for _ in range(25)]) for k in range(20)]
    d = spark.createDataFrame(rows, f"k int, p {PEAKS}")
    expr = {r.k: pairs(r.v) for r in d.select("k", pk.anchored_merge("p", 0.25).alias("v")).collect()}
    flat = merge_peak_rows(d.select("k", F.explode("p").alias("x")).select("k", "x.mz", "x.i"), ["k"], "mz", "i", 0.25)
    table = {k: sorted((r.mz, r.i) for r in g) for k, g in itertools.groupby(sorted(flat.collect(), key=lambda r: r.k), lambda r: r.k)}
    for k, p in rows:
        want = anchored_reference(p, 0.25)
        assert expr[k] == want
        assert table[k] == sorted(want)


def test_pack_keeps_input_order_and_pads(spark):
    v = one(spark, f"p {PEAKS}", ([(5.0, 2.0), (9.0, 8.0), (7.0, 4.0)],), pk.pack("p", F.lit(50.0), 4))
    assert pairs(v) == [(50.0, 1.1), (5.0, 0.25), (9.0, 1.0), (7.0, 0.5), (0.0, 0.0)]


def test_bad_neighbour_does_not_invalidate(spark):
    rows = [([10.0], [1.0]), ([float("nan")], [1.0]), ([10.0], [0.0]), ([], []), ([10.0, 11.0], [1.0])]
    d = spark.createDataFrame(rows, "m array<double>, i array<double>")
    assert [r.v for r in d.select(pk.valid_arrays("m", "i").alias("v")).collect()] == [True, False, False, False, False]


def test_margins_are_strict(spark):
    v = one(spark, f"p {PEAKS}", ([(99.98, 1.0), (99.99, 1.0), (100.0, 1.0)],), pk.below("p", F.lit(100.0), fixed.REFERENCE_MARGIN))
    assert [x["mz"] for x in v] == [99.98]
