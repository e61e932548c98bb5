"""Range joins, nearest neighbours and ordered scans against brute force, with hot keys."""
import random

import pytest
from pyspark.sql import functions as F

from massloom.operators import ordering, quantiles, ranges


def catalog(spark, n=300, hot=100, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"k{rng.randint(0, 40)}", 500.0 if i < hot else round(rng.uniform(490, 510), 3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "structure_id int, structure_key string, mass double")


def queries(spark, n=60, hot=20, seed=2):
    rng = random.Random(seed)
    rows = [(i, 500.001 if i < hot else round(rng.uniform(480, 520), 3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "query_id int, obs double")


def test_golden_window(spark):
    c = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "structure_id int, mass double")
    q = spark.createDataFrame([(20.0,), (25.0,)], "obs double")
    assert [(r.obs, r.structure_id) for r in ranges.mass_candidates(q, c).collect()] == [(20.0, 2)]


@pytest.mark.parametrize("width", [0.01, 0.3, 50.0])
def test_mass_candidates_any_width(spark, width):
    (cr, c), (qr, q) = catalog(spark), queries(spark)
    got = {(r.query_id, r.structure_id) for r in ranges.mass_candidates(q, c, ppm=200.0, da=0.05, width=width).collect()}
    want = {(i, s) for i, o in qr for s, _, m in cr if abs(m - o) <= max(0.05, o * 200e-6)}
    assert got == want


def test_plan_has_no_nested_loop(spark):
    (_, c), (_, q) = catalog(spark), queries(spark)
    plan = ranges.mass_candidates(q, c)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_k_with_ties_and_hot_mass(spark):
    (cr, c), (qr, q) = catalog(spark), queries(spark)
    got = {}
    for r in ranges.nearest_k(q, c, 7).collect():
        got.setdefault(r.query_id, set()).add(r.structure_id)
    order = sorted(cr, key=lambda r: (r[2], r[1], r[0]))
    for i, o in qr:
        want = sorted(range(len(order)), key=lambda j: (abs(order[j][2] - o), j))[:7]
        assert got[i] == {order[j][0] for j in want}


def test_tiers_prefer_the_tightest_window(spark):
    c = spark.createDataFrame([(1, "a", 100.0), (2, "b", 100.015), (3, "c", 200.0)], "structure_id int, structure_key string, mass double")
    q = spark.createDataFrame([(1, 100.001), (2, 100.03), (3, 150.0)], "query_id int, obs double")
    got = sorted((r.query_id, r.structure_id, r.mode) for r in ranges.tiered_candidates(q, c, 2).collect())
    # For the last query 100.0 and 200.0 are equally far: the earlier catalogue row wins.
    nearest = "nearest_mass_no_compatible_structure"
    assert got == [(1, 1, "mass_compatible"), (2, 2, "expanded_mass_window"), (3, 1, nearest), (3, 2, nearest)]


def test_interval_union_golden(spark):
    q = spark.createDataFrame([(100.0,), (100.002,), (200.0,)], "obs double")
    w = ranges.query_windows(q)
    assert w.count() == 2
    probe = spark.createDataFrame([(99.994,), (100.008,), (200.006,), (150.0,)], "mass double")
    assert sorted(r.mass for r in ranges.inside_windows(probe, w).collect()) == [99.994, 100.008, 200.006]


def test_interval_union_random(spark):
    rng = random.Random(9)
    iv = [(a, a + rng.uniform(0, 3)) for a in (rng.uniform(0, 200) for _ in range(300))]
    want = []
    for lo, hi in sorted(iv):
        if want and lo <= want[-1][1]:
            want[-1][1] = max(want[-1][1], hi)
        else:
            want.append([lo, hi])
    got = sorted((r.lo, r.hi) for r in ordering.merge_intervals(spark.createDataFrame(iv, "a double, b double"), "a", "b").collect())
    assert got == [tuple(x) for x in want]


def test_global_rank_with_heavy_ties(spark):
    rows = [(i, 5.0 if i % 3 else float(i)) for i in range(900)]
    got = {r.i: r.pos for r in ordering.global_rank(spark.createDataFrame(rows, "i int, v double"), ["v", "i"]).collect()}
    assert got == {i: p for p, (v, i) in enumerate(sorted((v, i) for i, v in rows))}


def test_hard_negatives_brute_force(spark):
    cr, c = catalog(spark)
    got = {}
    for r in ranges.hard_negatives(c, 3, 500.0, 0.05).collect():
        got.setdefault(r.structure_id, []).append((r.rank, r.negative_id))
    for i, k, m in cr:
        near = sorted((abs(m2 - m), k2, j) for j, k2, m2 in cr if k2 != k and abs(m2 - m) <= max(0.05, m * 500e-6))
        seen, want = set(), []
        for _, k2, j in near:
            if k2 not in seen:
                seen.add(k2)
                want.append(j)
        assert [j for _, j in sorted(got.get(i, []))] == want[:3]


def test_nearest_keys_is_enough_for_the_list(spark):
    from massloom.operators.ranking import distinct_top_k

    (cr, c), (_, q) = catalog(spark), queries(spark)
    rows = ranges.nearest_keys(q.select("obs").distinct(), c, 4, 2000.0, 0.05).withColumn("s", -F.col("distance"))
    got = {}
    for r in distinct_top_k(rows, ["obs"], "structure_key", "s", ["structure_id"], 4, bounded=True).collect():
        got.setdefault(r.obs, []).append((r["rank"], r.structure_id))
    for o in {r.obs for r in q.collect()}:
        seen, want = set(), []
        for d, i, k in sorted((round(abs(m - o), 6), i, k) for i, k, m in cr if abs(m - o) <= max(0.05, o * 2000e-6)):
            if k not in seen:
                seen.add(k)
                want.append(i)
        assert [i for _, i in sorted(got.get(o, []))] == want[:4]


def test_nearest_error_has_no_reach(spark):
    values = spark.createDataFrame([(14.0,), (25.0,), (None,)], "v double")
    got = {r.v: r.error for r in ranges.nearest_error(values, spark.createDataFrame([(10.0,), (20.0,)], "m double"), "v", "m").collect()}
    assert got == {14.0: 4.0, 25.0: 5.0, None: None}


def test_quantiles(spark):
    import numpy as np

    rng = random.Random(4)
    data = {"hot": [round(rng.gauss(0, 1), 4) for _ in range(3001)], "few": [1.0, 2.0], "same": [7.0] * 200}
    d = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    for r in quantiles.exact_quantiles(d, ["g"], "v", [0.5, 0.95, 1.0]).collect():
        want = np.quantile(data[r.g], [0.5, 0.95, 1.0])
        assert [r.q0, r.q1, r.q2] == pytest.approx(list(want), abs=1e-9) and r.n == len(data[r.g])
