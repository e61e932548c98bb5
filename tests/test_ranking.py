"""Ranked lists, gates, certificates and metrics."""
import math
import random

import pytest
from pyspark.sql import functions as F

from massloom.operators import certified, metrics, ranking


def case(spark, scores, keys, extra=None):
    rows = [("q", i, k, float(s), *(e if isinstance(e, tuple) else (e,)) * (extra is not None)) for i, (s, k, e) in
            enumerate(zip(scores, keys, extra or [None] * len(keys)))]
    return spark.createDataFrame(rows, "q string, pos int, key string, score double" + (", e double" if extra else ""))


def rank_of(spark, scores, keys, truth):
    top = ranking.distinct_top_k(case(spark, scores, keys), ["q"], "key", "score", ["pos"])
    t = spark.createDataFrame([("q", truth)], "q string, truth string")
    return ranking.truth_ranks(t, top, ["q"], "truth", "key").first()["rank"]


def test_distinct_rank_golden(spark):
    assert rank_of(spark, [3, 2, 1], list("AAB"), "B") == 2
    assert rank_of(spark, [3, 2, 1], list("AAB"), "C") == 0
    keys = [f"k{i}" for i in range(30)]
    assert rank_of(spark, range(30, 0, -1), keys, "k26") == 0
    assert rank_of(spark, range(30, 0, -1), keys, "k24") == 25


@pytest.mark.parametrize("bounded", [False, True])
def test_distinct_top_k_random(spark, bounded):
    rng = random.Random(8)
    rows = [(q, i, f"k{rng.randint(0, 8)}", float(rng.randint(0, 5))) for q in range(12) for i in range(rng.randint(1, 40))]
    d = spark.createDataFrame(rows, "q int, pos int, key string, score double")
    got = {}
    for r in ranking.distinct_top_k(d, ["q"], "key", "score", ["pos"], 5, bounded=bounded).collect():
        got.setdefault(r.q, []).append((r["rank"], r.key))
    for q in range(12):
        seen = []
        for _, _, k in sorted((-s, p, k) for qq, p, k, s in rows if qq == q):
            if k not in seen:
                seen.append(k)
        assert [k for _, k in sorted(got[q])] == seen[:5]


def test_metrics_golden(spark):
    m = spark.createDataFrame([(1,), (2,), (0,), (26,)], "rank int").agg(*metrics.rank_metrics()).first()
    assert (m.mrr, m.top1, m.recall) == (0.375, 0.25, 0.5)
    empty = spark.createDataFrame([], "rank int").agg(*metrics.rank_metrics()).first()
    assert empty.molecules == 0 and empty.mrr is None


def gate(spark, neural, spectral, keys):
    d = case(spark, neural, keys, spectral).withColumnRenamed("e", "sim")
    g = ranking.gated_promotion(d, ["q"], "key", "score", "sim", "pos", 0.9, 0.1)
    rows = sorted(g.collect(), key=lambda r: (r.front, -r.score, r.pos))
    return [r.pos for r in rows], rows[0].activated, rows[0].gap


def test_gate_golden(spark):
    order, on, _ = gate(spark, [4, 3, 2, 1], [0.2, 0.1, 0.95, 0.3], list("abcd"))
    assert order == [2, 0, 1, 3] and on
    _, on, gap = gate(spark, [3, 2, 1], [0.1, 0.95, 0.94], list("abb"))
    assert on and gap == pytest.approx(0.85)
    order, on, _ = gate(spark, [3, 2, 1], [0.1, 0.95, 0.94], list("abc"))
    assert order == [0, 1, 2] and not on


def certified_rows(spark, base, bonus, weight, k):
    d = case(spark, base, [str(i) for i in range(len(base))], bonus)
    return certified.certified_rerank(d, ["q"], "score", "pos", weight, lambda df: F.col("e"), k)


def test_certified_golden(spark):
    c = certified_rows(spark, [4, 3, 2, -20, -30], [0.2] * 5, 0.25, 2)
    top = [r.pos for r in sorted(c.filter("rank is not null").collect(), key=lambda r: r["rank"])]
    s = certified.certificate_summary(c, ["q"]).first()
    assert top == [0, 1] and (s.evaluations, s.pruned) == (2, 3)
    s = certified.certificate_summary(certified_rows(spark, [1, 1], [0.0, 0.0], 0.1, 1), ["q"]).first()
    assert s.evaluations == 2


def test_certified_equals_full_scoring(spark):
    rng = random.Random(11)
    rows = [(q, i, round(rng.uniform(0, 1), 3), None if rng.random() < 0.2 else round(rng.random(), 3)) for q in range(25) for i in range(rng.randint(1, 60))]
    d = spark.createDataFrame(rows, "q int, pos int, score double, e double")
    c = certified.certified_rerank(d, ["q"], "score", "pos", 0.2, lambda df: F.col("e"), 5).cache()
    for q in range(25):
        full = sorted((-(s + 0.2 * (e or 0.0)), i) for qq, i, s, e in rows if qq == q)[:5]
        got = sorted((r["rank"], r.pos) for r in c.filter(f"q = {q} and rank is not null").collect())
        assert [p for _, p in got] == [i for _, i in full]
    v = certified.verify_certificate(c, ["q"], "score", "lower", "evaluated", "rank", "pos", 0.2, 5)
    assert all(sum(r[1:]) == 0 for r in v.collect())


def test_tampered_certificate_is_caught(spark):
    c = certified_rows(spark, [4, 3, 2, -20, -30], [0.2] * 5, 0.25, 2).withColumn(
        "lower", F.when(F.col("pos") == 4, F.lit(9.0)).otherwise(F.col("lower")))
    v = certified.verify_certificate(c, ["q"], "score", "lower", "evaluated", "rank", "pos", 0.25, 2).first()
    assert v.changed_unevaluated == 1 and v.wrong_rank > 0


def test_out_of_range_evidence_fails(spark):
    with pytest.raises(Exception, match="evidence"):
        certified_rows(spark, [1, 0], [1.5, 0.0], 0.1, 1).collect()


def test_frontier_golden(spark):
    d = spark.createDataFrame([("q", "x", "a", 3.0, 0), ("q", "x", "b", 2.0, 1), ("q", "y", "c", 3.0, 0), ("q", "y", "b", 2.0, 1)],
                              "q string, regime string, key string, score double, pos int")
    assert {r.key for r in ranking.frontier(d, ["q"], "regime", "key", "score", "pos", 1).collect()} == {"a", "c"}


def test_isomers_keep_formula_slots(spark):
    rows = [("q", 1, "F", 0.1), ("q", 2, "G", 0.9), ("q", 3, "F", 0.8), ("q", 4, None, 0.99)]
    d = spark.createDataFrame(rows, "q string, slot int, formula string, final double")
    assert {r.slot: r.new_slot for r in ranking.isomer_slots(d, ["q"], "formula", "slot", "final").collect()} == {1: 3, 2: 2, 3: 1, 4: 4}


def test_best_representative_golden(spark):
    d = spark.createDataFrame([("A", 0, 2), ("A", 1, 8), ("B", 2, 9)], "key string, id int, n int").filter("key <> 'B'")
    assert [tuple(r) for r in ranking.best_per_key(d, ["key"], [("n", True), ("id", False)]).collect()] == [("A", 8, 1)]


@pytest.mark.parametrize("fn", [metrics.paired_bootstrap, metrics.poisson_bootstrap])
def test_bootstrap_constant_and_zero(spark, fn):
    for value in (0.1, 0.0):
        d = spark.createDataFrame([(i, value) for i in range(40)], "id int, delta double")
        r = fn(d, "id", "delta", 120).first()
        assert r.units == 40 and r.delta == pytest.approx(value) and [r.lo, r.hi] == pytest.approx([value, value])


def test_missing_check_fails_the_gate(spark):
    r = spark.createDataFrame([(1.0, None)], "a double, b double")
    out = {x.check: x.passed for x in metrics.promotion_gate(r, {"a": F.col("a") > 0, "b": F.col("b") > 0}).collect()}
    assert out == {"a": True, "b": False}


def sequential(base, evidence, weight, k, budget):
    """One candidate after the other, in rounds that double: what the bounds prove at each round's end."""
    n = len(base)
    order = sorted(range(n), key=lambda i: (-base[i], i))
    size = min(k, budget)
    while True:
        done = set(order[:size])
        lower = [base[i] + (weight * (evidence[i] or 0.0) if i in done else 0.0) for i in range(n)]
        top = sorted(range(n), key=lambda i: (-lower[i], i))[:k]
        bound = math.nextafter(base[order[size]] + weight, math.inf) if size < n else None
        proven = bound is None or bound < lower[top[-1]]
        if proven or size >= budget:
            size = min(size, n)
            return top, size, sum(evidence[i] is None for i in order[:size]), proven, n - size if proven else None, bound
        size = min(2 * size, budget)


@pytest.mark.parametrize("budget", [None, 0, 1, 3, 7])
def test_threshold_rounds_prove_what_they_say(spark, budget):
    r = random.Random(6)
    cases = {q: [(round(r.choice([r.random(), 0.5]), 3), r.choice([None, 0.0, 1.0, r.random()])) for _ in range(r.choice([1, 2, 5, 40]))] for q in range(25)}
    cases[99] = [((100 - i) / 1000, 1.0 if i == 70 else 0.0) for i in range(100)]  # the best lies far down
    df = spark.createDataFrame([(q, i, b, e) for q, rows in cases.items() for i, (b, e) in enumerate(rows)], "q int, i int, base double, e double")
    ranked, certificate = certified.certified_search(df, ["q"], "base", "i", 0.25, lambda d: F.col("e"), 3, budget)
    lists, proofs = {}, {x.q: x for x in certificate.collect()}
    for x in ranked.orderBy("q", "rank").collect():
        lists.setdefault(x.q, []).append(x.i)
    for q, rows in cases.items():
        top, size, none, proven, pruned, bound = sequential([b for b, _ in rows], [e for _, e in rows], 0.25, 3, 10**9 if budget is None else budget)
        p = proofs[q]
        assert lists[q] == top
        assert (p.rows, p.evaluations, p.missing_evidence, p.certified, p.pruned, p.largest_open_bound) == (len(rows), size, none, proven, pruned, bound)
        if p.certified:  # a proven list is that of full evaluation
            full = sorted(range(len(rows)), key=lambda i: (-(rows[i][0] + 0.25 * (rows[i][1] or 0.0)), i))[:3]
            assert lists[q] == full


def test_evidence_is_asked_for_in_its_round_only(spark):
    df = spark.createDataFrame([(1, i, float(-i)) for i in range(50)], "q int, i int, base double")
    asked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def dear(i):
        asked.add(1)
        return 0.2

    ranked, certificate = certified.certified_search(df, ["q"], "base", "i", 0.25, lambda d: dear.asNondeterministic()("i"), 2)
    assert certificate.first().evaluations == 2 and ranked.count() == 2
    assert asked.value == 2


@pytest.mark.parametrize("bad", [1.5, -0.1, float("nan")])
def test_evidence_outside_its_bound_fails(spark, bad):
    df = spark.createDataFrame([(1, 0, 1.0, bad)], "q int, i int, base double, e double")
    with pytest.raises(Exception, match="evidence"):
        certified.certified_search(df, ["q"], "base", "i", 0.25, lambda d: F.col("e"), 1)
