"""Keyed state over several batches and restarts, against plain Python."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from massloom.operators import audits
from massloom.session import shared_dir
from massloom.streaming import jobs, stateful

HOUR = 3_600_000_000


@pytest.fixture
def folders(spark):
    return [shared_dir(spark, n) for n in ("in", "out", "state")]


def test_sketch_goes_on_after_a_restart(spark, folders):
    src, _, state = folders
    r = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 5}", f"d{r.randint(0, 40):02d}" if i % 11 else None, i, [r.randint(0, 6), 7], [float(r.randint(1, 9)), 1.0]) for i in range(400)]
    rows += [("hot", "d00", -5, None, None)]
    schema = "k string, digest string, tie long, places array<int>, amounts array<double>"
    for part in (rows[:150], rows[150:300], rows[300:]):  # each run finds the state of the one before
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(src)
        stream = jobs.read_stream(spark, spark.read.parquet(src).schema, src, files_per_batch=2)
        stateful.sketch_stream(stream, ["k"], F.col("digest"), F.col("tie"), F.col("places"), F.col("amounts"), state)
    counts, sums = stateful.sketch_sums(spark, state, ["k"])
    assert {x["k"]: x["count"] for x in counts.collect()} == Counter(x[0] for x in rows)
    total = Counter()
    for k, _, _, p, a in rows:
        for at, v in zip(p or [], a or []):
            total[k, at] += v
    assert {(x.k, x.place): x.total for x in sums.collect()} == total
    want = {}
    for k, d, tie, p, a in rows:
        if d is not None and (d not in want.setdefault(k, {}) or tie < want[k][d][0]):
            want[k][d] = (tie, p or [], a or [])
    got = {(x.k, x["rank"]): (x.digest, x.tie, x.places, x.amounts) for x in stateful.sketch_kept(spark, state, ["k"]).collect()}
    assert got == {(k, n + 1): (d, *v[d]) for k, v in want.items() for n, d in enumerate(sorted(v)[:3])}


def at(spark, src, rows, schema="k string, us long, id long"):
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros(F.col("us") + 1000 * HOUR)).coalesce(1).write.mode("append").parquet(src)


def test_late_rows_are_dropped_and_counted_and_old_keys_leave(spark, folders):
    src, out, state = folders
    batches = [[("a", 0, 1), ("b", HOUR, 2), ("a", HOUR, 3)], [("c", 10 * HOUR, 4)], [("e", 10 * HOUR, 8)], [("d", 2 * HOUR, 5), ("c", 9 * HOUR + 1, 6), ("a", 10 * HOUR, 7)]]
    for b in batches:
        at(spark, src, b)
    stream = jobs.read_stream(spark, spark.read.parquet(src).schema, src, files_per_batch=1)
    seen = stateful.dedup_stream(stream, ["k"], out, state, "ts", "2 hours")
    # d is 6 hours behind the watermark; a of the last batch comes after its first appearance was forgotten.
    assert seen["rows"] == 8 and seen["late"] == 1
    assert sorted((r.k, r.id in (1, 2, 3)) for r in spark.read.parquet(out).collect()) == [("a", False), ("a", True), ("b", True), ("c", False), ("e", False)]
    assert seen["held"] == 3


def test_unlimited_memory_outlives_restarts(spark, folders):
    src, out, state = folders
    for part in ([("a", 0, 1), (None, 0, 2)], [("a", 900 * HOUR, 3), ("b", 0, 4)], [(None, 0, 5), ("b", 1, 6), ("c", 1, 7)]):
        at(spark, src, part)
        stateful.dedup_stream(jobs.read_stream(spark, spark.read.parquet(src).schema, src), ["k"], out, state)
    assert sorted((r.k or "-", r.epoch) for r in spark.read.parquet(out).collect()) == [("-", 0), ("a", 0), ("b", 1), ("c", 2)]


def test_trailing_budget_equals_the_batch_form(spark, folders):
    src, out, state = folders
    r = random.Random(5)
    rows = [("hot" if i % 2 else f"u{i % 4}", r.randint(0, 400 * HOUR) // (HOUR // 4) * (HOUR // 4) + (i if i % 7 else 0), i) for i in range(1200)]
    rows.sort(key=lambda x: x[1] + r.randint(0, HOUR // 2))
    for part in (rows[:300], rows[300:700], rows[700:], [("u0", 2000 * HOUR, None)]):
        at(spark, src, part)
        stream = jobs.read_stream(spark, spark.read.parquet(src).schema, src, files_per_batch=1)
        query = stateful.trailing_stream(stream, ["k"], "ts", F.unix_micros("ts"), "id", out, state)
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal == 0  # closed cells are gone
    want = audits.trailing_budget(spark.createDataFrame(rows, "k string, us long, id long"), ["k"], "us", "id")
    pick = lambda df: sorted((x.k, x.id, x.recent, x.allowed) for x in df.collect())
    got = spark.read.parquet(out).withColumnRenamed("tie", "id")
    assert pick(got) == pick(want)
    free = lambda df: {x.id: x.next_free for x in df.collect()}
    a, b = free(got), free(want)
    assert all(a[i] == b[i] + 1000 * HOUR for i in a if b[i] is not None)
