"""Streaming queries: each runs to the end of its input and is compared with the batch result."""
from __future__ import annotations

from pyspark.sql import functions as F

from massloom import fixed
from massloom.functions.numeric import r6
from massloom.functions.text import epoch_micros
from massloom.operators import audits
from massloom.operators.ranges import nearest_keys
from massloom.operators.ranking import distinct_top_k
from massloom.plans.flagship import DA, PPM
from massloom.plans.q_aggregates import _BINS, _SIGNED, _hist, signed
from massloom.plans.q_rows import _WATER
from massloom.registry import query
from massloom.session import shared_dir
from massloom.streaming import jobs, stateful


def _stream(t, df, name: str, parts: int = 4):
    """Writes a derived table as several files and opens it as a stream of two batches at least."""
    src = shared_dir(t.spark, f"{name}-in")
    df.repartition(parts).write.parquet(src)
    out, state = shared_dir(t.spark, f"{name}-out"), shared_dir(t.spark, f"{name}-state")
    return jobs.read_stream(t.spark, t.spark.read.parquet(src).schema, src, files_per_batch=max(1, parts // 2)), out, state


def _timed_stream(t, df, name: str, time: str, last=None, slices: int = 4):
    """A stream whose batches follow each other in time, but for rows up to half an hour early or late."""
    src, out, state = (shared_dir(t.spark, f"{name}-{x}") for x in ("in", "out", "state"))
    shaken = F.unix_micros(time) + F.pmod(F.xxhash64(*df.columns), F.lit(1_800_000_000))
    cuts = df.agg(F.percentile_approx(F.unix_micros(time), [i / slices for i in range(1, slices)]).alias("c")).first()["c"] or []
    slot = sum((F.when(shaken >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(len(cuts) + 1):
        df.where(slot == i).coalesce(1).write.mode("append").parquet(src)
    if last is not None:
        last.select(*df.columns).coalesce(1).write.mode("append").parquet(src)
    return jobs.read_stream(t.spark, df.schema, src, files_per_batch=1), out, state


def _library(t):
    """Reference spectra with observed neutral mass, catalogue mass and a validity flag."""
    c = t.catalog.select(F.col("structure_id").alias("truth_id"), "mass")
    n = 1 + F.col("query_id") % 2
    shift = F.when(F.col("query_id") % 3 == 0, F.lit(18.010564684) / n).otherwise(F.lit(0.0))
    return t.queries.join(c, "truth_id").select("query_id", "truth_key", "mass", (F.col("obs") - shift).alias("neutral"),
                                                (F.col("query_id") % 13 != 0).alias("valid"))


_LIB = _WATER.replace("SELECT q.query_id, 1", "SELECT q.query_id, q.truth_key, q.query_id % 13 <> 0 AS valid, 1")


@query("X1_incremental_ingestion", f"""
    WITH {_LIB} SELECT CASE WHEN NOT valid THEN 'invalid_spectrum_or_adduct' WHEN NOT abs(neutral - mass) <= greatest(0.003, mass * 50.0 * 1e-6) THEN 'precursor_inconsistent' ELSE 'accepted' END AS reason,
        count(*) AS rows FROM w GROUP BY 1""")
def incremental_ingestion(t):
    s, out, state = _stream(t, _library(t), "ingest")
    jobs.ingest(s, lambda df: audits.admit(df, F.col("valid"), "mass", "neutral"), out, state)
    return jobs.ingest_counters(t.spark, out)


@query("X1_ingested_rows", f"""
    WITH {_LIB} SELECT query_id, round(neutral, 6) AS neutral FROM w WHERE valid AND abs(neutral - mass) <= greatest(0.003, mass * 50.0 * 1e-6)""")
def ingested_rows(t):
    s, out, state = _stream(t, _library(t), "ingest")
    jobs.ingest(s, lambda df: audits.admit(df, F.col("valid"), "mass", "neutral"), out, state)
    return jobs.ingested(t.spark, out).select("query_id", r6("neutral").alias("neutral"))


@query("X2_online_sketch", """
    WITH d AS (SELECT lang, source, sha256(text) AS digest, n_chars FROM documents),
    s AS (SELECT lang, source, count(*) AS count, sum(n_chars)::BIGINT AS chars FROM d GROUP BY 1, 2),
    l AS (SELECT lang, source, list_sort(list(DISTINCT digest))[1:3] AS low FROM d GROUP BY 1, 2)
    SELECT s.lang, s.source, s.count, s.chars, array_to_string(l.low, ',') AS lowest FROM s JOIN l ON l.lang = s.lang AND l.source = s.source""")
def online_sketch(t):
    d = t.table("documents").select("lang", "source", F.sha2("text", 256).alias("digest"), "n_chars", "doc_id")
    s, _, state = _stream(t, d, "sketch")
    key = ["lang", "source"]
    stateful.sketch_stream(s, key, F.col("digest"), F.col("doc_id"), F.array(F.lit(0)), F.array(F.col("n_chars").cast("double")), state)
    counts, sums = stateful.sketch_sums(t.spark, state, key)
    low = stateful.sketch_kept(t.spark, state, key)
    text = F.array_join(F.array_sort(F.collect_list("digest")), ",")
    return counts.join(sums.select(*key, F.col("total").cast("bigint").alias("chars")), key).join(low.groupBy(*key).agg(text.alias("lowest")), key)


@query("X2_online_features", f"""
    WITH {_SIGNED}, {_BINS}, n AS (SELECT molecule_id, count(*) AS n FROM spectra_v s JOIN raw_lists_v USING (spectrum_id) GROUP BY 1),
    low AS (SELECT *, row_number() OVER (PARTITION BY molecule_id ORDER BY signature) AS rank FROM (
        SELECT molecule_id, signature, min(spectrum_id) AS spectrum_id FROM sig WHERE signature IS NOT NULL GROUP BY 1, 2)),
    kn AS (SELECT molecule_id, count(*) AS n FROM low WHERE rank <= 3 GROUP BY 1),
    k AS (SELECT low.molecule_id, channel, bin, sum(value) / max(kn.n) AS kept FROM low JOIN kn ON kn.molecule_id = low.molecule_id JOIN f ON f.spectrum_id = low.spectrum_id WHERE rank <= 3 GROUP BY 1, 2, 3),
    a AS (SELECT s.molecule_id, f.channel, f.bin, sum(f.value) / max(n.n) AS value FROM f JOIN spectra_v s ON s.spectrum_id = f.spectrum_id JOIN n ON n.molecule_id = s.molecule_id GROUP BY 1, 2, 3)
    SELECT a.molecule_id, a.channel, a.bin, round(value, 6) AS value, round(coalesce(kept, 0), 6) AS kept
    FROM a LEFT JOIN k ON k.molecule_id = a.molecule_id AND k.channel = a.channel AND k.bin = a.bin""")
def online_features(t):
    """Mean features of a molecule over all its spectra and over its three of lowest digest, from one pass of batches."""
    place = (F.col("channel") * fixed.BINS + F.col("bin")).alias("place")
    sparse = _hist(t).select("spectrum_id", F.struct(place, "value").alias("f")).groupBy("spectrum_id").agg(F.array_sort(F.collect_list("f")).alias("f"))
    rows = signed(t).select("molecule_id", "spectrum_id", "signature").join(sparse, "spectrum_id", "left")
    s, _, state = _stream(t, rows, "features")
    key, kind = ["molecule_id"], dict(rows.dtypes)["molecule_id"]
    stateful.sketches_stream(s, *key, F.col("signature"), F.col("spectrum_id"), F.col("f.place"), F.col("f.value"), state)
    counts, sums, low = (stateful.sketches_part(t.spark, state, part, *key, kind) for part in ("counts", "sums", "low"))
    of = low.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    kept = low.select(*key, F.explode(F.arrays_zip("places", "amounts")).alias("f")).groupBy(*key, F.col("f.places").alias("place")).agg(F.sum("f.amounts").alias("kept"))
    both = sums.join(counts, key).join(kept.join(of, key), [*key, "place"], "left")
    return both.select("molecule_id", F.floor(F.col("place") / fixed.BINS).cast("int").alias("channel"), (F.col("place") % fixed.BINS).cast("int").alias("bin"),
                       r6(F.col("total") / F.col("count")).alias("value"), r6(F.coalesce(F.col("kept") / F.col("n"), F.lit(0.0))).alias("kept"))


@query("X3_streaming_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def streaming_dedup(t):
    """First event per (user, type) over batches of any age: equal to a batch distinct."""
    s, out, state = _stream(t, t.table("events").select("user_id", "event_type"), "dedup")
    stateful.dedup_stream(s, ["user_id", "event_type"], out, state)
    return t.spark.read.parquet(out).select("user_id", "event_type")


@query("X3_daily_dedup", "SELECT DISTINCT user_id, event_type, (epoch_us(ts) // 86400000000)::BIGINT AS day FROM events")
def daily_dedup(t):
    """First event per (user, type, day) of a stream in rough order of time; keys older than a day leave the state."""
    us = epoch_micros("ts")
    e = t.table("events").select("user_id", "event_type", F.floor(us / 86_400_000_000).alias("day"), F.timestamp_micros(us).alias("ts"))
    s, out, state = _timed_stream(t, e, "daily", "ts")
    stateful.dedup_stream(s, ["user_id", "event_type", "day"], out, state, "ts", "1 day")
    return t.spark.read.parquet(out).select("user_id", "event_type", "day")


@query("X4_trailing_budget", """
    WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events),
    w AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent,
                 lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS prev FROM e)
    SELECT event_id, recent, recent < 2 AS allowed, CASE WHEN recent < 2 THEN us ELSE prev + 86400000000 END AS next_free FROM w""")
def trailing_budget_stream(t):
    """The exact trailing day of every event, from events an hour out of order; a last row without event moves time past them all."""
    e = t.table("events").select("event_id", "user_id", F.timestamp_micros(epoch_micros("ts")).alias("ts"))
    late = e.agg(F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("user_id"), (F.max("ts") + F.expr("interval 30 days")).alias("ts"))
    s, out, state = _timed_stream(t, e, "trailing", "ts", late)
    stateful.trailing_stream(s, ["user_id"], "ts", F.unix_micros("ts"), "event_id", out, state)
    return t.spark.read.parquet(out).select(F.col("tie").alias("event_id"), "recent", "allowed", "next_free")


@query("X4_sliding_budget", """
    WITH e AS (SELECT event_type, epoch_us(ts) AS us FROM events),
    w AS (SELECT event_type, unnest(range(us // 3600000000 - 23, us // 3600000000 + 1)) AS h FROM e)
    SELECT event_type, h * 3600 AS start_s, count(*) AS events FROM w GROUP BY 1, 2""")
def sliding_budget(t):
    e = t.table("events").select("event_type", F.timestamp_micros(epoch_micros("ts")).alias("ts"))
    s, out, state = _stream(t, e, "budget")
    jobs.sliding_counts(s, "ts", ["event_type"], out, state)
    return jobs.sliding_windows(t.spark, out, ["event_type"]).select("event_type", "start_s", F.col("count").alias("events"))


@query("X5_query_microbatches", """
    WITH r AS (SELECT obs, structure_key, row_number() OVER (PARTITION BY obs ORDER BY d, structure_id) AS rank FROM (
        SELECT p.obs, c.structure_key, c.structure_id, round(abs(c.mass - p.obs), 6) AS d,
               row_number() OVER (PARTITION BY p.obs, c.structure_key ORDER BY round(abs(c.mass - p.obs), 6), c.structure_id) AS rk
        FROM (SELECT DISTINCT obs FROM queries_v) p JOIN catalog_v c
          ON c.mass BETWEEN p.obs - greatest(0.02, p.obs * 300.0 * 1e-6) AND p.obs + greatest(0.02, p.obs * 300.0 * 1e-6)) WHERE rk = 1)
    SELECT q.query_id, r.structure_key, r.rank::INTEGER AS rank FROM queries_v q JOIN r ON r.obs = q.obs WHERE r.rank <= 3""")
def query_microbatches(t):
    def rank(batch):
        rows = nearest_keys(batch.select("obs").distinct(), t.catalog, 3, PPM, DA, width=0.6).withColumn("closeness", -F.col("distance"))
        top = distinct_top_k(rows, ["obs"], "structure_key", "closeness", ["structure_id"], 3, bounded=True)
        return batch.join(top, "obs").select("query_id", "structure_key", "rank")

    s, out, state = _stream(t, t.queries.select("query_id", "obs"), "match")
    jobs.match_stream(s, rank, out, state)
    return t.spark.read.parquet(out).select("query_id", "structure_key", "rank")
