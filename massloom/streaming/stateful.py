"""Keyed state on the RocksDB store: sketches, event-time budgets and unlimited or bounded de-duplication.

State lives on the executors' disks and in the checkpoint folder; a batch loads
the keys it touches and nothing else. A restarted job goes on where it stopped.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """The RocksDB store for the queries started inside; the session's own choice comes back afterwards."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def finish(writer, checkpoint: str) -> StreamingQuery:
    """Works off all there is, in batches, and returns the ended query with its progress."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stored_by_batch(out: str):
    """A batch writes one folder named by its id, so a replay replaces its own output."""
    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return batch


def _types(schema, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in columns)


# Sketches -----------------------------------------------------------------

class _Sketch(StatefulProcessor):
    """Running count and sparse sums of a key, and its n lowest digests with what they carry."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle) -> None:
        # One value: each call to the store costs more than a small key's work.
        self.state = handle.getValueState("sketch", "count bigint, places array<int>, sums array<double>, "
                                          "low array<struct<digest: string, tie: bigint, places: array<int>, amounts: array<double>>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, places, sums, low = self.state.get() or (0, [], [], [])
        total = dict(zip(places, sums))
        low = {r[0]: (r[0], r[1], list(r[2]), list(r[3])) for r in low}
        for part in rows:
            count += len(part)
            for digest, tie, at, amounts in zip(part["digest"], part["tie"], part["places"], part["amounts"]):
                at, amounts = at.tolist(), amounts.tolist()
                for p, a in zip(at, amounts):
                    total[p] = total.get(p, 0.0) + a
                if isinstance(digest, str) and (digest not in low or tie < low[digest][1]):
                    low[digest] = (digest, int(tie), at, amounts)
                    if len(low) > self.n:
                        del low[max(low)]
        ordered = sorted(total)
        self.state.update((count, ordered, [total[p] for p in ordered], [low[d] for d in sorted(low)]))
        yield pd.DataFrame({"count": [count]})

    def close(self) -> None:
        pass


def sketch_stream(stream: DataFrame, key: list[str], digest: Column, tie: Column, places: Column, amounts: Column, checkpoint: str,
                  n: int = 3, salts: int = 8) -> StreamingQuery:
    """Feeds a sketch per key: rows bring a digest, and places with amounts to be added up.

    A key's rows are spread over ``salts`` partial sketches by their digests, so a
    key that fills the stream keeps several tasks busy; partial sketches merge on
    reading. Rows without a digest are counted and added, and never kept. Of rows
    with one digest the smallest ``tie`` is kept, in whatever order they come.
    """
    rows = stream.select(*key, F.pmod(F.xxhash64(digest), F.lit(salts)).cast("int").alias("salt"), digest.alias("digest"), tie.cast("bigint").alias("tie"),
                         F.coalesce(places, F.array()).cast("array<int>").alias("places"), F.coalesce(amounts, F.array()).cast("array<double>").alias("amounts"))
    with rocksdb(stream.sparkSession):
        state = rows.groupBy(*key, "salt").transformWithStateInPandas(_Sketch(n), "count bigint", "Update", "None")
        return finish(state.writeStream.outputMode("update").format("noop"), checkpoint)


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    with rocksdb(spark):
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def sketch_sums(spark: SparkSession, checkpoint: str, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(key, count) and (key, place, total) from the state as it stands."""
    state = _state(spark, checkpoint, "sketch").select(*[F.col(f"key.{k}").alias(k) for k in key], "value.*")
    sums = state.select(*key, F.explode(F.arrays_zip("places", "sums")).alias("s"))
    return (state.groupBy(*key).agg(F.sum("count").alias("count")),
            sums.groupBy(*key, F.col("s.places").alias("place")).agg(F.sum("s.sums").alias("total")))


def sketch_kept(spark: SparkSession, checkpoint: str, key: list[str], n: int = 3) -> DataFrame:
    """(key, rank, digest, tie, places, amounts): the n lowest digests of each key; at most n rows a partial sketch are ranked."""
    low = _state(spark, checkpoint, "sketch").select(*[F.col(f"key.{k}").alias(k) for k in key], F.inline("value.low"))
    ranked = low.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy("digest")))
    return ranked.where(F.col("rank") <= n)


_PARTS = {
    "counts": pa.schema([("owner", pa.string()), ("count", pa.int64())]),
    "sums": pa.schema([("owner", pa.string()), ("place", pa.int32()), ("total", pa.float64())]),
    "low": pa.schema([("owner", pa.string()), ("digest", pa.string()), ("tie", pa.int64()), ("places", pa.list_(pa.int32())), ("amounts", pa.list_(pa.float64()))]),
}


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _added(rows: pd.DataFrame, by: list[str], value: str) -> pd.DataFrame:
    """Sums of ``value``, in which NaN stays."""
    code = rows.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
    first = ~rows.duplicated(by)
    return rows.loc[first, by].assign(**{value: np.bincount(code, weights=rows[value].to_numpy(), minlength=int(first.sum()))})


class _Sketches(StatefulProcessor):
    """What ``_Sketch`` keeps, for all small keys (column owner) of a bucket in one value."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle) -> None:
        self.state = handle.getValueState("sketches", ", ".join(f"{part} binary" for part in _PARTS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        old = self.state.get()
        counts, sums, low = (pa.ipc.open_stream(bytes(v)).read_pandas() for v in old) if old else (schema.empty_table().to_pandas() for schema in _PARTS.values())
        counts = _added(pd.concat([counts, new[["owner"]].assign(count=1)], ignore_index=True), ["owner"], "count").astype({"count": "int64"})
        size = new["places"].map(len).to_numpy()
        if size.sum():
            fresh = pd.DataFrame({"owner": new["owner"].to_numpy().repeat(size), "place": np.concatenate(new["places"].to_list()).astype(np.int32),
                                  "total": np.concatenate(new["amounts"].to_list()).astype(np.float64)})
            sums = _added(pd.concat([sums, fresh], ignore_index=True), ["owner", "place"], "total")
        known = new.loc[new["digest"].map(lambda d: isinstance(d, str)), ["owner", "digest", "tie", "places", "amounts"]].astype({"tie": "int64"})
        low = pd.concat([low, known], ignore_index=True).sort_values(["owner", "digest", "tie"], kind="stable")
        low = low[~low.duplicated(["owner", "digest"])]
        low = low[low.groupby("owner", dropna=False).cumcount() < self.n]
        self.state.update(tuple(_bytes(pa.Table.from_pandas(t, schema, preserve_index=False).replace_schema_metadata())
                                for t, schema in zip((counts, sums, low), _PARTS.values())))
        yield pd.DataFrame({"count": [len(new)]})

    def close(self) -> None:
        pass


def sketches_stream(stream: DataFrame, key: str, digest: Column, tie: Column, places: Column, amounts: Column, checkpoint: str,
                    n: int = 3, buckets: int = 1024) -> StreamingQuery:
    """``sketch_stream`` for many small keys: a bucket of them costs as many calls to the store as one.

    A batch rewrites the buckets that it touches; a bucket's state grows with the
    keys over ``buckets``.
    """
    rows = stream.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), F.col(key).cast("string").alias("owner"),
                         digest.alias("digest"), tie.cast("bigint").alias("tie"),
                         F.coalesce(places, F.array()).cast("array<int>").alias("places"), F.coalesce(amounts, F.array()).cast("array<double>").alias("amounts"))
    with rocksdb(stream.sparkSession):
        state = rows.groupBy("bucket").transformWithStateInPandas(_Sketches(n), "count bigint", "Update", "None")
        return finish(state.writeStream.outputMode("update").format("noop"), checkpoint)


def sketches_part(spark: SparkSession, checkpoint: str, part: str, key: str, kind: str) -> DataFrame:
    """One of ``counts`` (key, count), ``sums`` (key, place, total) and ``low`` (key, digest, tie, places, amounts) from the state as it stands."""
    types = {"counts": "count bigint", "sums": "place int, total double", "low": "digest string, tie bigint, places array<int>, amounts array<double>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch[0].to_pylist():
                yield from pa.ipc.open_stream(value)

    rows = _state(spark, checkpoint, "sketches").select(f"value.{part}").mapInArrow(run, f"owner string, {types[part]}")
    return rows.withColumn("owner", F.col("owner").cast(kind)).withColumnRenamed("owner", key)


# De-duplication -------------------------------------------------------------

def dedup_stream(stream: DataFrame, keys: list[str], out: str, checkpoint: str, time: str | None = None, delay: str | None = None) -> dict[str, int]:
    """First appearances of keys; returns input rows, rows too late, and keys still in the state.

    Without ``delay`` keys are remembered for good, on disk, and a batch looks up
    its own keys only. With ``delay`` a key is forgotten once the watermark has
    passed its first appearance by that much, and rows behind the watermark are
    dropped and counted: the state holds one delay's worth of keys.
    """
    seen = stream.observe("input", F.count(F.lit(1)).alias("rows"))
    if delay is None:
        first = seen.select(*keys).dropDuplicates(keys)
    else:
        first = seen.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    with rocksdb(stream.sparkSession):
        query = finish(first.writeStream.outputMode("append").foreachBatch(stored_by_batch(out)), checkpoint)
    progress = [p for p in query.recentProgress if p.stateOperators]
    return {"rows": sum(p.observedMetrics["input"]["rows"] for p in query.recentProgress if "input" in p.observedMetrics),
            "late": sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress),
            "held": progress[-1].stateOperators[0].numRowsTotal if progress else 0}


# Trailing budgets -------------------------------------------------------------

class _Trailing(StatefulProcessor):
    """Events of a bucket of keys and a cell of time, judged in order as soon as the watermark has passed them."""

    def __init__(self, key: list[str], span: int, cap: int, cell: int):
        self.key, self.span, self.cap, self.cell = key, span, cap, cell

    def init(self, handle) -> None:
        # One value for all keys of a bucket: each call to the store costs more than hundreds of events.
        self.handle = handle
        self.state = handle.getValueState("held", "done bigint, events binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [part[[*self.key, "us", "tie", "own"]] for part in rows]
        return self._judge(key, fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._judge(key, [], timerValues)

    def _judge(self, key, fresh: list[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, events = self.state.get() or (np.iinfo(np.int64).min, None)
        parts = [part for part in fresh if len(part)] if events is None else [pa.ipc.open_stream(bytes(events)).read_pandas(), *fresh]
        if not parts:
            self.state.clear()
            return
        held = pd.concat(parts, ignore_index=True)
        held["__code"] = held.groupby(self.key, dropna=False, sort=False).ngroup()
        held = held.sort_values(["__code", "us", "tie"], kind="stable", ignore_index=True)
        us, own, code = held["us"].to_numpy(np.int64), held["own"].to_numpy(bool), held.pop("__code").to_numpy(np.int64)
        upto = max(done, timerValues.getCurrentWatermarkInMs() * 1000)
        ready = np.flatnonzero(own & (us >= done) & (us < upto))
        if len(ready):
            # Key by key and time by time in one row of numbers: the place of an instant among all instants, after those of earlier keys.
            instants = np.unique(us)
            first = code * (len(instants) + 1)
            at, low = first + np.searchsorted(instants, us, "right"), first + np.searchsorted(instants, us - self.span, "right")
            recent = np.searchsorted(at, at[ready], "right") - np.searchsorted(at, low[ready], "right")
            allowed = recent < self.cap
            before, start = ready - (self.cap - 1), np.searchsorted(code, code[ready], "left")
            free = np.where(allowed, us[ready], us[np.maximum(before, start)] + self.span)
            known = allowed | (before >= start)
            yield pd.DataFrame({**{k: held[k].to_numpy()[ready] for k in self.key}, "tie": held["tie"].to_numpy()[ready], "recent": recent, "allowed": allowed,
                                "next_free": pd.array(free, "Int64").copy() if known.all() else pd.array(np.where(known, free, None), "Int64")})
        end = (int(key[-1]) + 1) * self.cell
        if upto >= end:
            self.state.clear()
            return
        kept = pa.Table.from_pandas(held[us > upto - self.span], preserve_index=False).replace_schema_metadata()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept.schema) as writer:
            writer.write_table(kept)
        self.state.update((int(upto), sink.getvalue().to_pybytes()))
        ahead = us[own & (us >= upto)]
        self.handle.registerTimer(int((ahead.min() if len(ahead) else end) // 1000 + 1))

    def close(self) -> None:
        pass


def trailing_stream(stream: DataFrame, key: list[str], time: str, micros: Column, tie: str, out: str, checkpoint: str, delay: str = "1 hour",
                    hours: int = 24, cap: int = 2, cell_hours: int = 168, buckets: int = 256) -> StreamingQuery:
    """(key, tie, recent, allowed, next_free) of every event, once the watermark has passed it.

    The exact form of a trailing budget: events in (t - hours, t], whether fewer
    than ``cap`` leave room, and the instant of the next free place. Events may
    come in any order within ``delay``. State is held per bucket of keys and cell
    of time, an event near a cell's end also in the next one, so no state or task
    holds a key's whole history; a timer at the cell's end lets it go. ``buckets``
    bounds the calls to the store, its state grows with the events of a window
    over ``buckets``. Rows without a time
    are left out; rows without a tie are no events and only move the watermark.
    """
    span, cell = hours * 3_600_000_000, cell_hours * 3_600_000_000
    if cell < span:
        raise ValueError("a cell must hold the window")
    us = micros.cast("bigint")
    own = F.floor(us / cell).cast("bigint")
    last = F.floor((us + (span - 1)) / cell).cast("bigint")
    both = F.array_distinct(F.array(own, last))
    # A row without a tie only moves time on. The condition names the time, so it stays above the watermark.
    counted = F.when(F.col(time).isNotNull(), F.col(tie).isNotNull()).otherwise(F.lit(False))
    rows = stream.withWatermark(time, delay).where(counted).select(*key, time, F.col(tie).cast("bigint").alias("tie"), us.alias("us"), own.alias("home"), F.explode(both).alias("cell"))
    # Keys travel as text: pandas has no integers with gaps.
    kinds = {k: stream.schema[k].dataType for k in key}
    text = [(F.base64(k) if kinds[k].simpleString() == "binary" else F.col(k).cast("string")).alias(f"key{i}") for i, k in enumerate(key)]
    back = [(F.unbase64(f"key{i}") if kinds[k].simpleString() == "binary" else F.col(f"key{i}").cast(kinds[k])).alias(k) for i, k in enumerate(key)]
    names = [f"key{i}" for i in range(len(key))]
    rows = rows.select(*text, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket"), "cell", time, "us", "tie", (F.col("home") == F.col("cell")).alias("own"))
    schema = ", ".join(f"{n} string" for n in names) + ", tie bigint, recent bigint, allowed boolean, next_free bigint"
    with rocksdb(stream.sparkSession):
        state = rows.groupBy("bucket", "cell").transformWithStateInPandas(_Trailing(names, span, cap, cell), schema, "Append", "EventTime")
        state = state.select(*back, "tie", "recent", "allowed", "next_free")
        return finish(state.writeStream.outputMode("append").foreachBatch(stored_by_batch(out)), checkpoint)
