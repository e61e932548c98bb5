"""Nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to length one and rotated by a fixed random orthogonal
matrix; the signs of the result are its code, one bit per dimension, beside one
correction scalar: the inner product of the rotated vector with its own code
vector. With it the inner product with a query is estimated without bias from
the code alone, and the error stays within

    epsilon * sqrt((1 - c*c) / (c*c * (D - 1)))

but for a share of pairs that falls off as exp(-const * epsilon**2). Vectors
whose upper bound reaches the k-th best lower bound so far are reranked with
the exact cosine of the original vectors in double precision; the others are
never touched again.

Codes and vectors lie in blocks of bounded size. Every block meets every block
of queries, both by key; a meeting leaves at most k rows per query. Rows of a
query are then ranked from bounded, pre-reduced groups.

Vectors that are null, zero, of another dimension than most, or hold null or
non-finite components take no part, as candidate or query. Rows that share a
query's own id are no candidates for it. Repeated vectors are all candidates;
ties go to the smaller id.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom.llm.storage import block_ids, stored

BLOCK_ROWS = 4096
QUERY_BLOCK_ROWS = 4096
EPSILON = 4.0


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def one_bit_codes(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, correction scalar) of vectors of any length but zero."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ turn.T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[0])


def code_signs(codes: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1


def error_bound(scalar: np.ndarray, dim: int, epsilon: float) -> np.ndarray:
    c = np.clip(scalar.astype(np.float64), 1e-12, 1.0)
    return epsilon * np.sqrt((1 - c * c) / (c * c * max(1, dim - 1)))


def exact_cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors score alike wherever they lie."""
    dot = (rows * query).sum(axis=1)
    return dot / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def _blocks(dim: int, rows: int):
    schema = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary()), ("scalars", pa.binary())])

    def run(batches):
        numbers, turn = block_ids(), rotation(dim)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                ids = part.column("id").to_numpy(zero_copy_only=False).astype("<i8")
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("<f8")
                codes, scalars = one_bit_codes(v, turn)
                yield pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (
                    ids, v, codes, scalars.astype("<f8"))]], schema=schema)

    return run, "block long, ids binary, vectors binary, codes binary, scalars binary"


def _meet(dim: int, k: int, epsilon: float):
    schema = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        turn = rotation(dim)
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c: b.column(c)[i].as_py()
                ids, v = np.frombuffer(get("ids"), "<i8"), np.frombuffer(get("vectors"), "<f8").reshape(-1, dim)
                codes = np.frombuffer(get("codes"), np.uint8).reshape(len(ids), -1)
                scalar = np.frombuffer(get("scalars"), "<f8")
                qids, q = np.frombuffer(get("qids"), "<i8"), np.frombuffer(get("qvectors"), "<f8").reshape(-1, dim)
                turned = ((q / np.linalg.norm(q, axis=1, keepdims=True)) @ turn.T).astype(np.float32)
                estimate = (code_signs(codes, dim) @ turned.T).astype(np.float64) / np.sqrt(dim) / scalar[:, None]
                margin = error_bound(scalar, dim, epsilon)[:, None]
                out = [[], [], [], []]
                for j in range(len(qids)):
                    others = np.flatnonzero(ids != qids[j])
                    if not len(others):
                        continue
                    e = estimate[others, j]
                    lower = e - margin[others, 0]
                    floor = np.partition(lower, -k)[-k] if len(others) > k else -np.inf
                    near = others[e + margin[others, 0] >= floor]
                    score = exact_cosine(v[near], q[j])
                    best = np.lexsort((ids[near], -score))[:k]
                    out[0] += [int(qids[j])] * len(best)
                    out[1] += [(get("qblock") << 20) + j] * len(best)
                    out[2] += ids[near][best].tolist()
                    out[3] += score[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run, "query_id long, query_row long, vec_id long, score double"


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest cosines found for each query row."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK_ROWS))
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None or not common["d"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common["d"]
    rows = rows.where(F.size("v") == dim)
    run, schema = _blocks(dim, BLOCK_ROWS)
    index = stored(rows.select("id", "v").mapInArrow(run, schema), "codes")
    run, schema = _blocks(dim, QUERY_BLOCK_ROWS)
    few = max(1, -(-rows.where("asks").count() // QUERY_BLOCK_ROWS))  # full blocks, whatever the table's partitions
    asked = stored(rows.where("asks").select("id", "v").repartition(few).mapInArrow(run, schema), "queries").select(
        F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"))
    # Every block of codes is sent once to each block of queries and meets it by its number. Query
    # blocks are copied to a few streams where there are fewer of them than tasks.
    numbers = asked.agg(F.sort_array(F.collect_list("qblock")).alias("all"), F.lit(1).alias("one"))  # ids only, one per 4096 queries
    streams = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, asked.count()))
    asked = asked.withColumn("stream", F.explode(F.array(*[F.lit(i) for i in range(streams)])))
    sent = index.withColumn("one", F.lit(1)).join(F.broadcast(numbers), "one").select(
        "*", F.explode("all").alias("qblock"), F.pmod(F.hash("block"), F.lit(streams)).alias("stream")).drop("all", "one")
    run, schema = _meet(dim, k, epsilon)
    found = sent.join(asked.hint("shuffle_hash"), ["qblock", "stream"]).mapInArrow(run, schema)
    place = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
