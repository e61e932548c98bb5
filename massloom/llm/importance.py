"""Target-distribution importance resampling over hashed word n-grams.

Pass one counts n-gram buckets of the corpus and of the target texts, one array
of ``buckets`` numbers per task. A bucket's gain is the logarithm of the ratio
of the two smoothed shares. Pass two reads the texts again and gives each
document the floored mean gain of its n-grams. Scores add Gumbel noise from the
document's id, so the highest scores are a draw without replacement in
proportion to the weights; ranks come from range partitions.

Texts are handled by the batch: they are joined with sentinel bytes that no word
holds, one regular expression finds all words, binary search in the documents'
offsets tells whose they are, and n-grams that run from one document into the
next are masked before counting. Words are taken in runs, so a text of any
length needs the memory of one run.

Null and empty texts have no n-grams: weight 0. Repeated rows are drawn on their
own; rows equal in score and id take their ranks by their numbers, then by row.
A null id hashes as an empty text and comes last among equal scores. Without any
n-gram in the target, or in the corpus, the smoothed shares still give gains.
An empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

import math
import re
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.arrays import small_batches, text_buffer
from massloom.llm.storage import BLOCK_BYTES, bounded_batches, stored
from massloom.operators.ordering import global_rank

#: Bytes of words once A-Z is lower-cased: digits, small letters and all of non-ASCII characters.
WORD = re.compile(rb"[0-9a-z\x80-\xFF]+")
SENTINEL = b"\x00"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Words looked at together.
RUN = 1 << 17

_start, _text = re.Match.start, re.Match.group


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _byte_table()


def then_space(crc: np.ndarray) -> np.ndarray:
    """Checksums of the same bytes with one space behind them."""
    c = ~crc
    return ~(_TABLE[(c ^ np.uint32(0x20)) & np.uint32(255)] ^ (c >> np.uint32(8)))


def joined(buf: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts of a batch with a sentinel behind each, lower-cased, and where each begins."""
    raw = buf.tobytes()
    ends = off.tolist()
    return SENTINEL.join([raw[a:b] for a, b in zip(ends[:-1], ends[1:])]).translate(LOWER), off[:-1] + np.arange(len(off) - 1)


def ngram_runs(buf: np.ndarray, off: np.ndarray, longest: int):
    """Yields (document index, checksum) arrays of all n-grams of 1 to ``longest`` words, a run of words at a time."""
    text, begins = joined(buf, off)
    found = WORD.finditer(text)
    words, starts = [], np.zeros(0, np.int64)
    while True:
        fresh = list(islice(found, RUN))
        if not fresh:
            return
        old = len(words)
        words = words + list(map(_text, fresh))
        starts = np.concatenate([starts, np.fromiter(map(_start, fresh), np.int64, len(fresh))])
        del fresh
        doc = np.searchsorted(begins, starts, "right") - 1
        crc = np.fromiter(map(crc32, words), np.uint32, len(words))
        yield doc[old:], crc[old:]
        for n in range(2, longest + 1):
            crc = np.fromiter(map(crc32, words[n - 1:], then_space(crc[:-1]).tolist()), np.uint32, max(len(words) - n + 1, 0))
            # Starts at i, ends at i + n - 1: new if it ends in this run, whole if both ends lie in one document.
            first = max(old - n + 1, 0)
            inside = doc[n - 1:][first:] == doc[:len(doc) - n + 1][first:]
            yield doc[first:len(doc) - n + 1][inside], crc[first:][inside]
        words, starts = words[max(len(words) - longest + 1, 0):] if longest > 1 else [], starts[max(len(starts) - longest + 1, 0):] if longest > 1 else starts[:0]


def _count(buckets: int, longest: int):
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in small_batches(batches, BLOCK_BYTES, "text"):
            for _, crc in ngram_runs(*text_buffer(b.column("text")), longest):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=schema)

    return run


def bucket_counts(texts: DataFrame, buckets: int, longest: int, text_col: str = "text") -> np.ndarray:
    """n-grams per bucket over all texts. Only ``buckets`` sums, a parameter, reach the driver."""
    bounded_batches(texts.sparkSession)
    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count(buckets, longest), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)), with one added to every bucket."""
    k, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + k)) / float((s + 1) * (t_all + k))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weigh(gain: np.ndarray, longest: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
    buckets = np.uint32(len(gain))

    def run(batches):
        for b in small_batches(batches, BLOCK_BYTES, "text"):
            rows = b.num_rows
            buf, off = text_buffer(b.column("text"))
            words, n, total = (np.zeros(rows, np.int64) for _ in range(3))
            level = 0
            for doc, crc in ngram_runs(buf, off, longest):
                seen = np.bincount(doc, minlength=rows)
                n += seen
                if level % longest == 0:
                    words += seen
                level += 1
                # Sums of the gains of each document, exact in integers: documents come in order.
                cut = np.searchsorted(doc, np.arange(rows + 1))
                sums = np.concatenate([[0], np.cumsum(gain[crc % buckets])])
                total += sums[cut[1:]] - sums[cut[:-1]]
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)], schema=schema)

    return run


def importance(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    gain = gains(bucket_counts(docs, buckets, longest, text_col), bucket_counts(target, buckets, longest, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_weigh(gain, longest), "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: str, key: Column) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of SHA-256 over seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(weighted: DataFrame, percent: int = 25, least_words: int = 20, seed: str = "7") -> DataFrame:
    """Adds ``score`` and ``rank`` (null: not drawn); of the N rows with enough words, floor(percent N / 100) are drawn."""
    rows = stored(weighted.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))).withColumn("row", F.monotonically_increasing_id()), "weights")
    fit = rows.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc(), F.col("row")]
    placed = global_rank(fit.select("score", "doc_id", "weight", "n_features", "row"), order, "pos")
    ranked = placed.where(F.col("pos") < drawn).select("row", (F.col("pos") + 1).alias("rank"))
    return rows.join(ranked, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
