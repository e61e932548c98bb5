"""Phrase collocations by SON partitioning.

Documents fall into a few shards by the hash of their id. A phrase that reaches
the global support reaches, in at least one shard, the support lowered by that
shard's share of all words; so the phrases that are frequent in some shard hold
every frequent phrase.

1. Each shard is mined completely, level by level: phrases of k words are
   counted where both phrases of k - 1 words inside are frequent in the shard.
   A shard is no task: its tasks send counted hashes, packed by hash range, and
   one task adds up one range.
2. The locally frequent phrases are united. A phrase leaves the union if even
   the most it can have in the other shards keeps it below the support. The
   union is a bit map of fixed size: a clash in it lets a phrase be counted in
   vain and loses none.
3. All candidates are counted over all shards, by their words, not by hashes.

More shards lower the local support to nothing, so their number stays small
whatever the corpus; tasks stay as small as their input splits.

Phrases never cross a punctuation mark, a line end or a document. A null
language is ``und``; null and empty texts have no words; repeated rows count
again; a null id falls into one shard. Without frequent phrases, or on an empty
table, the report is empty. Other columns are not read. Words and texts may be
of any length.
"""
from __future__ import annotations

from contextlib import contextmanager
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom.llm.arrays import FOLDED_VALUES, Prefix, combine, mix, small_batches, text_buffer
from massloom.llm.buckets import bucket_edges, pack, pack_ids, unpack, unpack_ids
from massloom.llm.storage import bucket_count, stored

SHARDS = 4
MAP_BITS = 26
#: Phrases counted together before they are sent.
HELD = 2 << 20
#: Words whose phrases are counted together by their words; ids of so many words take 21 bits.
RUN = 1 << 20
BATCH_BYTES = 4 << 20
HASH_BYTES = 1 << 20

_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _CUT.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@contextmanager
def _batches(spark: SparkSession, max_bytes: int):
    """Arrow batches of about ``max_bytes`` for the jobs inside."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": "100000", "spark.sql.execution.arrow.maxBytesPerBatch": str(max_bytes)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Words:
    """Words of a batch: spans, document, and a number that changes from piece to piece."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf = buf
        inside = ~_GAP[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        left = edge[:-1].copy()
        left[1:] |= ~inside[:-1]
        self.starts = np.flatnonzero(inside & left)
        right = edge[1:].copy()
        right[:-1] |= ~inside[1:]
        self.ends = np.flatnonzero(inside & right) + 1
        self.doc = np.searchsorted(off, self.starts, "right") - 1
        self.piece = np.cumsum(_CUT[buf], dtype=np.int64)[self.starts] + self.doc if len(self.starts) else self.starts

    def whole(self, a: int, b: int, n: int) -> np.ndarray:
        """Whether the phrases of ``n`` words that start at a .. b-1 lie in one piece."""
        last = np.minimum(np.arange(a, b) + n - 1, len(self.starts) - 1)
        return (np.arange(a, b) + n <= len(self.starts)) & (self.piece[a:b] == self.piece[last])

    def hashes(self) -> np.ndarray:
        out, at = [np.zeros(0, np.uint64)], 0
        while at < len(self.starts):  # a slice of the text at a time: prefix sums take many times its size
            low = self.starts[at]
            stop = max(at + 1, int(np.searchsorted(self.ends, low + HASH_BYTES, "right")))
            out.append(Prefix(self.buf[low:self.ends[stop - 1]], FOLDED_VALUES).spans(self.starts[at:stop] - low, self.ends[at:stop] - low))
            at = stop
        return np.concatenate(out)

    def spaced(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased bytes of words a .. b-1, each with a space behind it, and where each begins."""
        lens = self.ends[a:b] - self.starts[a:b]
        at = np.concatenate([[0], np.cumsum(lens + 1)])
        out = np.full(at[-1], 0x20, np.uint8)
        for x in range(0, b - a, 1 << 16):  # some words at a time: positions of bytes take many times their size
            y = min(x + (1 << 16), b - a)
            n = lens[x:y]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(at[x:y], n) + within] = _LOWER[self.buf[np.repeat(self.starts[a + x:a + y], n) + within]]
        return out, at


def _lang_hashes(column: pa.Array) -> np.ndarray:
    buf, off = text_buffer(column)
    return Prefix(buf).spans(off[:-1], off[1:])


def _cells(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _marked(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 > 0


def _keys(words: np.ndarray, lang: np.ndarray, n: int) -> np.ndarray:
    """Hash of (language, n words) by the first word's place; the last n - 1 places are left out."""
    if len(words) < n:
        return words[:0]
    return mix((combine(words, n) if n > 1 else words) + lang[:len(words) - n + 1])


MINED = "bucket int, shard int, words bigint, hashes binary, counts binary"


def _mine(n: int, maps, buckets: int):
    """Packed counts of phrases of ``n`` words by shard and hash range; ``maps`` has the shards' phrases of the level below."""
    schema = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("words", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
    edges = bucket_edges(buckets)

    def flush(held):
        shard = np.concatenate([s for s, _ in held])
        keys = np.concatenate([k for _, k in held])
        for s in np.unique(shard).tolist():
            h, count = np.unique(keys[shard == s], return_counts=True)
            cut = np.append(np.searchsorted(h, edges), len(h))
            full = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
            parts = [slice(cut[b], cut[b + 1]) for b in full]
            yield pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()), pa.array([s] * len(full), pa.int32()), pa.array([int(count[p].sum()) for p in parts], pa.int64()),
                pa.array([pack(h[p], int(edges[b]), 0) for b, p in zip(full, parts)], pa.binary()), pa.array([pack_ids(count[p]) for p in parts], pa.binary())], schema=schema)

    def run(batches):
        held, size = [], 0
        for b in small_batches(batches, BATCH_BYTES, "text"):
            w = Words(*text_buffer(b.column("text")))
            lang = _lang_hashes(b.column("lang"))[w.doc]
            shard = b.column("shard").to_numpy(zero_copy_only=False)[w.doc]
            words = w.hashes()
            keys = _keys(words, lang, n)
            ok = w.whole(0, len(keys), n)
            if n > 1 and len(keys):
                cells, below = _cells(_keys(words, lang, n - 1)), np.zeros(len(keys) + 1, bool)
                for s in np.unique(shard).tolist():
                    mine = np.flatnonzero(shard[:len(below)] == s)
                    below[mine] = _marked(maps.value[s], cells[mine])
                ok &= below[:-1] & below[1:]
            held.append((shard[:len(keys)][ok], keys[ok]))
            size += int(ok.sum())
            if size >= HELD:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _frequent(least: dict[int, int], support: int, buckets: int):
    """Adds up one hash range: bit maps of each shard's frequent phrases (kind = shard) and of the candidates of all (kind = -1)."""
    schema = pa.schema([("kind", pa.int32()), ("at", pa.int64()), ("bits", pa.binary())])
    edges = [(b << 64) // buckets for b in range(buckets + 1)]

    def run(key, table):
        low, high = edges[key[0].as_py()], edges[key[0].as_py() + 1] - 1
        first = low >> (64 - MAP_BITS) & ~7
        size = (high >> (64 - MAP_BITS) & ~7) + 8 - first
        shard = table["shard"].to_numpy()
        hashes, count_of, rows = [], [], []
        for s in np.unique(shard).tolist():
            at = np.flatnonzero(shard == s).tolist()
            h = np.concatenate([unpack(table["hashes"][i].as_py()) for i in at])
            n = np.concatenate([unpack_ids(table["counts"][i].as_py()) for i in at])
            order = np.argsort(h)
            h, n = h[order], n[order]
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            h, n = h[new], np.add.reduceat(n, new)
            keep = n >= least[s]
            h = h[keep] + np.uint64(low)
            rows.append((s, h))
            hashes.append(h)
            count_of.append(n[keep] - (least[s] - 1))
        # The most a phrase can have: its counts where it is frequent, and just too little everywhere else.
        h, back = np.unique(np.concatenate(hashes), return_inverse=True)
        most = np.bincount(back, weights=np.concatenate(count_of), minlength=len(h)) + sum(x - 1 for x in least.values())
        rows.append((-1, h[most >= support]))
        out = []
        for kind, h in rows:
            bits = np.zeros(size, bool)
            bits[_cells(h) - first] = True
            if len(h):
                out.append((kind, first >> 3, compress(np.packbits(bits, bitorder="little").tobytes(), 1)))
        return pa.Table.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _maps(slices: DataFrame, kinds: list[int]) -> dict[int, np.ndarray]:
    """Bit maps by kind. At most 2**MAP_BITS bits of each reach the driver, whatever the corpus."""
    out = {k: np.zeros(1 << (MAP_BITS - 3), np.uint8) for k in kinds}
    for r in slices.where(F.col("kind").isin(kinds)).coalesce(16).toLocalIterator():
        part = np.frombuffer(decompress(r["bits"]), np.uint8)
        out[r["kind"]][r["at"]:r["at"] + len(part)] |= part
    return out


def _count(longest: int, bits):
    """Exact counts of candidate phrases, word by word, and in rows without a phrase the words of each language."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])

    def run(batches):
        for b in small_batches(batches, BATCH_BYTES, "text"):
            w = Words(*text_buffer(b.column("text")))
            langs = b.column("lang").dictionary_encode()
            names, lang_of = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            lang_hash = _lang_hashes(b.column("lang"))[w.doc]
            hashes = w.hashes()
            total = len(w.starts)
            seen = np.bincount(lang_of[w.doc], minlength=len(names))
            yield pa.RecordBatch.from_arrays([names, pa.nulls(len(names), pa.string()), pa.array(np.zeros(len(names), np.int32)), pa.array(seen)], schema=schema)
            for a in range(0, total, RUN):
                stop = min(total, a + RUN)
                far = min(total, stop + longest - 1)
                data, at = w.spaced(a, far)
                column = pa.Array.from_buffers(pa.large_binary(), far - a, [None, pa.py_buffer(at), pa.py_buffer(data)])
                ids = column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                lang = lang_of[w.doc[a:far]]
                if len(names) > 1:  # one number for language and word
                    ids = np.unique(lang * (int(ids.max()) + 1) + ids, return_inverse=True)[1]
                key = np.zeros(stop - a, np.int64)
                for n in range(1, longest + 1):
                    m = min(stop, total - n + 1) - a
                    if m <= 0:
                        break
                    key = (key[:m] << 21) | ids[n - 1:n - 1 + m]
                    wanted = w.whole(a, a + m, n)
                    wanted &= _marked(bits.value, _cells(_keys(hashes[a:a + m + n - 1], lang_hash[a:a + m + n - 1], n)))
                    where = np.flatnonzero(wanted)
                    if not len(where):
                        continue
                    _, first, count = np.unique(key[where], return_index=True, return_counts=True)
                    first = where[first]
                    begin, lens = at[first], at[first + n] - 1 - at[first]
                    edge = np.concatenate([[0], np.cumsum(lens)])
                    text = data[np.repeat(begin - edge[:-1], lens) + np.arange(edge[-1])]
                    phrases = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(edge), pa.py_buffer(text)]).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[first])), phrases, pa.array(np.full(len(first), n, np.int32)), pa.array(count.astype(np.int64))], schema=schema)

    return run


def frequent_phrases(docs: DataFrame, support: int = 10, longest: int = 3, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Written table (lang, phrase, words, n): every phrase of at most three words with n >= support, and per language a row of 0 words with all its words."""
    if not 1 <= longest <= 3:
        raise ValueError("phrases have one to three words")
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int").alias("shard"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = bucket_count(spark, size)
    union = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    maps, least = None, {}
    with _batches(spark, BATCH_BYTES):
        for n in range(1, longest + 1):
            mined = rows.mapInArrow(_mine(n, maps, buckets), MINED)
            if n == 1:  # the shards' shares must be known before anything is left out
                mined = stored(mined, "words")
                total = {r["shard"]: r["n"] for r in mined.groupBy("shard").agg(F.sum("words").alias("n")).collect()}  # one row per shard
                # The smallest count that a shard's share of the support allows, in whole numbers.
                least = {s: -(-support * k // sum(total.values())) for s, k in total.items()}
            slices = stored(mined.groupBy("bucket").applyInArrow(_frequent(least, support, buckets), "kind int, at bigint, bits binary"), f"level-{n}")
            found = _maps(slices, [-1, *least] if n < longest else [-1])
            union |= found.pop(-1)
            if maps is not None:
                maps.destroy()
            maps = sc.broadcast(found) if n < longest else None
            del found
        bits = sc.broadcast(union)
        counted = rows.mapInArrow(_count(longest, bits), "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
        out = stored(counted.where((F.col("words") == 0) | (F.col("n") >= support)), "phrases")
    bits.destroy()
    return out


def _big(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def collocations(phrases: DataFrame, top: int = 2000, longest: int = 3, inside_percent: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases per language.

    A phrase's score is that of its weakest cut; phrases that lie mostly inside a
    longer one are left out. Numbers are exact to 38 digits.
    """
    part = lambda first, many: F.array_join(F.slice("w", first, many), " ")
    many = phrases.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = many.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    known = phrases.where("words >= 1")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("up", _big(_big(_big(F.col("a")) * _big(F.col("a"))) * F.lit(1000000))).withColumn("down", _big(_big(F.col("l")) * _big(F.col("r"))))
    weakest = cuts.withColumn("score", F.expr("up div down")).groupBy("lang", "phrase").agg(
        F.first("words").alias("words"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    inner = many.where("words > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = weakest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * _big(F.col("longer")) < inside_percent * _big(F.col("a"))))
    flat = left.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = flat.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = phrases.where("words = 0").select("lang", "n")
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
