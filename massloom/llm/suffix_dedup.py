"""Suffix-array de-duplication by difference-cover blockwise sorting.

Removes every byte covered by a 100-byte string that also starts earlier
(smaller id, or same document and earlier start). A corpus-wide suffix array is
never held; what a sort needs is cut into buckets, one bucket per task:

1. Blocks: texts are stored as blocks of some megabytes, in id order within a
   block, in a table bucketed by block. Later passes meet their answers there
   without moving a text again.
2. Long ties first: content-defined segments (a cut about every 512 bytes, the
   next 99 bytes included) are ranked. A segment that starts earlier elsewhere
   settles all suffixes in it. The first occurrence of any string is never
   settled this way, so nothing is lost for the next sorts.
3. Cover sample: of the open suffixes only positions whose residue modulo 73
   lies in a difference cover are sorted, by their first 28 bytes. For any two
   equal 100-byte strings some shift below 73 puts both on the cover, so a tie
   of two suffixes can only be long where a sample at that reach is tied too.
4. Suffixes: only those with a tied sample are sorted by 100 bytes; the sample
   ranks have dropped the rest. The earliest of each tie stays.

Sorts run on 64-bit fingerprints of the prefixes (48 bits for the sample, where
a clash only costs work). A block sends each fingerprint once, so a passage in
a third of all documents costs one entry per block. With n suffixes in step 4
the expected number of false ties is n*n/2**65.

Null texts are empty. Texts under 100 bytes lose nothing. Rows that share an id
count in the order of the scan, so of repeated rows the first one stays. A null
id sorts before all others. Only id and text are read; ``keep`` names the
columns to hand through.
"""
from __future__ import annotations

import hashlib
import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.arrays import Prefix, small_batches, text_buffer
from massloom.llm.buckets import SLICE_SCHEMA, answer, masks_by_block, read_masks, slices
from massloom.llm.storage import BLOCK_BYTES, block_ids, bounded_batches, bucket_count, modest, stored
from massloom.session import shared_dir

LENGTH = 100
PERIOD = 73
#: Every residue modulo 73 is a difference of two of these.
COVER = (0, 1, 3, 7, 15, 31, 36, 54, 63)
SAMPLE = LENGTH - PERIOD + 1
CUT_BITS = 9
CUT_WINDOW = 32
SEGMENTS, SAMPLES, SUFFIXES = range(3)
_ON_COVER = np.isin(np.arange(PERIOD), COVER)
_SLICE_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("twice", pa.binary()), ("ids", pa.binary())])


def _write_blocks(batches):
    ids = block_ids()
    schema = pa.schema([("block", pa.int64()), ("data", pa.binary())])
    for b in small_batches(batches, BLOCK_BYTES, "text"):
        order = np.argsort(b.column("doc_id").fill_null(-2**63).to_numpy(zero_copy_only=False), kind="stable")
        b = pa.Table.from_batches([b]).take(pa.array(order)).combine_chunks()
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(b)
        yield pa.RecordBatch.from_arrays([pa.array([next(ids)], pa.int64()), pa.array([sink.getvalue()], pa.binary())], schema=schema)


def _reach(flags: np.ndarray, back: int, ahead: int) -> np.ndarray:
    """Positions with a set flag at a distance of -back ... +ahead."""
    n = len(flags)
    c = np.zeros(back + 1 + n + ahead, np.int32)  # flags before each place, carried on at both ends
    np.cumsum(flags, dtype=np.int32, out=c[back + 1:back + 1 + n])
    c[back + 1 + n:] = c[back + n]
    return c[back + 1 + ahead:] > c[:n]


class Block:
    """Suffixes of one block and what earlier sorts said about them."""

    def __init__(self, data: bytes, masks: dict, buckets: int):
        self.table = pa.ipc.open_stream(data).read_all().combine_chunks()
        self.buf, self.off = text_buffer(self.table["text"])
        self.ids = self.table["doc_id"].fill_null(-2**63).to_numpy()
        self.masks, self.buckets = masks, buckets
        self.prefix = Prefix(self.buf)
        n = len(self.buf)
        self.valid = np.ones(n, bool)  # a whole string starts here
        lengths = np.diff(self.off)
        for end, length in zip(self.off[1:].tolist(), lengths.tolist()):
            self.valid[end - min(length, LENGTH - 1):end] = False
        cut = np.zeros(n + 1, bool)
        w = self.prefix.windows(CUT_WINDOW)
        cut[CUT_WINDOW:CUT_WINDOW + len(w)] = (w >> np.uint64(64 - CUT_BITS)) == 0
        cut[self.off] = True
        self.start = np.flatnonzero(cut[:n])
        stop = np.append(self.start[1:], n)
        doc_end = self.off[np.searchsorted(self.off, self.start, "right")]
        end = np.minimum(stop + LENGTH - 1, doc_end)
        self.long = np.flatnonzero(end - self.start >= LENGTH)
        self.stop = stop
        self.segment = self.prefix.spans(self.start[self.long], end[self.long])

    def _first(self, hashes: np.ndarray):
        """Distinct sorted hashes, first place of each, and which rank each one has."""
        order = np.argsort(hashes, kind="stable")
        s = hashes[order]
        new = np.ones(len(s), bool)
        np.not_equal(s[1:], s[:-1], out=new[1:])
        rank = np.empty(len(s), np.int64)
        rank[order] = np.cumsum(new) - 1
        return s[new], order[new], rank

    def _settled(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        u, first, rank = self._first(hashes)
        later = read_masks(u, self.masks.get(kind), self.buckets)[rank]
        again = np.ones(len(hashes), bool)
        again[first] = False
        return later | again

    def owners(self, places: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.off, places, "right") - 1]

    def segments(self):
        u, first, _ = self._first(self.segment)
        return u, np.zeros(len(u), bool), self.owners(self.start[self.long][first])

    def open(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes without a verdict, suffixes settled as repeated)."""
        done = np.zeros(len(self.buf) + 1, np.int8)
        hit = self.long[self._settled(SEGMENTS, self.segment)]
        np.add.at(done, self.start[hit], 1)
        np.add.at(done, self.stop[hit], -1)
        repeated = (np.cumsum(done[:-1], dtype=np.int8) > 0) & self.valid
        return self.valid & ~repeated, repeated

    def sample(self, open_: np.ndarray):
        """Places and hashes of the cover positions that open suffixes reach."""
        on = np.resize(_ON_COVER, len(self.buf)) & _reach(open_, PERIOD - 1, 0)
        at = np.flatnonzero(on)
        return at, self.prefix.spans(at, at + SAMPLE)

    def samples(self):
        _, h = self.sample(self.open()[0])
        u, counts = np.unique(h >> np.uint64(16), return_counts=True)
        return u << np.uint64(16), counts > 1, None

    def candidates(self):
        open_, repeated = self.open()
        at, h = self.sample(open_)
        u, rank = np.unique((h >> np.uint64(16)) << np.uint64(16), return_inverse=True)
        tied = np.zeros(len(self.buf), bool)
        tied[at] = read_masks(u, self.masks.get(SAMPLES), self.buckets)[rank]
        at = np.flatnonzero(open_ & _reach(tied, 0, PERIOD - 1))
        return at, self.prefix.spans(at, at + LENGTH), repeated

    def suffixes(self):
        at, h, _ = self.candidates()
        u, first, _ = self._first(h)
        return u, np.zeros(len(u), bool), self.owners(at[first])

    def removed(self) -> np.ndarray:
        at, h, repeated = self.candidates()
        repeated[at] = self._settled(SUFFIXES, h)
        return _reach(repeated, LENGTH - 1, 0)


def _mask_rows(value) -> dict:
    out: dict = {}
    for m in value or []:
        out.setdefault(m["kind"], []).append(m)
    return out


def _blocks_of(batches, buckets: int):
    for b in batches:
        for i in range(b.num_rows):
            masks = _mask_rows(b.column("masks")[i].as_py()) if "masks" in b.schema.names else {}
            yield b.column("block")[i].as_py(), Block(b.column("data")[i].as_py(), masks, buckets)


def _slices(kind: int, buckets: int):
    def run(batches):
        for block, x in _blocks_of(batches, buckets):
            h, twice, ids = (x.segments, x.samples, x.suffixes)[kind]()
            rows = [[], [], [], [], []]
            for r in slices(block, h, twice, buckets, 16 if kind == SAMPLES else 0, ids):
                for column, v in zip(rows, r):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _SLICE_ARROW)], schema=_SLICE_ARROW)

    return run


def _finish(keep: list[str], buckets: int, types: pa.Schema):
    def run(batches):
        for _, x in _blocks_of(batches, buckets):
            gone = x.removed()
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "text")}
            for a, b in zip(x.off[:-1].tolist(), x.off[1:].tolist()):
                g = gone[a:b]
                kept = x.buf[a:b][~g].tobytes()
                out["n_bytes"].append(b - a)
                out["n_removed"].append(b - a - len(kept))
                out["n_spans"].append(int(np.count_nonzero(g[1:] & ~g[:-1])) + bool(b > a and g[0]))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["text"].append(kept.decode("utf-8", "ignore"))
            columns = [pa.array(out[f.name], f.type) if f.name in out else x.table[f.name].combine_chunks().cast(f.type) for f in types]
            for piece in small_batches([pa.RecordBatch.from_arrays(columns, schema=types)], BLOCK_BYTES, "text"):
                yield piece

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, text, n_bytes, n_removed, n_spans, kept_sha256 and the ``keep`` columns.

    ``text`` holds the kept bytes; a character cut at the edge of a removed run
    is left out of it, while kept_sha256 digests the bytes as they are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = [c for c in keep or [] if c not in (id_col, text_col)]
    named = [f"keep_{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, named)])
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = bucket_count(spark, total)
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // (32 << 20)) + 1)
    name = f"massloom_blocks_{uuid.uuid4().hex}"
    (rows.mapInArrow(modest(_write_blocks), "block long, data binary").write.bucketBy(files, "block").option("compression", "none")
     .option("path", shared_dir(spark, "blocks")).saveAsTable(name))
    blocks = spark.table(name)

    masks = None
    schema = f"{SLICE_SCHEMA}, ids binary"
    for kind in (SEGMENTS, SAMPLES, SUFFIXES):
        sent = _with_masks(blocks, masks).mapInArrow(modest(_slices(kind, buckets)), schema)
        told = stored(answer(sent, later=kind != SAMPLES).withColumn("kind", F.lit(kind)), "masks")
        masks = told if masks is None else masks.unionByName(told)
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                       ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *_arrow_fields(rows, named)])
    out = ", ".join(["doc_id long", "text string", "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string",
                     *[f"{n} {rows.schema[n].dataType.simpleString()}" for n in named]])
    done = _with_masks(blocks, masks).mapInArrow(modest(_finish(named, buckets, arrow)), out)
    return done.select("doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", *[F.col(n).alias(c) for n, c in zip(named, keep)])


def _arrow_fields(rows: DataFrame, names: list[str]):
    from pyspark.sql.pandas.types import to_arrow_type

    return [(n, to_arrow_type(rows.schema[n].dataType)) for n in names]


def _with_masks(blocks: DataFrame, masks: DataFrame | None) -> DataFrame:
    """Answers travel to the blocks; the blocks stay in their buckets."""
    if masks is None:
        return blocks
    return blocks.join(masks_by_block(masks).hint("shuffle_hash"), "block", "left")
