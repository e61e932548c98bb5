"""Which hashes occur elsewhere: an exchange of sorted hash slices, one bucket at a time.

A block (some megabytes of text) sends each distinct hash once, sorted, cut by
hash range into buckets. So a passage that a third of all documents share costs
one entry per block, not one per occurrence. A bucket is sorted in one task and
answers each slice with a bit mask in the slice's own order.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.storage import hand_back

SLICE_SCHEMA = "block long, bucket int, hashes binary, twice binary"
MASK_SCHEMA = "block long, bucket int, mask binary"
_ARROW_MASK = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("mask", pa.binary())])


def pack(hashes: np.ndarray, low: int, drop: int) -> bytes:
    """Sorted hashes as byte planes of their gaps; ``drop`` low bits are left out."""
    v = (hashes - np.uint64(low)) >> np.uint64(drop)
    gaps = np.diff(v, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + planes.T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, :width] = planes.T
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


def pack_ids(ids: np.ndarray) -> bytes:
    """Integers in any order: the smallest, and byte planes of what exceeds it."""
    low = ids.min()
    over = (ids.astype(np.uint64) - np.uint64(low.astype(np.uint64))).astype("<u8")
    width = max(1, (int(over.max()).bit_length() + 7) // 8)
    return low.astype("<i8").tobytes() + bytes([width]) + over.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(data[8], -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, :data[8]] = planes.T
    return (full.view("<u8").ravel() + np.frombuffer(data, "<u8", 1)).astype(np.int64)


def bucket_edges(buckets: int) -> np.ndarray:
    return np.array([(b << 64) // buckets for b in range(buckets)], dtype=np.uint64)


def slices(block: int, hashes: np.ndarray, twice: np.ndarray, buckets: int, drop: int, ids: np.ndarray | None = None):
    """Rows (block, bucket, packed hashes, packed flags, packed ids) of one block's distinct sorted hashes."""
    edges = bucket_edges(buckets)
    cut = np.append(np.searchsorted(hashes, edges), len(hashes))
    for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        part = slice(cut[b], cut[b + 1])
        owners = None if ids is None else pack_ids(ids[part])
        yield block, b, pack(hashes[part], int(edges[b]), drop), np.packbits(twice[part]).tobytes(), owners


def _answer(later: bool):
    def run(key, table):
        blocks = table["block"].to_pylist()
        order = np.argsort(np.array(blocks, np.int64), kind="stable").tolist()
        parts = [unpack(table["hashes"][i].as_py()) for i in order]
        sizes = [len(p) for p in parts]
        merged = np.concatenate(parts)
        del parts
        if later:  # ties by id, then by block
            rank = np.lexsort((np.concatenate([unpack_ids(table["ids"][i].as_py()) for i in order]), merged))
        else:
            rank = np.argsort(merged)
        s = merged[rank]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        if not later:
            same[:-1] |= same[1:].copy()
        mask = np.zeros(len(s), bool)
        mask[rank] = same
        out, at = [], 0
        for i, n in zip(order, sizes):
            m = mask[at:at + n]
            if not later:
                m = m | np.unpackbits(np.frombuffer(table["twice"][i].as_py(), np.uint8), count=n).astype(bool)
            out.append(np.packbits(m).tobytes())
            at += n
        made = pa.Table.from_arrays([pa.array([blocks[i] for i in order], pa.int64()),
                                     pa.array([key[0].as_py()] * len(order), pa.int32()), pa.array(out, pa.binary())],
                                    schema=_ARROW_MASK)
        del out, rank, s, same, mask, merged
        hand_back()
        return made

    return run


def answer(rows: DataFrame, later: bool) -> DataFrame:
    """One mask per slice.

    ``later``: bit set where another block holds the hash under a smaller id
    (the same id: a smaller block). Otherwise: bit
    set where the hash occurs at least twice in all, in one block or several.
    """
    return rows.groupBy("bucket").applyInArrow(_answer(later), MASK_SCHEMA)


def masks_by_block(masks: DataFrame) -> DataFrame:
    """One row per block: its masks by kind and bucket (at most one of each)."""
    return masks.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("kind", "bucket", "mask"))).alias("masks"))


def read_masks(hashes: np.ndarray, masks: list[dict] | None, buckets: int) -> np.ndarray:
    """The masks of one block, put back in the order of its sorted hashes."""
    cut = np.append(np.searchsorted(hashes, bucket_edges(buckets)), len(hashes))
    out = np.zeros(len(hashes), bool)
    for m in masks or []:
        b = m["bucket"]
        n = cut[b + 1] - cut[b]
        out[cut[b]:cut[b + 1]] = np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=n).astype(bool)
    return out
