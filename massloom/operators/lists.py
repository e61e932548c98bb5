"""Peak lists put together in sorted scans: one exchange of peaks, no aggregate per peak.

Spectra and their peaks are dealt out by spectrum and sorted; a scan adds equal
masses up and hands on whole lists. Equal spectra then lie next to each other
in a second order and become one, with lists of those that they stand for.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.uint64(0x7FF8000000000001)  # a missing m/z in packed lists


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 where null, and what is null."""
    return column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _changes(column: pa.Array) -> np.ndarray:
    """Rows that differ from the one before; nulls are alike and so are NaN."""
    if pa.types.is_floating(column.type):
        v, gone = _numbers(column)
        same = ((v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1]))) & (gone[1:] == gone[:-1])
    else:
        gone = column.is_null().to_numpy(zero_copy_only=False)
        same = pc.equal(column[1:], column[:-1]).fill_null(False).to_numpy(zero_copy_only=False) | (gone[1:] & gone[:-1])
    return np.r_[np.ones(min(len(column), 1), bool), ~same]


def _packed(mz: pa.Array, i: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists as bytes, pairs of m/z and intensity; equal lists have equal bytes."""
    v, gone = _numbers(mz)
    pairs = np.stack([v, i], axis=1) + 0.0
    pairs[np.isnan(pairs)] = np.nan
    pairs.view(np.uint64)[gone, 0] = NONE
    offsets = np.r_[0, ends * 16].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(pairs)])


def _unpacked(lists: pa.Array) -> pa.ListArray:
    sizes = np.r_[0, np.cumsum(np.asarray(pc.binary_length(lists))) // 16].astype(np.int32)
    pairs = np.frombuffer(b"".join(lists.to_pylist()), np.float64).reshape(-1, 2)
    mz = pa.array(pairs[:, 0], mask=pairs.view(np.uint64)[:, 0] == NONE)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays([mz, pa.array(pairs[:, 1])], ["mz", "i"]))


def _by_mass(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows in order of key, each key's heads first and then its peaks by mass, nulls first."""
    mz, gone = _numbers(rows["mz"])
    return rows.take(pa.array(np.lexsort((mz, ~gone, rows["head"].is_null().to_numpy(zero_copy_only=False), np.cumsum(_changes(rows[0]))))))


def _merged(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Sorted rows (key, mz, i, head) with the intensities of equal masses of a key added up."""
    head = rows["head"].is_valid().to_numpy(zero_copy_only=False)
    new = _changes(rows[0]) | _changes(rows["mz"]) | head | np.r_[False, head[:-1]]
    if new.all():
        return rows
    i = np.bincount(np.cumsum(new) - 1, weights=_numbers(rows["i"])[0])
    first = rows.filter(pa.array(new))
    return pa.RecordBatch.from_arrays([first[0], first["mz"], pa.array(i, mask=head[new]), first["head"]], schema=rows.schema)


def _whole(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Every head of merged rows that has peaks, with its list, intensities divided by their sum."""
    head = rows["head"].is_valid().to_numpy(zero_copy_only=False)
    key = np.cumsum(_changes(rows[0])) - 1
    peaks = rows.filter(pa.array(~head))
    of, i = key[~head], peaks["i"].to_numpy(zero_copy_only=False)
    size = int(key[-1]) + 1
    with np.errstate(invalid="ignore"):
        share = i / np.bincount(of, weights=i, minlength=size)[of]
    ends = np.cumsum(np.bincount(of, minlength=size))
    lists = _packed(peaks["mz"], share, ends)
    at = np.flatnonzero(head & (np.diff(np.r_[0, ends])[key] > 0))
    kept = rows.take(pa.array(at))
    fields = [f.name for f in kept["head"].type]
    return pa.RecordBatch.from_arrays([kept[0], *kept["head"].flatten(), lists.take(pa.array(key[at]))], names=[rows.schema[0].name, *fields, "peaks"])


def with_lists(heads: DataFrame, peaks: DataFrame, key: str) -> DataFrame:
    """Rows of ``heads`` (key, ...) that have peaks (key, mz, intensity), each with ``peaks``: merged, sum-normalised, ordered by m/z, packed."""
    fields = [c for c in heads.columns if c != key]
    own = heads.where(F.col(key).isNotNull()).select(key, F.lit(None).cast("double").alias("mz"), F.lit(None).cast("double").alias("i"), F.struct(*fields).alias("head"))
    rows = peaks.where((F.col("intensity") > 0) & F.col(key).isNotNull()).select(
        key, F.col("mz").cast("double").alias("mz"), F.col("intensity").cast("double").alias("i"), F.lit(None).cast(own.schema["head"].dataType).alias("head"))
    ordered = rows.union(own).repartition(key).sortWithinPartitions(key)  # a single number sorts by its digits; masses follow in the scan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = _merged(_by_mass(batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]))
            last = int(np.flatnonzero(_changes(rows[0]))[-1])
            if last:
                yield _whole(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None:
            yield _whole(held)

    types = {f.name: f.dataType.simpleString() for f in heads.schema}
    return ordered.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in (key, *fields)) + ", peaks binary")


def equal_spectra(spectra: DataFrame, same: list[str], members: list[str]) -> DataFrame:
    """One row for neighbours equal in ``same`` and packed ``peaks``, lists unpacked, with ``members``: array<struct> of those columns of each.

    Rows meet in the order of a hash and are compared in full. A row stands for
    those of one Arrow batch, so that no list of members grows without bound;
    equal spectra of two batches stay two rows with one ``digest`` of their content.
    """
    place = F.xxhash64(*same, "peaks").alias("__place")
    ordered = spectra.select(place, *same, "peaks", *members).repartition("__place").sortWithinPartitions("__place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            new = _changes(batch["peaks"])
            for c in same:
                new |= _changes(batch[c])
            first = batch.filter(pa.array(new))
            starts = np.r_[np.flatnonzero(new), len(batch)]
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([batch[c] for c in members], members))
            digest = [sha256(repr(v).encode() + p).digest()[:16] for p, *v in zip(*(first[c].to_pylist() for c in ("peaks", *same)))]
            yield pa.RecordBatch.from_arrays([*[first[c] for c in same], _unpacked(first["peaks"]), lists, pa.array(digest, pa.binary())],
                                             names=[*same, "peaks", "members", "digest"])

    types = {f.name: f.dataType.simpleString() for f in spectra.schema}
    inner = ", ".join(f"`{c}`: {types[c]}" for c in members)
    return ordered.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in same) + f", peaks array<struct<mz: double, i: double>>, members array<struct<{inner}>>, digest binary")


def equal_rows(rows: DataFrame, same: list[str], ident: str, out: str) -> DataFrame:
    """One row for neighbours equal in ``same``, with ``out``: the ids of each; equal rows of two Arrow batches stay two."""
    ordered = rows.select(F.xxhash64(*same).alias("__place"), *same, ident).repartition("__place").sortWithinPartitions("__place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                new = np.logical_or.reduce([_changes(batch[c]) for c in same])
                first = batch.filter(pa.array(new))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[np.flatnonzero(new), len(batch)], pa.int32()), batch[ident])
                yield pa.RecordBatch.from_arrays([*[first[c] for c in same], lists], names=[*same, out])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ordered.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in same) + f", `{out}` array<{types[ident]}>")


def classes(rows: DataFrame, owner: str, content: list[str], size: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Owners with the same rows (unit, ...) as one: (class, content) once a class, and (class, owners) in lists of about ``size``.

    A class is named by the least of its owners, null if it has no other.
    """
    lists = rows.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(*content))).alias("__rows"))
    same = lists.groupBy("__rows").agg(F.min(owner).alias("class"), F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("__lists"))
    part = F.pmod(F.xxhash64(owner), F.col("__lists")).alias("__part")
    owners = lists.join(same, "__rows").groupBy("class", part).agg(F.collect_list(F.struct(owner)).alias("owners"))
    return same.select("class", F.inline("__rows")), owners.select("class", "owners")
