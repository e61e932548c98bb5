"""N-gram Jaccard join with set-relation skipping.

A document's set holds its distinct 5-word shingles; two documents link when
100 * intersection >= 80 * union. Every link between different sets is found or
implied by found ones, so components are exact.

1. Signatures: equal sets fall together (128-bit key) and are joined once. The
   same pass counts shingles in a sketch of fixed size, which gives the global
   order of shingles, rare ones first.
2. Index: a set's first n - ceil(0.8 n) + 1 shingles in that order. Linked sets
   share one of them. A shingle without a second set is left out, one bucket of
   the hash range at a time; very common ones pass unseen, so no bucket gathers
   a hot list. Lists with the same members count once: any shared shingle gives
   a valid bound for a pair.
3. Lists are cut into blocks by size class. Each block names one pivot; every
   set of the block and its neighbours meets the pivot unless sizes and
   positions rule the pair out (block skipping by position).
4. What is left are sets of one list that are not yet in one component. Their
   overlap is derived from the pivot's answers: a set highly similar to P
   inherits them, differing only by its shingles beyond P. Only pairs that this
   can't settle are counted.

Before a pair is counted its bit maps of hash cells meet, some bits a shingle:
chance pairs, which grow faster than the corpus, end there and send no set.

Null or empty texts and texts without words have no set and link with nothing.
Repeated rows are copies. Rows with a null id keep their sets but give no id to
the component; a component without ids has a null one. Other columns are not
read. The keys of sets in links are 64 bits wide: over 10**9 different sets the
expected number of clashes is 0.03.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.arrays import mix, shingle_sets, small_batches, text_buffer
from massloom.llm.buckets import bucket_edges, pack, pack_ids, unpack, unpack_ids
from massloom.llm.components import components
from massloom.llm.storage import BLOCK_BYTES, block_ids, bounded_batches, bucket_count, hand_back, modest, stored

CELLS = 1 << 19
SLICES = 64
FILTER_BITS = 1 << 24
TOKEN_BITS = 48
CHUNK = 2048
STREAM = 4000
MOST_IN_CELLS = 40_000  # beyond, a map would pass 16 KB and no bound is taken


def _keys(s: np.ndarray) -> tuple[int, int]:
    return (int(mix(s + np.uint64(0x1F)).sum(dtype=np.uint64)), int((mix(s ^ np.uint64(0xA5A5A5A5A5A5)) | np.uint64(1)).sum(dtype=np.uint64)))


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).astype(np.int64))


def _cells(s: np.ndarray) -> bytes | None:
    """Which hash cells hold items, as bits: two to four cells an item, so that the map tells sets of every size apart."""
    if not len(s) or len(s) > MOST_IN_CELLS:
        return None
    cells = max(64, 1 << (2 * len(s) - 1).bit_length())
    held = np.zeros(cells, bool)
    held[((s >> np.uint64(20)) & np.uint64(cells - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").tobytes()


def _most_shared(u: bytes, n: int, v: bytes, size: int) -> int:
    """Upper bound of the overlap of sets of n and ``size`` items: a cell that the other set lacks holds an item that it lacks."""
    a, b = np.frombuffer(u, np.uint8), np.frombuffer(v, np.uint8)
    width = min(len(a), len(b))  # the finer map is folded: its cells are numbered by the same low bits
    a, b = (np.bitwise_or.reduce(m.reshape(-1, width), axis=0) for m in (a, b))
    return min(n - int(np.bitwise_count(a & ~b).sum()), size - int(np.bitwise_count(b & ~a).sum()))


def _signature_pass(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                        ("cells", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts = np.zeros(CELLS, np.uint32)
        for b in small_batches(batches, BLOCK_BYTES, "text"):
            sets = shingle_sets(*text_buffer(b.column("text")), width)
            if any(len(s) for s in sets):
                counts += np.bincount((np.concatenate(sets) >> np.uint64(45)).astype(np.int64), minlength=CELLS).astype(np.uint32)
            keys = [_keys(s) for s in sets]
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _signed([k[0] for k in keys]),
                                              _signed([k[1] for k in keys]), pa.array([_cells(s) for s in sets], pa.binary()),
                                              none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        step = CELLS // SLICES
        for i in range(SLICES):
            part = counts[i * step:(i + 1) * step]
            at = np.flatnonzero(part).astype("<u4")
            if len(at):
                blob = at.tobytes() + part[at].astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.binary()), pa.array([i], pa.int32()), pa.array([blob], pa.binary())], schema=schema)

    return run, "doc_id long, n long, k1 long, k2 long, cells binary, slice int, counts binary"


def _sum_slice(key, table):
    total = np.zeros(CELLS // SLICES, np.int64)
    for blob in table["counts"].to_pylist():
        at, n = np.frombuffer(blob, "<u4").reshape(2, -1)
        total[at] += n
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()),
                     "counts": pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})


def _sketch(signatures: DataFrame) -> np.ndarray:
    """Counts of all shingles by cell: 64 rows of 32 KB reach the driver, whatever the corpus."""
    rows = (signatures.where("slice is not null").select("slice", "counts").groupBy("slice")
            .applyInArrow(_sum_slice, "slice int, counts binary").collect())
    out = np.zeros(CELLS, np.uint32)
    step = CELLS // SLICES
    for r in rows:
        out[r["slice"] * step:(r["slice"] + 1) * step] = np.frombuffer(r["counts"], "<u4")
    return out


def prefix_length(n: int, percent: int) -> int:
    """Shingles of which linked sets share at least one."""
    return n - (percent * n + 99) // 100 + 1


def _index_pass(sketch, heavy: int, buckets: int, width: int, percent: int):
    """Prefix entries, packed by bucket: shingles, owners, positions and the owners' table."""
    schema = pa.schema([("bucket", pa.int32()), ("sure", pa.bool_()), ("tokens", pa.binary()), ("owners", pa.binary()), ("places", pa.binary()), ("sets", pa.binary())])

    def run(batches):
        counts, ids = sketch.value, block_ids()
        edges = bucket_edges(buckets)
        for b in small_batches(batches, BLOCK_BYTES, "text"):
            block, seen, tokens, owner, place = next(ids), {}, [], [], []
            for s in shingle_sets(*text_buffer(b.column("text")), width):
                key = (*_keys(s), len(s))
                if not len(s) or key in seen:
                    continue
                p = prefix_length(len(s), percent)
                c = counts[(s >> np.uint64(45)).astype(np.int64)]
                order = np.argsort(c, kind="stable")[:p]  # ties in hash order, as s is sorted
                i = len(seen)
                seen[key] = int(c[order].mean())  # how common its rarest shingles are
                tokens.append(s[order])
                owner.append(np.full(len(order), i, np.uint32))
                place.append(np.arange(len(order), dtype=np.uint32))
            if not tokens:
                continue
            t, o, q = np.concatenate(tokens), np.concatenate(owner), np.concatenate(place)
            order = np.argsort(t, kind="stable")
            t, o, q = t[order], o[order], q[order]
            table = np.array([(*k, v) for k, v in seen.items()], dtype=np.uint64)
            often = counts[(t >> np.uint64(45)).astype(np.int64)] >= heavy
            cut = np.append(np.searchsorted(t, edges), len(t))
            spread = int(mix(np.array([block], np.uint64))[0] % np.uint64(buckets))
            # A hot shingle's bucket would hold its whole list; its entries stay where their block happens to go.
            pieces = [(i, False, np.arange(cut[i], cut[i + 1])[~often[cut[i]:cut[i + 1]]]) for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist()]
            pieces.append((spread, True, np.flatnonzero(often)))
            for bucket, sure, at in pieces:
                if not len(at):
                    continue
                used, local = np.unique(o[at], return_inverse=True)
                low = 0 if sure else int(edges[bucket])
                entries = pack_ids(local), pack_ids(q[at].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([sure]),
                                                  pa.array([pack(t[at], low, 64 - TOKEN_BITS)], pa.binary()), *[pa.array([e], pa.binary()) for e in entries],
                                                  pa.array([table[used].astype("<u8").tobytes()], pa.binary())], schema=schema)

    return run, "bucket int, sure boolean, tokens binary, owners binary, places binary, sets binary"


def _lists(buckets: int):
    """Lists of a bucket with two sets at least, one row for each chunk of at most CHUNK entries.

    A list is named by its members where it fits one chunk, so the many lists of
    one group of copies become one when equal rows are dropped; a longer one is
    named by its shingle.
    """
    schema = pa.schema([("l", pa.int64()), ("s", pa.int64()), ("x", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("pos", pa.list_(pa.int32())),
                        ("typ", pa.list_(pa.int64()))])

    def run(key, table):
        low = np.uint64(int(bucket_edges(buckets)[key[0].as_py()]))
        token, x, n, pos, typ, sure = [], [], [], [], [], []
        for i in range(table.num_rows):
            known = table["sure"][i].as_py()
            t = unpack(table["tokens"][i].as_py())
            t = (t << np.uint64(64 - TOKEN_BITS)) + (np.uint64(0) if known else low)
            o, q = unpack_ids(table["owners"][i].as_py()), unpack_ids(table["places"][i].as_py())
            sets = np.frombuffer(table["sets"][i].as_py(), "<u8").reshape(-1, 4)
            token.append(t >> np.uint64(64 - TOKEN_BITS))
            x.append(sets[o, 0])
            n.append(sets[o, 2].astype(np.int32))
            pos.append(q.astype(np.int32))
            typ.append(sets[o, 3].astype(np.int64))
            sure.append(np.full(len(t), known))
        token, x, n, pos, typ, sure = map(np.concatenate, (token, x, n, pos, typ, sure))
        order = np.lexsort((x, token, sure))
        token, x, n, pos, typ, sure = (v[order] for v in (token, x, n, pos, typ, sure))
        other = (token[1:] != token[:-1]) | (sure[1:] != sure[:-1])
        one = np.append(True, other | (x[1:] != x[:-1]))
        token, x, n, pos, typ, sure = (v[one] for v in (token, x, n, pos, typ, sure))
        start = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (sure[1:] != sure[:-1])))
        size = np.diff(np.append(start, len(token)))
        wanted = (size > 1) | sure[start]
        start, size = start[wanted], size[wanted]
        h1, h2 = mix(x), mix(x ^ np.uint64(0x5DEECE66D))
        out, seen = [[], [], [], [], [], []], set()
        for a, m in zip(start.tolist(), size.tolist()):
            named = sure[a] or m > CHUNK
            for at in range(a, a + m, CHUNK):
                e = slice(at, min(a + m, at + CHUNK))
                l = np.uint64(token[a]) if named else h1[e].sum(dtype=np.uint64)
                s = h2[e].sum(dtype=np.uint64)
                if (l, s) not in seen:
                    seen.add((l, s))
                    for column, v in zip(out, (l, s, x[e].astype(np.int64), n[e], pos[e], typ[e])):
                        column.append(v)
        made = pa.Table.from_arrays([_signed(out[0]), _signed(out[1]), *[pa.array(c, f.type) for c, f in zip(out[2:], list(schema)[2:])]], schema=schema)
        del out, token, x, n, pos, typ, sure, h1, h2
        hand_back()
        return made

    return run, "l long, s long, x array<long>, n array<int>, pos array<int>, typ array<long>"


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Smallest overlap that links sets of sizes a and b: 100 o >= percent (a + b - o)."""
    return F.ceil((percent * (a + b)) / F.lit(100.0 + percent)).cast("int")


def _room(n1, p1, n2, p2) -> Column:
    """Most shingles that two sets share, from the positions of one that they do."""
    n1, p1, n2, p2 = (F.col(c) for c in (n1, p1, n2, p2))
    return F.least(p1, p2) + 1 + F.least(n1 - p1 - 1, n2 - p2 - 1)


def _may_link(n1, p1, n2, p2, percent: int) -> Column:
    """Sizes and the positions of one shared prefix shingle leave room for a link."""
    a, b = F.col(n1), F.col(n2)
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (_room(n1, p1, n2, p2) >= _needed(a, b, percent))


def _wanted_filter(ids: DataFrame) -> np.ndarray:
    """A fixed 2 MB bit filter of the ids; false hits only cost work."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = ids.select((bit / 32).cast("int").alias("w"), (bit % 32).cast("int").alias("b")).groupBy("w").agg(
        F.bit_or(F.pow(F.lit(2.0), F.col("b")).cast("long")).alias("v"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    table = words.toArrow()  # at most 2**19 rows of two numbers
    out[table["w"].to_numpy()] = table["v"].to_numpy()
    return out


def _token_pass(width: int):
    schema = pa.schema([("x", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])

    def run(batches):
        seen = set()
        for b in small_batches(batches, BLOCK_BYTES, "text"):
            rows = []
            for s in shingle_sets(*text_buffer(b.column("text")), width):
                if len(s) and (k := _keys(s)) not in seen:
                    seen.add(k)
                    rows.append((k[0], len(s), pack(s, 0, 0)))
            if rows:
                yield pa.RecordBatch.from_arrays([_signed([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()),
                                                  pa.array([r[2] for r in rows], pa.binary())], schema=schema)

    return run, "x long, n int, tokens binary"


def _cell_bounds(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, n, p, np, m) of distinct pairs (x, p): sizes and ``m``, an upper bound of the overlap."""
    pairs = pairs.select("x", "p")
    named = pairs.select("x").unionByName(pairs.select(F.col("p").alias("x"))).distinct()
    cells = stored(sets.where("n > 0").select(F.col("k1").alias("x"), F.col("n").cast("int").alias("n"), "cells").join(
        named, "x", "left_semi").dropDuplicates(["x"]), "cells")
    other = cells.select(F.col("x").alias("p"), F.col("n").alias("np"), F.col("cells").alias("pcells"))
    schema = pa.schema([("x", pa.int64()), ("n", pa.int32()), ("p", pa.int64()), ("np", pa.int32()), ("m", pa.int32())])

    def run(batches):
        for b in batches:
            n, size = b.column("n").to_numpy(), b.column("np").to_numpy()
            m = np.minimum(n, size).astype(np.int32)
            for i, (u, v) in enumerate(zip(b.column("cells"), b.column("pcells"))):
                if u.is_valid and v.is_valid:
                    m[i] = _most_shared(u.as_py(), int(n[i]), v.as_py(), int(size[i]))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("n"), b.column("p"), b.column("np"), pa.array(m)], schema=schema)

    return pairs.join(cells, "x").join(other, "p").select("x", "n", "p", "np", "cells", "pcells").mapInArrow(modest(run), "x long, n int, p long, np int, m int")


def _overlaps(docs: DataFrame, owners: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Written table (x, nx, p, np, o, added): exact intersection sizes of the pairs (x, p), and where three quarters of x or more lie in p, the rest of x.

    A set is made from its text where it is needed, sent once to its pairs, and
    meets p's set in a sorted stream: p first, then its partners. A p with many
    partners is dealt out over several streams.
    """
    spark = docs.sparkSession
    streams = pairs.groupBy("p").agg(F.ceil(F.count("*") / F.lit(STREAM)).cast("int").alias("k"))
    partner = pairs.join(streams, "p").select(F.col("x").alias("s"), F.col("p").alias("t"), F.pmod(F.hash("x"), F.col("k")).alias("part"), F.lit(1).alias("role"))
    head = streams.select(F.col("p").alias("s"), F.col("p").alias("t"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), F.lit(0).alias("role"))
    wanted = stored(partner.unionByName(head).groupBy("s").agg(F.collect_list(F.struct("t", "part", "role")).alias("to")), "wanted")
    bits = spark.sparkContext.broadcast(_wanted_filter(owners.join(wanted.select(F.col("s").alias("x")), "x").select("doc_id")))

    @F.pandas_udf("boolean")
    def hit(h):
        bit = h.to_numpy() % FILTER_BITS
        return pd.Series((bits.value[bit // 32] >> (bit % 32).astype(np.uint32)) & 1 == 1)

    run, schema = _token_pass(width)
    sets = docs.where(hit(F.xxhash64("doc_id"))).mapInArrow(modest(run), schema).join(wanted, F.col("x") == F.col("s"))
    sent = sets.select(F.explode("to").alias("to"), "s", "n", "tokens").select("to.t", "to.part", "to.role", "s", "n", "tokens")
    sent = sent.repartition("t", "part").sortWithinPartitions("t", "part", "role", "s")
    out = pa.schema([("x", pa.int64()), ("nx", pa.int32()), ("p", pa.int64()), ("np", pa.int32()), ("o", pa.int32()), ("added", pa.list_(pa.int64()))])

    def count(batches):
        head, last, other, size = None, None, None, 0
        for b in batches:
            made = [[], [], [], [], [], []]
            t, role, s, n = (b.column(c).to_pylist() for c in ("t", "role", "s", "n"))
            for i, data in enumerate(b.column("tokens")):
                if role[i] == 0:
                    if t[i] != head:
                        head, other, size = t[i], unpack(data.as_py()), n[i]
                elif (t[i], s[i]) != last:  # equal sets may come from several documents
                    last = (t[i], s[i])
                    mine = unpack(data.as_py())
                    at = np.searchsorted(other, mine)
                    at[at == len(other)] = 0
                    new = mine[other[at] != mine]
                    o = n[i] - len(new)
                    for column, v in zip(made, (s[i], n[i], t[i], size, o, new.astype(np.int64) if 4 * o >= 3 * n[i] else None)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, out)], schema=out)

    made = stored(sent.mapInArrow(modest(count), "x long, nx int, p long, np int, o int, added array<long>"), "overlaps")
    bits.destroy()
    return made


def _links(overlaps: DataFrame, percent: int) -> DataFrame:
    return overlaps.where(100 * F.col("o") >= percent * (F.col("nx") + F.col("np") - F.col("o"))).select(
        F.col("x").alias("u"), F.col("p").alias("v"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    run, schema = _signature_pass(width)
    signatures = stored(docs.mapInArrow(modest(run), schema), "signatures")
    sets = signatures.where("slice is null").select("doc_id", "n", "k1", "k2", "cells")
    total = sets.where("n > 0").agg(F.sum("n")).first()[0] or 0
    sketch = spark.sparkContext.broadcast(_sketch(signatures))
    heavy = max(1000, 16 * total // CELLS)

    buckets = bucket_count(spark, total * (100 - percent) / 100 * 16)
    run, schema = _index_pass(sketch, heavy, buckets, width, percent)
    lists, out_schema = _lists(buckets)
    lists = docs.mapInArrow(modest(run), schema).groupBy("bucket").applyInArrow(lists, out_schema).dropDuplicates(["l", "s"])
    index = stored(lists.select(F.col("l").alias("token"), F.inline(F.arrays_zip("x", "n", "pos", "typ"))), "index")
    sketch.destroy()
    index = index.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int"))

    # The set whose rarest shingles are the most common is the most typical one, the same in all lists of a group.
    pivots = index.groupBy("token", "c").agg(F.max(F.struct("typ", "x", "n", "pos")).alias("v")).select(
        "token", F.col("c").alias("pc"), F.col("v.x").alias("p"), F.col("v.n").alias("np"), F.col("v.pos").alias("pp"))
    near = pivots.select("*", F.explode(F.array(F.col("pc") - 1, F.col("pc"), F.col("pc") + 1)).alias("c"))
    # Every set meets the pivots of its own and the neighbouring blocks, unless positions or cell
    # counts leave less than three quarters of it to share (less where less may link): such a set is far from the pivot.
    least = min(75, percent)
    star = index.join(near, ["token", "c"]).where(F.col("x") != F.col("p")).where(100 * _room("n", "pos", "np", "pp") >= least * F.col("n"))
    bounded = stored(_cell_bounds(star.select("x", "p").distinct(), sets), "bounds")
    pairs = bounded.where(f"100 * m >= {least} * n").select("x", "p")
    owners = sets.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id")).select(F.col("k1").alias("x"), "doc_id")
    exact = _overlaps(docs, owners, pairs, width)
    links = _links(exact, percent)
    answered = exact.withColumn("most", F.lit(False)).unionByName(
        bounded.where(f"100 * m < {least} * n").select("x", F.col("n").alias("nx"), "p", "np", F.col("m").alias("o"), F.lit(True).alias("most")), allowMissingColumns=True)
    labels = stored(components(links), "labels")

    rest = stored(_unsettled(index, pivots, answered, labels, percent), "unsettled")
    rest = stored(_cell_bounds(rest, sets).where(F.col("m") >= _needed(F.col("n"), F.col("np"), percent)).select("x", "p"), "rest")
    final = labels
    if not rest.isEmpty():
        final = components(links.unionByName(_links(_overlaps(docs, owners, rest, width), percent)))

    member = sets.join(final.select(F.col("node").alias("k1"), "component"), "k1", "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "k1")).alias("label"))
    lowest = member.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("lowest"))
    return member.join(lowest, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("lowest", "doc_id").alias("component_id"))


def _unsettled(index: DataFrame, pivots: DataFrame, answered: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of one list, in different components, that the pivots' answers don't rule out.

    For sets X and Z that met the same pivot P, X n Z holds at most
    min(|X n P|, |Z n P|) shingles of P. What is missing to a link must be
    shared beyond P. So where both lie mostly in P and something is missing,
    only sets with a common shingle beyond P are paired, and a group of copies
    around P is never paired up. The other cases meet in their list, bounded by
    sizes, positions and |X n P| + |Z - P|.
    """
    comp = labels.select(F.col("node").alias("x"), "component")
    entry = index.join(comp, "x", "left").withColumn("component", F.coalesce("component", "x"))
    around = F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1))
    # Lists with one component in neighbouring blocks are settled as a whole.
    spread = entry.groupBy("token", "c").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    wide = spread.select("token", around.alias("c"), "lo", "hi").groupBy("token", "c").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("token", "c")
    home = comp.select(F.col("x").alias("p"), F.col("component").alias("home"))
    blocks = pivots.join(wide, (F.col("pc") == wide["c"]) & (pivots["token"] == wide["token"]), "left_semi").join(home, "p", "left").select(
        "token", F.col("pc").alias("b"), "p", "np", "pp", F.coalesce("home", "p").alias("home"))
    visits = entry.withColumn("b", around)
    known = answered.select("x", "p", "o", "most")
    # Overlaps with the pivot: exact, or the most that cells (or else positions) allow.
    own = F.col("x") == F.col("p")
    seen = visits.join(blocks, ["token", "b"]).join(known, ["x", "p"], "left").withColumn("most", ~own & F.coalesce("most", F.lit(True))).withColumn(
        "o", F.when(own, F.col("n")).otherwise(F.coalesce("o", _room("n", "pos", "np", "pp"))))
    seen = seen.withColumn("near", ~F.col("most") & (4 * F.col("o") >= 3 * F.col("n")))
    seen = stored(seen.select("token", "b", "c", "x", "n", "pos", "component", "p", "np", "home", "o", "most", "near"), "visits")
    member = seen.where("b = c")
    minor = seen.where("component <> home or b <> c").select(
        "token", "b", F.col("x").alias("x1"), F.col("n").alias("n1"), F.col("pos").alias("pos1"), F.col("component").alias("c1"),
        F.col("o").alias("o1"), F.col("most").alias("most1"), F.col("near").alias("near1"))
    apart = (F.col("c1") != F.col("component")) & _may_link("n1", "pos1", "n", "pos", percent)
    least = _needed(F.col("n"), F.col("n1"), percent)
    # What both share in P is at most what either does; the rest of a set is known where its own overlap is exact.
    far = apart & (F.col("most") | (F.col("o1") + F.col("n") - F.col("o") >= least)) & (
        F.col("most1") | (F.col("o") + F.col("n1") - F.col("o1") >= least))
    inside = apart & (F.least("o", "o1") >= least) & ((F.col("n") < F.col("np")) | (F.col("n1") < F.col("np")))
    on = ["token", "b"]
    met = [minor.where("not near1").join(member, on).where(far), minor.where("near1").join(member.where("not near"), on).where(far),
           minor.where("near1").join(member.where("near and n < np"), on).where(inside),
           minor.join(seen.select("token", "b", "np").distinct().withColumnRenamed("np", "nq"), on).where("near1 and n1 < nq").drop("nq").join(
               member.where("near"), on).where(inside)]
    pairs = [m.select(F.greatest("x", "x1").alias("x"), F.least("x", "x1").alias("p")) for m in met]

    beyond = answered.where("added is not null").select("x", "p", F.explode("added").alias("e"))
    sets = seen.where("near").select("p", "x", "n", "o", "component", (F.col("b") == F.col("c")).alias("member"),
                                     ((F.col("component") != F.col("home")) | (F.col("b") != F.col("c"))).alias("minor")).distinct()
    extra = beyond.join(sets, ["x", "p"])
    left = extra.where("minor").select("p", "e", F.col("x").alias("x1"), F.col("n").alias("n1"), F.col("o").alias("o1"), F.col("component").alias("c1")).distinct()
    right = extra.where("member").select("p", "e", "x", "n", "o", "component").distinct()
    shared = left.join(right, ["p", "e"]).where((F.col("c1") != F.col("component")) & (100 * F.least("n", "n1") >= percent * F.greatest("n", "n1")))
    shared = shared.groupBy("p", "x", "x1").agg(F.count("*").alias("both"), F.first("n").alias("n"), F.first("n1").alias("n1"), F.first("o").alias("o"),
                                                F.first("o1").alias("o1")).where(F.col("both") + F.least("o", "o1") >= least)
    pairs.append(shared.select(F.greatest("x", "x1").alias("x"), F.least("x", "x1").alias("p")))
    every = pairs[0]
    for more in pairs[1:]:
        every = every.unionByName(more)
    asked = answered.select(F.greatest("x", "p").alias("x"), F.least("x", "p").alias("p"))
    return every.distinct().join(asked, ["x", "p"], "left_anti")
