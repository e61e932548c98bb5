"""Consistent-hash ring with virtual nodes and bounded loads.

Shards own virtual nodes on a ring of 60-bit positions; a key belongs to the
first virtual node at or after its own position. A shard takes rows up to its
capacity. What it cannot take continues clockwise to the next shard not tried
yet, in rounds: in round r every arc of the ring offers its unplaced rows to
the r-th different shard from its start, and a shard takes them in ring order.
So a shard below its capacity keeps all its own rows, only the overflow moves,
and after as many rounds as shards nothing is left.

Only counts per arc (virtual nodes + 1 of them, whatever the input) meet in one
row, where the rounds are a fold. Rows are ranked along the ring by range
partitions whose key ends in a number of the row, so a key that holds a third
of all rows spreads over tasks and over shards.

Null keys hash as an empty text, null texts have size ``overhead`` and checksum
0, repeated rows are rows of their own. An empty table gives no rows. Other
columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom.functions.numeric import let
from massloom.llm.storage import stored
from massloom.operators.ordering import global_rank

POSITION_DIGITS = 15
CELL_DIGITS = 3
_CELL_BITS = 4 * (POSITION_DIGITS - CELL_DIGITS)


def position(text: Column) -> Column:
    """Place on the ring: the first 60 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, POSITION_DIGITS), 16, 10).cast("long")


def ring(spark, shards: int, virtual: int) -> DataFrame:
    """Arcs in ring order (arc, till, prefer): all shards in clockwise order of first appearance.

    Virtual nodes are a parameter, so the table has a fixed size. The last arc
    lies beyond the last virtual node and leads to the first.
    """
    nodes = spark.range(shards * virtual).select((F.col("id") % shards).cast("int").alias("shard"), (F.col("id") / shards).cast("long").alias("v"))
    at = nodes.select("shard", position(F.concat(F.lit("shard:"), F.col("shard").cast("string"), F.lit(":"), F.col("v").cast("string"))).alias("till"))
    line = at.groupBy().agg(F.array_sort(F.collect_list(F.struct("till", "shard"))).alias("nodes"))
    around = line.select("nodes", F.transform("nodes", lambda n: n["shard"]).alias("owners"))
    one = around.select("owners", F.posexplode(F.concat("nodes", F.array(F.struct(F.lit(None).cast("long").alias("till"), F.element_at("nodes", 1)["shard"].alias("shard"))))).alias("arc", "node"))
    clockwise = F.array_distinct(F.concat(F.slice("owners", F.col("arc") + 1, F.lit(shards * virtual)), F.slice("owners", F.lit(1), F.col("arc"))))
    return one.select("arc", F.col("node.till").alias("till"), clockwise.alias("prefer"))


def _cells(arcs: DataFrame, spark) -> DataFrame:
    """Per cell of the ring (4,096 of them): arcs before it, and the virtual nodes inside."""
    inside = (arcs.where("till is not null").groupBy(F.shiftright("till", _CELL_BITS).alias("cell"))
              .agg(F.array_sort(F.collect_list("till")).alias("inside")))
    cells = spark.range(16 ** CELL_DIGITS).select(F.col("id").alias("cell")).join(F.broadcast(inside), "cell", "left")
    earlier = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # a window over the fixed number of cells
    return cells.select("cell", "inside", F.coalesce(F.sum(F.when(F.col("inside").isNotNull(), F.size("inside"))).over(earlier), F.lit(0)).alias("before"))


def _taken(free: Column, offers: Column, shard: Column) -> Column:
    """What one shard takes of the offers of a round, in ring order: struct<free, got: array<struct<arc, shard, lo, n, slot>>>."""
    start = F.struct(free.alias("free"), F.expr("cast(array() as array<struct<arc:int,shard:int,lo:bigint,n:bigint,slot:bigint>>)").alias("got"))

    def step(acc, x):
        n = F.least(acc["free"], x["rem"])
        row = F.struct(x["arc"].alias("arc"), shard.alias("shard"), x["lo"].alias("lo"), n.alias("n"), (-acc["free"]).alias("slot"))
        return F.struct((acc["free"] - n).alias("free"), F.when(n > 0, F.concat(acc["got"], F.array(row))).otherwise(acc["got"]).alias("got"))

    return F.aggregate(F.filter(offers, lambda x: x["to"] == shard), start, step)


def settle(arcs: DataFrame, shards: int, slack: float = 0.0) -> DataFrame:
    """(arc, shard, lo, n, slot) from (arc, n, prefer): rows lo .. lo+n-1 of an arc become slots slot .. slot+n-1 of a shard.

    Without slack the capacities add up to the number of rows and differ by one
    at most; with slack each is the rounded-up mean times (1 + slack).
    """
    all_rows = arcs.where("n > 0").groupBy().agg(F.array_sort(F.collect_list(F.struct("arc", "n", "prefer"))).alias("arcs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    ids = F.sequence(F.lit(0), F.lit(shards - 1))
    total = F.col("total")
    if slack:
        capacity = F.transform(ids, lambda s: F.ceil(total / shards * (1 + slack)).cast("long"))
    else:
        capacity = F.transform(ids, lambda s: F.floor(total / shards).cast("long") + F.when(s < total % shards, 1).otherwise(0))
    item = lambda arc, rem, lo, prefer: F.struct(arc.alias("arc"), rem.alias("rem"), lo.alias("lo"), prefer.alias("prefer"))
    state = F.struct(F.transform("arcs", lambda a: item(a["arc"], a["n"], F.lit(0).cast("long"), a["prefer"])).alias("items"), capacity.alias("free"),
                     F.expr("cast(array() as array<struct<arc:int,shard:int,lo:bigint,n:bigint,slot:bigint>>)").alias("got"))

    def one_round(acc, r):
        offers = F.transform(acc["items"], lambda x: F.struct(x["arc"].alias("arc"), x["rem"].alias("rem"), x["lo"].alias("lo"), F.element_at(x["prefer"], r + 1).alias("to")))
        return let(offers, lambda o: let(F.transform(ids, lambda s: _taken(F.element_at(acc["free"], s + 1), o, s)), lambda took: let(
            F.map_from_entries(F.transform(F.flatten(F.transform(took, lambda t: t["got"])), lambda g: F.struct(g["arc"], g["n"]))), lambda gone: F.struct(
                F.filter(F.transform(acc["items"], lambda x: let(F.coalesce(F.element_at(gone, x["arc"]), F.lit(0)), lambda n: item(x["arc"], x["rem"] - n, x["lo"] + n, x["prefer"]))),
                         lambda x: x["rem"] > 0).alias("items"),
                F.transform(took, lambda t: t["free"]).alias("free"),
                F.concat(acc["got"], F.flatten(F.transform(took, lambda t: t["got"]))).alias("got")))))

    done = all_rows.select(capacity.alias("capacity"), F.aggregate(ids, state, one_round)["got"].alias("got"))
    segments = done.select("capacity", F.explode("got").alias("g")).select("capacity", "g.*")
    return segments.select("arc", "shard", "lo", "n", (F.element_at("capacity", F.col("shard") + 1) + F.col("slot")).alias("slot"))


def bounded_ring(docs: DataFrame, shards: int, virtual: int = 128, slack: float = 0.0, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, size, text_crc32, shard, slot, home), home being the shard without bounds."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.concat(F.lit("key:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       position(key).alias("at"), F.monotonically_increasing_id().alias("row"))
    arcs = stored(ring(spark, shards, virtual).coalesce(1), "ring")
    cell = F.broadcast(_cells(arcs, spark))  # 4,096 rows
    found = (F.col("before") + F.coalesce(F.size(F.filter("inside", lambda t: t < F.col("at"))), F.lit(0))).cast("int")
    rows = stored(slim.withColumn("cell", F.shiftright("at", _CELL_BITS)).join(cell, "cell").select("doc_id", "size", "text_crc32", "at", "row", found.alias("arc")), "keys")
    counts = rows.groupBy("arc").agg(F.count("*").alias("n"))
    placed_arcs = settle(arcs.join(counts, "arc"), shards, slack)
    # Where each arc begins in the global order, and what becomes of its rows: one row per arc, at most virtual nodes + 1.
    begins = counts.groupBy().agg(F.array_sort(F.collect_list(F.struct("arc", "n"))).alias("all")).select(F.explode(F.transform(
        "all", lambda a: F.struct(a["arc"].alias("arc"), F.aggregate(F.filter("all", lambda b: b["arc"] < a["arc"]), F.lit(0).cast("long"), lambda s, b: s + b["n"]).alias("begin")))).alias("b")).select("b.*")
    of_arc = placed_arcs.groupBy("arc").agg(F.array_sort(F.collect_list(F.struct("lo", "n", "shard", "slot"))).alias("parts"))
    table = stored(begins.join(of_arc, "arc").join(arcs.select("arc", F.element_at("prefer", 1).alias("home")), "arc").coalesce(1), "arcs")
    ranked = global_rank(rows, ["at", "doc_id", "size", "text_crc32", "row"], "pos")
    place = F.element_at(F.filter("parts", lambda p: (F.col("inner") >= p["lo"]) & (F.col("inner") < p["lo"] + p["n"])), 1)
    return (ranked.join(F.broadcast(table), "arc").withColumn("inner", F.col("pos") - F.col("begin")).withColumn("place", place)
            .select("doc_id", "size", "text_crc32", F.col("place.shard").alias("shard"), (F.col("place.slot") + F.col("inner") - F.col("place.lo")).alias("slot"), "home", "row"))


def assigned(docs: DataFrame, shards: int, **options) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): the ``rows`` law, counts at most one apart."""
    made = bounded_ring(docs, shards, **options)
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
                       F.lit(None).cast("int").alias("grown_shard"), F.col("home").cast("int").alias("home_shard"))
