"""Ranked candidate lists.

Lists are long tables (query, key, score, position columns). Every order is
explicit. Per-query work is a partially aggregated group-by or a top-k window,
which Spark limits to k rows per key before the shuffle, so a query that owns a
large part of the rows never gathers them in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom import fixed


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= k)


def best_per_key(df: DataFrame, by: list[str], order: list[tuple[str, bool]], carry: list[str] = ()) -> DataFrame:
    """First row per key in the given order ((column, descending) pairs of numbers or ascending text)."""
    names = [c for c, _ in order]
    sort_key = F.struct(*[(-F.col(c) if desc else F.col(c)).alias(f"o{i}") for i, (c, desc) in enumerate(order)])
    rest = [c for c in [*names, *carry] if c not in by]
    first = df.groupBy(*by).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), sort_key).alias("__r"))
    return first.select(*by, *[F.col(f"__r.{c}").alias(c) for c in rest])


def distinct_top_k(df: DataFrame, query: list[str], key: str, score: str, pos: list[str], k: int = fixed.TOP_K,
                   carry: list[str] = (), bounded: bool = False) -> DataFrame:
    """Top k by descending score; later aliases of a key already seen take no rank.

    The default reduces each (query, key) map-side and can take a query of any
    size. ``bounded`` states that no query has many rows; then both steps are
    windows over one exchange.
    """
    order = [F.col(score).desc(), *[F.col(p).asc() for p in pos]]
    if bounded:
        rows = df.select(*query, key, score, *pos, *carry).repartition(*query)
        first = F.row_number().over(W.partitionBy(*query, key).orderBy(*order))
        best = rows.withColumn("__first", first).filter("__first = 1").drop("__first")
    else:
        best = best_per_key(df, [*query, key], [(score, True), *[(p, False) for p in pos]], list(carry))
    return top_k(best, query, order, k)


def truth_ranks(truth: DataFrame, ranked: DataFrame, query: list[str], truth_key: str, key: str) -> DataFrame:
    """Rank of the true key per truth row, 0 when absent; misses stay in the table."""
    r = ranked.select(*query, F.col(key).alias(truth_key), "rank")
    return truth.join(r, [*query, truth_key], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def submitted_rank(guesses: DataFrame, query: str, cell: str, truth: str, separator: str = ";") -> DataFrame:
    """First position whose guess equals the truth; duplicates and invalid guesses keep their place."""
    pos = F.array_position(F.split(cell, separator), F.col(truth))
    return guesses.select(query, F.coalesce(pos, F.lit(0)).cast("int").alias("rank"))


def ranked_list(ranked: DataFrame, query: str, guess: str, separator: str = ";") -> DataFrame:
    """One row per query with its (at most k) guesses joined in rank order."""
    items = F.array_sort(F.collect_list(F.struct("rank", guess)))
    return ranked.groupBy(query).agg(
        F.array_join(F.transform(items, lambda x: x[guess]), separator).alias("guesses"),
        F.count(F.lit(1)).alias("n_guesses"))


def top_margin(df: DataFrame, query: list[str], score: str, tie: list[str]) -> DataFrame:
    """Difference of the two best scores, null for a single candidate."""
    best = top_k(df, query, [F.col(score).desc(), *[F.col(t) for t in tie]], 2)
    return best.groupBy(*query).agg(
        F.max(F.when(F.col("rank") == 1, F.col(score))).alias("top1"),
        (F.max(F.when(F.col("rank") == 1, F.col(score))) - F.max(F.when(F.col("rank") == 2, F.col(score)))).alias("margin"))


def gated_promotion(df: DataFrame, query: list[str], key: str, base: str, spectral: str, pos: str,
                    threshold: float = fixed.GATE_THRESHOLD, margin: float = fixed.GATE_MARGIN) -> DataFrame:
    """Puts one unambiguous spectral match first and keeps the base order otherwise.

    The runner-up must carry a different key. The best row of each key, and then
    the two best keys, decide; the rows themselves only gain an order column.
    """
    per_key = best_per_key(df, [*query, key], [(spectral, True), (pos, False)])
    two = top_k(per_key, query, [F.col(spectral).desc(), F.col(pos)], 2, "__r")
    first = F.col("__r") == 1
    gate = two.groupBy(*query).agg(
        F.max(F.when(first, F.col(spectral))).alias("best_similarity"), F.max(F.when(first, F.col(pos))).alias("__best_pos"),
        F.coalesce(F.max(F.when(~first, F.col(spectral))), F.lit(0.0)).alias("__second")).withColumn(
        "gap", F.col("best_similarity") - F.col("__second")).withColumn(
        "activated", (F.col("best_similarity") >= threshold) & (F.round("gap", 9) >= margin)).drop("__second")
    return df.join(gate, query).withColumn(
        "front", F.when(F.col("activated") & (F.col(pos) == F.col("__best_pos")), 0).otherwise(1)).drop("__best_pos")


def frontier(df: DataFrame, group: list[str], regime: str, key: str, score: str, pos: str, n: int) -> DataFrame:
    """Union over regimes of each regime's n best keys."""
    return top_k(df, [*group, regime], [F.col(score).desc(), F.col(pos)], n).select(*group, key).distinct()


def rerank_inside(df: DataFrame, query: list[str], score: str, evidence: Column, weight: float, pos: str, n: int) -> DataFrame:
    """Adds weighted evidence to the n best rows only; the others keep their score."""
    head = top_k(df, query, [F.col(score).desc(), F.col(pos)], n).select(*query, pos, F.lit(True).alias("__head"))
    return df.join(head, [*query, pos], "left").withColumn(
        "final", F.col(score) + F.when(F.coalesce("__head", F.lit(False)), weight * evidence).otherwise(F.lit(0.0))) \
        .drop("__head")


def isomer_slots(df: DataFrame, query: list[str], formula: str, slot: str, final: str) -> DataFrame:
    """Re-orders only within rows of one formula, over the slots that formula holds.

    Input is a fixed top list (at most k rows per query). A null formula keeps its slot.
    """
    group = F.coalesce(F.col(formula), F.concat(F.lit("unsupported:"), F.col(slot).cast("string")))
    d = df.withColumn("__g", group)
    by = [*query, "__g"]
    old = d.select(*by, F.col(slot).alias("new_slot"),
                   F.row_number().over(W.partitionBy(*by).orderBy(slot)).alias("__i"))
    new = d.withColumn("__i", F.row_number().over(W.partitionBy(*by).orderBy(F.col(final).desc(), slot)))
    return new.join(old, [*by, "__i"]).drop("__g", "__i")


def rotate_blocks(df: DataFrame, mass: str, tie: str, value: str, block: int = 32) -> DataFrame:
    """Shuffled control: within blocks of neighbours in mass order each row takes the value before it."""
    from massloom.operators.ordering import global_rank

    r = global_rank(df, [mass, tie], "pos").withColumn("block", F.floor(F.col("pos") / block))
    w = W.partitionBy("block").orderBy("pos")
    whole = W.partitionBy("block").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return r.withColumn("rotated", F.coalesce(F.lag(value).over(w), F.last(value).over(whole)))


def lowest_hash(df: DataFrame, key: list[str], digest: str, n: int) -> DataFrame:
    """The n lowest distinct digests per key: a sample that ignores input order."""
    return top_k(df.dropDuplicates([*key, digest]), key, [F.col(digest).asc()], n)
