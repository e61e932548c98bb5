"""Rank metrics and paired comparisons."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.functions.hashing import draw
from massloom.functions.numeric import reciprocal
from massloom.operators.ordering import global_rank
from massloom.operators.quantiles import exact_quantiles


def rank_metrics(rank: str = "rank", k: int = 25) -> list[Column]:
    """Aggregates over all rows: a miss (0 or null) counts as zero; no rows give nulls."""
    inside = F.when(F.col(rank).between(1, k), F.col(rank))
    hit = F.coalesce(inside, F.lit(0))
    return [
        F.count(F.lit(1)).alias("molecules"), F.avg(reciprocal(hit)).alias("mrr"),
        F.avg((hit == 1).cast("double")).alias("top1"), F.avg((hit > 0).cast("double")).alias("recall")]


def paired_bootstrap(units: DataFrame, unit: str, delta: str, repeats: int = 2000, seed: str = "26091603") -> DataFrame:
    """Mean difference and 95 % interval from resampling units with replacement.

    Draw i of repeat r picks position sha256(seed:r:i) mod n. Draws are generated
    and joined in parallel and averaged with map-side partial sums.
    """
    placed = global_rank(units.select(unit, delta), [unit], "pos").select("pos", delta)
    n = placed.count()
    draws = units.sparkSession.range(repeats * n).select(
        F.expr(f"id div {n}").alias("r"),
        draw(F.concat_ws(":", F.lit(seed), F.expr(f"id div {n}"), F.col("id") % n), F.lit(n)).alias("pos"))
    # The identity sample rides along as r = -1, so the point estimate needs no second pass.
    own = placed.select(F.lit(-1).cast("bigint").alias("r"), delta)
    means = draws.join(placed, "pos").select("r", delta).unionByName(own).groupBy("r").agg(
        F.avg(delta).alias("m"), F.count(F.lit(1)).alias("n"))
    return _interval(means)


def poisson_bootstrap(units: DataFrame, unit: str, delta: str, repeats: int = 2000, seed: str = "26091603") -> DataFrame:
    """The same interval from independent Poisson(1) weights: one pass, no draw ever shuffled.

    Each unit emits its weights where it lives; only ``repeats`` partial sums per
    task are exchanged. Use this form when units are many.
    """
    # A weight is the number of cumulative probabilities at or below the draw. Thirteen digest
    # digits and the probabilities at the same scale compare as text of equal width.
    p, cumulative, weight = 0.36787944117144233, 0.0, None
    for count in range(12):
        cumulative += p
        below = F.col("h") < f"{math.ceil(cumulative * 2**52):013x}"
        weight = F.when(below, count) if weight is None else weight.when(below, count)
        p /= count + 1
    weight = weight.otherwise(12)
    # One digest serves four repeats, thirteen digits each.
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col("q"), F.col(unit)), 256)
    drawn = F.filter(F.transform(F.array(*[F.lit(j) for j in range(4)]), lambda j: F.struct(
        (F.col("q") * 4 + j).cast("int").alias("r"), F.substr(F.col("digest"), j * 13 + 1, F.lit(13)).alias("h"))), lambda x: x["r"] < repeats)
    own = F.array(F.struct(F.lit(-1).alias("r"), F.lit("").alias("h")))
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One row per unit is spread out before it multiplies; r = -1 keeps weight 1 for the point estimate.
    w = (units.select(unit, delta).repartition(tasks, unit)
         .select(unit, delta, F.explode(F.sequence(F.lit(-1), F.lit((repeats - 1) // 4))).alias("q")).withColumn("digest", digest)
         .select(delta, F.inline(F.when(F.col("q") < 0, own).otherwise(drawn))).withColumn("w", F.when(F.col("r") < 0, 1).otherwise(weight)))
    means = w.groupBy("r").agg((F.sum(F.col("w") * F.col(delta)) / F.sum("w")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _interval(means)


def _interval(means: DataFrame) -> DataFrame:
    """Point estimate from r = -1 and the interval from one mean per repeat (a fixed, small number of rows)."""
    drawn = F.when(F.col("r") >= 0, F.col("m"))
    return means.agg(
        F.max(F.when(F.col("r") < 0, F.col("n"))).alias("units"), F.max(F.when(F.col("r") < 0, F.col("m"))).alias("delta"),
        F.percentile(drawn, 0.025).alias("lo"), F.percentile(drawn, 0.975).alias("hi"))


def grid(df: DataFrame, configs: list[dict]) -> DataFrame:
    """Each row once per configuration (a literal list), with a ``config`` struct and its index."""
    entries = [F.struct(F.lit(i).alias("id"), *[F.lit(v).alias(k) for k, v in c.items()]) for i, c in enumerate(configs)]
    return df.withColumn("config", F.explode(F.array(*entries)))


def max_min_choice(gains: DataFrame, config: str, regime: str, gain: str, weight: str) -> DataFrame:
    """The configuration with the best worst-regime gain, then mean gain, then lowest weight."""
    per = gains.groupBy(config, weight).agg(F.min(gain).alias("min_gain"), F.avg(gain).alias("mean_gain"))
    return per.orderBy(F.col("min_gain").desc(), F.col("mean_gain").desc(), F.col(weight), F.col(config)).limit(1)


def guarded_choice(scores: DataFrame, mode: str, guard: str, baseline: float | Column, slack: float,
                   objective: Column) -> DataFrame:
    """Best objective among modes whose guard metric stays within ``slack`` of the baseline."""
    base = baseline if isinstance(baseline, Column) else F.lit(baseline)
    return scores.filter(F.col(guard) >= base - slack).withColumn("objective", objective) \
        .orderBy(F.col("objective").desc(), F.col(mode)).limit(1)


def promotion_gate(report: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per check plus eligibility; a check that cannot be computed is failed."""
    named = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()])
    passed = F.forall(named, lambda x: x["passed"])
    return report.select(F.explode(named).alias("c"), passed.alias("eligible")).select("c.check", "c.passed", "eligible")


def recompute_audit(stored: DataFrame, recomputed: DataFrame, keys: list[str], values: list[str],
                    tol: float = 1e-12) -> DataFrame:
    """Rows, matches, absences and the largest difference between stored and recomputed values."""
    s = stored.select(*keys, *[F.col(v).alias(f"s_{v}") for v in values], F.lit(1).alias("__s"))
    r = recomputed.select(*keys, *[F.col(v).alias(f"r_{v}") for v in values], F.lit(1).alias("__r"))
    j = s.join(r, keys, "full_outer")
    diff = F.greatest(*[F.abs(F.col(f"s_{v}") - F.col(f"r_{v}")) for v in values], F.lit(0.0))
    both = F.col("__s").isNotNull() & F.col("__r").isNotNull()
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(both & (diff <= tol)).alias("matching"),
                 F.count_if(~both).alias("unpaired"), F.max(F.when(both, diff)).alias("max_diff"))


def numeric_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, median, p95 (linear interpolation) and max over finite values; a group with none gives nulls."""
    fin = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))))
    q = exact_quantiles(fin, by, value, [0.5, 0.95, 1.0])
    return q.select(*by, F.col("n").alias("count"), F.col("q0").alias("median"), F.col("q1").alias("p95"),
                    F.col("q2").alias("max"))
