"""The end-to-end search: candidates, prior, distinct-key list, metric."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom import fixed
from massloom.functions.numeric import r6
from massloom.operators import ranges
from massloom.operators.metrics import rank_metrics
from massloom.operators.ranking import distinct_top_k, truth_ranks
from massloom.plans.views import Tables

PPM, DA = 300.0, 0.02


def ranked_by_mass(t: Tables, k: int = fixed.TOP_K) -> DataFrame:
    """Top k distinct keys for each distinct observed mass, by distance (1e-6) then id.

    Observations repeat across queries and masses repeat across the catalogue;
    both sides are reduced to what can matter before they meet. A point's rows
    are then few: at most k per distinct mass in its window.
    """
    rows = ranges.nearest_keys(t.queries.select("obs").distinct(), t.catalog, k, PPM, DA, width=0.6)
    scored = rows.withColumn("closeness", -F.col("distance"))
    return distinct_top_k(scored, ["obs"], "structure_key", "closeness", ["structure_id"], k, bounded=True)


def mass_search_ranks(t: Tables) -> DataFrame:
    return truth_ranks(t.queries, ranked_by_mass(t), ["obs"], "truth_key", "structure_key")


def mass_search(t: Tables) -> DataFrame:
    return mass_search_ranks(t).agg(*rank_metrics()).select("molecules", r6("mrr").alias("mrr"), r6("top1").alias("top1"),
                                                            r6("recall").alias("recall"))
