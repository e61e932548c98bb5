"""Mass-tolerance joins as binned equi-joins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom import fixed
from massloom.functions.numeric import tolerance
from massloom.operators.ordering import global_running_sum, merge_intervals
from massloom.session import durable

BIN = "__bin"


def _bin(value: Column | str, width: float) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(float(width))).cast("bigint")


def explode_bins(df: DataFrame, lo: str, hi: str, width: float) -> DataFrame:
    return df.withColumn(BIN, F.explode(F.sequence(_bin(lo, width), _bin(hi, width))))


def range_join(left: DataFrame, right: DataFrame, lo: str, hi: str, point: str, width: float,
               on: list[str] | None = None) -> DataFrame:
    """Rows of ``left`` with every row of ``right`` whose ``point`` lies in [lo, hi].

    Equi-join on bins of ``width`` plus the exact predicate: Spark shuffles and
    sort-merges (or broadcasts whichever side its size statistics allow) instead
    of comparing all pairs. The width is a matter of speed only; about twice
    the usual tolerance keeps an interval in one or two bins. Dense bins are
    split by AQE's skew join.
    """
    keys = [BIN, *(on or [])]
    r = right.withColumn(BIN, _bin(point, width))
    joined = explode_bins(left, lo, hi, width).join(r, keys)
    return joined.filter((F.col(point) >= F.col(lo)) & (F.col(point) <= F.col(hi))).drop(BIN)


def range_semi(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str, width: float) -> DataFrame:
    """Rows of ``points`` inside at least one interval."""
    i = explode_bins(intervals.select(F.col(lo).alias("__lo"), F.col(hi).alias("__hi")), "__lo", "__hi", width)
    p = points.withColumn(BIN, _bin(point, width))
    cond = (p[BIN] == i[BIN]) & (p[point] >= i["__lo"]) & (p[point] <= i["__hi"])
    return p.join(i, cond, "left_semi").drop(BIN)


def mass_candidates(queries: DataFrame, catalog: DataFrame, obs: str = "obs", mass: str = "mass",
                    ppm: float = fixed.CANDIDATE_TOLERANCE[0], da: float = fixed.CANDIDATE_TOLERANCE[1],
                    width: float | None = None) -> DataFrame:
    """Query x catalogue pairs within max(da, obs * ppm * 1e-6), both ends closed."""
    tol = tolerance(obs, ppm, da)
    q = queries.withColumn("__lo", F.col(obs) - tol).withColumn("__hi", F.col(obs) + tol)
    w = width or max(2 * da, 2 * 1000 * ppm * 1e-6)
    return range_join(q, catalog, "__lo", "__hi", mass, w).drop("__lo", "__hi")


def member_lists(df: DataFrame, by: str, ident: str, out: str, size: int = 1024) -> DataFrame:
    """(by, out): the ids of each distinct value in lists of about ``size``, so a value of any weight makes many short rows."""
    n = df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("__lists"))
    part = F.when(F.col("__lists") > 1, F.pmod(F.xxhash64(ident), F.col("__lists"))).otherwise(F.lit(0))
    return df.join(n, by).groupBy(by, part.alias("__list")).agg(F.collect_list(ident).alias(out)).drop("__list")


def mass_members(queries: DataFrame, catalog: DataFrame, value: Column, query: str = "query_id", ident: str = "structure_id", obs: str = "obs", mass: str = "mass",
                 ppm: float = fixed.CANDIDATE_TOLERANCE[0], da: float = fixed.CANDIDATE_TOLERANCE[1]) -> DataFrame:
    """Pairs of ``mass_candidates`` as (query, ident, ``value`` of obs and mass) where only lists of ids travel.

    Distinct observations meet distinct masses; every pair of them unfolds its
    ids where it stands. Exchanges grow with queries and catalogue, rows with pairs.
    """
    q = member_lists(queries.filter(F.col(obs).isNotNull()), obs, query, "__queries")
    c = member_lists(catalog.filter(F.col(mass).isNotNull()), mass, ident, "__members")
    met = mass_candidates(q, c, obs, mass, ppm, da).select("__queries", "__members", value)
    kept = met.columns[2:]
    one = met.select(F.explode("__queries").alias(query), "__members", *kept)
    return one.select(query, F.explode("__members").alias(ident), *kept)


def mass_shortlist(catalog: DataFrame, k: int, mass: str = "mass", key: str = "structure_key",
                   ident: str = "structure_id") -> DataFrame:
    """The first k distinct keys of every distinct mass (by id): all that a distance-ranked top k can use.

    Rows of one mass are equally far from any query, so later keys of that mass
    can never enter a list of k. A mass shared by much of the catalogue shrinks
    to k rows before any join.
    """
    from massloom.operators.ranking import top_k

    one = catalog.groupBy(mass, key).agg(F.min(ident).alias(ident))
    return top_k(one, [mass], [F.col(ident)], k, "__rn").drop("__rn")


def nearest_keys(points: DataFrame, catalog: DataFrame, k: int, ppm: float, da: float, obs: str = "obs",
                 mass: str = "mass", key: str = "structure_key", ident: str = "structure_id",
                 width: float | None = None) -> DataFrame:
    """(obs, key, ident, distance): every row that a list of the k nearest distinct keys can need.

    Points meet distinct masses first, where the distance (to 1e-6) is computed
    and where farther masses are dropped once a nearer one already supplies k
    keys. Only then do the surviving masses bring in their shortlisted rows.
    """
    short = mass_shortlist(catalog, k, mass, key, ident)
    masses = short.groupBy(mass).agg(F.count(F.lit(1)).alias("__keys"))
    near = mass_candidates(points, masses, obs, mass, ppm, da, width).withColumn(
        "distance", F.round(F.abs(F.col(mass) - F.col(obs)), 6))
    # A point's group here is the distinct masses of one window.
    reach = F.min(F.when(F.col("__keys") >= k, F.col("distance"))).over(W.partitionBy(obs))
    kept = near.withColumn("__reach", reach).filter(F.col("__reach").isNull() | (F.col("distance") <= F.col("__reach")))
    return kept.select(obs, mass, "distance").join(short, mass).select(obs, key, ident, "distance")


def hard_negatives(catalog: DataFrame, k: int = 7, ppm: float = fixed.CANDIDATE_TOLERANCE[0],
                   da: float = fixed.CANDIDATE_TOLERANCE[1], mass: str = "mass", key: str = "structure_key",
                   ident: str = "structure_id") -> DataFrame:
    """For each row the k nearest different keys in its mass window, nearest first.

    The list depends on the mass only, up to the row's own key. So it is built
    once per distinct mass with k + 1 keys and then handed to the rows, which
    never meet each other pairwise.
    """
    from massloom.operators.ranking import best_per_key, top_k

    one = catalog.groupBy(mass, key).agg(F.min(ident).alias(ident))
    short = top_k(one, [mass], [F.col(key)], k + 1, "__rn").drop("__rn")
    points = catalog.select(F.col(mass).alias("__center")).distinct()
    near = mass_candidates(points, short, "__center", mass, ppm, da).withColumn("__d", F.abs(F.col(mass) - F.col("__center")))
    best = best_per_key(near, ["__center", key], [("__d", False), (ident, False)])
    lists = top_k(best, ["__center"], [F.col("__d"), F.col(key), F.col(ident)], k + 1, "__r").select(
        F.col("__center").alias(mass), F.col(key).alias("negative_key"), F.col(ident).alias("negative_id"), "__r")
    rows = catalog.select(ident, key, mass).join(lists, mass).filter(F.col("negative_key") != F.col(key))
    return top_k(rows, [ident], [F.col("__r")], k).select(ident, "rank", "negative_id")


def query_windows(queries: DataFrame, obs: str = "obs", ppm: float = fixed.CANDIDATE_TOLERANCE[0],
                  da: float = fixed.CANDIDATE_TOLERANCE[1], padding: float = fixed.INTERVAL_PADDING) -> DataFrame:
    """Merged padded windows of all query masses."""
    d = queries.select(F.col(obs).alias("m")).distinct()
    reach = tolerance("m", ppm, da) + F.lit(padding)
    # A window narrower than any gap between masses stays its own island.
    return merge_intervals(d.select((F.col("m") - reach).alias("lo"), (F.col("m") + reach).alias("hi")), "lo", "hi")


def inside_windows(rows: DataFrame, windows: DataFrame, mass: str = "mass", width: float = 1.0) -> DataFrame:
    """Catalogue rows inside any merged window."""
    slack = F.lit(fixed.INTERVAL_SLACK)
    w = windows.select((F.col("lo") - slack).alias("lo"), (F.col("hi") + slack).alias("hi"))
    return range_semi(rows, w, mass, "lo", "hi", width)


def nearest_masses(points: DataFrame, masses: DataFrame, k: int, obs: str = "obs", mass: str = "mass",
                   weight: str = "n", block: int = 64) -> DataFrame:
    """For each distinct point the nearest distinct masses covering at least k weighted rows.

    Returns (obs, mass, need): take ``need`` rows of that mass. Ties in distance
    prefer the lower mass. Points find their place in the mass order through a
    global rank of the union; then a point meets only the 2k masses around that
    place, through an equi-join on blocks of positions.
    """
    m = masses.select(F.col(mass).alias("v"), F.col(weight).alias("n"), F.lit(0).alias("is_point"))
    p = points.select(F.col(obs).alias("v"), F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("is_point")).distinct()
    # ``seen``: masses up to and including this place, so a mass sits at seen - 1.
    placed = global_running_sum(m.unionByName(p), ["v", "is_point"], 1 - F.col("is_point"), "seen")
    left = placed.filter("is_point = 1").select(F.col("v").alias("__obs"), (F.col("seen") - k).alias("__lo"),
                                                (F.col("seen") + k - 1).alias("__hi"))
    right = placed.filter("is_point = 0").select(F.col("v").alias("__mass"), "n", (F.col("seen") - 1).alias("mpos"))
    near = range_join(left, right, "__lo", "__hi", "mpos", float(block)) \
        .withColumn("__d", F.abs(F.col("__mass") - F.col("__obs")))
    w = W.partitionBy("__obs").orderBy("__d", "__mass").rowsBetween(W.unboundedPreceding, -1)
    return (near.withColumn("__before", F.coalesce(F.sum("n").over(w), F.lit(0)))
            .filter(F.col("__before") < k)
            .select(F.col("__obs").alias(obs), F.col("__mass").alias(mass),
                    F.least(F.lit(k) - F.col("__before"), F.col("n")).alias("need")))


def nearest_k(queries: DataFrame, catalog: DataFrame, k: int = fixed.NEAREST_FALLBACK, obs: str = "obs",
              mass: str = "mass", order: list[str] | None = None) -> DataFrame:
    """The k catalogue rows nearest in mass; ties follow catalogue order (mass, then ``order``).

    Work is per distinct observation and distinct mass, so repeated queries or a
    mass shared by a large part of the catalogue add no pairs.
    """
    order = order or ["structure_key", "structure_id"]
    masses = catalog.groupBy(mass).agg(F.count(F.lit(1)).alias("n"))
    near = nearest_masses(queries.select(obs).distinct(), masses, k, obs, mass)
    first = catalog.withColumn("__rn", F.row_number().over(W.partitionBy(mass).orderBy(*order))) \
        .filter(F.col("__rn") <= k)
    rows = near.join(first, mass).filter(F.col("__rn") <= F.col("need")).drop("__rn", "need")
    return queries.join(rows, obs)


def candidate_tiers(queries: DataFrame, catalog: DataFrame, obs: str = "obs", mass: str = "mass",
                    tight: tuple[float, float] = fixed.CANDIDATE_TOLERANCE,
                    wide: tuple[float, float] = fixed.EXPANDED_TOLERANCE) -> DataFrame:
    """Each distinct observation with its tier: 1 tight window, 2 wide window, 3 nearest.

    Decided on distinct masses alone, before any candidate row is produced.
    """
    points = queries.select(obs).distinct()
    near = mass_candidates(points, catalog.select(mass).distinct(), obs, mass, *wide)
    inside = F.abs(F.col(mass) - F.col(obs)) <= tolerance(obs, *tight)
    tier = near.groupBy(obs).agg(F.min(F.when(inside, 1).otherwise(2)).alias("tier"))
    return points.join(tier, obs, "left").withColumn("tier", F.coalesce("tier", F.lit(3)))


MODES = {1: "mass_compatible", 2: "expanded_mass_window", 3: "nearest_mass_no_compatible_structure"}


def tiered_candidates(queries: DataFrame, catalog: DataFrame, k: int = fixed.NEAREST_FALLBACK, obs: str = "obs",
                      mass: str = "mass", order: list[str] | None = None,
                      tight: tuple[float, float] = fixed.CANDIDATE_TOLERANCE,
                      wide: tuple[float, float] = fixed.EXPANDED_TOLERANCE) -> DataFrame:
    """Candidates from the first non-empty tier, with the tier's name in ``mode``."""
    # One small row per distinct observation, used by both branches below.
    tiers = durable(candidate_tiers(queries, catalog, obs, mass, tight, wide))
    tol = F.when(F.col("tier") == 1, tolerance(obs, *tight)).otherwise(tolerance(obs, *wide))
    window = tiers.filter("tier < 3").withColumn("__lo", F.col(obs) - tol).withColumn("__hi", F.col(obs) + tol)
    width = max(2 * wide[1], 2 * 1000 * wide[0] * 1e-6)
    hit = range_join(window, catalog, "__lo", "__hi", mass, width).drop("__lo", "__hi")
    miss = nearest_k(tiers.filter("tier = 3"), catalog, k, obs, mass, order)
    mode = F.when(F.col("tier") == 1, MODES[1]).when(F.col("tier") == 2, MODES[2]).otherwise(MODES[3])
    rows = hit.unionByName(miss).withColumn("mode", mode)
    return queries.join(rows, obs)


def group_windows(spectra: DataFrame, group: str = "molecule_id", neutral: str = "neutral",
                  ppm: float = 20.0, da: float = 0.005) -> DataFrame:
    """Strict window shared by all spectra of a group, tolerance from the group median."""
    from massloom.operators.quantiles import group_median

    med = group_median(spectra, [group], neutral, "center")
    ends = spectra.groupBy(group).agg(F.min(neutral).alias("lowest"), F.max(neutral).alias("highest"))
    tol = tolerance("center", ppm, da)
    return ends.join(med, group).select(
        group, "center", tol.alias("tol"), (F.col("highest") - tol).alias("lo"), (F.col("lowest") + tol).alias("hi"),
        (F.greatest(F.col("highest") - F.col("center"), F.col("center") - F.col("lowest")) <= tol).alias("consistent"))


def nearest_error(values: DataFrame, masses: DataFrame, value: str, mass: str) -> DataFrame:
    """Smallest |value - mass| for each value row, however far it is; null only where there is no mass at all."""
    own = masses.select(F.col(mass).alias("__mass")).filter("__mass is not null").distinct().withColumn("__n", F.lit(1).cast("bigint"))
    near = nearest_masses(values.select(value).filter(F.col(value).isNotNull()), own, 1, value, "__mass", "__n")
    return values.join(near.select(value, F.abs(F.col(value) - F.col("__mass")).alias("error")), value, "left")


def max_in_window(peaks: DataFrame, hypotheses: DataFrame, key: list[str], mass: str, tol: str, width: float,
                  hyp_mass: str = "hyp_mass", hyp_value: str = "hyp_value", out: str = "best",
                  peak_key: list[str] | None = None) -> DataFrame:
    """Largest hypothesis value within +-tol of each peak, 0 when there is none."""
    p = peaks.withColumn("__lo", F.col(mass) - F.col(tol)).withColumn("__hi", F.col(mass) + F.col(tol))
    ids = [*key, *(peak_key or []), mass]
    best = range_join(p, hypotheses, "__lo", "__hi", hyp_mass, width, key) \
        .groupBy(*ids).agg(F.max(hyp_value).alias(out))
    return peaks.join(best, ids, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))
