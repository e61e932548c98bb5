"""Leak-free splits, samples and set comparisons."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.functions.hashing import salted
from massloom.operators.ordering import hash_rank


def hash_sample(keys: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    """The n keys lowest in digest order; a pool that is too small fails instead of shrinking the sample.

    ``limit`` after ``orderBy`` is a distributed top-n: each task keeps its own
    lowest n.
    """
    picked = keys.select(key).distinct().withColumn("digest", salted(salt, key)).orderBy("digest").limit(n)
    size = picked.agg(F.count(F.lit(1))).scalar()
    enough = F.when(size == n, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"pool has fewer than {n} keys")).cast("boolean"))
    return picked.filter(enough)


def role_partition(keys: DataFrame, key: str, salt: str, sizes: dict[str, int], excluded: DataFrame | None = None) -> DataFrame:
    """Disjoint role slices of one digest order, after removing excluded keys."""
    pool = keys.select(key).distinct()
    if excluded is not None:
        pool = pool.join(excluded.select(key).distinct(), key, "left_anti")
    wanted = sum(sizes.values())
    first = hash_sample(pool, key, salt, wanted)
    ranked = hash_rank(first, "digest")
    role, start = F.lit(None).cast("string"), 0
    for name, n in sizes.items():
        role = F.when(F.col("pos").between(start, start + n - 1), name).otherwise(role)
        start += n
    return ranked.select(key, role.alias("role"), "pos")


def forced_calibration(keys: DataFrame, key: str, used: DataFrame, salt: str, size: int) -> DataFrame:
    """Previously examined keys go to calibration first; digest order fills the rest."""
    pool = keys.select(key).distinct().join(
        used.select(key).distinct().withColumn("__used", F.lit(True)), key, "left")
    order = F.concat(F.when(F.col("__used"), "0").otherwise("1"), salted(salt, key))
    # Digest buckets stay even because the flag only adds one leading digit.
    ranked = hash_rank(pool.withColumn("__digest", order), "__digest")
    return ranked.select(key, F.when(F.col("pos") < size, "calibration").otherwise("audit").alias("role"),
                         F.coalesce("__used", F.lit(False)).alias("previously_used"))


def acquisition_split(spectra: DataFrame, molecule: str, signature: str, source: str, condition: str, salt: str) -> DataFrame:
    """Splits each molecule's distinct spectra into query and reference acquisitions.

    By source when a molecule has two or more, else by condition, else by the
    lower half of its signatures. One hashed group becomes the query side.
    Molecules with a single distinct spectrum are left out.
    """
    d = spectra.groupBy(molecule, signature).agg(
        F.min(F.struct(source, condition)).alias("__a")).select(
        molecule, signature, F.col(f"__a.{source}").alias(source), F.col(f"__a.{condition}").alias(condition))
    stats = d.groupBy(molecule).agg(
        F.count(F.lit(1)).alias("__n"), F.min(source) .alias("__s0"), F.max(source).alias("__s1"),
        F.min(condition).alias("__c0"), F.max(condition).alias("__c1"),
        F.min(F.struct(salted(salt, F.col(source)), F.col(source))).alias("__ps"),
        F.min(F.struct(salted(salt, F.col(condition)), F.col(condition))).alias("__pc")).filter("__n >= 2")
    j = d.join(stats, molecule)
    by_source, by_condition = F.col("__s0") != F.col("__s1"), F.col("__c0") != F.col("__c1")
    unit = F.when(by_source, "source_instrument").when(by_condition, "adduct_energy").otherwise("distinct_normalized_spectrum")
    # Only molecules that need the last rule pay for ordering their signatures.
    half = hash_rank(j.filter(~by_source & ~by_condition).select(molecule, signature, "__n"), signature, "__i", [molecule])
    lower = half.filter(F.col("__i") < F.greatest(F.floor(F.col("__n") / 2), F.lit(1))).select(
        molecule, signature, F.lit(True).alias("__low"))
    is_query = F.when(by_source, F.col(source) == F.col(f"__ps.{source}")) \
        .when(by_condition, F.col(condition) == F.col(f"__pc.{condition}")) \
        .otherwise(F.coalesce("__low", F.lit(False)))
    return j.join(lower, [molecule, signature], "left").select(
        molecule, signature, unit.alias("unit"), F.when(is_query, "query").otherwise("reference").alias("side"))


def hashed_choice(df: DataFrame, key: str, option: str, seed: str) -> DataFrame:
    """One option per key: the lowest digest of seed, key and option."""
    digest = F.sha2(F.concat(F.lit(seed + ":source:"), F.col(key).cast("string"), F.lit(":"), F.col(option)), 256)
    return df.select(key, option).distinct().groupBy(key).agg(F.min_by(option, digest).alias(option))


def role_overlaps(roles: DataFrame, key: str, role: str = "role") -> DataFrame:
    """Number of keys present in each pair of roles (no row when a pair is disjoint)."""
    per_key = roles.groupBy(key).agg(F.array_sort(F.collect_set(role)).alias("r")).filter(F.size("r") > 1)
    pairs = F.flatten(F.transform("r", lambda a, i: F.transform(
        F.filter("r", lambda b: b > a), lambda b: F.concat(a, F.lit("&"), b))))
    return per_key.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("keys"))


def id_set_report(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Each id that is missing, extra or duplicated, with its kind and count."""
    e = expected.groupBy(key).agg(F.count(F.lit(1)).alias("e"))
    a = actual.groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    j = e.join(a, key, "full_outer").fillna(0, ["e", "a"])
    kind = F.when(F.col("a") == 0, "missing").when(F.col("e") == 0, "extra").when(F.col("a") > 1, "duplicate")
    return j.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(key, "kind", F.col("a").alias("times"))


def result_differences(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """Rows on one side only, counted as multisets; empty means the results are equivalent."""
    l = left.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(1))
    r = right.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(-1))
    return l.unionByName(r).groupBy(*fields).agg(F.sum(F.col("n") * F.col("side")).alias("surplus")) \
        .filter(F.col("surplus") != 0)


def regimes(candidates: DataFrame, names: list[str]) -> DataFrame:
    """Each candidate row once per regime (a literal handful)."""
    return candidates.withColumn("regime", F.explode(F.array(*[F.lit(n) for n in names])))
