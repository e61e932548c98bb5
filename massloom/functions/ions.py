"""Adduct and formula arithmetic as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom import fixed
from massloom.functions.numeric import col, finite

_ION = r"^\[(\d*)M((?:[+-].*)?)\](\d*)([+-])$"
_TERM = r"([+-]\d*[A-Za-z][A-Za-z0-9]*)"
_ATOM = r"([A-Z][a-z]?\d*)"


def adduct_table(spark: SparkSession) -> DataFrame:
    """The verified ion conventions (a fixed handful of rows)."""
    rows = [(a, n, z, s) for a, (n, z, s) in fixed.ADDUCTS.items()]
    return spark.createDataFrame(rows, "adduct string, n int, z int, shift double").coalesce(1)


def normalise_adduct(adduct: Column | str) -> Column:
    """Blanks removed, typographic minus replaced."""
    return F.translate(col(adduct), "− ", "-")


def _element_masses() -> Column:
    return F.create_map(*[x for e, m in fixed.ELEMENT_MASS.items() for x in (F.lit(e), F.lit(m))])


def _number(text: Column) -> Column:
    return F.when(text == "", F.lit(1)).otherwise(text.cast("int"))


def formula_mass(formula: Column | str) -> Column:
    """Sum of element mass times count; null when the text is not a formula."""
    f = col(formula)
    atoms = F.regexp_extract_all(f, F.lit(_ATOM), F.lit(1))
    mass = F.aggregate(
        atoms, F.lit(0.0),
        lambda acc, a: acc + F.try_element_at(_element_masses(), F.regexp_extract(a, r"^([A-Za-z]+)", 1))
        * _number(F.regexp_extract(a, r"(\d*)$", 1)))
    return F.when((f != "") & (F.array_join(atoms, "") == f), mass)


def ion_columns(adduct: Column | str) -> Column:
    """Struct (n, z, shift); shift is null for text that is not fully understood."""
    s = normalise_adduct(adduct)
    body = F.regexp_extract(s, _ION, 2)
    n = _number(F.regexp_extract(s, _ION, 1))
    z = _number(F.regexp_extract(s, _ION, 3)) * F.when(F.regexp_extract(s, _ION, 4) == "+", 1).otherwise(-1)
    terms = F.regexp_extract_all(body, F.lit(_TERM), F.lit(1))

    def term_mass(t: Column) -> Column:
        sign = F.when(F.substring(t, 1, 1) == "+", 1).otherwise(-1)
        count = _number(F.regexp_extract(t, r"^[+-](\d*)", 1))
        return sign * count * formula_mass(F.regexp_extract(t, r"^[+-]\d*(.*)$", 1))

    shift = F.aggregate(terms, -z * F.lit(fixed.ELECTRON), lambda acc, t: acc + term_mass(t))
    known = s.rlike(_ION) & (F.array_join(terms, "") == body) & n.between(1, 5) & (F.abs(z) <= 5)
    return F.struct(n.alias("n"), z.alias("z"), F.when(known, shift).alias("shift"))


def build_adduct_table(df: DataFrame, column: str = "adduct") -> DataFrame:
    """One parsed row per distinct adduct text; ``valid`` is false for unknown aliases."""
    return (df.select(F.col(column).alias("adduct")).distinct()
            .withColumn("ion", ion_columns("adduct"))
            .select("adduct", "ion.n", "ion.z", "ion.shift", F.col("ion.shift").isNotNull().alias("valid")))


def neutral_mass(mz: Column | str, n: Column | str, z: Column | str, shift: Column | str) -> Column:
    """(m/z * |z| - shift) / n, null unless finite and positive."""
    m = (col(mz) * F.abs(col(z)) - col(shift)) / col(n)
    return F.when(finite(m) & (m > 0), m)


def with_neutral_mass(df: DataFrame, adducts: DataFrame, how: str = "inner") -> DataFrame:
    """Adds n, z and neutral. ``adducts`` has one row per convention, never per spectrum."""
    return (df.join(F.broadcast(adducts), "adduct", how)
            .withColumn("neutral", neutral_mass("precursor_mz", "n", "z", "shift")).drop("shift"))
