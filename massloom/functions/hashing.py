"""SHA-256 draws: the same number in every engine, whatever the row order."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from massloom.functions.numeric import col


def salted(salt: str, key: Column | str) -> Column:
    return F.sha2(F.concat(F.lit(salt), col(key).cast("string")), 256)


def hash_mod(salt: str, key: Column | str, modulus: int) -> Column:
    """First 8 digest bytes, big-endian and unsigned, modulo ``modulus``."""
    word = F.conv(F.substring(salted(salt, key), 1, 16), 16, 10).cast("decimal(20,0)")
    return (word % F.lit(modulus).cast("decimal(20,0)")).cast("int")


def is_holdout(key: Column | str, salt: str, modulus: int = 10) -> Column:
    return hash_mod(salt, key, modulus) == 0


def draw(text: Column, n: Column) -> Column:
    """Uniform integer in [0, n) from 60 digest bits."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint") % n).cast("bigint")
