"""SQL fragments shared by the twins."""
from __future__ import annotations


def greedy(a: str, b: str, da: float, ppm: float = 20.0, tie: str = "low") -> str:
    """Greedy assignment total of two peak lists, as one list_reduce."""
    sign = "-" if tie == "high" else ""
    edges = (
        f"list_sort(flatten(list_transform(range(1, len({a}) + 1), lambda i: list_transform(list_filter("
        f"range(1, len({b}) + 1), lambda j: abs({a}[i].mz - {b}[j].mz) <= greatest({da}, {a}[i].mz * {ppm} * 1e-6)), "
        f"lambda j: {{'w': -(sqrt({a}[i].i) * sqrt({b}[j].i)), 'i': {sign}i, 'j': {sign}j}}))))")
    return (
        f"list_reduce({edges}, lambda acc, x: CASE WHEN list_contains(acc.ui, x.i) OR list_contains(acc.uj, x.j) THEN acc "
        "ELSE {'t': acc.t - x.w, 'ui': list_append(acc.ui, x.i), 'uj': list_append(acc.uj, x.j)} END, "
        "{'t': 0.0::DOUBLE, 'ui': []::BIGINT[], 'uj': []::BIGINT[]}).t")


def mass(p: str) -> str:
    return f"list_sum(list_transform({p}, lambda y: y.i))"


def cosine(a: str, b: str, da: float, tie: str = "low") -> str:
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE least(1.0, greatest(0.0, "
            f"{greedy(a, b, da, tie=tie)} / (sqrt({mass(a)}) * sqrt({mass(b)})))) END")


def below(p: str, prec: str, margin: float) -> str:
    return f"list_filter({p}, lambda y: y.mz < {prec} - {margin})"


def losses(p: str, prec: str) -> str:
    return f"list_sort(list_transform({p}, lambda y: {{'mz': {prec} - y.mz, 'i': y.i}}))"


def forward(a: str, b: str, da: float, ppm: float = 20.0) -> str:
    """Struct(c, e, v, m): cosine, entropy, coverage, matches of cleaned lists."""
    edges = (
        f"list_sort(flatten(list_transform(range(1, len({a}) + 1), lambda i: list_transform(list_filter("
        f"range(1, len({b}) + 1), lambda j: abs({a}[i].mz - {b}[j].mz) <= greatest({da}, {a}[i].mz * {ppm} * 1e-6)), "
        f"lambda j: {{'w': -sqrt({a}[i].i * {b}[j].i), 'd': abs({a}[i].mz - {b}[j].mz), 'i': i, 'j': j, "
        f"'p': {a}[i].i, 'q': {b}[j].i}}))))")
    return (
        f"list_reduce({edges}, lambda acc, x: CASE WHEN list_contains(acc.ui, x.i) OR list_contains(acc.uj, x.j) THEN acc "
        "ELSE {'c': acc.c - x.w, 'e': acc.e + ((x.p + x.q) * ln(x.p + x.q) - x.p * ln(x.p) - x.q * ln(x.q)) / (2 * ln(2.0)), "
        "'v': acc.v + x.p, 'm': acc.m + 1, 'ui': list_append(acc.ui, x.i), 'uj': list_append(acc.uj, x.j)} END, "
        "{'c': 0.0::DOUBLE, 'e': 0.0::DOUBLE, 'v': 0.0::DOUBLE, 'm': 0::INTEGER, 'ui': []::BIGINT[], 'uj': []::BIGINT[]})")


def hash60(text: str) -> str:
    return f"('0x' || substr(sha256({text}), 1, 15))::BIGINT"


def hash_mod(salt: str, key: str, m: int) -> str:
    return f"(('0x' || substr(sha256('{salt}' || {key}), 1, 16))::UBIGINT % {m})::INTEGER"
