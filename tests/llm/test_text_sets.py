"""Near duplicates, repeated strings and components against brute force."""
import hashlib
import re

import pytest

from massloom.llm.components import components
from massloom.llm.jaccard import ngram_jaccard_join
from massloom.llm.suffix_dedup import COVER, PERIOD, suffix_dedup

BASE = " ".join(f"word{i}" for i in range(60))


def passage(seed: int, n: int) -> str:
    return "".join(hashlib.sha256(f"{seed}/{i}".encode()).hexdigest()[:6] + " " for i in range(n))


def fixture_rows():
    shared = passage(1, 40)
    long = passage(2, 3000)
    rows = [(0, BASE), (1, BASE), (2, BASE.upper()), (3, BASE + " one more"), (4, None), (5, ""), (6, " \n\t "), (7, "three little words"),
            (8, "Three  little\nwords"), (9, long), (10, long[:9000] + "changed" + long[9000:]), (11, passage(3, 30) + shared + passage(4, 30)),
            (12, passage(5, 30) + shared + passage(6, 30)), (13, shared), (14, "a" * 500), (15, "é" * 300), (16, "x" + "é" * 300),
            (None, BASE), (None, "only here " * 3)]
    rows += [(20 + i, " ".join(f"word{j}" if j != i else f"other{i}" for j in range(60))) for i in range(40)]
    return rows + [(1, BASE)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1, b"x") for i, t in fixture_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, n int, tokens binary").repartition(3)


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_components_equal_brute_force(docs):
    rows = fixture_rows()
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    lowest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            lowest[find(k)] = min(i, lowest.get(find(k), i))
    want = sorted((str(i), len(s), str(lowest.get(find(k), i))) for k, ((i, _), s) in enumerate(zip(rows, sets)))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_jaccard_join(docs).collect())
    assert got == want


def removed(rows):
    """Marks by definition: a window that an earlier (id, start) shows too."""
    seen, out = set(), []
    order = sorted(rows, key=lambda r: -2**63 if r[0] is None else r[0])
    for i, text in order:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(b[p:p + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((str(i), len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup_equals_brute_force(spark, docs):
    got = suffix_dedup(docs, keep=["block", "n"])
    assert got.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "block", "n"]
    # Ids decide; rows without one come first, in scan order, so only their sums are compared.
    rows = got.collect()
    named = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    want = removed(fixture_rows())
    assert named == want
    assert {r.block for r in rows} == {"clash"}


def test_operators_on_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard_join(none).collect() == []
    assert suffix_dedup(none).collect() == []


def test_cover_reaches_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_components_of_chains_hubs_and_cycles(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 400)] + [(500, 501), (501, 502), (502, 500), (502, 502)]
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 400)}, 500: 500, 501: 500, 502: 500}
