"""Groups of copies whose members don't all link: chains, bases, sub-bases, insertions and cuts."""
import random

import numpy as np
import pytest

from massloom.llm.jaccard import _cell_bounds, _cells, ngram_jaccard_join

WORDS = [f"{a}{b}" for a in "bcdfghjklm" for b in ("a", "e", "io", "ou")]


def varied(r, words, edits):
    w = list(words)
    for _ in range(edits):
        k = r.randrange(len(w))
        kind = r.randrange(3)
        if kind == 0:
            w[k] = f"new{r.randrange(10**6)}"
        elif kind == 1:
            w.insert(k, r.choice(WORDS))
        elif len(w) > 8:
            del w[k]
    return w


def corpus(seed):
    r = random.Random(seed)
    texts = []
    for size in (90, 40, 150):
        base = [r.choice(WORDS) for _ in range(size)]
        texts += [varied(r, base, r.randrange(6)) for _ in range(70)]
        other = varied(r, base, size // 14)
        texts += [varied(r, other, r.randrange(5)) for _ in range(40)]
        chain = base
        for _ in range(15):
            chain = varied(r, chain, 2)
            texts.append(chain)
        texts += [base[:int(size * f)] for f in (0.6, 0.75, 0.81, 0.9)] + [base + [r.choice(WORDS) for _ in range(int(size * f))] for f in (0.1, 0.2, 0.3)]
    passage = [r.choice(WORDS) for _ in range(30)]
    texts += [[r.choice(WORDS) for _ in range(r.randrange(4, 30))] + passage for _ in range(40)]
    r.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(rows))}


@pytest.mark.parametrize("percent", [40, 50, 60])
def test_low_percents_equal_brute_force(spark, percent):
    """Links that share less than three quarters of a set."""
    texts = []
    for k, (own, both) in enumerate([(30, 70), (40, 60), (20, 80), (45, 55), (55, 45), (10, 90)]):
        shared = [f"s{k}x{i}" for i in range(both + 4)]
        texts += [shared + [f"a{k}x{i}" for i in range(own)], [f"b{k}x{i}" for i in range(own)] + shared]
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    linked = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    want = {i: min(j for j in range(len(sets)) if linked(sets[i], sets[j])) for i in range(len(sets))}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_jaccard_join(docs, percent=percent).collect()} == want


def test_long_chance_pairs_end_at_their_bit_maps(spark):
    """Unrelated long sets have a bound below three quarters, as short ones have; no bound is below the overlap."""
    r = np.random.default_rng(3)
    made, truth = {}, {}
    for i, (n, shared) in enumerate([(30, 9), (700, 100), (5000, 0), (5000, 4500), (30_000, 600), (41_000, 0)]):
        common = r.integers(0, 2**64, shared, np.uint64)
        for side in (0, 1):
            own = r.integers(0, 2**64, n - shared + side * (n // 4), np.uint64)
            made[2 * i + side] = np.unique(np.concatenate([common, own]))
        truth[2 * i] = shared
    sets = spark.createDataFrame([(i, len(s), i, 0, _cells(s)) for i, s in made.items()], "doc_id long, n long, k1 long, k2 long, cells binary")
    pairs = spark.createDataFrame([(i, len(made[i]), i + 1, len(made[i + 1])) for i in truth], "x long, n int, p long, np int")
    got = {row["x"]: (row["n"], row["m"]) for row in _cell_bounds(pairs, sets).collect()}
    assert all(got[i][1] >= o for i, o in truth.items())
    assert [100 * m < 75 * n for n, m in (got[i] for i in sorted(truth))] == [True, True, True, False, True, False]
