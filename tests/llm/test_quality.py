"""Base counts by brute force; fitted models by held-out rows."""
import random
import re
from collections import Counter

import pytest

from massloom.llm import cotraining, line_crf

WORDS = [a + b for a in ("th", "on", "er", "st", "ha") for b in ("en", "ing", "ou", "re", "at", "ion")]


def clean(r, lines=8):
    return "\n".join(" ".join(r.choice(WORDS) for _ in range(r.randint(12, 25))).capitalize() + "." for _ in range(lines))


def junk(r):
    kind = r.randint(0, 2)
    words = clean(r, 6).split(" ")
    if kind == 0:
        return "Some first line here.\n" + " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return "Some first line here.\n" + " | ".join(words)
    return " ".join(w + r.choice(["###", "$$$", "&&&"]) for w in words)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    rows = [(i, junk(r) if i % 4 == 0 else clean(r), "en", f"src{i % 3}", "x") for i in range(400)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (3, None, 0)]
    labels += [(i, 1, 0) for i in range(1, 200, 4)]
    odd = [(1000, None, None, None, "x"), (1001, "", "", "", "x"), (1002, "a b c a b c a b c", "en", "s", "x"), (1003, "one\none\n\n \nONE\none two\n", "en", "s", "x"),
           (1004, "é " * 60, "en", "s", "x"), (1005, "#a *b* <c>|d &$%", "en", "s", "x"), (1006, clean(r, 400), "en", "s", "x"), (None, clean(r), "en", "s", "x"), (1, rows[1][1], "en", "src1", "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, kept string").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows + odd


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_line_field(corpus):
    docs, labels, rows = corpus
    got = line_crf.judge(docs, line_crf.train(docs, labels)).collect()
    want = sorted((str(r[0]), *base(r[1])) for r in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    kept = {r.doc_id: r.kept for r in got}
    wrong = [i for i in range(400) if i % 2 and not base(rows[i][1])[-1] and kept[i] != (i % 4 != 0)]
    assert len(wrong) <= 2
    assert not any(r.kept for r in got if r.base_failed)


def test_viterbi_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    f = line_crf.Field(rng.standard_normal(line_crf.FEATURES), rng.standard_normal((2, 2)))
    lengths = np.array([3, 0, 5, 1])
    x = rng.standard_normal((9, line_crf.FEATURES))
    got, at = f.decode(x, lengths), 0
    for n in lengths.tolist():
        e = f.emissions(x[at:at + n])
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: sum(e[i, k] for i, k in enumerate(y)) + sum(f.transitions[a, b] for a, b in zip(y, y[1:])))
        assert tuple(got[at:at + n]) == best
        at += n


def test_gradient_equals_differences():
    import numpy as np

    rng = np.random.default_rng(3)
    f = line_crf.Field(rng.standard_normal(line_crf.FEATURES), rng.standard_normal((2, 2)))
    lengths, x, y = np.array([2, 3]), rng.standard_normal((5, line_crf.FEATURES)), np.array([0, 1, 1, 0, 1])

    def loglik(w, t):
        import itertools

        total, at = 0.0, 0
        for n in lengths.tolist():
            e = np.stack([np.zeros(n), x[at:at + n] @ w], axis=1)
            score = lambda s: sum(e[i, k] for i, k in enumerate(s)) + sum(t[a, b] for a, b in zip(s, s[1:]))  # noqa: B023, E731
            total += score(y[at:at + n]) - np.log(sum(np.exp(score(s)) for s in itertools.product((0, 1), repeat=n)))
            at += n
        return total

    gw, gt = f.gradient(x, y, lengths)
    for i in range(line_crf.FEATURES):
        d = np.eye(line_crf.FEATURES)[i] * 1e-5
        assert abs((loglik(f.weights + d, f.transitions) - loglik(f.weights - d, f.transitions)) / 2e-5 - gw[i]) < 1e-6
    d = np.array([[0, 1e-5], [0, 0]])
    assert abs((loglik(f.weights, f.transitions + d) - loglik(f.weights, f.transitions - d)) / 2e-5 - gt[0, 1]) < 1e-6


def test_co_training(corpus):
    docs, labels, rows = corpus
    model = cotraining.train(docs, labels, per_class=100)
    got = cotraining.score(docs, model, keep=["doc_id", "kept", "source"].copy()[:1]).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert sum(kept[i] != (i % 4 != 0) for i in range(400)) <= 4
    assert all(0 <= r.text_score <= 1 and 0 <= r.meta_score <= 1 and 0 <= r.score <= 1 for r in got)


def test_every_other_document_hands_over(spark, corpus):
    """Sums over tasks equal those of all documents at once, repeated rows and null ids included."""
    import numpy as np

    docs, _, rows = corpus
    rng = np.random.default_rng(1)
    views = {"text": cotraining.View(rng.standard_normal(cotraining.GRAMS + cotraining.STATS), 0.1), "meta": cotraining.View(rng.standard_normal(cotraining.META), -0.2, 2.0, 0.1)}
    got: dict = {}
    picked = docs.select(*cotraining._inputs(docs, "doc_id", "text", "lang", "source"))
    for view, y, n, slope, curve in cotraining._others(picked)(views, 0.6):
        old = got.get((view, y), (0, 0, 0))
        got[view, y] = (old[0] + n, old[1] + slope, old[2] + curve)
    import pyarrow as pa

    texts = pa.array([r[1] for r in rows])
    text, meta = cotraining.text_view(texts), cotraining.metadata_view([r[2] for r in rows], [r[3] for r in rows], np.array([len((r[1] or "").encode()) for r in rows]))
    want = {(v, y): (n, s, c) for v, y, n, s, c in cotraining.hand_over(text, meta, views, 0.6)}
    assert want.keys() == got.keys() and len(want) == 4
    for k, (n, slope, curve) in want.items():
        assert got[k][0] == n
        np.testing.assert_allclose(got[k][1], slope, rtol=1e-6, atol=1e-6)
        np.testing.assert_allclose(got[k][2], curve, rtol=1e-6, atol=1e-6)


def test_curvature_is_the_derivative_of_the_gradient():
    import numpy as np

    rng = np.random.default_rng(4)
    text, meta = rng.standard_normal((30, 6)).astype(np.float32), rng.standard_normal((30, 5)).astype(np.float32)
    views = {"text": cotraining.View(rng.standard_normal(6), 0.0), "meta": cotraining.View(rng.standard_normal(5), 0.3)}
    for name, y, _, slope, curve in cotraining.hand_over(text, meta, views, 0.7):
        for i in range(len(slope) - 1):
            moved = cotraining.View(views[name].weights + 1e-5 * (np.arange(len(slope) - 1) == i), views[name].bias)
            # Only the receiving view moves: what is handed over stays the same.
            other = [s for v, c, _, s, _ in cotraining.hand_over(text, meta, {**views, name: moved}, 0.7) if (v, c) == (name, y)]
            assert abs((other[0][i] - slope[i]) / 1e-5 - curve[i]) < 1e-3


def test_without_labels_nothing_is_rejected(spark, corpus):
    docs, labels, _ = corpus
    none = labels.where("false")
    assert cotraining.train(docs, none) is None
    assert cotraining.score(docs, None).where("not kept").count() == 0
    judged = line_crf.judge(docs, line_crf.train(docs, none))
    assert judged.where("kept = base_failed").count() == 0
    assert line_crf.judge(docs.where("false"), line_crf.Field.neutral()).count() == 0
    assert cotraining.score(docs.where("false"), None).count() == 0
