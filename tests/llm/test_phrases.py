"""Collocations against plain Python: ties, hot words, clashing columns, nulls, runs."""
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from massloom.llm import phrases as ph

WORDS = ["Der", "the", "lamp", "été", "ÉTÉ", "#1", "a-b", "日本", "x\x00y", "new", "York", "city"]


def sentence(r, n):
    made = []
    for _ in range(n):
        made.append("new York city" if r.random() < 0.05 else r.choice(WORDS[:4] if r.random() < 0.7 else WORDS))
        made.append(r.choice([" ", " ", " ", "  ", "\t ", ". ", ",", "\n", "\x0b", " "]))
    return "".join(made)


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counts(rows):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, " ".join(w[i:i + k])) for i in range(len(w) - k + 1))
    return f, n


def report(rows, support, top):
    f, n = counts(rows)
    f = {k: v for k, v in f.items() if v >= support}
    found = {}
    for (lang, p), a in f.items():
        w = p.split(" ")
        cuts = []
        for k in range(1, len(w)):
            l, r = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((1000000 * a * a // (l * r), k, l, r))
        longer = [b for (m, q), b in f.items() if m == lang and len(q.split(" ")) > len(w) and f" {p} " in f" {q} "]
        if cuts and not any(100 * b >= 50 * a for b in longer):
            found.setdefault(lang, []).append((min(cuts), p, a))
    out = []
    for lang, items in found.items():
        items.sort(key=lambda x: (-x[0][0], -x[2], x[1].encode()))
        out += [(lang, i + 1, p, a, cut[2], cut[3], n[lang], cut[0]) for i, (cut, p, a) in enumerate(items[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    made = [(i, sentence(r, r.randint(0, 60)), r.choice(["en", "de", None])) for i in range(150)]
    made += [(3, "a lone phrase", "fr")] * 40  # repeated rows of one key
    return made + [(None, sentence(r, 50), "en"), (None, None, "en"), (900, "", None), (901, ". , ;\n", "xx"), (902, sentence(r, 3000), "de")]


@pytest.mark.parametrize("support,top", [(10, 2000), (3, 5), (100000, 5)])
def test_report_equals_plain_python(spark, rows, support, top):
    docs = spark.createDataFrame([(*x, "c", 1, 1) for x in rows], "doc_id long, text string, lang string, phrase string, n int, shard int").repartition(5)
    got = ph.collocations(ph.frequent_phrases(docs, support=support), top=top).collect()
    assert sorted(map(tuple, got)) == report(rows, support, top)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert ph.collocations(ph.frequent_phrases(docs)).collect() == []


def test_runs_and_batches_count_every_phrase_once(rows, monkeypatch):
    monkeypatch.setattr(ph, "RUN", 5)
    monkeypatch.setattr(ph, "BATCH_BYTES", 300)
    every = SimpleNamespace(value=np.full(1 << (ph.MAP_BITS - 3), 255, np.uint8))
    table = pa.RecordBatch.from_pydict({"text": [t for _, t, _ in rows], "lang": [x or "und" for _, _, x in rows]})
    got, words = Counter(), Counter()
    for b in ph._count(3, every)([table]):
        for lang, p, k, n in zip(*(c.to_pylist() for c in b.columns)):
            if k:
                assert len(p.split(" ")) == k
                got[lang, p] += n
            else:
                words[lang] += n
    want, total = counts(rows)
    assert got == want and +words == +total


def test_exact_beyond_64_bits(spark):
    big = 3 * 10**12
    table = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 7), ("en", None, 0, 9 * big)], "lang string, phrase string, words int, n long")
    assert [tuple(r) for r in ph.collocations(table).collect()] == [("en", 1, "a b", big, big + 1, big + 7, 9 * big, 1000000 * big * big // ((big + 1) * (big + 7)))]
