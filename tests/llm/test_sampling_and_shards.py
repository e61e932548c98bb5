"""Importance resampling and the bounded ring against plain Python, on awkward tables."""
import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from massloom.llm import importance as imp
from massloom.llm.arrays import text_buffer
from massloom.llm.bounded_ring import assigned, bounded_ring

WORDS = ["The", "of", "straße", "été", "Zebra", "x1", "9", "loom", "mass", "日本"]


def text(r, n):
    return "".join(r.choice(WORDS) + r.choice([" ", ", ", "\x00", "-\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    made = [(i, text(r, r.randint(0, 60))) for i in range(300)]
    made += [(7, made[7][1])] * 100 + [(500, None), (501, ""), (502, " .-"), (503, text(r, 9000)), (None, text(r, 30)), (None, None)]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns bear names that the operators use inside.
    return spark.createDataFrame([(*x, 1, "b", 2.0) for x in rows], "doc_id long, text string, row int, shard string, weight double").repartition(4)


def grams(t, longest):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "").encode())
    return len(w), [b" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_ngrams_stay_inside_documents_across_runs(rows, monkeypatch, longest):
    monkeypatch.setattr(imp, "RUN", 7)
    texts = [t for _, t in rows]
    got = [Counter() for _ in texts]
    for doc, crc in imp.ngram_runs(*text_buffer(pa.array(texts)), longest):
        for d, c in zip(doc.tolist(), crc.tolist()):
            got[d][c] += 1
    assert got == [Counter(map(crc32, grams(t, longest)[1])) for t in texts]


def test_resampling_equals_plain_python(spark, rows, docs):
    target = ["the zebra of", "loom mass loom", None, ""]
    made = imp.resample(imp.importance(docs, spark.createDataFrame([(t,) for t in target], "text string"), buckets=50), percent=25).collect()
    s, t = (np.zeros(50, int) for _ in range(2))
    for _, x in rows:
        for g in grams(x, 2)[1]:
            s[crc32(g) % 50] += 1
    for x in target:
        for g in grams(x, 2)[1]:
            t[crc32(g) % 50] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 50) / ((s[b] + 1) * (t.sum() + 50)))) for b in range(50)]
    want = []
    for i, x in rows:
        n, g = grams(x, 2)
        weight = sum(gain[crc32(f) % 50] for f in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    key = lambda x: (-x[3], x[0] is None, x[0] or 0, -x[2], -x[1])
    fit = sorted((x for x in want if x[4]), key=key)
    ranks = {k + 1: x[:4] for k, x in enumerate(fit[:25 * len(fit) // 100])}
    assert {r["rank"]: tuple(r)[:4] for r in made if r["rank"]} == ranks
    assert Counter(tuple(r)[:4] for r in made) == Counter(x[:4] for x in want)


def test_resampling_of_nothing(spark, docs):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert imp.resample(imp.importance(none, docs)).collect() == []
    alike = imp.importance(docs, none, buckets=20)
    assert alike.where("n_features = 0 and weight <> 0").count() == 0


def ring_by_hand(keys, shards, virtual, slack=0.0):
    """Shard of each key (id text, tie), in rounds over the ring, one key at a time."""
    h = lambda t: int(hashlib.sha256(t.encode()).hexdigest()[:15], 16)
    nodes = sorted((h(f"shard:{s}:{v}"), s) for s in range(shards) for v in range(virtual))
    total = len(keys)
    free = [math.ceil(total / shards * (1 + slack)) if slack else total // shards + (s < total % shards) for s in range(shards)]
    order = sorted((h(f"key:{k}"), n) for n, k in enumerate(keys))
    left, place = [], {}
    for p, n in order:
        a = next((i for i, (q, _) in enumerate(nodes) if q >= p), len(nodes))
        left.append((n, list(dict.fromkeys(s for _, s in nodes[a:] + nodes[:a]))))
    for r in range(shards):
        rest = []
        for n, prefer in left:
            s = prefer[r]
            if free[s]:
                free[s] -= 1
                place[n] = s
            else:
                rest.append((n, prefer))
        left = rest
    assert not left
    return [place[n] for n in range(total)]


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_ring_equals_one_key_at_a_time(spark, rows, docs, slack):
    got = bounded_ring(docs, 5, virtual=8, slack=slack).collect()
    keys = ["" if i is None else str(i) for i, _ in rows]
    by_key = lambda pairs: sorted(Counter(pairs).items())
    assert by_key(("" if r.doc_id is None else str(r.doc_id), r.shard) for r in got) == by_key(zip(keys, ring_by_hand(keys, 5, 8, slack)))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, crc32((t or "").encode())) for i, t in rows)
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_counts_are_even_under_a_hot_key_and_few_rows_move(spark):
    many = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(1)).otherwise(F.col("id")).alias("doc_id"), F.lit("a").alias("text"))
    counts = [r["count"] for r in assigned(many, 7).groupBy("shard").count().collect()]
    assert len(counts) == 7 and max(counts) - min(counts) <= 1
    single = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    old, new = bounded_ring(single, 10), bounded_ring(single, 11)
    moved = old.join(new.select("doc_id", F.col("shard").alias("now")), "doc_id").where("shard <> now").count()
    assert moved < 2.5 * 4000 / 11  # the new shard's own share is 1 / 11
    assert assigned(spark.createDataFrame([], "doc_id long, text string"), 4).collect() == []
    assert [tuple(r)[:6] for r in assigned(single.limit(1), 24).collect()] == [(0, 8, 0, "rows", 0, 0)]
