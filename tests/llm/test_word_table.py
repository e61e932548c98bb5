"""The tokenizer's memory of words: small, bounded, and without effect on the ids."""
import gc
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from massloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_remembered_words_take_few_bytes():
    words = packing.WordTokenizer(PATH)
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(w) for w in rng.choice(list("abcdefghijklmnop"), (2000, 9))) for _ in range(20)]
    words.encode(pa.array(texts[:1]))
    gc.collect()
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    for t in texts[1:]:
        words.encode(pa.array([t]))
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 100 * 2000 * 19  # Python strings in a dict take about twice as much


@pytest.mark.parametrize("limit", [1, 7, 40, 1 << 19])
def test_ids_do_not_depend_on_what_is_remembered(monkeypatch, limit):
    monkeypatch.setattr(packing, "MEMO", limit)
    words, library = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    rng = np.random.default_rng(limit)
    some = ["the", "The", "THE", "the,", "The.", "end?!", "...", ",", "Straße", "ÀÉ", "ªº", "µm", "Ÿ", "ĀB", "a-b", "x1", "it's", "☃☃", "漢字", "<|endoftext|>",
            "q" * 100, "q" * 100 + ".", "naïve;", "\x00", "a b", "İ", "ǅ", "I", "🙂.", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    for _ in range(12):
        texts = [None if k == 9 else " ".join(rng.choice(some, rng.integers(0, 30))) for k in range(10)]
        ids, edge = words.encode(pa.array(texts), 2)
        assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:])] == [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
        assert len(words.table.words) == len(words.table.used) == len(words.table.edge) - 1 <= limit


def test_the_table_keeps_what_was_used_last():
    table = packing.WordTable(4, 3)
    for group in (["a", "b", "c", "d"], ["a", "b"], ["e"], ["long"]):
        w = pa.array(group, pa.large_string())
        at = table.places(w)
        new = w.filter(pa.array(at < 0))
        table.keep(new, np.arange(len(new), dtype="<u4"), np.arange(len(new) + 1))
    assert set(table.words.to_pylist()) >= {"a", "b", "e"} and "long" not in table.words.to_pylist() and len(table.words) <= 4
