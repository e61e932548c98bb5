"""SentencePiece search and packing against their libraries and definitions."""
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from massloom.llm.memo import Memo
from massloom.llm.packing import concatenate_and_cut, tokenized
from massloom.llm.sentencepiece_viterbi import Model, decode, encode

TEXTS = ["", None, "a", " a", " a  b   c\n\n x ", "snow ☃☃ 漢字かな", "aaaa" * 300, "\n\nq\n", "x" * 5000, "abc▁▁▁ def      gh", "The the of\nThe end.  Two",
         "it's <|endoftext|> here", "tab\there\x00nul", "The the of\nThe end.  Two"]


@pytest.fixture(scope="module")
def piece():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return Model(f.read())


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_bpe_search_equals_the_library(piece):
    for t in TEXTS:
        assert ids(piece.encode(t or "")) == piece.processor.encode(t or "")
        assert piece.decode(piece.encode(t or "")) == (t or "").replace("▁", " ")


def test_streaming_equals_one_window(piece):
    """Without chunk boundaries the search commits by converging paths alone."""
    text = piece.normalize("thonering of the reader and " * 40)
    pieces = []
    piece.search(iter(text), pieces.append)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in piece.ids_of(p)] == piece.processor.encode("thonering of the reader and " * 40)


def test_unigram_search_has_the_best_score(piece):
    rng = np.random.default_rng(3)
    letters = "abcd"
    names = sorted({"".join(rng.choice(list(letters), rng.integers(2, 5))) for _ in range(60)} | set(letters))
    model = Model.__new__(Model)
    model.bpe, model.pair, model.score = False, {}, {p: -float(rng.integers(1, 100)) for p in names}
    model.longest = max(map(len, names))
    tails = {}
    for p in names:
        tails.setdefault(p[-2:], {1}).add(len(p))
    model.lengths, model.no_piece = {t: sorted(v) for t, v in tails.items()}, -200.0
    for _ in range(30):
        text = "".join(rng.choice(list(letters), 200))
        best = [0.0]
        for n in range(1, len(text) + 1):
            best.append(max(best[n - k] + model.score[text[n - k:n]] for k in range(1, min(n, 4) + 1) if text[n - k:n] in model.score))
        pieces = []
        model.search(text, pieces.append)
        assert "".join(pieces) == text and sum(model.score[p] for p in pieces) == best[-1]


def test_encode_and_decode_tables(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = decode(encode(df, path), path).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "no id" if r.id is None else TEXTS[r.id] or ""
        assert ids(r.ids) == sp.encode(text) and r.text == text.replace("▁", " ")


@pytest.mark.parametrize("length", [16, 4096])
def test_packing(spark, length):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "no id", 7), (10, TEXTS[10], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(4)
    pieces = concatenate_and_cut(tokenized(df, public_tokenizers.path("word_bpe_49k.json")), length).collect()
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in rows}
    filled = {}
    for p in pieces:
        part = want[p.doc_id][p.start:p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and p.doc_tokens == len(want[p.doc_id]) and len(part) == p.length > 0
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    total = sum(len(want[i]) for i, _, _ in rows)
    assert sum(p.length for p in pieces) == total
    for k, spans in filled.items():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at == length or k == max(filled)
    last = total - max(filled) * length
    padded = {p.padded_length for p in pieces if p.sequence_id == max(filled)}
    assert padded == {last if last & (last - 1) == 0 else length}
    assert sum(p.length for p in pieces if p.doc_id == 10) == 2 * len(want[10])


def test_packing_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert concatenate_and_cut(tokenized(none, public_tokenizers.path("word_bpe_49k.json"))).collect() == []


def test_memo_keeps_what_is_in_use():
    made = []
    memo = Memo(lambda k: made.append(k) or k * 2, 3, 4)
    assert [memo[k] for k in ("a", "b", "c", "a", "d", "a", "longer", "longer")] == ["aa", "bb", "cc", "aa", "dd", "aa", "longerlonger", "longerlonger"]
    assert made == ["a", "b", "c", "d", "longer", "longer"]
