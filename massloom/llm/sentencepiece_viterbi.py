"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is a lattice: boundaries between characters, pieces as edges. The search
keeps, for each boundary, the best edge that ends there. Only boundaries within
the longest piece can still be extended, so whenever the backpointer paths of
all of these run through one boundary, everything before it is final: its ids
are committed and forgotten. What is kept grows with the longest piece, not
with the text.

- Unigram models: the path with the largest sum of piece scores.
- BPE models: merging leaves two pieces side by side only if encoding just
  these two gives them back, and a path whose neighbours all pass that test is
  the encoding. So the test decides which edges may follow each other, and one
  path reaches each boundary.

Paths always meet at a boundary that no piece spans: before a word mark that
follows another character, and around characters that occur in no longer piece
(checked against the vocabulary, never assumed). Chunks between such boundaries
are searched once and remembered, within a fixed number of entries.

Null and empty texts have no ids. Characters without a piece become their UTF-8
bytes where the model has byte pieces, else the unknown id.
"""
from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.memo import Memo
from massloom.llm.storage import bounded_batches

MARK = "▁"
MEMO = 600_000
MEMO_CHARS = 64
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes):
    """(number, value) of the fields of one protobuf message."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            c = data[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[i:i + size]
            i += size


class Model:
    """Vocabulary of a SentencePiece model file and the search over it."""

    def __init__(self, data: bytes):
        import sentencepiece

        if array("I", [1]).tobytes() != b"\1\0\0\0":
            raise OSError("ids are stored as little-endian 32-bit numbers, which this machine's arrays are not")
        sp = self.processor = sentencepiece.SentencePieceProcessor(model_proto=data)
        top = list(_fields(data))
        trainer = dict(_fields(next((v for k, v in top if k == 2), b"")))
        normalizer = dict(_fields(next((v for k, v in top if k == 3), b"")))
        self.bpe = trainer.get(3, 1) == 2
        self.plain = not normalizer.get(2) and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0
        self.unk = sp.unk_id()
        self.score, self.ids, self.bytes, byte_of = {}, {}, [], {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_of[int(p[3:5], 16)] = i
                self.bytes.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"" if sp.is_control(i) else b" \xe2\x81\x87 ")
            else:
                self.score[p], self.ids[p] = sp.get_score(i), i
                self.bytes.append(p.replace(MARK, " ").encode())
        self.byte_ids = [byte_of.get(b) for b in range(256)] if len(byte_of) == 256 else None
        self.longest = max(map(len, self.score), default=1)
        tails: dict[str, set] = {}
        for p in self.score:
            tails.setdefault(p[-2:], {1}).add(len(p))
        self.lengths = {t: sorted(v) for t, v in tails.items()}
        self.no_piece = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        inner = {c for p in self.score if len(p) > 1 for c in p}
        mark_splits = not any(a != MARK and b == MARK for p in self.score for a, b in zip(p, p[1:]))
        self.chunk = re.compile(rf"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+") if mark_splits and "\n" not in inner else None
        self.pair, self.whole, self.memo = {}, {}, Memo(self.encode_chunk, MEMO, MEMO_CHARS)

    def normalize(self, text: str) -> str:
        if not text:
            return ""
        return MARK + text.replace(" ", MARK) if self.plain else self.processor.normalize(text)

    def merged(self, text: str) -> list[str]:
        """Pieces left when the best neighbouring pair is merged again and again."""
        s = list(text)
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                v = self.score.get(s[i] + s[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if at < 0:
                break
            s[at:at + 2] = [s[at] + s[at + 1]]
        return s

    def may_follow(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.pair.get(key)
        if known is None:
            if len(self.pair) > MEMO:
                self.pair.clear()
            known = self.pair[key] = self.merged(left + right) == [left, right]
        return known

    def stands(self, piece: str) -> bool:
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = self.merged(piece) == [piece]
        return known

    def search(self, chars, commit) -> None:
        """Streams characters in; ``commit`` receives each final piece in order."""
        recent = ""
        origin = 0  # boundary of the first retained character
        best: dict[int, tuple[float, int, str]] = {0: (0.0, -1, "")}
        n = 0
        score, lengths, bpe, follows = self.score, self.lengths, self.bpe, self.pair
        for c in chars:
            recent += c
            n += 1
            top = None
            for length in lengths.get(recent[-2:], (1,)):
                start = n - length
                if start < origin:
                    break
                piece = recent[-length:]
                v = score.get(piece)
                if v is None:
                    if length > 1:
                        continue
                    v = self.no_piece
                before = best.get(start)
                if before is None:
                    continue
                if bpe:
                    if length > 1 and not self.stands(piece):
                        continue
                    if before[2]:
                        known = follows.get((before[2], piece))
                        if not (self.may_follow(before[2], piece) if known is None else known):
                            continue
                    top = (0.0, start, piece)
                    break
                total = before[0] + v
                if top is None or total >= top[0]:  # of equal sums the longest last piece
                    top = (total, start, piece)
            if top is not None:
                best[n] = top
            if n - origin >= 4 * self.longest:
                meet = self._meet(best, n)
                if meet > origin:
                    self._commit(best, meet, commit)
                    recent = recent[meet - n:] if meet < n else ""
                    last = best[meet]
                    best = {b: v for b, v in best.items() if b > meet}
                    best[meet] = (last[0], -1, last[2])
                    origin = meet
        self._commit(best, n, commit)

    def _meet(self, best: dict, n: int) -> int:
        """The last boundary on the paths of all boundaries that can still be extended."""
        live = {b for b in range(n - self.longest + 1, n + 1) if b in best}
        while len(live) > 1:
            b = max(live)
            live.remove(b)
            live.add(best[b][1])
        return live.pop()

    @staticmethod
    def _commit(best: dict, at: int, commit) -> None:
        path = []
        while best[at][1] >= 0:
            path.append(best[at][2])
            at = best[at][1]
        for piece in reversed(path):
            commit(piece)

    def ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unk]

    def encode_chunk(self, chunk: str) -> bytes:
        pieces: list[str] = []
        self.search(chunk, pieces.append)
        ids: list[int] = []
        for p in pieces:
            if self.byte_ids or p in self.ids or ids[-1:] != [self.unk]:  # neighbouring unknown characters share one id
                ids += self.ids_of(p)
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.chunk is None:
            return self.encode_chunk(self.normalize(text))
        if self.plain and "  " not in text and MARK not in text and text[0] not in " \n":
            chunks = (MARK + text.replace(" ", " " + MARK).replace("\n", " \n")).split(" ")
        else:
            chunks = self.chunk.findall(self.normalize(text))
        return b"".join(map(self.memo.__getitem__, chunks))

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = Model(f.read())
    return _models[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids as one binary of little-endian unsigned 32-bit numbers."""
    bounded_batches(df.sparkSession)

    def run(batches):
        m = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([m.encode(t.as_py()) for t in b.column("text")], pa.binary())], ["id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, ids binary")


def decode(df: DataFrame, path: str) -> DataFrame:
    """(id, ids, text) of encoded rows; null ids stay null."""

    def run(batches):
        m = model(path)
        for b in batches:
            texts = [None if i.as_py() is None else m.decode(i.as_py()) for i in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ids"), pa.array(texts, pa.string())], ["id", "ids", "text"])

    return df.select("id", "ids").mapInArrow(run, "id long, ids binary, text string")
