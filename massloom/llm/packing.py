"""Concatenate and cut: documents laid end to end and cut into fixed windows.

Pass one turns texts into ids and counts them: every partition notes its own
running offset and, in one row, its total. Prefix sums over the partition
totals give each document its place in the whole stream. Pass two cuts the
stream every ``length`` ids; a document across a cut leaves a record in each
window it touches. Only the last window can be short.

Null and empty texts are one closing id. Repeated rows are packed again. A null
id stays null. Ids of a special token written out in a text are those that the
tokenizer gives it.
"""
from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom.llm.arrays import small_batches, text_buffer, word_spans
from massloom.llm.storage import BLOCK_BYTES, bounded_batches, modest, stored

#: Words whose ids a worker remembers; looking them up takes twice as many cells, a power of two.
MEMO = 1 << 19
MEMO_BYTES = 64
#: Words that the tokenizer gets at a time.
BATCH = 4_000

#: Marks that splitting takes off a word. A word of Latin-1 letters before them is plain: normalising only lower-cases it, splitting keeps it whole.
MARKS = ".,;:!?"


def _plain(core: str) -> bool:
    return core.isalpha() and (core.isascii() or max(core) < "Ā")


LETTERS = "".join(c for c in map(chr, range(256)) if _plain(c))


def _runs(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``n`` items of ``flat`` from ``start`` on, behind each other, and the edges between them."""
    edge = np.append(0, np.cumsum(n))
    return flat[np.repeat(start - edge[:-1], n) + np.arange(edge[-1])], edge


class WordTable:
    """Ids of up to ``limit`` words in flat arrays, a fraction of what Python's objects take; beyond that, those used last stay."""

    def __init__(self, limit: int, longest: int):
        self.limit, self.longest, self.turn = limit, longest, 0
        self.words = pa.array([], pa.large_string())
        self.ids, self.edge, self.used = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each word is, -1 where it isn't."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        self.turn += 1
        self.used[at[at >= 0]] = self.turn
        return at

    def keep(self, words: pa.Array, ids: np.ndarray, edge: np.ndarray) -> None:
        """Takes in new words, each once, with the edges of their ids; words over ``longest`` bytes are left out."""
        short = np.flatnonzero(pc.binary_length(words).to_numpy() <= self.longest)[-self.limit:]
        if len(self.words) + len(short) > self.limit:  # a quarter goes with them, so that not every batch sorts
            stay = max(0, min(self.limit * 3 // 4, self.limit - len(short)))
            order = np.sort(np.argsort(self.used, kind="stable")[len(self.used) - min(stay, len(self.used)):])
            self.ids, self.edge = _runs(self.ids, self.edge[order], np.diff(self.edge)[order])
            self.words, self.used = self.words.take(pa.array(order)), self.used[order]
        ids, edge = _runs(ids, edge[short], np.diff(edge)[short])
        self.words = pa.concat_arrays([self.words, words.take(pa.array(short))])
        self.ids, self.edge = np.concatenate([self.ids, ids]), np.append(self.edge, self.edge[-1] + edge[1:])
        self.used = np.append(self.used, np.full(len(short), self.turn))


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit numbers, through a bounded table of words.

    The tokenizer drops white space and never joins what it separates, so the
    ids of a text are those of its words. New words are handed over in batches;
    of plain ones only the letters, all in one text, whose ids are told apart by
    the pieces that end a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if array("I", [1]).tobytes() != b"\1\0\0\0":
            raise OSError("ids are stored as little-endian 32-bit numbers, which this machine's arrays are not")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True
        self.plain = bool(suffix) and self._splits_marks()
        self.table = WordTable(MEMO, MEMO_BYTES)

    def _splits_marks(self) -> bool:
        """Whether this tokenizer does with plain words and marks what is taken for granted here."""
        parts, norm = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        if parts is None or norm is None:
            return False
        if norm.normalize_str(LETTERS) != LETTERS.lower():
            return False
        whole = [x for x, _ in parts.pre_tokenize_str(LETTERS.lower())]
        apart = [len(parts.pre_tokenize_str(f"a{m}{n}")) for m in MARKS for n in MARKS]
        return len(whole) == 1 and set(apart) == {2}

    def _ids(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)  # ids only, no offsets
        return [array("I", e.ids).tobytes() if w else b"" for w, e in zip(words, found)]

    def _letters(self, cores: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(cores)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        if len(cut) != len(cores) + 1 or cut[-1] != len(ids):  # some piece is not what it seems
            return self._ids(cores)
        raw, cut = ids.tobytes(), (cut * 4).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def _encoded(self, words: pa.Array, ways) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words behind each other and the edges between them."""
        made = [x for at in range(0, len(words), BATCH) for x in ways(words.slice(at, BATCH).to_pylist())]
        return np.frombuffer(b"".join(made), "<u4"), np.append(0, np.cumsum(np.fromiter(map(len, made), np.int64, len(made)) // 4))

    def _looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, each in lower case and without marks where that is all its ids depend on."""
        place = self.table.places(words)
        unknown = place < 0
        new = words.filter(pa.array(unknown))
        plain = pc.match_substring_regex(new, f"^[{LETTERS}]+$") if self.plain else pa.array(np.zeros(len(new), bool))
        parts = [self._encoded(new.filter(plain), self._letters), self._encoded(new.filter(pc.invert(plain)), self._ids)]
        new = pa.concat_arrays([new.filter(plain), new.filter(pc.invert(plain))])
        ids = np.concatenate([x for x, _ in parts])
        edge = np.append(parts[0][1], parts[0][1][-1] + parts[1][1][1:])
        # The known words' runs, then the new ones, in the order asked for.
        is_plain = plain.to_numpy(zero_copy_only=False)
        rank = np.empty(len(new), np.int64)
        rank[np.append(np.flatnonzero(is_plain), np.flatnonzero(~is_plain))] = np.arange(len(new))
        place[unknown] = len(self.table.used) + rank
        flat, edges = np.concatenate([self.table.ids, ids]), np.append(self.table.edge, self.table.edge[-1] + edge[1:])
        found = _runs(flat, edges[place], np.diff(edges)[place])
        self.table.keep(new, ids, edge)
        return found

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words behind each other and the edges between them."""
        if not self.plain or not len(words):
            return self._looked_up(words)
        core = pc.utf8_rtrim(words, MARKS)
        plain = pc.match_substring_regex(core, f"^[{LETTERS}]+$")
        raw, off = text_buffer(words)
        n = np.where(plain.to_numpy(zero_copy_only=False), np.diff(off) - pc.binary_length(core).to_numpy(), 0)
        data, edge = _runs(raw, off[1:] - n, n)
        marks = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(edge), pa.py_buffer(data)])
        parts = pa.concat_arrays([pc.if_else(plain, pc.utf8_lower(core), words), marks]).dictionary_encode()
        ids, edge = self._looked_up(parts.dictionary)
        order = parts.indices.to_numpy().reshape(2, -1).T.ravel()  # a word's letters, then its marks
        ids, edge = _runs(ids, edge[order], np.diff(edge)[order])
        return ids, edge[::2]

    def encode(self, column, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow column behind each other, and where each text's begin; ``end_id`` closes every text."""
        buf, off = text_buffer(column)
        starts, ends, first = word_spans(buf, off)
        at = np.append(0, np.cumsum(ends - starts))
        edge = np.zeros(len(buf) + 1, np.int8)  # a text's last word may touch the next text's first
        edge[starts] += 1
        edge[ends] -= 1
        data = buf[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        ids, edge = self._distinct(words.dictionary)
        closing = np.array([] if end_id is None else [end_id], "<u4")
        ids, edge = np.concatenate([ids, closing]), np.append(edge, edge[-1] + len(closing))
        # Every text is its words and the closing entry.
        order = np.insert(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), first[1:], len(words.dictionary))
        out, stop = _runs(ids, edge[order], np.diff(edge)[order])
        return out, np.append(0, stop[1:][first[1:] + np.arange(len(off) - 1)])


def _tokenize(path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        words, part, at = WordTokenizer(path), TaskContext.get().partitionId(), 0  # of this task: goes before memory is handed back
        for b in small_batches(batches, BLOCK_BYTES, "text"):
            ids, edge = words.encode(b.column("text"), end_id)
            n = np.diff(edge)
            before = at + edge[:-1]
            at += len(ids)
            packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edge * 4), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(before), pa.array(n), packed], schema=schema)

    return run


def tokenized(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table (doc_id, part, before, n, ids): ids and the offset inside the partition."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(modest(_tokenize(path, end_id)), "doc_id long, part int, before long, n long, ids binary"), "tokens")


def concatenate_and_cut(tokens: DataFrame, length: int = 4096) -> DataFrame:
    """One row per piece of a document in a window.

    padded_length is what the window is filled up to: ``length``, or for a short
    last window whose size is a power of two, that size.
    """
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))  # one row per partition
    base = totals.select("part", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
                         F.sum("total").over(W.partitionBy(F.lit(0))).alias("all"))
    size = F.lit(length).cast("long")
    at = F.col("base") + F.col("before")
    placed = tokens.join(F.broadcast(base), "part").withColumn("at", at)

    def piece(k):
        start = F.greatest("at", k * size)
        n = F.least(F.col("at") + F.col("n"), (k + 1) * size) - start
        left = F.least(F.col("all") - k * size, size)
        first = start - F.col("at")
        return F.struct(first.alias("start"), n.alias("length"),
                        F.crc32(F.substring("ids", (first * 4 + 1).cast("int"), (n * 4).cast("int"))).alias("ids_crc32"),
                        F.col("n").alias("doc_tokens"), k.alias("sequence_id"), (start - k * size).alias("offset"),
                        F.when(left.bitwiseAND(left - 1) == 0, left).otherwise(size).alias("padded_length"))

    windows = F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))
    return placed.select("doc_id", F.inline(F.transform(windows, piece)))
