"""Quality rules by line labels: a linear-chain conditional random field.

Every line with a word gets a label, content or boilerplate, by Viterbi
decoding; a document is kept where content lines hold at least half of its
words and the base rules pass. Base counts are exact counts over the whole text.

The field is trained here from document labels: lines of good documents are
content; lines of bad documents start as what a line classifier says and are
re-decoded between fits. The fit sees at most ``per_class`` documents of each
label. Without both labels the field is neutral and only the base rules decide.

Null and empty texts have no words and fail the base rules. Repeated rows are
judged alike. Lines are the parts between \\n; a line without words has no label.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.arrays import small_batches, text_buffer
from massloom.llm.fit import labelled_sample, logistic, sigmoid
from massloom.llm.storage import BLOCK_BYTES, bounded_batches
from massloom.llm.textstats import Stats, shares

PER_CLASS = 400
FEATURES = 12
CONTENT, BOILERPLATE = 0, 1


def line_features(s: Stats) -> np.ndarray:
    """Shares (those of symbols and loud marks also squashed), a repeat flag and a constant for every line."""
    x = shares(s.line)
    return np.concatenate([x, np.tanh(6 * x[:, [0]]), np.tanh(6 * x[:, [2]]), s.line["again"][:, None].astype(np.float64), np.ones((len(x), 1))], axis=1)


class Field:
    """Weights of boilerplate against content per feature, and a 2 x 2 transition table."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions

    @classmethod
    def neutral(cls):
        w = np.zeros(FEATURES)
        w[-1] = -1.0
        return cls(w, np.zeros((2, 2)))

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.zeros(len(x)), x @ self.weights], axis=1)

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi labels of sequences laid end to end, all sequences a step at a time."""
        e, t = self.emissions(x), self.transitions
        start = np.cumsum(lengths) - lengths
        back = np.zeros((len(x), 2), np.int8)
        score = np.zeros((len(lengths), 2))
        live = np.flatnonzero(lengths > 0)
        score[live] = e[start[live]]
        k = 1
        while len(live := live[lengths[live] > k]):
            way = score[live][:, :, None] + t
            best = way.argmax(axis=1)
            back[start[live] + k] = best
            score[live] = np.take_along_axis(way, best[:, None, :], 1)[:, 0] + e[start[live] + k]
            k += 1
        labels = np.zeros(len(x), np.int8)
        state = score.argmax(axis=1)
        for k in range(int(lengths.max(initial=0)) - 1, -1, -1):
            live = np.flatnonzero(lengths > k)
            at = start[live] + k
            last = lengths[live] == k + 1
            here = np.where(last, state[live], labels[at])
            labels[at] = here
            if k:
                labels[at - 1] = back[at, here]
        return labels

    def gradient(self, x, y, lengths):
        """Log-likelihood gradient by forward and backward sums over padded sequences."""
        n, m = len(lengths), int(lengths.max())
        start = np.cumsum(lengths) - lengths
        inside = np.arange(m)[None, :] < lengths[:, None]
        e = np.zeros((n, m, 2))
        e[inside] = self.emissions(x)
        t = self.transitions
        a = np.zeros((n, m, 2))
        a[:, 0] = e[:, 0]
        for k in range(1, m):
            a[:, k] = np.where(inside[:, k, None], np.logaddexp.reduce(a[:, k - 1, :, None] + t, axis=1) + e[:, k], a[:, k - 1])
        b = np.zeros((n, m, 2))
        for k in range(m - 2, -1, -1):
            b[:, k] = np.where(inside[:, k + 1, None], np.logaddexp.reduce(t + (e[:, k + 1] + b[:, k + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(a[:, -1], axis=1)
        p = np.exp(a + b - z[:, None, None])[inside][:, 1]
        pair = np.exp(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * inside[:, 1:, None, None]
        seen = np.zeros((2, 2))
        follow = np.ones(len(x), bool)
        follow[start] = False
        f = np.flatnonzero(follow)
        np.add.at(seen, (y[f - 1], y[f]), 1)
        return (y - p) @ x, seen - pair.sum(axis=(0, 1))

    def fit(self, x, y, lengths, steps: int = 120, rate: float = 0.1, l2: float = 1e-3):
        m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
        # Sequences of like length share one padded table.
        start, size = np.cumsum(lengths) - lengths, np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
        groups = []
        for c in np.unique(size):
            at = np.flatnonzero(size == c)
            rows = np.concatenate([np.arange(start[i], start[i] + lengths[i]) for i in at])
            groups.append((x[rows], y[rows], lengths[at]))
        for k in range(1, steps + 1):
            parts = [self.gradient(*g) for g in groups]
            gw, gt = sum(p[0] for p in parts), sum(p[1] for p in parts)
            g = np.append(gw, gt.ravel()) / len(lengths) - l2 * np.append(self.weights, self.transitions.ravel())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            self.weights = self.weights + step[:FEATURES]
            self.transitions = self.transitions + step[FEATURES:].reshape(2, 2)
        return self


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Field:
    """Fits a field on at most ``per_class`` documents of each quality label."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(labels, "quality", per_class)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches):
        for b in small_batches(batches, BLOCK_BYTES, "text"):
            s = Stats(*text_buffer(b.column("text")))
            x, cut = line_features(s), np.searchsorted(s.line_doc, np.arange(b.num_rows + 1))
            blobs = [x[i:j].astype("<f8").tobytes() for i, j in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(blobs, pa.binary())], ["doc_id", "y", "x"])

    got = sorted((r["doc_id"], r["y"], bytes(r["x"])) for r in rows.mapInArrow(run, "doc_id long, y int, x binary").collect() if len(r["x"]))
    if len({y for _, y, _ in got}) < 2:
        return Field.neutral()
    parts = [np.frombuffer(x, "<f8").reshape(-1, FEATURES) for _, _, x in got]
    lengths = np.array([len(p) for p in parts])
    x = np.concatenate(parts)
    bad = np.repeat(np.array([y == 0 for _, y, _ in got]), lengths)
    # A line is first judged alone; every document weighs the same.
    w, bias = logistic(x, bad.astype(float), np.repeat(1.0 / lengths, lengths), l2=1e-4)
    y = (bad & (sigmoid(x @ w + bias) > 0.5)).astype(np.int64)
    field = Field.neutral()
    for _ in range(3):
        field.fit(x, y, lengths)
        y = (bad & (field.decode(x, lengths) == BOILERPLATE)).astype(np.int64)
    return field


def judge(docs: DataFrame, field: Field, min_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, content share and verdict of every document."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "content_words", "content_share"]

    def run(batches):
        for b in small_batches(batches, BLOCK_BYTES, "text"):
            s = Stats(*text_buffer(b.column("text")))
            d, n = s.doc, b.num_rows
            labels = field.decode(line_features(s), d["lines"])
            content = np.bincount(s.line_doc, weights=s.line["words"] * (labels == CONTENT), minlength=n).astype(np.int64)
            failed = (d["words"] < 50) | (100 * d["covered"] > 50 * d["words"])
            share = content / np.maximum(d["words"], 1)
            columns = [d["words"], d["word_chars"], d["symbols"], d["dup_lines"], d["covered"]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c.astype(np.int64)) for c in columns], pa.array(failed),
                                              pa.array(~failed & (share >= min_share)), pa.array(d["lines"].astype(np.int64)), pa.array(content), pa.array(share)], names)

    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
              "kept boolean, n_lines long, content_words long, content_share double")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
