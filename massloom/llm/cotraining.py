"""Quality classifier by co-training of a text view and a metadata view.

The text view sees character trigrams (hashed) and character statistics; the
metadata view sees language, source and length. Both start from a bounded
sample of labelled documents. In every round each view scores all other
documents and hands those it is sure of, by its calibrated probability, to the
other view with its label. They arrive as sums over all tasks: the gradient and
the curvature of their loss at the receiving view's weights, per class. So
every sure document counts, whatever their number, and what reaches the driver
has the size of the parameters. Handed documents weigh as much as the labelled
ones (``trust``). At the end both views are calibrated on held-out labelled
documents, and their evidence is added, so a view that knows nothing changes
nothing. All documents are scored over their whole texts.

Bounds: ``per_class`` labelled documents of each class, ``rounds`` exchanges.
Labels beyond the sample are not looked at; their documents count as others.
Without labels of both classes nothing is rejected and the score is 1. A
labelled id that several rows share gives one example for each of them.

Null and empty texts, sources and languages are values of their own. Repeated
rows score alike. Columns other than those five are handed through by ``keep``.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.llm.arrays import small_batches, text_buffer
from massloom.llm.fit import calibrate, labelled_sample, logistic, sigmoid
from massloom.llm.storage import BLOCK_BYTES, bounded_batches, stored, modest
from massloom.llm.textstats import Stats, shares

PER_CLASS, ROUNDS, SURE, TRUST = 1000, 2, 0.97, 0.5
#: Partial sums that reach the driver, at most.
SLOTS = 32
GRAMS, STATS = 1 << 11, 8
META = 64


def text_view(column) -> np.ndarray:
    """One row per text: square roots of trigram shares, then statistics."""
    buf, off = text_buffer(column)
    out = np.zeros((len(off) - 1, GRAMS + STATS), np.float32)
    v = buf.astype(np.uint32)
    if len(v) >= 3:
        h = ((v[:-2] * np.uint32(0x9E3779B1) + v[1:-1] * np.uint32(0x85EBCA77) + v[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)).astype(np.int64)
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            if b - a >= 3:
                out[i, :GRAMS] = np.sqrt(np.bincount(h[a:b - 2], minlength=GRAMS) / (b - a - 2))
    out[:, GRAMS:] = shares(Stats(buf, off).doc)
    return out


def metadata_view(lang: list, source: list, length: np.ndarray) -> np.ndarray:
    """Hashed language and source, and the size class of the length."""
    out = np.zeros((len(lang), META), np.float32)
    for i, (a, b) in enumerate(zip(lang, source)):
        out[i, zlib.crc32(repr(a).encode()) % 16] += 1
        out[i, 16 + zlib.crc32(repr(b).encode()) % 32] += 1
    out[np.arange(len(lang)), 48 + np.minimum(np.log2(np.maximum(length, 1)).astype(int), 15)] = 1
    return out


@dataclass
class View:
    """A linear scorer and the calibration of its scores."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (x @ self.weights + self.bias) + self.offset


@dataclass
class CoModel:
    text: View
    meta: View
    prior: float

    def combined(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of both views and of their summed evidence."""
        a, b = self.text.logit(text), self.meta.logit(meta)
        return sigmoid(a), sigmoid(b), sigmoid(a + b - self.prior)


@dataclass
class Handed:
    """Loss of the handed documents of one view around ``at``: per class their number, gradient and curvature."""

    at: np.ndarray
    number: np.ndarray
    slope: np.ndarray
    curve: np.ndarray

    def pull(self, weights: np.ndarray, trust: float) -> np.ndarray:
        share = np.where(self.number > 0, 0.5 * trust / np.maximum(self.number, 1), 0.0)
        return share @ (self.slope + self.curve * (weights - self.at))


def _fit(x, y, held_x, held_y, handed: Handed | None = None, trust: float = TRUST) -> View:
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    more = {} if handed is None else {"start": handed.at, "pull": lambda w: handed.pull(w, trust)}
    view = View(*logistic(x, y, balance, l2=1e-4, steps=250, rate=0.05, **more))
    view.slope, view.offset = calibrate(held_x @ view.weights + view.bias, held_y)
    return view


def hand_over(text: np.ndarray, meta: np.ndarray, views: dict[str, View], sure: float):
    """What each view hands the other of some documents: (receiver, class, number, slope, curve)."""
    x = {"text": text, "meta": meta}
    for giver, taker in (("text", "meta"), ("meta", "text")):
        p = sigmoid(views[giver].logit(x[giver]))
        for y, mask in ((0, p <= 1 - sure), (1, p >= sure)):
            if mask.any():
                rows = x[taker][mask].astype(np.float64)
                q = sigmoid(rows @ views[taker].weights + views[taker].bias)
                h = q * (1 - q)
                yield taker, y, int(mask.sum()), np.append((q - y) @ rows, (q - y).sum()), np.append(h @ (rows * rows), h.sum())


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, others, base_rate: float, rounds: int = ROUNDS, sure: float = SURE) -> CoModel:
    """The exchange itself. ``others(views, sure)`` gives the sums of what all other documents hand over;
    ``base_rate`` is the share of good rows among all labelled ones."""
    held = np.arange(len(y)) % 4 == 0
    x = {"text": text, "meta": meta}
    fitted = {k: _fit(v[~held], y[~held], v[held], y[held]) for k, v in x.items()}
    for _ in range(rounds):
        handed = {k: Handed(np.append(fitted[k].weights, fitted[k].bias), np.zeros(2), np.zeros((2, v.shape[1] + 1)), np.zeros((2, v.shape[1] + 1))) for k, v in x.items()}
        for k, c, n, slope, curve in others(fitted, sure):
            handed[k].number[c] += n
            handed[k].slope[c] += slope
            handed[k].curve[c] += curve
        if not any(h.number.any() for h in handed.values()):
            break
        fitted = {k: _fit(v[~held], y[~held], v[held], y[held], handed[k]) if handed[k].number.any() else fitted[k] for k, v in x.items()}
    # The sample is balanced by class; evidence is moved to the share among all labelled rows.
    shown = np.log((y[held].sum() + 1) / ((1 - y[held]).sum() + 1))
    real = np.log(base_rate / (1 - base_rate))
    for v in fitted.values():
        v.offset += real - shown
    return CoModel(fitted["text"], fitted["meta"], float(real))


def _inputs(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> list:
    return [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
            F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source")]


def _views_of(b) -> tuple[np.ndarray, np.ndarray]:
    buf, off = text_buffer(b.column("text"))
    return text_view(b.column("text")), metadata_view(b.column("lang").to_pylist(), b.column("source").to_pylist(), np.diff(off))


_SUMS = pa.schema([("slot", pa.int32()), ("view", pa.string()), ("y", pa.int32()), ("n", pa.int64()), ("slope", pa.binary()), ("curve", pa.binary())])
_SUMS_SQL = "slot int, view string, y int, n bigint, slope binary, curve binary"


def _sums_of(slot: int, parts) -> pa.RecordBatch:
    total: dict = {}
    for view, y, n, slope, curve in parts:
        old = total.get((view, y), (0, 0.0, 0.0))
        total[view, y] = (old[0] + n, old[1] + slope, old[2] + curve)
    return pa.RecordBatch.from_pylist([{"slot": slot, "view": v, "y": y, "n": n, "slope": s.tobytes(), "curve": c.tobytes()} for (v, y), (n, s, c) in total.items()], _SUMS)


def _rows_of(table):
    for r in table.to_pylist():
        yield r["view"], r["y"], r["n"], np.frombuffer(r["slope"]), np.frombuffer(r["curve"])


def _others(rows: DataFrame):
    """Sums over documents, in Spark: one row per task, view and class, then per slot."""
    def sums(views: dict[str, View], sure: float):
        def run(batches):
            parts = (x for b in small_batches(batches, BLOCK_BYTES, "text") for x in hand_over(*_views_of(b), views, sure))
            yield _sums_of(TaskContext.get().partitionId() % SLOTS, parts)

        def add(key, table):
            return pa.Table.from_batches([_sums_of(key[0].as_py(), _rows_of(table))])

        return _rows_of(rows.mapInArrow(modest(run), _SUMS_SQL).groupBy("slot").applyInArrow(add, _SUMS_SQL).toArrow())

    return sums


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rounds: int = ROUNDS, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> CoModel | None:
    bounded_batches(docs.sparkSession)
    rows = docs.select(*_inputs(docs, id_col, text_col, lang_col, source_col))
    rates = labels.where("quality in (0, 1)").agg(F.avg(F.col("quality").cast("double")).alias("r"), F.count("*").alias("n")).first()
    marked = stored(labelled_sample(labels, "quality", per_class), "labelled")  # at most two classes' worth of ids

    def run(batches):
        for b in small_batches(batches, BLOCK_BYTES, "text"):
            t, m = _views_of(b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([r.tobytes() for r in t], pa.binary()),
                                              pa.array([r.tobytes() for r in m], pa.binary())], ["doc_id", "y", "t", "m"])

    got = rows.join(F.broadcast(marked), "doc_id").mapInArrow(modest(run), "doc_id long, y int, t binary, m binary").toArrow()
    order = np.lexsort((got["t"].to_pandas().map(zlib.crc32).to_numpy(), got["doc_id"].to_numpy())) if got.num_rows else np.zeros(0, int)
    y = got["y"].to_numpy()[order]
    if not {0, 1} <= set(y.tolist()):
        return None
    stack = lambda name: np.stack([np.frombuffer(got[name][int(i)].as_py(), np.float32) for i in order])
    shuffle = np.random.default_rng(5).permutation(len(y))
    n = rates["n"]
    rate = min(max(rates["r"], 1 / (n + 2)), 1 - 1 / (n + 2))
    others = rows.join(F.broadcast(marked.select("doc_id")), "doc_id", "left_anti")
    return co_train(stack("t")[shuffle], stack("m")[shuffle], y[shuffle].astype(float), _others(others), rate, rounds)


def score(docs: DataFrame, model: CoModel | None, threshold: float = 0.5, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(keep..., text_score, meta_score, score, kept); ``keep`` is the id where not given."""
    bounded_batches(docs.sparkSession)
    keep = [id_col] if keep is None else keep
    named = [f"keep_{i}" for i in range(len(keep))]
    rows = docs.select(*_inputs(docs, id_col, text_col, lang_col, source_col), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, named)]).drop("doc_id")
    made = ["text_score", "meta_score", "score", "kept"]

    def run(batches):
        for b in small_batches(batches, BLOCK_BYTES, "text"):
            parts = model.combined(*_views_of(b)) if model else [np.ones(b.num_rows)] * 3
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in named], *[pa.array(p.astype(np.float64)) for p in parts],
                                              pa.array(parts[2] >= threshold)], [*named, *made])

    fields = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in named] + ["text_score double", "meta_score double", "score double", "kept boolean"]
    out = rows.mapInArrow(modest(run), ", ".join(fields))
    return out.select(*[F.col(n).alias(c) for n, c in zip(named, keep)], *made)
