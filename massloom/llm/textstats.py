"""Counts by line and document, from byte buffers."""
from __future__ import annotations

import numpy as np

from massloom.llm.arrays import Prefix, combine, mix, word_spans

SYMBOLS = b"#*$%&|<>"
_IS = {name: np.zeros(256, bool) for name in ("symbol", "upper", "lower", "digit", "point", "loud")}
_IS["symbol"][list(SYMBOLS)] = True
_IS["upper"][65:91] = True
_IS["lower"][97:123] = True
_IS["digit"][48:58] = True
_IS["point"][:] = True
_IS["point"][0x80:0xC0] = False  # continuation bytes
_IS["loud"][list(b"!?=_~^")] = True


def _sums(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[end] - c[start]


class Stats:
    """Lines (split at \\n, those with a word) and documents of one buffer.

    ``line`` and ``doc`` hold counts; ``line_doc`` is each line's document.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        docs = len(off) - 1
        starts, ends, first = word_spans(buf, off)
        cut = np.zeros(len(buf) + 1, bool)
        cut[off] = True
        at = np.flatnonzero(buf == 10) + 1
        cut[at] = True
        begin = np.flatnonzero(cut[:-1]) if len(buf) else np.zeros(0, np.int64)
        stop = np.append(begin[1:], len(buf))
        body = np.where((stop > begin) & (buf[np.maximum(stop - 1, 0)] == 10), stop - 1, stop) if len(buf) else stop
        line_of = np.searchsorted(begin, starts, "right") - 1
        words_in = np.bincount(line_of, minlength=len(begin))
        full = np.flatnonzero(words_in)
        begin, body = begin[full], body[full]
        renumber = np.zeros(len(words_in), np.int64)
        renumber[full] = np.arange(len(full))
        line_of = renumber[line_of]
        self.line_doc = np.searchsorted(off, begin, "right") - 1
        prefix = Prefix(buf)
        words = prefix.spans(starts, ends)
        doc_of = np.repeat(np.arange(docs), np.diff(first))

        # Lines equal to an earlier one of their document.
        key = mix(prefix.spans(begin, body) + self.line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]

        # Words under 3-word windows that their document holds twice or more.
        covered = np.zeros(len(words), bool)
        if len(words) >= 3:
            inside = doc_of[2:] == doc_of[:-2]
            where = np.flatnonzero(inside)
            window = mix(combine(words, 3)[where] + doc_of[where].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(window)
            same = window[order[1:]] == window[order[:-1]]
            twice = np.zeros(len(where), bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            hit = where[twice]
            covered[hit] = covered[hit + 1] = covered[hit + 2] = True
        echo = np.zeros(len(words), bool)
        if len(words) > 1:
            echo[1:] = (words[1:] == words[:-1]) & (doc_of[1:] == doc_of[:-1])

        point = _IS["point"][buf]
        upper, lower = _IS["upper"][buf], _IS["lower"][buf]
        wide = np.flatnonzero(buf[:-1] == 0xC3) + 1 if len(buf) else at  # letters of the Latin-1 block
        upper[wide] |= buf[wide] < 0x9F
        lower[wide] |= buf[wide] >= 0x9F
        flags = {"symbols": _IS["symbol"][buf], "upper": upper, "lower": lower, "digits": _IS["digit"][buf], "loud": _IS["loud"][buf], "points": point}
        self.line = {k: _sums(v, begin, body) for k, v in flags.items()}
        count = lambda mask: np.bincount(line_of[mask], minlength=len(begin)) if len(begin) else np.zeros(0, np.int64)
        self.line |= {"words": words_in[full], "again": again.astype(np.int64), "echo": count(echo), "covered": count(covered)}
        chars = _sums(point, starts, ends)
        self.doc = {k: _sums(v, off[:-1], off[1:]) for k, v in flags.items()}
        per_doc = lambda values: np.bincount(doc_of, weights=values, minlength=docs).astype(np.int64)
        self.doc |= {"words": np.diff(first), "word_chars": per_doc(chars), "covered": per_doc(covered), "echo": per_doc(echo),
                     "dup_lines": np.bincount(self.line_doc, weights=again, minlength=docs).astype(np.int64),
                     "lines": np.bincount(self.line_doc, minlength=docs)}


def shares(part: dict) -> np.ndarray:
    """Scale-free features of lines or documents, one row each."""
    points = np.maximum(part["points"], 1).astype(np.float64)
    letters = np.maximum(part["upper"] + part["lower"], 1).astype(np.float64)
    words = np.maximum(part["words"], 1).astype(np.float64)
    return np.stack([np.minimum(part["symbols"] / words, 3.0), part["upper"] / letters, np.minimum(part["loud"] / words, 3.0), part["digits"] / points,
                     part["echo"] / words, part["covered"] / words, np.log1p(words) / 5, np.minimum(points / words, 30) / 10], axis=1)
