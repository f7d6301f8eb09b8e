"""Toxicity by noisy-channel deobfuscation and a linear score of the restored text.

A trigram model of characters is counted over all documents. Stretches that
look disguised (digits or signs inside words, spelled-out words, drawn-out
letters) become character lattices: each sign may stand for some letters, a
separator may vanish or end a word, a repeated letter may be dropped, each at
a cost. The cheapest path under channel and character model is the restored
text, and the words of a document are those it has plus the restored ones.

The score is a logistic regression on the presence of words and word
beginnings that labelled toxic documents have far more often than others. It
is fitted on a bounded sample of labelled rows; the rest covers all documents.

Defined results: a null or empty text gets the score of a text without any
such word; rows without label are scored alike; repeated labels of a document
count as toxic if one is; without labelled rows of both kinds all scores are
the share of toxic labels (0 without labels); texts are read whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

THRESHOLD = 0.3
#: Labelled rows to fit on, at most; the ones with the smallest hash of doc_id.
FIT_ROWS = 20_000
#: Words and beginnings kept for the fit, at most.
FEATURES = 4_000
#: Least toxic documents with a feature, and least ratio of its shares.
LEAST_DOCS, LEAST_RATIO = 3, 4.0
#: Features a task counts before it passes them on.
HELD = 200_000

WORDS = re.compile(r"[^\W\d_]+")

# Letters that digits and signs stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
}
_S = r"0-9@$!|+€"
#: A sign between letters, before the letters of a word, or digits after them.
DISGUISED = re.compile(rf"[A-Za-z][{_S}]{{1,3}}[A-Za-z]|(?<![A-Za-z{_S}])[{_S}]{{1,2}}[A-Za-z]{{2}}|[A-Za-z]{{2}}[0-9@$|+]{{1,2}}(?![A-Za-z{_S}])")
DRAWN_OUT = re.compile(r"([^\W\d_])\1\1")
SPELLED = re.compile(rf"(?<![\w@$|+€])[A-Za-z{_S}](?:[ .\-_*][A-Za-z{_S}]){{2,}}(?![\w@$|+€])")

COST_SIGN, COST_DROP, COST_DROP_SECOND, COST_KEEP_RUN, COST_BREAK = 1.0, 0.5, 3.0, 3.0, 2.5

SYMBOLS = 28  # boundary, a to z, other letters
_OTHER = 27


def _letter_table() -> np.ndarray:
    """Symbol of each code point below 0x250: Latin letters by their base letter."""
    table = np.zeros(0x250, np.int64)
    for code in range(0x250):
        char = chr(code)
        if char.isalpha():
            base = unicodedata.normalize("NFD", char.lower())[0]
            table[code] = ord(base) - 96 if "a" <= base <= "z" else _OTHER
    return table


LETTERS = _letter_table()


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < len(LETTERS), LETTERS[np.minimum(codes, len(LETTERS) - 1)], _OTHER)


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of all symbol trigrams of all texts; the table has 28^3 cells at any size of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    s = np.concatenate([[0, 0], symbols(text.as_py()), [0]])
                    total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    cells = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3, np.int64)
    for row in cells:
        out[row.cell] = row.n
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def character_costs(counts: np.ndarray, weight: float = 20.0) -> np.ndarray:
    """-ln P(c | a, b), backing off to P(c | b) and P(c)."""
    one = counts.sum(axis=(0, 1)) + 1.0
    one = one / one.sum()
    two = counts.sum(axis=0) + weight * one
    two = two / two.sum(axis=1, keepdims=True)
    three = counts + weight * two[None]
    return -np.log(three / three.sum(axis=2, keepdims=True))


class Restorer:
    """Viterbi decoder of disguised stretches."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.known: dict[str, str] = {}

    def lattice(self, stretch: str) -> list[list[tuple[int | None, float]]]:
        """Per character the symbols it may be, None for nothing, with costs."""
        out = []
        previous, run = "", 0
        for char in stretch.lower():
            run = run + 1 if char == previous else 1
            options: list[tuple[int | None, float]]
            if char in SIGNS:
                options = [(ord(x) - 96, COST_SIGN) for x in SIGNS[char]]
            elif char.isalpha():
                options = [(int(symbols(char)[0]), 0.0 if run < 3 else COST_KEEP_RUN)]
            else:
                options = [(None, COST_DROP), (0, COST_BREAK)]
            if run > 1 and options[0][0] is not None:
                options.append((None, COST_DROP if run > 2 else COST_DROP_SECOND))
            out.append(options)
            previous = char
        return out

    def decode(self, stretch: str) -> str:
        """The most likely reading, in lower case."""
        if stretch in self.known:
            return self.known[stretch]
        # a path is its last letter and the path before it, so that long stretches cost no copies
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in self.lattice(stretch):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in best.items():
                row = self.costs[a][b]
                for symbol, price in options:
                    if symbol is None:
                        state, total, read = (a, b), cost + price, path
                    else:
                        state, total = (b, symbol), cost + price + row[symbol]
                        read = (" " if symbol == 0 else "?" if symbol == _OTHER else chr(96 + symbol), path)
                    if state not in after or total < after[state][0]:
                        after[state] = (total, read)
            best = after
        path = min(((cost + self.costs[a][b][0], path) for (a, b), (cost, path) in best.items()), key=lambda x: x[0])[1]
        letters = []
        while path is not None:
            letters.append(path[0])
            path = path[1]
        read = "".join(reversed(letters))
        if len(self.known) < 50_000 and len(stretch) < 100:
            self.known[stretch] = read
        return read

    def stretches(self, text: str) -> list[tuple[int, int]]:
        """Where a text looks disguised: (start, end), sorted, apart."""
        found = [m.span() for m in SPELLED.finditer(text)]
        for pattern in (DISGUISED, DRAWN_OUT):
            at = 0
            for m in pattern.finditer(text):
                if m.start() < at:
                    continue
                a, b = m.span()
                while a > at and (text[a - 1].isalnum() or text[a - 1] in SIGNS):
                    a -= 1
                while b < len(text) and (text[b].isalnum() or text[b] in SIGNS and text[b : b + 2][1:].isalnum()):
                    b += 1
                at = b
                found.append((a, b))
        found.sort()
        apart: list[tuple[int, int]] = []
        for a, b in found:
            if not apart or a >= apart[-1][1]:
                apart.append((a, b))
        return apart

    def restore(self, text: str) -> str:
        """`text` with its disguised stretches as they read."""
        out, at = [], 0
        for a, b in self.stretches(text):
            out += [text[at:a], self.decode(text[a:b])]
            at = b
        return "".join([*out, text[at:]])

    def words(self, text: str) -> set[str]:
        """Words of a text and of its restored form, in lower case; spelled-out stretches also as a whole, marked ~."""
        words = set(WORDS.findall(text.lower()))
        for a, b in self.stretches(text):
            read = WORDS.findall(self.decode(text[a:b]))
            words.update(read)
            if len(read) > 1 or SPELLED.fullmatch(text, a, b):
                words.add("~" + "".join(read))  # with one separator throughout, where words end is a guess
        return words


def features(words: set[str]) -> set[str]:
    """Words, marked =, and word beginnings of 3 to 5 letters."""
    words = {w for w in words if w[0] != "~"}
    out = {"=" + w for w in words}
    for n in (3, 4, 5):
        out.update(w[:n] for w in words if len(w) >= n)
    return out


@dataclass
class Model:
    """What scoring needs: bounded tables, sent with the tasks."""

    costs: np.ndarray
    weights: dict[str, float]
    bias: float

    def restorer(self) -> Restorer:
        if "_restorer" not in self.__dict__:
            self._restorer = Restorer(self.costs)
        return self._restorer

    def hits(self, words: set[str]) -> set[str]:
        if "_kinds" not in self.__dict__:
            known = {w[1:] for w in self.weights if w[0] == "="}
            self._kinds = (known, [{w for w in self.weights if w[0] != "=" and len(w) == n} for n in (3, 4, 5)], sorted({len(w) for w in known} - {1, 2, 3}))
        known, beginnings, lengths = self._kinds
        whole = {w for w in words if w[0] == "~"}
        inside = {w[i : i + n] for w in whole for n in lengths for i in range(1, len(w) - n + 1)} & known
        words = (words - whole) | inside
        out = {"=" + w for w in words & known}
        for n, some in zip((3, 4, 5), beginnings, strict=True):
            if some:
                out |= {w[:n] for w in words} & some
        return out

    def score(self, words: set[str]) -> float:
        return 1 / (1 + math.exp(-self.bias - sum(sorted(self.weights[x] for x in self.hits(words)))))


def fit_rows(labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """(doc_id, toxic) of the labelled rows to fit on, held-out ones left out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.where(~held_out(F.col("doc_id"))).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _regression(rows: list[tuple[list[int], int]], n: int, rounds: int = 400, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 rows by accelerated gradient steps."""
    y = np.array([t for _, t in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    to = np.array([i for x, _ in rows for i in x], np.int64)
    w, b = np.zeros(n), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    vw, vb, mw, mb = np.zeros(n), 0.0, np.zeros(n), 0.0
    for step in range(1, rounds + 1):
        z = b + np.bincount(at, w[to], len(rows))
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw, gb = np.bincount(to, g[at], n) / len(rows) + decay * w, float(g.mean())
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        vw, vb = 0.999 * vw + 0.001 * gw * gw, 0.999 * vb + 0.001 * gb * gb
        rate, c1, c2 = 0.05, 1 - 0.9**step, 1 - 0.999**step
        w = w - rate * (mw / c1) / (np.sqrt(vw / c2) + 1e-8)
        b = b - rate * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, most: int = FIT_ROWS) -> Model:
    """Count characters over all of `corpus` (or `docs`), then fit on labelled rows of `docs`."""
    costs = character_costs(count_trigrams(docs if corpus is None else corpus))
    rows = F.broadcast(fit_rows(labels, most))  # at most `most` rows
    sample = materialise(docs.select("doc_id", "text").join(rows, "doc_id"), "labelled").select("text", F.col("toxic").cast("int").alias("toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list({**seen[0], **seen[1]})
            pairs = [pa.array([c[x] for x in names], pa.int64()) for c in seen]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *pairs], names=["feature", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[int(toxic > 0)].update(features(restorer.words(text or "")))
                if len(seen[0]) + len(seen[1]) > HELD:
                    yield out()
                    for c in seen:
                        c.clear()
        yield out()

    kinds = {r.toxic > 0: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = kinds.get(True, 0), kinds.get(False, 0)
    if not n1 or not n0:
        share = n1 / max(1, n1 + n0)
        return Model(costs, {}, math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    counted = sample.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = (F.col("toxic") / F.lit(float(n1))) / ((F.col("clean") + 0.5) / F.lit(float(n0)))
    strong = counted.where((F.col("toxic") >= LEAST_DOCS) & (ratio >= LEAST_RATIO)).orderBy((F.col("toxic") * F.log(ratio)).desc(), "feature").limit(FEATURES)
    names = [r.feature for r in strong.collect()]
    place = {x: i for i, x in enumerate(names)}
    probe = Model(costs, dict.fromkeys(names, 0.0), 0.0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        for batch in batches:
            hits = [sorted(place[x] for x in probe.hits(restorer.words(t or ""))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), batch.column(1)], names=["hits", "toxic"])

    found = sample.mapInArrow(vectors, "hits array<int>, toxic int").collect()  # at most `most` short rows
    rows_ = sorted((list(r.hits), int(r.toxic > 0)) for r in found)
    weights, bias = _regression(rows_, len(names))
    return Model(costs, {x: round(float(w), 9) for x, w in zip(names, weights, strict=True)}, round(bias, 9))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with a column `score`; only the texts go through Python."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        restorer = model.restorer()
        return pd.Series([model.score(restorer.words(t)) if t else model.score(set()) for t in texts], dtype="float64")

    return docs.withColumn("score", score(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
