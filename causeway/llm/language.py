"""Language identification by bit-sliced Bloom filters of letter trigrams.

Each language has a Bloom filter of the trigrams that its documents use. All
filters share their hash functions and lie side by side, so that position i
holds bit i of every filter: reading a trigram's positions and joining them by
AND gives the set of all languages that contain it, in one look-up. A text's
trigrams are counted per language from these masks, and since a filter that is
filled to f at k hash functions also answers yes for a share f^k of foreign
trigrams, the counts are corrected for that. The largest corrected count
decides; its score is its share of the two largest.

Trigrams are of lower-case letters with word bounds; digits and signs are
bounds. A language contains a trigram if at least LEAST_SHARE of its training
documents have it, and not RATIO times less of them than of another language's
(a foreign line here and there makes no trigram a language's own). Documents
are counted, not places, over all training rows. The shares of a language's
trigrams add up to the mean number of different trigrams of a document, so a
filter holds at most that number over LEAST_SHARE of them at any size of the
corpus.

Every language is learned, from one training row on. A rare one, with less
than 1 in RARE of the training rows, takes no trigram from others, since its
shares are of few documents. Filters that make up more than TABLE_BYTES side
by side lie in several tables. Documents then go by one table after another,
and the counts of all tables decide as those of one would: what is sent to a
task is bounded, and no language is left out. The driver holds the names and
counts of languages, and one table.

Training rows have a text, a lang and a doc_id whose crc32 isn't 2 modulo 4;
rows without doc_id are training rows. Of a text nothing but its characters
enters a prediction.

Defined results: a null text and one without letters is und, at score 0; a text none of whose trigrams is known has the most frequent language
at score 0, and ties go to the more frequent language; without training rows
all texts are und; repeated rows and null ids are rows like others; texts are
read whole, long ones in stretches; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .toxicity import held_out

UNKNOWN = "und"
#: Least share of a language's training documents with a trigram, and of the largest such share.
LEAST_SHARE, RATIO = 1 / 200, 0.2
RARE = 256
#: Bytes of the filters that lie side by side in one table; a single filter may have more.
TABLE_BYTES = 1 << 25
#: Bytes of masks that are held at once.
MASK_BYTES = 1 << 23
HASHES, POSITIONS_EACH = 4, 12
#: Positions in one row of the table that the filters are collected from.
BLOCK = 4096
#: Code points that are turned into trigrams at once.
STRETCH = 1 << 19
#: Trigrams that a task counts before it passes them on.
HELD = 500_000

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """The lower-case letter of each code point, 0 for what is no letter; made once per process."""
    if not _LETTERS:
        table = np.zeros(0x110000, np.uint64)
        for code in range(len(table)):
            char = chr(code)
            if char.isalpha():
                table[code] = ord(char.lower()[0])
        _LETTERS.append(table)
    return _LETTERS[0]


def trigrams(text: str) -> Iterator[np.ndarray]:
    """The trigrams around each letter of `text`, as 63-bit numbers, in stretches."""
    table = letters()
    for at in range(0, len(text), STRETCH):
        part = text[max(0, at - 1) : at + STRETCH + 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.zeros(len(codes) + 2, np.uint64)
        chars[1:-1] = table[codes]
        # a stretch gives those around its own characters; its neighbours' only serve as context
        first = 1 + (at > 0)
        middle = np.arange(first, first + min(STRETCH, len(text) - at))
        middle = middle[chars[middle] > 0]
        yield (chars[middle - 1] << np.uint64(42)) | (chars[middle] << np.uint64(21)) | chars[middle + 1]


def distinct(text: str) -> np.ndarray:
    parts = [np.unique(x) for x in trigrams(text)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))


def positions(grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """HASHES positions of each trigram in a filter of `size`, a power of two."""
    x = grams.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # finaliser of splitmix64
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    step = (x >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield ((x + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)


@dataclass
class Filters:
    """Bloom filters of languages, side by side: table[position, i // 8] has bit i % 8 of language i; the more frequent language comes first."""

    languages: list[str]
    table: np.ndarray

    def __post_init__(self):
        filled = np.unpackbits(self.table, axis=1, bitorder="little")[:, : len(self.languages)].mean(axis=0, dtype=np.float64) if self.table.size else np.zeros(len(self.languages))
        self.false = filled**HASHES  # share of foreign trigrams that a filter seems to contain

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Per trigram the languages that contain it, as bits."""
        out = None
        for at in positions(grams, len(self.table)):
            out = self.table[at] if out is None else out & self.table[at]
        return out

    def counts(self, text: str) -> tuple[int, np.ndarray]:
        """Trigrams of a text, and how many of them each language contains, corrected for false answers."""
        total, seen = 0, np.zeros(self.table.shape[1] * 8, np.int64)
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
        most = max(1, MASK_BYTES // max(1, self.table.shape[1]))
        for stretch in trigrams(text):
            total += len(stretch)
            for at in range(0, len(stretch), most):
                masks = self.masks(stretch[at : at + most])
                for i in range(masks.shape[1]):
                    seen[8 * i : 8 * i + 8] += np.bincount(masks[:, i], minlength=256) @ bits
        found = seen[: len(self.languages)]
        return total, np.maximum(0.0, (found - self.false * total) / (1 - self.false))

    def largest(self, text: str | None) -> tuple[int, float, float] | None:
        """The language of the largest count, by its place here, with this count and the next one; none without letters."""
        if not text or not self.languages:
            return None
        total, counts = self.counts(text)
        if not total:
            return None
        best = int(counts.argmax())
        return best, float(counts[best]), float(np.delete(counts, best).max(initial=0.0))

    def predict(self, text: str | None) -> tuple[str, float]:
        if (found := self.largest(text)) is None:
            return UNKNOWN, 0.0
        best, top, second = found
        return self.languages[best], round(top / (top + second), 9) if top > 0 else 0.0


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")


def document_counts(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(lang, gram, n): documents of a language (by its place) with a trigram."""
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            langs = np.concatenate([np.zeros(0, np.int32), *(np.full(len(g), i, np.int32) for i, (g, _) in held.items())])
            grams, counts = (np.concatenate([np.zeros(0, np.int64), *(x[j].astype(np.int64) for x in held.values())]) for j in (0, 1))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])

        for batch in batches:
            new: dict[int, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                if (i := place.get(lang.as_py())) is not None:
                    new.setdefault(i, []).append(distinct(text.as_py()))
            for i, parts in new.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                if i in held:
                    grams, at = np.unique(np.concatenate([held[i][0], grams]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([held[i][1], n])).astype(np.int64)
                held[i] = (grams, n)
            if sum(len(g) for g, _ in held.values()) > HELD:
                yield out()
        yield out()

    counted = rows.select("text", "lang").mapInArrow(run, "lang int, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def contained(counts: DataFrame, known: DataFrame) -> DataFrame:
    """(gram, langs): the languages that contain each trigram; `known` (lang, documents, rare) are all languages."""
    own = counts.join(known, "lang").withColumn("share", F.col("n") / F.col("documents")).where(F.col("share") >= LEAST_SHARE)
    top = F.max(F.when(~F.col("rare"), F.col("share")))
    per = own.groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("all"), F.coalesce(top, F.lit(0.0)).alias("top"))  # an item per language
    return per.select("gram", F.transform(F.filter("all", lambda x: x["share"] >= RATIO * F.col("top")), lambda x: x["lang"]).alias("langs"))


def dealt(most: list[int]) -> list[tuple[int, list[int]]]:
    """Tables of filters as (positions, languages), for languages with so many trigrams: at most TABLE_BYTES each, or one language."""
    tables: list[tuple[int, list[int]]] = []
    for lang in sorted(range(len(most)), key=lambda i: (-most[i], i)):
        if not tables or tables[-1][0] * (len(tables[-1][1]) // 8 + 1) > TABLE_BYTES:
            tables.append((max(BLOCK, 1 << (POSITIONS_EACH * max(1, most[lang]) - 1).bit_length()), []))
        tables[-1][1].append(lang)
    return [(size, sorted(langs)) for size, langs in tables]


def filled(grams: DataFrame, size: int, langs: list[int]) -> np.ndarray:
    """The table of `langs`, whose trigrams are in `grams` (gram, langs)."""
    width = (len(langs) + 7) // 8
    places = np.array(langs, np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lang = lists.flatten().to_numpy()
            gram = np.repeat(batch.column(0).to_numpy().astype(np.uint64), np.diff(lists.offsets.to_numpy()))
            here = np.minimum(np.searchsorted(places, lang), len(places) - 1)
            mine = places[here] == lang
            one = pa.array(here[mine].astype(np.int32))
            for at in positions(gram[mine], size):
                yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK), pa.array(at % BLOCK), one], names=["block", "at", "lang"])

    def sliced(group: pa.Table) -> pa.Table:
        table = np.zeros((BLOCK, width), np.uint8)
        one = group.column("lang").to_numpy()
        np.bitwise_or.at(table, (group.column("at").to_numpy(), one // 8), (1 << (one % 8)).astype(np.uint8))
        return pa.table({"block": group.column("block").slice(0, 1), "bits": pa.array([table.tobytes()])})

    blocks = grams.mapInArrow(placed, "block long, at long, lang int").groupBy("block").applyInArrow(sliced, "block long, bits binary")
    table = np.zeros((size, width), np.uint8)
    for row in blocks.collect():
        table[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.bits, np.uint8).reshape(BLOCK, width)
    return table


def tables(docs: DataFrame) -> Iterator[tuple[list[int], Filters]]:
    """Filters of the languages of all training rows of `docs`, a table at a time, with the places of its languages by frequency."""
    spark, rows = docs.sparkSession, training_rows(docs)
    counted = sorted(((r.n, r.lang) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()), key=lambda x: (-x[0], x[1]))
    if not counted:
        yield [], Filters([], np.zeros((1, 0), np.uint8))
        return
    total = sum(n for n, _ in counted)
    known = spark.createDataFrame([(i, n, n * RARE < total) for i, (n, _) in enumerate(counted)], "lang int, documents long, rare boolean")
    grams = materialise(contained(document_counts(rows, [x for _, x in counted]), known), "trigrams")
    most = [0] * len(counted)
    for r in grams.select(F.explode("langs").alias("lang")).groupBy("lang").count().collect():
        most[r.lang] = r["count"]
    for size, langs in dealt(most):
        yield langs, Filters([counted[i][1] for i in langs], filled(grams, size, langs))
    discard(grams)


def fit(docs: DataFrame) -> Filters:
    """Filters of the languages of all training rows of `docs`, which must fit one table."""
    (_, filters), *more = tables(docs)
    if more:
        raise ValueError("the filters of these languages take several tables")
    return filters


def predicted(docs: DataFrame, filters: Filters) -> DataFrame:
    """`docs` with lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([filters.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("_said", predict(F.col("text"))).withColumns({"lang_pred": F.col("_said.lang_pred"), "score": F.col("_said.score")}).drop("_said")


def _largest(texts: DataFrame, places: list[int], filters: Filters) -> DataFrame:
    """(key, lang, name, top, second) of `texts` (key, text) by one table, for texts with letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, *x) for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if (x := filters.largest(t.as_py()))]
            key, best, top, second = zip(*found, strict=True) if found else ([],) * 4
            columns = [pa.array(key, pa.string()), pa.array([places[i] for i in best], pa.int32()), pa.array([filters.languages[i] for i in best], pa.string()), pa.array(top, pa.float64()), pa.array(second, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "lang", "name", "top", "second"])

    return texts.mapInArrow(run, "key string, lang int, name string, top double, second double")


def predicted_by_several(docs: DataFrame, several: Iterable[tuple[list[int], Filters]]) -> DataFrame:
    """As predicted(), by the counts of several tables: the largest of all, and the next one in any table."""
    keyed = docs.withColumn("_key", F.sha2("text", 256))
    texts = keyed.where(F.col("text").isNotNull()).select(F.col("_key").alias("key"), "text")
    found = None
    for places, filters in several:
        one = _largest(texts, places, filters)
        found = one if found is None else found.unionByName(one)
    # equal texts have equal counts; a list has an item per table
    alone = found.groupBy("key", (-F.col("lang")).alias("rank")).agg(*(F.first(c).alias(c) for c in ("name", "top", "second")))
    best = alone.groupBy("key").agg(F.max(F.struct("top", "rank", "name")).alias("best"), F.collect_list(F.struct("rank", "top", "second")).alias("all"))
    next_ = F.array_max(F.transform("all", lambda x: F.greatest(x["second"], F.when(x["rank"] != F.col("best.rank"), x["top"]).otherwise(0.0))))
    top = F.col("best.top")
    said = best.select("key", F.col("best.name").alias("_name"), F.when(top > 0, F.round(top / (top + next_), 9)).otherwise(0.0).alias("_score"))
    joined = keyed.join(said, F.col("_key") == F.col("key"), "left")
    return joined.withColumns({"lang_pred": F.coalesce("_name", F.lit(UNKNOWN)), "score": F.coalesce("_score", F.lit(0.0))}).drop("_key", "key", "_name", "_score")


def identified(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    read = docs.select("doc_id", "text")
    every = tables(docs)
    first, second = next(every), next(every, None)
    out = predicted(read, first[1]) if second is None else predicted_by_several(read, chain([first, second], every))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
