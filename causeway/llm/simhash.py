"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at up to 2 differing bits. Of two such
fingerprints one half of 32 bits differs in at most 1. On 31 bits of a half
the codewords of the perfect Hamming code [31, 26] are the anchors: every word
is within covering radius 1 of one. Each distinct fingerprint is replicated to
all anchors within radius plus threshold, 2, which are 16 (or 1 for a
codeword), and fingerprints are compared only per anchor: two halves that
differ in at most a bit share an anchor, so no link is lost.

An anchor with very many fingerprints is not compared pair by pair: its
members go by their 65 midpoints, the words within 1 bit. Two fingerprints
link if and only if they share one, and a midpoint has at most 65 members.
Components come from rounds of large-star and small-star contraction over the
distinct fingerprints, each round written to the shared folder.

Defined results: a null or empty text has fingerprint zero and links like any
other; rows with equal doc_id are documents of their own; a null doc_id never
is the smallest of a component that has others; an empty table gives an
empty result; very long texts are hashed whole; other columns are kept by
one_of_each() and else not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

SHINGLE = 3
DISTANCE = 2
SEED = 42
#: Members from which an anchor goes by midpoints.
CROWDED = 256
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text, as a signed 64-bit number."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return bit_majority(np.array(hashes, np.uint64))


def bit_majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """(*keep, fp) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp, pa.int64())], names=[*keep, "fp"])

    rows = docs.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    return rows.mapInArrow(run, f"{schema}, fp long")


def anchors(half: Column) -> Column:
    """All codewords within 2 bits of the 31 low bits of `half`.

    A word's syndrome s is the xor of the places (from 1) of its bits. The
    codewords within 2 flips are those by flipping i and j with i xor j = s,
    place 0 standing for no flip.
    """
    word = half.bitwiseAND(F.lit((1 << 31) - 1))
    syndrome = F.lit(0)
    for k in range(5):
        mask = sum(1 << (place - 1) for place in range(1, 32) if place >> k & 1)
        syndrome = syndrome + F.bit_count(word.bitwiseAND(F.lit(mask))) % 2 * (1 << k)
    flips = F.array(*(F.lit(1 << place >> 1).cast("long") for place in range(32)))
    places = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: i < i.bitwiseXOR(syndrome))
    near = F.transform(
        places, lambda i: word.bitwiseXOR(F.element_at(flips, i + 1)).bitwiseXOR(F.element_at(flips, i.bitwiseXOR(syndrome) + 1))
    )
    return F.when(syndrome == 0, F.array(word)).otherwise(near)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the rows of each anchor, rows being sorted by it; a crowd is passed on as (fp, null)."""

    def out(a: np.ndarray, b: np.ndarray, crowd: np.ndarray) -> pa.RecordBatch:
        left, right = np.concatenate([a, crowd]), np.concatenate([b, np.zeros(len(crowd), np.int64)])
        missing = np.arange(len(left)) >= len(a)
        return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right, mask=missing)], names=["a", "b"])

    def compared(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(first, len(key)))
        crowded = np.repeat(sizes > CROWDED, sizes)
        end = np.repeat(first + sizes, sizes)
        found = [np.empty((0, 2), np.int64)]
        rows = np.flatnonzero((np.repeat(sizes, sizes) > 1) & ~crowded)
        step = 1
        while len(rows := rows[rows + step < end[rows]]):
            near = np.bitwise_count((fp[rows] ^ fp[rows + step]).view(np.uint64)) <= DISTANCE
            found.append(np.stack([fp[rows[near]], fp[rows[near] + step]], axis=1))
            step += 1
        links = np.unique(np.concatenate(found), axis=0)
        return out(links[:, 0].copy(), links[:, 1].copy(), fp[crowded])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    crowd_key: int | None = None  # the anchor at hand is known to be crowded: nothing of it is held
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        fp = batch.column(1).to_numpy(zero_copy_only=False)
        if crowd_key is not None:
            same = int(np.searchsorted(key != crowd_key, True)) if (key != crowd_key).any() else len(key)
            yield out(fp[:0], fp[:0], fp[:same])
            key, fp = key[same:], fp[same:]
            if not len(key):
                continue
            crowd_key = None
        held.append((key, fp))
        key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        last = int(np.flatnonzero(key == key[-1])[0])
        if last:
            yield compared(key[:last], fp[:last])
        key, fp = key[last:], fp[last:]
        if len(key) > CROWDED:
            yield out(fp[:0], fp[:0], fp)
            crowd_key, held = int(key[0]), []
        else:
            held = [(key, fp)]
    if held:
        yield compared(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all of `distinct` (fp) within 2 bits of each other."""
    low = F.col("fp").bitwiseAND(F.lit((1 << 32) - 1))
    high = F.shiftrightunsigned("fp", 32)
    # bit 32 of the key tells the half; anchors have 31 bits
    keys = F.concat(anchors(low), F.transform(anchors(high), lambda x: x.bitwiseOR(F.lit(1 << 32))))
    spread = distinct.select(F.explode(keys).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    found = materialise(spread.mapInArrow(_compare, "a long, b long").distinct(), "links")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    crowd = found.where("b is null").select(F.col("a").alias("fp"))
    middles = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    groups = middles.groupBy("middle").agg(F.sort_array(F.collect_list("fp")).alias("near")).where(F.size("near") > 1)
    more = groups.select(F.col("near")[0].alias("a"), F.explode(F.slice("near", 2, 65)).alias("b")).distinct()
    return found.where("b is not null").unionByName(more)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b), the root being the smallest node of its component."""
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    star = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(star)
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.unionByName(star.join(least.withColumnRenamed("a", "x"), F.col("a") == F.col("x")).select("a", F.col("m").alias("b"))).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = materialise(small.where("a > b").distinct(), "edges")
        now = state(after)
        discard(star)
        star = after
        if now == before:
            break
        before = now
    roots = star.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def grouped(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """`prints` (key, fp, ...) with root (a fingerprint) and component_id, the smallest key, added."""
    by_print = materialise(prints.groupBy("fp").agg(F.min(key).alias("first_id")), "distinct")
    roots = components(links(by_print.select("fp")))
    rooted = by_print.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = rooted.select("fp", "root").join(smallest, "root")
    return prints.join(known, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    prints = materialise(fingerprints(docs, shingle=shingle), "prints")
    return grouped(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def wrapped(docs: DataFrame) -> DataFrame:
    """(_doc, _row, _id, _text): each row of `docs` as a whole, a hash of it, its id and text."""
    return docs.select(F.struct(*docs.columns).alias("_doc"), F.xxhash64(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """`docs` with one document of each group: the smallest doc_id, of repeated rows the first."""
    rows = wrapped(docs)
    prints = materialise(fingerprints(rows, ("_id", "_row"), shingle, "_text"), "prints")
    return keep_first(rows, grouped(prints, "_id"))


def keep_first(rows: DataFrame, rooted: DataFrame) -> DataFrame:
    """Of `rows` (wrapped) the first of each root of `rooted` (_id, _row, root), as it was."""
    first = F.struct(F.col("_id").isNull().alias("n"), "_id", "_row")
    same = rooted.groupBy("root", "_id", "_row").agg(F.count("*").alias("copies"))
    kept = same.groupBy("root").agg(F.min_by("copies", first).alias("_copies"), F.min(first).alias("k"))
    kept = materialise(kept.select(F.col("k._row").alias("_kept"), F.col("k._id").alias("_first"), "_copies"), "kept")
    joined = rows.join(kept, (F.col("_row") == F.col("_kept")) & F.col("_id").eqNullSafe(F.col("_first")))
    # only rows that are repeated as a whole have to meet each other
    once, again = joined.where("_copies = 1"), joined.where("_copies > 1").dropDuplicates(["_row", "_id"])
    return once.select("_doc.*").unionByName(again.select("_doc.*"))
