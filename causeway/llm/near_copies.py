"""Near copies by SimHash and exact resemblance: five-word shingles, 0.8 or more alike.

Two texts link where their sets of shingles have a Jaccard similarity of 0.8
or more; a group is a component of links. Two sets that are 0.8 alike differ
in about 10 of 64 bits of their SimHash, which no covering code of useful size
reaches, so SimHash proposes and does not decide: fingerprints of five-word
shingles within 2 bits, found by anchor points as in simhash, are the first
candidates, and a search by shared shingles completes them. Every candidate
is verified on the whole sets.

The completing search loses no link. In any one total order of shingles two
such sets share one among the first n - ceil(0.8 n) + 1 of each, so sets are
compared where they share one of these, and only if their sizes and the places
of the shared one allow for 0.8. The order puts shingles last that are common
in a sample, which decides how many candidates there are and not which links
are found. Counts of shingles in 64 classes bound the difference of two sets
from below and rule out most candidates before texts are read.

Equal sets are one node. Candidates are verified in two rounds: each set with
its fingerprint's links and the next few of a shared shingle first, then all
that are still in different components, so that a large group of near copies
isn't compared pair by pair. Sketches go where shingles meet, so a pair that
they rule out is never a row.

Defined results: words are those of the fingerprints of simhash; a text of up
to five words is one shingle; null or empty texts have no shingle and are
alike; shingles and equal sets are told by 64 bits of hashes; of repeated rows
one stays; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches
from .simhash import SEED, bit_majority, components, keep_first, wrapped
from .simhash import links as within_bits

SHINGLE = 5
#: Sets are alike from PART / WHOLE on.
PART, WHOLE = 4, 5
#: One of so many documents is looked at for common shingles, which are in so many of these; the commonest are known.
SAMPLE, COMMON, KNOWN = 16, 4, 1 << 16
#: Places after a set's own, among those with the same shingle, that the first round compares.
NEXT = 3
#: Shingles come from hashes of their words, each times one of these.
FACTORS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
#: Pairs of a batch.
PAIRS = 1 << 16
#: Classes in which shingles are counted.
CLASSES = 64


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted unsigned numbers."""
    import xxhash

    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    hashes = np.array([digest(w, SEED) for w in words], np.uint64)
    n = len(words) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        part = hashes[k : k + n] * FACTORS[k]
        out += part ^ (part >> np.uint64(29))
    return np.unique(out)


def sketch(found: np.ndarray) -> bytes:
    """How many shingles are in each class, up to 255."""
    return np.minimum(np.bincount((found % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes()


def sketched(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets with these sketches, and so many shingles together, may be alike."""
    apart = np.abs(x.astype(np.int16) - y.astype(np.int16)).sum(axis=1, dtype=np.int64)  # at most what is in one set only
    return apart * (PART + WHOLE) <= sizes * (WHOLE - PART)


def _common(rows: DataFrame) -> dict[int, int]:
    """How often the commonest shingles are in a sample of `rows` (_row, _text), at most KNOWN of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys = np.concatenate([shingles(t.as_py()) for t in batch.column(0).slice(at, 256)])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    sample = rows.where(F.pmod(F.xxhash64("_row"), F.lit(SAMPLE)) == 0).select("_text")
    counts = sample.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return {r.key: r.n for r in counts.orderBy(F.col("n").desc(), "key").limit(KNOWN).collect()}


def _prints(rows: DataFrame, common: dict[int, int]) -> DataFrame:
    """(_id, _row, node, n, fp, sketch, first) of `rows` (_id, _row, _text): hash, size, SimHash and classes of the set, and its first shingles in the order."""
    known = np.array(sorted(common), np.int64)
    often = np.array([common[k] for k in known.tolist()], np.int64)

    def first(key: np.ndarray) -> bytes:
        n = len(key)
        if n and len(known):
            i = np.minimum(np.searchsorted(known, key), len(known) - 1)
            key = key[np.lexsort((key, np.where(known[i] == key, often[i], 0)))]
        return key[: n - -(-PART * n // WHOLE) + 1 if n else 0].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                nodes, sizes, prints, classes, firsts = [], [], [], [], []
                for text in part.column(2):
                    found = shingles(text.as_py())
                    nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                    sizes.append(len(found))
                    prints.append(bit_majority(found))
                    classes.append(sketch(found))
                    firsts.append(first(found.view(np.int64)))
                columns = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(classes, pa.binary()), pa.array(firsts, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], names=["_id", "_row", "node", "n", "fp", "sketch", "first"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_id", "_row", "_text").mapInArrow(run, f"_id {kind}, _row long, node long, n int, fp long, sketch binary, first binary")


def _members(nodes: DataFrame) -> DataFrame:
    """(key, n, node, at): first shingles of `nodes` (node, n, first) that several have, with the set's size and their places."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                keys = [np.frombuffer(x.as_py(), np.int64) for x in part.column(2)]
                sizes = [len(k) for k in keys]
                node, n = (np.repeat(part.column(i).to_numpy(), sizes) for i in range(2))
                at = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.concatenate(keys), n, node, at)], names=["key", "n", "node", "at"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None  # a batch's last row waits for the next one's first key
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            key = rows.column(0).to_numpy()
            same = key[1:] == key[:-1]
            keep = np.concatenate([[key[0] == before], same]) | np.concatenate([same, [False]])
            yield rows.slice(0, len(key) - 1).filter(pa.array(keep[:-1]))
            before = key[-2] if len(key) > 1 else before
            held = rows.slice(len(key) - 1)
        if held is not None and held.column(0)[0].as_py() == before:
            yield held

    schema = "key long, n int, node long, at int"
    rows = nodes.select("node", "n", "first").mapInArrow(spread, schema)
    return rows.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(shared, schema)


def _pairs(members: DataFrame, first: int, last: int | None) -> DataFrame:
    """Candidates (a, b) among `members` (key, n, node, at, root, sketch), `first` to `last` places from each other by key and size.

    Pairs whose sketches rule them out are none.
    """

    def possible(rows, other, n, at, root, classes) -> np.ndarray:
        most = np.minimum(n[rows] - at[rows], n[other] - at[other])
        near = (most * (PART + WHOLE) >= PART * (n[rows] + n[other])) & (root[rows] != root[other])
        chosen = np.flatnonzero(near)
        for i in range(0, len(chosen), PAIRS):
            some = chosen[i : i + PAIRS]
            x, y = rows[some], other[some]
            near[some] = sketched(classes[x], classes[y], n[x] + n[y])
        return near

    def compared(key, n, node, at, root, classes) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(start, len(key)))
        end = np.repeat(start + sizes, sizes)
        mixed = np.repeat(np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start), sizes)
        rows, step, found, held = np.flatnonzero(mixed), first, [], 0
        while last is None or step <= last:
            rows = rows[rows + step < end[rows]]
            # sizes ascend: what is too large now stays so
            rows = rows[n[rows + step] * PART <= n[rows] * WHOLE]
            if not len(rows):
                break
            other = rows + step
            near = possible(rows, other, n, at, root, classes)
            a, b = node[rows[near]], node[other[near]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
            held += len(a)
            step += 1
            if held >= PAIRS:
                yield out(found)
                found, held = [], 0
        if held:
            yield out(found)

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        links = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy().astype(np.int64) for i in range(5)]
            columns.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, CLASSES))
            if not held or columns[0][-1] == held[-1][0][0] == held[-1][0][-1]:  # one key goes on
                held.append(columns)
                continue
            columns = [np.concatenate(c) for c in zip(*held, columns, strict=True)]
            cut = int(np.flatnonzero(columns[0] == columns[0][-1])[0])
            if cut:
                yield from compared(*(c[:cut] for c in columns))
            held = [[c[cut:] for c in columns]]
        if held:
            yield from compared(*(np.concatenate(c) for c in zip(*held, strict=True)))

    dealt = members.select("key", "n", "node", "at", "root", "sketch").repartition("key").sortWithinPartitions("key", "n", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _by_print(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) among `nodes` (node, fp): sets with equal fingerprints, or with fingerprints that link."""
    first = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    equal = nodes.join(first, "fp").where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b"))
    side = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}"))
    linked = within_bits(first.select("fp")).join(side("a"), "a").join(side("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return equal.unionByName(linked)


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose sketches in `nodes` (node, n, sketch) allow for alike sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, CLASSES) for c in batch.columns[4:])
                yield batch.select([0, 1]).filter(pa.array(sketched(x, y, sizes)))

    side = lambda c, x: nodes.select(F.col("node").alias(c), F.col("n").cast("long").alias(f"n{x}"), F.col("sketch").alias(x))
    both = pairs.distinct().join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "nx", "ny", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def _alike(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose sets are alike; `nodes` (node, _row) name a row of `rows` (_row, _text) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = (None, None)  # rows come by b
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if known[0] != b:
                    known = (b, shingles(y.as_py()))
                x, y = shingles(x.as_py()), known[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * (PART + WHOLE) >= PART * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialise(pairs.distinct(), "pairs")
    sides = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialise(nodes.select("node", "_row").join(sides, "node"), "wanted")
    # repeated rows have one text; texts travel, since the sets are larger
    texts = rows.select("_row", "_text").join(wanted, "_row").dropDuplicates(["node"])
    left = texts.select(F.col("node").alias("a"), F.col("_text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("_text").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    alike = materialise(both.mapInArrow(run, "a long, b long"), "links")
    discard(pairs)
    discard(wanted)
    return alike


def links(prints: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) that connect all sets of `prints` (_row, node, n, fp, sketch, first) that are alike; texts are in `rows` (_row, _text)."""
    few = prints.groupBy("node").agg(F.min("_row").alias("_row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"))
    nodes = materialise(few, "sets")
    held = materialise(_members(prints.select("node", "n", "first").dropDuplicates(["node"])), "members")
    sketches = nodes.select(F.col("node").alias("_of"), "sketch")
    members = held.join(sketches, F.col("node") == F.col("_of")).drop("_of")
    next_ = _pairs(members.withColumn("root", F.col("node")), 1, NEXT)
    near = _alike(next_.unionByName(_possible(_by_print(nodes), nodes)), nodes, rows)
    roots = materialise(components(near), "roots").withColumnRenamed("node", "_node")
    rooted = members.join(roots, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node"))
    far = _alike(_pairs(rooted, NEXT + 1, None), nodes, rows)
    discard(held)
    return near.unionByName(far)


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group: the smallest doc_id, of repeated rows the first."""
    small_batches(docs.sparkSession)
    rows = wrapped(docs)
    prints = materialise(_prints(rows, _common(rows)), "prints")
    roots = materialise(components(links(prints, rows)), "roots").withColumnRenamed("node", "_node")
    rooted = prints.join(roots, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node"))
    kept = keep_first(rows, rooted.select("_id", "_row", "root"))
    discard(prints)
    return kept
