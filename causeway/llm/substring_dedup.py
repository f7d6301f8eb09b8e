"""Exact removal of repeated 200-byte strings, by suffix arrays over shards.

Every 200-byte window holds a smallest 32-byte hash, and equal windows hold
the same. Consecutive windows with the same smallest place form a run, and
runs are dealt by that hash: windows can only be equal inside one group. A run
whose bytes, run for run, occur again repeats throughout. Where a group has
runs with different bytes, their contexts are joined into shards of bounded
size; a suffix array (induced sorting) and the common prefixes of neighbours,
taken in text order, tell which windows repeat. All comparisons that decide a
shard are of bytes; equal runs are told by 128 bits of hashes.

Groups stay small: a task passes on at most two runs of each kind and knows
further ones to be repeats, and texts that it saw twice it skips, results
being kept per distinct text. A group with more than CROWDED different runs
goes by 128-bit hashes of its single windows, which spread over all tasks.

Defined results: a null text is empty; texts under 200 bytes keep all; copies
of a text, repeated rows too, repeat as a whole; null ids are ids like others;
texts are read whole; an empty table gives an empty result; other columns, of
any name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .suffix_array import common_prefix, suffix_array, words_at

LENGTH = 200
#: Bytes that a place's hash covers.
GRAM = 32
#: Bytes of texts hashed at once; a longer text goes in overlapping pieces.
PIECE = 1 << 19
#: Places are kept in the low bits of the hashes whose minimum is taken.
PLACE_BITS = 20
#: Bytes of a suffix array's shard, and different runs from which a group is crowded.
SHARD_BYTES, CROWDED = 2 << 20, 8_192
#: Kinds of runs that a task remembers.
REMEMBERED = 1_000_000

_MASK = np.uint64((1 << PLACE_BITS) - 1)


def text_key() -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place."""
    w = words_at(data)
    n = len(data) - GRAM + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    for step in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h += w[step : step + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def window_minima(h: np.ndarray, length: int) -> np.ndarray:
    """Per window of `length` bytes its smallest hash's high bits with the place of it."""
    m = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(m) - (width - span)], m[width - span :]) if width > span else m


def runs_of(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """Runs of windows: arrays (text, start in text, windows, hash), the bytes, and their starts there."""
    pieces: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        data = np.frombuffer(raw := b"".join(p[2] for p in pieces), np.uint8)
        ends = np.cumsum([len(p[2]) for p in pieces])
        starts = ends - [len(p[2]) for p in pieces]
        h = gram_hashes(data)
        m = window_minima(h, length)
        owner = np.repeat(np.arange(len(pieces)), [len(p[2]) for p in pieces])[: len(m)]
        valid = np.flatnonzero(np.arange(len(m)) + length <= ends[owner])
        if not len(valid):
            return None
        new = np.concatenate([[True], (valid[1:] != valid[:-1] + 1) | (m[valid[1:]] != m[valid[:-1]])])
        at = np.flatnonzero(new)
        first = valid[at]
        count = np.diff(np.append(at, len(valid)))
        which = owner[first]
        text = np.array([p[0] for p in pieces])[which]
        base = np.array([p[1] for p in pieces])[which]
        place = (m[first] & _MASK).astype(np.int64)
        return text, first - starts[which] + base, count, h[place].view(np.int64), raw, first

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        for a in range(0, max(1, len(text) - length + 1), PIECE - length + 1):
            part = text[a : a + PIECE]
            if size + len(part) > PIECE and pieces:
                if (out := flush()) is not None:
                    yield out
                pieces, size = [], 0
            pieces.append((i, a, part))
            size += len(part)
    if pieces and (out := flush()) is not None:
        yield out


_RUNS = "hash long, context long, text binary, start long, windows int"


def runs(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """Runs of `keyed` (text key, text). Without a hash: known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        kinds: dict[tuple[int, int], int] = {}
        copies: dict[bytes, int] = {}
        for batch in batches:
            keys, texts = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or len(text) * 4 < length:
                    continue
                if len(copies) > REMEMBERED:
                    copies.clear()
                copies[key] = seen = copies.get(key, 0) + 1
                if seen <= 2:
                    keys.append(key)
                    texts.append(text.encode())
            names = pa.array(keys, pa.binary())
            for text, start, count, h, raw, first in runs_of(texts, length):
                view = memoryview(raw)
                context = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)], np.uint64).view(np.int64)
                known = np.zeros(len(h), bool)
                if len(kinds) > REMEMBERED:
                    kinds.clear()
                for i, kind in enumerate(zip(h.tolist(), context.tolist(), strict=True)):
                    seen = kinds.get(kind, 0)
                    if seen >= 2:
                        known[i] = True
                    else:
                        kinds[kind] = seen + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, mask=known), pa.array(context, mask=known), names.take(pa.array(text)), pa.array(start), pa.array(count.astype(np.int32))],
                    names=["hash", "context", "text", "start", "windows"],
                )

    return keyed.mapInArrow(run, _RUNS)


_SORTED = "text binary, start long, windows int, hash long, open boolean, crowded boolean"


def _groups(crowded: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From runs sorted by hash and context: repeats (no hash), and of mixed groups a run of each kind.

        `open` runs occur once and have yet to be compared; the others repeat and
        are only there to be compared with.
        """
        names = [x.split()[0] for x in _SORTED.split(", ")]

        def out(rows: pa.RecordBatch, hash_: pa.Array, open_: np.ndarray, crowd_: bool) -> pa.RecordBatch:
            flags = [pa.array(open_), pa.array(np.full(len(open_), crowd_))]
            return pa.RecordBatch.from_arrays([rows.column("text"), rows.column("start"), rows.column("windows"), hash_, *flags], names=names)

        pending: list[pa.RecordBatch] = []  # the runs of the hash at hand, one of each kind
        kinds, crowd, last = 0, False, None

        def held() -> Iterator[pa.RecordBatch]:
            if kinds > 1:
                for rows in pending:
                    yield out(rows, rows.column("hash"), rows.column("open").to_numpy(zero_copy_only=False), crowd)

        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if carry is None else pa.concat_batches([carry, batch])
            h, c = rows.column("hash").to_numpy(), rows.column("context").to_numpy()
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(h)))
            # the last kind may go on: two of its rows are as good as all
            tail = int(first[-1])
            carry = rows.slice(tail, min(2, len(h) - tail))
            repeated = np.flatnonzero(np.repeat(size > 1, size))
            if len(repeated):
                some = rows.take(pa.array(repeated))
                yield out(some, pa.nulls(len(repeated), pa.int64()), np.zeros(len(repeated), bool), False)
            first, size = first[:-1], size[:-1]
            if not len(first):
                continue
            one = rows.take(pa.array(first)).append_column("open", pa.array(size == 1))
            hashes = h[first]
            cuts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            stops = np.append(cuts[1:], len(hashes))
            # groups that lie within this batch, but for the first and the last, go in one piece
            inner = np.repeat(stops - cuts, stops - cuts)
            inside = (inner > 1) & (inner <= crowded) & (np.arange(len(hashes)) >= stops[0]) & (np.arange(len(hashes)) < cuts[-1])
            if inside.any():
                some = one.take(pa.array(np.flatnonzero(inside)))
                yield out(some, some.column("hash"), some.column("open").to_numpy(zero_copy_only=False), False)
            large = [(a, b) for a, b in zip(cuts.tolist(), stops.tolist(), strict=True) if a == 0 or b == len(hashes) or b - a > crowded]
            for a, b in large:
                if int(hashes[a]) != last:
                    yield from held()
                    pending, kinds, crowd, last = [], 0, False, int(hashes[a])
                pending.append(one.slice(a, b - a))
                kinds += b - a
                if kinds > crowded:
                    crowd = True
                    yield from held()
                    pending = []
        if carry is not None:
            hash_ = carry.column("hash")[0].as_py()
            if hash_ != last:
                yield from held()
                pending, kinds, crowd = [], 0, False
            pending.append(carry.slice(0, 1).append_column("open", pa.array([carry.num_rows == 1])))
            kinds += 1
            yield from held()

    return run


def _contexts(length: int):
    """Rows (wanted runs, text) to rows (hash, open, crowded, text key, start, context bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column("text_value")[i].as_py().encode()
                wanted = batch.column("wanted")[i].as_py()
                yield pa.RecordBatch.from_pydict(
                    {
                        "hash": pa.array([w["hash"] for w in wanted], pa.int64()),
                        "open": pa.array([w["open"] for w in wanted], pa.bool_()),
                        "crowded": pa.array([w["crowded"] for w in wanted], pa.bool_()),
                        "text": pa.array([batch.column("text")[i].as_py()] * len(wanted), pa.binary()),
                        "start": pa.array([w["start"] for w in wanted], pa.int64()),
                        "context": pa.array([raw[w["start"] : w["start"] + w["windows"] + length - 1] for w in wanted], pa.binary()),
                    }
                )

    return run


def repeated_windows(contexts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Which windows of the joined contexts, at their first bytes, occur at another place; windows lie within a context."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    ends = np.repeat(np.cumsum(sizes), sizes)
    window = np.arange(len(data)) + length <= ends
    order = suffix_array(data)
    order = order[window[order]]
    out = np.zeros(len(data), bool)
    if len(order) < 2:
        return out
    # common prefixes in text order: phi is the neighbour before
    phi = np.full(len(data), -1, np.int64)
    phi[order[1:]] = order[:-1]
    at = np.flatnonzero(phi >= 0)
    full = length // 8 * 8
    words = words_at(data)
    same = common_prefix(words, len(data), at, phi[at], full)
    for step in range(full, length):
        near = np.flatnonzero(same)
        same[near] = data[at[near] + step] == data[phi[at[near]] + step]
    out[at[same]] = True
    out[phi[at[same]]] = True
    return out


_SPANS = "text binary, start long, end long"


def _shards(length: int):
    """Spans of repeated windows from contexts sorted by hash, in shards of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, bytes, int, bytes]] = []
        size = 0

        def solve(rows) -> pa.RecordBatch:
            found = repeated_windows([r[4] for r in rows], length)
            text, start, end = [], [], []
            base = 0
            for _, open_, key, at, context in rows:
                if open_:
                    own = np.flatnonzero(np.diff(np.concatenate([[0], found[base : base + len(context)].view(np.int8), [0]])))
                    for a, b in zip(own[::2].tolist(), own[1::2].tolist(), strict=True):
                        text.append(key)
                        start.append(at + a)
                        end.append(at + b + length - 1)
                base += len(context)
            return pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["text", "start", "end"])

        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("hash", "open", "text", "start", "context")), strict=True):
                if size >= SHARD_BYTES and row[0] != held[-1][0]:  # groups stay whole
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    return run


def _windows(length: int):
    """Each window of crowded contexts with 128 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for text, start, context in zip(*(batch.column(x).to_pylist() for x in ("text", "start", "context")), strict=True):
                n = len(context) - length + 1
                keys = [xxhash.xxh3_128_digest(context[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([text] * n, pa.binary()), pa.array(np.arange(start, start + n))], names=["window", "text", "start"])

    return run


def repeated_spans(keyed: DataFrame, length: int = LENGTH, crowded: int = CROWDED) -> DataFrame:
    """(text key, start, end) of byte spans of distinct texts that repeat; they overlap."""
    found = materialise(runs(keyed, length), "runs")
    parts = found.where("hash is not null").repartition("hash").sortWithinPartitions("hash", "context", "text", "start")
    grouped = materialise(parts.mapInArrow(_groups(crowded), _SORTED), "groups")
    spans = found.where("hash is null").select("text", "start", "windows").unionByName(grouped.where("hash is null").select("text", "start", "windows"))
    spans = spans.select("text", "start", (F.col("start") + F.col("windows") + length - 1).alias("end")).distinct()
    wanted = grouped.where("hash is not null").groupBy("text").agg(F.collect_set(F.struct("hash", "open", "crowded", "start", "windows")).alias("wanted"))
    one = keyed.select(F.col("text").alias("text"), F.col("value").alias("text_value"))
    # of copies of a text any will do; they are rare here, since what repeats as a whole isn't compared
    contexts = one.join(wanted, "text").select("text", "text_value", "wanted").mapInArrow(
        _contexts(length), "hash long, open boolean, crowded boolean, text binary, start long, context binary"
    )
    contexts = materialise(contexts.dropDuplicates(["text", "start"]), "contexts")
    shards = contexts.where("not crowded").repartition("hash").sortWithinPartitions("hash", "text", "start").mapInArrow(_shards(length), _SPANS)
    windows = contexts.where("crowded").select("text", "start", "context").mapInArrow(_windows(length), "window binary, text binary, start long")
    again = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    crowd = windows.join(again, "window", "left_semi").select("text", "start", (F.col("start") + length).alias("end"))
    return spans.unionByName(shards).unionByName(crowd)


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def deduplicated(docs: DataFrame, length: int = LENGTH, crowded: int = CROWDED) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(text_key().alias("text"), text.alias("value"))
    spans = repeated_spans(keyed, length, crowded).groupBy("text").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = materialise(spans, "repeats")
    rows = docs.select("doc_id", text_key().alias("key"), text.alias("value")).join(spans, F.col("key") == F.col("text"), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for value, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = value.encode()
                gone = union_of([(x["start"], x["end"]) for x in found or ()])
                kept, at = [], 0
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                for column, x in zip(out, (len(raw), sum(b - a for a, b in gone), len(gone), b"".join(kept)), strict=True):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "value", "spans").mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Removed spans of each text by counting all windows: for tests."""
    from collections import Counter

    seen = Counter(hashlib.md5(t[i : i + length]).digest() for t in texts for i in range(len(t) - length + 1))
    return [union_of([(i, i + length) for i in range(len(t) - length + 1) if seen[hashlib.md5(t[i : i + length]).digest()] > 1]) for t in texts]
