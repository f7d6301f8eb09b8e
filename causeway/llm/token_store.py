"""Token-id shards with a minimal perfect hash index from document keys to offsets.

A shard is two files. `<name>.bin` holds nothing but the ids of its documents
in ascending key order, little-endian, two bytes each where the vocabulary
allows it, else four. `<name>.idx` holds per document, in file order, its
first id position and key; a minimal perfect hash, that is bit arrays of
falling size with counts before each block of bits, in which each key finds a
bit of its own, whose rank is its slot; and per slot a fingerprint of the key
and the document's place. A lookup reads one block a level, checks the
fingerprint and the stored key and knows the offset: constant time, and no
more of the files than that.

Shards are range partitions of the key of bounded size, so a manifest of their
first and last keys and id counts orders them. File names carry the task
attempt; only files that the manifest names count, so a lost executor leaves
nothing behind that is read.

Defined results: a null text is empty; every document gets the end id; a null
key sorts first and is stored but not indexed; repeated keys are stored each,
in the order of a hash of their texts, and the index gives the first of a
shard; texts of any length are encoded whole, each in one shard; an empty
table gives no shard; other columns, of any name, are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path
from .tokens import default_path, encoder

END_ID = 2
MAGIC = b"CWTOKIX2"
#: Bits per key on each level of the hash.
GAMMA = 2
NULL_KEY = -(1 << 63)
#: Bytes of text that a shard holds on average, at most.
SHARD_TEXT_BYTES = 32 << 20
#: Bits of a level that share a count.
BLOCK_BITS = 512


def mixed_bits(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys, vectorised."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: bit levels with ranks."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [int(x.sum()) for x in levels]
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.ranks = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            size = max(8, GAMMA * len(rest))
            at = (mixed_bits(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any number, or -1, for keys that weren't built in."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            at = (mixed_bits(keys[open_], i) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.starts[i] + self.ranks[i][at[hit]]
            open_ = open_[~hit]
        return out

    def pack(self) -> list[tuple[bytes, bytes]]:
        """Per level the counts of bits before each block, and the bits."""
        out = []
        for bits, ranks in zip(self.levels, self.ranks, strict=True):
            padded = np.concatenate([bits, np.zeros(-len(bits) % BLOCK_BITS, bool)])
            out.append((ranks[: len(bits) : BLOCK_BITS].astype("<i8").tobytes(), np.packbits(padded, bitorder="little").tobytes()))
        return out

    @classmethod
    def unpack(cls, sizes: list[int], raw: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little").astype(bool) for n, x in zip(sizes, raw, strict=True)])


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed_bits(keys, 977) >> np.uint64(32)).astype(np.uint32)


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def _header(first: bytes, more) -> tuple[dict, int]:
    """An index file's header, and where its parts begin."""
    if first[:8] != MAGIC:
        raise ValueError("not an index file")
    n = int.from_bytes(first[8:12], "little")
    return json.loads(more(n)), 12 + n


@dataclass
class ShardIndex:
    """What an index file holds."""

    keys: np.ndarray
    starts: np.ndarray  # of len(keys) + 1 ids
    width: int
    hash: PerfectHash
    prints: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, width: int) -> ShardIndex:
        starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        known = np.flatnonzero(keys != NULL_KEY)
        distinct, first = np.unique(keys[known], return_index=True)
        table = PerfectHash.build(distinct)
        slots = table.slots(distinct)
        prints, places = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.int64)
        prints[slots], places[slots] = fingerprints(distinct), known[first]
        return cls(keys, starts, width, table, prints, places)

    def dump(self) -> bytes:
        parts = {
            "starts": self.starts.astype("<i8").tobytes(),
            "keys": self.keys.astype("<i8").tobytes(),
            "prints": self.prints.astype("<u4").tobytes(),
            "places": self.places.astype("<i8").tobytes(),
        }
        for i, (counts, bits) in enumerate(self.hash.pack()):
            parts |= {f"counts{i}": counts, f"bits{i}": bits}
        at, offsets = 0, {}
        for name, raw in parts.items():
            offsets[name] = at
            at += len(raw)
        head = json.dumps({"documents": len(self.keys), "width": self.width, "levels": [len(x) for x in self.hash.levels], "ones": self.hash.starts.tolist(), "at": offsets, "end": at}).encode()
        return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(parts.values())

    @classmethod
    def load(cls, raw: bytes) -> ShardIndex:
        head, base = _header(raw[:12], lambda n: raw[12 : 12 + n])
        names = [*head["at"], None]
        part = {a: raw[base + head["at"][a] : base + (head["at"][b] if b else head["end"])] for a, b in zip(names, names[1:], strict=False)}
        table = PerfectHash.unpack(head["levels"], [part[f"bits{i}"] for i in range(len(head["levels"]))])
        get = lambda name, kind: np.frombuffer(part[name], kind)
        return cls(get("keys", "<i8"), get("starts", "<i8"), head["width"], table, get("prints", "<u4"), get("places", "<i8"))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place in file order of each key's first document, -1 for absent ones."""
        slots = self.hash.slots(keys)
        ok = (slots >= 0) & (len(self.prints) > 0)
        out = np.full(len(keys), -1, np.int64)
        ok[ok] = self.prints[slots[ok]] == fingerprints(keys[ok])
        out[ok] = self.places[slots[ok]]
        same = out >= 0  # a fingerprint may agree by chance; the stored key settles it
        same[same] = self.keys[out[same]] == keys[same]
        return np.where(same, out, -1)


MANIFEST = "shard int, name string, first_key long, last_key long, documents long, ids long, width int"


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None) -> list[dict]:
    """Encode `docs` (doc_id, text) into shards under `folder`; the manifest's rows in key order.

    The manifest has a row per shard, so it is bounded by the shard count.
    """
    path = tokenizer or default_path()
    parts = shards
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_TEXT_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, context = encoder(path), TaskContext.get()
        end = np.array([end_id], encode.dtype).tobytes()
        width = encode.dtype.itemsize
        shard = context.partitionId()
        name = f"shard-{shard:06d}-{context.taskAttemptId()}"
        fs, root = _filesystem(folder)
        keys, counts, out = [], [], None
        for batch in batches:
            keys.append(batch.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False))
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}.bin")
            for text in batch.column(1):
                ids = encode(text.as_py() or "") + end
                counts.append(len(ids) // width)
                out.write(ids)
        if out is None:
            return
        out.close()
        index = ShardIndex.of(np.concatenate(keys), np.array(counts, np.int64), width)
        with fs.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(index.dump())
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "name": [name],
                "first_key": [int(index.keys[0])],
                "last_key": [int(index.keys[-1])],
                "documents": [len(counts)],
                "ids": [int(index.starts[-1])],
                "width": pa.array([width], pa.int32()),
            }
        )

    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    # the hash spreads a key that very many documents have
    order = ("doc_id", "_hash")
    dealt = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_hash")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = [r.asDict() for r in dealt.select("doc_id", "text").mapInArrow(write, MANIFEST).collect()]
    start = 0
    for row in sorted(rows, key=lambda r: r["shard"]):
        row["start"] = start
        start += row["ids"]
    rows.sort(key=lambda r: r["shard"])
    return rows


def read_shards(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files, by their index."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index = ShardIndex.load(fs.open_input_file(f"{root}/{name}.idx").readall())
                keys, known = index.keys, index.keys != NULL_KEY
                place = np.arange(len(keys))
                found = index.find(keys[known])
                if (found < 0).any():
                    raise ValueError(f"{name}: keys that the index doesn't find")
                # the index gives a key's first document; later ones of it follow
                place[known] = found + (np.arange(len(keys)) - np.searchsorted(keys, keys))[known]
                kind = np.dtype("<u2" if index.width == 2 else "<u4")
                ids = np.frombuffer(fs.open_input_file(f"{root}/{name}.bin").readall(), kind)
                first, last = index.starts[place], index.starts[place + 1]
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(keys, pa.int64(), mask=~known), "start": first + base, "n_tokens": last - first, "ids_crc32": pa.array(sums, pa.int64())}
                )

    names = spark.createDataFrame([(r["name"], r["start"]) for r in manifest], "name string, start long")
    return names.repartition(len(manifest)).mapInArrow(read, schema)


class TokenStore:
    """Keyed access to written shards: the manifest finds the shard, a few reads of its index the offset."""

    def __init__(self, folder: str, manifest: list[dict]):
        self.fs, self.root = _filesystem(folder)
        self.manifest = [r for r in manifest if r["documents"]]
        self.first = np.array([r["first_key"] for r in self.manifest], np.int64)
        self.headers: dict[str, tuple[dict, int]] = {}

    def place(self, f, head: dict, base: int, key: int) -> int | None:
        """The place of a key's first document, read from an open index file."""

        def number(part: str, i: int, kind: str = "<i8") -> int:
            size = np.dtype(kind).itemsize
            f.seek(base + head["at"][part] + i * size)
            return int(np.frombuffer(f.read(size), kind)[0])

        wanted = np.array([key], np.int64)
        for i, size in enumerate(head["levels"]):
            bit = int(mixed_bits(wanted, i)[0] % np.uint64(size))
            block, inside = divmod(bit, BLOCK_BITS)
            f.seek(base + head["at"][f"bits{i}"] + block * BLOCK_BITS // 8)
            bits = int.from_bytes(f.read(BLOCK_BITS // 8), "little")
            if bits >> inside & 1:
                slot = head["ones"][i] + number(f"counts{i}", block) + (bits & (1 << inside) - 1).bit_count()
                if number("prints", slot, "<u4") != int(fingerprints(wanted)[0]):
                    return None
                place = number("places", slot)
                return place if number("keys", place) == key else None
        return None

    def ids(self, key: int) -> list[int] | None:
        """The ids of a document, None if it isn't stored."""
        at = int(np.searchsorted(self.first, key, "right")) - 1
        while at > 0 and self.manifest[at - 1]["last_key"] == key:
            at -= 1
        if at < 0:
            return None
        name = self.manifest[at]["name"]
        with self.fs.open_input_file(f"{self.root}/{name}.idx") as f:
            if name not in self.headers:
                self.headers[name] = _header(f.read(12), f.read)
            head, base = self.headers[name]
            place = self.place(f, head, base, key)
            if place is None:
                return None
            f.seek(base + head["at"]["starts"] + 8 * place)
            start, end = np.frombuffer(f.read(16), "<i8").tolist()
        with self.fs.open_input_file(f"{self.root}/{name}.bin") as f:
            f.seek(start * head["width"])
            raw = f.read((end - start) * head["width"])
        return np.frombuffer(raw, "<u2" if head["width"] == 2 else "<u4").tolist()


def stored(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write `docs` to shards in the shared folder and read every document back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    return read_shards(spark, folder, write_shards(docs, folder, tokenizer))
