"""Training-data operators against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from causeway.llm import ann, exact_topk, mixing, near_copies, packing, pii, sharding, simhash, substring_dedup, token_store, toxicity
from causeway.llm import tokens as tok
from causeway.llm.suffix_array import suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int, fp string, size string, rank int, key string, value string, root string, position string, start string, spans string"


def docs(spark, rows):
    """Documents (doc_id, text, source) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", "x", 1, "x", "x", "x", "x", "x", "x") for i, t, s in rows], DOCS)


WORDS = "the cat sat on a mat and then it ran off to see what was there of course in town".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(9)) * (rng.random() < 0.2) for _ in range(n))


ODD = [
    (1, None, "b"),
    (2, "", "a"),
    (3, " \t\n", None),
    (None, "one two three four", "a"),
    (4, "one two three four", "a"),
    (4, "one two three four", "a"),
    (5, "Ünïcode   wörds \U0001f600 und mehr x", None),
    (6, "word " * 9_000, "b"),
    (7, "x" * 30_000, "c"),
    (8, "1 " * 12_000, "c"),
]

ALL = {
    "mixing": mixing.mixed,
    "mixture": mixing.mixture,
    "token_store": token_store.stored,
    "packing": packing.packed,
    "simhash": simhash.near_duplicates,
    "one_of_each": simhash.one_of_each,
    "substring": lambda d: substring_dedup.digest(substring_dedup.deduplicated(d)),
    "pii": pii.personal_data,
    "redacted": pii.redacted,
    "sharding": sharding.sharded,
}


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, name):
    assert ALL[name](docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", [n for n in ALL if n not in ("mixture", "packing", "one_of_each")])
def test_odd_rows_all_come_back(spark, name):
    assert ALL[name](docs(spark, ODD)).count() == len(ODD)


CLASHING = ["_row", "_kept", "_copy", "_doc", "_id", "_text", "_base", "_wide", "_all", "_key", "_ends", "_open", "wide", "base", "_take", "_bucket", "_place", "times", "before", "node", "fp", "root", "first", "sketch", "n"]


@pytest.mark.parametrize("f", [mixing.mixture, simhash.one_of_each, near_copies.one_of_each, pii.redacted])
def test_columns_and_their_values_are_kept(spark, f):
    table = docs(spark, ODD)
    for i, name in enumerate(CLASHING):
        table = table.withColumn(name, F.concat(F.lit(f"{i}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    out = f(table)
    assert out.columns == table.columns
    rows = out.collect()
    assert rows and all(r[name] == f"{i}-{'null' if r.doc_id is None else r.doc_id}" for r in rows for i, name in enumerate(CLASHING))


# ---------------------------------------------------------------- 1 mixing
def test_targets_stop_and_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 500)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    total, most, weight = 1.5 * 1610, {"a": 20, "b": 200, "c": 2000, None: 1000}, {"a": 5, "b": 2, "c": 1, None: 5}
    want, open_ = {}, set(most)
    while True:
        left = total - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = most[s]
            open_.discard(s)
    assert got == pytest.approx(want)


def test_mix_takes_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(1, 60)), rng.choice("aaabcd")) for i in range(400)]
    out = mixing.mixed(docs(spark, rows)).collect()
    again = mixing.mixed(docs(spark, rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    for s in "abcd":
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60
        assert own[0].source_size == sum(r.size for r in own)
    assert all(r.taken <= 2 * r.size and r.size == len(rows[r.doc_id][1].split()) for r in out)
    assert all((r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1) for r in out)


def test_positions_invert_the_demand(spark):
    shares = [i / 50 for i in range(51)]
    df = spark.createDataFrame([(s, c) for s in shares for c in range(3)], "s double, c int")
    for r in df.select("s", "c", mixing.training_position(F.col("s"), F.col("c")).alias("t")).collect():
        w, fine = mixing.SCHEDULES[r.c], np.linspace(0, 1, 20_001)
        area = np.concatenate([[0], np.cumsum((np.interp(fine[1:], mixing.KNOTS, w) + np.interp(fine[:-1], mixing.KNOTS, w)) / 2)])
        assert np.interp(r.t, fine, area / area[-1]) == pytest.approx(r.s, abs=1e-6)


def test_training_order_is_sorted(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 20), rng.choice("ab")) for i in range(100)]
    got = [r.position for r in mixing.training_order(mixing.mixed(docs(spark, rows))).collect()]
    assert got == sorted(got)


# ---------------------------------------------------------------- 2, 3 search
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long, dim int, node long")


def search_rows(n=700, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[50:90] = x[50]  # copies
    x[91] = 0
    return [(i, [float(v) for v in x[i]], 0, 0, 0, 0) for i in range(n)], x


BAD = [(1000, None, 0, 0, 0, 0), (1020, [float("nan")] * 16, 0, 0, 0, 0), (1040, [float("inf")] * 16, 0, 0, 0, 0), (1060, [], 0, 0, 0, 0), (None, [1.0] * 16, 0, 0, 0, 0), (1080, [None] + [1.0] * 15, 0, 0, 0, 0)]


def test_exact_top_k(spark):
    rows, x = search_rows()
    got: dict = {}
    for r in exact_topk.top_k(vectors(spark, rows + BAD)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    z = np.floor(64 * x.astype(float)).astype(np.int64)
    for q in range(0, len(x), 20):
        s = z @ z[q]
        want = [(int(i), int(s[i])) for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]
        assert [got[q][k] for k in range(1, 21)] == want
    assert len(got) == 35


def test_bounds_prune_and_keep_all_that_matters():
    rng = np.random.default_rng(3)
    q, c = (np.floor(64 * rng.standard_normal((n, 64))).astype(np.int64) for n in (40, 900))
    c[:20] = q[:20] * 2  # near ones raise the least score, so that bounds bite
    score = q @ c.T
    least = np.sort(score, axis=1)[:, -5].astype(float)
    row, at, s = exact_topk.block_top((np.arange(40) + 5000, q), (np.arange(900), c), least, 5)
    for i in range(40):
        assert s[row == i].tolist() == np.sort(score[i])[::-1][:5].tolist()
    stats = exact_topk.segment_statistics(q, 4) @ exact_topk.segment_statistics(c, 4).T
    assert (stats >= score - 1e-6).all()


def plain_top(z, every=20, k=20):
    return {q: [(int(i), int(s[i])) for i in np.lexsort((np.arange(len(z)), -s)) if i != q][:k] for q in range(0, len(z), every) for s in [z @ z[q]]}


@pytest.mark.parametrize("kind", ["negative", "constant", "few", "odd length"])
def test_exact_top_k_where_bounds_are_tight(spark, kind):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((60, {"odd length": 37}.get(kind, 64)))
    if kind == "negative":  # each query's 20th score is far under zero
        x = np.where(np.arange(60)[:, None] < 2, 5.0, -5.0 - np.arange(60)[:, None] / 8) * np.ones((1, 64))
    if kind == "constant":
        x = np.repeat(rng.integers(-3, 4, (60, 4)), 16, axis=1).astype(float)
    if kind == "few":
        x = x[:7]
    got: dict = {}
    for r in exact_topk.top_k(vectors(spark, [(i, [float(v) for v in row], 0, 0, 0, 0) for i, row in enumerate(x)])).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = plain_top(np.floor(64 * x.astype(np.float32).astype(float)).astype(np.int64))
    assert {q: [v[i] for i in sorted(v)] for q, v in got.items()} == want


@pytest.mark.parametrize("n", [1, 8, 700])
def test_nearest_neighbours(spark, n):
    rows, x = search_rows(n if n > 100 else 700)
    rows, x = rows[:n], x[:n]
    got: dict = {}
    for r in ann.nearest(vectors(spark, rows + BAD)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    live = [i for i in range(n) if np.abs(x[i]).sum() > 0]
    for q in [i for i in live if i % 20 == 0]:
        s = x.astype(float) @ x[q].astype(float)
        want = sorted((i for i in live if i != q), key=lambda i: (-s[i], i))[:20]
        own = [got[q][k] for k in range(1, len(want) + 1)] if want else []
        assert all(v == pytest.approx(s[i]) for i, v in own) and [(-v, i) for i, v in own] == sorted((-v, i) for i, v in own)
        hits += len({i for i, _ in own} & set(want))
        total += len(want)
    assert hits >= 0.9 * total


@pytest.mark.parametrize("kind", ["one long", "ten decades", "huge"])
def test_nearest_neighbours_at_any_spread_of_norms(spark, kind):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((600, 64)) / 8
    if kind == "one long":
        x[7] *= 1e8
    else:
        x *= 10.0 ** rng.uniform(-5, 5, 600)[:, None] * (1e140 if kind == "huge" else 1)
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(table).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    hits = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:20]
        assert sorted(got[q]) == list(range(1, 21))
        hits += len(set(got[q].values()) & set(want))
    assert hits >= 0.9 * 600


@pytest.mark.parametrize("spread", ["some long", "1 to 12"])
def test_nearest_neighbours_of_tight_clusters(spark, spread):
    """Clusters larger than a neighbourhood, of different lengths: what a query looks for is another cluster as a rule."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((60, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    centres *= np.where(np.arange(60) % 20 == 0, 10.0, 1.0)[:, None] if spread == "some long" else rng.uniform(1, 12, (60, 1))
    x = np.repeat(centres, 50, axis=0) * (1 + 0.02 * rng.standard_normal((3_000, 64)))
    x = x[rng.permutation(3_000)].astype(np.float32).astype(np.float64)
    got = {}
    for r in ann.nearest(vectors(spark, [(i, v.tolist(), 0, 1, 1, 1) for i, v in enumerate(x)])).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    shares = []
    for q in range(0, 3_000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        shares.append(len(got[q] & set(np.argsort(-score, kind="stable")[:20].tolist())) / 20)
    assert np.mean(shares) >= 0.9 and min(shares) >= 0.7, (np.mean(shares), min(shares))


def test_search_of_nothing(spark):
    for f in (ann.nearest, exact_topk.top_k):
        assert f(vectors(spark, [])).count() == 0 and f(vectors(spark, BAD)).count() == 0


# ---------------------------------------------------------------- 4, 10 tokens
def plain_ids(text):
    from tokenizers import Tokenizer

    if not _PLAIN:
        _PLAIN.append(Tokenizer.from_file(tok.default_path()))
    return _PLAIN[0].encode(text or "", add_special_tokens=False).ids


_PLAIN: list = []


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_cuts_at_line_feeds_and_tells_uneven_space():
    encode = tok.Encoder(tok.default_path())
    text = "One two.\nThree four\nfive\n"
    assert encode(text) == encode.words.encode(text)
    assert not any("\n" in w and w != "\n" for w in encode.words)  # words are remembered, not what lines make of them
    space = [c for c in map(chr, range(0x110000)) if re.match(r"\s|\0", c)]
    for c in space:
        for x in (f"a{c}b", f"a {c}b", f"a{c}{c}b", f"{c}\nb", f"{c}é{c}", f"世{c} "):
            assert tok.uneven(x) == (tok.UNEVEN.search(x) is not None)


def test_encoder_is_the_tokenizer():
    rng, encode = random.Random(4), tok.encoder(tok.default_path())
    parts = ["a", "Bc", " ", " ", "\n", "'s", "é", "1", ".", ",", "!", "\t", "²", "日本", "　", "_", "\0", "<|endoftext|>", "<|endof", "don't", "\u00a0", "\u2028", "\x1c", "\x85", "\u200b", "\u0301", "\U0001f600"]
    for i in range(20_000):
        some = parts if i % 2 else [*parts, *(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x30000)])) for _ in range(4))]
        text = "".join(rng.choice(some) for _ in range(rng.randrange(12)))
        assert np.frombuffer(encode(text), encode.dtype).tolist() == plain_ids(text), repr(text)
    for code in range(0x3000):  # every character of the first planes' white space, beside each kind of neighbour
        for text in (f"a {chr(code)}b", f"é\n{chr(code)}1", f"{chr(code)} x", f"a{chr(code)}b c"):
            if not 0xD800 <= code < 0xE000:
                assert np.frombuffer(encode(text), encode.dtype).tolist() == plain_ids(text), repr(text)


def test_store_round_trip(spark):
    rows = [r for r in ODD]
    folder = token_store.scratch_path(spark, "test") if hasattr(token_store, "scratch_path") else None
    table = docs(spark, rows)
    manifest = token_store.write_shards(table, folder, shards=3)
    got = token_store.read_shards(spark, folder, manifest).orderBy("start").collect()
    want = sorted(((i is not None, i or 0, t) for i, t, _ in rows), key=lambda r: r[:2])
    start = 0  # texts of a repeated key are equal here
    for r, (known, i, text) in zip(got, want, strict=True):
        ids = [*plain_ids(text), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i if known else None, start, len(ids), crc(ids))
        start += len(ids)
    store = token_store.TokenStore(folder, manifest)
    assert store.ids(5) == [*plain_ids(ODD[6][1]), 2] and store.ids(4) == [*plain_ids("one two three four"), 2] and store.ids(99) is None


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**62), 2**62, 5000))
    table = token_store.PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    sizes, raw = [len(x) for x in table.levels], [bits for _, bits in table.pack()]
    assert (token_store.PerfectHash.unpack(sizes, raw).slots(keys) == table.slots(keys)).all()
    index = token_store.ShardIndex.of(np.sort(keys), np.ones(len(keys), np.int64), 2)
    assert (token_store.ShardIndex.load(index.dump()).find(keys + 1) >= 0).sum() == np.isin(keys + 1, keys).sum()


def test_every_key_is_found_through_the_files(spark):
    rng = random.Random(16)
    keys = rng.sample(range(-(10**12), 10**12), 3_000)
    rows = [(k, f"text {k} {prose(rng, 3)}", "s") for k in keys] + [(7, f"copy {i}", "s") for i in range(400)]
    folder = token_store.scratch_path(spark, "test")
    manifest = token_store.write_shards(docs(spark, rows), folder, shards=5)
    store = token_store.TokenStore(folder, manifest)
    for k, text, _ in rows[::50][:60]:
        assert store.ids(k) == [*plain_ids(text), 2]
    assert all(store.ids(k) is None for k in range(8, 60)) and store.ids(7)[:-1] in [plain_ids(f"copy {i}") for i in range(400)]
    got = token_store.read_shards(spark, folder, manifest).collect()
    assert sorted((r.doc_id, r.ids_crc32) for r in got) == sorted((k, crc([*plain_ids(t), 2])) for k, t, _ in rows)
    # an index that lacks a key is told
    row = manifest[0]
    fs, root = token_store._filesystem(folder)
    index = token_store.ShardIndex.load(fs.open_input_file(f"{root}/{row['name']}.idx").readall())
    index.prints = index.prints ^ 1
    with fs.open_output_stream(f"{root}/{row['name']}.idx") as f:
        f.write(index.dump())
    with pytest.raises(Exception, match="doesn't find"):
        token_store.read_shards(spark, folder, manifest).collect()


def test_packing_is_whole(spark):
    out = packing.packed(docs(spark, ODD)).collect()
    assert sum(r.length for r in out) == sum(len(plain_ids(t)) + 1 for _, t, _ in ODD)
    bins: dict = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id == 6:
            ids = [*plain_ids(ODD[7][1]), 0]
            assert r.ids_crc32 == crc(ids[r.start : r.start + r.length]) and (r.length == 2048 or r.piece == 0)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1 + -(-sum(r.length for r in out) // 2048)


def test_every_piece_holds_the_ids_of_its_document(spark):
    rng = random.Random(31)
    texts = {i: prose(rng, rng.choice([0, 1, 5, 300, 3_000])) + rng.choice(["", " \n ", "é\U0001f600"]) for i in range(60)}
    got: dict = {}
    for r in packing.packed(docs(spark, [(i, t, "s") for i, t in texts.items()])).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids, at = [*plain_ids(text), 0], 0
        for n, (piece, start, length, check) in enumerate(sorted(got[i])):
            assert (piece, start, check) == (n, at, crc(ids[at : at + length]))
            assert length == 2048 or n == 0 and length == (len(ids) - 1) % 2048 + 1
            at += length
        assert at == len(ids)


@pytest.mark.parametrize("limits", [packing.Limits(64), packing.Limits(64, rule="dot"), packing.Limits(64, documents=3), packing.Limits(64, documents=5, attention=64 * 64, weights=(1, 1, 1))])
def test_plan_keeps_every_capacity(limits):
    rng = random.Random(3)
    histogram = {n: rng.randrange(1, 40) for n in range(1, 65)}
    bins: dict = {}
    count: dict = {}
    for length, low, high, sequence, offset in packing.plan(histogram, limits):
        count[length] = count.get(length, 0) + high - low
        for i in range(high - low):
            bins.setdefault(sequence + i, []).append((offset, length))
    assert count == histogram
    tokens, documents, attention = limits.vector()
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= tokens and len(parts) <= documents and sum(n * n for _, n in parts) <= attention
    lower = max(-(-sum(k * n for k, n in histogram.items()) // tokens), -(-sum(histogram.values()) // documents))
    assert len(bins) <= 1.15 * lower + 2


# ---------------------------------------------------------------- 5 toxicity
def test_toxicity_sees_through_disguise(spark):
    rng = random.Random(5)
    bad = ["idiot", "scum", "worthless"]
    rows, labels = [], []
    for i in range(600):
        words, toxic = prose(rng, 30).split(), int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 0, toxic))
    probes = {1001: "you 1d10t you", 1002: "such s c u m here", 1003: "w0rthless and wooorthless", 1004: "a cat sat there", 1005: None, 1006: ""}
    table = docs(spark, rows + [(i, t, "s") for i, t in probes.items()])
    known = spark.createDataFrame([*labels, (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(table, known).collect()}
    assert all(out[i].predicted == 1 for i in (1001, 1002)) and all(out[i].predicted == 0 for i in (1004, 1005, 1006))
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i].held_out == (i in held) for i in range(600))
    assert sum(out[i].predicted == labels[i][2] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())


def reading_by_trial(costs, stretch):
    """The cheapest reading of a stretch by trying all paths of its lattice."""
    restorer = toxicity.Restorer(costs)
    best = None
    for path in itertools.product(*restorer.lattice(stretch)):
        a = b = 0
        total, read = 0.0, ""
        for symbol, price in path:
            total += price
            if symbol is not None:
                total += costs[a][b][symbol]
                a, b, read = b, symbol, read + (" " if symbol == 0 else "?" if symbol == 27 else chr(96 + symbol))
        total += costs[a][b][0]
        if best is None or total < best[0] - 1e-12:
            best = (total, read)
    return best[1]


def test_decoding_is_the_cheapest_path(spark):
    rng = random.Random(13)
    costs = toxicity.character_costs(toxicity.count_trigrams(docs(spark, [(i, prose(rng, 80), "s") for i in range(20)])))
    restorer = toxicity.Restorer(costs)
    for stretch in ["c4t", "c a t", "s-4-t", "m4tttt", "1t", "w4$ th3r3", "t h e n", "0ff", "aaat"] + ["".join(rng.choice("ca7t1 -0") for _ in range(8)) for _ in range(30)]:
        assert restorer.decode(stretch) == reading_by_trial(costs, stretch)


def test_long_disguises_are_decoded(spark):
    rng = random.Random(14)
    bad = ["worthless", "idiot", "loser"]
    rows, labels = [], []
    for i in range(600):
        words, toxic = prose(rng, 30).split(), int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 0, toxic))
    clean = prose(rng, 60).replace(" ", "")
    probes = {
        1001: " ".join("youareaworthlessidiotandaloserofcourse" * 8),
        1002: "-".join("thecatsatandtheidiotranoff"),
        1003: "id" + "i" * 300 + "ot",
        1004: " ".join(re.sub("[0-9]", "", clean)),
        1005: "x" * 50_000,
        1006: "1 " * 30_000,
        1007: "w0rthl3$$" * 1 + " " + "l" + "0" * 60 + "ser",
    }
    out = {r.doc_id: r for r in toxicity.toxicity(docs(spark, rows + [(i, t, "s") for i, t in probes.items()]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert {i: out[i].predicted for i in probes} == {1001: 1, 1002: 1, 1003: 1, 1004: 0, 1005: 0, 1006: 0, 1007: 1}


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(1, 9)] + [(4, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs(spark, ODD), labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(docs(spark, []), labels).count() == 0
    kept = toxicity.scored(docs(spark, ODD).drop("score"), toxicity.fit(docs(spark, ODD), labels))
    assert [r.text for r in kept.collect()] == [t for _, t, _ in ODD]


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in toxicity.toxicity(docs(spark, ODD), none).collect()} == {0.0}
    assert toxicity.toxicity(docs(spark, []), none).count() == 0


# ---------------------------------------------------------------- 6 substrings
@pytest.mark.parametrize("seed", range(3))
def test_suffix_array_sorts(seed):
    rng = random.Random(seed)
    for _ in range(150):
        raw = bytes(97 + rng.randrange(rng.choice([1, 2, 26])) for _ in range(rng.randrange(1, 80))) * rng.choice([1, 2])
        assert suffix_array(np.frombuffer(raw, np.uint8)).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


@pytest.mark.parametrize("seed", range(3))
def test_suffix_array_of_names_sorts(seed):
    rng = random.Random(seed)
    for _ in range(200):
        top = rng.choice([1, 2, 5, 400, 100_000])
        raw = [rng.randrange(top) for _ in range(rng.randrange(1, 120))] * rng.choice([1, 1, 2, 3])
        names = np.unique(raw, return_inverse=True)[1].astype(np.int64)
        assert suffix_array(names).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_suffix_array_of_repeated_prose():
    rng = random.Random(4)
    part = prose(rng, 3_000)
    raw = (part + prose(rng, 1_000) + part + "x" * 500 + part[:9_000]).encode()
    got = suffix_array(np.frombuffer(raw, np.uint8))
    assert got.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


@pytest.mark.parametrize("crowded", [2, 8192])
def test_repeats_are_removed(spark, crowded):
    rng = random.Random(6)
    shared = [prose(rng, 40) for _ in range(4)]
    rows = list(ODD)
    for i in range(100, 160):
        parts = [prose(rng, rng.randrange(5, 60)) for _ in range(2)]
        if rng.random() < 0.6:
            parts.insert(1, rng.choice(shared)[rng.randrange(20) :])
        rows.append((i, " ".join(parts), "s"))
    rows += [(200, rows[20][1], "s"), (201, rows[21][1][3:] + "é", "s")]
    got = sorted(tuple(r) for r in substring_dedup.digest(substring_dedup.deduplicated(docs(spark, rows), crowded=crowded)).fillna(-1).collect())
    raw = [(t or "").encode() for _, t, _ in rows]
    want = []
    for (i, _, _), text, gone in zip(rows, raw, substring_dedup.brute_force(raw, 200), strict=True):
        kept, at = b"", 0
        for a, b in gone:
            kept, at = kept + text[at:a], b
        want.append((-1 if i is None else i, len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept + text[at:]).hexdigest()))
    assert got == sorted(want)


# ---------------------------------------------------------------- 7 personal data
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if ok(k, m[0]))


def test_base_spans_are_the_patterns(spark):
    rng = random.Random(7)
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1", "12", ".", " ", "-", "é", "😀", "+", "0", "abc", "_%", "79927398713000000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    texts += ["a.b@c.d_e@f.gh@i.j", "9" * 3_000, "a@" * 5_000, "a." * 1_000 + "@x.y", "1." * 20_000, "+1" + "(" * 5_000, "4111111111111111 " * 500]
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        spans = base_spans(text)
        written = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest(), text[:80]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(written.split(",")) - {""} <= set(got[i].spans.split(","))


def test_long_runs_stay_linear(spark):
    texts = ["9" * 100_000, "a." * 100_000 + "@x.y", "1." * 4_000, "x" * 300_000, "a@b.cd 1.2.3.4 " * 25_000, "(030) 123-4567, " * 20_000]
    table = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in pii.personal_data(table).collect()}
    assert got[1].n_email == 1 and got[1].spans.startswith("email:0:200004")
    assert got[2].n_ip == 1_000 and got[3].spans == "" and got[0].n_card == 0
    assert (got[4].n_email, got[4].n_ip, got[5].n_phone, got[5].spans.count("phone")) == (25_000, 25_000, 0, 20_000)
    new = {r.doc_id: r.text for r in pii.redacted(table).collect()}
    assert new[4] == "[EMAIL] [IP] " * 25_000 and new[5] == "[PHONE], " * 20_000 and new[3] == texts[3]


def test_skipping_texts_loses_no_candidate(spark):
    found = ["john [at] example.com", "john(at)example.com", "john {at} example [dot] com", "john at example.com", "john at example dot com", "john@example.com"]
    rows = docs(spark, [(i, f"see {t} now", "s") for i, t in enumerate(found)] + [(90, "a dot b", "s"), (91, "chat atom", "s"), (92, None, "s")])
    email = next(g for g, (name, _, _) in enumerate(pii.GENERATORS) if name == "email")
    spans = {r.doc_id: [m.m for m in r.found if m.g == email and m.m is not None] for r in rows.select("doc_id", pii.matches(F.coalesce("text", F.lit(""))).alias("found")).collect()}
    assert spans == {**{i: [t] for i, t in enumerate(found)}, 90: [], 91: [], 92: []}


def test_spans_are_added_and_clean_texts_left_alone(spark):
    rng = random.Random(15)
    base = [f"{prose(rng, 12)} {rng.choice(['mail', 'write to', 'see'])} a{i}.b@mail{i % 7}.example.com or +49 (30) 123-45{i % 90 + 10} {prose(rng, 5)}" for i in range(120)]
    hidden = {
        "mail jane [at] mail.org today": "jane [at] mail.org",
        "reach joe (at) web (dot) example": "joe (at) web (dot) example",
        "office (030) 123-4567 daily": "(030) 123-4567",
        "call 212-555-0188 now": "212-555-0188",
        "tel: 030 1234567": "030 1234567",
        "host 10[.]0[.]0[.]7 is up": "10[.]0[.]0[.]7",
        "visa 4111/1111/1111/1111 ok": "4111/1111/1111/1111",
        "call +1 (843) 555-7672 170.106.47.218 then": "+1 (843) 555-7672",
    }
    clean = ["order 123456789012 shipped", "we met at noon.then left", "on 2024-01-02 10:20:30", "no 4111111111111112 here", "version 1 . 2 . 3 . 4", "look at example.com", "pages 10 20 30 40 50", "isbn 978-3-16-148410-0"]
    for corpus in (base, []):  # with and without base spans to learn from
        rows = [*corpus, *hidden, *clean]
        got = {r.doc_id: r for r in pii.personal_data(docs(spark, [(i, t, "s") for i, t in enumerate(rows)])).collect()}
        for i, text in enumerate(rows):
            spans = {tuple(x.split(":")) for x in got[i].spans.split(",") if x}
            found = {text[int(a) : int(b)] for _, a, b in spans}
            if text in hidden:
                assert hidden[text] in found, text
            else:
                assert len(spans) == len(base_spans(text)), text


def test_trees_learn_format_and_thresholds_are_calibrated():
    cells = []
    for digits in range(8):
        for cue in range(2):
            row = dict.fromkeys(pii.RANGES, 0) | {"digits": digits, "cue": cue}
            cells.append((row, 100, 95 if digits >= 5 and cue else 2))
    model = pii.boost(cells)
    scores = [model.raw(c[0]) for c in cells]
    assert min(s for s, c in zip(scores, cells, strict=True) if c[2] == 95) > max(s for s, c in zip(scores, cells, strict=True) if c[2] == 2)
    least = pii.calibrate(model, [(s, *c) for s, c in zip(scores, cells, strict=True)]).threshold
    assert list(least) == [0] and all((s >= least[0]) == (c[2] == 95) for s, c in zip(scores, cells, strict=True))
    # where the held-out cells say otherwise no score is good enough
    assert pii.calibrate(pii.boost(cells), [(s, c[0], 100, 50) for s, c in zip(scores, cells, strict=True)]).threshold == {}


def test_redaction(spark):
    rows = [(1, "mail a@b.co or +49 30 1234567 now", "s"), (2, "nothing here", "s"), (3, None, "s"), (4, "1.2.3.4", "s"), (5, "é\U0001f600 a@b.co\U0001f600", "s")]
    got = {r.doc_id: r for r in pii.redacted(docs(spark, rows)).collect()}
    assert got[1].text == "mail [EMAIL] or [PHONE] now" and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text, got[4].text, got[5].text) == ("nothing here", None, "[IP]", "é\U0001f600 [EMAIL]\U0001f600")


# ---------------------------------------------------------------- 8 sharding
def test_shards(spark):
    rows = [(i, "é" * (i % 5), "s") for i in range(3000)] + [(7, "again", "s"), (None, None, "s")]
    out = sharding.sharded(docs(spark, rows)).collect()
    slots: dict = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) == set(range(24))
    assert max(map(len, slots.values())) < 2 * min(map(len, slots.values()))
    one = next(r for r in out if r.doc_id == 9)
    assert (one.size, one.text_crc32) == (16, zlib.crc32("éééé".encode()))
    assert len({r.shard for r in out if r.doc_id == 7}) == 1


def test_shards_are_the_largest_draws(spark):
    def draws(key, n):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        return [xxhash.xxh64_intdigest(struct.pack("<i", i), seed) >> 11 for i in range(n)]

    def first(values):
        return values.index(max(values))

    rows = docs(spark, [(i, "x", "s") for i in [*range(0, 40_000, 97), -5, None, 2**62]])
    for r in sharding.sharded(rows).collect():
        assert (r.shard, r.grown_shard) == (first(draws(r.doc_id, 24)), first(draws(r.doc_id, 25)))
    weights = [1.0, 4.0, 2.5]
    for r in sharding.sharded(rows, 3, weights, 2.0).collect():
        scores = [w / -math.log((d + 0.5) * 2.0**-53) for w, d in zip([*weights, 2.0], draws(r.doc_id, 4), strict=True)]
        assert (r.shard, r.grown_shard) == (first(scores[:3]), first(scores))


def test_weighted_shards(spark):
    rows = docs(spark, [(i, "", "s") for i in range(4000)])
    n = {r.shard: r["count"] for r in sharding.sharded(rows, 3, [1.0, 2.0, 5.0]).groupBy("shard").count().collect()}
    assert abs(n[2] / 4000 - 5 / 8) < 0.05 and abs(n[0] / 4000 - 1 / 8) < 0.05
    with pytest.raises(ValueError):
        sharding.sharded(rows, 3, [1.0])


# ---------------------------------------------------------------- 9 simhash
def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_groups(spark):
    rng = random.Random(8)
    texts = ["", None, "A b", "a  B", "x y z", "x y z", "ÀB ÀB ÀB"] + [prose(rng, 200) for _ in range(10)]
    for base in texts[7:12]:
        words = base.split()
        for _ in range(4):
            words[rng.randrange(len(words))] = "zzz"
            texts.append(" ".join(words))
    prints = [plain_print(t) for t in texts]
    group = joined(prints)
    for r in simhash.near_duplicates(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect():
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == group[r.doc_id]


@pytest.mark.parametrize("crowd", [False, True])
def test_links_lose_nothing(spark, crowd):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for b in base:
        for _ in range(300 if crowd and b == base[0] else 25):
            x = b
            for _ in range(rng.randrange(5)):
                # a crowd differs in the upper half only, so that it shares anchors
                x ^= 1 << (32 + rng.randrange(32) if crowd else rng.randrange(64))
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    for r in edges.collect():
        assert bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 2
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    group = joined(prints)
    for i in range(len(prints)):
        for j in range(i):
            assert (roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j])) == (group[i] == group[j])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 600)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(201)) and roots[600] == roots[500] == 500


def test_one_of_each_keeps_the_smallest(spark):
    rows = [(3, "a b c d", "s"), (2, "a b c d", "s"), (2, "a b c d", "s"), (9, "quite other words here", "s"), (None, "a b c d", "s")]
    assert sorted(r.doc_id for r in simhash.one_of_each(docs(spark, rows)).collect()) == [2, 9]


def test_exact_topk_sends_no_pairs_of_blocks_through_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(0, 3, (600, 6)), 3)
    x[7, 2] = 1e7  # a block of wider numbers
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 90)
    monkeypatch.setattr(exact_topk, "BLOCK_QUERIES", 8)
    found = exact_topk.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), k=5)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    q = np.floor(64 * x).astype(np.int64)
    want = {}
    for i in range(0, 600, 20):
        order = sorted((j for j in range(600) if j != i), key=lambda j: (-int(q[i] @ q[j]), j))[:5]
        want[i] = [(j, int(q[i] @ q[j])) for j in order]
    got: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want
    for most in (127, 128, 2**15, -(2**15), -(2**15) - 1, 2**31, 2**62):
        ids, back = exact_topk.unpacked(2, np.arange(2).tobytes(), exact_topk.narrow(np.array([1, most, -3, 0])).tobytes())
        assert back.tolist() == [[1, most], [-3, 0]] and ids.tolist() == [0, 1]


def test_pools_take_new_nodes_by_arrays():
    rng = random.Random(4)
    kind = pa.list_(pa.struct([("score", pa.float64()), ("node", pa.int64()), ("seen", pa.int32())]))
    rows = []
    for i in range(1_100):  # more than a stretch
        nodes = rng.sample(range(60), rng.choice([0, 3, 12, 30]))
        pool = sorted(((rng.randrange(9) / 4, v, rng.randrange(2)) for v in nodes[::2]), key=lambda p: (-p[0], -p[1]))
        of = {v: s for s, v, _ in pool}
        rows.append((i, pool, [(of.get(v, rng.randrange(9) / 4), v, 0) for v in nodes[1::2] + nodes[:4:2]]))
    entries = lambda part: [dict(zip(("score", "node", "seen"), p, strict=True)) for p in part]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([entries(r[1]) for r in rows], kind), pa.array([entries(r[2]) for r in rows], kind)], names=["query_id", "pool", "new"])
    got = [r for out in ann._taken(8, 3)(iter([batch.slice(1)])) for r in out.to_pylist()]
    assert len(got) == 1_099
    for r, (i, pool, new) in zip(got, rows[1:], strict=True):
        visited = [v for _, v, seen in pool if not seen][:3]
        known = {v for _, v, _ in pool}
        old = [(s, v, 1 if seen or v in visited else 0) for s, v, seen in pool]
        want = sorted(old + [p for p in new if p[1] not in known], reverse=True)[:8]
        assert r == {"query_id": i, "pool": entries(want)}
