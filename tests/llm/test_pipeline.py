"""The corpus pipeline on planted documents, stage by stage against plain versions."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

from causeway.llm import near_copies, simhash

from .test_operators import base_spans, joined, plain_ids, plain_print, prose

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, tmp_path):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(300):
        text = prose(rng, rng.randrange(20, 80))
        toxic = int(rng.random() < 0.25)
        if toxic:
            text += " you idiot"
        elif i % 10 == 0:
            text += f" mail p{i}@example.org"
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, 0, toxic))
    rows += [(400 + i, rows[i][1], "en", "src0", rows[i][4]) for i in range(0, 60, 2)] + [(500, None, "en", None, None), (501, "", "en", None, 0)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text_of = {r[0]: r[1] for r in rows}

    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns
    assert kept == {r[0] for r in rows if "idiot" not in (r[1] or "")}

    single = corpus_pipeline.drop_near_copies(spark, clean, str(tmp_path))
    ids = sorted(kept)
    group = joined([plain_print(text_of[i]) for i in ids])
    assert {r.doc_id for r in single.collect()} == {ids[g] for g in set(group)}

    masked = {r.doc_id: r.text for r in corpus_pipeline.redact(spark, single, str(tmp_path)).collect()}
    for i, text in masked.items():
        assert not base_spans(text or "")
        assert ("[EMAIL]" in (text or "")) == ("@" in (text_of[i] or ""))

    out = corpus_pipeline.run(spark, str(tmp_path))
    total = out.agg(F.sum("length")).first()[0]
    pieces = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("length").alias("l")).collect()
    assert {p.doc_id for p in pieces} <= set(masked)
    for p in pieces:
        assert p.l % (len(plain_ids(masked[p.doc_id])) + 1) == 0
    assert out.select("sequence_id").distinct().count() == -(-total // 2048)


def test_stages_name_the_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "best_fit_packing"]
    assert corpus_pipeline.STAGES[1][1].__module__ == "corpus_pipeline" and simhash.DISTANCE == 2


def test_near_copies_from_four_fifths(spark):
    rng = random.Random(11)
    texts = {}
    for i in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        texts[i * 10] = " ".join(words)
        for j in range(1, 6):
            copy = list(words)
            for at in rng.sample(range(len(copy)), max(1, round(len(copy) * rng.choice([0.004, 0.01, 0.02, 0.025, 0.05])))):
                copy[at] = "edited"
            texts[i * 10 + j] = " ".join(copy)
    # a passage that all have, copies of one text by the hundred, and short texts
    texts |= {1000 + i: prose(random.Random(5), 60) + " " + prose(rng, 30) for i in range(60)}
    base = [f"v{i}" for i in range(300)]
    texts |= {2000 + i: " ".join(base[: i + 1] + ["other", str(i)] + base[i + 3 :]) for i in range(0, 250)}
    texts |= {3000: "a b c", 3001: "a  b C", 3002: "a b c d", 3003: None, 3004: " ", 3005: "a b c d e f"}

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    ids = sorted(texts)
    sets = [shingles(texts[i]) for i in ids]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    between = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both, either = len(a & sets[j]), len(a | sets[j])
            if 5 * both >= 4 * either:
                between += both < 0.95 * either
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert between > 50
    docs = spark.createDataFrame([(i, texts[i], "en", "s", 1) for i in ids] + [(0, texts[0], "en", "s", 1)], DOCUMENTS)
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept) == sorted({ids[find(i)] for i in range(len(ids))})
    assert near_copies.one_of_each(docs.where("false")).count() == 0


def test_pairs_that_sketches_rule_out_are_no_rows(spark):
    sketch = lambda *at: bytes(5 if i in at else 0 for i in range(near_copies.CLASSES))
    # one shared shingle, sets of ten; the first two may be alike, the third is in other classes
    members = [(7, 10, 1, 0, 1, sketch(0, 1)), (7, 10, 2, 0, 2, sketch(0, 1)), (7, 10, 3, 0, 3, sketch(2, 3)), (8, 10, 3, 0, 3, sketch(2, 3))]
    df = spark.createDataFrame(members, "key long, n int, node long, at int, root long, sketch binary")
    assert [(r.a, r.b) for r in near_copies._pairs(df, 1, None).collect()] == [(1, 2)]
