"""Language identification, filter audit and fill-in-the-middle against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import fill_middle, filter_audit, language

from .test_operators import ODD, docs, prose

LABELS = "doc_id long, quality int, toxic int, text string, part string"


def labels(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], LABELS)


# ---------------------------------------------------------------- language identification
SYLLABLES = {
    "en": "th ing er tion the an re on at en nd sh wh ou ly".split(),
    "de": "sch ei ung ch ver lich keit be ge en er ä ö pf z".split(),
    "ru": "ст ов ни ть про ко на ра ль ый ест".split(),
}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))).capitalize() for _ in range(n)) + "."


def corpus(spark, n=400, seed=1, words=30):
    rng = random.Random(seed)
    rows = [(i, speech(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(2, words)), lang, f"s{i % 3}") for i in range(n)]
    return rows, spark.createDataFrame([(i, t, lang, s, "x", 1.0) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, lang_pred string, score double")


def plain_trigrams(text):
    low = " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
    return [low[i - 1 : i + 2] for i in range(1, len(low) - 1) if low[i] != " "]


def number(gram):
    a, b, c = (0 if x == " " else ord(x) for x in gram)
    return a << 42 | b << 21 | c


def test_trigrams_are_those_around_letters(monkeypatch):
    text = "Ünï 12 x\U00020000y, ABC-d\U0001f600 ĳß"
    for stretch in (1 << 19, 1, 2, 7):
        monkeypatch.setattr(language, "STRETCH", stretch)
        assert [int(x) for part in language.trigrams(text) for x in part] == [number(g) for g in plain_trigrams(text)]
    assert [int(x) for x in language.distinct("aa aa")] == sorted({number(g) for g in plain_trigrams("aa aa")})
    assert len(language.distinct("12 ,")) == 0 and len(language.distinct("")) == 0


def plain_languages(rows):
    """Which languages contain each trigram, by counting."""
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    n, have = Counter(r[2] for r in train), Counter((r[2], g) for r in train for g in set(plain_trigrams(r[1])))
    out = {}
    for gram in {g for _, g in have}:
        shares = {x: have[x, gram] / n[x] for x in n}
        out[gram] = {x for x, s in shares.items() if s >= language.LEAST_SHARE and s >= language.RATIO * max(shares.values())} if max(shares.values()) >= language.LEAST_SHARE else set()
    return {g: x for g, x in out.items() if x}


def test_filters_lose_no_trigram_and_counts_are_corrected(spark):
    rows, df = corpus(spark)
    filters = language.fit(df)
    assert sorted(filters.languages) == sorted(SYLLABLES)
    want = plain_languages(rows)
    grams = sorted(want)
    masks = filters.masks(np.array([number(g) for g in grams], np.uint64))
    wrong = 0
    for gram, mask in zip(grams, masks, strict=True):
        said = {x for i, x in enumerate(filters.languages) if mask[i // 8] >> (i % 8) & 1}
        assert want[gram] <= said  # a Bloom filter has no false negatives
        wrong += len(said - want[gram])
    foreign = sum(len(filters.languages) - len(x) for x in want.values())
    assert wrong <= 5 + 3 * foreign * filters.false.max()
    # trigrams of no language: what is left after the correction is near nothing
    total, counts = filters.counts("".join(chr(0x4E00 + i) for i in range(20_000)))
    assert total == 20_000 and (counts <= 0.01 * total).all()


def test_filters_that_are_crowded_are_corrected():
    rng = np.random.default_rng(1)
    table = (rng.random((4096, 1)) < 0.5).astype(np.uint8) | (rng.random((4096, 1)) < 0.8).astype(np.uint8) * 2
    filters = language.Filters(["a", "b"], table)
    assert abs(filters.false[0] - 0.5**4) < 0.01 and abs(filters.false[1] - 0.8**4) < 0.03
    total, counts = filters.counts("".join(chr(0x4E00 + i) for i in range(15_000)))
    assert (counts < 0.03 * total).all()  # 41 of 100 trigrams seem to be in b


def test_more_languages_than_a_byte_has_bits(spark):
    rows = [(i, f"{chr(97 + i % 19) * 3} {chr(97 + i % 19) * 4}", f"l{i % 19:02d}", "a") for i in range(190)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    filters = language.fit(df)
    assert len(filters.languages) == 19 and filters.table.shape[1] == 3
    assert all(filters.predict(t)[0] == lang for _, t, lang, _ in rows)


def test_held_out_documents_are_told_apart(spark):
    rows, df = corpus(spark, 600, 2)
    got = {r.doc_id: r for r in language.identified(df).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 50 and all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_predictions_follow_from_text_alone_and_held_out_labels_do_not_matter(spark):
    rows, df = corpus(spark, 300, 3)
    one = {r.doc_id: (r.lang_pred, r.score) for r in language.identified(df).collect()}
    lied = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert one == {r.doc_id: (r.lang_pred, r.score) for r in language.identified(lied.repartition(7)).collect()}


def test_languages_of_odd_rows(spark):
    got = language.identified(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    for r in got:
        text = next(t for i, t, _ in ODD if i == r.doc_id)
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == "en"
    assert language.identified(docs(spark, [])).collect() == []
    nobody = docs(spark, ODD).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identified(nobody).collect()} == {"und"}


def test_a_rare_language_beside_a_hot_one(spark):
    rng = random.Random(4)
    same = speech(rng, "en", 40)
    rows = [(i, same, "en") for i in range(600)] + [(1000 + i, speech(rng, "de", 25), "de") for i in range(60)]
    got = language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == ("en" if r.doc_id < 1000 else "de") for r in got)


def test_every_language_is_learned_however_rare(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("αβγδεζηθ") for _ in range(5)) for _ in range(30)]
    rows = [(i, speech(rng, "en", 30), "en") for i in range(900)] + [(2000 + i, " ".join(rng.sample(words, 20)), "el") for i in range(3)]
    rows += [(3000 + 10 * i + j, f"{chr(0x4E00 + i) * 3} {chr(0x4E00 + i) * 4}", f"l{i:03d}") for i in range(300) for j in range(2)]
    rows.append((9000, rows[0][1], "zz"))  # a mark that is wrong takes nothing from the language of the text
    df = spark.createDataFrame([*rows, (9001, "12", "en"), (9002, None, "en")], "doc_id long, text string, lang string")
    learned = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    one = {r.doc_id: (r.lang_pred, r.score) for r in language.identified(df).collect()}
    assert len(one) == len(rows) + 2 and one[9001] == one[9002] == ("und", 0.0)
    assert all(one[i][0] == ("en" if i == 9000 else lang) for i, _, lang in rows if lang in learned and lang != "zz")
    # the same from several tables, all of these filters having BLOCK positions or more
    monkeypatch.setattr(language, "TABLE_BYTES", language.BLOCK * 8)
    assert len(list(language.tables(df))) >= 4
    several = {r.doc_id: (r.lang_pred, r.score) for r in language.identified(df).collect()}
    assert {i: x[0] for i, x in several.items()} == {i: x[0] for i, x in one.items()}
    assert all(abs(x[1] - one[i][1]) < 0.05 for i, x in several.items())


# ---------------------------------------------------------------- filter audit
def plain_masks(rows):
    """(part, doc_id, set of failed filters) by their definition."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and i > first.get(t, i) else set()
        out.append((s or "", i, fails))
    return out


def plain_audit(rows, label_rows):
    masks = plain_masks(rows)
    good, toxic = {i for i, q, _ in label_rows if q == 1} - {None}, {i for i, _, t in label_rows if t == 1} - {None}
    out = {}
    for part in {p for p, _, _ in masks}:
        own = [(i, f) for p, i, f in masks if p == part]
        removed_in_all = Counter()
        for order in itertools.permutations("ABCDE"):
            left, gone = list(own), []
            for step, x in enumerate(order, 1):
                cut = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                removed_in_all[x] += len(cut)
                counts = [len(left), len(cut), sum(x in f for _, f in gone), sum(f == {x} for _, f in own), sum(i in good for i, _ in cut), sum(i in toxic for i, _ in cut)]
                gone += cut
                out[part, "".join(order), step] = counts
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed_in_all[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, rows, label_rows):
    got = filter_audit.audit(docs(spark, rows), labels(spark, label_rows)).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(found) == len(got)
    return found


def filtered_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.choice([3, 60, 90]))
        if rng.random() < 0.3:
            text = " ".join(str(rng.randrange(10**6)) for _ in range(rng.choice([40, 70])))
        text = text.upper() if rng.random() < 0.2 else text
        text = text + rng.choice("#$%&*|") if rng.random() < 0.2 else text
        rows.append((rng.choice([i, i, i, None, rng.randrange(n)]), rng.choice([text, text, None, "", "same " * 60]), rng.choice(["a", "b", None, ""])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_audit_is_its_definition(spark, seed):
    rows = filtered_rows(150, seed)
    rng = random.Random(seed)
    label_rows = [(rng.choice([i, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(150) for _ in range(rng.choice([0, 1, 2]))]
    assert audited(spark, rows, label_rows) == plain_audit(rows, label_rows)


def test_audit_of_odd_rows_and_of_nothing(spark):
    assert audited(spark, ODD, []) == plain_audit(ODD, [])
    assert audited(spark, [], [(1, 1, 1)]) == {}


def test_audit_of_copies_that_hold_most_rows(spark):
    rows = [(i, "Copy # of a text", "hot") for i in range(500, 0, -1)] + [(7, "Copy # of a text", "cold"), (1, "Copy # of a text", "cold"), (None, "Copy # of a text", "cold")]
    got = audited(spark, rows, [(1, 1, 0), (2, 0, 1)])
    assert got == plain_audit(rows, [(1, 1, 0), (2, 0, 1)])
    assert got["hot", "EABCD", 1][:2] == (1, 499) and got["cold", "EABCD", 1][:2] == (2, 1)


def test_shares_of_removal_add_up(spark):
    rows = filtered_rows(80, 9)
    got = audited(spark, rows, [])
    for part in {k[0] for k in got}:
        own = [f for p, _, f in plain_masks(rows) if p == part]
        assert sum(got[part, "ABCDE", s][6] for s in range(1, 6)) == 120 * sum(bool(f) for f in own)


# ---------------------------------------------------------------- fill-in-the-middle
def plain_cut(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def middle_rows():
    rng = random.Random(5)
    out = list(ODD)
    for i in range(100, 220):
        text = prose(rng, rng.randrange(1, 30))
        text = rng.choice([text, "\n\n" + text + " \t", text.replace("e", "́\U0001f600"), text + rng.choice(["<", "<S", "<P>x", " <M>"]), "S>" + text + "<", "  " + text])
        out.append((i, text, "a"))
    return out + [(300, "same text", "a")] * 40 + [(i, "same text", "a") for i in range(400, 440)]


def test_cuts_are_their_definition(spark):
    rows = middle_rows()
    got = sorted(fill_middle.digest(docs(spark, rows)).collect(), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        n, form, a, m, out = plain_cut(i, t)
        want.append((i, n, form, a, m, sha(out), sha(t or "")))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_outputs_restore_and_other_columns_stay(spark):
    df = docs(spark, middle_rows())
    out = fill_middle.transformed(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    assert out.schema["doc"].dataType.names == [c for c in df.columns if c != "text"]
    got = sorted((str(r.doc.doc_id), r.doc.key, r.back, r.output) for r in out.collect())
    assert got == sorted((str(i), "x", t or "", plain_cut(i, t)[4]) for i, t, _ in middle_rows())


def test_rates_of_forms(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    share = lambda rates: {r.form: r["count"] / 3000 for r in fill_middle.transformed(df, rates).groupBy("form").count().collect()}
    half = share(fill_middle.Rates())
    assert abs(half["plain"] - 0.5) < 0.03 and abs(half["spm"] - 0.4) < 0.03 and abs(half["psm"] - 0.1) < 0.03
    assert set(share(fill_middle.Rates(cut=100, suffix_first=0))) == {"psm"} and set(share(fill_middle.Rates(cut=0))) == {"plain"}


def test_cuts_of_nothing(spark):
    assert fill_middle.digest(docs(spark, [])).collect() == []
