"""Fill-in-the-middle: documents cut at two unit bounds and put in another order.

Units are words with the white space before them. A document that is cut is
turned into rows, one per unit, with the unit's place and length; a running
sum over them gives where each unit ends, the document's two cut requests meet
the unit before the cut, and the offsets that come back cut the text. Nothing
but places and lengths is exploded.

Which documents are cut, and where, follows from a keyed hash of doc_id, so
reruns agree. Texts that stay plain are never shuffled. The others are, once,
by a row number, and all later steps use that partitioning: rows with one
doc_id, or one text, are spread like any others, and a document's units are
bounded by its own length.

Defined results: a null or empty text is plain, with no units and the digest
of an empty text; a null doc_id is hashed as an empty one; repeated rows are
rows like others and get equal results; texts are read whole; an empty table
gives an empty result; other columns are not read by the digest, and kept by
transformed().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Rates:
    """Percent of documents to cut, and percent of these that give the suffix first."""

    cut: int = 50
    suffix_first: int = 80
    seed: int = 42


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers that follow from seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def form(text: Column, doc_id: Column, rates: Rates) -> Column:
    """plain, spm (suffix first) or psm (prefix first)."""
    _, _, cut, first = draws(doc_id, rates.seed)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (F.length(text) == 0) | marked | (cut % 100 >= rates.cut)
    return F.when(plain, "plain").when(first % 100 < rates.suffix_first, "spm").otherwise("psm")


def unit_ends(rows: DataFrame) -> DataFrame:
    """(_row, at, end): where each unit before a document's later cut ends. rows: _row, text, _stop."""
    lengths = F.transform(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)), F.length)
    units = rows.select("_row", F.posexplode(F.slice(lengths, F.lit(1), F.col("_stop"))).alias("at", "chars"))
    along = Window.partitionBy("_row").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return units.select("_row", "at", F.sum("chars").over(along).alias("end"))


def offsets(rows: DataFrame) -> DataFrame:
    """(_of, prefix_end, middle_end) of documents: code points before each cut. rows: _row, text, _start and _stop in units."""
    requests = rows.select(F.col("_row").alias("_of"), "_start", "_stop")
    # one request row per document; the place is no join key, so that units stay where they are
    meets = (F.col("_row") == F.col("_of")) & F.array_contains(F.array(F.col("_start") - 1, F.col("_stop") - 1), F.col("at"))
    met = unit_ends(rows).join(requests, meets)
    end = lambda c: F.max(F.when(F.col("at") == F.col(c) - 1, F.col("end")))
    return met.groupBy("_of").agg(end("_start").alias("prefix_end"), end("_stop").alias("middle_end"))


def _cut(rows: DataFrame, rates: Rates) -> DataFrame:
    """`rows` that are cut, with n, prefix_chars, middle_chars and output."""
    h1, h2, _, _ = draws(F.col("doc_id"), rates.seed)
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    rows = rows.withColumns({"_a": h1 % (F.col("n") + 1), "_b": h2 % (F.col("n") + 1), "_row": F.monotonically_increasing_id()})
    rows = rows.withColumns({"_start": F.least("_a", "_b").cast("int"), "_stop": F.greatest("_a", "_b").cast("int")}).drop("_a", "_b").repartition("_row")
    placed = rows.join(offsets(rows), F.col("_row") == F.col("_of"), "left")
    at = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    placed = placed.withColumns({"prefix_chars": at("prefix_end"), "middle_chars": at("middle_end") - at("prefix_end")})
    text, a, m = F.col("text"), F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle, suffix = F.left(text, a), F.substring(text, a + 1, m), F.substring(text, a + m + 1, F.length(text))
    orders = {"psm": (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), "spm": (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)}
    psm, spm = (F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)) for parts in orders.values())
    return placed.withColumn("output", F.when(F.col("form") == "psm", psm).otherwise(spm))


def _transformed(rows: DataFrame, rates: Rates) -> DataFrame:
    """`rows` (_kept, doc_id, text without nulls) as _kept, n, form, prefix_chars, middle_chars and output."""
    rows = rows.withColumn("form", form(F.col("text"), F.col("doc_id"), rates))
    none = F.lit(None).cast("long")
    plain = rows.where("form = 'plain'").withColumns({"n": F.regexp_count("text", F.lit(UNIT)).cast("long"), "prefix_chars": none, "middle_chars": none, "output": F.col("text")})
    out = ("_kept", "n", "form", "prefix_chars", "middle_chars", "output")
    return plain.select(*out).unionByName(_cut(rows.where("form <> 'plain'"), rates).select(*out))


def transformed(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """A row per document: doc (its columns but for text), n (units), form, prefix_chars, middle_chars and output."""
    rows = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("_kept"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _transformed(rows, rates).withColumnRenamed("_kept", "doc")


def restored(output: Column, form_: Column) -> Column:
    """The text that `output` was made of. No part holds a mark, so each mark is found where it first stands."""
    body = F.substring(output, len(PREFIX) + 1, F.length(output))
    second = F.when(form_ == "psm", SUFFIX).otherwise(PREFIX)
    first, rest = F.split_part(body, second, F.lit(1)), F.split_part(body, second, F.lit(2))
    other, middle = F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))
    whole = F.when(form_ == "psm", F.concat(first, middle, other)).otherwise(F.concat(other, middle, first))
    return F.when(form_ == "plain", output).otherwise(whole)


def digest(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """One row per document: doc_id, n, form, the cuts, and SHA-256 of output and restored text."""
    out = transformed(docs.select("doc_id", "text"), rates)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc.doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
