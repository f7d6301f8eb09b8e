"""How quality filters interact: what each removes, alone and after others, in every order.

Five filters become a five-bit mask of failures per document. Documents are
counted per part and mask (32 cells a part, with the good and the toxic ones
among them), and whatever an order of filters would keep, remove or see twice
is a sum of cells: no order is ever run over the documents.

The fifth filter fails a text that a smaller doc_id has too. Texts are grouped
by their length and SHA-256, so that no text is shuffled. Rows are counted per
doc_id and text before they meet the smallest doc_id of their text, and groups
of copies shrink to a row per part and label before they come together: a text
that a third of all rows share is a few rows by then.

Defined results: a null text is an empty one, and all empty texts are equal; a
null doc_id is smaller than none and greater than none, so its row neither
fails nor makes others fail the fifth filter, and has no labels; of rows with
one doc_id and one text none is removed for the others; a document is good (or
toxic) if one of its label rows says so; a null source is the part of empty
sources; texts are read whole; an empty table has no parts and no rows; other
columns are not read.
"""

from __future__ import annotations

import itertools
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD

#: Filters in the order of their bits; a document that fails one has its bit set.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SIGNS = "[#$%&*|]"
CELLS = 1 << len(FILTERS)
#: Parts of rows without doc_id, which no label meets.
SPREAD = 1024


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def own_failures(text: Column, words: Column) -> Column:
    """The bits of A to D, which a text decides alone; `words` are its words."""
    total = F.size(words)
    fails = {
        "A": total < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < total.cast("long") * LEAST_DISTINCT,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * MOST_CAPITALS,
        "D": text.rlike(SIGNS),
    }
    out = F.lit(0)
    for letter, failed in fails.items():
        out = out + F.when(failed, bit(letter)).otherwise(0)
    return out


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """`rows` with 0/1 columns good and toxic; rows without doc_id have no labels and are spread by their text."""
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_good"), F.max("toxic").alias("_toxic")).withColumn("_at", F.lit(0))
    rows = rows.withColumn("_part", F.when(F.col("doc_id").isNull(), F.pmod(F.crc32("digest"), F.lit(SPREAD))).otherwise(0).cast("int"))
    out = rows.join(known, (F.col("doc_id") == F.col("_id")) & (F.col("_part") == F.col("_at")), "left")
    flag = lambda c: (F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")
    return out.select(*rows.columns, flag("_good").alias("good"), flag("_toxic").alias("toxic"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and mask, in all and with either label."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("_text"))
    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    digest = F.concat_ws(":", F.length("_text").cast("string"), F.sha2("_text", 256))
    rows = rows.select("doc_id", "part", digest.alias("digest"), own_failures(F.col("_text"), F.col("_words")).alias("own"))
    # repeated rows first, so that neither a doc_id nor a text is a hot key of the join
    kinds = ("digest", "part", "own")
    rows = labelled(rows.groupBy("doc_id", *kinds).agg(F.count("*").alias("n")), labels)
    of = (*kinds, "good", "toxic")
    no_id = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    copies = rows.groupBy(*of).agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"), no_id.alias("n_no_id"))
    first = F.min("low").over(Window.partitionBy("digest"))  # a row per part and label
    passed = F.col("n_no_id") + F.when(F.col("low") == first, F.col("n_low")).otherwise(0)
    copies = copies.withColumn("passed", F.coalesce(passed, F.lit(0)))
    both = F.array(F.struct(F.col("own").alias("mask"), F.col("passed").alias("n")), F.struct((F.col("own") + bit("E")).alias("mask"), (F.col("n") - F.col("passed")).alias("n")))
    split = copies.select("part", "good", "toxic", F.explode(both).alias("c"))
    n = F.col("c.n")
    return split.where("c.n > 0").groupBy("part", "c.mask").agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def kept_by_subset(histogram: DataFrame) -> DataFrame:
    """A row per part with arrays all_kept, good_kept and toxic_kept: documents that pass every filter of a subset, by the subset's bits."""
    own = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # CELLS items at most

    def kept(count: str) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(CELLS - 1)),
            lambda s: F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(c["mask"].bitwiseAND(s) == 0, c[count]).otherwise(0)),
        )

    return own.select("part", *(kept(n).alias(name) for name, n in (("all_kept", "n"), ("good_kept", "good"), ("toxic_kept", "toxic"))))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of that step."""
    parts = kept_by_subset(cells(docs, labels))
    orders = F.array(*(F.lit("".join(o)) for o in itertools.permutations(FILTERS)))
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    own, earlier = F.lit(0), F.lit(0)
    for letter in FILTERS:
        place = F.instr("filter_order", letter)
        own = own + F.when(place == F.col("step"), bit(letter)).otherwise(0)
        earlier = earlier + F.when(place < F.col("step"), bit(letter)).otherwise(0)
    steps = steps.withColumns({"own": own, "earlier": earlier})
    at = lambda array, subset: F.get(array, subset)
    fresh = lambda array: at(array, F.col("earlier")) - at(array, F.col("earlier") + F.col("own"))
    failing = at("all_kept", F.lit(0)) - at("all_kept", F.col("own"))
    # of all orders, those in which just the filters of a subset come before this one
    orders_with = F.array(*(F.lit(factorial(s.bit_count()) * factorial(max(0, len(FILTERS) - 1 - s.bit_count()))) for s in range(CELLS)))
    share = lambda s: F.when(s.bitwiseAND(F.col("own")) == 0, at(orders_with, s) * (at("all_kept", s) - at("all_kept", s.bitwiseOR(F.col("own"))))).otherwise(0)
    shapley = F.aggregate(F.sequence(F.lit(0), F.lit(CELLS - 1)), F.lit(0).cast("long"), lambda acc, s: acc + share(s))
    return steps.select(
        "part",
        "filter_order",
        "step",
        at("all_kept", F.col("earlier") + F.col("own")).alias("kept"),
        fresh("all_kept").alias("removed"),
        (failing - fresh("all_kept")).alias("redundant"),
        (at("all_kept", F.lit(CELLS - 1) - F.col("own")) - at("all_kept", F.lit(CELLS - 1))).alias("unique_fails"),
        fresh("good_kept").alias("good_lost"),
        fresh("toxic_kept").alias("toxic_lost"),
        shapley.alias("shapley"),
    )
