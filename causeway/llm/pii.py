"""Personal data: high-recall candidates, boosted trees, calibrated thresholds.

Base spans come from fixed patterns and checks and always stay. Wider
generators propose further, overlapping candidates of the same kinds: spelled
out addresses, other separators, numbers without a plus, the well-formed part
of a longer run. Each candidate has a few small integer features of its format
(of the form it stands for, so a spelled-out address is judged like a plain
one) and its context.

Candidates that are base spans are true. False are those that fail their
kind's check and those that overlap a base span of another kind. All others
have no label and aren't learned from. How forms that no base span has are to
be judged comes from EXAMPLES, a short list of labelled phrases. Candidates of
all documents are counted per feature vector (a table bounded by the features'
ranges); boosted trees are fitted to the counts of three quarters of the
texts and the examples. Scores are calibrated (isotonic regression) per kind,
on the other quarter of the texts for forms that base spans have, and on the
examples for all others, each scored by trees that were fitted without it. A
candidate is added from a calibrated chance of PRECISION on, if no base span
overlaps it.

Main path: DataFrame functions only. Matches become rows, features are columns
of rows, and each feature vector is scored once, in a table that rows join.

Matching is leftmost and without overlap, as the patterns say. Two devices
keep it linear on long texts and change no match: possessive repeats where the
next character can't belong to the class, and a start only at the previous
match's end or where no character of the leading class stands before, since a
match from within such a run could also start at its begin. Candidates meet
base spans as sorted rows of a document, in one pass.

Defined results: a null or empty text has no spans; offsets are code points,
end exclusive; repeated rows and null ids are rows like others; an empty table
gives an empty result; other columns, of any name, are kept by redacted() and
else not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "A-Za-z0-9._%+-"
_HOST = "[A-Za-z0-9-]++"
#: What finds the base spans, by kind.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@{_HOST}(?:\.{_HOST})++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:@|\x20?[\[({]at[\])}]\x20?|\x20at\x20)", r"(?:\.|\x20?[\[({]dot[\])}]\x20?|\x20dot\x20)"
#: What proposes candidates: kind and pattern.
WIDE = {
    "email": ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++{_AT}{_HOST}(?:{_DOT}{_HOST})++"),
    "ip": ("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:(?:\.|\[\.\]|\x20\.\x20)[0-9]++){3}"),
    "card": ("card", r"(?<![0-9])[0-9](?:[\x20.\-/]?[0-9]){11,18}(?![0-9])"),
    "phone": ("phone", r"(?<![0-9A-Za-z+(])\+?\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,14}(?![0-9A-Za-z])"),
    # the area code, three digits and four
    "grouped": ("phone", r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}[\x20.\-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[\x20.\-]?[0-9]{3}[\x20.\-][0-9]{4}(?![0-9A-Za-z])"),
}
#: Without one of these a text has no match of the kind.
NEEDS = {"email": r"@|[\[({]at[\])}]|\x20at\x20", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
#: Words before personal data, by kind.
CUES = {
    "email": "mail|contact|write|reach|send",
    "ip": "ip|addr|server|host|from|login|client",
    "card": "card|visa|credit|account|konto|pay",
    "phone": "tel|phone|call|mobile|fax|cell|ring|text|whatsapp",
}
# Phrases whose candidates are all true, or all false.
TRUE_EXAMPLES = (
    "jane [at] mail.org", "john(at)example.com", "mail john.roe [at] example [dot] com", "write to jane.doe at example dot org", "contact: j_smith {at} mail.example.net",
    "reach me at.", "e-mail max at post dot example dot de", "mail anna (at) web.example", "anna.k (at) web (dot) example", "send it to bob [at] site.io",
    "(030) 123-4567", "call (212) 555-0188 now", "tel 212-555-0188", "phone: 030 1234567", "fax 089/1234567", "mobile 0170 1234567", "cell 415.555.0133",
    "ring 020 7946 0018", "my phone is (415) 555-0133", "phone 2125550188", "(0221) 470-1234", "212-555-0188 or 212-555-0189", "415.555.0133", "tel. 030-123 4567",
    "ip 10[.]1[.]2[.]3", "host 192[.]168[.]0[.]17", "from 8 . 8 . 4 . 4", "server 172[.]16[.]5[.]9 down", "203[.]0[.]113[.]9", "login 198[.]51[.]100[.]23",
    "card 4111.1111.1111.1111", "visa 4111/1111/1111/1111", "pay with 5500.0000.0000.0004", "credit card: 3400/000000/00009", "4012/8888/8888/1881", "card 6011.1111.1111.1117",
)
FALSE_EXAMPLES = (
    "we met at noon.then left", "look at example.com", "arrived at paris.it rained", "sold at shop.example today", "the talk at pycon.org was good", "bought at store dot",
    "order 1234567890", "id 987654321012", "number 300400500", "2024-01-02 10:20", "on 2023-11-30 09", "page 123-456-789", "978-3-16-148410-0", "isbn 978 3 16 148410",
    "lot 20240102030405", "1 2 3 4 5 6 7 8 9", "10 20 30 40 50 60", "serial 0012003400560078", "total 1.234.567.890", "12/11/2023 10/11/2023", "3.141592653589793", "code 555123456",
    "version 1 . 2 . 3 . 4", "1 . 2 . 3 . 4", "section 10 . 4 . 2 . 1 says", "items 1 . 2 . 3 . 4",
    "4111.1111.1111.1112", "scores 10/12/10/12/10/12/10", "1.2.3.4.5.6.7.8.9.10.11.12", "0000/0000/0000/0000",
)

ROUNDS, RATE, DEPTH, SHRINK = 24, 0.3, 3, 4.0
#: A threshold is the least score at which the calibrated share of true candidates is so large.
PRECISION = 0.9
#: Candidates that an example counts as; one text of so many is for calibration.
EXAMPLE_WEIGHT, HELD_OUT = 50, 4
#: Code points of context before a candidate.
BEFORE = 24


#: All generators: name, kind, pattern; base ones first.
GENERATORS = [*((f"base_{k}", k, p) for k, p in BASE.items()), *((n, k, p) for n, (k, p) in WIDE.items())]
#: What a text without any match has none of.
NEEDS_ANY = "|".join(sorted(set(NEEDS.values())))
_MATCH = "struct<g:int,m:string,gap:int,before:string,first:string>"


def matches(text: Column) -> Column:
    """An array of each generator's matches in turn: generator g, match m, code points since the last match (gap) and the end of these, and their first one.

    Each generator's matches are followed by an item without match, for what stands after the last.
    """

    def of(g: int, kind: str, pattern: str) -> Column:
        item = lambda m, between: F.struct(
            F.lit(g).alias("g"), m.alias("m"), F.length(between).alias("gap"), F.right(between, F.lit(BEFORE)).alias("before"), F.left(between, F.lit(1)).alias("first")
        )
        found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), item)
        # most texts are searched once, up to no match
        return F.when(text.rlike(NEEDS[kind]) & text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_MATCH}>"))

    every = F.array(*(of(g, kind, pattern) for g, (_, kind, pattern) in enumerate(GENERATORS)))
    return F.flatten(F.filter(every, lambda x: F.size(x) > 1))


def placed(found: DataFrame) -> DataFrame:
    """`found` (_id, _matches and others) as a row per match: s, e, k, generator g, m, before, after."""
    others = [c for c in found.columns if c not in ("_id", "_matches")]
    rows = found.where(F.size("_matches") > 0).select("_id", *others, F.posexplode("_matches").alias("_i", "_c")).select("_id", *others, "_i", "_c.*").repartition("_id")
    along = Window.partitionBy("_id", "g").orderBy("_i")
    end = F.sum(F.col("gap") + F.coalesce(F.length("m"), F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"e": end.cast("int"), "after": F.lead("first").over(along)}).where(F.col("m").isNotNull())
    kinds = F.array(*(F.lit(KINDS.index(k)) for _, k, _ in GENERATORS))
    return rows.withColumns({"s": F.col("e") - F.length("m"), "k": F.get(kinds, F.col("g"))}).drop("_i", "gap", "first")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    last_first = F.split(F.reverse(digits), "(?<=.)(?=.)")
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(last_first, value), F.lit(0), lambda acc, x: acc + x) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


#: Ranges of the features; `form` is 0 where a base span may be written so.
RANGES = {"kind": 4, "digits": 8, "valid": 2, "shape": 3, "form": 3, "cue": 3, "quoted": 2, "glued": 2}


def plain(kind: str, m: Column) -> Column:
    """The form that a candidate stands for."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(m, rf"{_AT}(?=[A-Za-z0-9-])", "@"), rf"{_DOT}(?=[A-Za-z0-9-])", ".")
    if kind == "ip":
        return F.regexp_replace(m, r"\[\.\]|\x20\.\x20", ".")
    return F.regexp_replace(m, "[./]", " ") if kind == "card" else m


def per_kind(values: dict[str, Column]) -> Column:
    """The value that belongs to a row's kind k."""
    out = F
    for i, kind in enumerate(KINDS):
        out = out.when(F.col("k") == i, values[kind])
    return out


def features() -> dict[str, Column]:
    """Features of a row (k, before, after, match m, plain form _f)."""
    m, form = F.col("m"), F.col("_f")
    flag = lambda x: F.when(x, 1).otherwise(0)
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    cue = lambda words: F.col("before").rlike(rf"(?i)(?<![A-Za-z])(?:{words})[a-z]{{0,6}}(?:[\x20:=#.\-]{{1,3}}(?:is|me|at|to|it|us|with|number|no)?[\x20:]{{0,2}}){{1,2}}\(?$")
    shapes = {
        "email": (form.rlike(r"\.[A-Za-z]{2,4}$"), form.rlike(r"\.[A-Za-z]+$")),
        "ip": (~form.rlike(r"(?:^|\.)0"), ~form.rlike(r"(?:^|\.)[0-9](?:\.[0-9])+$")),
        "card": (form.rlike(r"^[0-9]{4}(?:[ -][0-9]{4})+$"), ~form.rlike("[^0-9]")),
        "phone": (form.rlike(WIDE["grouped"][1].replace("(?<![0-9A-Za-z+(])", "^").replace("(?![0-9A-Za-z])", "$")), form.rlike(r"^[+(]?[0-9]{2,5}\)?[ /.\-][0-9 \-]{4,}$")),
    }
    forms = {
        "email": F.when(m.contains("@"), 0).when(m.rlike(r"[\[({]at[\])}]"), 1).otherwise(2),
        "ip": F.when(m.rlike(r"\[\.\]"), 1).when(m.contains(" "), 2).otherwise(0),
        "card": F.when(m.contains("/"), 1).when(m.contains("."), 2).otherwise(0),
        "phone": F.when(m.startswith("+"), 0).otherwise(1),
    }
    valid = {kind: passes(kind, form) for kind in KINDS}
    valid["email"] = form.rlike(rf"^[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}$")
    return {
        "kind": F.col("k"),
        "digits": F.least(F.floor(digits / 3), F.lit(7)).cast("int"),
        "valid": flag(per_kind(valid)),
        "shape": per_kind({k: F.when(x, 2).when(y, 1).otherwise(0) for k, (x, y) in shapes.items()}),
        "form": per_kind(forms),
        "cue": F.when(per_kind({k: cue(CUES[k]) for k in KINDS}), 2).when(cue("|".join(CUES.values())), 1).otherwise(0),
        "quoted": flag(F.col("before").rlike("[\"'=]\\s?$")),
        "glued": flag(F.col("before").rlike("[A-Za-z0-9]$") | F.col("after").rlike("[A-Za-z0-9]")),
    }


def judged(found: DataFrame) -> DataFrame:
    """A row per place that is a base span or a candidate: is_base, features (null if no generator proposes it), `free` of base spans, and `y`, null if unlabelled.

    `found` has _id, _matches, _fold and _label (of examples).
    """
    rows = placed(found)
    wide = F.col("g") >= len(BASE)
    rows = rows.withColumn("_f", per_kind({k: plain(k, F.col("m")) for k in KINDS}))
    rows = rows.withColumn("b", F.when(wide, 0).when(per_kind({k: passes(k, F.col("m")) for k in KINDS}), 1)).where("b is not null")
    rows = rows.withColumns({n: F.when(wide, x) for n, x in features().items()})
    rows = rows.groupBy("_id", "_fold", "_label", "s", "e", "k").agg(F.max("b").alias("is_base"), *(F.max(n).alias(n) for n in RANGES))
    # both ways as growing frames; a frame that shrinks is built anew for each row
    before, after = (Window.partitionBy("_id").orderBy(x).rangeBetween(Window.unboundedPreceding, 0) for x in (F.col("s").asc(), F.col("s").desc()))
    of = lambda i, c: F.when((F.col("is_base") == 1) & (F.col("k") == i), F.col(c))
    rows = rows.withColumns({f"_e{i}": F.max(of(i, "e")).over(before) for i in range(len(KINDS))} | {f"_s{i}": F.min(of(i, "s")).over(after) for i in range(len(KINDS))})
    meets = [F.coalesce(F.col(f"_e{i}") > F.col("s"), F.lit(False)) | F.coalesce(F.col(f"_s{i}") < F.col("e"), F.lit(False)) for i in range(len(KINDS))]
    any_, other = F.lit(False), F.lit(False)
    for i, met in enumerate(meets):
        any_, other = any_ | met, other | (met & (F.col("k") != i))
    y = F.when(F.col("_label").isNotNull(), F.col("_label")).when(F.col("is_base") == 1, 1).when((F.col("valid") == 0) | other, 0)
    return rows.select("_id", "_fold", "_label", "s", "k", "e", "is_base", *RANGES, (~any_).alias("free"), y.alias("y"))


@dataclass
class Trees:
    """Boosted trees over the features: nested (feature, at most, low, high) or a leaf's value."""

    bias: float
    trees: list
    threshold: dict[int, float]

    def raw(self, row: dict[str, int]) -> float:
        def value(t) -> float:
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            return t

        return self.bias + sum(value(t) for t in self.trees)


def boost(cells: list[tuple[dict[str, int], int, int]]) -> Trees:
    """Second-order logistic boosting on counted feature vectors (row, candidates, true ones)."""
    n, y = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not cells or not y or y == n:
        return Trees(9.0 if cells and y else -9.0, [], {})
    bias = math.log(y / (n - y))
    raw = [bias] * len(cells)

    def grow(at: list[int], depth: int):
        g = sum(grad[i] for i in at)
        h = sum(hess[i] for i in at)
        best = None
        if depth:
            for name, top in RANGES.items():
                sums = [[0.0, 0.0] for _ in range(top)]
                for i in at:
                    s = sums[cells[i][0][name]]
                    s[0] += grad[i]
                    s[1] += hess[i]
                gl = hl = 0.0
                for cut in range(top - 1):
                    gl, hl = gl + sums[cut][0], hl + sums[cut][1]
                    if hl > 1 and h - hl > 1:
                        gain = gl * gl / (hl + SHRINK) + (g - gl) ** 2 / (h - hl + SHRINK) - g * g / (h + SHRINK)
                        if gain > 1e-6 and (best is None or gain > best[0]):
                            best = (gain, name, cut)
        if best is None:
            return round(-RATE * g / (h + SHRINK), 9)
        _, name, cut = best
        low = [i for i in at if cells[i][0][name] <= cut]
        high = [i for i in at if cells[i][0][name] > cut]
        return (name, cut, grow(low, depth - 1), grow(high, depth - 1))

    trees = []
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-x)) for x in raw]
        grad = [c[1] * q - c[2] for c, q in zip(cells, p, strict=True)]
        hess = [c[1] * q * (1 - q) for c, q in zip(cells, p, strict=True)]
        tree = grow(list(range(len(cells))), DEPTH)
        trees.append(tree)
        one = Trees(0.0, [tree], {})
        raw = [x + one.raw(c[0]) for x, c in zip(raw, cells, strict=True)]
    return Trees(bias, trees, {})


def judge(row: dict[str, int]) -> int:
    """Which threshold a candidate meets: its kind's, one for forms that base spans have and one for all others."""
    return row["kind"] + (len(KINDS) if row["form"] else 0)


def calibrate(model: Trees, scored: list[tuple[float, dict[str, int], int, int]], least: float = PRECISION) -> Trees:
    """Per judge the score from which the calibrated share of true candidates is at least `least`. scored: score, row, candidates, true ones.

    It stands midway between the lowest good score and the next one below.
    """
    for one in range(2 * len(KINDS)):
        steps: list[list] = []  # rising scores: [lowest score, highest, candidates, true ones], pooled until shares rise too
        for score, n, true in sorted((x, n, true) for x, row, n, true in scored if judge(row) == one):
            steps.append([score, score, n, true])
            while len(steps) > 1 and (steps[-2][1] == steps[-1][0] or steps[-2][3] * steps[-1][2] >= steps[-1][3] * steps[-2][2]):
                _, high, n, true = steps.pop()
                steps[-1][1] = high
                steps[-1][2] += n
                steps[-1][3] += true
        good = [i for i, (_, _, n, true) in enumerate(steps) if true >= least * n]
        if good:
            low = steps[good[0]][0]
            model.threshold[one] = (low + steps[good[0] - 1][1]) / 2 if good[0] else low
    for kind in range(len(KINDS)):  # nothing to go by: as other forms of the kind
        if not any(judge(row) == kind for _, row, _, _ in scored) and kind + len(KINDS) in model.threshold:
            model.threshold[kind] = model.threshold[kind + len(KINDS)]
    return model


def examples(spark: SparkSession) -> DataFrame:
    """The labelled phrases as texts: _id below 0, _text, _label."""
    phrases = [(t, 1) for t in TRUE_EXAMPLES] + [(t, 0) for t in FALSE_EXAMPLES]
    return _local(spark, {"_id": [-i - 1 for i in range(len(phrases))], "_text": [t for t, _ in phrases], "_label": [y for _, y in phrases]}, "_id long, _text string, _label int")


def _local(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A small table of the driver; no Python runs on executors for it."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    return spark.createDataFrame(pa.table([pa.array(v, t) for v, t in zip(columns.values(), types, strict=True)], names=list(columns)), schema)


def fit(rows: DataFrame) -> Trees:
    """Fit on the judged candidates of all documents; what is collected is bounded by RANGES.

    Phrases count EXAMPLE_WEIGHT times. For the thresholds each one is scored
    by trees that were fitted without it, in HELD_OUT groups.
    """
    names = list(RANGES)
    known = rows.where("kind is not null and y is not null")
    labelled, group = F.col("_label").isNotNull(), F.pmod("_id", F.lit(HELD_OUT))
    counted = known.withColumns({"own": ~labelled, "part": F.when(labelled, group).otherwise((F.col("_fold") != 0).cast("int"))})
    cells = counted.groupBy("own", "part", *names).agg(F.count("*").alias("n"), F.sum("y").alias("true")).collect()

    def some(keep, times: int = 1) -> list[tuple[dict[str, int], int, int]]:
        return sorted((({x: r[x] for x in names}, r["n"] * times, r["true"] * times) for r in cells if keep(r)), key=lambda c: tuple(c[0].values()))

    documents, held = some(lambda r: r["own"] and r["part"] == 1), some(lambda r: r["own"] and r["part"] == 0)
    scored = []
    for part in range(HELD_OUT):
        rest = boost([*some(lambda r: not r["own"] and r["part"] != part, EXAMPLE_WEIGHT), *documents])
        scored += [(rest.raw(c[0]), *c) for c in some(lambda r: not r["own"] and r["part"] == part, EXAMPLE_WEIGHT)]
    model = boost([*some(lambda r: not r["own"], EXAMPLE_WEIGHT), *documents])
    return calibrate(model, [*scored, *((model.raw(c[0]), *c) for c in held)])


def chosen(rows: DataFrame, model: Trees) -> DataFrame:
    """The base spans and the added ones of `rows`: _id, s, k, e, is_base. Each feature vector is scored once."""
    names = list(RANGES)
    open_ = (F.col("is_base") == 0) & F.col("free")
    met = [{x: r[x] for x in names} for r in rows.where(open_).select(*names).distinct().collect()]
    good = [c for c in met if model.raw(c) >= model.threshold.get(judge(c), math.inf) - 1e-9]
    cells = _local(rows.sparkSession, {f"_{x}": [c[x] for c in good] for x in names}, ", ".join(f"_{x} int" for x in names)).withColumn("_good", F.lit(True))
    on = [F.col(x) == F.col(f"_{x}") for x in names]
    joined = rows.join(F.broadcast(cells), on, "left")  # bounded by RANGES
    return joined.where((F.col("is_base") == 1) | (open_ & F.col("_good"))).select("_id", "s", "k", "e", "is_base")


def spans_of(found: DataFrame) -> DataFrame:
    """The chosen spans of `found` (_id, _text or _matches and _fold), as rows.

    Candidates are written once, since they are counted, scored and chosen.
    """
    more = examples(found.sparkSession)
    phrases = more.select("_id", matches(F.col("_text")).alias("_matches"), F.lit(0).alias("_fold"), "_label")
    every = found.select("_id", "_matches", "_fold", F.lit(None).cast("int").alias("_label")).unionByName(phrases)
    rows = materialise(judged(every), "candidates")
    return chosen(rows, fit(rows)).where("_id >= 0")


def matched(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """`keep` of `docs` (with _text, without nulls), a row number, the matches and the part of the texts; written, so that no later use changes the numbers."""
    fold = F.pmod(F.xxhash64("_text"), F.lit(HELD_OUT)).cast("int").alias("_fold")
    return materialise(docs.select(*keep, F.monotonically_increasing_id().alias("_id"), matches(F.col("_text")).alias("_matches"), fold), "spans")


def written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: counts per kind and digest of base spans, and all spans."""
    found = matched(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")), "doc_id")
    span, base = F.struct("s", "k", "e"), F.col("is_base") == 1
    per = spans_of(found).groupBy(F.col("_id").alias("_of")).agg(
        *(F.count(F.when(base & (F.col("k") == i), 1)).alias(f"n_{kind}") for i, kind in enumerate(KINDS)),
        F.sort_array(F.collect_list(F.when(base, span))).alias("_base"),
        F.sort_array(F.collect_list(span)).alias("_all"),
    )
    out = found.select("doc_id", "_id").join(per, F.col("_id") == F.col("_of"), "left")
    counts = [F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    text = lambda c: F.coalesce(written(F.col(c)), F.lit(""))
    return out.select("doc_id", *counts, F.sha2(text("_base"), 256).alias("base_sha256"), text("_all").alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with every selected span of the text replaced by its kind, overlapping ones as one."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    # texts that can have no match pass by and aren't written
    some = F.col("_text").rlike(NEEDS_ANY)
    found = matched(rows.where(some), "_row", "_text")
    # a span opens a new one where it starts at or after all ends before it
    before = F.coalesce(F.max("e").over(Window.partitionBy("_id").orderBy("s", "k", "e").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans_of(found).withColumn("before", before)
    opened = F.sort_array(F.collect_list(F.when(F.col("s") >= F.col("before"), F.struct("s", "k", "before"))))
    per = spans.groupBy(F.col("_id").alias("_of")).agg(opened.alias("_open"), F.max("e").alias("_end"))
    out = found.drop("_matches", "_fold").join(per, F.col("_id") == F.col("_of"), "left")
    # code points of four bytes each, so that a piece is cut without counting from the start
    out = out.withColumn("_points", F.when(F.col("_end").isNotNull(), F.encode("_text", "UTF-32")))
    cut = lambda a, b: F.decode(F.substring(F.col("_points"), a * 4 + 1, (b - a) * 4), "UTF-32")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    pieces = F.transform("_open", lambda x: F.concat(cut(x["before"], x["s"]), F.element_at(names, x["k"] + 1)))
    text = F.when(F.col("_end").isNotNull(), F.concat(F.array_join(pieces, ""), cut(F.col("_end"), F.length("_text")))).otherwise(F.col("_row").getField("text"))
    out = out.withColumn("_new", text)
    row = lambda c: F.col("_row").getField(c)
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_end").isNotNull(), F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(row("n_chars"))
    return rows.where(~some).select("_row.*").unionByName(out.select(*(new.get(c, row(c)).alias(c) for c in docs.columns)))
