"""Text parsing with column expressions: lenient numbers, line features, logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_number(text: Column) -> Column:
    """A number from text with blanks and percent signs; null where there is none."""
    return F.regexp_replace(F.trim(text), "%", "").try_cast("double")


def lenient_timestamp(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """By the given pattern, else by any that a cast knows, else null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit(pattern)), text.try_cast("timestamp"))


def line_features(text: Column) -> dict[str, Column]:
    """Counts of characters, lines, filled lines, the longest line, numbers, marks and keywords."""
    lines = F.split(text, "\n")
    return {
        "chars": F.length(text).cast("long"),
        "lines": F.size(lines).cast("long"),
        "filled_lines": F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long"),
        "longest_line": F.array_max(F.transform(lines, F.length)).cast("long"),
        "numbers": F.regexp_count(text, F.lit("[0-9]+")).cast("long"),
        "comments": F.regexp_count(text, F.lit("[#]")).cast("long"),
        "keywords": F.regexp_count(text, F.lit(" (?:the|and|for|if|while|in) ")).cast("long"),
    }


def _indent(space: Column) -> Column:
    """Columns that leading white space takes, tabs going to the next multiple of four."""
    return F.aggregate(F.split(space, ""), F.lit(0), lambda acc, c: F.when(c == "\t", acc + 4 - acc % 4).when(c == "", acc).otherwise(acc + 1))


def loop_depth(text: Column) -> Column:
    """Deepest nesting of lines that begin a loop, told by indentation."""
    line = r"(?U)^(\s*)(?:for|while)\b"
    loops = F.filter(F.split(text, "\n"), lambda x: x.rlike(line))
    stack = F.aggregate(
        F.transform(loops, lambda x: _indent(F.regexp_extract(x, line, 1))),
        F.struct(F.array().cast("array<int>").alias("s"), F.lit(0).alias("m")),
        lambda acc, d: F.struct(
            F.concat(F.filter(acc["s"], lambda x: x < d), F.array(d)).alias("s"),
            F.greatest(acc["m"], F.size(F.filter(acc["s"], lambda x: x < d)) + 1).alias("m"),
        ),
        lambda acc: acc["m"],
    )
    return F.coalesce(stack, F.lit(0))


def recursion(text: Column) -> Column:
    """Whether a function is called more often than it is defined, on an indented line at least once."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?mU)^\s*def\s+([A-Za-z_]\w*)"), F.lit(1)))
    times = lambda before, n, after: F.regexp_count(text, F.concat(F.lit(before), n, F.lit(after)))
    return F.exists(names, lambda n: (times("", n, r"\(") > times(r"(?mU)^\s*def\s+", n, r"\s*\(")) & (times(r"(?mU)^\s+.*\b", n, r"\s*\(") > 0))


# Words that are counted, and modules that have a mark of their own.
COUNTED = ("while", "for", "input", "def", "if", "print", "range", "try", "class", "return", "lambda", "len", "append")
MODULES = ("math", "random", "time", "sys", "os", "numpy", "itertools", "string")
# Words whose presence is told.
NOTED = ("sleep", "eval", "exec", "open")
#: Largest values of indentation, nesting, and digits in a row.
MOST_INDENT, MOST_DEPTH, MOST_DIGITS = 60, 12, 18


def code_parts(text: Column) -> dict[str, Column]:
    """A source text cut up into lines, filled lines, the words and the modules that code_features asks for."""
    lines = F.split(text, "\n")
    imported = r"(?mU)^\s*(?:from|import)\s+([A-Za-z_][\w.]*)"
    return {
        "lines": lines,
        "filled": F.filter(lines, lambda x: x.rlike(r"(?U)\S")),
        "words": F.filter(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: w.isin(*COUNTED, *NOTED)),
        "modules": F.transform(F.regexp_extract_all(text, F.lit(imported), F.lit(1)), lambda x: F.substring_index(x, ".", 1)),
    }


def code_features(text: Column, parts: dict[str, Column] | None = None) -> dict[str, Column]:
    """37 measures of a source text: sizes, words, imports, nesting, calls and numbers.

    `parts` are code_parts(text). Given as columns of a projection before, they
    are found once; else each measure cuts the text up anew.
    """
    lines, filled, words, modules = (parts or code_parts(text)).values()
    number = lambda x: F.array_max(F.transform(F.regexp_extract_all(x, F.lit(r"(?U)\d+"), F.lit(0)), F.length))
    ranges = F.regexp_extract_all(text, F.lit(r"range\(([^)]{0,80})\)"), F.lit(1))
    has = lambda *some: F.exists(words, lambda w: w.isin(*some)).cast("int")
    out = {
        "chars": F.length(text),
        "lines": F.size(lines),
        "nonblank_lines": F.size(filled),
        "max_line_len": F.array_max(F.transform(lines, F.length)),
        "n_comment_lines": F.regexp_count(text, F.lit(r"(?mU)^\s*#")),
    }
    times = lambda word: F.size(F.filter(words, lambda x: x == word))
    out |= {f"n_{w}": times(w) for w in COUNTED}
    out["n_import"] = F.size(modules)
    out |= {f"imp_{m}": F.array_contains(modules, m).cast("int") for m in MODULES}
    out |= {
        "imp_other": F.exists(modules, lambda x: ~x.isin(*MODULES)).cast("int"),
        "max_indent": F.least(F.coalesce(F.array_max(F.transform(filled, lambda x: _indent(F.regexp_extract(x, "^([ \t]*)", 1)))), F.lit(0)), F.lit(MOST_INDENT)),
        "nest_loop_depth": F.least(loop_depth(text), F.lit(MOST_DEPTH)),
        "has_while_true": text.rlike(r"(?U)while\s*\(?\s*(?:True|1)\s*\)?\s*:").cast("int"),
        "has_recursion": recursion(text).cast("int"),
        "max_num_digits": F.least(F.coalesce(number(text), F.lit(0)), F.lit(MOST_DIGITS)),
        "max_range_digits": F.least(F.coalesce(F.array_max(F.transform(ranges, number)), F.lit(0)), F.lit(MOST_DIGITS)),
        "has_sleep": has("sleep"),
        "has_evalexec": has("eval", "exec"),
        "has_open": has("open"),
    }
    return out


def error_class(output: Column) -> Column:
    """The error of an execution's last filled line: a class name before a colon, TimeLimit, or Other; Empty without such a line."""
    filled = F.filter(F.split(output, "\n"), lambda x: F.trim(x) != "")
    last = F.regexp_replace(F.try_element_at(filled, F.lit(-1)), r"^\s+|\s+$", "")
    name = F.regexp_extract(last, r"^([A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception|Interrupt|Warning|Exit))\s*:", 1)
    return F.when(output.isNull(), None).when(last.isNull(), "Empty").when(name != "", name).when(F.lower(last).rlike("^killed|time limit"), "TimeLimit").otherwise("Other")
