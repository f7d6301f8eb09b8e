"""Readers of raw logs: archives, dumps, workload files, CSV and JSON lines, and cached tables."""

from __future__ import annotations

import csv
import io
import re
import tarfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import error_class, lenient_number, lenient_timestamp
from ..schema import require_columns

# ---------------------------------------------------------------- archives
_MEMBERS = "archive string, member string, size long, content string"
#: What a text member is read for; bytes of all others are skipped in the stream.
WANTED = r"^[^/]+/[^/]+/(?:assessments/.|users/[^/]+/(?:user\.data|logins\.log|executions|codemirror)(?:/|$))"

# The marks of an execution log.
SEPARATOR = "*-*-*-*-*-*-*-*-*-*-*-*-*-*-*-*-*-*-*-*-*-*-*-*"
HEAD = r"==\s+(SUBMITION|TEST)\s+\((\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2})\)"
SECTION = r"-- (CODE|EXECUTION TIME|OUTPUT|ERROR|GRADE|TEST CASE \d+):[ \t]*"
LOGIN = r"(?md)^(\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2})#user/(\w+)"
MINUTE = r"^(\d{4})-(\d{1,2})-(\d{1,2}) (\d{1,2}):(\d{2})"
#: Bytes that a line of an editor log has at least, with all that follows it.
LINE_BYTES = 20


def _opened(uri: str):
    """A file as a stream of bytes, from any file system that the workers know."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return open("/" + uri[5:].lstrip("/"), "rb")
    return fs.FileSystem.from_uri(uri)[0].open_input_stream(fs.FileSystem.from_uri(uri)[1])


def archive_members(spark: SparkSession, path: str, pattern: str = "*.tar.gz", wanted: str = WANTED) -> DataFrame:
    """(archive, member, size, content) of the wanted text members.

    Each archive is one pass of one task over its stream: nothing is unpacked
    to disk and no more than a member is held. Other members come with a null
    content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = re.compile(wanted)
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with _opened(uri) as raw, tarfile.open(fileobj=raw, mode="r|*") as archive:
                    for member in archive:
                        if member.isfile():
                            name = re.sub(r"^\./", "", member.name)
                            text = archive.extractfile(member).read().decode("utf-8", "replace") if keep.match(name) else None
                            yield pa.RecordBatch.from_pydict({"archive": [uri], "member": [name], "size": pa.array([member.size], pa.int64()), "content": pa.array([text], pa.string())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    count = max(1, min(files.count(), 10_000))
    return files.repartition(count, "path").mapInArrow(run, _MEMBERS)


def term_of(archive: Column) -> Column:
    """The term an archive's name states before its version: a year, an underscore and a tag, written with a dash."""
    return F.translate(F.nullif(F.regexp_extract(archive, r"_(\d{4}_[A-Za-z0-9]+)_v[^/]*$", 1), F.lit("")), "_", "-")


def routed(members: DataFrame) -> DataFrame:
    """`members` with term, class_id, kind, user, assessment and exercise by where they lie: <term>/<class>/<folder>/..."""
    parts = F.split("member", "/")
    part = lambda i: F.try_element_at(parts, F.lit(i))
    deep, deeper = F.size(parts) >= 4, F.size(parts) >= 5
    own = deeper & (part(3) == "users")
    kind = (
        F.when(deep & (part(3) == "assessments"), "assessment")
        .when(own & (part(5) == "user.data"), "user")
        .when(own & (part(5) == "logins.log"), "logins")
        .when(own & (part(5) == "executions"), "executions")
        .when(own & (part(5) == "codemirror"), "keystrokes")
        .otherwise("other")
    )
    stem = F.regexp_replace(F.when(part(3) == "assessments", part(4)).otherwise(part(-1)), r"(?<=.)\.[^.]*$", "")
    return members.select(
        "*",
        part(1).alias("term"),
        part(2).alias("class_id"),
        kind.alias("kind"),
        F.when(own, part(4)).alias("user"),
        F.when(part(3) == "assessments", stem).otherwise(F.substring_index(stem, "_", 1)).alias("assessment"),
        F.when(own & F.contains(stem, F.lit("_")), F.regexp_replace(stem, "^[^_]*_", "")).when(own, "").alias("exercise"),
    )


def stamp(text: Column) -> Column:
    """A time whose month, day and hour may lack their leading zero, with or without seconds."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-M-d H:m:s")), F.try_to_timestamp(text, F.lit("yyyy-M-d H:m")), lenient_timestamp(text))


def key_values(text: Column) -> Column:
    """An array of (k, v) of the lines `-- key: value`, with two to four dashes, keys in lower case."""
    line = r"^-{2,4} ([^:]+):\s*(.*)$"
    lines = F.filter(F.transform(F.split(text, r"\r?\n|\r"), F.trim), lambda x: x.rlike(line))
    return F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, line, 1))).alias("k"), F.trim(F.regexp_extract(x, line, 2)).alias("v")))


def assessments(members: DataFrame) -> DataFrame:
    """Assessments of routed members: type, weight, start, end, exercises; of a repeated key the last counts."""
    rows = members.where("kind = 'assessment'").withColumn("kv", key_values(F.col("content")))
    of = lambda k: F.try_element_at(F.filter("kv", lambda p: p["k"] == k), F.lit(-1))["v"]
    exercises = F.transform(F.filter("kv", lambda p: p["k"].startswith("exercise ")), lambda p: p["v"])
    return rows.select(
        "term",
        "class_id",
        "assessment",
        of("type").alias("type"),
        lenient_number(of("weight")).alias("weight"),
        stamp(of("start")).alias("start"),
        stamp(of("end")).alias("end"),
        lenient_number(of("total_exercises")).cast("int").alias("n_exercises"),
        exercises.alias("exercise_ids"),
        of("class number").alias("class_number"),
        of("language").alias("language"),
    )


def executions(members: DataFrame) -> DataFrame:
    """One row per block of an execution log: kind, time, and measures of its sections; their text goes."""
    separated = F.split("content", r"\Q" + SEPARATOR + r"\E")
    blocks = members.where("kind = 'executions'").select("term", "class_id", "user", "assessment", "exercise", F.posexplode(separated).alias("place", "block"))
    blocks = blocks.where(F.col("block").rlike(HEAD))
    parts = F.split(F.regexp_replace("block", rf"(?s)^.*?(?={HEAD})", ""), rf"(?md)(?=^{SECTION}$)")
    section = F.transform(
        F.filter(parts, lambda x: x.rlike(rf"(?d)^{SECTION}(?:\n|$)")),
        lambda x: F.struct(F.regexp_extract(x, rf"^{SECTION}", 1).alias("name"), F.regexp_replace(x, rf"^{SECTION}\n?", "").alias("body")),
    )
    blocks = blocks.withColumn("sections", section)
    last = lambda name: F.try_element_at(F.filter("sections", lambda x: x["name"] == name), F.lit(-1))["body"]
    code = F.coalesce(F.regexp_replace(last("CODE"), r"\n+\z", ""), F.lit(""))
    number = lambda name: F.regexp_replace(F.regexp_replace(last(name), r"^\s+|\s+$", ""), "%+$", "").try_cast("double")
    failed = F.exists("sections", lambda x: x["name"] == "ERROR")
    return blocks.select(
        "term",
        "class_id",
        "user",
        "assessment",
        "exercise",
        "place",
        F.when(F.regexp_extract("block", HEAD, 1) == "TEST", "test").otherwise("submit").alias("kind"),
        stamp(F.regexp_extract("block", HEAD, 2)).alias("ts"),
        number("EXECUTION TIME").alias("exec_time"),
        number("GRADE").alias("grade"),
        F.length(code).alias("code_len"),
        F.when(code == "", 0).otherwise(F.regexp_count(code, F.lit("\n")) + 1).alias("code_lines"),
        F.size(F.filter("sections", lambda x: x["name"].startswith("TEST CASE"))).alias("n_testcases"),
        failed.alias("has_error"),
        F.when(failed, error_class(last("ERROR"))).alias("error_type"),
    )


def logins(members: DataFrame) -> DataFrame:
    """(term, class_id, user, ts, kind) of login logs."""
    found = F.arrays_zip(F.regexp_extract_all("content", F.lit(LOGIN), F.lit(1)).alias("at"), F.regexp_extract_all("content", F.lit(LOGIN), F.lit(2)).alias("what"))
    rows = members.where("kind = 'logins'").select("term", "class_id", "user", F.explode(found).alias("x"))
    return rows.select("term", "class_id", "user", stamp(F.col("x.at")).alias("ts"), F.col("x.what").alias("kind"))


def users(members: DataFrame) -> DataFrame:
    """(term, class_id, user, course_id): the id is all that is read of a user's file, and only before the part on schools."""
    head = F.substring_index("content", "-- HIGH SCHOOL", 1)
    return members.where("kind = 'user'").select("term", "class_id", "user", F.nullif(F.regexp_extract(head, r"course id:\s*(\S+)", 1), F.lit("")).alias("course_id"))


def _lines_seen(content: Column) -> Column:
    """Lines that begin early enough to hold a time."""
    size = F.length(content)
    return F.when(size < LINE_BYTES, 0).otherwise(F.regexp_count(F.left(content, size - LINE_BYTES), F.lit("\n")) + 1)


def keystroke_minutes(members: DataFrame) -> DataFrame:
    """Keystroke events per minute; months, days and hours may lack their leading zero, other lines count for nothing."""
    seen = F.slice(F.split("content", "\n", -1), F.lit(1), _lines_seen(F.col("content")))
    lines = members.where("kind = 'keystrokes'").select("term", "class_id", "user", "assessment", "exercise", F.explode(seen).alias("line"))
    part = lambda i: F.regexp_extract("line", MINUTE, i).cast("int")
    real = F.col("line").rlike(MINUTE) & part(2).between(1, 12) & part(3).between(1, 31) & (part(4) <= 23) & (part(5) <= 59)
    minute = F.try_to_timestamp(F.format_string("%04d-%02d-%02d %02d:%02d", *(part(i) for i in range(1, 6))), F.lit("yyyy-MM-dd HH:mm"))
    return lines.where(real).groupBy("term", "class_id", "user", "assessment", "exercise", minute.alias("minute")).agg(F.count("*").cast("int").alias("n_events"))


def coverage(members: DataFrame) -> DataFrame:
    """One row: files by kind, bytes of those that are read, and lines of editor logs seen and used."""
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("assessment", "user", "logins", "executions", "keystrokes", "other")]
    size = F.sum(F.when(F.col("kind") != "other", F.col("size"))).alias("bytes_read")
    rows = members.agg(*kinds, size, F.sum(F.when(F.col("kind") == "keystrokes", _lines_seen(F.col("content")))).alias("lines_seen"))
    used = keystroke_minutes(members).agg(F.coalesce(F.sum("n_events"), F.lit(0)).alias("lines_used"))
    return rows.crossJoin(F.broadcast(used))  # one row each


def parse_statistics(events: DataFrame) -> DataFrame:
    """One row: fill shares and the span of time."""
    filled = [F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_filled") for c in events.columns if c != "ts"]
    return events.agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"), *filled)


# ---------------------------------------------------------------- dumps
def dump_rows(text: str) -> Iterator[list[str | None]]:
    """Rows of the VALUES lists of a dump: quoted fields unescaped, NULL as None."""
    escapes = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "Z": "\x1a"}
    i, n = 0, len(text)
    while (i := text.find("VALUES", i)) >= 0:
        i += 6
        while i < n and text[i] != ";":
            if text[i] != "(":
                i += 1
                continue
            row: list[str | None] = []
            field, quoted, i = [], False, i + 1
            while True:
                c = text[i]
                if c == "'":
                    quoted, i = True, i + 1
                    while text[i] != "'" or text[i + 1 : i + 2] == "'":
                        if text[i] == "\\":
                            field.append(escapes.get(text[i + 1], text[i + 1]))
                            i += 2
                        else:
                            i += 2 if text[i] == "'" else 1
                            field.append(text[i - 1])
                    i += 1
                elif c in ",)":
                    value = "".join(field) if quoted else "".join(field).strip()
                    row.append(None if not quoted and value.upper() == "NULL" else value)
                    field, quoted, i = [], False, i + 1
                    if c == ")":
                        break
                else:
                    field.append(c)
                    i += 1
            yield row


def dump_table(spark: SparkSession, path: str, table: str, columns: Sequence[str]) -> DataFrame:
    """A table of a dump as strings, statement by statement; rows with another count of fields fail."""
    statements = spark.read.option("lineSep", ";\n").text(path).where(F.col("value").rlike(rf"^(?:\s|--[^\n]*\n)*INSERT INTO `?{table}`?\b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for text in batch.column(0).to_pylist() for r in dump_rows(text + ";")]
            for r in rows:
                if len(r) != len(columns):
                    raise ValueError(f"{table}: {len(r)} fields where {len(columns)} are expected")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(columns))], names=list(columns))

    return statements.mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


def insert_count(spark: SparkSession, path: str) -> DataFrame:
    """(table, statements) of a dump, as a check of what was parsed."""
    heads = spark.read.text(path).select(F.regexp_extract("value", r"^\s*INSERT INTO `?(\w+)`?", 1).alias("table"))
    return heads.where("table <> ''").groupBy("table").agg(F.count("*").alias("statements"))


# ---------------------------------------------------------------- flat files
#: Columns of the standard workload format.
SWF = ("job", "submit", "wait", "run", "nproc", "cpu_used", "mem_used", "nproc_req", "time_req", "mem_req", "status", "uid", "gid", "exe", "queue", "part", "prev_job", "think")


def workload(spark: SparkSession, path: str) -> DataFrame:
    """A file of the standard workload format: comments go, all columns are numbers."""
    fields = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.ltrim("value").startswith(";") & (F.trim("value") != ""))
    return lines.select(*(F.try_element_at(fields, F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate(SWF)))


def invocations(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of (app, func, end_timestamp, duration) as jobs: arrival is the end less the duration."""
    rows = spark.read.schema("app string, func string, end_timestamp double, duration double").csv(path, header=True)
    return rows.select(F.xxhash64("app").alias("app_id"), F.xxhash64("app", "func").alias("func_id"), (F.col("end_timestamp") - F.col("duration")).alias("arrival"), "duration")


def clicks(spark: SparkSession, path: str, modules: dict[str, str] | None = None) -> DataFrame:
    """Daily clicks per module of a clickstream CSV, modules mapped to groups."""
    rows = spark.read.schema("code_module string, code_presentation string, id_student long, id_site long, date int, sum_click long").csv(path, header=True)
    group = F.col("code_module")
    if modules:
        group = F.coalesce(F.create_map(*(F.lit(x) for pair in modules.items() for x in pair))[group], group)
    return rows.groupBy(group.alias("module"), "date").agg(F.sum("sum_click").alias("clicks"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def runs_of_tasks(tasks: DataFrame) -> DataFrame:
    """Nested tasks (task_id, runs array of structs) to one row per run."""
    require_columns(tasks, ("task_id", "runs"))
    return tasks.select("task_id", F.posexplode("runs").alias("run_id", "r")).select("task_id", "run_id", "r.*")


def cached(spark: SparkSession, paths: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Several parquet caches as one table; a missing one is an error that names it."""
    out = None
    for path in paths:
        try:
            part = spark.read.parquet(path)
        except Exception as error:
            raise FileNotFoundError(f"no cache at {path}") from error
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError("no cache named")
    return out.orderBy(*order)


def cell(spark: SparkSession, folder: str, **values) -> DataFrame:
    """One cell of stored traces (see sinks.write_cells): only its folder is read."""
    out = spark.read.parquet(folder)
    for name, value in values.items():
        out = out.where(F.col(name) == value)
    return out


def rows_of_csv(text: str) -> list[dict[str, str]]:
    """A small CSV as dictionaries, for reports that are read back."""
    return list(csv.DictReader(io.StringIO(text)))
