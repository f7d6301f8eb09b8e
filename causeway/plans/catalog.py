"""Registered queries of the engine over the driver's tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clock
from ..operators import history, metrics, replay, study, temporal
from ..session import ship
from ..sources.scratch import dropped, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Delay of results in the feature queries, and servers of the replay queries.
DELTA = 60_000_000
SERVERS = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock.jobs(table(spark, sf_dir, "events"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock.arrival_and_availability(jobs(spark, sf_dir), delta=DELTA)


def heavy_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with a thousandfold work, so that each user's own queue forms."""
    rows = jobs(spark, sf_dir).withColumn("arrival_us", F.col("header_us")).withColumn("work_us", F.col("cost_us") * 1000)
    # a score that follows the work loosely, by a residue of the cost
    return rows.withColumn("score", F.col("cost_us") / F.lit(1e6) + (F.col("cost_us") % 97).cast("double"))


JOBS = """j AS (
  SELECT event_id AS job_id, user_id AS user_key, regexp_extract(props, '[0-9]+')::INTEGER AS item_key, event_type AS kind,
         epoch_us(ts) AS header_us, round_even(value * 1e6, 0)::BIGINT AS cost_us,
         (event_type = 'error')::INTEGER AS is_error, event_type = 'view' AS is_result_only,
         floor((epoch_us(ts) - 345600000000) / 604800000000)::BIGINT AS week
  FROM events),
a AS (
  SELECT *, week::VARCHAR || '|' || (user_key % 8)::VARCHAR AS class_term, week::VARCHAR || '|' || (item_key % 10)::VARCHAR AS assessment,
         (week + 1) * 604800000000 + 345600000000 AS deadline_us,
         CASE WHEN is_result_only THEN 0 ELSE least(cost_us, 60000000) END AS work_us, header_us AS arrival_us
  FROM j),
t AS (
  SELECT *, arrival_us + work_us + 60000000 + CASE WHEN is_result_only THEN 60000000 ELSE 0 END AS available_us FROM a),
h AS (SELECT *, cost_us * 1000 AS big_us FROM a)"""
#: The merged stream of results (0), reads (1) and registrations (2).
STREAM = JOBS + """,
s AS (
  SELECT available_us AS at_us, 0 AS k, * FROM t UNION ALL
  SELECT arrival_us, 1, * FROM t UNION ALL
  SELECT arrival_us, 2, * FROM t)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


# ---------------------------------------------------------------- clock and scalar functions
@query("clock_readings", f"""WITH {JOBS} SELECT job_id, header_us - work_us AS arrival_us, header_us - work_us + work_us + 60000000 + CASE WHEN is_result_only THEN 60000000 ELSE 0 END AS available_us, work_us FROM a""")
def clock_readings(spark, sf_dir):
    return clock.arrival_and_availability(jobs(spark, sf_dir), reading="result", delta=DELTA).select("job_id", "arrival_us", "available_us", "work_us")


def _bits(*keys: str) -> str:
    """SQL of clock.keyed_bits."""
    return "('0x' || substr(md5(" + " || '|' || ".join(f"({k})::VARCHAR" for k in keys) + "), 1, 13))::BIGINT"


@query("jitter_key", f"SELECT event_id, {_bits('user_id', 'event_id')} * 2.0::DOUBLE ^ -52 AS jitter FROM events")
def jitter_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", clock.jitter("user_id", "event_id").alias("jitter"))


@query("capped_work", f"WITH {JOBS} SELECT job_id, least(cost_us, 60000000) AS work_us FROM j")
def capped_work(spark, sf_dir):
    return jobs(spark, sf_dir).select("job_id", clock.executed(F.col("cost_us")).alias("work_us"))


@query("calendar_context", f"""WITH {JOBS} SELECT job_id, ((arrival_us % 86400000000) // 3600000000)::INTEGER AS hour,
  ((arrival_us // 86400000000 + 3) % 7)::INTEGER AS weekday, floor((deadline_us - arrival_us) / 1000000)::BIGINT AS to_deadline_s FROM a""")
def calendar_context(spark, sf_dir):
    return timed(spark, sf_dir).select("job_id", *(c.alias(n) for n, c in clock.calendar(F.col("arrival_us"), F.col("deadline_us")).items()))


@query("heavy_flags", f"""WITH {JOBS} SELECT job_id, work_us > (SELECT quantile_cont(work_us, 0.95) FROM a WHERE NOT is_result_only) AS heavy,
  deadline_us - arrival_us BETWEEN 0 AND 86400000000 AS in_window FROM a""")
def heavy_flags(spark, sf_dir):
    rows = timed(spark, sf_dir)
    flagged = rows.crossJoin(F.broadcast(history.heavy_threshold(rows)))  # one row
    return flagged.select("job_id", (F.col("work_us") > F.col("heavy_us")).alias("heavy"), clock.in_deadline_window(F.col("arrival_us"), F.col("deadline_us")).alias("in_window"))


@query("priority_map", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 END::INTEGER AS priority FROM orders")
def priority_map(spark, sf_dir):
    known = F.create_map(*(F.lit(x) for pair in (("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3), ("4-NOT SPECIFIED", 4), ("5-LOW", 5)) for x in pair))
    return table(spark, sf_dir, "orders").select("o_orderkey", known[F.col("o_orderpriority")].alias("priority"))


@query("binned_quantity", "SELECT l_returnflag, floor(l_quantity / 10)::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def binned_quantity(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.floor(F.col("l_quantity") / 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("digits_to_n", "SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[0-9]+$', ''), '[0-9]+', 'N', 'g') AS label FROM part")
def digits_to_n(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.regexp_replace("p_name", "[0-9]+$", ""), "[0-9]+", "N").alias("label"))


@query("lenient_numbers", "SELECT event_id, try_cast(replace(trim(regexp_extract(props, ':(.*)[}]', 1)), '%', '') AS DOUBLE) AS number FROM events")
def lenient_numbers(spark, sf_dir):
    from ..functions.text import lenient_number

    return table(spark, sf_dir, "events").select("event_id", lenient_number(F.regexp_extract("props", ":(.*)[}]", 1)).alias("number"))


@query("text_features", r"""SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS lines,
  len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS filled_lines,
  list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest_line,
  len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(regexp_extract_all(text, '[#]')) AS comments,
  len(regexp_extract_all(text, ' (?:the|and|for|if|while|in) ')) AS keywords FROM documents""")
def text_features(spark, sf_dir):
    from ..functions.text import line_features

    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in line_features(F.col("text")).items()))


@query("kv_parse", "SELECT event_id, regexp_extract(props, '\"([a-z]+)\"', 1) AS key, regexp_extract(props, ': *([0-9]+)', 1) AS text_value FROM events")
def kv_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", '"([a-z]+)"', 1).alias("key"), F.regexp_extract("props", ": *([0-9]+)", 1).alias("text_value"))


@query("json_field", "SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("html_sections", r"""SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS tags, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def html_sections(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_count("html", F.lit("<[a-zA-Z][^>]*>")).cast("long").alias("tags"),
        F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
    )


@query("exploded_lines", "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 20 GROUP BY line HAVING count(*) > 3")
def exploded_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 20)
    return lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 3")


# ---------------------------------------------------------------- causal features
@query("merged_stream", f"WITH {STREAM} SELECT at_us, k AS kind, job_id, row_number() OVER (PARTITION BY item_key ORDER BY at_us, k, job_id) AS place FROM s")
def merged_stream(spark, sf_dir):
    stream = history.merged_stream(timed(spark, sf_dir), ["item_key"])
    return stream.select("at_us", "kind", "job_id", F.row_number().over(Window.partitionBy("item_key").orderBy("at_us", "kind", "job_id")).cast("long").alias("place"))


def _history_sql(key: str, prefix: str) -> str:
    over = f"OVER (PARTITION BY {key} ORDER BY at_us, k, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""WITH {STREAM}, w AS (SELECT job_id, k, count(*) FILTER (k = 0) {over} AS n, coalesce(sum(work_us) FILTER (k = 0) {over}, 0)::DOUBLE AS w, coalesce(sum(is_error) FILTER (k = 0) {over}, 0)::DOUBLE AS e FROM s)
SELECT job_id, n AS {prefix}_n, CASE WHEN n > 0 THEN w / n ELSE -1 END AS {prefix}_mean_us, CASE WHEN n > 0 THEN e / n ELSE -1 END AS {prefix}_err FROM w WHERE k = 1"""


@query("causal_history", _history_sql("item_key", "item"))
def causal_history(spark, sf_dir):
    return history.keyed_history(history.merged_stream(timed(spark, sf_dir), ["item_key", "work_us", "is_error"]), ["item_key"], "item")


@query("user_history", _history_sql("user_key", "user"))
def user_history(spark, sf_dir):
    return history.keyed_history(history.merged_stream(timed(spark, sf_dir), ["user_key", "work_us", "is_error"]), ["user_key"], "user")


@query("pair_history", _history_sql("user_key, item_key", "pair"))
def pair_history(spark, sf_dir):
    return history.keyed_history(history.merged_stream(timed(spark, sf_dir), ["user_key", "item_key", "work_us", "is_error"]), ["user_key", "item_key"], "pair")


@query("scoped_history", _history_sql("class_term, item_key", "scoped"))
def scoped_history(spark, sf_dir):
    return history.keyed_history(history.merged_stream(timed(spark, sf_dir), ["class_term", "item_key", "work_us", "is_error"]), ["class_term", "item_key"], "scoped")


@query("permuted_control", f"""WITH {JOBS}, s AS (SELECT available_us AS at_us, 0 AS k, *, item_key AS key FROM t UNION ALL SELECT arrival_us, 1, *, (item_key * 7 + 3) % 100 FROM t),
w AS (SELECT job_id, k, count(*) FILTER (k = 0) OVER (PARTITION BY key ORDER BY at_us, k, job_id) AS n FROM s) SELECT job_id, n AS permuted_n FROM w WHERE k = 1""")
def permuted_control(spark, sf_dir):
    rows = timed(spark, sf_dir)
    stream = history.merged_stream(rows, ["item_key", "work_us", "is_error"]).where("kind <> 2")
    mapped = stream.withColumn("item_key", F.when(F.col("kind") == 1, (F.col("item_key") * 7 + 3) % 100).otherwise(F.col("item_key")))
    return history.keyed_history(mapped, ["item_key"], "permuted").select("job_id", "permuted_n")


@query("rolling_quantile", f"""WITH {JOBS}, r AS (SELECT item_key, available_us, job_id, list_sort(list(work_us) OVER (PARTITION BY item_key ORDER BY available_us, job_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)) AS w FROM t),
u AS (SELECT item_key, available_us AS at_us, 0 AS k, job_id, w FROM r UNION ALL SELECT item_key, arrival_us, 1, job_id, NULL FROM t),
l AS (SELECT job_id, k, last_value(w IGNORE NULLS) OVER (PARTITION BY item_key ORDER BY at_us, k, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM u)
SELECT job_id, coalesce(len(w), 0)::INTEGER AS n, w[least(len(w), floor(0.5 * (len(w) - 1) + 0.5)::BIGINT + 1)] AS p50_us, w[least(len(w), floor(0.9 * (len(w) - 1) + 0.5)::BIGINT + 1)] AS p90_us, list_max(w) AS max_us FROM l WHERE k = 1""")
def rolling_quantile(spark, sf_dir):
    return history.recent_results(timed(spark, sf_dir), ["item_key"])


_TERCILES = """x AS (SELECT *, count(*) FILTER (k = 0) OVER w AS un, sum(work_us) FILTER (k = 0) OVER w AS uw FROM s
  WINDOW w AS (PARTITION BY user_key ORDER BY at_us, k, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
y AS (SELECT *, (CASE WHEN un = 0 THEN 1 WHEN uw / un <= 25000000 THEN 0 WHEN uw / un <= 30000000 THEN 1 ELSE 2 END)::INTEGER AS tercile FROM x)"""


@query("user_tercile", f"WITH {STREAM}, {_TERCILES} SELECT job_id, tercile FROM y WHERE k = 1")
def user_tercile(spark, sf_dir):
    stream = history.merged_stream(timed(spark, sf_dir), ["user_key", "work_us"])
    return history.with_terciles(stream, "user_key", 25e6, 30e6).where("kind = 1").select("job_id", "tercile")


@query("relational_block", f"WITH {STREAM}, {_TERCILES}, " + """z AS (SELECT job_id, k, count(*) FILTER (k = 0) OVER w AS n, sum(work_us) FILTER (k = 0) OVER w AS v FROM y
  WINDOW w AS (PARTITION BY item_key, tercile ORDER BY at_us, k, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT job_id, n AS alike_n, CASE WHEN n > 0 THEN v::DOUBLE / n ELSE -1 END AS alike_mean_us FROM z WHERE k = 1""")
def relational_block(spark, sf_dir):
    stream = history.merged_stream(timed(spark, sf_dir), ["user_key", "item_key", "work_us", "is_error"])
    rows = history.keyed_history(history.with_terciles(stream, "user_key", 25e6, 30e6), ["item_key", "tercile"], "alike")
    return rows.select("job_id", "alike_n", "alike_mean_us")


def _block_sql() -> str:
    frame = "ORDER BY at_us, k, twin, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    own = "FILTER (k = 0 AND sub)"
    sums = lambda p, *what: ", ".join([f"count(*) {own} OVER {p} AS {p}_n", *(f"coalesce(sum({'lg::HUGEINT * lg' if c == 'square' else c}) {own} OVER {p}, 0) AS {p}_{c}" for c in what)])
    mean = lambda p, c, unit="": f"CASE WHEN {p}_n > 0 THEN {p}_{c}::DOUBLE / {p}_n END{unit}"
    micro = " / 1e6::DOUBLE"
    sd = lambda p: f"CASE WHEN {p}_n > 0 THEN sqrt(greatest({p}_square::DOUBLE / {p}_n - ({p}_lg::DOUBLE / {p}_n) * ({p}_lg::DOUBLE / {p}_n), 0)) / 1e6::DOUBLE END"
    rest = lambda c, unit="": f"CASE WHEN a_n > b_n THEN (a_{c} - b_{c})::DOUBLE / (a_n - b_n){unit} END"
    related = {
        "alike_log": "(" + mean("t", "lg") + ")" + micro, "alike_heavy": mean("t", "heavy"),
        "other_log": rest("lg", micro), "other_heavy": rest("heavy"), "class_log": "(" + mean("c", "lg") + ")" + micro,
    }
    recent = lambda key, p: f"""{p}r AS (SELECT {key} AS key, available_us, job_id, list_sort(list(lg) OVER (PARTITION BY {key} ORDER BY available_us, job_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)) AS w FROM v WHERE sub),
{p}u AS (SELECT key, available_us AS at_us, 0 AS k, job_id, w FROM {p}r UNION ALL SELECT {key}, arrival_us, 1, job_id, NULL FROM v WHERE sub),
{p}l AS (SELECT job_id, k, last_value(w IGNORE NULLS) OVER (PARTITION BY key ORDER BY at_us, k, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM {p}u)"""  # noqa: E731
    at = lambda p: f"w[least(len(w), floor({p} * (len(w) - 1) + 0.5)::BIGINT + 1)] / 1e6::DOUBLE"
    since = lambda last: f"ln(1 + (at_us - {last}) / 1e6::DOUBLE)"
    return f"""WITH {JOBS},
v AS (SELECT t.*, NOT is_result_only AS sub, (work_us > (SELECT quantile_cont(work_us, 0.95) FROM t WHERE NOT is_result_only))::INTEGER AS heavy, cost_us % 20 + 1 AS tests,
  floor(ln(1 + work_us / 1e6::DOUBLE) * 1e6::DOUBLE + 0.5)::BIGINT AS lg FROM t),
s AS (SELECT available_us AS at_us, 0 AS k, 0 AS twin, * FROM v UNION ALL SELECT arrival_us, 1, 0, * FROM v WHERE sub
  UNION ALL SELECT arrival_us, 1, 1, * REPLACE ((item_key * 7 + 3) % 100 AS item_key, week::VARCHAR || '|' || ((item_key * 3 + 1) % 10)::VARCHAR AS assessment) FROM v WHERE sub UNION ALL SELECT arrival_us, 2, 0, * FROM v),
su AS (SELECT *, {sums('u', 'lg', 'square', 'is_error', 'heavy')}, count(*) FILTER (k = 2 AND sub) OVER u AS u_arrived, max(at_us) FILTER (k = 2) OVER u AS u_last_us,
  arg_max(is_error, (arrival_us, job_id)) FILTER (k = 0) OVER u AS prev_err FROM s WINDOW u AS (PARTITION BY user_key {frame})),
sv AS (SELECT *, (CASE WHEN u_n = 0 THEN 1 WHEN u_lg::DOUBLE / u_n / 1e6::DOUBLE < 3.2 THEN 0 WHEN u_lg::DOUBLE / u_n / 1e6::DOUBLE < 3.5 THEN 1 ELSE 2 END) AS tercile FROM su),
sw AS (SELECT *, {sums('e', 'lg', 'square', 'is_error', 'heavy', 'tests')}, count(*) FILTER (k = 2 AND sub) OVER e AS e_arrived, {sums('t', 'lg', 'heavy')}, {sums('c', 'lg')}, {sums('b', 'lg', 'heavy')}, {sums('a', 'lg', 'heavy')},
  count(*) FILTER (k = 2 AND sub) OVER p AS p_arrived, max(at_us) FILTER (k = 2 AND sub) OVER p AS p_last_us, arg_max(lg, (arrival_us, job_id)) {own} OVER p AS p_lg, arg_max(is_error, (arrival_us, job_id)) {own} OVER p AS p_err
  FROM sv WINDOW e AS (PARTITION BY item_key {frame}), t AS (PARTITION BY item_key, tercile {frame}), c AS (PARTITION BY item_key, class_term {frame}), b AS (PARTITION BY item_key, assessment {frame}),
  a AS (PARTITION BY assessment {frame}), p AS (PARTITION BY item_key, user_key {frame})),
x AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in related.items())} FROM sw WHERE k = 1),
{recent('item_key', 'i')}, {recent('user_key', 'u')}
SELECT x.job_id, e_arrived AS ex_n, ({mean('e', 'lg')}){micro} AS ex_mean, {sd('e')} AS ex_sd, {mean('e', 'is_error')} AS ex_err, {mean('e', 'heavy')} AS ex_heavy, {mean('e', 'tests')} AS ex_tests,
  u_arrived AS u_n, ({mean('u', 'lg')}){micro} AS u_mean, {sd('u')} AS u_sd, {mean('u', 'is_error')} AS u_err, {mean('u', 'heavy')} AS u_heavy,
  p_arrived AS pair_n, p_lg / 1e6::DOUBLE AS pair_last_log, p_err AS pair_last_err, round({since('p_last_us')}, 9) AS pair_since, prev_err, round({since('u_last_us')}, 9) AS prev_since,
  {", ".join(f"x.{n}" for n in related)}, {", ".join(f"y.{n} AS permuted_{n}" for n in related)},
  i.p50 AS ex_p50, i.p90 AS ex_p90, i.top AS ex_max, z.p50 AS u_p50, z.p90 AS u_p90
FROM x JOIN (SELECT job_id, {", ".join(related)} FROM x WHERE twin = 1) y ON x.job_id = y.job_id AND x.twin = 0
JOIN (SELECT job_id, {at('0.5')} AS p50, {at('0.9')} AS p90, list_max(w) / 1e6::DOUBLE AS top FROM il WHERE k = 1) i ON i.job_id = x.job_id
JOIN (SELECT job_id, {at('0.5')} AS p50, {at('0.9')} AS p90 FROM ul WHERE k = 1) z ON z.job_id = x.job_id"""


def submissions(spark, sf_dir):
    """Jobs with the columns that the feature block reads."""
    rows = timed(spark, sf_dir)
    flagged = rows.crossJoin(F.broadcast(history.heavy_threshold(rows)))  # one row
    return flagged.withColumns({"is_submission": ~F.col("is_result_only"), "heavy": (F.col("work_us") > F.col("heavy_us")).cast("int"), "tests": F.col("cost_us") % 20 + 1})


@query("feature_block", _block_sql())
def feature_block(spark, sf_dir):
    """All columns of history and relations of each submission, with the permuted control."""
    from ..operators import blocks

    other_assessment = clock.composite(F.col("week"), (F.col("item_key") * 3 + 1) % 10)
    rows = blocks.feature_block(submissions(spark, sf_dir), 3.2, 3.5, (F.col("item_key") * 7 + 3) % 100, other_assessment)
    return rows.withColumns({c: F.round(c, 9) for c in ("pair_since", "prev_since")})


def _platform_sql(lag: int) -> str:
    order = "ORDER BY at_, k, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    got = lambda p, x: f"{x} FILTER (k = 3) OVER {p}"
    sums = lambda p, *what: ", ".join([f"{got(p, 'count(*)')} AS {p}_n", *(f"{got(p, f'sum({c})')} AS {p}_{c}" for c in what)])
    mean = lambda p, c: f"CASE WHEN {p}_n > 0 THEN {p}_{c}::DOUBLE / {p}_n END"
    sd = lambda p: f"CASE WHEN {p}_n > 0 THEN sqrt(greatest(({mean(p, 'sq')}) - ({mean(p, 'lg')}) * ({mean(p, 'lg')}), 0)) END"
    last = lambda p, c: f"last_value(CASE WHEN k = 3 THEN {c} END IGNORE NULLS) OVER {p}"
    sides = ", ".join(
        f"{p}_n, {mean(p, 'lg')} AS {p}_mean, {sd(p)} AS {p}_sd, {p}_max, {p}_last, {mean(p, 'heavy')} AS {p}_heavy_rate, {mean(p, 'tle')} AS {p}_limit_rate, {mean(p, 'ac')} AS {p}_accept_rate, {mean(p, 'len')} AS {p}_length_mean"
        for p in ("p", "u")
    )
    return f"""WITH {JOBS}, v AS (SELECT job_id AS id, row_number() OVER (ORDER BY job_id) - 1 AS rk, item_key AS problem, user_key AS usr, CASE WHEN kind <> 'signup' THEN week END AS contest, user_key % 3 AS lang,
  CASE WHEN item_key % 4 <> 0 THEN [item_key % 7, 10 + item_key % 3] ELSE [] END AS tags, floor(ln(1 + work_us / 1e6::DOUBLE) * 1e6::DOUBLE + 0.5)::BIGINT AS lg, cost_us % 1000 AS mem, job_id % 500 AS len,
  (work_us > 55000000)::INTEGER AS heavy, (work_us = 60000000)::INTEGER AS tle, 1 - is_error AS ac, NOT is_result_only AS ok FROM t),
s AS (SELECT rk + {lag} AS at_, 3 AS k, *, lg::HUGEINT * lg AS sq FROM v WHERE ok UNION ALL SELECT rk, 1, *, 0 FROM v),
a1 AS (SELECT *, {sums('p', 'lg', 'sq', 'heavy', 'tle', 'ac', 'len', 'mem')}, {got('p', 'max(lg)')} AS p_max, {last('p', 'lg')} AS p_last, {sums('up', 'lg')}, {got('up', 'max(lg)')} AS up_max, {last('up', 'lg')} AS up_last, {last('up', 'ac')} AS up_ac, {last('up', 'tle')} AS up_tle,
  {sums('cp', 'lg')}, {sums('pl', 'lg')} FROM s WINDOW p AS (PARTITION BY problem {order}), up AS (PARTITION BY problem, usr {order}), cp AS (PARTITION BY problem, contest {order}), pl AS (PARTITION BY problem, lang {order})),
a2 AS (SELECT *, (k = 3 AND up_n = 1)::INTEGER AS fresh FROM a1),
a3 AS (SELECT *, {sums('u', 'lg', 'sq', 'heavy', 'tle', 'ac', 'len', 'fresh')}, {got('u', 'max(lg)')} AS u_max, {last('u', 'lg')} AS u_last, {sums('c', 'lg', 'heavy')}, {sums('cu', 'lg')}
  FROM a2 WINDOW u AS (PARTITION BY usr {order}), c AS (PARTITION BY contest {order}), cu AS (PARTITION BY contest, usr {order})),
g AS (SELECT at_, k, id, usr, lg, heavy, unnest(tags) AS tag FROM s), g2 AS (SELECT *, {sums('t', 'lg', 'heavy')}, {sums('ut', 'lg')} FROM g WINDOW t AS (PARTITION BY tag {order}), ut AS (PARTITION BY tag, usr {order})),
hg AS (SELECT id, sum(t_n)::BIGINT AS t_n, coalesce(sum(t_lg), 0) AS t_lg, coalesce(sum(t_heavy), 0) AS t_heavy, sum(ut_n)::BIGINT AS ut_n, coalesce(sum(ut_lg), 0) AS ut_lg FROM g2 WHERE k = 1 GROUP BY id)
SELECT id, {sides}, {mean('p', 'mem')} AS p_memory_mean, coalesce(u_fresh, 0)::BIGINT AS u_problems, up_n, up_last, up_max, {mean('up', 'lg')} AS up_mean, up_ac AS up_last_accepted, up_tle AS up_last_limit,
  CASE WHEN contest IS NOT NULL THEN c_n ELSE 0 END AS c_n, CASE WHEN contest IS NOT NULL THEN cu_n ELSE 0 END AS cu_n, CASE WHEN contest IS NOT NULL THEN cp_n ELSE 0 END AS cp_n,
  CASE WHEN contest IS NOT NULL THEN {mean('c', 'lg')} END AS c_mean, CASE WHEN contest IS NOT NULL THEN {mean('c', 'heavy')} END AS c_heavy_rate, CASE WHEN contest IS NOT NULL THEN {mean('cu', 'lg')} END AS cu_mean, CASE WHEN contest IS NOT NULL THEN {mean('cp', 'lg')} END AS cp_mean,
  coalesce(t_n, 0) AS tag_n, {mean('t', 'lg')} AS tag_mean, {mean('t', 'heavy')} AS tag_heavy_rate, coalesce(ut_n, 0) AS utag_n, {mean('ut', 'lg')} AS utag_mean, pl_n AS plang_n, {mean('pl', 'lg')} AS plang_mean
FROM a3 LEFT JOIN hg USING (id) WHERE k = 1"""


@query("platform_history", _platform_sql(20))
def platform_history(spark, sf_dir):
    """Every record's history of its problem, user, contest, language and tags, from records more than 20 places back."""
    from ..operators import blocks, platform

    rows = timed(spark, sf_dir).select(
        F.col("job_id").alias("id"), F.col("item_key").alias("problem"), F.col("user_key").alias("user"), F.when(F.col("kind") != "signup", F.col("week")).alias("contest"), (F.col("user_key") % 3).alias("lang"),
        F.when(F.col("item_key") % 4 != 0, F.array(F.col("item_key") % 7, F.lit(10) + F.col("item_key") % 3)).otherwise(F.array().cast("array<int>")).alias("tags"),
        blocks.log_cost(F.col("work_us")).alias("cost"), (F.col("cost_us") % 1000).alias("memory"), (F.col("job_id") % 500).alias("length"),
        (F.col("work_us") > 55_000_000).cast("int").alias("heavy"), (F.col("work_us") == clock.LIMIT).cast("int").alias("over_time"), (1 - F.col("is_error")).alias("accepted"), (~F.col("is_result_only")).alias("judged"),
    )
    return platform.platform_history(rows, 20)


@query("register_counts", f"""WITH {STREAM}, w AS (SELECT job_id, k, count(*) FILTER (k = 2) OVER v AS user_arrived, max(at_us) FILTER (k = 2) OVER v AS user_last_us FROM s
  WINDOW v AS (PARTITION BY user_key ORDER BY at_us, k, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT job_id, user_arrived, user_last_us FROM w WHERE k = 1""")
def register_counts(spark, sf_dir):
    return history.registered(history.merged_stream(timed(spark, sf_dir), ["user_key"]), ["user_key"], "user")


@query("last_result", f"""WITH {STREAM}, w AS (SELECT job_id, k, arg_max(job_id, (arrival_us, job_id)) FILTER (k = 0) OVER v AS lj, arg_max(is_error, (arrival_us, job_id)) FILTER (k = 0) OVER v AS le, arg_max(work_us, (arrival_us, job_id)) FILTER (k = 0) OVER v AS lw FROM s
  WINDOW v AS (PARTITION BY user_key ORDER BY at_us, k, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT job_id, lj AS last_job, le AS last_error, lw AS last_work_us FROM w WHERE k = 1""")
def last_result(spark, sf_dir):
    return history.last_result(history.merged_stream(timed(spark, sf_dir), ["user_key", "arrival_us", "is_error", "work_us"]), ["user_key"])


@query("inflight_counts", f"""WITH {STREAM}, w AS (SELECT job_id, k, count(*) FILTER (k = 2) OVER v - count(*) FILTER (k = 0) OVER v AS in_flight FROM s
  WINDOW v AS (PARTITION BY item_key ORDER BY at_us, k, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT job_id, in_flight FROM w WHERE k = 1""")
def inflight_counts(spark, sf_dir):
    return history.in_flight(history.merged_stream(timed(spark, sf_dir), ["item_key"]), ["item_key"])


@query("ewm_history", f"""WITH RECURSIVE {JOBS}, o AS (SELECT user_key, job_id, work_us, row_number() OVER (PARTITION BY user_key ORDER BY arrival_us, job_id) AS i FROM a),
e AS (SELECT user_key, i, job_id, work_us, NULL::DOUBLE AS ewm FROM o WHERE i = 1 UNION ALL
  SELECT o.user_key, o.i, o.job_id, o.work_us, coalesce((1 - 0.2::DOUBLE) * e.ewm + 0.2::DOUBLE * e.work_us::DOUBLE, e.work_us::DOUBLE) FROM e JOIN o ON o.user_key = e.user_key AND o.i = e.i + 1)
SELECT job_id, round(ewm, 3) AS ewm FROM e""")
def ewm_history(spark, sf_dir):
    rows = history.ewm(timed(spark, sf_dir), ["user_key"], ["arrival_us", "job_id"], "work_us")
    return rows.select("job_id", F.round("ewm", 3).alias("ewm"))


@query("prefix_lag_history", f"""WITH {JOBS} SELECT job_id, count(*) OVER w AS prior_n, coalesce(sum(work_us) OVER w, 0)::BIGINT AS prior_sum FROM a
  WINDOW w AS (PARTITION BY user_key ORDER BY job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING)""")
def prefix_lag_history(spark, sf_dir):
    return history.prefix_lag(timed(spark, sf_dir), ["user_key"], "job_id", 3, "work_us").select("job_id", "prior_n", "prior_sum")


@query("distinct_items_before", f"""WITH {JOBS}, f AS (SELECT job_id, user_key, CASE WHEN row_number() OVER (PARTITION BY user_key, item_key ORDER BY job_id) = 1 THEN 1 ELSE 0 END AS f FROM a)
SELECT job_id, coalesce(sum(f) OVER (PARTITION BY user_key ORDER BY job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS distinct_before FROM f""")
def distinct_items_before(spark, sf_dir):
    return history.distinct_before(timed(spark, sf_dir), ["user_key"], "job_id", "item_key").select("job_id", "distinct_before")


@query("recent_neighbours", f"""WITH {JOBS}, w AS (SELECT job_id, list_reverse(list(user_key) OVER (PARTITION BY item_key ORDER BY arrival_us, job_id ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING)) AS l FROM t)
SELECT job_id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[:16], ','), '') AS near FROM w""")
def recent_neighbours(spark, sf_dir):
    rows = history.recent_neighbours(timed(spark, sf_dir), ["item_key"], ["arrival_us", "job_id"], "user_key")
    return rows.select("job_id", F.array_join(F.transform("near", lambda x: x.cast("string")), ",").alias("near"))


@query("duplicate_mask", f"WITH {JOBS} SELECT job_id, row_number() OVER (PARTITION BY user_key, item_key, kind ORDER BY header_us, job_id) > 1 AS duplicate FROM j")
def duplicate_mask(spark, sf_dir):
    return history.duplicates(jobs(spark, sf_dir), ["user_key", "item_key", "kind"], ["header_us", "job_id"]).select("job_id", "duplicate")


@query("coending_groups", f"WITH {JOBS}, g AS (SELECT job_id, count(*) OVER (PARTITION BY user_key, header_us // 3600000000) AS n FROM j) SELECT job_id, CASE WHEN n >= 2 THEN n ELSE -1 END AS group_size FROM g")
def coending_groups(spark, sf_dir):
    rows = jobs(spark, sf_dir).withColumn("hour", F.floor(F.col("header_us") / clock.HOUR))
    return history.coending(rows, ["user_key", "hour"]).select("job_id", F.col("group_size").cast("long").alias("group_size"))


@query("coending_merge", f"""WITH {JOBS}, g AS (SELECT job_id, row_number() OVER (PARTITION BY user_key, header_us // 3600000000 ORDER BY header_us, job_id) AS i, max(work_us) OVER (PARTITION BY user_key, header_us // 3600000000) AS work_us FROM a)
SELECT job_id, work_us FROM g WHERE i = 1""")
def coending_merge(spark, sf_dir):
    rows = timed(spark, sf_dir).withColumn("hour", F.floor(F.col("header_us") / clock.HOUR))
    return history.merge_coending(rows, ["user_key", "hour"], ["header_us", "job_id"], "work_us").select("job_id", "work_us")


@query("block_index", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS blk FROM conversations")
def block_index(spark, sf_dir):
    order = Window.partitionBy("conv_id", "role").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(order) - 1).cast("long").alias("blk"))


@query("strict_history", f"""WITH {JOBS} SELECT q.job_id, count(x.job_id) AS user_n FROM t q LEFT JOIN t x ON x.user_key = q.user_key AND x.available_us < q.arrival_us GROUP BY q.job_id""")
def strict_history(spark, sf_dir):
    """Results of a user that were readable before, not at, a job's arrival."""
    stream = history.merged_stream(timed(spark, sf_dir), ["user_key", "work_us", "is_error"], strict=True)
    return history.keyed_history(stream, ["user_key"], "user").select("job_id", F.greatest("user_n", F.lit(0)).cast("long").alias("user_n"))


@query("first_codes", "SELECT user_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY user_id")
def first_codes(spark, sf_dir):
    return study.first_codes(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("learned_score", f"WITH {JOBS}, f AS (SELECT job_id, cost_us / 1e6::DOUBLE + 1 AS s, item_key::DOUBLE AS x, ln(1 + is_error::DOUBLE) AS y FROM j), m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM f) SELECT job_id, round(ln(s) + 0.5::DOUBLE * (x - mx) / sx - 0.25::DOUBLE * (y - my) / sy, 9) AS learned FROM f, m")
def learned_score(spark, sf_dir):
    rows = jobs(spark, sf_dir).select("job_id", (F.col("cost_us") / F.lit(1e6) + 1).alias("s"), F.col("item_key").cast("double").alias("x"), F.log1p(F.col("is_error").cast("double")).alias("y"))
    return study.learned_score(rows, "s", {"x": 0.5, "y": -0.25}).select("job_id", F.round("learned", 9).alias("learned"))


_CODE_WORDS = ", ".join(f"len(list_filter(w, lambda x: x = '{k}'))::INTEGER AS n_{k}" for k in ("while", "for", "input", "def", "if", "print", "range", "try", "class", "return", "lambda", "len", "append"))
_CODE_MODULES = ", ".join(f"list_contains(m, '{k}')::INTEGER AS imp_{k}" for k in ("math", "random", "time", "sys", "os", "numpy", "itertools", "string"))


@query("code_features", rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), x AS (SELECT *, string_split(text, chr(10)) AS l, regexp_extract_all(text, '[\pL\pM\pN_]+') AS w,
  list_transform(regexp_extract_all(text, '(?m)^\s*(?:from|import)\s+([A-Za-z_][A-Za-z0-9_.]*)', 1), lambda z: string_split(z, '.')[1]) AS m FROM d), y AS (SELECT *, list_filter(l, lambda z: regexp_matches(z, '\S')) AS f FROM x)
SELECT doc_id, length(text)::INTEGER AS chars, len(l)::INTEGER AS lines, len(f)::INTEGER AS nonblank_lines, list_max(list_transform(l, lambda z: length(z)))::INTEGER AS max_line_len, len(regexp_extract_all(text, '(?m)^\s*#'))::INTEGER AS n_comment_lines, {_CODE_WORDS},
  len(m)::INTEGER AS n_import, {_CODE_MODULES}, (len(list_filter(m, lambda z: z NOT IN ('math', 'random', 'time', 'sys', 'os', 'numpy', 'itertools', 'string'))) > 0)::INTEGER AS imp_other,
  least(coalesce(list_max(list_transform(f, lambda z: length(regexp_extract(z, '^( *)', 1)))), 0), 60)::INTEGER AS max_indent, regexp_matches(text, 'while\s*\(?\s*(True|1)\s*\)?\s*:')::INTEGER AS has_while_true,
  least(coalesce(list_max(list_transform(regexp_extract_all(text, '[0-9]+'), lambda z: length(z))), 0), 18)::INTEGER AS max_num_digits, list_contains(w, 'sleep')::INTEGER AS has_sleep, (list_contains(w, 'eval') OR list_contains(w, 'exec'))::INTEGER AS has_evalexec, list_contains(w, 'open')::INTEGER AS has_open FROM y""")
def code_features(spark, sf_dir):
    """Measures of source texts, on prose; nesting, recursion and digits in ranges are checked on code in the tests."""
    from ..functions import text

    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = text.code_parts(F.col("text"))
    found = text.code_features(F.col("text"), {n: F.col(f"_{n}") for n in parts})
    return rows.withColumns({f"_{n}": x for n, x in parts.items()}).select("doc_id", *(x.cast("int").alias(n) for n, x in found.items() if n not in ("nest_loop_depth", "has_recursion", "max_range_digits")))


# ---------------------------------------------------------------- joins along time
@query("asof_backward_strict", """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, event_id AS click_id FROM events WHERE event_type = 'click')
SELECT l.event_id, r.click_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts > r.ts""")
def asof_backward_strict(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", clock.micros(F.col("ts")))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    right = e.where("event_type = 'click'").select("user_id", F.col("at").alias("click_at"), F.col("event_id").alias("click_id"))
    return temporal.asof(left, right, ["user_id"], "at", "click_at", ["click_id"], strict=True).select("event_id", "click_id")


@query("asof_nearest_tol", """WITH l AS (SELECT event_id, user_id, epoch_us(ts) AS at_ FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, epoch_us(ts) AS at_, event_id AS click_id FROM events WHERE event_type = 'click'),
p AS (SELECT l.event_id, r.click_id, abs(l.at_ - r.at_) AS gap, r.at_ > l.at_ AS ahead FROM l JOIN r USING (user_id) WHERE abs(l.at_ - r.at_) <= 21600000000),
b AS (SELECT event_id, arg_min(click_id, (gap, ahead)) AS click_id FROM p GROUP BY event_id) SELECT l.event_id, b.click_id FROM l LEFT JOIN b USING (event_id)""")
def asof_nearest_tol(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", clock.micros(F.col("ts")))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    right = e.where("event_type = 'click'").select("user_id", F.col("at").alias("click_at"), F.col("event_id").alias("click_id"))
    return temporal.asof(left, right, ["user_id"], "at", "click_at", ["click_id"], direction="nearest", tolerance=6 * clock.HOUR).select("event_id", "click_id")


@query("asof_forward", """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT user_id, ts, event_id AS purchase_id FROM events WHERE event_type = 'purchase')
SELECT l.event_id, r.purchase_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.ts""")
def asof_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", clock.micros(F.col("ts")))
    left = e.where("event_type = 'click'").select("event_id", "user_id", "at")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("at").alias("purchase_at"), F.col("event_id").alias("purchase_id"))
    return temporal.asof(left, right, ["user_id"], "at", "purchase_at", ["purchase_id"], direction="forward").select("event_id", "purchase_id")


@query("asof_two_keys", """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS at_, (props->>'$.k')::INTEGER % 5 AS item FROM events), l AS (SELECT * FROM e WHERE event_type = 'purchase'), r AS (SELECT * FROM e WHERE event_type = 'click'),
p AS (SELECT l.event_id, r.event_id AS click_id, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.at_ - r.at_), r.at_) AS i FROM l JOIN r USING (user_id, item)) SELECT l.event_id, p.click_id FROM l LEFT JOIN p ON l.event_id = p.event_id AND i = 1""")
def asof_two_keys(spark, sf_dir):
    """The nearest click of the same user on the same kind of item, however far."""
    e = table(spark, sf_dir, "events").withColumns({"at": clock.micros(F.col("ts")), "item": F.from_json("props", "k int")["k"] % 5})
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "item", "at")
    right = e.where("event_type = 'click'").select("user_id", "item", F.col("at").alias("click_at"), F.col("event_id").alias("click_id"))
    return temporal.asof(left, right, ["user_id", "item"], "at", "click_at", ["click_id"], direction="nearest").select("event_id", "click_id")


@query("points_in_intervals", """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS at_ FROM events), i AS (SELECT user_id, at_ AS lo, at_ + 86400000000 * (1 + event_id % 3) AS hi, event_id AS id FROM e WHERE event_type = 'error')
SELECT e.event_id, count(i.id) AS open, coalesce(sum(i.id), 0)::BIGINT AS ids FROM e LEFT JOIN i ON e.user_id = i.user_id AND e.at_ BETWEEN i.lo AND i.hi GROUP BY e.event_id""")
def points_in_intervals(spark, sf_dir):
    """For every event the periods of one to three days after an error of its user that hold it; they overlap, and all count."""
    e = table(spark, sf_dir, "events").withColumn("at", clock.micros(F.col("ts")))
    periods = e.where("event_type = 'error'").select("user_id", F.col("at").alias("lo"), (F.col("at") + clock.DAY * (1 + F.col("event_id") % 3)).alias("hi"), F.col("event_id").alias("id"))
    met = temporal.within(e.select("event_id", "user_id", "at"), periods, ["user_id"], "at", "lo", "hi", clock.DAY, parts=4)
    found = met.groupBy("event_id").agg(F.count("*").alias("open"), F.sum("id").alias("ids"))
    return e.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("ids", F.lit(0)).alias("ids"))


@query("next_deadline", """WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS at_ FROM events WHERE event_type = 'view'), d AS (SELECT user_id, epoch_us(ts) AS due FROM events WHERE event_type = 'error')
SELECT c.event_id, min(due) FILTER (due >= at_) AS next_due, count(*) FILTER (due BETWEEN at_ AND at_ + 259200000000) AS due_soon FROM c LEFT JOIN d ON c.user_id = d.user_id GROUP BY c.event_id""")
def next_deadline(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", clock.micros(F.col("ts")))
    asks, dues = e.where("event_type = 'view'"), e.where("event_type = 'error'")
    span = 72 * clock.HOUR
    # running counts of dues at both ends of the span, in one stream per user
    legs = dues.select("user_id", "at", F.lit(1).alias("o"), F.lit(None).cast("long").alias("event_id"), F.lit(1).alias("d"), F.col("at").alias("due"))
    for shift, order in ((0, 0), (span, 2)):
        legs = legs.unionAll(asks.select("user_id", F.col("at") + shift, F.lit(order), "event_id", F.lit(0), F.lit(None).cast("long")))
    order = Window.partitionBy("user_id").orderBy("at", "o", "event_id")
    back = Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("o"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = legs.withColumns({"n": F.sum("d").over(order), "next": F.last("due", ignorenulls=True).over(back)}).where("event_id is not null")
    return seen.groupBy("event_id").agg(F.max(F.when(F.col("o") == 0, F.col("next"))).alias("next_due"), (F.max(F.when(F.col("o") == 2, F.col("n"))) - F.max(F.when(F.col("o") == 0, F.col("n")))).alias("due_soon"))


_BUSY = "w AS (SELECT user_key, job_id, arrival_us AS s, arrival_us + work_us * 60 AS e FROM a)"


@query("session_merge", f"""WITH {JOBS}, {_BUSY}, m AS (SELECT *, max(e) OVER (PARTITION BY user_key ORDER BY s, e, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM w),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_key ORDER BY s, e, job_id) AS n FROM m)
SELECT user_key, min(s) AS start_us, max(e) AS end_us, count(*) AS n FROM (SELECT user_key, s, e, n AS grp FROM g) GROUP BY user_key, grp""")
def session_merge(spark, sf_dir):
    return temporal.sessions(busy(spark, sf_dir), ["user_key"], "s", "e", 1800 * clock.SECOND, "job_id")


def busy(spark, sf_dir):
    return timed(spark, sf_dir).select("user_key", "kind", "job_id", F.col("arrival_us").alias("s"), (F.col("arrival_us") + F.col("work_us") * 60).alias("e"))


_LEVELS = "d AS (SELECT user_key, s AS at_, 1 AS d FROM w UNION ALL SELECT user_key, e, -1 FROM w), n AS (SELECT user_key, at_, sum(d) AS d FROM d GROUP BY ALL), f AS (SELECT user_key, at_ AS from_us, lead(at_) OVER (PARTITION BY user_key ORDER BY at_) AS to_us, (sum(d) OVER (PARTITION BY user_key ORDER BY at_))::BIGINT AS level FROM n)"


@query("concurrency_steps", f"WITH {JOBS}, {_BUSY}, {_LEVELS} SELECT * FROM f WHERE to_us IS NOT NULL")
def concurrency_steps(spark, sf_dir):
    return temporal.levels(busy(spark, sf_dir), ["user_key"], "s", "e")


@query("time_weighted_levels", f"""WITH {JOBS}, {_BUSY}, {_LEVELS}, p AS (SELECT user_key, level, sum(to_us - from_us) AS us FROM f WHERE to_us IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(us) OVER (PARTITION BY user_key ORDER BY level) AS c, sum(us) OVER (PARTITION BY user_key) AS t FROM p)
SELECT user_key, round(sum(level * us)::DOUBLE / sum(us)::DOUBLE, 6) AS mean_level, min(level) FILTER (c >= 0.95::DOUBLE * t) AS quantile_level, max(level) AS max_level FROM c GROUP BY user_key""")
def time_weighted_levels(spark, sf_dir):
    rows = metrics.time_weighted(temporal.levels(busy(spark, sf_dir), ["user_key"], "s", "e"), ["user_key"], 0.95)
    return rows.withColumn("mean_level", F.round("mean_level", 6))


@query("interval_overlap", f"""WITH {JOBS}, w AS (SELECT user_key, kind, arrival_us AS s, arrival_us + work_us * 60 AS e FROM a),
d AS (SELECT user_key, s AS at_, (kind = 'click')::INT AS da, (kind = 'error')::INT AS db FROM w WHERE kind IN ('click', 'error') UNION ALL SELECT user_key, e, -(kind = 'click')::INT, -(kind = 'error')::INT FROM w WHERE kind IN ('click', 'error')),
n AS (SELECT user_key, at_, sum(da) AS da, sum(db) AS db FROM d GROUP BY ALL),
f AS (SELECT user_key, at_, lead(at_) OVER (PARTITION BY user_key ORDER BY at_) AS nx, sum(da) OVER (PARTITION BY user_key ORDER BY at_) AS la, sum(db) OVER (PARTITION BY user_key ORDER BY at_) AS lb FROM n)
SELECT user_key, sum(CASE WHEN la > 0 AND lb > 0 THEN nx - at_ ELSE 0 END)::BIGINT AS both_us FROM f GROUP BY user_key""")
def interval_overlap(spark, sf_dir):
    rows = busy(spark, sf_dir)
    return temporal.overlap(rows.where("kind = 'click'"), rows.where("kind = 'error'"), ["user_key"], "s", "e")


@query("union_length", f"""WITH {JOBS}, {_BUSY}, m AS (SELECT *, max(e) OVER (PARTITION BY user_key ORDER BY s, e, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM w)
SELECT user_key, sum(greatest(0, e - greatest(s, coalesce(b, s))))::BIGINT AS union_us FROM m GROUP BY user_key""")
def union_length(spark, sf_dir):
    merged = temporal.sessions(busy(spark, sf_dir), ["user_key"], "s", "e", 0, "job_id")
    return merged.groupBy("user_key").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("union_us"))


@query("capacity_series", f"WITH {JOBS}, b AS (SELECT DISTINCT user_key, unnest(range(arrival_us // 600000000 - 1, arrival_us // 600000000 + 2)) AS bucket FROM a) SELECT bucket, count(*) AS workers FROM b GROUP BY bucket")
def capacity_series(spark, sf_dir):
    bucket = F.floor(F.col("arrival_us") / (600 * clock.SECOND))
    near = timed(spark, sf_dir).select("user_key", F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket")).distinct()
    return near.groupBy("bucket").agg(F.count("*").alias("workers"))


@query("think_time", f"WITH {JOBS} SELECT job_id, arrival_us - lag(available_us) OVER (PARTITION BY user_key ORDER BY arrival_us, job_id) AS think_us FROM t")
def think_time(spark, sf_dir):
    order = Window.partitionBy("user_key").orderBy("arrival_us", "job_id")
    return timed(spark, sf_dir).select("job_id", (F.col("arrival_us") - F.lag("available_us").over(order)).alias("think_us"))


_HOURLY = "p AS (SELECT kind, arrival_us // 3600000000 AS hour, count(*) AS n FROM a GROUP BY ALL)"


def hourly(spark, sf_dir):
    return timed(spark, sf_dir).groupBy("kind", F.floor(F.col("arrival_us") / clock.HOUR).alias("hour")).agg(F.count("*").alias("n"))


@query("rolling_24", f"WITH {JOBS}, {_HOURLY} SELECT kind, hour, CASE WHEN count(*) OVER w >= 12 THEN sum(n) OVER w / count(*) OVER w END AS mean_24 FROM p WINDOW w AS (PARTITION BY kind ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)")
def rolling_24(spark, sf_dir):
    over = Window.partitionBy("kind").orderBy("hour").rowsBetween(-23, Window.currentRow)
    return hourly(spark, sf_dir).select("kind", "hour", F.when(F.count("*").over(over) >= 12, F.sum("n").over(over) / F.count("*").over(over)).alias("mean_24"))


@query("lag_panel", f"WITH {JOBS}, {_HOURLY} SELECT kind, hour, n, lag(n, 1) OVER w AS lag_1, lag(n, 2) OVER w AS lag_2, lag(n, 7) OVER w AS lag_7, lag(n, 14) OVER w AS lag_14 FROM p WINDOW w AS (PARTITION BY kind ORDER BY hour)")
def lag_panel(spark, sf_dir):
    order = Window.partitionBy("kind").orderBy("hour")
    return hourly(spark, sf_dir).select("kind", "hour", "n", *(F.lag("n", i).over(order).alias(f"lag_{i}") for i in (1, 2, 7, 14)))


@query("week_shift", f"WITH {JOBS} SELECT job_id, week, arrival_us + 3 * 604800000000 AS shifted_us FROM a")
def week_shift(spark, sf_dir):
    return timed(spark, sf_dir).select("job_id", "week", (F.col("arrival_us") + 3 * clock.WEEK).alias("shifted_us"))


# ---------------------------------------------------------------- overlays and load
_ENTRIES = "e AS (SELECT * FROM (VALUES (0, '1', 0), (0, '2', 1), (0, '3', 0), (1, '1', 2), (1, '2', 0), (1, '3', 1), (2, '2', 3), (0, '0', 1), (2, '0', 0)) v(copy, term, shift_weeks))"
_ENTRY_ROWS = [(0, "1", 0), (0, "2", 1), (0, "3", 0), (1, "1", 2), (1, "2", 0), (1, "3", 1), (2, "2", 3), (0, "0", 1), (2, "0", 0)]


def overlay(spark, sf_dir):
    rows = timed(spark, sf_dir).withColumn("term", (F.col("user_key") % 4).cast("string"))
    known = spark.createDataFrame(_ENTRY_ROWS, "copy int, term string, shift_weeks int")
    return study.superpose(rows, known, "term")


_OVERLAY = f"WITH {JOBS}, {_ENTRIES}, o AS (SELECT a.job_id, a.user_key, a.work_us, e.copy, e.term, a.arrival_us + e.shift_weeks * 604800000000 AS arrival_us FROM (SELECT *, (user_key % 4)::VARCHAR AS term FROM a) a JOIN e ON a.term = e.term)"


@query("superpose", _OVERLAY + " SELECT job_id, copy::INTEGER AS copy, arrival_us, row_number() OVER (PARTITION BY copy ORDER BY arrival_us, job_id) AS place FROM o")
def superpose(spark, sf_dir):
    order = Window.partitionBy("copy").orderBy("arrival_us", "job_id")
    return overlay(spark, sf_dir).select("job_id", "copy", "arrival_us", F.row_number().over(order).cast("long").alias("place"))


@query("busy_hour", _OVERLAY + ", p AS (SELECT copy, arrival_us // 3600000000 AS h, sum(work_us) AS w FROM o GROUP BY ALL) SELECT copy::INTEGER AS copy, max(w)::BIGINT AS busy_us FROM p GROUP BY copy")
def busy_hour(spark, sf_dir):
    return study.busy_hour(overlay(spark, sf_dir), ["copy"])


@query("copies_probe", f"""WITH {JOBS}, s AS (SELECT * FROM (VALUES (0, 0, 0), (0, 1, 24), (1, 0, 168), (1, 1, 192), (2, 0, 48), (2, 1, 72)) v(copy, term, shift)),
m AS (SELECT s.copy, a.arrival_us // 3600000000 + s.shift AS hour, sum(work_us) AS w FROM a JOIN s ON a.user_key % 2 = s.term GROUP BY ALL),
g AS (SELECT c.copy, m.hour, sum(m.w) AS w FROM (SELECT DISTINCT copy FROM s) c JOIN m ON m.copy <= c.copy GROUP BY ALL)
SELECT (copy + 1)::INTEGER AS copies, max(w)::BIGINT AS busy_us FROM g GROUP BY copy""")
def copies_probe(spark, sf_dir):
    shifts = spark.createDataFrame([(0, 0, 0), (0, 1, 24), (1, 0, 168), (1, 1, 192), (2, 0, 48), (2, 1, 72)], "copy int, term long, shift_hours long")
    return study.copies_probe(timed(spark, sf_dir).withColumn("term", F.col("user_key") % 2), shifts, "term")


@query("level_servers", _OVERLAY + ", p AS (SELECT copy, arrival_us // 3600000000 AS h, sum(work_us) AS w FROM o GROUP BY ALL), b AS (SELECT copy, max(w) AS w FROM p GROUP BY copy) SELECT copy::INTEGER AS copy, l.load, greatest(1, floor(w::DOUBLE / 3600000000 / l.load + 0.5))::INTEGER AS servers FROM b, (SELECT unnest([0.05::DOUBLE, 0.08, 0.1]) AS load) l")
def level_servers(spark, sf_dir):
    busiest = study.busy_hour(overlay(spark, sf_dir), ["copy"])
    rows = [busiest.select("copy", F.lit(x).alias("load"), study.servers(F.col("busy_us"), x).alias("servers")) for x in (0.05, 0.08, 0.1)]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


@query("assembled_overlay", _OVERLAY.replace("SELECT a.job_id,", "SELECT a.job_id, a.deadline_us - a.arrival_us BETWEEN 0 AND 86400000000 AS in_window,") + """, b AS (SELECT copy, max(w) AS w FROM (SELECT copy, arrival_us // 3600000000 AS h, sum(work_us) AS w FROM o GROUP BY ALL) GROUP BY copy)
SELECT o.copy::INTEGER AS copy, job_id, row_number() OVER (PARTITION BY o.copy ORDER BY arrival_us, job_id) - 1 AS rank, arrival_us - min(arrival_us) OVER (PARTITION BY o.copy) // 86400000000 * 86400000000 AS arrival_us, work_us, (arrival_us - 345600000000) // 604800000000 AS calendar_week, in_window,
  w::BIGINT AS busy_us, greatest(1, floor(w::DOUBLE / 3600000000 / 0.05::DOUBLE + 0.5))::INTEGER || '|' || greatest(1, floor(w::DOUBLE / 3600000000 / 0.1::DOUBLE + 0.5))::INTEGER AS servers FROM o JOIN b USING (copy)""")
def assembled_overlay(spark, sf_dir):
    rows = timed(spark, sf_dir).withColumns({"term": (F.col("user_key") % 4).cast("string"), "in_window": clock.in_deadline_window(F.col("arrival_us"), F.col("deadline_us"))})
    copies = study.superpose(rows, spark.createDataFrame(_ENTRY_ROWS, "copy int, term string, shift_weeks int"), "term")
    out = study.assembled(copies, ["copy"], (0.05, 0.1), ["in_window"])
    return out.withColumn("servers", F.array_join(F.transform("servers", lambda x: x.cast("string")), "|"))


@query("arrival_compression", f"WITH {JOBS} SELECT job_id, floor((arrival_us - (SELECT min(arrival_us) FROM a)) * 0.25::DOUBLE)::BIGINT AS compressed_us FROM a")
def arrival_compression(spark, sf_dir):
    rows = timed(spark, sf_dir)
    first = rows.agg(F.min("arrival_us").alias("first"))
    return rows.crossJoin(F.broadcast(first)).select("job_id", F.floor((F.col("arrival_us") - F.col("first")) * F.lit(0.25)).alias("compressed_us"))  # one row


@query("episode_arrivals", f"WITH {JOBS} SELECT job_id, (deadline_us - floor(604800000000::DOUBLE * pow({_bits('user_key', 'job_id')} * 2.0::DOUBLE ^ -52, 1::DOUBLE / 0.7::DOUBLE)))::BIGINT AS arrival_us FROM a")
def episode_arrivals(spark, sf_dir):
    """Arrivals before a deadline by the inverse of a power law, one keyed draw per job."""
    draw = clock.jitter("user_key", "job_id")
    return jobs(spark, sf_dir).select("job_id", (F.col("deadline_us") - F.floor(F.lit(float(clock.WEEK)) * clock.power(draw, 1 / 0.7))).cast("long").alias("arrival_us"))


# ---------------------------------------------------------------- replay
@query("fluid_backlog", f"""WITH {JOBS}, p AS (SELECT job_id, kind, arrival_us, work_us, job_id AS i, sum(big_us) OVER (PARTITION BY user_key ORDER BY arrival_us, job_id) AS p, big_us, user_key FROM h)
SELECT job_id, (p - 3 * arrival_us - min(p - big_us - 3 * arrival_us) OVER (PARTITION BY user_key ORDER BY arrival_us, job_id))::BIGINT AS backlog_us FROM p""")
def fluid_backlog(spark, sf_dir):
    return replay.fluid_backlog(heavy_load(spark, sf_dir), ["user_key"], 3).select("job_id", "backlog_us")


@query("lindley_fcfs", f"""WITH {JOBS}, p AS (SELECT job_id, arrival_us, big_us, user_key, sum(big_us) OVER (PARTITION BY user_key ORDER BY arrival_us, job_id) - big_us AS p FROM h)
SELECT job_id, (p - arrival_us - min(p - arrival_us) OVER (PARTITION BY user_key ORDER BY arrival_us, job_id))::BIGINT AS wait_us FROM p""")
def lindley_fcfs(spark, sf_dir):
    return replay.lindley(heavy_load(spark, sf_dir), ["user_key"]).select("job_id", "wait_us")


#: Waits with two servers per user, by recursion over each user's jobs.
_FCFS2 = f"""{JOBS}, o AS (SELECT user_key, job_id, arrival_us, big_us, row_number() OVER (PARTITION BY user_key ORDER BY arrival_us, job_id) AS i FROM h),
r AS (SELECT user_key, i, job_id, 0::BIGINT AS wait_us, arrival_us + big_us AS f1, arrival_us AS f2 FROM o WHERE i = 1 UNION ALL
  SELECT o.user_key, o.i, o.job_id, greatest(least(r.f1, r.f2) - o.arrival_us, 0), greatest(r.f1, r.f2), greatest(least(r.f1, r.f2), o.arrival_us) + o.big_us
  FROM r JOIN o ON o.user_key = r.user_key AND o.i = r.i + 1)"""


@query("kserver_fcfs", f"WITH RECURSIVE {_FCFS2} SELECT job_id, wait_us FROM r")
def kserver_fcfs(spark, sf_dir):
    return replay.fcfs(heavy_load(spark, sf_dir), ["user_key"], SERVERS).select("job_id", "wait_us")


RULES = (
    replay.fcfs_rule(),
    replay.score_rule(),
    replay.guard_rule(36_000, SERVERS, 600, 0.05, 5, limit_s=600),
    replay.fixed_rule(36_000, SERVERS, 3_000, limit_s=600),
    replay.skip_rule(7_200, SERVERS, limit_s=600),
    replay.timeout_rule(3_600),
    replay.block_rule(4),
    replay.channels_rule(20_000, 3, 30_000),
    replay.refund_rule(30_000, limit_s=600),
)


def replayed(spark, sf_dir, rules=RULES):
    return replay.replay(heavy_load(spark, sf_dir), ["user_key"], SERVERS, rules)


def _dispatch_sql(key: str, fired: str = "NULL", work: str = "big_us", score: str = "cost_us / 1e6::DOUBLE + (cost_us % 97)::DOUBLE", delay: int = 0, per: str = "user_key") -> str:
    """Common tables `p` (job_id, wait_us, place, forced) of two servers per user, by recursion over dispatches.

    `todo` holds a user's jobs by rank, `s` those dispatched with begin and
    reported end. A dispatch comes when a server is free and a job has come;
    `key` orders the jobs x that have come by then, unless the expression
    `fired` over `come` and `s` at time t names the rank of one.
    """
    return f"""{JOBS}, n0 AS (SELECT *, {work} AS w_us, {score} AS sc FROM h),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY arrival_us, job_id) - 1 AS i FROM n0),
r0 AS (SELECT {per} AS g, list(struct_pack(i := i, a := arrival_us, w := w_us::BIGINT, sc := sc, q := item_key, id := job_id) ORDER BY i) AS todo FROM ranked GROUP BY {per}),
r AS (
  SELECT g, todo, []::STRUCT(i BIGINT, w BIGINT, b BIGINT, e BIGINT, q BIGINT)[] AS s, -9000000000000000000::BIGINT AS f1, -9000000000000000000::BIGINT AS f2, NULL::BIGINT AS job_id, NULL::BIGINT AS wait_us, -1::BIGINT AS place, NULL::BOOLEAN AS forced FROM r0 UNION ALL
  SELECT g, list_filter(todo, lambda x: x.i <> pick.i), list_append(s, struct_pack(i := pick.i, w := pick.w, b := t, e := t + pick.w + {delay}, q := pick.q)), least(f2, t + pick.w), greatest(f2, t + pick.w), pick.id, t - pick.a, place + 1, by_guard
  FROM (SELECT *, coalesce(list_filter(come, lambda x: x.i = fired_i)[1], list_sort(list_transform(come, lambda x: struct_pack(k := {key}, x := x)))[1].x) AS pick, fired_i IS NOT NULL AS by_guard
    FROM (SELECT *, {fired} AS fired_i FROM (SELECT *, list_filter(todo, lambda x: x.a <= t) AS come FROM (SELECT *, greatest(f1, todo[1].a) AS t FROM r WHERE len(todo) > 0))))),
p AS (SELECT g, job_id, wait_us, place, forced FROM r WHERE job_id IS NOT NULL)"""


def _done_sql(what: str, where: str = "true", rank: str = "come[1].i") -> str:
    """Sum over dispatched jobs d of a later rank."""
    return f"coalesce(list_sum(list_transform(list_filter(s, lambda d: d.i > {rank} AND ({where})), lambda d: {what})), 0)"


_SCORED = "struct_pack(a := x.sc, b := x.i)"


def _work_guard_sql(rule: replay.Rule) -> str:
    """The rank that a guard on overtaking work names: the first in arrival order whose budget is used up."""
    eta = round(rule.eta_k * replay.RATE_PARTS)
    waiting = "len(list_filter(todo, lambda y: y.i < x.i)) + len(list_filter(s, lambda y: y.i < x.i AND y.b >= x.a))"
    budget = f"{rule.b0_us} + {rule.gam_us} * ({waiting})"
    if rule.bmax_us:
        budget = f"least({budget}, {rule.bmax_us})"
    own = "coalesce(list_sum(list_transform(list_filter(s, lambda d: d.i > x.i AND d.e <= t), lambda d: d.w)), 0)"
    used = f"({own})::HUGEINT * {replay.RATE_PARTS} >= ({budget})::HUGEINT * {replay.RATE_PARTS} + {eta}::HUGEINT * (t - x.a)"
    first = f"CASE WHEN {rule.bmax_us} > 0 AND {_done_sql('d.w', 'd.e <= t')} >= {rule.bmax_us} THEN come[1].i ELSE " if rule.bmax_us else "CASE WHEN false THEN 0 ELSE "
    return f"{first}list_filter(come, lambda x: {used})[1].i END"


@query("replay_fcfs", f"WITH RECURSIVE {_FCFS2} SELECT job_id, wait_us FROM r")
def replay_fcfs(spark, sf_dir):
    return replayed(spark, sf_dir, [replay.fcfs_rule()]).select("job_id", "wait_us")


@query("replay_sjf", f"WITH RECURSIVE {_dispatch_sql(_SCORED, score='big_us::DOUBLE')} SELECT job_id, wait_us FROM p")
def replay_sjf(spark, sf_dir):
    rows = heavy_load(spark, sf_dir).withColumn("score", F.col("work_us").cast("double"))
    return replay.replay(rows, ["user_key"], SERVERS, [replay.score_rule("SJF")]).select("job_id", "wait_us")


_AGED = "cost_us / 1e6::DOUBLE + (cost_us % 97)::DOUBLE + 0.01::DOUBLE * (arrival_us - min(arrival_us) OVER (PARTITION BY user_key)) / 1000000::DOUBLE"


@query("replay_aging", f"WITH RECURSIVE {_dispatch_sql(_SCORED, score=_AGED)} SELECT job_id, wait_us, place FROM p")
def replay_aging(spark, sf_dir):
    rows = heavy_load(spark, sf_dir)
    first = F.min("arrival_us").over(Window.partitionBy("user_key"))
    rows = rows.withColumn("score", replay.aged(F.col("score"), F.col("arrival_us"), first, 0.01))
    return replay.replay(rows, ["user_key"], SERVERS, [replay.score_rule("Aging")]).select("job_id", "wait_us", "place")


def _register_replay(rule: replay.Rule, name: str, key: str = _SCORED, fired: str = "NULL") -> None:
    @query(name, f"WITH RECURSIVE {_dispatch_sql(key, fired)} SELECT job_id, wait_us, place, forced FROM p")
    def run(spark, sf_dir):
        return replayed(spark, sf_dir, [rule]).select("job_id", "wait_us", "place", "forced")


_SPJF, _GUARD, _FIXED, _SKIP, _TIMEOUT, _BLOCK, _CHANNELS, _REFUND = RULES[1:]
_register_replay(_SPJF, "replay_spjf")
_register_replay(_GUARD, "replay_guard", fired=_work_guard_sql(_GUARD))
_register_replay(_FIXED, "replay_fixed", fired=_work_guard_sql(_FIXED))
_register_replay(_SKIP, "replay_skip", fired=f"CASE WHEN {_done_sql('1')} >= {_SKIP.skips} THEN come[1].i END")
_register_replay(_TIMEOUT, "replay_timeout", fired=f"CASE WHEN t - come[1].a >= {_TIMEOUT.timeout_us} THEN come[1].i END")
_register_replay(_BLOCK, "replay_block", key=f"struct_pack(z := x.i // {_BLOCK.block}, a := x.sc, b := x.i)")
_register_replay(
    _CHANNELS,
    "replay_channels",
    fired=f"CASE WHEN {_done_sql('1', f'd.e <= t AND d.w <= {_CHANNELS.short_us}')} >= {_CHANNELS.skips} OR {_done_sql('d.w', f'd.e <= t AND d.w > {_CHANNELS.short_us}')} >= {_CHANNELS.b0_us} THEN come[1].i END",
)
_register_replay(_REFUND, "replay_refund", fired=f"CASE WHEN {_done_sql(f'CASE WHEN d.e <= t THEN d.w ELSE {_REFUND.limit_us} END')} >= {_REFUND.b0_us} THEN come[1].i END")


_QUEUED = f"""{_dispatch_sql(_SCORED, _work_guard_sql(_GUARD))}, z AS (SELECT p.*, h.arrival_us + p.wait_us AS start_us, (SELECT count(*) FROM h x WHERE x.user_key = p.g AND x.arrival_us <= h.arrival_us + p.wait_us) - p.place AS queue FROM p JOIN h USING (job_id))"""


def _guarded(spark, sf_dir):
    rows = heavy_load(spark, sf_dir)
    return replay.replay(rows, ["user_key"], SERVERS, [_GUARD]).join(rows.select("job_id", "arrival_us", "score", "cost_us"), "job_id")


@query("queue_weights", f"WITH RECURSIVE {_QUEUED} SELECT g AS user_key, sum(queue)::BIGINT AS queue_total, sum(queue * forced::INT)::BIGINT AS queue_forced, sum(queue * forced::INT)::DOUBLE / sum(queue)::DOUBLE AS forced_share FROM z GROUP BY g")
def queue_weights(spark, sf_dir):
    """Queue lengths at dispatch, and how much of them the guard's dispatches met."""
    return replay.queue_weights(_guarded(spark, sf_dir), ["user_key"])


@query("rank_displacement", f"""WITH RECURSIVE {_dispatch_sql(_SCORED, _work_guard_sql(_GUARD))}, y AS (SELECT p.g, p.place, k.i, k.arrival_us, k.arrival_us + p.wait_us AS start_us, p.job_id, k.sc, k.cost_us / 1e6::DOUBLE AS cs FROM p JOIN ranked k USING (job_id))
SELECT q.job_id, count(*) FILTER ((x.cs, x.i) < (q.cs, q.i)) - count(*) FILTER ((x.sc, x.i) < (q.sc, q.i)) AS moved FROM y q JOIN y x ON x.g = q.g AND x.arrival_us <= q.start_us AND x.place >= q.place GROUP BY q.job_id""")
def rank_displacement(spark, sf_dir):
    """How a job's rank in its queue at dispatch moves if scores lose their noise."""
    rows = _guarded(spark, sf_dir).withColumn("corrected", F.col("cost_us") / F.lit(1e6))
    return replay.rank_displacement(rows, ["user_key"], "score", "corrected").select("job_id", "moved")


@query("rebased", f"WITH {JOBS} SELECT job_id, arrival_us - floor(min(arrival_us) OVER (PARTITION BY user_key) / 86400000000)::BIGINT * 86400000000 AS arrival_us FROM a")
def rebased(spark, sf_dir):
    return study.rebased(timed(spark, sf_dir), ["user_key"]).select("job_id", "arrival_us")


def _per_user(spark, sf_dir, run, new):
    from ..operators.traces import per_trace

    rows = heavy_load(spark, sf_dir).select("user_key", "job_id", F.col("arrival_us").alias("came_us"), "work_us", "score")
    return per_trace(rows, ["user_key"], ["came_us", "job_id"], ["job_id"], run, new)


@query("replay_closed_loop", f"""WITH RECURSIVE {JOBS}, ranked AS (SELECT *, cost_us / 1e6::DOUBLE + (cost_us % 97)::DOUBLE AS sc, row_number() OVER (PARTITION BY user_key ORDER BY arrival_us, job_id) - 1 AS i FROM h),
r0 AS (SELECT user_key AS g, list(struct_pack(i := i, o := job_id % 5, a := arrival_us, w := big_us, sc := sc, id := job_id) ORDER BY i) AS todo FROM ranked GROUP BY user_key),
r AS (SELECT g, todo, []::STRUCT(o BIGINT, e BIGINT)[] AS ended, -9000000000000000000::BIGINT AS f1, -9000000000000000000::BIGINT AS f2, NULL::BIGINT AS job_id, NULL::BIGINT AS arrival_us, NULL::BIGINT AS wait_us FROM r0 UNION ALL
  SELECT g, list_filter(todo, lambda x: x.i <> pick.i), list_append(list_filter(ended, lambda y: y.o <> pick.o), struct_pack(o := pick.o, e := t + pick.w)), least(f2, t + pick.w), greatest(f2, t + pick.w), pick.id, pick.a, t - pick.a
  FROM (SELECT *, list_sort(list_transform(list_filter(come, lambda x: x.a <= t), lambda x: struct_pack(k := {_SCORED}, x := x)))[1].x AS pick FROM (SELECT *, greatest(f1, list_min(list_transform(come, lambda x: x.a))) AS t FROM (
    SELECT *, list_transform(list_filter(todo, lambda x: len(list_filter(todo, lambda y: y.o = x.o AND y.i < x.i)) = 0), lambda x: struct_pack(i := x.i, o := x.o, a := coalesce(list_filter(ended, lambda y: y.o = x.o)[1].e + 3600000000, x.a), w := x.w, sc := x.sc, id := x.id)) AS come FROM r WHERE len(todo) > 0))))
SELECT job_id, arrival_us, wait_us FROM r WHERE job_id IS NOT NULL""")
def replay_closed_loop(spark, sf_dir):
    def run(x):
        owner = (x["job_id"] % 5).tolist()
        return replay.simulate_closed(owner, [clock.HOUR] * len(owner), x["work_us"].tolist(), x["score"].tolist(), x["came_us"].tolist(), SERVERS)

    return _per_user(spark, sf_dir, run, "arrival_us long, wait_us long")


@query("replay_abandonment")
def replay_abandonment(spark, sf_dir):
    def run(x):
        return replay.simulate_abandon(x["came_us"].tolist(), x["work_us"].tolist(), x["score"].tolist(), SERVERS, 4.0 * clock.HOUR, 0.5, clock.HOUR)

    return _per_user(spark, sf_dir, run, "wait_us long, attempts long, served boolean")


@query("replay_backfill")
def replay_backfill(spark, sf_dir):
    def run(x):
        estimate = (x["work_us"] * 3 // 2 + 1).tolist()
        return [replay.simulate_backfill(x["came_us"].tolist(), x["work_us"].tolist(), estimate, SERVERS, clock.HOUR)]

    return _per_user(spark, sf_dir, run, "wait_us long")


@query("replay_varying_capacity", f"""WITH RECURSIVE {JOBS}, n0 AS (SELECT *, cost_us / 1e6::DOUBLE + (cost_us % 97)::DOUBLE AS sc FROM h), ranked AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY arrival_us, job_id) - 1 AS i FROM n0),
r0 AS (SELECT user_key AS g, min(arrival_us) AS t0, list(struct_pack(i := i, a := arrival_us, w := big_us, sc := sc, id := job_id) ORDER BY i) AS todo FROM ranked GROUP BY user_key),
r AS (
  SELECT g, t0, t0 AS t, todo, []::BIGINT[] AS ends, NULL::BIGINT AS job_id, NULL::BIGINT AS wait_us, -1::BIGINT AS place FROM r0 UNION ALL
  SELECT g, t0, now_, list_filter(todo, lambda x: x.i <> pick.i), list_append(list_filter(ends, lambda e: e > now_), now_ + pick.w), pick.id, now_ - pick.a, place + 1
  FROM (SELECT *, list_sort(list_transform(list_filter(todo, lambda x: x.a <= now_), lambda x: struct_pack(k := {_SCORED}, x := x)))[1].x AS pick
    FROM (SELECT *, list_min(list_filter(list_concat([from_], list_concat(ends, list_transform(range(60), lambda d: t0 + d * 86400000000))), lambda m: m >= from_ AND len(list_filter(ends, lambda e: e > m)) < 1 + least((m - t0) // 86400000000, 59) % 3)) AS now_
      FROM (SELECT *, greatest(t, todo[1].a) AS from_ FROM r WHERE len(todo) > 0))))
SELECT job_id, wait_us, place FROM r WHERE job_id IS NOT NULL""")
def replay_varying_capacity(spark, sf_dir):
    def run(x):
        steps = [(int(x["came_us"][0]) + i * clock.DAY, 1 + i % 3) for i in range(60)]
        return replay.simulate(x["came_us"].tolist(), x["work_us"].tolist(), x["score"].tolist(), steps, replay.score_rule())[:2]

    return _per_user(spark, sf_dir, run, "wait_us long, place long")


@query("replay_late_reports", f"WITH RECURSIVE {_dispatch_sql(_SCORED, _work_guard_sql(_GUARD), delay=clock.HOUR)} SELECT job_id, wait_us, place, forced FROM p")
def replay_late_reports(spark, sf_dir):
    from dataclasses import replace

    late = replace(_GUARD, name="Late", report_delay_us=clock.HOUR)
    return replayed(spark, sf_dir, [late]).select("job_id", "wait_us", "place", "forced")


# ---------------------------------------------------------------- bounds and identities
@query("in_out_work", f"""WITH RECURSIVE {_FCFS2}, c AS (SELECT h.user_key, h.job_id, h.arrival_us, h.big_us, row_number() OVER (PARTITION BY h.user_key ORDER BY h.cost_us % 1000, h.job_id) AS place, row_number() OVER (PARTITION BY h.user_key ORDER BY h.arrival_us, h.job_id) AS rank FROM h)
SELECT q.job_id, coalesce(sum(x.big_us) FILTER (x.rank > q.rank AND x.place < q.place), 0)::BIGINT AS in_us, coalesce(sum(x.big_us) FILTER (x.rank < q.rank AND x.place > q.place), 0)::BIGINT AS out_us
FROM c q JOIN c x ON q.user_key = x.user_key GROUP BY q.job_id""")
def in_out_work(spark, sf_dir):
    order = Window.partitionBy("user_key").orderBy(F.col("cost_us") % 1000, "job_id")
    return replay.overtaking(heavy_load(spark, sf_dir).withColumn("place", F.row_number().over(order)), ["user_key"]).select("job_id", "in_us", "out_us")


@query("identity_residual", "SELECT event_id AS job_id, 0::BIGINT AS residual_us FROM events")
def identity_residual(spark, sf_dir):
    """One server: a job waits longer by exactly the work that overtook it less what it overtook."""
    rows = heavy_load(spark, sf_dir)
    played = replay.replay(rows, ["user_key"], 1, [replay.score_rule()])
    schedule = rows.join(played.select("job_id", "place", "wait_us"), "job_id")
    moved = replay.overtaking(schedule, ["user_key"]).drop("user_key")
    base = replay.lindley(rows, ["user_key"]).select("job_id", F.col("wait_us").alias("fcfs_us"))
    both = schedule.select("job_id", "wait_us").join(moved, "job_id").join(base, "job_id")
    return both.select("job_id", (F.col("wait_us") - F.col("fcfs_us") - F.col("in_us") + F.col("out_us")).alias("residual_us"))


@query("guard_bound", f"""WITH RECURSIVE {_dispatch_sql(_SCORED, _work_guard_sql(_GUARD), work='least(big_us, 600000000)')},
f AS (SELECT user_key, i, job_id, 0::BIGINT AS wait_us, arrival_us + w_us AS f1, arrival_us AS f2 FROM ranked WHERE i = 0 UNION ALL
  SELECT o.user_key, o.i, o.job_id, greatest(least(f.f1, f.f2) - o.arrival_us, 0), greatest(f.f1, f.f2), greatest(least(f.f1, f.f2), o.arrival_us) + o.w_us FROM f JOIN ranked o ON o.user_key = f.user_key AND o.i = f.i + 1)
SELECT g AS user_key, count(*) AS jobs, count(*) FILTER (p.wait_us > f.wait_us + {_GUARD.bmax_us / SERVERS + (3 - 2 / SERVERS) * 600 * clock.SECOND}::DOUBLE) AS violations, max(p.wait_us - f.wait_us) AS worst_excess_us FROM p JOIN f ON f.user_key = g AND f.job_id = p.job_id GROUP BY g""")
def guard_bound(spark, sf_dir):
    rule = RULES[2]
    rows = heavy_load(spark, sf_dir).withColumn("work_us", F.least("work_us", F.lit(600 * clock.SECOND)))
    waits = replay.replay(rows, ["user_key"], SERVERS, [rule])
    return replay.bound_usage(waits, replay.fcfs(rows, ["user_key"], SERVERS), ["user_key"], rule, SERVERS, limit_s=600)


@query("absolute_bound", f"""WITH RECURSIVE {_FCFS2}, p AS (SELECT user_key, job_id, arrival_us, big_us, sum(big_us) OVER (PARTITION BY user_key ORDER BY arrival_us, job_id) AS p FROM h),
v AS (SELECT job_id, user_key, p - 2 * arrival_us - min(p - big_us - 2 * arrival_us) OVER (PARTITION BY user_key ORDER BY arrival_us, job_id) AS v FROM p),
m AS (SELECT user_key, max(v) AS sigma FROM v GROUP BY user_key)
SELECT r.user_key, count(*) AS jobs, count(*) FILTER (r.wait_us * 2 > m.sigma + 2 * (SELECT max(big_us) FROM h)) AS violations, max(m.sigma)::BIGINT AS sigma_us FROM r JOIN m USING (user_key) GROUP BY r.user_key""")
def absolute_bound(spark, sf_dir):
    rows = heavy_load(spark, sf_dir)
    sigma = replay.fluid_backlog(rows, ["user_key"], SERVERS).groupBy("user_key").agg(F.max("backlog_us").alias("sigma_us"))
    most = rows.agg(F.max("work_us").alias("most"))
    waits = replay.fcfs(rows, ["user_key"], SERVERS).join(sigma, "user_key").crossJoin(F.broadcast(most))  # one row
    over = F.col("wait_us") * SERVERS > F.col("sigma_us") + SERVERS * F.col("most")
    return waits.groupBy("user_key").agg(F.count("*").alias("jobs"), F.count_if(over).alias("violations"), F.max("sigma_us").alias("sigma_us"))


# ---------------------------------------------------------------- metrics
def fcfs_waits(spark, sf_dir):
    rows = heavy_load(spark, sf_dir)
    return replay.fcfs(rows, ["user_key"], SERVERS).join(rows.select("job_id", "kind", "arrival_us", "deadline_us", "work_us", "week"), "job_id")


@query("wait_summary", f"WITH RECURSIVE {_FCFS2} SELECT h.kind, count(*) AS n, round(avg(wait_us), 3) AS mean_us, round(quantile_cont(wait_us, 0.99), 3) AS p99_us, max(wait_us) AS max_us FROM r JOIN h USING (job_id) GROUP BY h.kind")
def wait_summary(spark, sf_dir):
    return fcfs_waits(spark, sf_dir).groupBy("kind").agg(
        F.count("*").alias("n"), F.round(F.avg("wait_us"), 3).alias("mean_us"), F.round(F.percentile("wait_us", F.lit(0.99)), 3).alias("p99_us"), F.max("wait_us").alias("max_us")
    )


_POLICIES = " UNION ALL ".join(
    f"SELECT '{rule.name}' AS policy, * FROM (WITH RECURSIVE {_dispatch_sql('struct_pack(a := x.i)' if rule.order == 'fcfs' else _SCORED, fired)} SELECT job_id, wait_us, forced FROM p)"
    for rule, fired in ((RULES[0], "NULL"), (_SPJF, "NULL"), (_GUARD, _work_guard_sql(_GUARD)), (_FIXED, _work_guard_sql(_FIXED)))
)


@query("policy_summary", f"""WITH {JOBS}, w AS ({_POLICIES}), x AS (SELECT w.*, w.wait_us - f.wait_us AS excess, f.wait_us AS fcfs_us, h.deadline_us - h.arrival_us BETWEEN 0 AND 86400000000 AS in_window, h.big_us > 150000000000 AS heavy FROM w JOIN w f ON f.policy = 'FCFS' AND f.job_id = w.job_id JOIN h ON h.job_id = w.job_id)
SELECT policy, count(*) AS jobs, round(quantile_cont(wait_us, 0.99) FILTER (in_window), 6) AS window_p99_us, round(avg(wait_us), 6) AS mean_us, round(quantile_cont(wait_us, 0.99), 6) AS p99_us, max(excess) AS max_excess_us, max(excess) FILTER (fcfs_us <= 1000000) AS harm_us, max(wait_us) FILTER (heavy) AS max_heavy_us, round(avg(forced::INT), 6) AS forced_share FROM x GROUP BY policy""")
def policy_summary(spark, sf_dir):
    rows = heavy_load(spark, sf_dir)
    base = replay.fcfs(rows, ["user_key"], SERVERS).select("job_id", F.col("wait_us").alias("fcfs_us"))
    marks = rows.select("job_id", clock.in_deadline_window(F.col("arrival_us"), F.col("deadline_us")).alias("in_window"), (F.col("work_us") > 150_000 * clock.SECOND).alias("heavy"))
    waits = replayed(spark, sf_dir, RULES[:4]).join(base, "job_id").join(marks, "job_id")
    out = metrics.policy_summary(waits, ["policy"])
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query("wait_percentiles", f"WITH RECURSIVE {_FCFS2} SELECT user_key, round(quantile_cont(wait_us, 0.5)) AS p50_us, round(quantile_cont(wait_us, 0.9)) AS p90_us, round(quantile_cont(wait_us, 0.999)) AS p999_us FROM r GROUP BY user_key")
def wait_percentiles(spark, sf_dir):
    return fcfs_waits(spark, sf_dir).groupBy("user_key").agg(*(F.round(F.percentile("wait_us", F.lit(p))).alias(n) for p, n in ((0.5, "p50_us"), (0.9, "p90_us"), (0.999, "p999_us"))))


@query("count_distribution", f"WITH RECURSIVE {_FCFS2} SELECT user_key, count(*) FILTER (wait_us > 0) AS positive, count(*) FILTER (wait_us > 0) / count(*) AS share, max(wait_us) AS most FROM r GROUP BY user_key")
def count_distribution(spark, sf_dir):
    return fcfs_waits(spark, sf_dir).groupBy("user_key").agg(F.count_if(F.col("wait_us") > 0).alias("positive"), (F.count_if(F.col("wait_us") > 0) / F.count("*")).alias("share"), F.max("wait_us").alias("most"))


@query("tail_share", "WITH r AS (SELECT l_suppkey, round(l_extendedprice * 100)::BIGINT AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(l_extendedprice * 100) DESC) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, sum(CASE WHEN i <= greatest(floor(n * 0.05::DOUBLE), 1) THEN v ELSE 0 END)::DOUBLE / sum(v)::DOUBLE AS tail_share FROM r GROUP BY l_suppkey")
def tail_share(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"))
    return metrics.tail_share(rows, ["l_suppkey"], "v", 0.05)


@query("dispersion", f"WITH {JOBS}, {_HOURLY} SELECT kind, round(var_samp(n) / avg(n), 6) AS dispersion FROM p GROUP BY kind")
def dispersion(spark, sf_dir):
    return hourly(spark, sf_dir).groupBy("kind").agg(F.round(metrics.dispersion(F.col("n")), 6).alias("dispersion"))


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").where("quality is not null")


_LABELLED = "l AS (SELECT n_chars, quality FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"


@query("auroc", f"WITH {_LABELLED}, g AS (SELECT n_chars, sum((quality = 1)::INT)::DOUBLE AS p, sum((quality = 0)::INT)::DOUBLE AS q FROM l GROUP BY n_chars), b AS (SELECT *, coalesce(sum(q) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g) SELECT round(sum(p * (b + 0.5 * q)) / (sum(p) * sum(q)), 9) AS auroc FROM b")
def auroc(spark, sf_dir):
    return metrics.auroc(labelled(spark, sf_dir), "n_chars", "quality").select(F.round("auroc", 9).alias("auroc"))


@query("average_precision", f"WITH {_LABELLED}, g AS (SELECT n_chars, sum((quality = 1)::INT)::DOUBLE AS p, count(*)::DOUBLE AS n FROM l GROUP BY n_chars), b AS (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY n_chars DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT round(sum(p * cp / cn) / sum(p), 9) AS average_precision FROM b")
def average_precision(spark, sf_dir):
    return metrics.average_precision(labelled(spark, sf_dir), "n_chars", "quality").select(F.round("average_precision", 9).alias("average_precision"))


@query("rmse", "SELECT round(sqrt(avg((ln(1 + l_quantity) - ln(1 + l_extendedprice / 1000)) ** 2)), 9) AS rmse FROM lineitem")
def rmse(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_extendedprice") / 1000)
    return metrics.rmse_log(rows, "l_quantity", "p").select(F.round("rmse", 9).alias("rmse"))


@query("spearman", "WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS a, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2 AS b FROM orders) SELECT round(corr(a, b), 9) AS spearman FROM r")
def spearman(spark, sf_dir):
    return metrics.spearman(table(spark, sf_dir, "orders").select("o_totalprice", "o_custkey"), "o_totalprice", "o_custkey").select(F.round("spearman", 9).alias("spearman"))


@query("pivot_types", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def pivot_types(spark, sf_dir):
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase"]).count()
    return wide.na.fill(0)


@query("margins", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def margins(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("cube_counts", "SELECT event_type, user_id % 3 AS third, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 3)")
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("third", F.col("user_id") % 3).cube("event_type", "third").agg(F.count("*").alias("n"))


@query("linear_fit", "WITH m AS (SELECT l_quantity AS x, median(l_extendedprice) AS y FROM lineitem GROUP BY l_quantity) SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 3) AS intercept FROM m")
def linear_fit(spark, sf_dir):
    medians = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.median("l_extendedprice").alias("y"))
    return medians.agg(F.round(F.regr_slope("y", "x"), 4).alias("slope"), F.round(F.regr_intercept("y", "x"), 3).alias("intercept"))


@query("icc", "WITH p AS (SELECT user_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY user_id), t AS (SELECT count(*) AS g, sum(n) AS big, sum(n * n) AS n2, sum(n * m) AS s, sum(n * m * m) AS s2, sum(n * v) AS w FROM p), q AS (SELECT (s2 - s * s / big) / (g - 1) AS b, w / (big - g) AS w, (big - n2 / big) / (g - 1) AS k FROM t) SELECT round((b - w) / (b + (k - 1) * w), 6) AS icc FROM q")
def icc(spark, sf_dir):
    return metrics.icc(table(spark, sf_dir, "events"), "user_id", "value").select(F.round("icc", 6).alias("icc"))


@query("peak_f1", f"WITH {JOBS}, {_HOURLY}, f AS (SELECT kind, n, lag(n) OVER (PARTITION BY kind ORDER BY hour) AS f FROM p), c AS (SELECT kind, quantile_cont(n, 0.9) AS cut FROM f GROUP BY kind), k AS (SELECT f.kind, count(*) FILTER (f > cut AND n > cut) AS hits, count(*) FILTER (f > cut) AS said, count(*) FILTER (n > cut) AS peaks FROM f JOIN c ON f.kind = c.kind GROUP BY f.kind) SELECT kind, hits, said, peaks, 2 * hits / (said + peaks) AS f1 FROM k")
def peak_f1(spark, sf_dir):
    rows = hourly(spark, sf_dir).withColumn("f", F.lag("n").over(Window.partitionBy("kind").orderBy("hour")))
    return metrics.peak_scores(rows, "kind", "n", "f", 0.9)


# ---------------------------------------------------------------- bootstrap
#: Blocks are weeks from the first one of the table on, taken in turn where there are more.
_BLOCKS = 6
_DRAWS = [(0, b, 1) for b in range(_BLOCKS)] + [(1, 0, 2), (1, 1, 0), (1, 2, 1), (1, 3, 3), (1, 4, 0), (1, 5, 1), (2, 0, 0), (2, 1, 4), (2, 2, 0), (2, 3, 1), (2, 4, 1), (2, 5, 2)]
_DRAWS_SQL = "d AS (SELECT * FROM (VALUES " + ", ".join(map(str, _DRAWS)) + ") v(resample, block, m))"


def in_blocks(rows: DataFrame) -> DataFrame:
    first = rows.agg(F.min("week").alias("_first"))
    return rows.crossJoin(F.broadcast(first)).withColumn("block", F.pmod(F.col("week") - F.col("_first"), F.lit(_BLOCKS))).drop("_first")  # one row


_BLOCKED = f"ab AS (SELECT *, (week - (SELECT min(week) FROM a)) % {_BLOCKS} AS blk FROM a)"


def draws(spark):
    return spark.createDataFrame(_DRAWS, "resample int, block long, m int")


def _tens_sql(name: str, seed: int) -> str:
    drawn = study.draws_of(10, 50, seed)
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join(f"({r}, {b}, {m})" for r, row in enumerate(drawn) for b, m in enumerate(row)) + ") v(resample, block, m))"


_RANKED = f"""WITH {JOBS}, {{draws}}, y AS (SELECT (user_key % 10)::BIGINT AS block, cost_us // 1000000 AS score, is_error AS y FROM j), x AS (SELECT resample, score, sum(m * y)::DOUBLE AS p, sum(m * (1 - y))::DOUBLE AS q FROM y JOIN d USING (block) GROUP BY ALL),
c AS (SELECT *, sum(q) OVER (PARTITION BY resample ORDER BY score) - q AS below, sum(p) OVER (PARTITION BY resample ORDER BY score DESC) AS above_p, sum(p + q) OVER (PARTITION BY resample ORDER BY score DESC) AS above FROM x)"""


@query("bootstrap_ranking", _RANKED.replace("{draws}", _tens_sql("d", 9)) + " SELECT resample::INTEGER AS resample, round(sum(p * (below + 0.5 * q)) / nullif(sum(p) * sum(q), 0), 9) AS auroc, round(sum(CASE WHEN above > 0 THEN p * above_p / above ELSE 0 END) / nullif(sum(p), 0), 9) AS average_precision FROM c GROUP BY resample")
def bootstrap_ranking(spark, sf_dir):
    """How well cost ranks errors, in samples of groups of users drawn with replacement."""
    rows = jobs(spark, sf_dir).select((F.col("user_key") % 10).alias("block"), F.floor(F.col("cost_us") / 1_000_000).alias("score"), "is_error")
    many = study.multiplicities(spark, range(10), 50, seed=9)
    out = metrics.resampled_ranking(rows, "block", "score", "is_error", many)
    return out.select("resample", F.round("auroc", 9).alias("auroc"), F.round("average_precision", 9).alias("average_precision"))


@query("curve_correlations", f"""WITH {JOBS}, c AS (SELECT user_key % 25 AS s, (arrival_us % 86400000000) // 3600000000 AS h, count(*) AS n FROM a GROUP BY ALL), e AS (SELECT s, h, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT s FROM c), (SELECT DISTINCT h FROM c)) LEFT JOIN c USING (s, h))
SELECT x.s AS a, y.s AS b, round(corr(x.n, y.n), 9) AS corr FROM e x JOIN e y ON x.h = y.h AND x.s < y.s GROUP BY ALL""")
def curve_correlations(spark, sf_dir):
    """How alike the daily curves of groups of users are, pair by pair."""
    hour = F.floor(F.pmod(F.col("arrival_us"), F.lit(clock.DAY)) / clock.HOUR).alias("h")
    curves = timed(spark, sf_dir).groupBy((F.col("user_key") % 25).alias("s"), hour).agg(F.count("*").alias("n"))
    return metrics.pairwise_corr(curves, "s", "h", "n", 3).withColumn("corr", F.round("corr", 9))


@query("bootstrap_mean", f"WITH {JOBS}, {_BLOCKED}, {_DRAWS_SQL} SELECT d.resample::INTEGER AS resample, kind, sum(m * work_us)::DOUBLE / sum(m)::DOUBLE AS mean FROM ab JOIN d ON ab.blk = d.block GROUP BY d.resample, kind")
def bootstrap_mean(spark, sf_dir):
    return study.resampled_mean(in_blocks(timed(spark, sf_dir)), "block", "work_us", ["kind"], draws(spark))


@query("bootstrap_p99", f"WITH {JOBS}, {_BLOCKED}, {_DRAWS_SQL}, x AS (SELECT d.resample, kind, work_us, unnest(range(m)) FROM ab JOIN d ON ab.blk = d.block WHERE m > 0) SELECT resample::INTEGER AS resample, kind, round(quantile_cont(work_us, 0.99), 3) AS quantile FROM x GROUP BY ALL")
def bootstrap_p99(spark, sf_dir):
    return study.resampled_quantile(in_blocks(timed(spark, sf_dir)), "block", "work_us", ["kind"], 0.99, draws(spark)).withColumn("quantile", F.round("quantile", 3))


@query("paired_diff", f"WITH {JOBS}, {_BLOCKED}, {_DRAWS_SQL}, m AS (SELECT d.resample, kind, sum(m * work_us)::DOUBLE / sum(m)::DOUBLE AS mean FROM ab JOIN d ON ab.blk = d.block GROUP BY ALL) SELECT x.resample::INTEGER AS resample, x.mean - y.mean AS difference FROM m x JOIN m y ON x.resample = y.resample AND x.kind = 'click' AND y.kind = 'error'")
def paired_diff(spark, sf_dir):
    replicates = study.resampled_mean(in_blocks(timed(spark, sf_dir)), "block", "work_us", ["kind"], draws(spark))
    return study.paired(replicates, [], "kind", "click", "error", "mean")


def _many_sql(resamples: int, seed: int) -> str:
    """The blocks of weeks and the draws of study.multiplicities over them."""
    drawn = study.draws_of(_BLOCKS, resamples, seed)
    return f"{_BLOCKED}, " + "d AS (SELECT * FROM (VALUES " + ", ".join(f"({r}, {w}, {m})" for r, row in enumerate(drawn) for w, m in enumerate(row)) + ") v(resample, block, m))"


_MEANS_SQL = "m AS (SELECT d.resample, kind, sum(m * work_us)::DOUBLE / nullif(sum(m), 0)::DOUBLE AS mean FROM ab JOIN d ON ab.blk = d.block GROUP BY ALL)"


@query("bootstrap_interval", f"WITH {JOBS}, {_many_sql(200, 7)}, {_MEANS_SQL} SELECT kind, round(max(mean) FILTER (resample = 0), 3) AS estimate, round(quantile_cont(mean, 0.025) FILTER (resample > 0), 3) AS low, round(quantile_cont(mean, 0.975) FILTER (resample > 0), 3) AS high FROM m GROUP BY kind")
def bootstrap_interval(spark, sf_dir):
    rows = timed(spark, sf_dir)
    many = study.multiplicities(spark, range(_BLOCKS), 200, seed=7)
    out = study.interval(study.resampled_mean(in_blocks(rows), "block", "work_us", ["kind"], many), ["kind"], "mean")
    return out.select("kind", *(F.round(c, 3).alias(c) for c in ("estimate", "low", "high")))


@query("multiway_bootstrap", f"WITH {JOBS}, {_tens_sql('du', 1)}, {_tens_sql('di', 2)}, s AS (SELECT user_key % 10 AS u, item_key % 10 AS i, sum(work_us) AS s, count(*) AS n FROM t GROUP BY ALL) SELECT du.resample::INTEGER AS resample, sum(du.m * di.m * s)::DOUBLE / sum(du.m * di.m * n)::DOUBLE AS mean FROM s JOIN du ON du.block = u JOIN di ON di.block = i AND di.resample = du.resample GROUP BY du.resample")
def multiway_bootstrap(spark, sf_dir):
    """Users and items drawn apart: a row counts as often as the product says."""
    rows = timed(spark, sf_dir).select((F.col("user_key") % 10).alias("u"), (F.col("item_key") % 10).cast("long").alias("i"), "work_us")
    users = study.multiplicities(spark, range(10), 50, seed=1).withColumnsRenamed({"block": "u", "m": "mu"})
    items = study.multiplicities(spark, range(10), 50, seed=2).withColumnsRenamed({"block": "i", "m": "mi"})
    sums = rows.groupBy("u", "i").agg(F.sum("work_us").alias("s"), F.count("*").alias("n"))
    both = sums.join(F.broadcast(users), "u").join(F.broadcast(items), ["i", "resample"])
    return both.groupBy("resample").agg(F.try_divide(F.sum(F.col("mu") * F.col("mi") * F.col("s")), F.sum(F.col("mu") * F.col("mi") * F.col("n"))).alias("mean"))


@query("cluster_bootstrap", f"""WITH RECURSIVE {JOBS}, {_DRAWS_SQL}, hb AS (SELECT *, (week - (SELECT min(week) FROM h)) % {_BLOCKS} AS blk FROM h), c AS (SELECT d.resample, h.user_key, h.job_id * 100 + n AS job_id, h.arrival_us + ({_bits("d.resample", "h.blk", "n")} % 4) * 604800000000 AS arrival_us, h.big_us, h.cost_us FROM hb h JOIN d ON d.block = h.blk, range(0, 5) z(n) WHERE n < d.m),
ranked AS (SELECT *, row_number() OVER (PARTITION BY resample, user_key ORDER BY arrival_us, job_id) - 1 AS i FROM c),
r0 AS (SELECT resample, user_key, list(struct_pack(i := i, a := arrival_us, w := big_us, sc := cost_us / 1e6::DOUBLE + (cost_us % 97)::DOUBLE) ORDER BY i) AS todo FROM ranked GROUP BY ALL),
r AS (SELECT resample, user_key, todo, -9000000000000000000::BIGINT AS f1, -9000000000000000000::BIGINT AS f2, NULL::BIGINT AS wait_us FROM r0 UNION ALL
  SELECT resample, user_key, list_filter(todo, lambda x: x.i <> pick.i), least(f2, t + pick.w), greatest(f2, t + pick.w), t - pick.a
  FROM (SELECT *, list_sort(list_transform(list_filter(todo, lambda x: x.a <= t), lambda x: struct_pack(k := {_SCORED}, x := x)))[1].x AS pick FROM (SELECT *, greatest(f1, todo[1].a) AS t FROM r WHERE len(todo) > 0)))
SELECT resample::INTEGER AS resample, 'SPJF' AS policy, round(quantile_cont(wait_us, 0.99), 2) AS quantile FROM r WHERE wait_us IS NOT NULL GROUP BY resample""")
def cluster_bootstrap(spark, sf_dir):
    """Weeks are drawn, their jobs overlaid anew, and every overlay is replayed."""
    return study.cluster_bootstrap(in_blocks(heavy_load(spark, sf_dir)).withColumnRenamed("block", "turn"), "turn", draws(spark), ["user_key"], SERVERS, [_SPJF], 0.99, weeks=4).withColumn("quantile", F.round("quantile", 2))


# ---------------------------------------------------------------- search
@query("grid_points", "SELECT b0_s, gam_s, eta, promise_s, CASE WHEN b0_s >= promise_s THEN 1 ELSE 0 END AS full_ FROM (SELECT unnest([60.0, 300.0, 600.0]::DOUBLE[]) AS b0_s), (SELECT unnest([0.0, 5.0]::DOUBLE[]) AS gam_s), (SELECT unnest([0.0, 0.1]::DOUBLE[]) AS eta), (SELECT unnest([300.0, 600.0]::DOUBLE[]) AS promise_s)")
def grid_points(spark, sf_dir):
    points = study.grid(spark, [60, 300, 600], [0, 5], [0, 0.1], [300, 600])
    return points.select("b0_s", "gam_s", "eta", "promise_s", F.col("schedule_key").startswith("full").cast("int").alias("full_"))


def cells(spark, sf_dir):
    """One cell per (supplier, flag): a gap and a harm from prices."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy((F.col("l_suppkey") % 12).alias("config"), (F.col("l_suppkey") % 3).alias("family"), "l_returnflag").agg(
        F.round(F.avg("l_discount"), 6).alias("gap"), F.round(F.max("l_quantity") - F.min("l_tax") * 100, 4).alias("harm")
    )


_CELLS = "c AS (SELECT l_suppkey % 12 AS config, l_suppkey % 3 AS family, l_returnflag, round(avg(l_discount), 6) AS gap, round(max(l_quantity) - min(l_tax) * 100, 4) AS harm FROM lineitem GROUP BY ALL), w AS (SELECT config, family, min(gap) AS worst_gap, max(harm) AS worst_harm, count(*) AS cells FROM c GROUP BY ALL)"


@query("choose_worst_cell", f"WITH {_CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY worst_gap DESC, worst_harm, config) AS i FROM w WHERE worst_harm <= 50) SELECT * EXCLUDE (i) FROM r WHERE i = 1")
def choose_worst_cell(spark, sf_dir):
    return study.choose(study.worst_cells(cells(spark, sf_dir), ["config", "family"]), ["family"], 50.0, [F.col("config")])


@query("frontier", f"WITH {_CELLS}, b AS (SELECT *, max(worst_gap) OVER (ORDER BY worst_harm, worst_gap DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM w) SELECT config, family, worst_gap, worst_harm, cells FROM b WHERE b IS NULL OR worst_gap > b")
def frontier(spark, sf_dir):
    return study.frontier(study.worst_cells(cells(spark, sf_dir), ["config", "family"]), [])


@query("smallest_pool", f"""WITH RECURSIVE {JOBS}, o AS (SELECT user_key, job_id, arrival_us, big_us, row_number() OVER (PARTITION BY user_key ORDER BY arrival_us, job_id) AS i FROM h),
r AS (SELECT user_key, k, 0::BIGINT AS i, NULL::BIGINT AS wait_us, list_transform(range(k), lambda x: -9000000000000000000::BIGINT) AS free FROM (SELECT DISTINCT user_key FROM h), (SELECT unnest(range(1, 33)) AS k) UNION ALL
  SELECT r.user_key, r.k, o.i, greatest(r.free[1], o.arrival_us) - o.arrival_us, list_sort(list_append(r.free[2:], greatest(r.free[1], o.arrival_us) + o.big_us)) FROM r JOIN o ON o.user_key = r.user_key AND o.i = r.i + 1),
q AS (SELECT user_key, k, quantile_cont(wait_us, 0.99) AS p FROM r WHERE i > 0 GROUP BY ALL) SELECT user_key, min(k) FILTER (p <= 3600000000)::INTEGER AS servers FROM q GROUP BY user_key""")
def smallest_pool(spark, sf_dir):
    """The least number of servers under which each user's p99 wait is within an hour."""
    return study.smallest_pools(checkpointed(heavy_load(spark, sf_dir)), ["user_key"], 0.99, clock.HOUR)


@query("expand_duplicates", "WITH p AS (SELECT b.x AS b0, p.x AS promise, CASE WHEN b.x >= p.x THEN 'full|' || p.x ELSE b.x || '|' || p.x END AS k FROM (SELECT unnest([100, 200, 300, 400]) AS x) b, (SELECT unnest([200, 300]) AS x) p), u AS (SELECT k, min(b0) AS b FROM p GROUP BY k) SELECT p.b0, p.promise, u.b * 2 AS result FROM p JOIN u USING (k)")
def expand_duplicates(spark, sf_dir):
    b = spark.createDataFrame([(100,), (200,), (300,), (400,)], "b0 int")
    points = b.crossJoin(spark.createDataFrame([(200,), (300,)], "promise int"))
    points = points.withColumn("k", F.when(F.col("b0") >= F.col("promise"), F.concat_ws("|", F.lit("full"), F.col("promise").cast("string"))).otherwise(F.concat_ws("|", F.col("b0").cast("string"), F.col("promise").cast("string"))))
    solved = points.groupBy("k").agg((F.min("b0") * 2).alias("result"))
    return points.join(solved, "k").select("b0", "promise", "result")


# ---------------------------------------------------------------- visibility
_DONE = f"""{_FCFS2}, v AS (SELECT h.job_id, h.user_key, h.item_key, h.arrival_us, h.arrival_us + h.work_us AS available_us, h.arrival_us + r.wait_us + h.big_us AS done_us FROM h JOIN r USING (job_id))"""


def with_done(spark, sf_dir):
    rows = heavy_load(spark, sf_dir)
    source = clock.arrival_and_availability(jobs(spark, sf_dir), result_lag=0).select("job_id", "available_us")
    waits = replay.fcfs(rows, ["user_key"], SERVERS).select("job_id", "wait_us")
    return rows.join(source, "job_id").join(waits, "job_id").withColumn("done_us", F.col("arrival_us") + F.col("wait_us") + F.col("work_us"))


@query("premature_counts", f"""WITH RECURSIVE {_DONE}, n AS (SELECT q.job_id, count(*) FILTER (x.available_us <= q.arrival_us) - count(*) FILTER (x.done_us <= q.arrival_us) AS premature FROM v q JOIN v x ON q.user_key = x.user_key GROUP BY q.job_id) SELECT * FROM n""")
def premature_counts(spark, sf_dir):
    return study.premature_counts(with_done(spark, sf_dir), [["user_key"]])


@query("premature_pairs", f"""WITH RECURSIVE {_DONE} SELECT q.job_id, count(*) FILTER (x.available_us <= q.arrival_us) - count(*) FILTER (x.done_us <= q.arrival_us) AS premature FROM v q JOIN v x ON q.user_key = x.user_key OR q.item_key = x.item_key GROUP BY q.job_id""")
def premature_pairs(spark, sf_dir):
    return study.premature_counts(with_done(spark, sf_dir), [["user_key"], ["item_key"], ["user_key", "item_key"]])


@query("lag_certificate", f"WITH RECURSIVE {_FCFS2} SELECT user_key, count(*) AS jobs, count(*) FILTER (wait_us > 3600000000) AS violations, avg((wait_us > 3600000000)::INT::DOUBLE) AS share, max(wait_us - 3600000000) FILTER (wait_us > 3600000000) AS worst_us FROM r GROUP BY user_key")
def lag_certificate(spark, sf_dir):
    return study.lag_certificate(fcfs_waits(spark, sf_dir), ["user_key"], clock.HOUR)


@query("signatures", f"WITH {JOBS}, s AS (SELECT user_key, available_us AS at_us, 0 AS k, job_id, {_bits('job_id')} AS v FROM t UNION ALL SELECT user_key, arrival_us, 1, job_id, 0 FROM t), w AS (SELECT job_id, k, sum(v) OVER (PARTITION BY user_key ORDER BY at_us, k, job_id ROWS UNBOUNDED PRECEDING) AS x FROM s) SELECT job_id, x::HUGEINT::VARCHAR AS signature FROM w WHERE k = 1")
def signatures(spark, sf_dir):
    return study.signatures(timed(spark, sf_dir), ["user_key"]).select("job_id", F.col("signature").cast("string").alias("signature"))


# ---------------------------------------------------------------- joins, sets and order over the star tables
@query("star_join", "SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def star_join(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")), 2).cast("double").alias("total"))


@query("match_rate", "SELECT count(*) AS n, count(l.doc_id) AS matched, count(l.doc_id) / count(*) AS rate FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def match_rate(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("hit")).distinct()
    rows = table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left")
    return rows.agg(F.count("*").alias("n"), F.count("hit").alias("matched"), (F.count("hit") / F.count("*")).alias("rate"))


@query("semi_anti", "SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without_orders")
def semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return c.join(o, "c_custkey", "left_semi").agg(F.count("*").alias("with_orders")).crossJoin(c.join(o, "c_custkey", "left_anti").agg(F.count("*").alias("without_orders")))  # one row each


@query("set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'except_all', count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer)")
def set_operations(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey")
    parts = {"union": o.union(c).distinct(), "intersect": o.intersect(c), "except": c.subtract(o), "except_all": o.exceptAll(c)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("frame_compare", "WITH a AS (SELECT o_orderkey, o_totalprice AS p, o_orderstatus AS s FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p, o_orderstatus AS s FROM orders WHERE o_orderkey % 11 <> 0), f AS (SELECT a.o_orderkey AS ka, b.o_orderkey AS kb, a.p AS ap, b.p AS bp, a.s AS sa, b.s AS sb FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) SELECT 'p' AS \"column\", count(*) FILTER (ka IS NOT NULL AND kb IS NOT NULL AND ap IS DISTINCT FROM bp) AS different, count(*) FILTER (kb IS NULL) AS only_a, count(*) FILTER (ka IS NULL) AS only_b FROM f UNION ALL SELECT 's', count(*) FILTER (ka IS NOT NULL AND kb IS NOT NULL AND sa IS DISTINCT FROM sb), count(*) FILTER (kb IS NULL), count(*) FILTER (ka IS NULL) FROM f")
def frame_compare(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("s"))
    other = o.where("o_orderkey % 11 <> 0").withColumn("p", F.when(F.col("o_orderkey") % 5 == 0, F.col("p") + 1).otherwise(F.col("p")))
    return study.compare_tables(o.where("o_orderkey % 7 <> 0"), other, ["o_orderkey"], ["p", "s"])


@query("dedupe_first", "SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem) WHERE i = 1")
def dedupe_first(spark, sf_dir):
    order = Window.partitionBy("l_suppkey", "l_partkey").orderBy("l_orderkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    return rows.withColumn("i", F.row_number().over(order)).where("i = 1").drop("i")


@query("top_k", "SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 8")
def top_k(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "p_brand").limit(8)


@query("distinct_counts", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT date_trunc('day', ts)) AS days FROM events GROUP BY event_type")
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.date_trunc("day", "ts")).alias("days"))


@query("active_entities", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(DISTINCT date_trunc('day', ts)) >= 2")
def active_entities(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("d"))
    return per.where("d >= 2").select("user_id", "n")


@query("decomposition", f"WITH RECURSIVE {_FCFS2}, g AS (SELECT h.week % 2 AS part, h.kind, avg(wait_us) AS m, count(*) AS n FROM r JOIN h USING (job_id) GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY part) AS share FROM g) SELECT x.kind, round((x.share - y.share) * y.m, 3) AS mix, round(x.share * (x.m - y.m), 3) AS level FROM s x JOIN s y ON x.kind = y.kind AND x.part = 1 AND y.part = 0")
def decomposition(spark, sf_dir):
    g = fcfs_waits(spark, sf_dir).groupBy((F.col("week") % 2).alias("part"), "kind").agg(F.avg("wait_us").alias("m"), F.count("*").alias("n"))
    s = g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("part")))
    x, y = s.where("part = 1").drop("part", "n"), s.where("part = 0").select("kind", F.col("m").alias("m0"), F.col("share").alias("s0"))
    both = x.join(y, "kind")
    return both.select("kind", F.round((F.col("share") - F.col("s0")) * F.col("m0"), 3).alias("mix"), F.round(F.col("share") * (F.col("m") - F.col("m0")), 3).alias("level"))


@query("adversarial_scores", f"WITH {JOBS}, r AS (SELECT job_id, cost_us, row_number() OVER (ORDER BY cost_us DESC, job_id) AS i, count(*) OVER () AS n FROM j) SELECT job_id, -cost_us AS negated, CASE WHEN i <= greatest(floor(n * 0.01::DOUBLE), 1) THEN 0 ELSE cost_us END AS masked FROM r")
def adversarial_scores(spark, sf_dir):
    marked = study.longest_share(jobs(spark, sf_dir), "cost_us", "job_id", 0.01)
    return marked.select("job_id", (-F.col("cost_us")).alias("negated"), F.when(F.col("longest"), F.lit(0)).otherwise(F.col("cost_us")).cast("long").alias("masked"))


@query("pushdown_scan", "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value > 10")
def pushdown_scan(spark, sf_dir):
    return table(spark, sf_dir, "events").where((F.col("event_type") == "purchase") & (F.col("value") > 10)).select("event_id", "value")


# ---------------------------------------------------------------- prediction
def _terms(rows):
    """The weeks of a table, which are few."""
    return [r.week for r in rows.select("week").distinct().orderBy("week").collect()]


@query("rolling_origin_mask", f"WITH {JOBS}, b AS (SELECT week AS target, min(arrival_us) AS s FROM t GROUP BY week) SELECT target, job_id FROM t, b WHERE week < target AND available_us < s")
def rolling_origin_mask(spark, sf_dir):
    """For each week the jobs that its model may learn from."""
    from ..operators import predict

    return predict.training_pairs(timed(spark, sf_dir), "week").select("target", "job_id")


def checkpointed(rows: DataFrame) -> DataFrame:
    """`rows` written to the session's checkpoint folder, so that each week's model doesn't build them again."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return rows.checkpoint()


def _featured(spark, sf_dir, eligible=None):
    rows = timed(spark, sf_dir)
    stream = history.merged_stream(rows, ["user_key", "item_key", "work_us", "is_error"], eligible).where("kind <> 2")  # registrations tell no result
    item = history.keyed_history(stream, ["item_key"], "item")
    user = history.keyed_history(stream, ["user_key"], "user")
    return rows.join(item, "job_id").join(user, "job_id")


_FEATURES = ("item_n", "item_mean_us", "item_err", "user_n", "user_mean_us", "user_err")


_SPEC = {"rounds": 10, "depth": 3, "bins": 16}
_FEATURES_SQL = f"""{JOBS[: JOBS.index(",\nh AS")]},
s AS (SELECT available_us AS at_us, 0 AS k, * FROM t UNION ALL SELECT arrival_us, 1, * FROM t),
hist AS (SELECT *, {", ".join(f"count(*) FILTER (k = 0) OVER {w} AS {w}n, coalesce(sum(work_us) FILTER (k = 0) OVER {w}, 0)::DOUBLE AS {w}w, coalesce(sum(is_error) FILTER (k = 0) OVER {w}, 0)::DOUBLE AS {w}e" for w in ("wi", "wu"))}
  FROM s WINDOW {", ".join(f"{w} AS (PARTITION BY {key} ORDER BY at_us, k, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for w, key in (("wi", "item_key"), ("wu", "user_key")))}),
f AS (SELECT job_id, week, user_key, arrival_us, available_us, work_us, work_us / 1e6::DOUBLE AS label, {", ".join(f"{w}n::DOUBLE AS x{3 * i + 1}, CASE WHEN {w}n > 0 THEN {w}w / {w}n ELSE -1 END AS x{3 * i + 2}, CASE WHEN {w}n > 0 THEN {w}e / {w}n ELSE -1 END AS x{3 * i + 3}" for i, w in enumerate(("wi", "wu")))}
  FROM hist WHERE k = 1)"""


def _boosted_sql(pairs: str, loss: str, features: int = 6, rounds: int = 10, depth: int = 3, bins: int = 16, rate: float = 0.1, shrink: float = 1.0, least_rows: int = 20, least_gain: float = 1e-6) -> str:
    """SQL that grows the same trees: `pairs` has model, job_id, y (as learned), train and x1.. ; ends with a table scored (model, job_id, raw)."""
    start = {"tweedie": "ln(greatest(avg(y), 1e-6))", "log": "avg(y)", "logistic": "ln(least(greatest(avg(y), 1e-6), 1 - 1e-6) / (1 - least(greatest(avg(y), 1e-6), 1 - 1e-6)))"}[loss]
    g, h = {
        "tweedie": ("exp(0.5::DOUBLE * raw) - y * exp(-0.5::DOUBLE * raw)", "0.5::DOUBLE * exp(0.5::DOUBLE * raw) + 0.5::DOUBLE * y * exp(-0.5::DOUBLE * raw)"),
        "log": ("raw - y", "1.0::DOUBLE"),
        "logistic": ("1.0::DOUBLE / (1.0::DOUBLE + exp(-raw)) - y", "exp(-raw) / ((1.0::DOUBLE + exp(-raw)) * (1.0::DOUBLE + exp(-raw)))"),
    }[loss]
    at = ", ".join(f"{i / bins}::DOUBLE" for i in range(1, bins))
    names = range(1, features + 1)
    out = [
        f"pr AS MATERIALIZED ({pairs})",
        f"cu AS MATERIALIZED (SELECT model, round({start}, 9) AS start, {', '.join(f'list_distinct(quantile_disc(x{i}, [{at}])) AS c{i}' for i in names)} FROM pr WHERE train GROUP BY model)",
        f"r0 AS MATERIALIZED (SELECT model, job_id, y, train, start AS raw, [{', '.join(f'1 + len(list_filter(c{i}, lambda z: z < x{i}))' for i in names)}] AS x FROM pr JOIN cu USING (model))",
    ]
    unit = "1048576::DOUBLE"
    part = lambda a, b: f"({a}) * ({a}) / (({b}) + {shrink}::DOUBLE)"
    for r in range(rounds):
        out.append(f"n{r}_0 AS (SELECT *, 1 AS node, floor(({g}) * {unit} + 0.5)::BIGINT AS g, floor(({h}) * {unit} + 0.5)::BIGINT AS h FROM r{r})")
        for d in range(depth):
            n = f"n{r}_{d}"
            left, right = ("lg", "lh"), ("ag - lg", "ah - lh")
            u = lambda c: f"({c})::DOUBLE / {unit}"
            both = lambda pair: [u(c) if "-" not in c else " - ".join(u(z) for z in c.split(" - ")) for c in pair]
            gain = f"{part(*both(left))} + {part(*both(right))} - {part(*both(('ag', 'ah')))}"
            out += [
                f"h{r}_{d} AS (SELECT model, node, f, x[f] AS bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (SELECT *, unnest(range(1, {features + 1})) AS f FROM {n} WHERE train) GROUP BY ALL)",
                f"w{r}_{d} AS (SELECT model, node, f, bin, sum(g) OVER o AS lg, sum(h) OVER o AS lh, sum(n) OVER o AS ln, sum(g) OVER a AS ag, sum(h) OVER a AS ah, sum(n) OVER a AS an FROM h{r}_{d} WINDOW a AS (PARTITION BY model, node, f), o AS (PARTITION BY model, node, f ORDER BY bin))",
                f"k{r}_{d} AS MATERIALIZED (SELECT model, node, f, bin FROM (SELECT *, {gain} AS gain FROM w{r}_{d}) WHERE ln >= {least_rows} AND an - ln >= {least_rows} AND gain > {least_gain} QUALIFY row_number() OVER (PARTITION BY model, node ORDER BY gain DESC, f, bin) = 1)",
                f"n{r}_{d + 1} AS MATERIALIZED (SELECT a.* REPLACE (2 * a.node + CASE WHEN a.x[k.f] > k.bin THEN 1 ELSE 0 END AS node) FROM {n} a LEFT JOIN k{r}_{d} k ON a.model = k.model AND a.node = k.node)",
            ]
        n = f"n{r}_{depth}"
        out += [
            f"v{r} AS (SELECT model, node, -{rate}::DOUBLE * (sum(g)::DOUBLE / {unit}) / (sum(h)::DOUBLE / {unit} + {shrink}::DOUBLE) AS v FROM {n} WHERE train GROUP BY ALL)",
            f"r{r + 1} AS MATERIALIZED (SELECT a.model, job_id, y, train, raw + coalesce(v, 0) AS raw, x FROM {n} a LEFT JOIN v{r} USING (model, node))",
        ]
    return ",\n".join([*out, f"scored AS (SELECT model, job_id, raw FROM r{rounds} WHERE NOT train)"])


def _forward_pairs(label: str, extra: str = "") -> str:
    xs = ", ".join(f"x{i}" for i in range(1, 7))
    return f"""SELECT target AS model, job_id, {label} AS y, true AS train, {xs} FROM f JOIN (SELECT week AS target, min(arrival_us) AS s FROM f GROUP BY week) ON week < target AND available_us < s
  UNION ALL SELECT week, job_id, 0, false, {xs} FROM f"""


def _forward(spark, sf_dir, loss):
    from ..operators import boosting, predict

    rows = checkpointed(_featured(spark, sf_dir).withColumn("label", F.col("work_us") / F.lit(1e6)))
    model = predict.rolling_models(rows, "week", _FEATURES, "label", boosting.Boosting(loss=loss, **_SPEC))
    return predict.forward_scores(model, rows, "week").select("job_id", F.round("prediction", 6).alias("prediction"))


@query("tweedie_scores", f"WITH {_FEATURES_SQL}, {_boosted_sql(_forward_pairs('label'), 'tweedie')} SELECT job_id, round(exp(raw), 6) AS prediction FROM scored")
def tweedie_scores(spark, sf_dir):
    """Work as each week's model sees it, by boosted trees with a Tweedie loss; SQL grows the trees once more."""
    return _forward(spark, sf_dir, "tweedie")


@query("log_scores", f"WITH {_FEATURES_SQL}, {_boosted_sql(_forward_pairs('ln(1 + label)'), 'log')} SELECT job_id, round(exp(raw) - 1, 6) AS prediction FROM scored")
def log_scores(spark, sf_dir):
    return _forward(spark, sf_dir, "log")


_WITHHELD_SQL = _FEATURES_SQL[_FEATURES_SQL.index("s AS (SELECT available_us") :].replace("* FROM t UNION", "* FROM t WHERE job_id % 5 <> 0 UNION").replace("s AS (", "s2 AS (", 1).replace("hist AS", "hist2 AS").replace("FROM s WINDOW", "FROM s2 WINDOW").replace("f AS (SELECT job_id", "f2 AS (SELECT job_id").replace("FROM hist WHERE", "FROM hist2 WHERE")


@query("frozen_scores", f"WITH {_FEATURES_SQL}, {_WITHHELD_SQL}, {_boosted_sql(_forward_pairs('label').rsplit('FROM f', 1)[0] + 'FROM f2', 'tweedie', rounds=5)} SELECT job_id, round(exp(raw), 6) AS prediction FROM scored")
def frozen_scores(spark, sf_dir):
    """Each week's saved model over histories from which a fifth of the results is withheld; nothing is fitted again."""
    from ..operators import boosting, predict

    spec = boosting.Boosting(loss="tweedie", **(_SPEC | {"rounds": 5}))
    rows = checkpointed(_featured(spark, sf_dir).withColumn("label", F.col("work_us") / F.lit(1e6)))
    path = f"{shared_folder(spark)}/frozen-{uuid.uuid4().hex}"
    predict.rolling_models(rows, "week", _FEATURES, "label", spec).save(path)
    model = boosting.Model.load(spark, path, spec, ["target"], _FEATURES)
    changed = _featured(spark, sf_dir, F.col("job_id") % 5 != 0)
    return predict.forward_scores(model, changed, "week").select("job_id", F.round("prediction", 6).alias("prediction"))


_SEEDS, _DRAWN = (1, 2, 3), 0.7
_HEAVY_PAIRS = f"""SELECT q.target * 10 + seed AS model, job_id, (work_us > heavy_us)::INTEGER::DOUBLE AS y, true AS train, x1, x2, x3, x4, x5, x6 FROM q JOIN cut USING (target), (SELECT unnest([1, 2, 3]) AS seed) z
    WHERE {_bits('seed', 'job_id')} * 2.0::DOUBLE ^ -52 < {_DRAWN}::DOUBLE
  UNION ALL SELECT week * 10 + seed, job_id, 0, false, x1, x2, x3, x4, x5, x6 FROM w, (SELECT unnest([1, 2, 3]) AS seed) z"""


@query("heavy_by_history", f"""WITH {_FEATURES_SQL}, w AS (SELECT f.* FROM f JOIN j USING (job_id) WHERE NOT is_result_only), b AS (SELECT week AS target, min(arrival_us) AS s FROM w GROUP BY week),
q AS (SELECT target, w.* FROM w JOIN b ON week < target AND available_us < s), cut AS (SELECT target, quantile_cont(work_us, 0.95) AS heavy_us FROM q GROUP BY target),
{_boosted_sql(_HEAVY_PAIRS, 'logistic', rounds=4)}, p AS (SELECT job_id, round(avg(1 / (1 + exp(-raw))), 9) AS p FROM scored GROUP BY job_id),
e AS (SELECT x4 < 20 AS cold, p, (work_us > heavy_us)::INTEGER AS y FROM w JOIN p USING (job_id) JOIN cut ON target = week), g AS (SELECT cold, p, sum(y)::DOUBLE AS y, sum(1 - y)::DOUBLE AS n FROM e GROUP BY ALL),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY cold ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
SELECT cold, sum(y) AS positives, sum(n) AS negatives, round(sum(y * (b + 0.5 * n)) / (sum(y) * sum(n)), 9) AS auroc FROM r GROUP BY cold""")
def heavy_by_history(spark, sf_dir):
    """How well heavy jobs are told by an ensemble over seeds, for users with little history and others; what is heavy follows from each week's training rows."""
    from ..operators import boosting, predict

    rows = checkpointed(_featured(spark, sf_dir).where(~F.col("is_result_only")))
    pairs = predict.training_pairs(rows, "week")
    cuts = predict.cutoffs(pairs, ["target"], "work_us", heavy_us=0.95)
    marked = lambda df: df.join(cuts, "target").withColumn("label", (F.col("work_us") > F.col("heavy_us")).cast("int"))
    spec = boosting.Boosting(loss="logistic", **(_SPEC | {"rounds": 4}))
    model = predict.ensemble(marked(pairs), ["target"], _FEATURES, "label", _SEEDS, _DRAWN, "job_id", spec)
    target = marked(rows.withColumn("target", F.col("week")))
    said = predict.averaged(model, target, _SEEDS, "job_id").withColumn("prediction", F.round("prediction", 9))
    both = target.join(said, "job_id").withColumn("cold", F.col("user_n") < 20)
    return metrics.auroc_by(both, ["cold"], "prediction", "label").withColumn("auroc", F.round("auroc", 9))


@query("superposition_forecast", f"WITH {JOBS}, p AS (SELECT kind, (arrival_us % 86400000000) // 3600000000 AS phase, count(*) AS n FROM a GROUP BY ALL), l AS (SELECT kind, avg(n) AS level FROM p GROUP BY kind), s AS (SELECT phase, sum(n) / sum(level) AS shape FROM p JOIN l ON p.kind = l.kind GROUP BY phase) SELECT p.kind, p.phase, round(level * shape, 6) AS forecast FROM p JOIN l ON p.kind = l.kind JOIN s ON p.phase = s.phase")
def superposition_forecast(spark, sf_dir):
    from ..operators import predict

    phase = F.floor(F.pmod(F.col("arrival_us"), F.lit(clock.DAY)) / clock.HOUR).alias("phase")
    panel = timed(spark, sf_dir).groupBy("kind", phase).agg(F.count("*").alias("n"))
    return predict.superposition_forecast(panel, "kind", "phase", "n").withColumn("forecast", F.round("forecast", 6))


# ---------------------------------------------------------------- streams
def _stream(spark, sf_dir):
    from ..streaming import live

    schema = table(spark, sf_dir, "events").schema
    return live.event_stream(spark, f"{sf_dir}/events.parquet*", schema)


def _drained(spark, stream, mode):
    from ..streaming import live

    return live.drained(stream, f"{shared_folder(spark)}/live_{uuid.uuid4().hex}", mode)


@query("live_hours", "SELECT time_bucket(INTERVAL '1 hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def live_hours(spark, sf_dir):
    from ..streaming import live

    rows = _drained(spark, live.tumbling(_stream(spark, sf_dir)), "complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("live_sliding", "SELECT (time_bucket(INTERVAL '1 hour', ts) - to_hours(i::INTEGER))::TIMESTAMP AS start, event_type, count(*) AS n FROM events, range(0, 24) r(i) GROUP BY ALL")
def live_sliding(spark, sf_dir):
    from ..streaming import live

    rows = _drained(spark, live.sliding(_stream(spark, sf_dir)), "complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("live_sessions", "WITH m AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), g AS (SELECT *, sum(CASE WHEN b IS NULL OR ts >= b + INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m) SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM g GROUP BY user_id, s")
def live_sessions(spark, sf_dir):
    from ..streaming import live

    rows = _drained(spark, live.live_sessions(_stream(spark, sf_dir)), "complete")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("live_waits", f"WITH RECURSIVE {_FCFS2} SELECT job_id AS event_id, wait_us FROM r")
def live_waits(spark, sf_dir):
    from ..streaming import live

    return _drained(spark, live.live_waits(_stream(spark, sf_dir), SERVERS), "append").select("event_id", "wait_us")


@query("live_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def live_first_seen(spark, sf_dir):
    """The kinds of events of each user, each reported once by the stream."""
    from ..streaming import live

    return _drained(spark, live.deduplicated(_stream(spark, sf_dir), ["user_id", "event_type"]), "append").select("user_id", "event_type")


@query("live_history", f"""WITH {STREAM}, w AS (SELECT job_id, k, count(*) FILTER (k = 0) OVER v AS n, coalesce(sum(work_us) FILTER (k = 0) OVER v, 0)::BIGINT AS work_us, coalesce(sum(is_error) FILTER (k = 0) OVER v, 0)::BIGINT AS errors
  FROM s WINDOW v AS (PARTITION BY user_key ORDER BY at_us, k, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT job_id, n, work_us, errors FROM w WHERE k = 1""")
def live_history(spark, sf_dir):
    """Histories of users off a stream whose rows come up to 90 minutes late, in files of some days."""
    from ..streaming import live

    rows = timed(spark, sf_dir).select("user_key", "job_id", "arrival_us", "available_us", "work_us", "is_error")
    rows = rows.withColumn("ts", F.timestamp_micros("arrival_us")).withColumn("part", F.floor((F.col("arrival_us") + clock.jitter("job_id") * F.lit(1.5 * clock.HOUR)) / (5 * clock.DAY)))
    # a last row of another key lets the watermark pass all others
    end = rows.agg(F.max("arrival_us").alias("m")).where("m is not null").select(
        F.lit(-1).cast("long").alias("user_key"), F.lit(-1).cast("long").alias("job_id"), (F.col("m") + clock.DAY).alias("arrival_us"), (F.col("m") + clock.DAY).alias("available_us"), F.lit(0).cast("long").alias("work_us"), F.lit(0).alias("is_error")
    ).withColumns({"ts": F.timestamp_micros("arrival_us"), "part": F.lit(1 << 40).cast("long")})
    folder = f"{shared_folder(spark)}/arriving-{uuid.uuid4().hex}"
    every = rows.unionByName(end)
    every.write.partitionBy("part").parquet(f"{folder}-parts")
    parts = spark.read.schema(every.schema).parquet(f"{folder}-parts")
    for part in [r.part for r in parts.select("part").distinct().orderBy("part").collect()]:  # one write a file, in order of time; each reads its own part alone
        parts.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(folder)
    dropped(parts)
    stream = live.event_stream(spark, folder, every.drop("part").schema, 1)
    return _drained(spark, live.live_history(stream, "user_key"), "append").where("job_id >= 0").select("job_id", "n", "work_us", "errors")


# ---------------------------------------------------------------- audits
@query("table_digest", "SELECT 'events' AS name, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM orders")
def table_digest(spark, sf_dir):
    one = table(spark, sf_dir, "events").agg(F.lit("events").alias("name"), F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return one.unionAll(table(spark, sf_dir, "orders").agg(F.lit("orders"), F.count("*"), F.sum("o_orderkey")))


@query("audited_counts", f"""WITH {STREAM}, w AS (SELECT job_id, k, count(*) FILTER (k = 0) OVER o AS every, count(*) FILTER (k = 0 AND job_id % 5 <> 0) OVER o AS open, coalesce(sum(is_error) FILTER (k = 0) OVER o, 0) AS e, coalesce(sum(is_error) FILTER (k = 0 AND job_id % 5 <> 0) OVER o, 0) AS oe
  FROM s WINDOW o AS (PARTITION BY item_key ORDER BY at_us, k, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), p AS (SELECT * FROM w WHERE k = 1 AND {_bits('job_id')} % 2 = 0)
SELECT 'x_n' AS "column", count(*) FILTER (every <> open) AS different, 0::BIGINT AS only_a, 0::BIGINT AS only_b FROM p
UNION ALL SELECT 'x_err', count(*) FILTER ((CASE WHEN every > 0 THEN e::DOUBLE / every ELSE -1 END) <> (CASE WHEN open > 0 THEN oe::DOUBLE / open ELSE -1 END)), 0, 0 FROM p""")
def audited_counts(spark, sf_dir):
    """How far withheld results change an item's history, on the audited half of the jobs."""
    rows = timed(spark, sf_dir)
    read = lambda eligible: history.keyed_history(history.merged_stream(rows, ["item_key", "work_us", "is_error"], eligible), ["item_key"], "x")
    return study.audited(read(None), read(F.col("job_id") % 5 != 0), ["job_id"], ["x_n", "x_err"], 2)


@query("sealed_read", f"WITH {JOBS} SELECT week, count(*) AS n FROM j WHERE week NOT IN (2820, 2821) GROUP BY week")
def sealed_read(spark, sf_dir):
    from ..access import Guard

    return Guard("week", frozenset({2820, 2821})).open_part(jobs(spark, sf_dir)).groupBy("week").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- online scores and controls
_SEEN = "list_filter(s, lambda d: d.q = {x}.q AND d.e <= {x}.a)"


def _online_sql(x: str) -> str:
    """The mean work of the results of a job's item that are done by its arrival, weighed with one of a usual job."""
    seen = _SEEN.format(x=x)
    return f"(coalesce(list_sum(list_transform({seen}, lambda d: d.w)), 0) + 30000000.0::DOUBLE) / (len({seen}) + 1)"


@query("online_replay", f"""WITH RECURSIVE {_dispatch_sql(f"struct_pack(a := {_online_sql('x')}, b := x.i)")}, o AS (SELECT p.g, p.job_id, p.wait_us, k.item_key, k.arrival_us, k.w_us, k.arrival_us + p.wait_us + k.w_us AS e FROM p JOIN ranked k USING (job_id))
SELECT q.job_id, any_value(q.wait_us) AS wait_us, round((coalesce(sum(x.w_us), 0) + 30000000.0::DOUBLE) / (count(x.job_id) + 1), 3) AS score FROM o q LEFT JOIN o x ON x.g = q.g AND x.item_key = q.item_key AND x.e <= q.arrival_us GROUP BY q.job_id""")
def online_replay(spark, sf_dir):
    from ..operators import online

    return online.online_replay(heavy_load(spark, sf_dir), ["user_key"], "item_key", SERVERS).select("job_id", "wait_us", F.round("score", 3).alias("score"))


@query("refined_replay")
def refined_replay(spark, sf_dir):
    """Scores from the source's clock, less every result that a replay shows to have come too late."""
    from ..operators import online

    rows = clock.arrival_and_availability(heavy_load(spark, sf_dir), result_lag=0)
    checkpointed(rows.limit(0))  # names the folder
    out, _ = online.refined(rows, ["user_key"], "item_key", SERVERS)
    return out.select("job_id", "wait_us", F.round("score", 3).alias("score"), "withheld")


@query("withheld_history", f"""WITH {JOBS}, s AS (SELECT available_us AS at_us, 0 AS k, * FROM t WHERE job_id % 5 <> 0 UNION ALL SELECT arrival_us, 1, * FROM t),
w AS (SELECT job_id, k, count(*) FILTER (k = 0) OVER (PARTITION BY item_key ORDER BY at_us, k, job_id) AS n FROM s) SELECT job_id, n AS open_n FROM w WHERE k = 1""")
def withheld_history(spark, sf_dir):
    stream = history.merged_stream(timed(spark, sf_dir), ["item_key", "work_us", "is_error"], eligible=F.col("job_id") % 5 != 0)
    return history.keyed_history(stream, ["item_key"], "open").select("job_id", "open_n")


def _rebuilt_sql(instant: str) -> str:
    """Histories by definition, with the instant at which job q may read result x, null for never."""
    at = lambda p: f"v[least(len(v), floor({p} * (len(v) - 1) + 0.5)::BIGINT + 1)]"
    return f"""WITH {JOBS}, m AS (SELECT q.job_id, q.arrival_us AS now_us, x.job_id AS r, x.arrival_us, x.work_us, x.is_error, {instant} AS at_us FROM t q JOIN t x ON q.user_key = x.user_key AND x.job_id <> q.job_id),
s AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY at_us DESC, r DESC) AS i FROM m WHERE at_us <= now_us),
g AS (SELECT job_id, count(*) AS n, sum(work_us)::BIGINT AS work_us, sum(is_error)::BIGINT AS errors, list_sort(list(work_us) FILTER (i <= 120)) AS v, arg_max(r, (arrival_us, r)) AS last_job, arg_max(is_error, (arrival_us, r)) AS last_error FROM s GROUP BY job_id)
SELECT t.job_id, coalesce(n, 0) AS n, coalesce(g.work_us, 0) AS work_us, coalesce(errors, 0) AS errors, {at(0.5)} AS p50, {at(0.9)} AS p90, list_max(v) AS top, last_job, last_error FROM t LEFT JOIN g USING (job_id)"""


@query("lagged_own_copy", _rebuilt_sql("CASE WHEN x.class_term = q.class_term AND x.available_us + 21600000000 > q.arrival_us THEN NULL ELSE x.available_us END"))
def lagged_own_copy(spark, sf_dir):
    """Histories of users in which a copy's own results of the last six hours are withheld; only the jobs that this reaches are built again."""
    from ..operators import recompute

    rows = timed(spark, sf_dir)
    baseline = recompute.history(rows, ["user_key"])
    changes = recompute.own_copy_lag(rows, ["user_key"], "class_term", 6 * clock.HOUR)
    return recompute.patched(baseline, recompute.rebuilt(rows, ["user_key"], baseline, changes))


@query("released_own_copy", _rebuilt_sql("CASE WHEN x.class_term = q.class_term AND x.arrival_us <= q.arrival_us AND x.available_us > q.arrival_us THEN x.arrival_us + x.work_us // 2 + 1 ELSE x.available_us END"))
def released_own_copy(spark, sf_dir):
    """Histories in which a copy's own jobs that are in flight are read from another instant on, which also places them in the window."""
    from ..operators import recompute

    rows = timed(spark, sf_dir)
    baseline = recompute.history(rows, ["user_key"])
    pairs = recompute.own_copy_pairs(rows, ["user_key"], "class_term", "arrival_us", 3 * clock.LIMIT + 1)
    open_ = pairs.where("available_us > now_us").withColumn("release_us", F.col("arrival_us") + F.floor(F.col("work_us") / 2) + 1)
    return recompute.patched(baseline, recompute.rebuilt(rows, ["user_key"], baseline, open_))


_CONTROLS = " UNION ALL ".join(
    f"""SELECT '{name}' AS control, q.job_id, (SELECT count(*) FROM t x WHERE x.user_key = q.user_key AND {extra} AND x.available_us + {lag} <= q.arrival_us) AS n FROM t q"""
    for name, lag, extra in (("plain", 0, "true"), ("lag_1h", 3_600_000_000, "true"), ("lag_6h", 21_600_000_000, "true"), ("replayed", 0, "NOT x.is_result_only"), ("own_class", 0, "x.class_term = q.class_term"))
)


@query("visibility_controls", f"WITH {JOBS} {_CONTROLS}")
def visibility_controls(spark, sf_dir):
    """How many results of its user a job sees under each control: lags, dropped kinds, a narrower namespace."""
    rows = timed(spark, sf_dir)
    out = None
    for name, lag, keys, eligible in (
        ("plain", 0, ["user_key"], None),
        ("lag_1h", clock.HOUR, ["user_key"], None),
        ("lag_6h", 6 * clock.HOUR, ["user_key"], None),
        ("replayed", 0, ["user_key"], ~F.col("is_result_only")),
        ("own_class", 0, ["user_key", "class_term"], None),
    ):
        later = rows.withColumn("available_us", F.col("available_us") + lag)
        stream = history.merged_stream(later, [*keys, "work_us", "is_error"], eligible)
        one = history.keyed_history(stream, keys, "x").select(F.lit(name).alias("control"), "job_id", F.col("x_n").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


@query("same_phase_work", f"""WITH RECURSIVE {_FCFS2}, c AS (SELECT h.user_key, h.job_id, h.arrival_us + r.wait_us AS start_us, h.big_us, h.arrival_us FROM h JOIN r USING (job_id))
SELECT q.job_id, coalesce(sum(x.big_us) FILTER ((x.arrival_us, x.job_id) > (q.arrival_us, q.job_id)), 0)::BIGINT AS phase_us FROM c q JOIN c x ON q.user_key = x.user_key AND q.start_us = x.start_us GROUP BY q.job_id""")
def same_phase_work(spark, sf_dir):
    """Work of later jobs that started at the same instant."""
    rows = fcfs_waits(spark, sf_dir).withColumn("start_us", F.col("arrival_us") + F.col("wait_us"))
    later = Window.partitionBy("user_key", "start_us").orderBy(F.desc("arrival_us"), F.desc("job_id")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("job_id", F.coalesce(F.sum("work_us").over(later), F.lit(0)).alias("phase_us"))


@query("single_server_pool", f"""WITH RECURSIVE {JOBS}, p AS (SELECT user_key % 40 AS term, arrival_us // 3600000000 AS h, sum(work_us)::BIGINT AS w FROM t GROUP BY ALL), l AS (SELECT term, list(struct_pack(h := h, w := w)) AS hist FROM p GROUP BY term), g AS (SELECT list(struct_pack(t := term, hist := hist)) AS every FROM l),
r AS (SELECT every, []::BIGINT[] AS chosen, MAP {{}}::MAP(BIGINT, BIGINT) AS load, 0::BIGINT AS peak FROM g UNION ALL
  SELECT every, list_append(chosen, pick.t), map_from_entries(list_concat(list_filter(map_entries(load), lambda e: NOT list_contains(list_transform(pick.hist, lambda y: y.h), e.key)), list_transform(pick.hist, lambda y: struct_pack("key" := y.h, "value" := y.w + coalesce(load[y.h], 0))))), pick.p
  FROM (SELECT *, list_sort(list_transform(list_filter(every, lambda z: NOT list_contains(chosen, z.t)), lambda z: struct_pack(p := greatest(peak, list_max(list_transform(z.hist, lambda y: y.w + coalesce(load[y.h], 0)))), t := z.t, hist := z.hist)))[1] AS pick FROM r) WHERE pick.p <= 450000000)
SELECT (unnest(range(len(chosen))))::INTEGER AS place, unnest(chosen) AS term FROM (SELECT chosen FROM r ORDER BY len(chosen) DESC LIMIT 1)""")
def single_server_pool(spark, sf_dir):
    histogram = timed(spark, sf_dir).groupBy((F.col("user_key") % 40).alias("term"), F.floor(F.col("arrival_us") / clock.HOUR).alias("hour")).agg(F.sum("work_us").alias("work"))
    chosen = study.single_server_pool(checkpointed(histogram), "term", "hour", "work", clock.HOUR // 8)
    return spark.createDataFrame(list(enumerate(chosen)), "place int, term long")


@query("simultaneous_band", f"""WITH {JOBS}, {_many_sql(200, 5)}, {_MEANS_SQL}, c AS (SELECT kind, max(mean) FILTER (resample = 0) AS estimate, stddev_samp(mean) FILTER (resample > 0) AS sd FROM m GROUP BY kind),
z AS (SELECT resample, max(abs((mean - estimate) / nullif(sd, 0))) AS z FROM m JOIN c USING (kind) WHERE resample > 0 GROUP BY resample), q AS (SELECT quantile_cont(z, 0.95) AS z FROM z) SELECT kind, round(estimate, 3) AS estimate, round(estimate - z * sd, 3) AS low, round(estimate + z * sd, 3) AS high FROM c, q""")
def simultaneous_band(spark, sf_dir):
    rows = timed(spark, sf_dir)
    means = study.resampled_mean(in_blocks(rows), "block", "work_us", ["kind"], study.multiplicities(spark, range(_BLOCKS), 200, seed=5))
    out = study.simultaneous_band(means, "kind", "mean")
    return out.select("kind", *(F.round(c, 3).alias(c) for c in ("estimate", "low", "high")))


_U = "(({}) + 0.5::DOUBLE) * 2.0::DOUBLE ^ -52"


@query("noisy_scores", f"WITH {JOBS} SELECT job_id, round(cost_us / 1e6::DOUBLE * exp(0.5::DOUBLE * sqrt(-2.0::DOUBLE * ln({_U.format(_bits('1', 'job_id'))})) * cos(2 * 3.141592653589793::DOUBLE * {_U.format(_bits('2', 'job_id'))})), 6) AS score FROM j")
def noisy_scores(spark, sf_dir):
    return jobs(spark, sf_dir).select("job_id", F.round(study.noisy(F.col("cost_us") / 1e6, 0.5, "job_id"), 6).alias("score"))


@query("repaired_scores", f"WITH {JOBS}, e AS (SELECT job_id, cost_us::DOUBLE AS truth, (cost_us % 50000000)::DOUBLE AS score FROM j), c AS (SELECT quantile_cont(abs(score - truth), 0.9) AS cut FROM e) SELECT job_id, CASE WHEN abs(score - truth) > cut THEN truth ELSE score END AS score FROM e, c")
def repaired_scores(spark, sf_dir):
    rows = jobs(spark, sf_dir).select("job_id", F.col("cost_us").cast("double").alias("truth"), (F.col("cost_us") % 50_000_000).cast("double").alias("score"))
    return study.repaired(rows, "score", "truth", 0.1).select("job_id", "score")


@query("id_time_anchors", f"WITH {JOBS}, m AS (SELECT user_key, job_id AS x, arrival_us AS y FROM a WHERE job_id % 4 = 0), l AS (SELECT q.job_id, q.user_key, b.x AS x0, b.y AS y0, f.x AS x1, f.y AS y1 FROM a q ASOF LEFT JOIN m b ON q.user_key = b.user_key AND q.job_id >= b.x ASOF LEFT JOIN m f ON q.user_key = f.user_key AND q.job_id <= f.x) SELECT job_id, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * ((job_id - x0)::DOUBLE / (x1 - x0)) END / 1e6, 2) AS at_s FROM l")
def id_time_anchors(spark, sf_dir):
    rows = timed(spark, sf_dir)
    anchors = rows.where("job_id % 4 = 0").select("user_key", F.col("job_id").alias("x"), F.col("arrival_us").alias("y"))
    out = temporal.interpolated(anchors, ["user_key"], "x", "y", rows.select("user_key", "job_id"), "job_id")
    return out.select("job_id", F.round(F.col("y") / 1e6, 2).alias("at_s"))
