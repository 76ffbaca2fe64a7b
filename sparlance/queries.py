"""Queries of the engine's own operators over the tables of a data directory, each with its SQL where SQL can express it.

Doubles are rounded to six digits on both sides, as sums are added up in another order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparlance.functions import text as T
from sparlance.operators import classify as C
from sparlance.operators import compare as X
from sparlance.operators import dialogs as D
from sparlance.operators import integrity as I
from sparlance.operators import rollups as R
from sparlance.operators import runs as P
from sparlance.operators import values as V
from sparlance.plans import metric, semantic, sqlinfo, sqltree
from sparlance.session import register, table
from sparlance.streaming.rollout import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _records(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "prepared_records")


def _results(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "result_rows")


# ---------------------------------------------------------------- metric language

STAR = {
    "base_table": "lineitem",
    "measures": {"revenue": {"sql": "round(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))), 2)"}, "lines": {"sql": "count(*)"}, "quantity": {"sql": "sum(cast(l_quantity as decimal(18,2)))"}},
    "dimensions": {
        "customer_segment": {"sql": "customer.c_mktsegment"}, "customer_region": {"sql": "region.r_name"}, "customer_nation": {"sql": "nation.n_name"},
        "return_flag": {"sql": "l_returnflag"}, "line_status": {"sql": "l_linestatus"}, "brand": {"sql": "part.p_brand"},
    },
    "joins": [
        {"table": "orders", "sql_on": "lineitem.l_orderkey = orders.o_orderkey", "required_by": ["customer_segment", "customer_region", "customer_nation"]},
        {"table": "customer", "sql_on": "orders.o_custkey = customer.c_custkey", "required_by": ["customer_segment", "customer_region", "customer_nation"]},
        {"table": "nation", "sql_on": "customer.c_nationkey = nation.n_nationkey", "required_by": ["customer_region", "customer_nation"]},
        {"table": "region", "sql_on": "nation.n_regionkey = region.r_regionkey", "required_by": ["customer_region"]},
        {"table": "part", "sql_on": "lineitem.l_partkey = part.p_partkey", "required_by": ["brand"]},
    ],
}


def _metric(spark: SparkSession, base: str, text: str, model: dict) -> DataFrame:
    q = metric.parse_metric(text)
    metric.check_metric(text) if q.measures else None
    names = {model["base_table"], *(j["table"] for j in model.get("joins", []))}
    out = metric.compile_frame(q, model, {n: table(spark, base, n) for n in names})
    return out.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in out.dtypes])


@query("""
    SELECT c_mktsegment AS customer_segment, CAST(round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))), 2) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' GROUP BY 1 ORDER BY 2 DESC LIMIT 5""")
def metric_revenue_by_segment(spark: SparkSession, base: str) -> DataFrame:
    return _metric(spark, base, "MEASURE(revenue) BY customer_segment WHERE customer_region = 'ASIA' ORDER BY MEASURE(revenue) DESC LIMIT 5", STAR)


@query("""
    SELECT p_brand AS brand, l_returnflag AS return_flag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, count(*) AS lines
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 7""")
def metric_filter_order_limit(spark: SparkSession, base: str) -> DataFrame:
    return _metric(spark, base, "MEASURE(quantity), MEASURE(lines) BY brand, return_flag WHERE return_flag = 'R' ORDER BY MEASURE(quantity) DESC, brand LIMIT 7", STAR)


@query("SELECT l_returnflag AS return_flag, l_linestatus AS line_status FROM lineitem")
def metric_dimensions_keep_duplicates(spark: SparkSession, base: str) -> DataFrame:
    return metric.compile_frame(metric.MetricQuery(dimensions=("return_flag", "line_status")), STAR, {n: table(spark, base, n) for n in ("lineitem", "orders", "customer", "nation", "region", "part")})


SAFE = {
    "base_table": "lineitem", "distinct_on": ["orders.o_orderkey", "orders.o_totalprice"],
    "measures": {"order_total": {"sql": "sum(cast(orders_o_totalprice as decimal(18,2)))"}}, "dimensions": {"return_flag": {"sql": "l_returnflag"}},
    "joins": [{"table": "orders", "sql_on": "lineitem.l_orderkey = orders.o_orderkey", "required_by": ["return_flag"]}],
}


@query("""
    SELECT return_flag, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS order_total
    FROM (SELECT DISTINCT o_orderkey, o_totalprice, l_returnflag AS return_flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""")
def metric_fanout_safe_sum(spark: SparkSession, base: str) -> DataFrame:
    return _metric(spark, base, "MEASURE(order_total) BY return_flag", SAFE)


@query("""
    SELECT l_returnflag AS return_flag, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS order_total
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def metric_fanout_naive_sum(spark: SparkSession, base: str) -> DataFrame:
    naive = {k: v for k, v in SAFE.items() if k != "distinct_on"} | {"measures": {"order_total": {"sql": "sum(cast(o_totalprice as decimal(18,2)))"}}}
    return _metric(spark, base, "MEASURE(order_total) BY return_flag", naive)


@query("""
    SELECT strftime(o_orderdate, '%Y-%m') AS order_month, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders GROUP BY 1""")
def metric_by_month(spark: SparkSession, base: str) -> DataFrame:
    model = {"base_table": "orders", "measures": {"orders": {"sql": "count(*)"}, "total": {"sql": "sum(cast(o_totalprice as decimal(18,2)))"}}, "dimensions": {"order_month": {"sql": "date_format(o_orderdate, 'yyyy-MM')"}}}
    return _metric(spark, base, "MEASURE(orders), MEASURE(total) BY order_month", model)


@query()
def metric_scores(spark: SparkSession, base: str) -> DataFrame:
    pairs = [("MEASURE(revenue) BY brand", "MEASURE(revenue) BY brand"), ("MEASURE(lines)", "MEASURE(revenue)"), ("MEASURE(revenue), MEASURE(lines) BY brand", "MEASURE(revenue) BY brand, return_flag WHERE return_flag = 'R'")]
    rows = [(p, g, *metric.score_metric(metric.parse_metric(p), metric.parse_metric(g)).values(), metric.compile_sql(metric.parse_metric(p), STAR)) for p, g in pairs]
    return spark.createDataFrame(rows, "predicted string, gold string, measure_f1 double, dimension_f1 double, filter_f1 double, measure_preservation double, compiled string")


@query()
def metric_evaluation(spark: SparkSession, base: str) -> DataFrame:
    """Predictions made from the results' plan labels against their own projection, rolled up."""
    import json

    r = _results(spark, base).where("gold_plan.parseable")
    dims = F.array_join(F.transform("gold_plan.projection_shape.group_by", lambda g: F.regexp_replace(F.lower(g), r"[^a-z0-9_]", "_")), ", ")
    dsl = F.concat(F.when(F.size("gold_plan.projection_shape.aggregations") > 0, "MEASURE(lines)").otherwise("MEASURE(profit)"), F.when(dims != "", F.concat(F.lit(" BY "), dims)).otherwise(""))
    rows = r.select(F.col("result_key").alias("id"), dsl.alias("predicted_dsl"), F.lit("MEASURE(lines)").alias("gold_dsl"), F.lit(json.dumps(STAR)).alias("semantic_model"))
    scored = metric.evaluate_rows(rows).withColumn("database_path", F.lit(None).cast("string")).withColumn("execution_score", F.lit(None).cast("double"))
    return R.metric_rollup(scored)


@query()
def predicted_statements(spark: SparkSession, base: str) -> DataFrame:
    """Statements of a stand-in generator for the prompts that do not show their reference."""
    turns = D.load_turns(_results(spark, base), key="result_key")
    clean = turns.join(D.leaked_reference(turns).select("result_key"), "result_key", "left_anti")
    return D.predictions(clean, D.echo_last_question, "direct_sql", key="result_key")


# ---------------------------------------------------------------- value index and retrieval

_NORM = r"trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def _index_sql(cells: list[tuple[str, str]], limit: int = 200) -> str:
    union = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM {t}" for t, c in cells)
    return f"""
    WITH cells AS ({union}),
    counted AS (SELECT "table", "column", v, count(*) AS source_frequency FROM cells WHERE v IS NOT NULL AND trim(v) <> '' AND length(v) <= 120 GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY "table", "column" ORDER BY source_frequency DESC, v) AS rn FROM counted),
    idx AS (SELECT 'star' AS database_id, "table", "column", trim(v) AS raw_value, {_NORM.format('v')} AS normalized_value, source_frequency FROM top WHERE rn <= {limit})"""


_ENTRY = """SELECT left(sha256(concat_ws('|', database_id, "table", "column", raw_value, normalized_value)), 16) AS id, database_id, "table", "column", raw_value, normalized_value,
    raw_value || CASE WHEN normalized_value <> raw_value THEN '|' || normalized_value ELSE '' END AS aliases, source_frequency FROM idx WHERE normalized_value <> ''"""


def _star(spark: SparkSession, base: str, cells: list[tuple[str, str]]) -> DataFrame:
    names = dict.fromkeys(t for t, _ in cells)
    return V.build_index({n: table(spark, base, n).select(*[c for t, c in cells if t == n]) for n in names}, "star")


def _shown(index: DataFrame) -> DataFrame:
    return index.select("id", "database_id", "table", "column", "raw_value", "normalized_value", F.array_join("aliases", "|").alias("aliases"), "source_frequency")


_PART = [("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("part", "p_size")]
_ALL = [*_PART, ("customer", "c_name"), ("customer", "c_mktsegment"), ("customer", "c_nationkey"), ("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("lineitem", "l_returnflag"), ("lineitem", "l_linenumber"), ("events", "event_type")]


@query(f"{_index_sql(_PART)} {_ENTRY}")
def value_index_part(spark: SparkSession, base: str) -> DataFrame:
    return _shown(_star(spark, base, _PART))


@query(f"{_index_sql(_ALL)} {_ENTRY}")
def value_index_star(spark: SparkSession, base: str) -> DataFrame:
    return _shown(_star(spark, base, _ALL))


@query(f"""{_index_sql(_ALL)} SELECT count(*) AS entries, count(DISTINCT database_id) AS databases, count(DISTINCT "table") AS tables, count(DISTINCT "table" || '.' || "column") AS columns,
    CAST(sum(CASE WHEN normalized_value <> raw_value THEN 2 ELSE 1 END) AS BIGINT) AS aliases FROM idx WHERE normalized_value <> ''""")
def value_index_summary(spark: SparkSession, base: str) -> DataFrame:
    return V.index_summary(_star(spark, base, _ALL))


_LABELS = "SELECT p_partkey, 'star' AS database_id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'part' END AS resolved_table, 'part.p_name' AS resolved_column, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' x' ELSE upper(p_name) END AS resolved_value, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS mention_text FROM part"


def _labels(spark: SparkSession, base: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, base, "part").select(
        "p_partkey", F.lit("star").alias("database_id"), F.when(k % 7 != 0, "part").alias("resolved_table"), F.lit("part.p_name").alias("resolved_column"),
        F.when(k % 5 == 0, F.concat("p_name", F.lit(" x"))).otherwise(F.upper("p_name")).alias("resolved_value"), F.when(k % 3 != 0, F.col("p_name")).alias("mention_text"),
    )


_COVERED = f"""{_index_sql(_PART)}, labels AS ({_LABELS}), keys AS (SELECT DISTINCT "table", "column", normalized_value AS token FROM idx WHERE normalized_value <> ''),
    covered AS (SELECT l.*, EXISTS (SELECT 1 FROM keys k WHERE k."table" = l.resolved_table AND k."column" = 'p_name' AND k.token = {_NORM.format('l.resolved_value')}) AS value_hit,
      EXISTS (SELECT 1 FROM keys k WHERE k."table" = l.resolved_table AND k."column" = 'p_name' AND k.token = {_NORM.format('l.mention_text')}) AS mention_hit FROM labels l)"""


@query(f"{_COVERED} SELECT count(*) AS label_count, count(*) FILTER (value_hit) AS value_hits, count(*) FILTER (mention_hit) AS mention_hits, round(count(*) FILTER (value_hit) / count(*), 6) AS value_rate, round(count(*) FILTER (mention_hit) / count(*), 6) AS mention_rate FROM covered")
def index_coverage(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(V.coverage_rates(V.coverage(_star(spark, base, _PART), _labels(spark, base))))


@query(f"{_COVERED} SELECT p_partkey, resolved_value FROM covered WHERE NOT value_hit ORDER BY p_partkey LIMIT 5")
def index_missing_examples(spark: SparkSession, base: str) -> DataFrame:
    return V.missing_examples(V.coverage(_star(spark, base, _PART), _labels(spark, base)), "p_partkey").select("p_partkey", "resolved_value")


@query(f"SELECT record_key, {_NORM.format('source')} AS source, md5({_NORM.format('messages[2].content')}) AS question FROM prepared_records WHERE messages IS NOT NULL")
def normalize_text(spark: SparkSession, base: str) -> DataFrame:
    return _records(spark, base).where("messages is not null").select("record_key", T.normalize_token(F.col("source")).alias("source"), F.md5(T.normalize_token(F.get("messages", 1)["content"])).alias("question"))


_NAMES = """names AS (
      SELECT db_id AS database_id, t AS "table", 'name' AS "column", t AS raw_value, 100 AS source_frequency FROM (SELECT db_id, unnest(table_names_original) AS t FROM database_schemas)
      UNION ALL SELECT db_id, table_names_original[c.table_idx + 1], 'column', c.name, 1 FROM (SELECT db_id, table_names_original, unnest(column_names_original) AS c FROM database_schemas) WHERE c.table_idx >= 0)"""


def _name_index(spark: SparkSession, base: str) -> DataFrame:
    """Table and column names of each database as values that questions mention."""
    s = table(spark, base, "database_schemas")
    tables = s.select(F.col("db_id").alias("database_id"), F.explode("table_names_original").alias("table"))
    cols = V.schema_columns(s)
    names = tables.select("database_id", "table", F.lit("name").alias("column"), F.col("table").alias("raw_value"), F.lit(100).alias("source_frequency"))
    names = names.unionByName(cols.select(F.col("db_id").alias("database_id"), F.col("table_name").alias("table"), F.lit("column").alias("column"), F.col("column_name").alias("raw_value"), F.lit(1).alias("source_frequency")))
    norm = T.normalize_token(F.col("raw_value"))
    return names.withColumn("aliases", T.aliases_of(F.col("raw_value"), norm))


_TURNS = f"""turns AS (SELECT record_key, database_id, i - 1 AS message_index, row_number() OVER (PARTITION BY record_key ORDER BY i) - 1 AS user_turn, {_NORM.format("coalesce(messages[i].content, '')")} AS normal
      FROM (SELECT record_key, database_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM prepared_records WHERE messages IS NOT NULL) WHERE messages[i].role = 'user')"""
_STOP = ", ".join(f"'{w}'" for w in T.COMMON_WORDS)
_MATCHES = f"""WITH {_NAMES}, {_TURNS},
    n AS (SELECT *, {_NORM.format('raw_value')} AS token FROM names),
    m AS (SELECT DISTINCT record_key, user_turn, message_index, t.database_id, "table", "column", raw_value, source_frequency, CASE WHEN raw_value = token OR length(token) >= 3 THEN raw_value END AS matched_alias
      FROM turns t JOIN n ON n.database_id = t.database_id AND contains(' ' || normal || ' ', ' ' || token || ' ') WHERE token <> '' AND (regexp_matches(token, '^\\d+(\\.\\d+)?$') OR (length(token) >= 3 AND token NOT IN ({_STOP})))),
    r AS (SELECT *, row_number() OVER (PARTITION BY record_key, user_turn ORDER BY source_frequency DESC, "table", "column", raw_value) AS rank FROM m)"""


def _matches(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    turns = V.user_turns(_records(spark, base))
    return turns, V.retrieve(turns, _name_index(spark, base), ["record_key", "user_turn", "message_index"])


@query(f'{_MATCHES} SELECT record_key, user_turn, rank, "table", "column", raw_value, matched_alias, source_frequency FROM r WHERE rank <= 4')
def alias_retrieval_topk(spark: SparkSession, base: str) -> DataFrame:
    return _matches(spark, base)[1].select("record_key", "user_turn", F.col("rank").cast("long").alias("rank"), "table", "column", "raw_value", "matched_alias", "source_frequency")


@query(f"""{_MATCHES} SELECT record_key, message_index, md5('Database values that the user''s text mentions:' || chr(10) || string_agg('- ' || "table" || '.' || "column" || ' = {{"raw_value":"' || raw_value || '"}} (matched: ' || matched_alias || ')', chr(10) ORDER BY rank)) AS block
    FROM r WHERE rank <= 4 GROUP BY record_key, message_index""")
def retrieval_blocks(spark: SparkSession, base: str) -> DataFrame:
    return V.retrieval_blocks(_matches(spark, base)[1], ["record_key", "message_index"]).select("record_key", F.col("message_index").cast("long").alias("message_index"), F.md5("block").alias("block"))


@query(f"""{_MATCHES}, c AS (SELECT t.record_key, t.user_turn, coalesce(t.database_id, '') AS database_id, count(r.rank) AS k FROM turns t LEFT JOIN (SELECT * FROM r WHERE rank <= 4) r ON r.record_key = t.record_key AND r.user_turn = t.user_turn GROUP BY ALL)
    SELECT database_id, count(DISTINCT record_key) AS rows, count(*) AS user_turns, count(DISTINCT CASE WHEN k > 0 THEN record_key END) AS matched_rows, count(*) FILTER (k > 0) AS matched_turns, CAST(sum(k) AS BIGINT) AS matched_values FROM c GROUP BY 1""")
def retrieval_summary(spark: SparkSession, base: str) -> DataFrame:
    return V.retrieval_summary(*_matches(spark, base))


@query(f"""{_MATCHES}, b AS (SELECT record_key, count(DISTINCT message_index) AS k FROM r WHERE rank <= 4 GROUP BY 1)
    SELECT p.record_key, len(p.messages) AS n_messages, coalesce(b.k, 0) AS changed FROM prepared_records p LEFT JOIN b USING (record_key) WHERE messages IS NOT NULL""")
def retrieval_injected(spark: SparkSession, base: str) -> DataFrame:
    records = _records(spark, base).where("messages is not null").select("record_key", "messages")
    blocks = V.retrieval_blocks(_matches(spark, base)[1], ["record_key", "message_index"])
    marked = F.size(F.filter(D.F.col("messages"), lambda m: F.coalesce(F.contains(m["content"], F.lit("\n\nDatabase values that the user's text mentions:\n")), F.lit(False))))
    return V.inject_blocks(records, blocks).select("record_key", F.size("messages").cast("long").alias("n_messages"), marked.cast("long").alias("changed"))


@query(r"""
    WITH t AS (SELECT record_key, i, messages, regexp_extract(messages[i].content, '''([^'']+)''', 1) AS v FROM (SELECT record_key, messages, unnest(range(1, len(messages) + 1)) AS i FROM prepared_records WHERE messages IS NOT NULL) WHERE messages[i].role = 'assistant'),
    u AS (SELECT record_key, i, lower(v) AS v, [lower(coalesce(m.content, '')) FOR m IN messages[1:i - 1] IF m.role = 'user'] AS us, [lower(coalesce(m.content, '')) FOR m IN messages[1:i - 1] IF m.role = 'assistant'] AS pa FROM t WHERE regexp_matches(v, '^[\w ]+$')),
    s AS (SELECT record_key, i - 1 AS message_index, v,
        regexp_matches(' ' || us[-1] || ' ', '[^a-z0-9]' || v || '[^a-z0-9]') AS a, regexp_matches(' ' || array_to_string(us[1:-2], ' ') || ' ', '[^a-z0-9]' || v || '[^a-z0-9]') AS b, regexp_matches(' ' || array_to_string(pa, ' ') || ' ', '[^a-z0-9]' || v || '[^a-z0-9]') AS c FROM u)
    SELECT record_key, message_index, CASE WHEN a THEN 'exact_in_current_turn' WHEN b THEN 'exact_in_history' WHEN c THEN 'carried_from_prior_sql' ELSE 'missing_from_user_text' END AS mention_status FROM s""")
def mention_status(spark: SparkSession, base: str) -> DataFrame:
    """Where the first plain literal of each answer is mentioned."""
    rows = _records(spark, base).where("messages is not null").select("record_key", "messages", F.posexplode("messages").alias("message_index", "m")).where("m.role = 'assistant'")
    said = lambda role: F.transform(F.filter(F.slice("messages", 1, F.col("message_index")), lambda m: m["role"] == role), lambda m: F.coalesce(m["content"], F.lit("")))
    v = F.regexp_extract("m.content", "'([^']+)'", 1)
    rows = rows.select("record_key", F.col("message_index").cast("long").alias("message_index"), v.alias("v"), said("user").alias("us"), F.array_join(said("assistant"), " ").alias("prior")).where(r"v rlike '^[\\w ]+$'")
    now = T.exact_mention(F.try_element_at("us", F.lit(-1)), F.col("v"))
    past = T.exact_mention(F.array_join(F.slice("us", 1, F.size("us") - 1), " "), F.col("v"))
    status = F.when(now.isNotNull(), "exact_in_current_turn").when(past.isNotNull(), "exact_in_history").when(T.exact_mention(F.col("prior"), F.col("v")).isNotNull(), "carried_from_prior_sql").otherwise("missing_from_user_text")
    return rows.select("record_key", "message_index", status.alias("mention_status"))


@query()
def grounded_literals(spark: SparkSession, base: str) -> DataFrame:
    return V.grounded_literals(_records(spark, base))


@query()
def grounding_summary(spark: SparkSession, base: str) -> DataFrame:
    return V.grounding_summary(V.grounded_literals(_records(spark, base)))


# ---------------------------------------------------------------- schemas

_SCOLS = """cols AS (SELECT db_id, c.table_idx AS ti, table_names_original[c.table_idx + 1] AS tn, i - 1 AS ci, c.name AS cn, coalesce(column_types[i], 'text') AS ct, coalesce(list_contains(primary_keys, i - 1), false) AS pk
    FROM (SELECT *, column_names_original[i] AS c FROM (SELECT *, unnest(range(1, len(column_names_original) + 1)) AS i FROM database_schemas)) WHERE c.table_idx >= 0)"""


@query(f"""WITH {_SCOLS}, per AS (SELECT db_id, ti, string_agg(cn || ' ' || ct, ', ' ORDER BY ci) AS s FROM cols GROUP BY ALL),
    tabs AS (SELECT db_id, i - 1 AS ti, table_names_original[i] AS tn FROM (SELECT *, unnest(range(1, len(table_names_original) + 1)) AS i FROM database_schemas))
    SELECT db_id, md5(string_agg(tn || '(' || coalesce(s, '') || ')', chr(10) ORDER BY ti)) AS schema_text FROM tabs LEFT JOIN per USING (db_id, ti) GROUP BY 1""")
def schema_text(spark: SparkSession, base: str) -> DataFrame:
    return V.schema_text(table(spark, base, "database_schemas")).select("db_id", F.md5("schema_text").alias("schema_text"))


@query(f"""WITH {_SCOLS} SELECT CASE WHEN lower(ct) IN ('number','integer','int','float','double','real','decimal') THEN 'number' WHEN lower(ct) IN ('time','date','datetime','timestamp') THEN 'time' WHEN lower(ct) IN ('boolean','bool') THEN 'boolean' ELSE 'string' END AS semantic_type,
    count(*) AS n_columns, count(*) FILTER (pk) AS n_primary FROM cols GROUP BY 1""")
def semantic_types(spark: SparkSession, base: str) -> DataFrame:
    return V.schema_columns(table(spark, base, "database_schemas")).groupBy(V.semantic_type(F.col("column_type")).alias("semantic_type")).agg(F.count("*").alias("n_columns"), F.count_if("is_primary").alias("n_primary"))


_SEMANTIC = f"""WITH {_SCOLS}, k AS (SELECT *, CASE WHEN lower(ct) IN ('number','integer','int','float','double','real','decimal') THEN 'number' WHEN lower(ct) IN ('time','date','datetime','timestamp') THEN 'time' WHEN lower(ct) IN ('boolean','bool') THEN 'boolean' ELSE 'string' END AS st, replace(lower(cn), ' ', '_') AS sn FROM cols),
    per AS (SELECT db_id, ti, string_agg(cn || ' [' || st || CASE WHEN pk THEN ', primary_key' ELSE '' END || ']', ', ' ORDER BY ci) AS dims,
      string_agg(CASE WHEN st = 'number' AND NOT pk AND lower(cn) NOT IN ('id', 'uid') AND lower(cn) NOT LIKE '%\\_id' ESCAPE '\\' AND lower(cn) NOT LIKE '% id' THEN 'sum_' || sn || '=sum(' || cn || '), avg_' || sn || '=avg(' || cn || ')' END, ', ' ORDER BY ci) AS sums,
      string_agg(CASE WHEN pk THEN cn END, ', ' ORDER BY ci) AS pks FROM k GROUP BY ALL),
    fks AS (SELECT db_id, i, a, b, table_names_original AS tno FROM (SELECT db_id, table_names_original, i, column_names_original[foreign_keys[i][1] + 1] AS a, column_names_original[foreign_keys[i][2] + 1] AS b FROM (SELECT *, unnest(range(1, len(foreign_keys) + 1)) AS i FROM database_schemas)) WHERE a.table_idx >= 0 AND b.table_idx >= 0),
    js AS (SELECT db_id, a.table_idx AS ti, string_agg(tno[a.table_idx + 1] || '.' || a.name || ' -> ' || tno[b.table_idx + 1] || '.' || b.name || ' (many_to_one)', ', ' ORDER BY i) AS joins FROM fks GROUP BY ALL),
    tabs AS (SELECT db_id, i - 1 AS ti, table_names_original[i] AS tn FROM (SELECT *, unnest(range(1, len(table_names_original) + 1)) AS i FROM database_schemas))"""


@query(f"""{_SEMANTIC} SELECT db_id, md5(string_agg('- Cube ' || tn || ' (grain: one row per ' || tn || CASE WHEN pks IS NOT NULL THEN '; primary key: ' || pks ELSE '' END || ')' || CASE WHEN dims IS NOT NULL THEN chr(10) || '  Dimensions: ' || dims ELSE '' END
      || chr(10) || '  Measures: count' || CASE WHEN sums IS NOT NULL THEN ', ' || sums ELSE '' END || CASE WHEN joins IS NOT NULL THEN chr(10) || '  Joins: ' || joins ELSE '' END, chr(10) ORDER BY ti)) AS semantic_text
    FROM tabs LEFT JOIN per USING (db_id, ti) LEFT JOIN js USING (db_id, ti) GROUP BY 1""")
def semantic_text(spark: SparkSession, base: str) -> DataFrame:
    return V.semantic_text(table(spark, base, "database_schemas")).select("db_id", F.md5("semantic_text").alias("semantic_text"))


@query(f"""{_SEMANTIC}, c AS (SELECT db_id, count(DISTINCT ti) AS table_count, count(*) AS column_count FROM cols GROUP BY 1), f AS (SELECT db_id, count(*) AS n FROM fks GROUP BY 1)
    SELECT db_id, table_count, column_count, coalesce(n, 0) AS join_key_count FROM c LEFT JOIN f USING (db_id)""")
def column_context(spark: SparkSession, base: str) -> DataFrame:
    return V.column_context(table(spark, base, "database_schemas")).select("db_id", "table_count", F.col("column_count").cast("long").alias("column_count"), F.col("join_key_count").cast("long").alias("join_key_count"))


@query("SELECT DISTINCT lower(trim(database_id)) AS database_id FROM prepared_records WHERE trim(database_id) <> '' AND lower(trim(database_id)) NOT IN (SELECT lower(db_id) FROM database_schemas)")
def missing_databases(spark: SparkSession, base: str) -> DataFrame:
    return I.missing_databases(_records(spark, base), table(spark, base, "database_schemas"))


@query()
def gold_metric_labels(spark: SparkSession, base: str) -> DataFrame:
    """Why reference statements amount to a metric query of their database's semantic model, or do not."""
    def derive(sqls: pd.Series, texts: pd.Series) -> pd.DataFrame:
        model = lru_cache(maxsize=64)(semantic.read_model)
        out = [semantic.derive_metric(model(t) if t is not None else [], s) for s, t in zip(sqls, texts)]
        return pd.DataFrame([(d, "no semantic model" if t is None else w) for (d, w), t in zip(out, texts)], columns=["dsl", "why"])

    models = V.semantic_text(table(spark, base, "database_schemas"))
    rows = _results(spark, base).where("reference_sql is not null").groupBy("reference_sql", F.lower(F.trim("database_id")).alias("db_id")).agg(F.count("*").alias("n"))
    got = rows.join(models, "db_id", "left").withColumn("d", F.pandas_udf(derive, "struct<dsl:string,why:string>")("reference_sql", "semantic_text"))
    return got.groupBy(F.coalesce("d.why", F.lit("labelled")).alias("outcome")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_statements"), F.count_distinct("d.dsl").alias("n_queries"))


# ---------------------------------------------------------------- dialogs

_EXPANDED = """x AS (SELECT record_key, coalesce(nullif(dialog_id, ''), nullif(id, ''), 'prepared-' || record_key) AS dialog_id, i, messages, database_id, len([m FOR m IN messages IF m.role = 'assistant']) AS turn_count,
      row_number() OVER (PARTITION BY record_key ORDER BY i) - 1 AS turn_index, messages[i].content AS reference_sql, schema_link_labels AS labels, split_role, history_policy
    FROM (SELECT *, unnest(range(1, len(messages) + 1)) AS i FROM prepared_records WHERE messages IS NOT NULL) WHERE messages[i].role = 'assistant')"""


@query(f"WITH {_EXPANDED} SELECT record_key, dialog_id || ':' || turn_index AS id, dialog_id, turn_index, turn_count, i - 1 AS n_before, md5(reference_sql) AS reference, coalesce(labels[turn_index + 1].parseable, false) AS parseable FROM x")
def expand_turns(spark: SparkSession, base: str) -> DataFrame:
    t = D.expand_turns(_records(spark, base))
    return t.select("record_key", "id", "dialog_id", F.col("turn_index").cast("long").alias("turn_index"), F.col("turn_count").cast("long").alias("turn_count"), F.size("messages").cast("long").alias("n_before"), F.md5("reference_sql").alias("reference"), F.coalesce("gold_plan.parseable", F.lit(False)).alias("parseable"))


@query(f"WITH {_EXPANDED} SELECT record_key, turn_index, md5(array_to_string([coalesce(m.content, '') FOR m IN messages[1:i - 1] IF m.role = 'user'], chr(10))) AS user_text FROM x")
def history_prefix(spark: SparkSession, base: str) -> DataFrame:
    t = D.expand_turns(_records(spark, base))
    text = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    return t.select("record_key", F.col("turn_index").cast("long").alias("turn_index"), F.md5(text).alias("user_text"))


@query(f"WITH {_EXPANDED} SELECT record_key, turn_index FROM x ORDER BY record_key, turn_index LIMIT 100")
def first_turns(spark: SparkSession, base: str) -> DataFrame:
    t = D.expand_turns(_records(spark, base)).withColumn("turn_index", F.col("turn_index").cast("long"))
    return D.first_turns(t.select("record_key", "turn_index"), 100, ("record_key", "turn_index"))


@query("SELECT CASE WHEN n > 1 THEN 'multi_turn_dialog' ELSE 'single_turn' END AS turn_format, CASE WHEN n > 1 THEN 'gold_sql_teacher_forced' ELSE 'single_turn' END AS history_policy, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS turns FROM (SELECT len([m FOR m IN messages IF m.role = 'assistant']) AS n FROM prepared_records WHERE messages IS NOT NULL AND len(messages) >= 3) GROUP BY ALL")
def turn_formats(spark: SparkSession, base: str) -> DataFrame:
    w = D.wrap_records(_records(spark, base).where("messages is not null").select("messages")).where("turn_format is not null")
    return w.groupBy("turn_format", "history_policy").agg(F.count("*").alias("n_records"), F.sum("assistant_turn_count").alias("turns"))


@query("SELECT record_key, n - 1 AS recoverable_later_turn_count FROM (SELECT record_key, split_role, len([m FOR m IN messages IF m.role = 'assistant']) AS n FROM prepared_records WHERE messages IS NOT NULL) WHERE n >= 2 AND split_role = 'clean_local_holdout'")
def multi_turn_candidates(spark: SparkSession, base: str) -> DataFrame:
    return D.multi_turn_candidates(_records(spark, base).where("messages is not null"), "clean_local_holdout").select("record_key", F.col("recoverable_later_turn_count").cast("long").alias("recoverable_later_turn_count"))


@query("SELECT record_key FROM prepared_records WHERE coalesce(uses_oracle_planning_hints, false) OR coalesce(semantic_context_pruned_by_oracle_labels, false) OR len([m FOR m IN messages IF contains(m.content, 'SQL planning hints:') OR contains(m.content, 'Oracle SQL planning hints')]) > 0")
def plan_hint_records(spark: SparkSession, base: str) -> DataFrame:
    return _records(spark, base).where(D.uses_plan_hints(F.col("messages"), F.col("uses_oracle_planning_hints"), F.col("semantic_context_pruned_by_oracle_labels"))).select("record_key")


@query("SELECT record_key, md5(coalesce(messages[1].content || chr(10) || chr(10) || 'Return only the SQL query, without explanation.', 'Return only the SQL query, without explanation.')) AS system_text, len(messages) AS n_messages FROM prepared_records WHERE messages[1].role = 'system'")
def sql_only_prompts(spark: SparkSession, base: str) -> DataFrame:
    r = _records(spark, base).where(F.get("messages", 0)["role"] == "system")
    m = D.with_sql_only(F.col("messages"))
    return r.select("record_key", F.md5(F.get(m, 0)["content"]).alias("system_text"), F.size(m).cast("long").alias("n_messages"))


@query("SELECT record_key, md5('S') AS system_text, md5(messages[-2].content || chr(10) || chr(10) || 'T') AS last_user FROM prepared_records WHERE messages IS NOT NULL AND messages[-2].role = 'user' AND messages[-2].content IS NOT NULL AND rtrim(messages[-2].content, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) = messages[-2].content AND messages[-1].role = 'assistant'")
def system_replaced_prompts(spark: SparkSession, base: str) -> DataFrame:
    last = F.try_element_at("messages", F.lit(-2))["content"]
    r = _records(spark, base).where(F.col("messages").isNotNull() & (F.try_element_at("messages", F.lit(-2))["role"] == "user") & last.isNotNull() & (F.regexp_replace(last, r"[ \t\n\r\x0b\f]+$", "") == last) & (F.try_element_at("messages", F.lit(-1))["role"] == "assistant"))
    m = D.with_system(F.col("messages"), "S", "T")
    return r.select("record_key", F.md5(F.get(m, 0)["content"]).alias("system_text"), F.md5(F.try_element_at(m, F.lit(-2))["content"]).alias("last_user"))


@query(f"WITH {_EXPANDED} SELECT record_key, turn_index FROM x WHERE reference_sql <> '' AND contains(array_to_string([m.content FOR m IN messages[1:i - 1] IF m.role IN ('system', 'user')], chr(10)), reference_sql)")
def leaked_references(spark: SparkSession, base: str) -> DataFrame:
    return D.leaked_reference(D.expand_turns(_records(spark, base))).select("record_key", F.col("turn_index").cast("long").alias("turn_index"))


@query("SELECT record_key AS result_key, CASE WHEN messages[-1].role IS DISTINCT FROM 'user' THEN 'prompt_not_ending_with_user' ELSE 'scorer_field_in_prompt' END AS violation FROM prepared_records WHERE messages IS NOT NULL AND (messages[-1].role IS DISTINCT FROM 'user' OR len([m FOR m IN messages IF regexp_matches(m.content, 'schema_link_labels|gold_plan|gold_metric_dsl')]) > 0)")
def prompt_violations(spark: SparkSession, base: str) -> DataFrame:
    """Records end with an answer, so as prompts they break the rule."""
    return D.prompt_violations(_records(spark, base).where("messages is not null").withColumnRenamed("record_key", "result_key")).select("result_key", "violation")


_SIGNALS = """array_to_string(list_filter([CASE WHEN coalesce(len(gold_plan.projection_shape.aggregations), 0) > 0 OR len([e FOR e IN gold_plan.projection_shape.selected_expressions IF regexp_matches(lower(e), '(count|sum|avg|min|max)\\(')]) > 0 THEN 'aggregation' END,
    CASE WHEN coalesce(gold_plan.query_skeleton['group_by'], false) OR coalesce(len(gold_plan.projection_shape.group_by), 0) > 0 THEN 'group_by' END, CASE WHEN gold_plan.query_skeleton['having'] THEN 'having' END,
    CASE WHEN gold_plan.query_skeleton['order_by'] OR gold_plan.projection_shape.order_by IS NOT NULL THEN 'order_by' END, CASE WHEN gold_plan.query_skeleton['limit'] OR gold_plan.projection_shape."limit" IS NOT NULL THEN 'limit' END], lambda x: x IS NOT NULL), ',')"""


@query(f"SELECT signals, count(*) AS n_rows FROM (SELECT {_SIGNALS} AS signals FROM result_rows WHERE gold_plan IS NOT NULL) GROUP BY 1")
def metric_signals(spark: SparkSession, base: str) -> DataFrame:
    s = F.array_join(D.metric_signals(F.col("gold_plan")), ",")
    return _results(spark, base).where("gold_plan is not null").groupBy(s.alias("signals")).agg(F.count("*").alias("n_rows"))


@query(f"WITH {_EXPANDED} SELECT x.record_key, x.turn_index, turn_count, i - 1 AS history_length FROM x JOIN prepared_records p USING (record_key) WHERE p.seeded_failure_turn_index IS NULL OR p.seeded_failure_turn_index <> x.turn_index")
def rollout_history(spark: SparkSession, base: str) -> DataFrame:
    out = D.rollout(_records(spark, base), D.echo_last_question)
    return out.select(F.col("key").alias("record_key"), *[F.col(c).cast("long").alias(c) for c in ("turn_index", "turn_count", "history_length")])


@query()
def teacher_forced(spark: SparkSession, base: str) -> DataFrame:
    return D.teacher_forced(_records(spark, base))


@query("SELECT doc_id, 'Database: ' || database_id || chr(10) || chr(10) || 'Question:' || chr(10) || coalesce(lang, '') AS prompt FROM documents WHERE database_id <> ''")
def user_prompts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").where("database_id <> ''").select("doc_id", D.user_prompt(F.coalesce("lang", F.lit("")), database=F.col("database_id")).alias("prompt"))


@query("SELECT result_key, 'treatment' AS arm FROM result_rows WHERE list_contains(gold_plan.relevant_tables, gold_plan.relevant_tables[1]) UNION ALL SELECT result_key, 'control' FROM result_rows WHERE list_contains(gold_plan.relevant_tables, gold_plan.relevant_tables[1])")
def paired_arms(spark: SparkSession, base: str) -> DataFrame:
    r = _results(spark, base).select("result_key", F.col("gold_plan.relevant_tables").alias("tables"), F.get("gold_plan.relevant_tables", 0).alias("first"))
    return r.where(F.array_contains("tables", F.col("first"))).withColumn("arm", F.explode(F.array(F.lit("treatment"), F.lit("control")))).select("result_key", "arm")


# ---------------------------------------------------------------- statements


@query(r"SELECT result_key, regexp_replace(regexp_replace(regexp_replace(reference_sql, '>\s+=', '>=', 'g'), '<\s+=', '<=', 'g'), '!\s+=', '!=', 'g') AS repaired, replace(replace(replace(replace(reference_sql, '> =', '>='), '< =', '<='), '! =', '!='), '= =', '==') AS cleaned FROM result_rows WHERE reference_sql IS NOT NULL")
def repaired_statements(spark: SparkSession, base: str) -> DataFrame:
    return _results(spark, base).where("reference_sql is not null").select("result_key", T.repair_spacing(F.col("reference_sql")).alias("repaired"), T.clean_sql(F.col("reference_sql")).alias("cleaned"))


@query(r"""SELECT result_key, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(generated_sql, '''[^'']*'''), regexp_extract_all(generated_sql, '"[^"]*"')))), '|') AS literals FROM result_rows""")
def quoted_literals(spark: SparkSession, base: str) -> DataFrame:
    return _results(spark, base).select("result_key", F.array_join(F.array_sort(T.quoted_literals(F.col("generated_sql"))), "|").alias("literals"))


@query()
def extracted_statements(spark: SparkSession, base: str) -> DataFrame:
    return _results(spark, base).select("result_key", T.extract_generated_sql(F.col("raw_generation"), F.col("prompt_variant")).alias("extracted"))


@query()
def sql_features(spark: SparkSession, base: str) -> DataFrame:
    return _results(spark, base).select("result_key", T.sql_features(F.col("reference_sql")).alias("f")).select("result_key", "f.*")


@query()
def plan_labels(spark: SparkSession, base: str) -> DataFrame:
    return _results(spark, base).select("result_key", T.plan_labels(F.col("reference_sql")).alias("p")).select("result_key", "p.*")


_STORED = "result_key, array_to_string(list_sort(gold_plan.relevant_tables), '|') AS tables, lower(array_to_string(gold_plan.join_path, '|')) AS join_path, gold_plan.query_skeleton['where'] AS has_where, gold_plan.query_skeleton['group_by'] AS has_group, gold_plan.projection_shape.selected_count AS selected_count"


@query(f"SELECT {_STORED} FROM result_rows WHERE gold_plan.parseable")
def plan_labels_checked(spark: SparkSession, base: str) -> DataFrame:
    """Labels computed from the reference, or as stored where it is broken, against those stored with each row."""
    rows = _results(spark, base).where("gold_plan.parseable").withColumn("p", T.plan_labels(F.col("reference_sql")))

    def both(computed: Callable, stored: Callable | None = None) -> F.Column:
        return F.when(F.col("p.parseable"), computed(F.col("p"))).otherwise((stored or computed)(F.col("gold_plan")))

    return rows.select(
        "result_key", both(lambda p: F.array_join(p["relevant_tables"], "|"), lambda p: F.array_join(F.array_sort(p["relevant_tables"]), "|")).alias("tables"), both(lambda p: F.lower(F.array_join(p["join_path"], "|"))).alias("join_path"),
        both(lambda p: p["query_skeleton"]["where"]).alias("has_where"), both(lambda p: p["query_skeleton"]["group_by"]).alias("has_group"), both(lambda p: p["projection_shape"]["selected_count"]).alias("selected_count"),
    )


@query(r"SELECT result_key, order_sensitive OR regexp_matches(reference_sql, '(?i)\slimit\s+\d+[\s;]*(--.*)?$') AS order_sensitive FROM result_rows WHERE gold_plan.parseable")
def order_sensitivity_checked(spark: SparkSession, base: str) -> DataFrame:
    """Whether the reference sorts or limits, or as stored where it is broken, against what is stored with each row."""
    rows = _results(spark, base).where("gold_plan.parseable")
    whole = T.plan_labels(F.col("reference_sql"))["parseable"]
    return rows.select("result_key", F.when(whole, T.order_sensitive(F.col("reference_sql"))).otherwise(F.col("order_sensitive") | F.coalesce(F.col("reference_sql").rlike(r"(?i)\slimit\s+\d+[\s;]*(--.*)?$"), F.lit(False))).alias("order_sensitive"))


@query()
def sql_literals(spark: SparkSession, base: str) -> DataFrame:
    return _results(spark, base).select("result_key", F.posexplode(T.literal_predicates(F.col("reference_sql"))).alias("value_index", "p")).select("result_key", "value_index", "p.*")


@query()
def order_sensitivity(spark: SparkSession, base: str) -> DataFrame:
    return _results(spark, base).groupBy(T.order_sensitive(F.col("reference_sql")).alias("computed"), F.col("order_sensitive").alias("stored")).agg(F.count("*").alias("n_rows"))


@query()
def canonical_statements(spark: SparkSession, base: str) -> DataFrame:
    return _results(spark, base).groupBy(T.canonical_sql(F.col("reference_sql")).alias("canonical")).agg(F.count("*").alias("n_rows"))


@query()
def structured_briefs(spark: SparkSession, base: str) -> DataFrame:
    r = _results(spark, base)
    return r.select("result_key", T.structured_brief(F.try_element_at("messages", F.lit(-1))["content"], F.col("reference_sql")).alias("brief"))


@query()
def schema_validation(spark: SparkSession, base: str) -> DataFrame:
    return C.validated(_results(spark, base)).select("result_key", "check.*")


@query()
def rescored(spark: SparkSession, base: str) -> DataFrame:
    return X.rescore(_results(spark, base)).groupBy("execution_score", "normalized_match", "syntax_valid").agg(F.count("*").alias("n_rows"), F.avg("original_execution_score").alias("mean_original"))


# ---------------------------------------------------------------- failures

_CLASS = "CASE WHEN coalesce(value_execution_score, execution_score) = 1.0 THEN 'correct' WHEN NOT coalesce(syntax_valid, true) THEN 'invalid_sql' WHEN coalesce(score_error, '') <> '' THEN 'execution_error' ELSE 'other' END"


def _staged(spark: SparkSession, base: str) -> DataFrame:
    """Classified results, with every label that compares statements shown as other: what SQL can tell from the stored flags."""
    label = F.when(F.col("error_primary").isin("correct", "invalid_sql", "execution_error"), F.col("error_primary")).otherwise("other")
    return C.classify(_results(spark, base)).withColumn("error_primary", label).withColumn("error_secondary", F.array().cast("array<string>"))


#: Pairs of statements with flags, and the labels they must get: (case, reference, generated, value score, syntax valid, error, turn, primary, secondary).
_CASES = (
    ("right", "SELECT a FROM t", "SELECT b FROM u", 1.0, True, "", 0, "correct", ""),
    ("flagged as invalid", "SELECT a FROM t", "SELECT a FROM t", 0.0, False, "", 0, "invalid_sql", ""),
    ("not parsable", "SELECT a FROM t", "SELECT FROM", 0.0, True, "", 0, "invalid_sql", ""),
    ("failed to run", "SELECT a FROM t", "SELECT a FROM t", 0.0, True, "no such column", 0, "execution_error", ""),
    ("another table", "SELECT count(*) FROM t", "SELECT count(*) FROM u", 0.0, True, "", 0, "schema_link", ""),
    ("another table in a later turn", "SELECT count(*) FROM t", "SELECT count(*) FROM u", 0.0, True, "", 2, "schema_link", "history_resolution"),
    ("another condition of the join", "SELECT count(*) FROM t JOIN u ON t.a = u.a", "SELECT count(*) FROM t JOIN u ON t.b = u.b", 0.0, True, "", 0, "join_path", ""),
    ("another aggregate", "SELECT max(a) FROM t", "SELECT min(a) FROM t", 0.0, True, "", 0, "aggregation", ""),
    ("another grouping", "SELECT count(*) FROM t GROUP BY a", "SELECT count(*) FROM t GROUP BY b", 0.0, True, "", 0, "grain_fanout", ""),
    ("duplicates dropped", "SELECT a FROM t", "SELECT DISTINCT a FROM t", 0.0, True, "", 0, "grain_fanout", ""),
    ("another order", "SELECT a FROM t ORDER BY a", "SELECT a FROM t ORDER BY a DESC", 0.0, True, "", 0, "ordering_limit", ""),
    ("another limit", "SELECT a FROM t LIMIT 3", "SELECT a FROM t LIMIT 5", 0.0, True, "", 1, "ordering_limit", "value_grounding,history_resolution"),
    ("another value", "SELECT a FROM t WHERE b = 'x'", "SELECT a FROM t WHERE b = 'y'", 0.0, True, "", 0, "value_grounding", ""),
    ("another column", "SELECT a FROM t", "SELECT b FROM t", 0.0, True, "", 0, "projection", ""),
    ("columns in another order", "SELECT a, b FROM t", "SELECT b, a FROM t", 0.0, True, "", 3, "projection", ""),
    ("nothing differs", "SELECT a FROM t", "select A from T", 0.0, True, "", 0, "other", ""),
    ("reference not parsable", "SELECT", "SELECT a FROM t", 0.0, True, "", 0, "other", ""),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c[0]}', '{c[7]}', '{c[8]}')" for c in _CASES) + ") AS t(name, error_primary, error_secondary_text)")
def failure_label_cases(spark: SparkSession, base: str) -> DataFrame:
    """Labels of hand-made pairs, one for each rule."""
    rows = spark.createDataFrame([c[:7] for c in _CASES], "name string, reference_sql string, generated_sql string, value_execution_score double, syntax_valid boolean, score_error string, turn_index int")
    return C.classify(rows.withColumn("execution_score", F.lit(0.0))).select("name", "error_primary", "error_secondary_text")


@query(f"SELECT error_primary, count(*) AS n_rows FROM (SELECT {_CLASS} AS error_primary FROM result_rows) GROUP BY 1")
def failure_stages(spark: SparkSession, base: str) -> DataFrame:
    return _staged(spark, base).groupBy("error_primary").agg(F.count("*").alias("n_rows"))


@query()
def failure_labels(spark: SparkSession, base: str) -> DataFrame:
    return C.diagnostics(C.classify(_results(spark, base))).select("result_key", "error_primary", "error_secondary_text", "missing_tables", "extra_tables", "missing_columns", "extra_columns", "table_diff_count", "column_diff_count")


@query()
def failure_pivot(spark: SparkSession, base: str) -> DataFrame:
    return R.error_pivot(C.classify(_results(spark, base)))


@query(f"SELECT model_name, prompt_variant, error_primary, n, round(va, 6) AS value_accuracy, round(sa, 6) AS strict_accuracy, round(ya, 6) AS syntax_accuracy, round(n / sum(n) OVER (PARTITION BY model_name, prompt_variant), 6) AS rate FROM (SELECT model_name, coalesce(prompt_variant, '') AS prompt_variant, {_CLASS} AS error_primary, count(*) AS n, avg(coalesce(value_execution_score, 0)) AS va, avg(coalesce(strict_execution_score, 0)) AS sa, avg(CAST(syntax_valid AS INT)) AS ya FROM result_rows GROUP BY ALL)")
def error_summary(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(C.error_summary(_staged(spark, base)))


@query(f"""SELECT CASE WHEN coalesce(prompt_variant, '') <> '' THEN model_name || '[' || prompt_variant || ']' ELSE model_name END AS run, count(*) AS samples, round(avg(coalesce(value_execution_score, 0)), 6) AS value_accuracy, round(avg(coalesce(strict_execution_score, 0)), 6) AS strict_accuracy, round(avg(CAST(syntax_valid AS INT)), 6) AS syntax_accuracy,
    {', '.join(f"count(*) FILTER (e = '{x}') AS {x}" for x in C.LABELS)}, CAST(0 AS BIGINT) AS history_resolution_turns FROM (SELECT *, {_CLASS} AS e FROM result_rows) GROUP BY 1""")
def error_pivot(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(R.error_pivot(_staged(spark, base)))


@query(f"""SELECT method, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT CASE WHEN e = 'other' THEN 'unresolved_other' ELSE 'recovery' END AS method, count(*) AS n FROM (SELECT {_CLASS} AS e FROM result_rows) WHERE e <> 'correct' GROUP BY 1) GROUP BY 1""")
def method_hints(spark: SparkSession, base: str) -> DataFrame:
    return C.method_hints(_staged(spark, base))


@query()
def column_validity(spark: SparkSession, base: str) -> DataFrame:
    """Generated statements against the columns of their database."""
    cols = V.schema_columns(table(spark, base, "database_schemas")).groupBy("db_id", F.lower("table_name").alias("t")).agg(F.collect_set(F.lower("column_name")).alias("c"))
    allowed = cols.groupBy("db_id").agg(F.map_from_entries(F.collect_list(F.struct("t", "c"))).alias("allowed"))
    out = _results(spark, base).select("result_key", F.lower(F.trim("database_id")).alias("dialog_id"), "generated_sql")
    inputs = allowed.select(F.col("db_id").alias("dialog_id"), "allowed", F.array(F.lit("rowid")).alias("patterns"))
    return C.column_validity(out, inputs).select("result_key", "alias_resolution_success", "schema_valid_sql", "column_validity_match")


@query()
def value_choice(spark: SparkSession, base: str) -> DataFrame:
    """Does the generated statement select the first text that its reference selects?"""
    lit = F.filter(T.literal_predicates(F.col("reference_sql")), lambda p: (p["operator"] == "=") & (p["literal_type"] == "string") & p["table"].isNotNull())
    base_rows = _results(spark, base).select(F.col("result_key").alias("dialog_id"), "generated_sql", F.get(lit, 0).alias("p")).where("p is not null")
    expected = base_rows.select("dialog_id", "p.table", "p.column", F.col("p.literal_value").alias("storage_value"))
    return C.value_choice(base_rows.select("dialog_id", "generated_sql"), expected).groupBy("value_choice_match").agg(F.count("*").alias("n_rows"))


# ---------------------------------------------------------------- roll-ups

_RUN = "count(*) AS n_rows, round(avg(execution_score), 6) AS execution_accuracy, round(avg(coalesce(strict_execution_score, execution_score)), 6) AS strict_execution_accuracy, round(avg(coalesce(value_execution_score, execution_score)), 6) AS value_execution_accuracy, round(avg(CAST(coalesce(syntax_valid, false) AS INT)), 6) AS syntax_accuracy, round(avg(coalesce(generation_latency_ms, 0)), 6) AS mean_generation_latency_ms"


@query(f"SELECT {_RUN} FROM result_rows")
def run_metrics(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(R.run_metrics(_results(spark, base)))


@query(f"SELECT model_name, evaluation_mode, {_RUN} FROM result_rows GROUP BY ALL")
def run_metrics_by_model(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(R.run_metrics(_results(spark, base), ("model_name", "evaluation_mode")))


@query("SELECT model_name, count(*) AS dialog_count, round(coalesce(avg(CASE WHEN dialog_id IS NOT NULL THEN CAST(ok AS INT) END), 0), 6) AS interaction_match_rate FROM (SELECT model_name, dialog_id, bool_and(execution_score = 1.0) AS ok FROM result_rows GROUP BY ALL) GROUP BY 1")
def interaction_match(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(R.interaction_match(_results(spark, base), ("model_name",)))


@query("SELECT model_name, coalesce(prompt_variant, '') AS prompt_variant, source, round(avg(execution_score), 6) AS accuracy, round(avg(strict_execution_score), 6) AS strict_accuracy, round(avg(value_execution_score), 6) AS value_accuracy, round(avg(CAST(syntax_valid AS INT)), 6) AS syntax_accuracy, round(avg(generation_latency_ms), 6) AS mean_latency_ms, count(execution_score) AS samples FROM result_rows GROUP BY ALL")
def group_summary(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(R.group_summary(_results(spark, base)))


@query("""SELECT model_name, prompt_variant, source, round(avg(e), 6) AS dialog_execution_accuracy, round(avg(s), 6) AS dialog_strict_accuracy, round(avg(v), 6) AS dialog_value_accuracy, round(avg(y), 6) AS dialog_syntax_accuracy, round(avg(m), 6) AS interaction_match_rate, count(dialog_id) AS dialogs, CAST(sum(t) AS BIGINT) AS turns
    FROM (SELECT model_name, coalesce(prompt_variant, '') AS prompt_variant, source, dialog_id, avg(execution_score) AS e, avg(strict_execution_score) AS s, avg(value_execution_score) AS v, avg(CAST(syntax_valid AS INT)) AS y, min(CASE WHEN execution_score = 1 THEN 1 ELSE 0 END) AS m, count(execution_score) AS t FROM result_rows GROUP BY ALL) GROUP BY ALL""")
def dialog_summary(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(R.dialog_summary(_results(spark, base)))


@query("SELECT coalesce(split_role, 'unknown') AS value, count(*) AS n_rows FROM prepared_records GROUP BY 1")
def role_histogram(spark: SparkSession, base: str) -> DataFrame:
    return R.histogram(_records(spark, base), "split_role")


@query("SELECT coalesce(prompt_variant, '') AS prompt_variant, round(avg(execution_score), 6) AS accuracy, round(avg(CAST(syntax_valid AS INT)), 6) AS syntax_rate, round(avg(coalesce(generation_latency_ms, 0)), 6) AS mean_latency_ms, count(*) AS samples FROM result_rows GROUP BY 1")
def leaderboard(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(R.leaderboard(_results(spark, base)))


@query("""SELECT model_name, count(*) AS rows_with_usage, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS total_prompt_tokens, CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS total_completion_tokens, CAST(sum(t) AS BIGINT) AS total_tokens, round(avg(coalesce(prompt_tokens, 0)), 6) AS mean_prompt_tokens, round(avg(coalesce(completion_tokens, 0)), 6) AS mean_completion_tokens, round(avg(t), 6) AS mean_total_tokens
    FROM (SELECT *, coalesce(total_tokens, prompt_tokens + completion_tokens) AS t FROM result_rows) WHERE t IS NOT NULL GROUP BY 1""")
def token_rollup(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(R.token_rollup(_results(spark, base), ("model_name",)))


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS n_records, CAST(coalesce(sum(assistant_turn_count), 0) AS BIGINT) AS turns, coalesce(max(assistant_turn_count), 0) AS max_turns, count(*) FILTER (turn_format = 'multi_turn_dialog') AS multi_turn FROM prepared_records GROUP BY 1")
def dataset_composition(spark: SparkSession, base: str) -> DataFrame:
    return R.composition(_records(spark, base))


@query("SELECT value, count(*) AS n_rows FROM (SELECT unnest(list_distinct(gold_plan.relevant_tables)) AS value FROM result_rows) GROUP BY 1")
def referenced_tables(spark: SparkSession, base: str) -> DataFrame:
    return R.element_counts(_results(spark, base).select(F.col("gold_plan.relevant_tables").alias("tables")), "tables")


_DIGEST = """SELECT split_id, count(*) AS split_row_count, CAST(sum(n) AS BIGINT) AS split_eval_turn_count, sha256('[' || string_agg('"' || replace(replace(split_row_id, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"', ',' ORDER BY p, split_row_id) || ']') AS split_row_ids_sha256
    FROM (SELECT split_id, split_row_id, min(record_key) AS p, count(*) AS n FROM prepared_records WHERE split_row_id IS NOT NULL GROUP BY ALL) GROUP BY 1"""


@query(_DIGEST)
def split_integrity(spark: SparkSession, base: str) -> DataFrame:
    return R.split_integrity(_records(spark, base), "record_key", ("split_id",))


@query()
def content_digests(spark: SparkSession, base: str) -> DataFrame:
    return R.set_digest(_results(spark, base), "generated_sql", ("model_name",))


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(windowed_counts(table(spark, base, "events")), 3)


# ---------------------------------------------------------------- runs

_PAIR = f"""WITH s AS (SELECT *, {_CLASS} AS error_primary FROM result_rows), b AS (SELECT * FROM s WHERE model_name = (SELECT min(model_name) FROM result_rows) QUALIFY row_number() OVER (PARTITION BY id ORDER BY result_key DESC) = 1),
    c AS (SELECT * FROM s WHERE model_name = (SELECT max(model_name) FROM result_rows)), o AS (SELECT c.id, coalesce(c.value_execution_score, 0) = 1 AS cok, coalesce(b.value_execution_score, 0) = 1 AS bok, c.error_primary AS ce, b.error_primary AS be FROM c JOIN b USING (id))"""


def _two_runs(spark: SparkSession, base: str, labelled: bool = False) -> tuple[DataFrame, DataFrame]:
    """The runs of the last and of the first model by name."""
    s = _staged(spark, base) if labelled else _results(spark, base).withColumn("error_primary", F.lit(""))
    low, high = _results(spark, base).agg(F.min("model_name"), F.max("model_name")).first()
    return s.where(F.col("model_name") == high), s.where(F.col("model_name") == low)


@query(f"{_PAIR} SELECT count(*) AS samples_compared, count(*) FILTER (cok AND NOT bok) AS fixed_turns, count(*) FILTER (NOT cok AND bok) AS regressed_turns, count(*) FILTER (cok AND bok) AS both_correct, count(*) FILTER (NOT cok AND NOT bok) AS both_wrong, count(*) FILTER (cok AND NOT bok) - count(*) FILTER (NOT cok AND bok) AS net_fixed FROM o")
def pairwise_fixed_regressed(spark: SparkSession, base: str) -> DataFrame:
    return P.pairwise_summary(P.pairwise(*_two_runs(spark, base)))


@query(f"{_PAIR} SELECT CASE WHEN cok THEN 'fixed' ELSE 'regressed' END AS outcome, CASE WHEN cok THEN be ELSE ce END AS error_primary, count(*) AS n_rows FROM o WHERE cok <> bok GROUP BY ALL")
def pairwise_errors(spark: SparkSession, base: str) -> DataFrame:
    return P.pairwise_errors(P.pairwise(*_two_runs(spark, base, labelled=True)))


_IDS = "dialog_id, turn_index, database_id"


@query(f"""WITH a AS (SELECT {_IDS}, count(*) AS n_a FROM result_rows WHERE model_name = (SELECT max(model_name) FROM result_rows) GROUP BY ALL), b AS (SELECT {_IDS}, count(*) AS n_b FROM result_rows WHERE model_name = (SELECT min(model_name) FROM result_rows) GROUP BY ALL)
    SELECT coalesce(a.dialog_id, b.dialog_id) AS dialog_id, coalesce(a.turn_index, b.turn_index) AS turn_index, coalesce(a.database_id, b.database_id) AS database_id, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b
    FROM a FULL JOIN b ON a.dialog_id IS NOT DISTINCT FROM b.dialog_id AND a.turn_index = b.turn_index AND a.database_id IS NOT DISTINCT FROM b.database_id WHERE coalesce(n_a, 0) <> coalesce(n_b, 0)""")
def row_identity_mismatch(spark: SparkSession, base: str) -> DataFrame:
    return P.identity_mismatches(*_two_runs(spark, base), ("dialog_id", "turn_index", "database_id"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_identities(spark: SparkSession, base: str) -> DataFrame:
    return P.duplicate_identities(table(spark, base, "lineitem"), ("l_orderkey", "l_linenumber"))


@query("SELECT result_key FROM result_rows WHERE dialog_id IS NULL OR turn_index IS NULL OR database_id IS NULL OR reference_sql IS NULL")
def missing_identity(spark: SparkSession, base: str) -> DataFrame:
    return P.missing_identity(_results(spark, base), P.IDENTITY).select("result_key")


@query("""SELECT 'has a reference' AS rule, count(*) FILTER (reference_sql IS NULL) AS n_rows FROM result_rows UNION ALL SELECT 'score in range', count(*) FILTER (NOT coalesce(execution_score BETWEEN 0 AND 1, false)) FROM result_rows
    UNION ALL SELECT 'turn below count', count(*) FILTER (NOT coalesce(turn_index < turn_count, false)) FROM result_rows UNION ALL SELECT 'value score present', count(*) FILTER (value_execution_score IS NULL) FROM result_rows""")
def rule_violations(spark: SparkSession, base: str) -> DataFrame:
    c = F.col
    rules = {"has a reference": c("reference_sql").isNotNull(), "score in range": c("execution_score").between(0, 1), "turn below count": c("turn_index") < c("turn_count"), "value score present": c("value_execution_score").isNotNull()}
    return P.violations(_results(spark, base), rules)


_ONE = "SELECT count(*) AS n_rows, avg(execution_score) AS e, avg(coalesce(value_execution_score, execution_score)) AS v, avg(CAST(coalesce(syntax_valid, false) AS INT)) AS y FROM result_rows WHERE model_name = (SELECT {0}(model_name) FROM result_rows)"


@query(f"""WITH t AS ({_ONE.format('max')}), c AS ({_ONE.format('min')}) SELECT t.n_rows, round(t.e, 6) AS execution_accuracy, round(c.e, 6) AS control_execution_accuracy, round(t.e - c.e, 6) AS execution_accuracy_delta_vs_control, round(t.v - c.v, 6) AS value_execution_accuracy_delta_vs_control, round(t.y - c.y, 6) AS syntax_accuracy_delta_vs_control FROM t, c""")
def run_deltas(spark: SparkSession, base: str) -> DataFrame:
    t, c = (R.run_metrics(x) for x in _two_runs(spark, base))
    names = ("execution_accuracy", "value_execution_accuracy", "syntax_accuracy")
    out = P.compare_metrics(t, c, names, "control")
    return _rounded(out.select("n_rows", "execution_accuracy", "control_execution_accuracy", *[f"{n}_delta_vs_control" for n in names]))


_GAP = "(SELECT avg(execution_score) FROM result_rows WHERE model_name = (SELECT {0}(model_name) FROM result_rows) AND turn_index {1} 0)"


@query(f"SELECT round(o0 - l0, 6) AS normal_gap, round(o1 - l1, 6) AS treated_gap, round(o1 - l1 - o0 + l0, 6) AS gap_delta, round(l1 - l0, 6) AS local_delta, round(o1 - o0, 6) AS other_delta FROM (SELECT {_GAP.format('max', '=')} AS l0, {_GAP.format('max', '>')} AS l1, {_GAP.format('min', '=')} AS o0, {_GAP.format('min', '>')} AS o1)")
def context_gap(spark: SparkSession, base: str) -> DataFrame:
    """The gap between two models on first and on later turns."""
    local, other = _two_runs(spark, base)
    m = lambda df, c: R.run_metrics(df.where(c))
    return _rounded(P.context_gap(m(local, "turn_index = 0"), m(local, "turn_index > 0"), m(other, "turn_index = 0"), m(other, "turn_index > 0"), "execution_accuracy"))


# ---------------------------------------------------------------- splits


@query("SELECT split_id, problem FROM (SELECT split_id, unnest([CASE WHEN coalesce(trim(source_split), '') = '' THEN 'missing source_split' END, CASE WHEN coalesce(trim(leakage_boundary), '') = '' THEN 'missing leakage_boundary' END, CASE WHEN schema_version IS DISTINCT FROM 1 THEN 'schema_version' END, CASE WHEN NOT coalesce(role IN ('train', 'validation', 'proxy_dev_seen', 'clean_local_holdout', 'external_target'), false) THEN 'unknown role' END, CASE WHEN NOT coalesce(status = 'ready', false) THEN 'status not ready' END]) AS problem FROM split_manifests) WHERE problem IS NOT NULL")
def manifest_problems(spark: SparkSession, base: str) -> DataFrame:
    return I.check_manifests(table(spark, base, "split_manifests"))


@query("SELECT r.split_id, coalesce(split_role, '') AS split_role, count(*) AS n_rows FROM prepared_records r LEFT JOIN (SELECT * REPLACE (CASE WHEN role = 'train' THEN 'changed' ELSE source_sha256 END AS source_sha256) FROM split_manifests) m USING (split_id) WHERE r.split_id IS NOT NULL AND (m.role IS NULL OR m.role IS DISTINCT FROM lower(trim(split_role)) OR m.source_sha256 IS DISTINCT FROM r.split_source_sha256) GROUP BY ALL")
def stamp_mismatches(spark: SparkSession, base: str) -> DataFrame:
    """Against manifests whose training sources have changed since the records were stamped."""
    manifests = table(spark, base, "split_manifests")
    return I.unstamped(_records(spark, base), manifests.withColumn("source_sha256", F.when(F.col("role") == "train", "changed").otherwise(F.col("source_sha256"))))


_ROLE = "lower(trim(split_role))"


@query(f"SELECT DISTINCT split_row_id FROM prepared_records WHERE {_ROLE} = 'proxy_dev_seen' AND split_row_id IN (SELECT split_row_id FROM prepared_records WHERE {_ROLE} = 'clean_local_holdout')")
def split_disjointness(spark: SparkSession, base: str) -> DataFrame:
    r = _records(spark, base)
    return I.shared_rows(r.where(f"{_ROLE} = 'proxy_dev_seen'"), r.where(f"{_ROLE} = 'clean_local_holdout'"), "split_row_id")


@query(f"SELECT DISTINCT database_id FROM prepared_records WHERE {_ROLE} = 'train' AND database_id IN (SELECT database_id FROM prepared_records WHERE {_ROLE} <> 'train')")
def split_shared_databases(spark: SparkSession, base: str) -> DataFrame:
    r = _records(spark, base)
    return I.shared_rows(r.where(f"{_ROLE} = 'train'"), r.where(f"{_ROLE} <> 'train'"), "database_id")


def _span(spark: SparkSession, base: str) -> tuple[int, int]:
    """The whole range of the records' keys."""
    low, high = _records(spark, base).agg(F.min("record_key"), F.max("record_key")).first()
    return (low, high + 1) if low is not None else (0, 0)


@query("SELECT record_key, 'dialogs_dev:' || lpad(CAST(record_key AS VARCHAR), 4, '0') || ':' || coalesce(database_id, '') AS split_row_id FROM prepared_records")
def split_selection(spark: SparkSession, base: str) -> DataFrame:
    return I.split_row_ids(I.select_range(_records(spark, base), "record_key", *_span(spark, base)), index="record_key", split="dev").select("record_key", "split_row_id")


@query("""WITH s AS (SELECT record_key, database_id, assistant_turn_count, 'dialogs_dev:' || lpad(CAST(record_key AS VARCHAR), 4, '0') || ':' || coalesce(database_id, '') AS split_row_id FROM prepared_records)
    SELECT count(*) AS n_rows, count(DISTINCT database_id) AS n_databases, CAST(coalesce(sum(assistant_turn_count), 0) AS BIGINT) AS turn_count, sha256('[' || string_agg('"' || split_row_id || '"', ',' ORDER BY record_key) || ']') AS row_ids_sha256 FROM s""")
def split_manifest(spark: SparkSession, base: str) -> DataFrame:
    rows = I.split_row_ids(I.select_range(_records(spark, base), "record_key", *_span(spark, base)), index="record_key", split="dev")
    return I.split_manifest(rows, "record_key")


# ---------------------------------------------------------------- SQL surface

_SQL = {
    "sql_inner_join": "SELECT n_name, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_aggregates": "SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS n_types, min(p_size) AS least, max(p_size) AS most, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY p_brand",
    "sql_having": "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sql_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "sql_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "sql_in_list": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0",
    "sql_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "sql_union": "SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_except": "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0",
    "sql_derived_table": "SELECT s, count(*) AS n FROM (SELECT o_custkey, max(o_orderstatus) AS s FROM orders GROUP BY o_custkey) AS x GROUP BY s",
    "sql_scalar_subquery": "SELECT p_partkey FROM part WHERE p_size > (SELECT avg(p_size) FROM part)",
}


#: In SQLite's dialect, each with the same in DuckDB's.
_DIALECT = {
    "sql_strftime": ("```sql\nSELECT strftime('%Y-%m', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY strftime('%Y-%m', o_orderdate);\n```", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1"),
    "sql_window": ("SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer", None),
    "sql_left_join": ("SELECT n.n_name, count(s.s_suppkey) AS n_suppliers FROM nation AS n LEFT JOIN supplier AS s ON n.n_nationkey == s.s_nationkey GROUP BY n.n_name", "SELECT n_name, count(s_suppkey) AS n_suppliers FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name"),
    "sql_like_ignores_case": ("The query is: SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'build%' OR c_mktsegment > = \"MACHINERY\" ;", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%' OR c_mktsegment >= 'MACHINERY'"),
    "sql_limit_offset": ("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 5, 10", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 5"),
    "sql_glob": ("SELECT p_partkey, p_brand FROM part WHERE p_brand GLOB '*#1?'", "SELECT p_partkey, p_brand FROM part WHERE p_brand GLOB '*#1?'"),
}


def _surface(name: str, sql: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, base: str) -> DataFrame:
        register(spark, base, ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"])
        return X.run_query(spark, sql)

    run.__name__ = name
    query(oracle or sql)(run)


for _name, _text in _SQL.items():
    _surface(_name, _text)
for _name, (_text, _other) in _DIALECT.items():
    _surface(_name, _text, _other)


def _comparison(spark: SparkSession, base: str, cases: list[tuple[str, str, str]]) -> DataFrame:
    register(spark, base, ["nation", "customer", "part", "orders"])
    rows = [(n, (s := X.score_pair(a, b, lambda q: X.run_query(spark, q))).value_execution_score == 1.0, s.strict_execution_score == 1.0, s.order_sensitive, s.syntax_valid) for n, a, b in cases]
    return spark.createDataFrame(rows, "name string, value_match boolean, strict_match boolean, order_sensitive boolean, syntax_valid boolean")


@query("""SELECT * FROM (VALUES ('same rows', true, true, false, true), ('another label', true, false, false, true), ('duplicates count', false, false, false, true), ('order counts', false, false, true, true), ('not parsable', false, false, false, false), ('close numbers', true, true, false, true)) AS t(name, value_match, strict_match, order_sensitive, syntax_valid)""")
def result_comparison(spark: SparkSession, base: str) -> DataFrame:
    """Scores of pairs of statements whose relation is known, on the whole tables."""
    seg = "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"
    return _comparison(spark, base, [
        ("same rows", seg, seg + " ORDER BY n"), ("another label", seg, seg.replace("AS n", "AS m")), ("duplicates count", "SELECT c_mktsegment FROM customer", "SELECT DISTINCT c_mktsegment FROM customer"),
        ("order counts", "SELECT n_name FROM nation ORDER BY n_name", "SELECT n_name FROM nation ORDER BY n_name DESC"), ("not parsable", seg, "SELECT FROM"),
        ("close numbers", "SELECT p_partkey, p_retailprice FROM part", "SELECT p_partkey, p_retailprice + 0.0000001 AS p_retailprice FROM part"),
    ])
