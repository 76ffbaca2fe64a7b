"""Value index, retrieval of values a text mentions, grounding of literals, and their roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from sparlance.functions import text as T
from sparlance.operators.dialogs import dialog_key


def build_index(tables: dict[str, DataFrame], database: str, max_values: int = 200, max_length: int = 120) -> DataFrame:
    """Index entries of every column of every table: the most frequent texts, their normal form and aliases.

    One scan per table: columns are unpivoted as texts, so all are counted in one grouped pass. Nulls, blanks
    and texts longer than max_length are left out; the top max_values of a column are taken by (frequency,
    text) before values without a normal form are dropped. Values are trimmed after counting, so two may come
    out alike. Binary columns are skipped. A table without rows gives no entry.
    """

    def one(name: str, df: DataFrame) -> DataFrame:
        fields = [f.name for f in df.schema.fields if isinstance(f.dataType, (t.AtomicType,)) and not isinstance(f.dataType, t.BinaryType)]
        texts = df.select(*[F.col(c).cast("string").alias(c) for c in fields])
        return texts.unpivot([], fields, "column", "value").select(F.lit(name).alias("table"), "column", "value")

    cells = reduce(DataFrame.unionByName, [one(n, df) for n, df in tables.items()])
    kept = cells.where("value is not null and trim(value) <> '' and length(value) <= " + str(max_length))
    counted = kept.groupBy("table", "column", "value").agg(F.count("*").alias("source_frequency"))
    best = Window.partitionBy("table", "column").orderBy(F.desc("source_frequency"), F.asc("value"))
    top = counted.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= max_values)
    raw, norm = F.trim("value"), T.normalize_token(F.trim("value"))
    rows = top.select(F.lit(database).alias("database_id"), "table", "column", raw.alias("raw_value"), norm.alias("normalized_value"), "source_frequency").where("normalized_value <> ''")
    return rows.withColumn("aliases", T.aliases_of(F.col("raw_value"), F.col("normalized_value"))).withColumn("id", T.entry_id(*[F.col(c) for c in ("database_id", "table", "column", "raw_value", "normalized_value")]))


def star_index(spark: SparkSession, base: str, names: tuple[str, ...], **limits: int) -> DataFrame:
    return build_index({n: spark.read.parquet(f"{base}/{n}.parquet") for n in names}, "star", **limits)


def index_summary(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count("*").alias("entries"), F.count_distinct("database_id").alias("databases"), F.count_distinct("database_id", "table").alias("tables"),
        F.count_distinct("database_id", "table", "column").alias("columns"), F.coalesce(F.sum(F.size("aliases")), F.lit(0)).alias("aliases"),
    )


def coverage(index: DataFrame, labels: DataFrame) -> DataFrame:
    """labels with `value_hit` and `mention_hit`: is the resolved value, or the mention, an alias of its column?

    Keys are (database, table, column, normal alias), made distinct before the join, so no label is repeated.
    A label without a table never hits.
    """
    keys = index.select("database_id", F.lower("table").alias("table"), T.column_tail(F.col("column")).alias("column"), F.explode("aliases").alias("a"))
    keys = keys.select("database_id", "table", "column", T.normalize_token(F.col("a")).alias("token")).where("token <> ''").distinct()

    def hit(df: DataFrame, value: str, out: str) -> DataFrame:
        right = keys.select(*[F.col(c).alias(f"_{c}") for c in keys.columns], F.lit(True).alias(out))
        on = [F.col("database_id") == F.col("_database_id"), F.lower("resolved_table") == F.col("_table"), T.column_tail(F.col("resolved_column")) == F.col("_column"), T.normalize_token(F.col(value)) == F.col("_token")]
        return df.join(right, on, "left").drop("_database_id", "_table", "_column", "_token").withColumn(out, F.coalesce(out, F.lit(False)))

    return hit(hit(labels, "resolved_value", "value_hit"), "mention_text", "mention_hit")


def coverage_rates(covered: DataFrame) -> DataFrame:
    n = F.count("*")
    rate = lambda c: F.when(n > 0, F.count_if(c) / n).otherwise(0.0)
    return covered.agg(n.alias("label_count"), F.count_if("value_hit").alias("value_hits"), F.count_if("mention_hit").alias("mention_hits"), rate(F.col("value_hit")).alias("value_rate"), rate(F.col("mention_hit")).alias("mention_rate"))


def missing_examples(covered: DataFrame, position: str, hit: str = "value_hit", n: int = 5) -> DataFrame:
    """The first n labels, by position, that do not hit; a report, so the limit is the feature."""
    return covered.where(~F.col(hit)).orderBy(position).limit(n)


def user_turns(records: DataFrame, key: str = "record_key", scope: str = "current_turn") -> DataFrame:
    """(key, database_id, message_index, user_turn, text): the user's text of each turn, or all of it so far."""
    if scope not in ("current_turn", "history"):
        raise ValueError("scope must be current_turn or history")
    users = F.filter(F.transform("messages", lambda m, i: F.struct(i.alias("i"), m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"))), lambda m: m["role"] == "user")
    rows = records.where("messages is not null").select(F.col(key), "database_id", users.alias("_u")).select("*", F.posexplode("_u").alias("user_turn", "_m"))
    text = F.col("_m.content") if scope == "current_turn" else F.array_join(F.transform(F.slice("_u", 1, F.col("user_turn") + 1), lambda m: m["content"]), "\n")
    return rows.select(key, "database_id", F.col("_m.i").alias("message_index"), "user_turn", text.alias("text"))


def retrieve(turns: DataFrame, index: DataFrame, keys: list[str], *, max_matches: int = 4, min_chars: int = 3, max_words: int = 6, same_database: bool = True) -> DataFrame:
    """(keys, rank, table, column, raw_value, matched_alias, source_frequency): the values that a text mentions.

    An alias matches if its words are a run of the text's words. Texts give their word runs, up to
    max_words long, and these are joined with the aliases by equality, so nothing is compared pair by pair.
    Aliases of more words are joined on their first max_words words and compared after that. An entry
    counts once, by its first alias; entries are ranked by (frequency, table, column, value).
    """
    db = ["database_id"] if same_database else []
    cols = ["table", "column", "raw_value", "source_frequency"]
    entries = index.select(*db, *cols, F.posexplode("aliases").alias("alias_at", "alias")).withColumn("token", T.normalize_token(F.col("alias")))
    entries = entries.where(~T.prunable_alias(F.col("token"), min_chars) & (F.col("token") != "")).withColumn("words", F.split("token", " "))
    longest = entries.agg(F.max(F.size("words"))).first()[0] or 1  # runs longer than any alias are of no use
    max_words = min(max_words, longest)
    entries = entries.withColumn("gram", F.array_join(F.slice("words", 1, max_words), " ")).withColumn("n", F.least(F.size("words"), F.lit(max_words)))
    spoken = turns.select(*keys, *[c for c in db if c not in keys], T.normalize_token(F.col("text")).alias("normal")).withColumn("w", F.split("normal", " "))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max_words)), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice(F.col("w"), i, n), " "))).otherwise(F.array().cast("array<string>"))))
    grams = spoken.select(*keys, *[c for c in db if c not in keys], "normal", F.explode(F.array_distinct(runs)).alias("gram"))
    found = grams.join(entries, [*db, "gram"]).where(T.whole_token_match(F.col("normal"), F.col("token")))
    per_entry = found.groupBy(*keys, *cols).agg(F.min_by("alias", "alias_at").alias("matched_alias"))
    order = Window.partitionBy(*keys).orderBy(F.desc("source_frequency"), "table", "column", "raw_value")
    return per_entry.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_matches)


def retrieval_blocks(matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block): the text block that shows a turn's matches in order."""
    line = F.concat(F.lit("- "), F.concat_ws(".", "table", "column"), F.lit(" = "), F.to_json(F.struct("raw_value")), F.lit(" (matched: "), F.col("matched_alias"), F.lit(")"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])  # at most max_matches lines
    return matches.groupBy(*keys).agg(F.concat_ws("\n", F.lit("Database values that the user's text mentions:"), lines).alias("block"))


def inject_blocks(records: DataFrame, blocks: DataFrame, key: str = "record_key") -> DataFrame:
    """Records with each block at the end of its user message; blocks are (key, message_index, block)."""
    per_record = blocks.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("message_index", "block"))).alias("_b"))
    joined = records.join(per_record, key, "left")
    with_block = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), F.concat_ws("\n\n", m["content"], F.element_at("_b", i)).alias("content")))
    return joined.withColumn("messages", F.when(F.col("_b").isNull(), F.col("messages")).otherwise(with_block)).drop("_b")


def retrieval_summary(turns: DataFrame, matches: DataFrame, key: str = "record_key", turn: str = "user_turn") -> DataFrame:
    """Rows, turns and values matched, by database; a null database is shown as ""."""
    n = matches.groupBy(key, turn).agg(F.count("*").alias("n"))
    rows = turns.select(key, turn, F.coalesce("database_id", F.lit("")).alias("database_id")).join(n, [key, turn], "left")
    return rows.groupBy("database_id").agg(F.count_distinct(key).alias("rows"), F.count("*").alias("user_turns"), F.count_distinct(F.when(F.col("n") > 0, F.col(key))).alias("matched_rows"), F.count("n").alias("matched_turns"), F.coalesce(F.sum("n"), F.lit(0)).alias("matched_values"))


def grounded_literals(records: DataFrame, key: str = "record_key") -> DataFrame:
    """One row per literal predicate of each answer, with where the user or an earlier answer mentions the literal.

    The statuses are tried in order: current turn, earlier user text, earlier statements, nowhere. History
    is part of the record's own row, so no window or shuffle is needed.
    """
    role = lambda m: m["role"]
    said = lambda m: F.coalesce(m["content"], F.lit(""))
    numbered = F.transform("messages", lambda m, i: F.struct(i.alias("i"), role(m).alias("role"), said(m).alias("content")))
    base = records.where("messages is not null").select(F.col(key), F.coalesce("database_id", F.lit("unknown")).alias("database_id"), dialog_key(F.col(key)).alias("dialog_id"), "messages", numbered.alias("_m"))
    turns = base.select("*", F.posexplode(F.filter("_m", lambda m: m["role"] == "assistant")).alias("turn_index", "_a"))
    before = F.slice("_m", 1, F.col("_a.i"))
    users = F.transform(F.filter(before, lambda m: m["role"] == "user"), lambda m: m["content"])
    prior = F.array_join(F.transform(F.filter(before, lambda m: m["role"] == "assistant"), lambda m: m["content"]), "\n")
    texts = turns.select(key, "dialog_id", "database_id", "turn_index", F.col("_a.content").alias("reference_sql"), F.coalesce(F.element_at(F.concat(F.array(F.lit("")), users), -1), F.lit("")).alias("current"), F.array_join(F.slice(users, 1, F.greatest(F.size(users) - 1, F.lit(0))), "\n").alias("history"), prior.alias("prior"))
    rows = texts.select("*", F.posexplode(T.literal_predicates(F.col("reference_sql"))).alias("value_index", "p"))
    v = F.col("p.literal_value")
    now, past, sql = (T.exact_mention(F.col(c), v) for c in ("current", "history", "prior"))
    status = F.when(now.isNotNull(), "exact_in_current_turn").when(past.isNotNull(), "exact_in_history").when(sql.isNotNull(), "carried_from_prior_sql").otherwise("missing_from_user_text")
    return rows.select(
        key, F.concat_ws(":", "dialog_id", F.col("turn_index").cast("string"), F.col("value_index").cast("string")).alias("id"), "dialog_id", "turn_index", "value_index", "database_id",
        F.col("p.table").alias("resolved_table"), F.col("p.column").alias("resolved_column"), F.col("p.operator").alias("operator"), v.alias("resolved_value"), F.col("p.literal_type").alias("literal_type"),
        status.alias("mention_status"), F.coalesce(now, past, sql).alias("mention_text"),
    ).withColumns({
        "requires_context_carryover": F.col("mention_status").isin("exact_in_history", "carried_from_prior_sql"),
        "requires_value_normalization": F.col("mention_status").isin("missing_from_user_text", "carried_from_prior_sql"),
    })


def grounding_summary(labels: DataFrame) -> DataFrame:
    """The nine counters of a set of grounded literals."""
    is_ = lambda s: F.count_if(F.col("mention_status") == s).alias(f"{s}_count")
    return labels.agg(
        F.count("*").alias("value_reference_count"), F.count_distinct("dialog_id", "turn_index").alias("dialog_turn_count"), F.count_distinct("database_id").alias("database_count"),
        is_("exact_in_current_turn"), is_("exact_in_history"), is_("carried_from_prior_sql"), is_("missing_from_user_text"),
        F.count_if("requires_context_carryover").alias("requires_context_carryover_count"), F.count_if("requires_value_normalization").alias("requires_value_normalization_count"),
    )


# ---------------------------------------------------------------- schemas

# Fixed: words of declared types, by semantic type.
NUMBER, TIME, BOOLEAN = ("number", "integer", "int", "float", "double", "real", "decimal"), ("time", "date", "datetime", "timestamp"), ("boolean", "bool")


def semantic_type(declared: Column) -> Column:
    d = F.lower(declared)
    return F.when(d.isin(*NUMBER), "number").when(d.isin(*TIME), "time").when(d.isin(*BOOLEAN), "boolean").otherwise("string")


def schema_columns(schemas: DataFrame) -> DataFrame:
    """(db_id, table_index, table_name, column_index, column_name, column_type, is_primary) of every column but the star.

    A missing type is text. Null arrays count as empty.
    """
    c = schemas.select("db_id", "table_names_original", "column_types", "primary_keys", F.posexplode("column_names_original").alias("column_index", "c"))
    typed = F.coalesce(F.get("column_types", F.col("column_index")), F.lit("text"))
    rows = c.where("c.table_idx >= 0").select(
        "db_id", F.col("c.table_idx").alias("table_index"), F.get("table_names_original", F.col("c.table_idx")).alias("table_name"), "column_index", F.col("c.name").alias("column_name"),
        typed.alias("column_type"), F.coalesce(F.array_contains("primary_keys", F.col("column_index")), F.lit(False)).alias("is_primary"),
    )
    return rows


def _per_table(schemas: DataFrame, line: Column, out: str) -> DataFrame:
    """The line of every column, in order, as one text per table; a table's columns are one schema's, so few."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("column_index", line.alias("s")))), lambda x: x["s"])
    return schema_columns(schemas).groupBy("db_id", "table_index").agg(F.array_join(parts, ", ").alias(out))


def schema_text(schemas: DataFrame) -> DataFrame:
    """(db_id, schema_text): a `table(column type, ...)` line per table, tables without columns too."""
    tables = schemas.select("db_id", F.posexplode("table_names_original").alias("table_index", "table_name"))
    cols = _per_table(schemas, F.concat_ws(" ", "column_name", "column_type"), "cols")
    line = F.concat(F.col("table_name"), F.lit("("), F.coalesce("cols", F.lit("")), F.lit(")"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("table_index", line.alias("s")))), lambda x: x["s"])
    return tables.join(cols, ["db_id", "table_index"], "left").groupBy("db_id").agg(F.array_join(lines, "\n").alias("schema_text"))


def foreign_keys(schemas: DataFrame) -> DataFrame:
    """(db_id, from_index, from_table, from_column, to_table, to_column) of the keys whose ends exist."""
    fk = schemas.select("db_id", "table_names_original", "column_names_original", F.posexplode("foreign_keys").alias("fk_at", "fk"))
    col = lambda i: F.get("column_names_original", i)
    rows = fk.select("db_id", "fk_at", "table_names_original", col(F.get("fk", 0)).alias("a"), col(F.get("fk", 1)).alias("b")).where("a.table_idx >= 0 and b.table_idx >= 0")
    name = lambda x: F.get("table_names_original", F.col(f"{x}.table_idx"))
    return rows.select("db_id", "fk_at", F.col("a.table_idx").alias("table_index"), name("a").alias("from_table"), F.col("a.name").alias("from_column"), name("b").alias("to_table"), F.col("b.name").alias("to_column"))


def semantic_text(schemas: DataFrame) -> DataFrame:
    """(db_id, semantic_text): cubes with grain, typed dimensions, default measures and many-to-one joins."""
    kind = semantic_type(F.col("column_type"))
    low = F.lower("column_name")
    is_id = low.isin("id", "uid") | low.endswith("_id") | low.endswith(" id")
    dim = F.concat(F.col("column_name"), F.lit(" ["), kind, F.when(F.col("is_primary"), ", primary_key").otherwise(""), F.lit("]"))
    snake = F.replace(low, F.lit(" "), F.lit("_"))
    measure = F.when((kind == "number") & ~F.col("is_primary") & ~is_id, F.concat(F.lit("sum_"), snake, F.lit("=sum("), "column_name", F.lit("), avg_"), snake, F.lit("=avg("), "column_name", F.lit(")")))
    ordered = lambda c: F.array_join(F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("column_index", c.alias("s")))), lambda x: x["s"])), ", ")
    cols = schema_columns(schemas).groupBy("db_id", "table_index").agg(ordered(dim).alias("dims"), ordered(measure).alias("sums"), ordered(F.when(F.col("is_primary"), F.col("column_name"))).alias("pk"))
    link = F.concat(F.concat_ws(".", "from_table", "from_column"), F.lit(" -> "), F.concat_ws(".", "to_table", "to_column"), F.lit(" (many_to_one)"))
    joins = foreign_keys(schemas).groupBy("db_id", "table_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fk_at", link.alias("s")))), lambda x: x["s"]), ", ").alias("joins"))
    tables = schemas.select("db_id", F.posexplode("table_names_original").alias("table_index", "table_name"))
    full = tables.join(cols, ["db_id", "table_index"], "left").join(joins, ["db_id", "table_index"], "left")
    grain = F.concat(F.lit("one row per "), "table_name", F.when(F.col("pk") != "", F.concat(F.lit("; primary key: "), "pk")).otherwise(""))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("- Cube "), "table_name", F.lit(" (grain: "), grain, F.lit(")")), F.when(F.col("dims") != "", F.concat(F.lit("  Dimensions: "), "dims")),
        F.concat(F.lit("  Measures: count"), F.when(F.col("sums") != "", F.concat(F.lit(", "), "sums")).otherwise("")), F.concat(F.lit("  Joins: "), "joins"),
    )
    return full.groupBy("db_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_index", lines.alias("s")))), lambda x: x["s"]), "\n").alias("semantic_text"))


def column_context(schemas: DataFrame) -> DataFrame:
    """(db_id, block, table_count, column_count, join_key_count): allowed columns and join keys as a prompt block."""
    cols = schema_columns(schemas).groupBy("db_id", "table_index", "table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("column_index", "column_name"))), lambda x: x["column_name"]).alias("names"))
    line = F.concat(F.lit("- "), "table_name", F.lit(": "), F.array_join("names", ", "))
    per_db = cols.groupBy("db_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_name", line.alias("s")))), lambda x: x["s"]), "\n").alias("allowed"), F.count("*").alias("table_count"), F.sum(F.size("names")).alias("column_count"))
    key = F.concat(F.concat_ws(".", "from_table", "from_column"), F.lit(" = "), F.concat_ws(".", "to_table", "to_column"))
    keys = foreign_keys(schemas).groupBy("db_id").agg(F.array_sort(F.collect_list(key)).alias("keys"))
    full = per_db.join(keys, "db_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    shown = F.concat_ws(
        "\n", F.lit("Column roles (from the schema only):"), F.lit("Allowed columns:"), "allowed",
        F.when(F.size("keys") > 0, F.concat(F.lit("Join keys:\n"), F.array_join(F.transform("keys", lambda k: F.concat(F.lit("- "), k)), "\n"))), F.lit("Use only the listed table.column references."),
    )
    return full.select("db_id", shown.alias("block"), "table_count", "column_count", F.size("keys").alias("join_key_count"))
