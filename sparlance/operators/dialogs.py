"""Operators on conversations: formatting, turn expansion, prompts, candidates, leakage, rollout."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparlance.functions import text as T
from sparlance.plans import sqltree

# Fixed texts of the conversation format.
SQL_ONLY = "Return only the SQL query, without explanation."
PLAN_MARKERS = ("Oracle SQL planning hints", "SQL planning hints:")
MESSAGE = "struct<role:string,content:string>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_prompt(question: Column, *, schema: Column | None = None, semantic: Column | None = None, database: Column | None = None) -> Column:
    """Labelled blocks joined by blank lines; a null or empty block is left out."""
    block = lambda label, c: F.when(c != "", F.concat(F.lit(label), c)) if c is not None else F.lit(None).cast("string")
    return F.concat_ws("\n\n", block("Database: ", database), block("Schema/context:\n", schema), block("Semantic model:\n", semantic), F.concat(F.lit("Question:\n"), question))


def format_single(df: DataFrame, question: str, answer: str, system: str, *, schema: str | None = None, evidence: str | None = None, semantic: str | None = None, database: str | None = None) -> DataFrame:
    """Rows of a flat question and answer source as `messages`, with `error` naming the first missing field.

    With `evidence`, a non-empty evidence text is shown as the schema block. Rows with an error have null messages.
    """
    c = lambda n: F.col(n) if n else None
    shown = F.when(F.col(evidence) != "", F.concat(F.lit("Evidence:\n"), F.col(evidence))) if evidence else c(schema)
    required = [n for n in (question, schema, answer) if n]
    missing = F.coalesce(*[F.when(F.col(n).isNull() | (F.col(n) == ""), F.lit(n)) for n in required])
    messages = F.array(message("system", F.lit(system)), message("user", user_prompt(F.col(question), schema=shown, semantic=c(semantic), database=c(database))), message("assistant", F.col(answer)))
    return df.withColumn("error", missing).withColumn("messages", F.when(missing.isNull(), messages))


def format_interactions(df: DataFrame, turns: str, system: str, *, schema: str | None = None, semantic: str | None = None, database: str | None = None) -> DataFrame:
    """Rows with an array of {question, query} turns as `messages`; turns lacking either are dropped.

    Context blocks go to turn 0 only, and are lost if turn 0 is dropped. Without a usable turn messages are null.
    """
    c = lambda n: F.col(n) if n else F.lit(None).cast("string")
    kept = F.filter(F.transform(turns, lambda t, i: F.struct(i.alias("i"), t["question"].alias("q"), t["query"].alias("a"))), lambda t: (t["q"] != "") & (t["a"] != ""))
    first = lambda t, n: F.when(t["i"] == 0, c(n))
    spoken = F.flatten(F.transform(kept, lambda t: F.array(message("user", user_prompt(t["q"], schema=first(t, schema), semantic=first(t, semantic), database=first(t, database))), message("assistant", t["a"]))))
    return df.withColumn("messages", F.when(F.size(kept) > 0, F.concat(F.array(message("system", F.lit(system))), spoken)))


FORMATTERS: dict[str, Callable[..., DataFrame]] = {"single": format_single, "interactions": format_interactions}


def _role(m: Column) -> Column:
    return m["role"]


def answers(messages: Column) -> Column:
    return F.filter(messages, lambda m: _role(m) == "assistant")


def wrap_records(df: DataFrame) -> DataFrame:
    """Adds counts, turn format and history policy; rows with fewer than three messages get null in them."""
    n = F.size(answers(F.col("messages")))
    enough = F.size("messages") >= 3
    return df.withColumns({
        "assistant_turn_count": F.when(enough, n),
        "turn_format": F.when(enough, F.when(n > 1, "multi_turn_dialog").otherwise("single_turn")),
        "history_policy": F.when(enough, F.when(n > 1, "gold_sql_teacher_forced").otherwise("single_turn")),
    })


def dialog_key(position: Column | None = None) -> Column:
    """dialog_id, else id, else prepared-<position>; empty texts count as missing."""
    filled = [F.when(F.col(n) != "", F.col(n)) for n in ("dialog_id", "id")]
    return F.coalesce(*filled, *([F.concat(F.lit("prepared-"), position.cast("string"))] if position is not None else []))


def expand_turns(records: DataFrame, *, key: str = "record_key", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per assistant message: its turn index, the messages before it, its content as reference, its label.

    The label is taken by position, null if the list is short. Records with null messages or without an
    assistant message give no row.
    """
    turns = F.filter(F.transform("messages", lambda m, i: F.struct(i.alias("at"), _role(m).alias("role"), m["content"].alias("content"))), lambda m: m["role"] == "assistant")
    base = records.where("messages is not null").withColumn("_dialog", dialog_key(F.col(key))).withColumn("_turns", turns)
    rows = base.select("*", F.posexplode("_turns").alias("turn_index", "_t"))
    label = [F.get("schema_link_labels", F.col("turn_index")).alias("gold_plan")] if "schema_link_labels" in records.columns else []
    return rows.select(
        key, F.concat_ws(":", "_dialog", F.col("turn_index").cast("string")).alias("id"), F.col("_dialog").alias("dialog_id"), "turn_index",
        F.size("_turns").alias("turn_count"), F.slice("messages", 1, F.col("_t.at")).alias("messages"), F.col("_t.content").alias("reference_sql"),
        *label, *keep,
    )


def first_turns(turns: DataFrame, n: int, order: tuple[str, ...]) -> DataFrame:
    """The first n turns in that order; may cut a dialog. A limit over an order: each task keeps n rows."""
    return turns.orderBy(*order).limit(n)


def load_turns(df: DataFrame, *, key: str = "record_key", limit: int | None = None) -> DataFrame:
    """Turns of a frame that holds either turns (it has reference_sql and turn_index) or whole dialogs.

    The limit counts rows of the former and expanded turns of the latter, in order of (key, turn).
    """
    turns = df if {"reference_sql", "turn_index"} <= set(df.columns) else expand_turns(df, key=key)
    return turns if limit is None else first_turns(turns, limit, (key, "turn_index"))


def exactly(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows in that order; ValueError if there are fewer. The count stops at n rows."""
    chosen = df.orderBy(order).limit(n)
    if (got := chosen.count()) < n:
        raise ValueError(f"{got} rows, {n} are needed")
    return chosen


def predictions(turns: DataFrame, generate: Callable[[list[dict]], str], target: str, key: str = "id") -> DataFrame:
    """(key, text) of a generator for each prompt; the column is predicted_dsl or generated_sql, by target.

    Prompts that show their own reference are refused, with ValueError, before anything is generated.
    """
    column = {"metric_dsl": "predicted_dsl", "direct_sql": "generated_sql"}.get(target)
    if column is None:
        raise ValueError(f"unknown target {target!r}")
    if leaked_reference(turns).limit(1).count():
        raise ValueError("a prompt shows its own reference")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [generate([{"role": m["role"], "content": m["content"]} for m in ms]).strip() for ms in pdf.messages]
            yield pd.DataFrame({"key": pdf.key, "made": made})

    rows = turns.where("messages is not null").select(F.col(key).cast("string").alias("key"), "messages").mapInPandas(run, "key string, made string")
    made = F.col("made") if target == "metric_dsl" else T.extract_sql(F.col("made"))
    return rows.select(F.col("key").alias(key), made.alias(column))


def uses_plan_hints(messages: Column, *flags: Column) -> Column:
    """Is a flag set, or does a message show a planning hint? Nulls count as no."""
    shown = F.exists(messages, lambda m: F.coalesce(F.contains(m["content"], F.lit(PLAN_MARKERS[0])) | F.contains(m["content"], F.lit(PLAN_MARKERS[1])), F.lit(False)))
    out = F.coalesce(shown, F.lit(False))
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def with_sql_only(messages: Column, instruction: str = SQL_ONLY) -> Column:
    """The instruction appended to the first system message, or put in front as one."""
    at = F.array_position(F.transform(messages, lambda m: F.coalesce(_role(m), F.lit(""))), F.lit("system"))
    added = F.transform(messages, lambda m, i: F.when(i == at - 1, F.struct(_role(m).alias("role"), F.concat_ws("\n\n", m["content"], F.lit(instruction)).alias("content"))).otherwise(m))
    return F.when(at > 0, added).otherwise(F.concat(F.array(message("system", F.lit(instruction))), messages))


def with_system(messages: Column, system: str, tail: str | None = None) -> Column:
    """Another system message in place of all; `tail` goes to the end of the last user message."""
    rest = F.filter(messages, lambda m: _role(m) != "system")
    if tail:
        last = F.size(rest) - F.array_position(F.reverse(F.transform(rest, _role)), F.lit("user"))
        rest = F.transform(rest, lambda m, i: F.when((i == last) & (_role(m) == "user"), F.struct(_role(m).alias("role"), F.concat(F.regexp_replace(m["content"], r"\s+$", ""), F.lit("\n\n" + tail)).alias("content"))).otherwise(m))
    return F.concat(F.array(message("system", F.lit(system))), rest)


def to_first_user(messages: Column, block: Column) -> Column:
    """A block at the end of the first user message; null without a user message."""
    at = F.array_position(F.transform(messages, lambda m: F.coalesce(_role(m), F.lit(""))), F.lit("user"))
    added = F.transform(messages, lambda m, i: F.when(i == at - 1, F.struct(_role(m).alias("role"), F.concat_ws("\n\n", m["content"], block).alias("content"))).otherwise(m))
    return F.when(at > 0, added)


def contents(messages: Column, role: str | None = None, sep: str = "\n") -> Column:
    """All contents (of one role) as one text; null contents are left out."""
    kept = F.filter(messages, lambda m: _role(m) == role) if role else messages
    return F.array_join(F.transform(kept, lambda m: m["content"]), sep)


def multi_turn_candidates(records: DataFrame, role: str | None = None, policies: tuple[str, ...] | None = None, least: int = 2) -> DataFrame:
    """Records with `least` or more assistant turns (of that split role and those history policies), with
    `recoverable_later_turn_count`."""
    df = records.withColumn("_n", F.size(answers(F.col("messages")))).where(F.col("_n") >= least)
    if role:
        df = df.where(F.col("split_role") == role)
    if policies:
        df = df.where(F.col("history_policy").isin(*policies))
    return df.withColumn("recoverable_later_turn_count", F.col("_n") - 1).drop("_n")


def metric_signals(plan: Column) -> Column:
    """Which of aggregation, group_by, having, order_by and limit a plan label shows, in this order."""
    has = lambda key: F.coalesce(F.element_at(plan["query_skeleton"], key), F.lit(False))
    shape = plan["projection_shape"]
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    calls = F.coalesce(F.exists(shape["selected_expressions"], lambda e: F.lower(e).rlike(r"(count|sum|avg|min|max)\(")), F.lit(False))
    tests = (
        ("aggregation", some(shape["aggregations"]) | calls), ("group_by", has("group_by") | some(shape["group_by"])), ("having", has("having")),
        ("order_by", has("order_by") | shape["order_by"].isNotNull()), ("limit", has("limit") | shape["limit"].isNotNull()),
    )
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def leaked_reference(turns: DataFrame) -> DataFrame:
    """Turns whose prompt (system and user messages) shows their own non-empty reference."""
    prompt = F.array_join(F.transform(F.filter("messages", lambda m: _role(m).isin("system", "user")), lambda m: m["content"]), "\n")
    return turns.where((F.col("reference_sql") != "") & F.contains(prompt, F.col("reference_sql")))


def prompt_violations(turns: DataFrame, fields: tuple[str, ...] = ("schema_link_labels", "gold_plan", "gold_metric_dsl")) -> DataFrame:
    """Turns whose prompt does not end with a user message, or names a scorer's field, with the `violation`."""
    last = F.try_element_at("messages", F.lit(-1))
    shown = F.exists("messages", lambda m: F.coalesce(m["content"].rlike("|".join(fields)), F.lit(False)))
    why = F.when(F.size("messages") == 0, "prompt_not_ending_with_user").when(_role(last) != "user", "prompt_not_ending_with_user").when(shown, "scorer_field_in_prompt")
    return turns.withColumn("violation", why).where("violation is not null")


def visible(df: DataFrame, columns: tuple[str, ...], scorer: tuple[str, ...]) -> DataFrame:
    """Only the columns a model may see, and the scorer's as one struct without nulls in a JSON text."""
    return df.select(*columns, F.to_json(F.struct(*scorer)).alias("scoring_contract"))


def paired_arms(df: DataFrame, target: str, arms: tuple[str, ...] = ("treatment", "control"), targets: str = "training_targets") -> DataFrame:
    """Rows meant for a target, once for each arm."""
    return df.where(F.array_contains(targets, target)).withColumn("arm", F.explode(F.array(*map(F.lit, arms))))


def seeded_inputs(df: DataFrame, system: str, blocks: dict[str, Column]) -> DataFrame:
    """Rollout inputs: the conversation under another system message, with named context blocks at its first user message."""
    shown = F.concat_ws("\n\n", *[F.when(c.isNotNull(), F.concat(F.lit(f"{label}:\n"), c)) for label, c in blocks.items()])
    return df.withColumn("messages", to_first_user(with_system(F.col("messages"), system), shown))


# ---------------------------------------------------------------- rollout

Generate = Callable[[list[dict]], str]
ROLLOUT_SCHEMA = "key long, dialog_id string, turn_index int, turn_count int, history_length int, history_digest string, reference_sql string, generated_sql string, normalized_match boolean, syntax_valid boolean"


def rollout_dialog(key: int, dialog_id: str, messages: list, seeded: int | None, generate: Generate) -> list[tuple]:
    """Rows of one dialog: every assistant slot is answered from the history so far, and the answer joins the history.

    The seeded slot's own text joins the history without giving a row.
    """
    import hashlib

    history: list[dict] = []
    n = sum(m["role"] == "assistant" for m in messages)
    turn, out = 0, []
    for m in messages:
        if m["role"] != "assistant":
            history.append({"role": m["role"], "content": m["content"]})
            continue
        if seeded is not None and turn == seeded:
            history.append({"role": "assistant", "content": m["content"]})
        else:
            made = generate(history)
            shown = "\n".join(h["content"] or "" for h in history)
            a, b = sqltree.canonical(m["content"]), sqltree.canonical(made)
            out.append((key, dialog_id, turn, n, len(history), hashlib.sha256(shown.encode("utf-8", "replace")).hexdigest()[:16], m["content"], made, a is not None and a == b, b is not None))
            history.append({"role": "assistant", "content": made})
        turn += 1
    return out


def rollout(records: DataFrame, generate: Generate, key: str = "record_key") -> DataFrame:
    """Generated-history rollout of every record, dialogs in parallel, one pass and no shuffle.

    A record is a whole dialog, so its state never leaves its row. Null messages give no row.
    """
    rows = records.where("messages is not null").select(F.col(key).alias("key"), dialog_key(F.col(key)).alias("dialog_id"), "messages", "seeded_failure_turn_index")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROLLOUT_SCHEMA.split(", ")]
        for pdf in batches:
            out: list[tuple] = []
            for k, d, m, s in zip(pdf.key, pdf.dialog_id, pdf.messages, pdf.seeded_failure_turn_index):
                out += rollout_dialog(k, d, list(m), None if pd.isna(s) else int(s), generate)
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, ROLLOUT_SCHEMA)


def echo_last_question(history: list[dict]) -> str:
    """A stand-in for a model: a statement that names how much history it has seen."""
    return f"SELECT {sum(len(h['content'] or '') for h in history)}, {len(history)}"


def teacher_forced(records: DataFrame, key: str = "record_key") -> DataFrame:
    """The control arm: every reference scored against itself, without a database."""
    turns = expand_turns(records, key=key)
    own = T.canonical_sql(F.col("reference_sql"))
    valid = own.isNotNull()
    return turns.select(key, "id", "turn_index", F.col("reference_sql").alias("generated_sql"), valid.alias("syntax_valid"), valid.cast("double").alias("execution_score"))
