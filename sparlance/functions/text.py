"""Text and scalar functions as column expressions: no Python on the way unless a docstring says so."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparlance.plans import sqlinfo, sqltree


def _accents() -> tuple[str, str]:
    """Latin letters with a one-letter base under NFKD, and these bases; made from the Unicode data."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    kept = [(c, "".join(x for x in d if ord(x) < 128)) for c, d in pairs]
    kept = [(c, b) for c, b in kept if len(b) == 1]
    return "".join(c for c, _ in kept), "".join(b for _, b in kept)


_FROM, _TO = _accents()


def normalize_token(c: Column) -> Column:
    """Lower case, accents dropped, other characters beyond ASCII dropped, every run of others one space, trimmed.

    Decomposes Latin letters only; `normalize_token_full` does so for all of Unicode.
    """
    ascii_only = F.regexp_replace(F.lower(F.translate(c, _FROM, _TO)), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(ascii_only, "[^a-z0-9]+", " "))


def normalize_token_full(c: Column) -> Column:
    """normalize_token with the full NFKD decomposition; an Arrow batch function."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        plain = s.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")
        return plain.str.lower().str.replace(r"[^a-z0-9]+", " ", regex=True).str.strip()

    return run(c)


def aliases_of(raw: Column, normalized: Column) -> Column:
    """The trimmed value, and its normal form if that is another non-empty text."""
    return F.array_compact(F.array(F.trim(raw), F.when((normalized != "") & (normalized != F.trim(raw)), normalized)))


def entry_id(*parts: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the parts, joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def column_tail(c: Column) -> Column:
    """Last dotted part, without quotes, in lower case."""
    return F.element_at(F.split(F.lower(F.regexp_replace(F.trim(c), r"[`\"\[\]]", "")), r"\."), -1)


def table_hint(c: Column) -> Column:
    """First dotted part of a qualified name; null without a qualifier and for aliases such as t1."""
    clean = F.lower(F.regexp_replace(F.trim(c), r"[`\"\[\]]", ""))
    head = F.element_at(F.split(clean, r"\."), 1)
    return F.when(clean.contains(".") & ~head.rlike(r"^t\d+$"), head)


def repair_spacing(c: Column, split_where: bool = False) -> Column:
    """`> =` and the like as one sign; with split_where also `WHEREx` as `WHERE x`."""
    for sign in "><!":
        c = F.regexp_replace(c, rf"{sign}\s+=", f"{sign}=")
    return F.regexp_replace(c, r"(?i)\b(WHERE)(?=[A-Za-z_])", "$1 ") if split_where else c


def clean_sql(c: Column) -> Column:
    """Four fixed replacements of signs that a tokenizer pulled apart."""
    for a, b in (("> =", ">="), ("< =", "<="), ("! =", "!="), ("= =", "==")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def extract_sql(c: Column) -> Column:
    """The statement in a model's output: inside a code fence if there is one, from the first SQL verb, up to
    the first semicolon or the first line that continues a chat."""
    t = F.trim(c)
    fence = r"(?is)```(?:sql)?\s*(.*?)```"
    t = F.when(t.rlike(fence), F.trim(F.regexp_extract(t, fence, 1))).otherwise(t)
    verb = r"(?is)\b(?:select|with|insert|update|delete)\b.*"
    body = F.when(t.rlike(verb), F.trim(F.regexp_extract(t, verb, 0)))
    cut = F.regexp_replace(body, r"(?s)(;).*", "$1")
    chat = F.regexp_replace(body, r"(?is)\n\s*(?:system|user|assistant)\s*(?::|\n|$).*", "")
    return F.coalesce(F.trim(F.when(F.length(cut) <= F.length(chat), cut).otherwise(chat)), t)


def extract_generated_sql(c: Column, variant: Column) -> Column:
    """extract_sql; for the structured-brief variant only what follows the first line that starts with SQL:."""
    after = F.regexp_replace(c, r"(?ims)\A.*?^SQL:\s*", "")
    return extract_sql(F.when(variant == "structured_brief_sql", after).otherwise(c))


def normalize_identifier(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.trim(c), r"^[`\"\[\]]+|[`\"\[\]]+$", "")), r"\s+", " "))


def squeeze(c: Column, lower: bool = True) -> Column:
    """White space collapsed, trimmed; lower case unless the text is a literal."""
    return F.trim(F.regexp_replace(F.lower(c) if lower else c, r"\s+", " "))


def quoted_literals(c: Column) -> Column:
    """Distinct quoted parts, single and double quotes."""
    return F.array_distinct(F.array_union(F.regexp_extract_all(c, F.lit("('[^']*')"), 1), F.regexp_extract_all(c, F.lit('("[^"]*")'), 1)))


def top_level_parts(c: Column) -> Column:
    """Parts between commas outside parentheses (one level), trimmed, empty ones dropped."""
    parts = F.regexp_extract_all(c, F.lit(r"((?:[^,(]|\([^)]*\))+)"), 1)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def exact_mention(text: Column, value: Column) -> Column:
    """The first span of `text` that equals `value` but for case, with no letter or digit around it; null if none.

    The value is taken literally. Null in gives null.
    """
    literal = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    found = F.call_function("regexp_extract", text, literal, F.lit(0))
    return F.when((found != "") & (value != ""), found)


def whole_token_match(normal_text: Column, normal_alias: Column) -> Column:
    """Is the alias a run of whole words of the text? Both in normal form; an empty alias never is."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (normal_alias != "") & F.contains(pad(normal_text), pad(normal_alias))


# Fixed: words too common to stand for a value.
COMMON_WORDS = tuple("a an and as at by can for from in is it me of on or the to what where which who with".split())


def prunable_alias(c: Column, min_chars: int = 3) -> Column:
    """Too short or too common to match; numbers never are."""
    return ~c.rlike(r"^\d+(\.\d+)?$") & ((F.length(c) < min_chars) | c.isin(*COMMON_WORDS))


def token_usage(prompt: Column, completion: Column, total: Column) -> Column:
    """Tokens in all: the total if given, else the sum if both parts are."""
    return F.coalesce(total, prompt + completion)


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def json_list(c: Column) -> Column:
    """An array of texts as a JSON list without spaces; quotes and backslashes are escaped."""
    escaped = F.transform(c, lambda x: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(escaped, ","), F.lit("]"))


def list_digest(c: Column) -> Column:
    return F.sha2(json_list(c), 256)


# ---------------------------------------------------------------- functions on statements, in Arrow batches



def canonical_sql(c: Column) -> Column:
    """Canonical spelling of a statement; null if it is not parsable."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([sqltree.canonical(sqlinfo.repair_spacing(x)) if x else None for x in s], dtype=object)

    return run(c)


def sql_features(c: Column) -> Column:
    @F.pandas_udf(sqlinfo.FEATURES_SCHEMA)
    def run(s: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(("tables", "columns", "join_tables", "join_conditions", "aggregations", "group_by", "where_sql", "order_sql", "limit_sql", "having_sql", "projections", "projection_order", "literals", "distinct"))
        return pd.DataFrame([sqlinfo.features(x) or none for x in s], columns=list(none))

    return run(c)


def plan_labels(c: Column) -> Column:
    @F.pandas_udf(sqlinfo.LABEL_SCHEMA)
    def run(s: pd.Series) -> pd.DataFrame:
        names = ["parseable", "relevant_tables", "relevant_columns", "join_path", "query_skeleton", "projection_shape"]
        return pd.DataFrame([sqlinfo.plan_label(x) for x in s], columns=names)

    return run(c)


def literal_predicates(c: Column) -> Column:
    @F.pandas_udf(sqlinfo.LITERALS_SCHEMA)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([sqlinfo.literal_predicates(x) for x in s], dtype=object)

    return run(c)


def order_sensitive(c: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([sqlinfo.is_order_sensitive(x) for x in s], dtype=object)

    return run(c)


def schema_check(sql: Column, user_text: Column) -> Column:
    @F.pandas_udf(sqlinfo.CHECK_SCHEMA)
    def run(s: pd.Series, t: pd.Series) -> pd.DataFrame:
        names = ["status", "errors", "unknown_tables", "unknown_columns", "wrong_table_columns", "ambiguous_columns"]
        return pd.DataFrame([sqlinfo.check_against_schema(a, b or "") for a, b in zip(s, t)], columns=names)

    return run(sql, user_text)


def structured_brief(question: Column, sql: Column) -> Column:
    @F.pandas_udf("string")
    def run(q: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([sqlinfo.brief(a, b) for a, b in zip(q, s)], dtype=object)

    return run(question, sql)
