"""Problem 3: duplicates hidden by formatting differences.

A statement's canonical form keeps quoted literals as they are; everything else loses case,
white space, quoting characters and final semicolons, and a leading SELECT gets its items
sorted. Groups of equal forms are counted by digest. Keys of more than HOT rows are found
exactly, from counts combined before the shuffle; they are aggregated in two
levels over salts, all others in one shuffle.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparlance.session import cut

#: A key of more rows than this is hot, whatever the number of rows in all; one salt for each HOT rows of it, SALTS at most.
HOT = 50_000
SALTS = 4096
#: So many hot keys may be broadcast, 20 bytes each.
FEW_HOT = 1 << 18

#: A literal (closed or running to the end), a word, or one other character.
_PART = re.compile(r"'[^']*(?:''[^']*)*(?:'|$)|\w+|[^\w']")
_SPACE = re.compile(r"\s")
#: Fixed: characters that never count outside literals.
_QUOTING = "`\"[]"


def canonical_statement(text: str) -> str:
    """The form under which statements that differ only in formatting are equal.

    Ignored outside single-quoted literals: letter case, white space, backticks, double quotes,
    square brackets, and semicolons at the end. Where the text begins with SELECT, the items up
    to its FROM (outside parentheses) are put in order; without such a FROM they stay.
    """
    parts = _PART.findall(text)
    while parts and (parts[-1] == ";" or _SPACE.match(parts[-1])):
        parts.pop()
    kept = []
    for p in parts:
        if p[0] == "'":
            kept.append(p)
        elif not (_SPACE.match(p) or p in _QUOTING):
            kept.append(p.lower())
    while kept and kept[-1] == ";":  # semicolons that only ignored characters followed
        kept.pop()
    if not kept or kept[0] != "select":
        return "".join(kept)
    start = 2 if len(kept) > 1 and kept[1] == "distinct" else 1
    items, item, depth = [], [], 0
    for i in range(start, len(kept)):
        p = kept[i]
        if p == "from" and depth <= 0:
            items.append("".join(item))
            return "".join(kept[:start]) + ",".join(sorted(items)) + "".join(kept[i:])
        depth += (p == "(") - (p == ")")
        if p == "," and depth <= 0:
            items.append("".join(item))
            item = []
        else:
            item.append(p)
    return "".join(kept)


_FENCE = re.compile(r"```\w*")


def is_empty_answer(text: str | None) -> bool:
    """Null, or no letter or digit left once code-fence marks are removed."""
    return text is None or not any(c.isalnum() for c in _FENCE.sub("", text))


def canonical(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if is_empty_answer(t) else canonical_statement(t) for t in texts], dtype=object)

    return run(text)


def canonical_digests(rows: DataFrame, *, key: str = "result_key", text: str = "reference_sql") -> DataFrame:
    """(key, digest) of every row with a text; digest is the first 128 bits of the form's SHA-256."""
    form = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), canonical(F.col(text)).alias("form"))
    return form.where("form is not null").select("key", F.expr("substring(unhex(sha2(form, 256)), 1, 16)").alias("digest"))


def copy_groups(rows: DataFrame, *, key: str = "result_key", text: str = "reference_sql", hot: int = HOT) -> DataFrame:
    """(key, first_key, n_rows): for each row with a text the smallest key and the size of its group.

    Null and empty texts (no letter or digit) are left out; an empty table gives no row. Partial counts, combined before
    they are shuffled, give each digest its exact number of rows and so its number of salts, 1 unless it is hot. Rows meet
    their group by digest and salt: a hot group is aggregated over its salts first and then over these, and the
    result is handed back salt by salt, so that no task has more than about `hot` rows of a group (or a 4096th of it).
    """
    keyed = cut(canonical_digests(rows, key=key, text=text))
    salts = F.least(F.ceil(F.col("n") / hot), F.lit(SALTS)).cast("int")
    counted = keyed.groupBy("digest").agg(F.count("*").alias("n"))
    wide = cut(counted.where(F.col("n") > hot).select("digest", salts.alias("salts")))
    few = F.broadcast(wide) if wide.count() <= FEW_HOT else wide  # else a join whose skewed partitions are split
    salted = keyed.join(few, "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("key"), F.col("salts")), F.lit(0).cast("long")))
    level = salted.groupBy("digest", "salt").agg(F.count("*").alias("n"), F.min("key").alias("low"))
    one_level = level.join(wide.select("digest"), "digest", "left_anti").select("digest", "salt", F.col("low").alias("first_key"), F.col("n").alias("n_rows"))
    both = level.join(wide, "digest")
    two_level = both.groupBy("digest", "salts").agg(F.sum("n").alias("n_rows"), F.min("low").alias("first_key"))
    handed = two_level.select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"), "first_key", "n_rows")
    return salted.join(one_level.unionByName(handed), ["digest", "salt"]).select("key", "first_key", "n_rows")


def hidden_copies(rows: DataFrame, *, key: str = "result_key", text: str = "reference_sql") -> DataFrame:
    """(first_key, copy_key) of every row that is a copy of one with a smaller key."""
    return copy_groups(rows, key=key, text=text).where("key > first_key").select("first_key", F.col("key").alias("copy_key"))


def distinct_statements(rows: DataFrame, *, key: str = "result_key", text: str = "reference_sql") -> DataFrame:
    """(first_key, statement, n_rows): one row per group, with the text of its smallest key."""
    first = copy_groups(rows, key=key, text=text).where("key = first_key").select("first_key", "n_rows")
    texts = rows.select(F.col(key).alias("first_key"), F.col(text).alias("statement"))
    return first.join(texts, "first_key").select("first_key", "statement", "n_rows")
