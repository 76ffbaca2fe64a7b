"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, as a character class for Java patterns.
SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{200b}\x{feff}]"


def trimmed(c: Column) -> Column:
    """c without leading and trailing white space."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def clean_id(c: Column) -> Column:
    """Trimmed and lower case; null where nothing is left."""
    t = F.lower(trimmed(c))
    return F.when(t != "", t)
