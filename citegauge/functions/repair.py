"""Repair of titles that an extractor left with mark-up."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import SPACE

S = f"{SPACE}*"
#: Fixed values, in order: (pattern, replacement). Any "sup.../sup" counts as mangled mark-up, inside words too.
REPAIRS = [
    (rf"{S}<sup>([^<]*)</sup>{S}", "$1 "),
    (rf"{S}<sub>([^<]*)</sub>{S}", "$1 "),
    (r"<i>([^<]*)</i>", "$1"),
    (r"<b>([^<]*)</b>", "$1"),
    (r"<em>([^<]*)</em>", "$1"),
    (rf"{S}sup([^/]*)/sup{S}", "$1 "),
    (rf"{S}sub([^/]*)/sub{S}", "$1 "),
    (rf"{S}<{S}>{S}([^<]*){S}<{S}>{S}", "$1 "),
    (rf"{S}<>{S}", ""),
    (r"<[^>]+/>", ""),
    (r"<[^>]+>", ""),
]


@F.pandas_udf(StringType())
def _decoded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: html.unescape(t) if isinstance(t, str) else None).astype(object)


@F.pandas_udf(StringType())
def _closed_decoded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: re.sub("&#?[0-9A-Za-z]+;", lambda m: html.unescape(m[0]), t) if isinstance(t, str) else None).astype(object)


def decode_entities(c: Column, closed: bool = False) -> Column:
    """Named and numbered entities as characters; with `closed` only those that a semicolon ends, else also old names without one.

    Texts without an ampersand stay in the JVM: Python sees a null for them.
    """
    some = c.contains("&")
    return F.when(some, (_closed_decoded if closed else _decoded)(F.when(some, c))).otherwise(c)


def repair_title(title: Column, closed: bool = False) -> Column:
    """Whole and mangled mark-up unwrapped, entities decoded, white space single. Null stays null. closed: as in `decode_entities`."""
    for pattern, to in REPAIRS:
        title = F.regexp_replace(title, pattern, to)
    return F.regexp_replace(F.regexp_replace(decode_entities(title, closed), f"{SPACE}+", " "), "^ | $", "")
