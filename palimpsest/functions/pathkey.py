"""The key under which two spellings of a path are the same path.

Two paths are the same if they hold the same letters and digits in the same order; case, width and composition of a
letter do not count, nor does any other character. Plain ASCII strings, nearly all of them, are folded inside the JVM;
only the others travel to Python, as Arrow batches.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_NEITHER = regex.compile(r"[^\p{L}\p{N}\p{M}]+")
_MARKS = regex.compile(r"[^\p{L}\p{N}]+")


def fold_text(s: str | None) -> str | None:
    """Reference form of the key for one string: '' if it holds no letter or digit, None for None."""
    if s is None:
        return None
    s = unicodedata.normalize("NFKC", _NEITHER.sub("", s)).casefold()
    return _MARKS.sub("", unicodedata.normalize("NFKC", s))


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(fold_text, na_action="ignore")


def is_blank(c: Column) -> Column:
    """Null, empty or nothing but white space of any script. Never null."""
    return ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def folded(c: Column) -> Column:
    """``fold_text`` of a string column."""
    ascii_only = F.octet_length(c) == F.char_length(c)
    native = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    return F.when(ascii_only, native).otherwise(_fold(F.when(~ascii_only, c)))


def path_key(c: Column) -> Column:
    """Key of a path column; null for a null or blank path, which is no path."""
    return F.when(~is_blank(c), folded(c))
