"""Tokens of text, as column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "[ \\t\\n\\r\\f]+"
#: From the first to the last of a-z in a part between white space.
WORD = "[a-z](?:[^ \\t\\n\\r\\f]*[a-z])?"
CAP = 100


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column) -> Column:
    """The words of a text: its parts between white space (space, tab, line feed, carriage return, form feed) in lower case, without what
    stands before the first and after the last of a-z; parts without any of a-z are none. One regular expression over the text."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))


def capped_tokens(text: str | Column, cap: int = CAP) -> Column:
    """The words up to and including the first one at or beyond part ``cap`` (from 1; parts that aren't words count)."""
    space, part = "[ \\t\\n\\r\\f]", "[^ \\t\\n\\r\\f]"
    head = f"^{space}*+(?:{part}++{space}++){{0,{cap - 1}}}[^a-z]*+{part}*+"
    return tokens(F.regexp_extract(F.lower(_col(text)), head, 0))


def each(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """``keep`` and one row per element of an array of no nulls, as ``name``. Spark would filter on the array's size before it explodes it,
    and so compute it twice; the outer form with a filter behind it computes it once."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line): one row per line, blank ones included; null texts have none."""
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def bigrams_of(t: Column) -> Column:
    """Adjacent pairs of an array as structs (w1, w2). Give a column that holds the array: it is read several times."""
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))


def snippet(text: str | Column, n: int = 80) -> Column:
    """The text, or its first ``n`` characters and three dots if it is longer."""
    c = _col(text)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
