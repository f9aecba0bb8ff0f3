"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(line: Column) -> Column:
    """Words between single spaces: leading and inner empty words stay, trailing ones go.

    An empty line is one empty word, a line of spaces has none, a null line gives null.
    """
    body = F.rtrim(line)
    return (
        F.when(line == "", F.array(F.lit("")))
        .when(body == "", F.array().cast("array<string>"))
        .otherwise(F.split(body, " "))
    )


def pair(key: Column, count: Column) -> Column:
    """``(key,count)`` as the text sink writes it."""
    return F.concat(F.lit("("), key, F.lit(","), count.cast("string"), F.lit(")"))
