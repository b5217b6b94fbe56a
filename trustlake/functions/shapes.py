"""Value shapes: what a value looks like, without the value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for white space other than U+0020 while runs are measured.
_GAP = ""


def classes(c: Column) -> Column:
    """Digit 9, capital A, small a, other letter U, space _, other white space one private character, the rest as it is."""
    for pattern, to in ((r"(?U)\d", "9"), ("[a-z]", "a"), ("[A-Z]", "A"), (r"[\p{L}&&[^A-Za-z]]", "U"), (" ", "_"), (r"(?U)\s", _GAP)):
        c = F.regexp_replace(c, pattern, to)
    return c


def shape_class(c: Column) -> Column:
    """Classes with runs as x{n}; NULL is <null>, the empty text <empty>."""
    runs = F.regexp_extract_all(classes(c), F.lit(r"(?s)((.)\2*)"), F.lit(1))
    short = F.transform(runs, lambda r: F.when(F.char_length(r) == 1, r).otherwise(F.concat(F.substring(r, 1, 1), F.lit("{"), F.char_length(r).cast("string"), F.lit("}"))))
    return F.when(c.isNull(), "<null>").when(c == "", "<empty>").otherwise(F.replace(F.array_join(short, ""), F.lit(_GAP), F.lit(r"\s")))


def shape_counts(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    """(shape, n): the most frequent shapes over all rows; ties by shape."""
    return df.groupBy(shape_class(F.col(column).cast("string")).alias("shape")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shape").limit(top)


def top_shapes(df: DataFrame, column: str, top: int = 5) -> dict[str, int]:
    return {r["shape"]: r["n"] for r in shape_counts(df, column, top).collect()}
