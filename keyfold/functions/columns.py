"""Scalar functions over text and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of plain word counts.
BLANKS = r"[ \t\n]+"
#: Separators of words without punctuation.
PUNCTUATION = r"""[ \t\n.,()'":;!?<>]+"""


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str, separators: str = BLANKS) -> Column:
    """The pieces of a text between separators, without empty ones. A null text has none."""
    return F.array_remove(F.split(F.coalesce(_col(text), F.lit("")), separators), "")


def ascii_lower(text: Column | str) -> Column:
    """A-Z to lower case, all else as it is."""
    return F.translate(_col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column | str) -> Column:
    """Lower-cased pieces between blanks and punctuation."""
    return tokens(ascii_lower(text), PUNCTUATION)


def hash_bucket(value: Column | str, n: int) -> Column:
    """A bucket from 0 to n - 1 that other engines can compute too: the first 32 bits of the MD5 digest, modulo n."""
    return F.conv(F.substring(F.md5(_col(value).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % F.lit(n)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.aggregate(F.zip_with(_col(a), _col(b), square), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
