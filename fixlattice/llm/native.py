"""Small helpers for operators that are DataFrame and SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Regular expression class of what separates words: space and 0x09-0x0D.
BLANK = r"\x20\x09-\x0D"
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D, in order."""
    return F.array_remove(F.split(text, f"[{BLANK}]+"), "")


def running(values: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """start, then what op (associative, start neutral) makes of the first 1, 2, ... of an array that isn't empty.

    Folds are taken within blocks and over them, so that a long array isn't copied once for each of its members."""

    def folds(xs: Column, first: Column) -> Column:
        return F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    return let(
        blocks,
        lambda bs: let(
            folds(F.transform(bs, lambda xs: F.aggregate(xs, start, op)), start),
            lambda bases: F.concat(F.array(start), F.flatten(F.transform(bs, lambda b, i: F.slice(folds(b, F.get(bases, i)), F.lit(2), F.size(b))))),
        ),
    )


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, value>> of the leftmost non-overlapping matches, in code points, stop exclusive.

    Matches are set off by U+0001 and cut out there; that character in the text itself is first
    replaced by U+0003 (the pattern mustn't depend on either). The pattern may have no capturing group before
    its own need of one.
    """
    marked = F.regexp_replace(F.when(text.contains("\u0001"), F.translate(text, "\u0001", "\u0003")).otherwise(text), f"({pattern})", "\u0001$1\u0001")
    none = F.array().cast("array<struct<start:bigint,stop:bigint,value:string>>")

    def cut(pieces: Column) -> Column:
        # piece k ends at ends[k + 1]; the matches are the odd pieces
        return let(
            running(F.transform(pieces, lambda x: F.length(x).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x),
            lambda e: F.transform(
                F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)),
                lambda i: F.struct(F.get(e, i).alias("start"), F.get(e, i + 1).alias("stop"), F.get(pieces, i).alias("value")),
            ),
        )

    return let(F.split(marked, "\u0001", -1), lambda p: F.when(F.size(p) >= 3, cut(p)).otherwise(none))
