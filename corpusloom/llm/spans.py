"""Positions of regular-expression matches as DataFrame expressions.

Matches are marked by a private-use character and the text is split at it; the
lengths of the parts give the positions, in code points. Where the text holds
that character, another of the same length, which no pattern here matches,
stands in for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, STAND_IN = "\ue000", "\ue001"
#: Lengths that are added up one by one before their sums are; keeps the sums of many matches far from quadratic.
RUN = 64


def unmarked(text: Column) -> Column:
    """text without nulls and marks; the input of matches()."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(STAND_IN))


def let(value: Column, body) -> Column:
    """body(value), with value computed once even where body uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ends(lengths: Column, before: Column) -> Column:
    """Running sums of lengths; before: the sums of the runs of RUN that precede each run."""
    within = lambda i: F.aggregate(F.slice(lengths, i - i % RUN + 1, i % RUN + 1), F.lit(0), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), F.size(lengths) - 1), lambda i: within(i) + F.get(before, F.floor(i / RUN).cast("int")))


def _before(lengths: Column) -> Column:
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")), lambda r: F.aggregate(F.slice(lengths, r * RUN + 1, F.lit(RUN)), F.lit(0), lambda s, x: s + x))
    return F.aggregate(runs, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))


SPAN = "array<struct<s:int,e:int,m:string,before:string,after:string>>"


def matches(text: Column, pattern: str, context: int = 0) -> Column:
    """Spans of pattern in text, a column of unmarked(); with context, so many characters before each and one after."""

    def spans(cut: Column, ends: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(cut) - 2, F.lit(2)),
            lambda i: F.struct(
                F.get(ends, i - 1).alias("s"),
                F.get(ends, i).alias("e"),
                F.get(cut, i).alias("m"),
                (F.right(F.get(cut, i - 1), F.lit(context)) if context else F.lit("")).alias("before"),
                (F.left(F.get(cut, i + 1), F.lit(1)) if context else F.lit("")).alias("after"),
            ),
        )

    def found(cut: Column) -> Column:
        lengths = F.transform(cut, lambda x: F.length(x))
        whole = let(lengths, lambda n: let(let(_before(n), lambda b: _ends(n, b)), lambda ends: spans(cut, ends)))
        return F.when(F.size(cut) > 1, whole).otherwise(F.array().cast(SPAN))

    # Texts between matches and matches, in turn.
    return let(F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK), found)


def tagged(spans: Column, rank: int, kind: str) -> Column:
    """Spans as (s, rank, e, kind), which sorts by start and then by kind."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def joined(tags: Column) -> Column:
    """kind:start:end of an array of tagged spans, in order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(tags), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
