"""Spans of pattern matches in whole texts, as arrays of structs.

A span has ``start`` and ``end`` in code points (end exclusive), the matched
text and a kind. The pieces between matches give the places, so a text is read
once by a pattern without matches and twice by one with matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from promolens.llm.columns import let

SPAN = "array<struct<start:int,end:int,found:string>>"


def spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches that ``keep`` accepts; an empty array for none."""
    nothing = F.array().cast(SPAN)

    def places(found: Column) -> Column:
        pieces = F.zip_with(F.slice(F.split(text, pattern), 1, F.size(found)), found,
                            lambda gap, m: F.struct(F.char_length(gap).alias("gap"),
                                                    F.char_length(m).alias("n"), m.alias("m")))
        start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
        return F.aggregate(pieces, start, lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + p["n"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + p["gap"]).alias("start"),
                (acc["at"] + p["gap"] + p["n"]).alias("end"), p["m"].alias("found")))).alias("out")),
            lambda acc: acc["out"])

    every = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                lambda found: F.when(F.size(found) == 0, nothing).otherwise(places(found)))
    return F.filter(every, lambda s: keep(s["found"])) if keep else every


def of_kind(found: Column, rank: int, kind: str) -> Column:
    """The spans with their kind; ``rank`` orders kinds."""
    return F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
        F.lit(kind).alias("kind")))


def by_start(found: Column) -> Column:
    return F.sort_array(found)


def by_kind(found: Column) -> Column:
    """Kind first, then place."""
    turned = F.sort_array(F.transform(found, lambda s: F.struct(
        s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"),
        s["kind"].alias("kind"))))
    return F.transform(turned, lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"),
        s["kind"].alias("kind")))


def listed(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def redacted(text: Column, found: Column, mark: str) -> Column:
    """The text with every span replaced by ``mark``; overlapping spans count as one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    joined = F.aggregate(
        by_start(found), start,
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
            F.lit(mark)).alias("out")))
        .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(found) > 0, joined).otherwise(text)
