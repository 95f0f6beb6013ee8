"""Matches with offsets, and the sentence and clause around them, as Column expressions.

Spark finds all matches but not where they are; the parts that split() leaves and the matches take turns, so
their lengths sum up to every start. All offsets count code points from 0, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,raw:string,value:string>"


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, raw, value>>; value is the group's text."""
    p = F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else hits
    rows = F.arrays_zip(hits.alias("m"), F.slice(F.split(text, pattern, -1), 1, F.size(hits)).alias("b"), values.alias("v"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("raw"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    found = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def sentence_of(text: Column, ends: Column, start: Column, end: Column) -> Column:
    """The text from behind the last end before `start` up to, and with, the first at or behind `end`."""
    left = F.coalesce(F.array_max(F.filter(ends, lambda b: b < start)) + 1, F.lit(0))
    right = F.coalesce(F.array_min(F.filter(ends, lambda b: b >= end)) + 1, F.length(text))
    return cut(text, left, right)


def clause_of(sentence: Column, at: Column, pattern: str) -> Column:
    """The part of the sentence between the boundaries around offset `at`: the last that ends by it, and the
    first that starts at or behind it."""
    bounds = spans(sentence, pattern)
    left = F.coalesce(F.array_max(F.transform(F.filter(bounds, lambda b: b["end"] <= at), lambda b: b["end"])), F.lit(0))
    right = F.coalesce(F.array_min(F.transform(F.filter(bounds, lambda b: b["start"] >= at), lambda b: b["start"])), F.length(sentence))
    return cut(sentence, left, right)


def any_in(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out
