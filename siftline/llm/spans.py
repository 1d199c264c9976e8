"""Matches of a pattern with their places, in SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Matches whose places are added up in one go; totals of such blocks are added up in a second.
BLOCK = 256


def occurrences(text: Column, pattern: str, kind: str) -> Column:
    """Array of (kind, s, e, v): all leftmost non-overlapping matches, code points, end exclusive.

    The text cut at the matches gives what lies between them; lengths added up give the places, within blocks of
    matches and over the blocks, so that work stays near proportion in the number of matches.
    Patterns are written with possessive loops, which Java runs without recursion or backtracking.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("v"), F.slice(between, 1, F.size(found)).alias("g"))
    empty = F.array().cast("array<struct<kind:string,s:int,e:int,v:string>>")

    def place(block: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + F.length(x["g"])
            e = s + F.length(x["v"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x["v"].alias("v")))).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def cut(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))

    def walk(acc: Column, block: Column) -> Column:
        total = F.aggregate(block, F.lit(0), lambda n, x: n + F.length(x["g"]) + F.length(x["v"]))
        return F.struct((acc["at"] + total).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

    def both(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(blocks, zero, walk, lambda acc: acc["starts"])
        return F.flatten(F.zip_with(blocks, starts, place))

    # one-element arrays bind a value to a name, so that it is computed once
    once = F.transform(F.array(pairs), lambda p: F.when(F.size(p) == 0, empty).otherwise(F.transform(F.array(cut(p)), both)[0]))
    return once[0]


def replaced(text: Column, spans: Column) -> Column:
    """The text with each (kind, s, e, ...) replaced by its kind in brackets; spans that overlap an earlier one's text are joined to it."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        add = F.when(fresh, F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], -x["n"]).alias("at"), F.concat(acc["out"], add).alias("out"))

    done = F.aggregate(ordered, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text))))
