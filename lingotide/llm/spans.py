"""Places of regular expression matches and of spans within a text, counted in code points, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_spans(text: Column, pattern: str, group: int = 0, used: int | None = None) -> Column:
    """array<struct<start, end, value>> of all leftmost, non-overlapping matches; ``end`` is exclusive.

    The pieces between the matches and the matches themselves cover the text, so their lengths add up to the places.
    The pattern must not match the empty string. Where the value is a ``group`` that looks ahead from the start of the
    match, the match itself has ``used`` characters, and values may overlap.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), group)
    gaps = F.split(text, pattern, -1)
    kind = "struct<start:int,end:int,value:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["found"])
        hit = F.struct(begin.alias("start"), end.alias("end"), pair["found"].alias("value"))
        at = end if used is None else begin + used
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("found")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def merged_spans(spans: Column) -> Column:
    """Unite overlapping spans: array<struct<start, end, kind>> in order, with the kind that starts first."""
    kind = "struct<start:int,end:int,kind:string>"
    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        overlaps = (F.size(acc) > 0) & F.coalesce(F.try_element_at(acc, F.lit(-1))["end"] > s["start"], F.lit(False))
        return F.when(overlaps, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(plain, F.array().cast(f"array<{kind}>"), step)


def replaced(text: Column, spans: Column) -> Column:
    """The text with each merged span replaced by its kind in angle brackets."""
    merged = merged_spans(spans)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        mark = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(kept, mark)).alias("out"))

    def end(acc: Column) -> Column:
        tail = F.substring(text, acc["at"] + 1, F.length(text))
        return F.array_join(F.concat(acc["out"], F.array(tail)), "")

    return F.when(F.size(merged) == 0, text).otherwise(F.aggregate(merged, start, step, end))
