"""Span columns and their digests, shared by the scans."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPANS = "array<struct<kind:string,start:int,end:int>>"


def text_of(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def digest(spans: Column) -> Column:
    return F.sha2(text_of(spans), 256)


def by_place(a: Column, b: Column, kinds: tuple[str, ...]) -> Column:
    """Order of two spans: start, then kind as listed, then end."""
    listed = F.array(*[F.lit(k) for k in kinds])
    keys = [(a["start"], b["start"]), (F.array_position(listed, a["kind"]), F.array_position(listed, b["kind"])), (a["end"], b["end"])]
    out = F.lit(0)
    for x, y in reversed(keys):
        out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
    return out
