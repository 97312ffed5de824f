"""Where conversation ids and timestamps stand in payloads that no parser knows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .payloads import evidence_pairs, gemini_id, timestamp

# Forms of ids and times in Gemini's text, and how many places of an id are told.
ID_FORM = re.compile(r"(?:^|[^A-Za-z0-9_])((?:c_)?[a-f0-9]{8,})(?=[^A-Za-z0-9_]|$)", re.I)
PAIR_FORM = re.compile(r"\[\s*(1[6-9]\d{8}|2\d{9})\s*,\s*(\d{1,9})\s*\]", re.A)
MILLIS_FORM = re.compile(r"\b(1[6-9]\d{11}|2\d{12})\b", re.A)
PLACES = 8


def _each(frame: pd.DataFrame, find) -> pd.DataFrame:
    rows = [(d, *x) for d, b in zip(frame["doc"], frame["body"], strict=True) for x in find(b or "")]
    return pd.DataFrame(rows, columns=["doc", "what", "pos"])


def id_places(payloads: DataFrame) -> DataFrame:
    """doc, id, pos of every place of an id in payloads (doc, body); an id's place is where its prefix, if any, begins."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield _each(x, lambda b: [(i, m.start(1)) for m in ID_FORM.finditer(b) if (i := gemini_id(m[1]))])

    return payloads.select("doc", "body").mapInPandas(run, f"doc {payloads.schema['doc'].dataType.simpleString()}, what string, pos long").withColumnRenamed("what", "id")


def time_places(payloads: DataFrame, as_of_year: int) -> DataFrame:
    """doc, ts, pos of every plausible timestamp, as [seconds, nanoseconds] or as milliseconds."""

    def find(b: str) -> list[tuple[str, int]]:
        pairs = [(timestamp(round(int(m[1]) * 1000 + int(m[2]) / 1e6), as_of_year), m.start()) for m in PAIR_FORM.finditer(b) if int(m[2]) < 10**9]
        return [(t, at) for t, at in [*pairs, *((timestamp(m[1], as_of_year), m.start()) for m in MILLIS_FORM.finditer(b))] if t]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield _each(x, find)

    return payloads.select("doc", "body").mapInPandas(run, f"doc {payloads.schema['doc'].dataType.simpleString()}, what string, pos long").withColumnRenamed("what", "ts")


def id_hits(places: DataFrame) -> DataFrame:
    """doc, id, hit_count, hit_indexes: how often each id stands in a payload, and its first PLACES places."""
    x = places.groupBy("doc", "id").agg(F.count("*").alias("hit_count"), F.array_sort(F.collect_list("pos")).alias("all"))
    return x.select("doc", "id", "hit_count", F.slice("all", 1, PLACES).alias("hit_indexes"))


def evidence(payloads: DataFrame, as_of_year: int) -> DataFrame:
    """doc, id, ts, distance, rank: the timestamps nearest to each id's places."""
    return evidence_pairs(id_places(payloads), time_places(payloads, as_of_year))


def nearby_time(x, as_of_year: int) -> str:
    """The first plausible time in a list: a number, or a list of one to three that begins with one."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    firsts = (v if number(v) else v[0] if isinstance(v, list) and 1 <= len(v) <= 3 and number(v[0]) else None for v in (x if isinstance(x, list) else []))
    return next((t for v in firsts if v is not None and (t := timestamp(v, as_of_year))), "")
