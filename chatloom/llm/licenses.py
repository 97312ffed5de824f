"""License scans: fuzzy search for short notices.

A text is lower-cased (A-Z), cut into words of digits, letters and other non-ASCII characters, and
the words are joined by single spaces, so that punctuation and line breaks inside a notice do not
matter. A notice may have `errors` insertions, deletions or substitutions of characters. It is split
into errors + 1 seeds; by the pigeonhole principle one of them stands unchanged in every match, so
only where an exact seed is found does the `regex` library's bounded-error matching run, on the
stretch that a match around this seed can cover. Every match is reported with its words and edits;
those of a notice do not overlap, and where damaged ones crowd the best goes first. A stretch in which
seeds recur is searched in windows of a few notices' length, so the work grows with the text's length.

Base places are those where a phrase's words stand consecutively, as whole words, without an error.
Null text counts as empty: no words, no places, empty labels, score 0. Repeated rows are scanned one
by one; other columns play no part, and a null doc_id stays null. An empty table gives no rows. A very
long text is scanned in whole, by one task; of equally good places the first counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import LOWER, text_slices


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    errors: int


#: Exact phrases whose places count as base.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices that are searched with errors.
NOTICES = (
    Notice("licensed under cc by", "cc-by", 2),
    Notice("creative commons attribution", "cc-by", 3),
    Notice("creative commons zero", "cc0", 2),
    Notice("dedicated to the public domain", "public-domain", 3),
    Notice("gnu general public license", "gpl", 3),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("mozilla public license", "mpl", 2),
    Notice("apache license version", "apache", 2),
    Notice("licensed under the apache license", "apache", 3),
    Notice("mit license", "mit", 1),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("all rights reserved", "reserved", 2),
)

#: Lengths of a longest match that one bounded-error search goes over.
WINDOW = 8

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def seeds(notice: Notice) -> list[tuple[int, str]]:
    """errors + 1 parts of about equal length, each with its place in the phrase."""
    n, k = len(notice.phrase), notice.errors + 1
    cuts = [round(i * n / k) for i in range(k + 1)]
    return [(a, notice.phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=4)
def _compiled(notices: tuple[Notice, ...]):
    """Every seed in one automaton, and each notice's matcher: whole words, best match first."""
    import ahocorasick

    found: dict[str, list[tuple[int, int]]] = {}
    for i, notice in enumerate(notices):
        for at, part in seeds(notice):
            found.setdefault(part, []).append((i, at))
    automaton = ahocorasick.Automaton()
    for part, uses in found.items():
        automaton.add_word(part, (len(part), uses))
    automaton.make_automaton()
    return automaton, [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n.phrase)}){{e<={n.errors}}}(?![^ ])") for n in notices]


def normalised(buffer: np.ndarray, begins: np.ndarray) -> tuple[list[str], list[int]]:
    """Each text's words joined by single spaces, and their number."""
    clean = np.where(_WORD[LOWER[buffer]], LOWER[buffer], 0x20).astype(np.uint8).tobytes()
    words = [clean[a:b].split() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
    return [b" ".join(w).decode("utf-8", "replace") for w in words], [len(w) for w in words]


def fuzzy_matches(text: str, notices: tuple[Notice, ...] = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, errors) of the matches in a normalised text; those of a notice do not overlap."""
    automaton, matchers = _compiled(notices)
    stretches: dict[int, list[tuple[int, int]]] = {}
    for end, (length, uses) in automaton.iter(text):
        for i, at in uses:
            room, begin = notices[i].errors, end + 1 - length - at
            stretches.setdefault(i, []).append((max(0, begin - room - 1), min(len(text), begin + len(notices[i].phrase) + room + 1)))
    out = []
    for i, own in stretches.items():
        own.sort()
        a, b = own[0]
        for next_a, next_b in own[1:]:
            if next_a > b:
                out.extend(_search(text, a, b, i, notices[i], matchers[i]))
                a, b = next_a, next_b
            b = max(b, next_b)
        out.extend(_search(text, a, b, i, notices[i], matchers[i]))
    return out


def _search(text: str, a: int, b: int, i: int, notice: Notice, matcher) -> list[tuple[int, int, int, int]]:
    """The matches within text[a:b] that are whole words, in windows of WINDOW lengths of a match."""
    longest, found = len(notice.phrase) + notice.errors, []
    if a and text[a - 1] != " ":
        a = text.find(" ", a, b) + 1 or b
    if b < len(text) and text[b] != " ":
        b = max(a, text.rfind(" ", a, b))
    while a < b:
        end = min(b, a + WINDOW * longest)
        last = end == b
        if not last and text[end] != " ":
            end = text.rfind(" ", a, end)
            if end < a:  # a word longer than any match
                a = text.find(" ", a, b) + 1 or b
                continue
        sure = end if last else max(a + 1, end - 2 * longest)  # a match that starts later may go on in the next window
        parts, own = [(a, end)], []
        while parts:  # the best match of a part, then what stands before and after it
            begin, stop = parts.pop()
            if begin < stop and (m := matcher.search(text, begin, stop)):
                own.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                parts += [(begin, m.start() - 1), (m.end() + 1, stop)]
        kept = sorted(x for x in own if x[1] < sure)
        found += kept
        a = max([sure, *(x[2] for x in kept)])
        if a < b and text[a - 1] != " ":
            a = text.find(" ", a, b) + 1 or b
    return found


def base_places(text: str) -> list[tuple[int, str]]:
    """(place in the text, label) of every place where a base phrase's words stand consecutively."""
    framed, out = f" {text} ", []
    for phrase, label in BASE:
        part, at = f" {phrase} ", -1
        while (at := framed.find(part, at + 1)) >= 0:
            out.append((at, label))
    return out


def words_before(text: str, places: list[int]) -> list[int]:
    """How many spaces of a normalised text stand before each place."""
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 0x20) if places else np.zeros(0, np.int64)
    return np.searchsorted(spaces, places).tolist()


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])


def _scan(notices: tuple[Notice, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buffer, begins in text_slices(batch):
                out = []
                for text, n in zip(*normalised(buffer, begins), strict=True):
                    base = base_places(text)
                    fuzzy = fuzzy_matches(text, notices)
                    words = words_before(text, [at for at, _ in base] + [x for _, a, b, _ in fuzzy for x in (a, b)])
                    spans = [{"label": notices[i].label, "first_word": a, "last_word": b, "errors": e} for (i, _, _, e), a, b in zip(fuzzy, words[len(base) :: 2], words[len(base) + 1 :: 2], strict=True)]
                    labels = {label for _, label in base}
                    best = max([1 - e / len(notices[i].phrase) for i, _, _, e in fuzzy] + [1.0] * bool(base), default=0.0)
                    first = words[: len(base)]
                    out.append((n, len(base), min(first, default=None), max(first, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s["label"] for s in spans})), best, spans))
                columns = list(zip(*out, strict=True)) if out else [[]] * 8
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, _SCHEMA.types[1:], strict=True))], schema=_SCHEMA)

    return run


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """A row per row of docs (doc_id, text, ...): words, base places, labels, best similarity, spans of all fuzzy matches."""
    fields = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, last_word: long, errors: int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(notices), fields)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
