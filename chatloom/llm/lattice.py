"""LM scoring: marginal probability of a text under a unigram subword lattice.

The pieces and their scores are those of a public subword vocabulary, which is not trained here. Its
scores are the ranks of its pieces; read as a Zipf law, log(1 / (rank + ZIPF)), they weigh the lattice
of all segmentations. ROUNDS of expectation-maximisation over that lattice fit the weights to the
training words: a piece's expected count over all segmentations of all words (forward and backward
recursion), plus one half. A word's probability sums over all its segmentations into pieces, by
forward recursion in log space; a text's is the product over its words and one end.

A word is scored once for the whole corpus, not once per occurrence. Each task turns about
CHUNK_BYTES of text into the chunk's distinct words and, per document, indices into them; distinct
words meet in one table that holds corpus counts and marginals, and go back to their chunks from
there. Nothing but the piece scores (one number per piece of the vocabulary) reaches the driver.

Null or empty text: no words, only the end. Rows are scored one by one, repeated or not; a null
doc_id counts as training. A word of any length and any byte has a probability, through byte pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import BLANK, LOWER, byte_hashes, span_hashes, text_slices, word_spans
from .workspace import Workspace

CHUNK_BYTES = 16 << 20
BATCH_ROWS = 1 << 16
ROUNDS = 1
ZIPF = 2.7
MARK = "▁".encode()  # stands before every word in the vocabulary's pieces
_CHUNKS = "chunk long, doc_id long, held_out boolean, n_words long, at binary, times binary, h long, word binary, c long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=1)
def vocabulary(path: str):
    """The bytes of every piece (None for control pieces), and its log weight by the file's own scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else None if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).encode() for i in range(n)]
    scores = np.array([model.get_score(i) for i in range(n)])
    rank = (-scores).argsort(kind="stable").argsort(kind="stable")  # byte pieces have the score of the first rank, as any text may need them
    weights = -np.log(rank + ZIPF)
    return pieces, weights - np.logaddexp.reduce(weights)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (h null) and of their chunk's distinct words (doc fields null)."""
    part, k = TaskContext.get().partitionId(), 0
    known = np.zeros(0, np.uint64)  # the chunk's words, sorted, and each one's index and training count
    index = np.zeros(0, np.int64)
    count = np.zeros(0, np.int64)
    spelt: list[pa.Array] = []  # the words' texts, in order of their indices
    held = 0

    def row(size: int, **columns) -> pa.RecordBatch:
        kinds = {"chunk": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_words": pa.int64(), "at": pa.binary(), "times": pa.binary(), "h": pa.int64(), "word": pa.binary(), "c": pa.int64()}
        columns["chunk"] = pa.array(np.full(size, (part << 24) + k), pa.int64())
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, t) for c, t in kinds.items()], names=list(kinds))

    def words() -> Iterator[pa.RecordBatch]:
        texts = pa.concat_arrays(spelt)
        for a in range(0, len(known), BATCH_ROWS):
            own = slice(a, a + BATCH_ROWS)
            yield row(len(known[own]), h=pa.array(known[own].astype(np.int64)), n_words=pa.array(index[own], pa.int64()), word=texts.take(pa.array(index[own])), c=pa.array(count[own], pa.int64()))

    for batch in batches:
        for rows, buffer, begins in text_slices(batch):
            low = LOWER[buffer]
            starts, ends = word_spans(low, begins, BLANK)
            first = np.searchsorted(starts, begins)
            distinct, at, inverse = np.unique(span_hashes(byte_hashes(low), starts, ends), return_index=True, return_inverse=True)
            place = np.searchsorted(known, distinct)
            old = place < len(known)
            old[old] = known[place[old]] == distinct[old]
            fresh = np.flatnonzero(~old)
            number = np.empty(len(distinct), np.int64)
            number[old] = index[place[old]]
            number[fresh] = len(known) + np.arange(len(fresh))
            trains = ~np.array([bool(x) for x in rows.column("held_out").to_pylist()])
            adds = np.bincount(inverse, weights=np.repeat(trains, np.diff(first)), minlength=len(distinct)).astype(np.int64)
            count[place[old]] += adds[old]
            raw = low.tobytes()
            spelt.append(pa.array([raw[a:b] for a, b in zip(starts[at[fresh]].tolist(), ends[at[fresh]].tolist(), strict=True)], pa.binary()))
            known = np.concatenate([known, distinct[fresh]])
            index = np.concatenate([index, number[fresh]])
            count = np.concatenate([count, adds[fresh]])
            order = np.argsort(known, kind="stable")
            known, index, count = known[order], index[order], count[order]
            tokens = number[inverse].astype(np.uint32)
            at_rows, times_rows = [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own, times = np.unique(tokens[a:b], return_counts=True)
                at_rows.append(own.tobytes())
                times_rows.append(times.astype(np.uint32).tobytes())
            yield row(rows.num_rows, doc_id=rows.column("doc_id"), held_out=rows.column("held_out"), n_words=pa.array(np.diff(first), pa.int64()), at=pa.array(at_rows, pa.binary()), times=pa.array(times_rows, pa.binary()))
            held += len(buffer)
            if held >= CHUNK_BYTES:
                if len(known):
                    yield from words()
                known, index, count, spelt, held, k = known[:0], index[:0], count[:0], [], 0, k + 1
    if len(known):
        yield from words()


def _piece_counts(path: str | None, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path or default_vocabulary())[0]
        lattice = Lattice(pieces, weights)
        total = np.zeros(len(lattice.keys))
        for batch in batches:
            if batch.num_rows:
                total += lattice.expected(batch.column("word").to_pylist(), batch.column("c").to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lattice.first[at]), pa.array(total[at])], names=["piece", "times"])

    return run


class Lattice:
    """Forward recursion over batches of words, given the log weight of every piece."""

    def __init__(self, pieces: list[bytes | None], weights: np.ndarray):
        merged: dict[bytes, float] = {}
        first: dict[bytes, int] = {}
        for k, (piece, weight) in enumerate(zip(pieces, weights, strict=True)):
            if piece:
                merged[piece] = np.logaddexp(merged.get(piece, -np.inf), weight)
                first.setdefault(piece, k)
        texts = list(merged)
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        keys = span_hashes(byte_hashes(data), starts, ends)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(merged.values()))[order]
        self.first = np.array(list(first.values()))[order]  # the number of the piece, or of the first of equal ones
        self.lengths = sorted({len(t) for t in texts})

    def marginals(self, words: list[bytes], batch: int = 1 << 14) -> np.ndarray:
        """Natural log of each word's probability (the mark before it included)."""
        out = np.empty(len(words))
        for own, texts, size in self._batches(words, batch):
            out[own] = self._forward(texts, size)[0][np.arange(len(own)), size]
        return out

    def expected(self, words: list[bytes], times: np.ndarray, batch: int = 1 << 13) -> np.ndarray:
        """How often each piece is expected in the words, over all their segmentations; a word counts `times`."""
        total = np.zeros(len(self.keys))
        for own, texts, size in self._batches(words, batch):
            alpha, steps = self._forward(texts, size, keep=True)
            rows = np.arange(len(own))
            beta = np.full_like(alpha, -np.inf)
            beta[rows, size] = 0
            whole, weight = alpha[rows, size], np.asarray(times, np.float64)[own]
            for end, length, hit, place in reversed(steps):
                back = beta[hit, end] + self.values[place]
                total += np.bincount(place, weights=np.exp(alpha[hit, end - length] + back - whole[hit]) * weight[hit], minlength=len(total))
                beta[hit, end - length] = np.logaddexp(beta[hit, end - length], back)
        return total

    @staticmethod
    def _batches(words: list[bytes], batch: int):
        """Words of like length together: their numbers, their bytes with the mark, and lengths."""
        size = np.array([len(w) + len(MARK) for w in words])
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            take = max(1, min(batch, (batch << 5) // int(size[order[min(at + batch, len(order)) - 1]])))
            own = order[at : at + take]
            yield own, [MARK + words[i] for i in own], size[own]
            at += take

    def _forward(self, words: list[bytes], size: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list[tuple]]:
        """Log weight of every prefix of every word; the pieces that were met, as (end, length, words, places), if asked for."""
        starts = np.cumsum(size) - size
        sums = byte_hashes(np.frombuffer(b"".join(words), np.uint8))
        alpha = np.full((len(words), int(size.max()) + 1), -np.inf)
        alpha[:, 0] = 0
        steps = []
        for end in range(1, alpha.shape[1]):
            live = np.flatnonzero(size >= end)
            total = np.full(len(live), -np.inf)
            for length in self.lengths:
                if length > end:
                    break
                h = span_hashes(sums, starts[live] + end - length, starts[live] + end)
                place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[place] == h)
                if len(hit):
                    total[hit] = np.logaddexp(total[hit], alpha[live[hit], end - length] + self.values[place[hit]])
                    if keep:
                        steps.append((end, length, live[hit], place[hit]))
            alpha[live, end] = total
        return alpha, steps


def _marginals(path: str | None, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(path or default_vocabulary())[0], weights)
        for batch in batches:
            lp = lattice.marginals(batch.column("word").to_pylist()) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), pa.array(lp / np.log(10))], names=["h", "c", "lp"])

    return run


def score(docs: DataFrame, vocabulary_path: str | None = None, work: Workspace | None = None) -> DataFrame:
    """A row per row of docs (doc_id, text, held_out, ...): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows with held_out true are scored but not learned from.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "lattice")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    chunks = work.save(docs.mapInArrow(_chunks, _CHUNKS), "chunks")
    texts = chunks.where("h is not null")
    counts = texts.select("h", "word", "c").repartition("h").groupBy("h").agg(F.max("word").alias("word"), F.sum("c").alias("c"))
    words = work.save(counts, "words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = chunks.where("h is null and not held_out").count()
    n, v = total.n + ends, total.v + (ends > 0)
    kinds = len(vocabulary(vocabulary_path or default_vocabulary())[0])
    weights = vocabulary(vocabulary_path or default_vocabulary())[1]
    weights = np.append(weights, weights.min())  # the last is the end
    for _ in range(ROUNDS):
        pieces = words.where("c > 0").select("word", "c").mapInArrow(_piece_counts(vocabulary_path, weights[:kinds]), "piece long, times double").groupBy("piece").agg(F.sum("times").alias("times")).toPandas()
        times = np.full(kinds + 1, 0.5)
        times[pieces["piece"].to_numpy(np.int64)] += pieces["times"].to_numpy()
        times[-1] += ends
        weights = np.log(times / times.sum())
    scored = work.save(words.select("h", "word", "c").mapInArrow(_marginals(vocabulary_path, weights[:-1]), "h long, c long, lp double"), "scored")

    found = texts.select("chunk", F.col("n_words").cast("int").alias("number"), "h").join(scored, "h").select(F.col("chunk").alias("of"), "number", "c", "lp")
    own = chunks.where("h is null").select("chunk", "doc_id", "held_out", "n_words", "at", "times")
    end_lp, base_end = weights[-1] / np.log(10), np.log10((ends + 1) / (n + v + 1))

    def add(key, rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("number")
        c, lp = table["c"].to_numpy(np.float64), table["lp"].to_numpy(np.float64)
        base = np.log10((c + 1) / (n + v + 1))
        at = [np.frombuffer(x, np.uint32) for x in rows["at"]]
        w = [np.frombuffer(x, np.uint32).astype(np.float64) for x in rows["times"]]
        out = rows[["doc_id", "held_out"]].assign(n_tokens=rows["n_words"] + 1, train_tokens=n)
        out["n_known"] = [int(x[c[a] > 0].sum()) + (ends > 0) for a, x in zip(at, w, strict=True)]
        out["base_score"] = [float(base[a] @ x + base_end) for a, x in zip(at, w, strict=True)]
        out["score"] = [float(lp[a] @ x + end_lp) for a, x in zip(at, w, strict=True)]
        return out

    return own.groupBy("chunk").cogroup(found.groupBy("of")).applyInPandas(add, "doc_id long, held_out boolean, n_tokens long, train_tokens long, n_known long, base_score double, score double").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_lattice_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs.select("doc_id", "text", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2).alias("held_out")))
