"""Best-fit packing: bounded-space online best-fit of tokenised documents into fixed-length sequences.

A document is its tokens and then an end token. A longer one than a sequence is cut into whole
sequences, the first piece taking what is left over, so only one piece of each has to be packed.

Pieces come in streams of about STREAM_ROWS, dealt by where they stand in the input. A stream keeps
at most OPEN_BINS sequences open, in a bitset with one bit for each amount of free space; a piece
goes where it leaves the least space, found by shifting the bitset, and where more sequences would
be open the fullest closes first. What is open at the end of the streams is packed once more,
64 streams at a time, so that the end of a stream wastes next to nothing.

Null or empty text: the end token alone. Rows with the same doc_id are packed row by row; other
columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

LENGTH = 2048
END_ID = 0
OPEN_BINS = 1024
STREAM_ROWS = 40_000
MERGED_STREAMS = 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """ids of a text under a byte-level BPE file of the `tokenizers` library; strings of special tokens are ordinary text.

    The file's vocabulary is run by tiktoken, which gives the same ids (a test compares them) in a tenth of the time.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as source:
        model = json.load(source)["model"]
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(shown[c] for c in token): i for token, i in model["vocab"].items() if all(c in shown for c in token) and not token.startswith("<|")}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("ordinal", pa.int64())])


def _pieces(path: str | None, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or default_tokenizer())
        part, ordinal = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                first = len(ids) % length or length
                for piece, start in enumerate([0, *range(first, len(ids), length)]):
                    own = ids[start : first if not piece else start + length]
                    out.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), part, ordinal))
                    ordinal += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECES.types, strict=True)] if out else [pa.array([], t) for t in _PIECES.types], schema=_PIECES)

    return run


def best_fit(sizes, capacity: int, open_bins: int = OPEN_BINS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item in turn; fill of each bin; which bins are open at the end."""
    free_bits, by_free = 0, [deque() for _ in range(capacity + 1)]
    bins, offsets, fill, closed, opened = [], [], [], set(), 0
    for size in sizes:
        above = free_bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            at = by_free[free].popleft()
            if not by_free[free]:
                free_bits ^= 1 << free
        else:
            if opened == open_bins:
                fullest = (free_bits & -free_bits).bit_length() - 1
                closed.add(by_free[fullest].popleft())
                if not by_free[fullest]:
                    free_bits ^= 1 << fullest
                opened -= 1
            free, at = capacity, len(fill)
            fill.append(0)
            opened += 1
        bins.append(at)
        offsets.append(fill[at])
        fill[at] += size
        free -= size
        if free:
            by_free[free].append(at)
            free_bits |= 1 << free
        else:
            closed.add(at)
            opened -= 1
    still = np.ones(len(fill), bool)
    still[list(closed)] = False
    return np.array(bins, np.int64), np.array(offsets, np.int64), np.array(fill, np.int64), still


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, open_bins: int = OPEN_BINS, work: Workspace | None = None) -> DataFrame:
    """A row per piece of docs (doc_id, text, ...): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "packing")
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, ordinal long"
    pieces = work.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, length), fields), "pieces")
    whole = pieces.where(F.col("length") == length)
    rest = pieces.where(F.col("length") < length)
    streams = max(1, -(-rest.count() // STREAM_ROWS))

    def first(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["part", "ordinal"], ignore_index=True)
        bins, offsets, fill, still = best_fit(x["length"].tolist(), length, open_bins)
        return x[["doc_id", "piece", "start", "length", "ids_crc32", "stream"]].assign(bin=x["stream"].astype(np.int64) * (1 << 32) + bins, offset=offsets, fill=fill[bins], open=still[bins])

    dealt = rest.withColumn("stream", F.pmod(F.xxhash64("part", F.floor(F.col("ordinal") / 64)), F.lit(streams)).cast("int"))
    placed = work.save(dealt.groupBy("stream").applyInPandas(first, "doc_id long, piece int, start long, length long, ids_crc32 long, stream int, bin long, offset long, fill long, open boolean"), "placed")

    def again(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("bin", ignore_index=True)
        bins, offsets, _, _ = best_fit(x["fill"].tolist(), length, open_bins)
        return pd.DataFrame({"bin": x["bin"], "moved": x["bundle"].astype(np.int64) * (1 << 32) + bins, "base": offsets})

    left = placed.where("open").select("bin", "fill", F.floor(F.col("stream") / MERGED_STREAMS).cast("int").alias("bundle")).distinct()
    moved = left.groupBy("bundle").applyInPandas(again, "bin long, moved long, base long")
    columns = [F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    number = lambda kind, x: (x * 4 + kind).alias("sequence_id")  # noqa: E731  three kinds of sequence, no number twice
    return (
        whole.select(*columns, number(0, F.shiftleft(F.col("part").cast("long"), 40) + F.col("ordinal")), F.lit(0).cast("long").alias("offset"))
        .unionByName(placed.where("not open").select(*columns, number(1, F.col("bin")), "offset"))
        .unionByName(placed.where("open").join(moved, "bin").select(*columns, number(2, F.col("moved")), (F.col("offset") + F.col("base")).alias("offset")))
    )


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
