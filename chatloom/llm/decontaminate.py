"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Words are runs of letters and digits, lower-cased. A seed is the hash of the words at the marked
places of a mask; the places between are ignored, so that a seed survives substitutions there. Every
seed of the benchmark items meets the documents' seeds at every word. Each hit names a text, an item
and the offset between them, and around it the item is laid over the document: with L = the item's
words, at most WINDOW, a text is contaminated where L words in a row of the item agree with the
document in at least SIMILARITY of the places. The masks are chosen so that every such agreement of
SPAN to WINDOW words holds a whole seed (a test goes through all of them), so none is missed. The
best such place is reported per text and item.

Items of fewer than SPAN words have one seed of all their words and so match word for word; items
of fewer than SHORTEST words stand in many clean texts and match only a text that has no other words.
An item is known by a hash of its words: rows of the benchmark without an item_id are searched too,
and their leaks have a null item_id unless the same words have an id. A text is known by a hash of
itself, so copies are verified together and repeated rows, null or repeated doc_ids each get their
own text's result. Null texts and items, and those without words, match nothing.

The benchmark's seeds are broadcast up to BROADCAST_SEEDS of them, and the hashes of texts with hits
up to BROADCAST_TEXTS; beyond that both are shuffled joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

MASKS = ("11101", "100111", "1101001")
SPAN = 8
WINDOW = 20
SIMILARITY = 0.75
SHORTEST = 5
BROADCAST_SEEDS = 200_000
BROADCAST_TEXTS = 500_000


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(words: str, mask: int, at: Column) -> Column:
    """Null where the mask does not fit."""
    marked = [k for k, c in enumerate(MASKS[mask]) if c == "1"]
    return F.when(at + len(MASKS[mask]) <= F.size(words), F.xxhash64(F.lit(mask), *(F.get(words, at + k) for k in marked)))


def _short_seed(words: str, length: int, at: Column) -> Column:
    fits = at + length <= F.size(words) if length >= SHORTEST else F.size(words) == length
    return F.when(fits & (at + length <= F.size(words)), F.xxhash64(F.lit(-length), *(F.get(words, at + k) for k in range(length))))


def _seeds_at_every_word(texts: DataFrame, kept: list[str], lengths: list[int]) -> DataFrame:
    """seed, place and the kept columns of every seed of texts (words, ...), short ones of these lengths.

    The places are exploded first and hashed then, which Spark compiles; lambdas over arrays are interpreted.
    """
    at = texts.select(*kept, "words", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)))).alias("place"))
    seeds = [_seed("words", m, F.col("place")) for m in range(len(MASKS))] + [_short_seed("words", n, F.col("place")) for n in lengths]
    return at.select(*kept, "place", F.explode_outer(F.array(*seeds)).alias("seed"))


def item_seeds(items: DataFrame) -> DataFrame:
    """seed, item, place of every seed of items (item, words)."""
    long = _seeds_at_every_word(items.where(F.size("words") >= SPAN), ["item"], [])
    short = [items.where(F.size("words") == n).select("item", F.lit(0).alias("place"), _short_seed("words", n, F.lit(0)).alias("seed")) for n in range(1, SPAN)]
    for x in short:
        long = long.unionByName(x)
    return long.where("seed is not null").select("seed", "item", "place")


def find_leaks(docs: DataFrame, benchmark: DataFrame, work: Workspace | None = None) -> DataFrame:
    """text_hash, item_id, first_word, n_words, n_matched, similarity: a row per contaminated text of docs (text, ...) and item of benchmark (item_id, text)."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "leaks")
    listed = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("words"))
    listed = work.save(listed.where(F.size("words") > 0).withColumn("item", F.xxhash64("words")).distinct(), "listed")
    items = work.save(listed.select("item", "words").dropDuplicates(["item"]), "items")
    named = listed.where("item_id is not null").select("item", "item_id")
    ids = named.unionByName(listed.where("item_id is null").select("item", "item_id").join(named, "item", "left_anti"))
    seeds = work.save(item_seeds(items), "seeds")
    lengths = sorted(r.n for r in items.where(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct().collect())  # at most SPAN - 1 numbers

    texts = docs.where("text is not null").select(F.xxhash64("text").alias("text_hash"), "text")
    laid = _seeds_at_every_word(texts.select("text_hash", word_hashes(F.col("text")).alias("words")), ["text_hash"], lengths)
    held = seeds.withColumnRenamed("place", "item_place")
    hits = laid.join(F.broadcast(held) if seeds.count() <= BROADCAST_SEEDS else held, "seed")
    candidates = work.save(hits.select("text_hash", "item", (F.col("place") - F.col("item_place")).cast("int").alias("shift")).distinct(), "candidates")

    wanted = candidates.select("text_hash").distinct()
    some = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    some = some.select("text_hash", word_hashes(F.col("text")).alias("words"))
    paired = candidates.join(items.withColumnRenamed("words", "item_words"), "item").join(some, "text_hash")
    same = F.transform("item_words", lambda w, j: F.coalesce((F.when(F.col("shift") + j >= 0, F.get("words", F.col("shift") + j)) == w).cast("int"), F.lit(0)))
    length = F.size("item_words")
    n = F.least(length, F.lit(WINDOW))
    least = F.when(n < SPAN, n).otherwise(F.ceil(n * SIMILARITY))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    windows = lambda q: F.array_max(F.transform(F.sequence(F.lit(0), length - n), lambda s: F.struct(total(F.slice(q, s + 1, n)).alias("matched"), (-s).alias("back"))))
    best = F.get(F.transform(F.array(same), lambda q: F.when(total(q) >= least, windows(q))), F.lit(0))  # a lambda's variable, so that it is computed once
    placed = work.save(paired.select("text_hash", "item", "shift", n.alias("n"), least.alias("least"), best.alias("best")), "placed")  # saved before the filter, which would compute it again
    placed = placed.where("best.matched >= least").join(ids, "item")
    best = placed.groupBy("text_hash", "item_id").agg(F.max(F.struct((F.col("best.matched") / F.col("n")).alias("similarity"), (-(F.col("shift") - F.col("best.back"))).alias("place"), "n", F.col("best.matched").alias("matched"))).alias("b"))
    return work.save(best.select("text_hash", "item_id", (-F.col("b.place")).cast("long").alias("first_word"), F.col("b.n").cast("long").alias("n_words"), F.col("b.matched").cast("long").alias("n_matched"), F.col("b.similarity").alias("similarity")), "leaks")


def leaks_by_document(docs: DataFrame, benchmark: DataFrame, work: Workspace | None = None) -> DataFrame:
    """The same per row of docs (doc_id, text, ...): doc_id, item_id, first_word, n_words, n_matched, similarity."""
    leaks = find_leaks(docs, benchmark, work)
    return _with_text_hash(docs.select("doc_id", "text"), leaks).drop("text_hash")


def _with_text_hash(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"))
    return rows.join(F.broadcast(leaks) if leaks.count() <= BROADCAST_TEXTS else leaks, "text_hash")


def clean_documents(docs: DataFrame, benchmark: DataFrame, work: Workspace | None = None) -> DataFrame:
    """The rows of docs whose text is not contaminated, as they are."""
    leaks = find_leaks(docs, benchmark, work).select("text_hash").distinct()
    held = F.broadcast(leaks) if leaks.count() <= BROADCAST_TEXTS else leaks
    marked = "text_hash"
    while marked in docs.columns:
        marked += "_"
    return docs.withColumn(marked, F.xxhash64("text")).join(held.withColumnRenamed("text_hash", marked), marked, "left_anti").select(*docs.columns)


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks_by_document(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
