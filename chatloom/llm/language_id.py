"""Language ID: interpolated Kneser-Ney character models, one per language.

A text is its words: runs of letters, lower-cased, each between word marks. A language's model gives
a character's probability after the up to ORDER - 1 characters before it in the word: discounted
counts at the highest order, continuation counts below, interpolated down to a uniform floor. All
models lie in one sorted array of n-gram hashes per order, with a column per language. A text gets
the language with the lowest cross-entropy per character, and a word that occurs often in a slice of
texts is looked up once.

Rejection is calibrated on training texts held back from the counts: a text is accepted when its
cross-entropy is at most the language's own SLACK quantile of them plus MARGIN bits, with more room
for fewer letters. score is the posterior of the language among those learned (equal priors, of the
text's mean log-likelihood times at most EVIDENCE letters).

Learned from a bounded sample: about TRAIN_TEXTS labelled texts for each language, whole texts,
chosen by a hash of doc_id. Beyond MANY_LANGUAGES of them each has fewer texts, so that the models'
columns take no more memory in all, but at least one, so that every language is learned. Every text
is predicted, in whole, by one task. Null text or text without a letter: `und`, score 0, not accepted.
Equal cross-entropies: the first language by name. Repeated rows are learned and predicted row by row;
a null doc_id counts as training and keeps its row; of other columns only lang plays a part, in
learning. An empty table gives no rows. Where nothing can be learned (no labelled text), every text
is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix, text_slices

ORDER = 5
DISCOUNT = 0.75
TRAIN_TEXTS = 1500
MANY_LANGUAGES = 100
CALIBRATE = 5  # one sampled text in so many calibrates
SLACK = 0.995
MARGIN = 1.5
FEW_LETTERS = 6.0
EVIDENCE = 200
FLOOR = 1 / 4096
END = 1  # the word mark; letters are code points + 2

_LETTER: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Code point -> its lower-case form + 2 for letters, else 0."""
    if not _LETTER:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
                low = s.lower()
                table[c] = (ord(low) if len(low) == 1 else c) + 2
        _LETTER["table"] = table
    return _LETTER["table"]


def letter_words(buffer: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of a slice, where words start and end in them, and the index of each text's first word."""
    ascii_only = not len(buffer) or int(buffer.max()) < 128
    if ascii_only:
        points, first = buffer, begins
    else:
        points = np.frombuffer(buffer.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = (buffer & 0xC0) != 0x80
        first = np.r_[0, np.cumsum(lead)][begins]
    letters = _letters()[points]
    n = len(letters)
    inside = np.zeros(n + 1, bool)
    inside[:n] = letters != 0
    breaks = np.zeros(n + 1, bool)
    breaks[first] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | breaks))
    ends = np.flatnonzero(before & (~inside | breaks))
    return letters, starts, ends, np.searchsorted(starts, first)


def _distinct(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index per distinct word, and each word's place among them."""
    from .hashing import byte_hashes, span_hashes

    _, at, inverse = np.unique(span_hashes(byte_hashes(letters), starts, ends), return_index=True, return_inverse=True)
    return at, inverse


def _runs(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words end to end, each as mark, letters, mark; the word of each predicted character, and its place in the word (from 1)."""
    size = ends - starts
    word = np.repeat(np.arange(len(size)), size + 2)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size + 2) - size - 2, size + 2)
    source = np.clip(np.repeat(starts, size + 2) + place - 1, 0, max(0, len(letters) - 1))
    symbols = np.where((place == 0) | (place == np.repeat(size + 1, size + 2)), END, letters[source] if len(letters) else END).astype(np.uint64)
    return symbols, word, place


def _gram_hashes(symbols: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` symbols that end at each position (positions too near the start hold no use)."""
    out = np.zeros(len(symbols), np.uint64)
    for k in range(order):
        shifted = np.zeros(len(symbols), np.uint64)
        shifted[k:] = symbols[: len(symbols) - k] if k else symbols
        out = out + mix(shifted + np.uint64((k + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
    return mix(out + np.uint64(order))


def count_grams(texts: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order 1..ORDER: (hash, context hash, shorter n-gram's hash, count) of the distinct n-grams within words."""
    symbols = []
    for _, buffer, begins in text_slices(texts):
        letters, starts, ends, _ = letter_words(buffer, begins)
        at, inverse = _distinct(letters, starts, ends)
        symbols.append((*_runs(letters, starts[at], ends[at]), np.bincount(inverse, minlength=len(at))))
    out = []
    for order in range(1, ORDER + 1):
        own = []
        for s, word, place, times in symbols:
            full, shorter = _gram_hashes(s, order), _gram_hashes(s, order - 1)
            context = np.r_[np.zeros(1, np.uint64), shorter[:-1]]
            ok = (place >= order - 1) & (place >= 1)
            own.append((full[ok], context[ok], shorter[ok], times[word[ok]]))
        full, context, shorter, times = (np.concatenate(x) for x in zip(*own, strict=True))
        h, at, inverse = np.unique(full, return_index=True, return_inverse=True)
        out.append((h, context[at], shorter[at], np.bincount(inverse, weights=times).astype(np.float64)))
    return out


def kneser_ney(grams) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: sorted n-gram hashes with log2 interpolated probabilities; sorted context hashes with log2 back-off weights."""
    out, below = [], None
    for order in range(1, ORDER + 1):
        h, context, shorter, count = grams[order - 1]
        if order < ORDER:  # how many different characters stand before it; an n-gram that begins its word keeps its count
            wider, times = np.unique(grams[order][2], return_counts=True)
            at = np.minimum(np.searchsorted(wider, h), max(0, len(wider) - 1))
            more = np.zeros(len(h))
            if len(wider):
                more = np.where(wider[at] == h, times[at], 0)
            count = np.where(more > 0, more, count)
        c, inverse = np.unique(context, return_inverse=True)
        total = np.bincount(inverse, weights=count)
        kinds = np.bincount(inverse)
        back = DISCOUNT * kinds / total
        if below is None:
            lower = np.full(len(h), FLOOR)
        else:
            lower = 2.0 ** below[1][np.searchsorted(below[0], shorter)]
        p = np.maximum(count - DISCOUNT, 0) / total[inverse] + back[inverse] * lower
        below = (h, np.log2(p))
        out.append((h, np.log2(p), c, np.log2(back)))
    return out


class Models:
    """All languages' models: per order one sorted hash array, a column per language (NaN: not in it)."""

    def __init__(self, learned: dict[str, list]):
        self.languages = sorted(learned)
        self.grams, self.backs = [], []
        for order in range(ORDER):
            for into, (a, b) in ((self.grams, (0, 1)), (self.backs, (2, 3))):
                keys = np.unique(np.concatenate([learned[x][order][a] for x in self.languages] or [np.zeros(0, np.uint64)]))
                values = np.full((len(keys) + 1, len(self.languages)), np.nan, np.float32)
                for k, x in enumerate(self.languages):
                    values[np.searchsorted(keys, learned[x][order][a]), k] = learned[x][order][b]
                into.append((keys, values))
        self.limits = np.zeros((len(self.languages), 2))

    @staticmethod
    def _rows(table, hashes: np.ndarray) -> np.ndarray:
        keys, values = table
        if not len(keys):
            return values[np.zeros(len(hashes), np.int64)]
        at = np.searchsorted(keys, hashes)
        at[at == len(keys)] = len(keys) - 1
        return values[np.where(keys[at] == hashes, at, len(keys))]

    def word_bits(self, letters, starts, ends) -> np.ndarray:
        """Bits of each word (its end included) in each language."""
        symbols, word, place = _runs(letters, starts, ends)
        out = np.zeros((len(starts), len(self.languages)))
        keep = np.flatnonzero(place >= 1)
        hashes = [_gram_hashes(symbols, k) for k in range(ORDER + 1)]
        bits = np.full((len(keep), len(self.languages)), np.nan, np.float32)
        gone = np.zeros_like(bits)  # log2 of the back-off weights so far
        todo = np.arange(len(keep))
        for order in range(ORDER, 0, -1):
            own = todo[place[keep[todo]] >= order - 1]
            if len(own):
                found = self._rows(self.grams[order - 1], hashes[order][keep[own]]) + gone[own]
                open_ = np.isnan(bits[own])
                bits[own] = np.where(open_, found, bits[own])
                left = np.isnan(bits[own]).any(1)
                miss = own[left]
                back = self._rows(self.backs[order - 1], hashes[order - 1][keep[miss] - 1] if order > 1 else np.full(len(miss), hashes[0][0]))
                gone[miss] += np.where(np.isnan(back), 0, back)
                todo = np.setdiff1d(todo, own[~left], assume_unique=True)
        bits = np.where(np.isnan(bits), gone + np.log2(FLOOR), bits)
        edges = np.searchsorted(word[keep], np.arange(len(starts)))
        return -np.add.reduceat(bits, edges, axis=0, dtype=np.float64) if len(starts) else out

    def text_bits(self, buffer, begins) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text in each language, and its characters (word ends included)."""
        letters, starts, ends, first = letter_words(buffer, begins)
        at, inverse = _distinct(letters, starts, ends)
        per_word = self.word_bits(letters, starts[at], ends[at])
        total = np.zeros((len(begins), len(self.languages)))
        size = np.r_[0, np.cumsum(ends - starts + 1)]
        for k in range(len(self.languages)):
            sums = np.r_[0, np.cumsum(per_word[inverse, k])] if len(starts) else np.zeros(1)
            total[:, k] = sums[first]
        chars = np.diff(size[first])
        return np.diff(total, axis=0) / np.maximum(chars, 1)[:, None], chars

    def calibrate(self, bits: np.ndarray, chars: np.ndarray, truth: np.ndarray) -> None:
        """limits: per language, the bits per character that all but 1 - SLACK of its own calibrating texts stay below."""
        for k, x in enumerate(self.languages):
            own = bits[(truth == x) & (chars > 0), k] - FEW_LETTERS / np.sqrt(chars[(truth == x) & (chars > 0)])
            self.limits[k] = (np.quantile(own, SLACK) if len(own) else 24.0) + MARGIN, len(own)

    def predict(self, bits: np.ndarray, chars: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        best = bits.argmin(1)
        log = -(bits - bits.min(1, keepdims=True)) * np.minimum(chars, EVIDENCE)[:, None]
        score = 1 / np.exp2(log).sum(1)
        accepted = (bits[np.arange(len(best)), best] <= self.limits[best, 0] + FEW_LETTERS / np.sqrt(np.maximum(chars, 1))) & (chars > 0)
        return ["und" if not c else self.languages[b] for b, c in zip(best, chars, strict=True)], np.where(chars > 0, score, 0.0), accepted


def _sampled(labelled: DataFrame, texts: int) -> DataFrame:
    """About `texts` rows of each language, or fewer of many languages; one of them at least trains."""
    languages = labelled.select("lang").distinct().count()
    texts = texts * min(1.0, MANY_LANGUAGES / max(1, languages)) ** 2  # n-grams and columns both grow with the languages
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATE)) == 0
    order = F.struct((~F.col("text").rlike(r"\p{L}")).alias("empty"), calibrates.alias("calibrates"), draw.alias("draw"), F.xxhash64("text").alias("mark"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("count"), F.min(order).alias("first"))
    share = sizes.select("lang", (F.lit(float(texts)) / F.col("count")).alias("share"), "first")
    is_first = order == F.col("first")
    return labelled.join(F.broadcast(share), "lang").where((draw < F.col("share")) | is_first).withColumn("calibrates", calibrates & ~is_first).drop("first")


def _learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One language's model, as a row of arrays per order."""
    out = []
    texts = pa.RecordBatch.from_pandas(rows[["text"]], preserve_index=False)
    for order, arrays in enumerate(kneser_ney(count_grams(texts))):
        h, p, c, b = arrays
        out.append((key[0], order, h.tobytes(), p.astype(np.float32).tobytes(), c.tobytes(), b.astype(np.float32).tobytes()))
    return pd.DataFrame(out, columns=["lang", "order", "h", "p", "c", "b"])


def learn(labelled: DataFrame, texts: int = TRAIN_TEXTS) -> Models:
    """Models from labelled (doc_id, text, lang): at most about `texts` texts of a language reach one task."""
    sample = _sampled(labelled.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), texts)
    rows = sample.where("not calibrates").select("lang", "text").groupBy("lang").applyInPandas(_learn, "lang string, order int, h binary, p binary, c binary, b binary").collect()
    learned: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.order)):
        learned.setdefault(r.lang, []).append((np.frombuffer(r.h, np.uint64), np.frombuffer(r.p, np.float32), np.frombuffer(r.c, np.uint64), np.frombuffer(r.b, np.float32)))
    models = Models({x: a for x, a in learned.items() if len(a[0][0])})
    if models.languages:
        held = labelled.sparkSession.sparkContext.broadcast(models)

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, buffer, begins in text_slices(batch):
                    b, n = held.value.text_bits(buffer, begins)
                    yield pa.RecordBatch.from_arrays([rows.column("lang"), pa.array(list(b), pa.list_(pa.float64())), pa.array(n, pa.int64())], names=["lang", "bits", "chars"])

        calibrating = sample.where("calibrates").select("lang", "text").mapInArrow(bits, "lang string, bits array<double>, chars long").toPandas()
        if len(calibrating):
            models.calibrate(np.array(calibrating["bits"].tolist()), calibrating["chars"].to_numpy(), calibrating["lang"].to_numpy())
        else:
            models.limits[:, 0] = 24.0
        held.unpersist()
    return models


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score, accepted, bits_per_char of every row of docs (doc_id, text, ...)."""
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = held.value
        for batch in batches:
            for rows, buffer, begins in text_slices(batch):
                if models.languages:
                    bits, chars = models.text_bits(buffer, begins)
                    names, score, accepted = models.predict(bits, chars)
                    least = np.where(chars > 0, bits.min(1), np.nan)
                else:
                    n = rows.num_rows
                    names, score, accepted, least = ["und"] * n, np.zeros(n), np.zeros(n, bool), np.full(n, np.nan)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(accepted), pa.array(least, from_pandas=True)], names=["doc_id", "lang_pred", "score", "accepted", "bits_per_char"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean, bits_per_char double")


def accepted_documents(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of docs that are in a learned language, as they are."""
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buffer, begins in text_slices(batch):
                if held.value.languages:
                    yield rows.filter(pa.array(held.value.predict(*held.value.text_bits(buffer, begins))[2]))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = learn(docs.where(~held_out()))
    return predict(docs, models).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted", "bits_per_char")
