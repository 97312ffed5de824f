import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatloom.llm import language_id, lattice, quality

from .conftest import prose

TONGUES = {"en": ("the", "ing", "tion", "sh", "wh"), "de": ("der", "ung", "sch", "keit", "ü"), "fr": ("eau", "oi", "é", "ment", "que")}


def say(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(5)
    rows = [(i, say(rng, TONGUES[x], rng.randint(5, 60)), x) for i, x in enumerate(rng.choices(list(TONGUES), k=300))]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !!! ###", "fr"), (1003, "zq xj kv qx zzv jq xk vq zk qj", None), (1004, "the " * 30000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_of_held_out_texts(spoken):
    models = language_id.learn(spoken.where(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.predict(spoken, models).collect()}
    truth = {r.doc_id: r for r in spoken.collect()}
    tested = [r.doc_id for r in spoken.where(language_id.held_out()).where("doc_id < 1000").collect()]
    assert len(tested) > 40
    assert np.mean([got[i].lang_pred == truth[i].lang for i in tested]) > 0.97
    assert np.mean([got[i].accepted for i in tested]) > 0.97
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert not got[1003].accepted and got[1004].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.accepted_documents(spoken, models)
    assert kept.columns == spoken.columns and kept.count() == sum(r.accepted for r in got.values())


def test_every_language_of_many_is_learned(spark):
    say_in = lambda k, n: " ".join("".join(chr(0x4E00 + 20 * k + (i * 7 + j * 3) % 20) for j in range(4)) for i in range(n))
    rows = [(1000 * k + i, say_in(k, 10 + i), f"l{k:03}") for k in range(130) for i in range(1 + (k < 110))]
    docs = spark.createDataFrame([*rows, (7, "123", "l129")], "doc_id long, text string, lang string")
    models = language_id.learn(docs)
    assert models.languages == sorted({lang for _, _, lang in rows})
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, models).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    assert language_id.accepted_documents(docs, models).count() == len(rows)


def test_language_models_are_distributions(spoken):
    models = language_id.learn(spoken)
    word = np.frombuffer(b"the", np.uint8)
    letters = language_id._letters()[word]
    alphabet = sorted({int(c) for r in spoken.where("doc_id < 300").collect() for c in language_id._letters()[[ord(x) for x in r.text]] if c})
    ends = models.word_bits(letters, np.array([0]), np.array([3]))[0]
    longer = sum(2.0 ** -models.word_bits(np.r_[letters, c].astype(np.uint32), np.array([0]), np.array([4]))[0] for c in alphabet)
    assert (2.0**-ends > 0).all() and (longer < 1).all()


def test_no_labelled_text_and_no_text(spark):
    none = spark.createDataFrame([(1, "hello there", None)], "doc_id long, text string, lang string")
    models = language_id.learn(none)
    assert [r.lang_pred for r in language_id.predict(none, models).collect()] == ["und"]
    assert language_id.predict(none.limit(0), models).count() == 0
    assert language_id.accepted_documents(none, models).count() == 0


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        x = say(rng, TONGUES["en"], rng.randint(20, 60))
        rows.append((i, x if good else " | ".join(x.split()) if i % 2 else " ".join(w + "###" for w in x.split())))
        labels.append((i, int(good), 0))
    rows += [(900, None), (901, ""), (902, "the " * 30000)]
    labels += [(3, None, 0), (None, 1, 0), (77777, 1, 0), (5, labels[5][1], 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_of_held_out_texts(graded):
    docs, labels = graded
    model = quality.learn(docs, labels.where(~quality.held_out()))
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    got = {r.doc_id: r for r in quality.predict(docs.where(quality.held_out()), model).collect() if r.doc_id < 900}
    assert len(got) > 60
    assert np.mean([r.predicted == truth[i] for i, r in got.items()]) > 0.95
    every = quality.predict(docs, model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in every) and len(every) == docs.count()
    assert quality.accepted_documents(docs, model).count() == sum(r.predicted for r in every)


def test_quality_without_labels(graded):
    docs, labels = graded
    model = quality.learn(docs, labels.limit(0))
    assert {r.score for r in quality.predict(docs, model).collect()} == {0.5}
    assert quality.predict(docs.limit(0), model).count() == 0


def test_dual_coordinate_descent_reaches_the_margin():
    rows = [np.array([1, 2], np.uint32), np.array([3, 4], np.uint32)] * 20
    y = np.array([1, -1] * 20)
    ratio = np.zeros(quality.FEATURES)
    ratio[[1, 2]], ratio[[3, 4]] = 1.0, -1.0
    w, bias = quality.fit_linear(rows, y, ratio)
    margins = [y[i] * (w[rows[i]] @ (ratio[rows[i]] / np.sqrt(2)) + bias) for i in range(2)]
    assert min(margins) > 0.99


def words_of(x):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]


def test_base_scores_against_a_plain_model(spark, docs, texts, no_docs):
    from collections import Counter
    from math import log10

    marked = docs.withColumn("held_out", F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False)))
    rows = marked.collect()
    counts = Counter()
    for r in rows:
        if not r.held_out:
            counts.update([*words_of(r.text), "\n"])
    n, v = sum(counts.values()), len(counts)
    expected = sorted((r.doc_id is None, r.doc_id or 0, len(words_of(r.text)) + 1, sum(counts[w] > 0 for w in [*words_of(r.text), "\n"]), round(sum(log10((counts[w] + 1) / (n + v + 1)) for w in [*words_of(r.text), "\n"]), 6)) for r in rows)
    got = lattice.score(marked).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expected
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert lattice.score(no_docs.withColumn("held_out", F.lit(False))).count() == 0


def test_a_chunk_lists_each_word_once(docs):
    """With its text and count in one row."""
    from collections import Counter

    rows = docs.coalesce(1).select("doc_id", "text", F.lit(False).alias("held_out"))
    listed = [r for r in rows.mapInArrow(lattice._chunks, lattice._CHUNKS).collect() if r.h is not None]
    counts = Counter(w for r in rows.collect() for w in words_of(r.text))
    assert sorted((bytes(r.word).decode(), r.c) for r in listed if r.word is not None and r.c is not None) == sorted(counts.items())
    assert len(listed) == len(counts) and sorted(r.n_words for r in listed) == list(range(len(counts)))


@pytest.mark.parametrize("chunk, batch", [(1, 1), (100, 3), (3000, 7), (1 << 40, 1 << 16)])
def test_a_chunks_words_rebuild_its_texts(texts, monkeypatch, chunk, batch):
    """Whatever the sizes of chunks, slices and batches; no batch of words is larger than BATCH_ROWS."""
    from collections import Counter, defaultdict
    from types import SimpleNamespace

    monkeypatch.setattr(lattice, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lattice, "BATCH_ROWS", batch)
    monkeypatch.setattr(lattice, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(lattice, "text_slices", lambda rows, slices=lattice.text_slices: slices(rows, budget=500))
    ids = list(range(len(texts)))
    rows = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array([i % 4 == 1 for i in ids])], names=["doc_id", "text", "held_out"])
    words, own, counts = defaultdict(dict), {}, defaultdict(Counter)
    for out in lattice._chunks(iter([rows.slice(0, 20), rows.slice(20, 0), rows.slice(20)])):
        for r in out.to_pylist():
            if r["h"] is None:
                own[r["doc_id"]] = r
            else:
                assert out.num_rows <= batch and r["n_words"] not in words[r["chunk"]]
                words[r["chunk"]][r["n_words"]] = (r["word"].decode(), r["c"])
    for i, text in enumerate(texts):
        numbers, times = (np.frombuffer(own[i][c], np.uint32).tolist() for c in ("at", "times"))
        of = words[own[i]["chunk"]]
        assert {of[n][0]: t for n, t in zip(numbers, times, strict=True)} == Counter(words_of(text)) and own[i]["n_words"] == len(words_of(text))
        if i % 4 != 1:
            counts[own[i]["chunk"]].update(words_of(text))
    assert all(dict(of.values()) == {w: counts[k][w] for w, _ in of.values()} and len(dict(of.values())) == len(of) for k, of in words.items())


def test_marginals_sum_over_all_segmentations():
    pieces = [None, b"a", b"b", b"ab", lattice.MARK, lattice.MARK + b"a", *[bytes([c]) for c in range(256)]]
    weights = np.log(np.r_[1e-9, 0.2, 0.1, 0.05, 0.1, 0.15, np.full(256, 0.4 / 256)])
    model = lattice.Lattice(pieces, weights)
    p = {}
    for piece, w in zip(pieces, weights, strict=True):
        if piece:
            p[piece] = p.get(piece, 0) + np.exp(w)

    def total(x):
        return 1.0 if not x else sum(p.get(x[:k], 0) * total(x[k:]) for k in range(1, len(x) + 1))

    words = [b"a", b"ab", b"abab", "é".encode(), b"ba" * 4]
    assert np.allclose(model.marginals(words), [np.log(total(lattice.MARK + w)) for w in words])


def test_expected_counts_go_over_all_segmentations():
    pieces = [None, b"a", b"b", b"ab", b"aba", lattice.MARK, lattice.MARK + b"a", *[bytes([c]) for c in range(256)]]
    weights = np.log(np.random.default_rng(1).random(len(pieces)))
    model = lattice.Lattice(pieces, weights)
    value = dict(zip(model.first.tolist(), model.values.tolist(), strict=True))
    number = {p: k for k, p in reversed(list(enumerate(pieces))) if p}

    def segmentations(w):
        if not w:
            yield []
        for p, k in number.items():
            if w.startswith(p):
                for rest in segmentations(w[len(p) :]):
                    yield [k, *rest]

    words, times = [b"aba", b"abab", b"z", b"", b"bab"], [3, 1, 2, 5, 7]
    want = dict.fromkeys(value, 0.0)
    for w, c in zip(words, times, strict=True):
        ways = list(segmentations(lattice.MARK + w))
        share = np.exp([sum(value[k] for k in way) for way in ways])
        for way, p in zip(ways, share / share.sum(), strict=True):
            for k in way:
                want[k] += p * c
    assert np.allclose(model.expected(words, np.array(times)), [want[k] for k in model.first.tolist()])


def test_a_round_makes_the_training_words_likelier(docs, monkeypatch):
    marked = docs.withColumn("held_out", F.lit(False))
    totals = []
    for rounds in (0, 1, 2):
        monkeypatch.setattr(lattice, "ROUNDS", rounds)
        totals.append(sum(r.score for r in lattice.score(marked).collect()))
    assert totals[0] < totals[1] < totals[2]


def plain_kneser_ney(texts):
    """n-gram -> probability of its last character after the others, by dictionaries; and words' bits per character."""
    import re
    from collections import Counter, defaultdict

    words = [f"#{w.lower()}#" for t in texts for w in re.findall(r"[^\W\d_]+", t)]
    n = language_id.ORDER
    counts = [Counter(w[e - k : e] for w in words for e in range(2, len(w) + 1) if e - k >= 0) for k in range(n + 1)]
    use = {}
    for k in range(1, n + 1):
        before = defaultdict(set)
        if k < n:
            for g in counts[k + 1]:
                before[g[1:]].add(g)
        use[k] = {g: len(before[g]) if k < n and before[g] else c for g, c in counts[k].items()}
    total, kinds = defaultdict(float), Counter()
    for k in use:
        for g, c in use[k].items():
            total[k, g[:-1]] += c
            kinds[k, g[:-1]] += 1

    def p(g):
        if not g:
            return language_id.FLOOR
        k, context = len(g), (len(g), g[:-1])
        if not total[context]:
            return p(g[1:])
        seen = use[k].get(g)
        back = language_id.DISCOUNT * kinds[context] / total[context] * p(g[1:])
        return back if seen is None else max(seen - language_id.DISCOUNT, 0) / total[context] + back

    def bits(text):
        own = [f"#{w.lower()}#" for w in re.findall(r"[^\W\d_]+", text)]
        return -sum(np.log2(p(w[max(0, e - n) : e])) for w in own for e in range(2, len(w) + 1)) / sum(len(w) - 1 for w in own)

    return bits


def test_language_models_against_plain_kneser_ney():
    rng = random.Random(4)
    learned = {"a": [prose(rng, 60) for _ in range(5)] + ["Ünïcode wörd ß"], "b": [prose(rng, 60, ("lo", "ma", "ki", "ne", "su")) for _ in range(5)]}
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array(x)], names=["text"])
    models = language_id.Models({k: language_id.kneser_ney(language_id.count_grams(batch(x))) for k, x in learned.items()})
    plain = [plain_kneser_ney(learned[k]) for k in models.languages]
    asked = [prose(rng, 20), prose(rng, 20, ("lo", "ki", "the")), "zzz qqq", "a", "Wörd lomaki 12 ß", learned["a"][0]]
    for _, buffer, begins in language_id.text_slices(batch(asked)):
        got, chars = models.text_bits(buffer, begins)
        assert np.allclose(got, [[f(x) for f in plain] for x in asked], rtol=1e-4)


def test_quality_scores_against_plain_features():
    """Features, margins and scores of texts, one by one, from plain words."""
    import re

    rng = random.Random(7)
    texts = [prose(rng, 30) + (" BUY!!! now" if k % 2 else "") for k in range(80)] + ["", "x x x", "Ä b!"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    ((_, buffer, begins),) = list(quality.text_slices(batch))
    rows = quality.features(buffer, begins)
    alone = [quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in texts]
    assert all((a == b).all() for a, b in zip(rows, alone, strict=True))

    def shape(w):
        kinds = [b if b < 128 and not chr(b).isalnum() else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else "a" for b in w.encode()]
        return tuple(k for k, before in zip(kinds, [None, *kinds], strict=False) if k != before)

    def plain(t):
        words = re.findall(r"[^ \t\n\v\f\r]+", t)
        low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
        own = {("w", x) for x in low} | {("s", shape(w)) for w in words}
        own |= {("ww", *x) for x in zip(low, low[1:], strict=False)} | {("ss", shape(a), shape(b)) for a, b in zip(words, words[1:], strict=False)}
        return own | {("same",) for a, b in zip(low, low[1:], strict=False) if a == b}

    kept = [plain(t) for t in texts]
    assert all(len(r) == len(k) or abs(len(r) - len(k)) <= 2 for r, k in zip(rows, kept, strict=True))  # hashes may meet
    for i in range(0, 83, 7):
        for k in range(83):
            assert abs(len(np.intersect1d(rows[i], rows[k])) - len(kept[i] & kept[k])) <= 3
    y = np.array([k % 2 for k in range(80)] + [0, 0, 1])
    model = quality.Model(rows, y, np.arange(83) % 5 == 0)
    for x in rows:
        v = model.value[x].sum() / max(np.sqrt(model.scale[x].sum()), 1e-12) + model.bias
        assert model.score(x) == pytest.approx(1 / (1 + np.exp(-(model.a * v + model.b))))
