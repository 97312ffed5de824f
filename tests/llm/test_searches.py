import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.llm import decontaminate, licenses, nearest


def test_mih_finds_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (500, 8), dtype=np.uint8)
    index = nearest.Index(codes)
    for radius in (0, 3, 7, 8, 20, 29, 64):
        for q in (codes[3], rng.integers(0, 256, 8, dtype=np.uint8)):
            assert index.within(q, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ q).sum(1) <= radius).tolist()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[100:160] = x[7]  # copies of one vector
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [None] * 16), (1200, [1.0, 2.0]), (None, [1.0] * 16), (50, rows[50][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))


def test_nearest_against_brute_force(vectors):
    usable = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect() if r.vec_id is not None and r.vec_id < 1000}
    ids = np.array(sorted(usable))
    x = np.stack([usable[i] for i in ids])
    got = nearest.nearest(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == set(range(0, 400, 50))
    hits = 0
    for q in range(0, 400, 50):
        own = [r for r in got if r.query_id == q]
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in own}
        s = (x * usable[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((usable[q] ** 2).sum()))
        best = [(-v, i) for v, i in sorted(zip(-s, ids, strict=True)) if i != q][:5]
        hits += len({i for _, i in best} & {r.vec_id for r in own})
        for r in own:
            assert r.score == pytest.approx(s[list(ids).index(r.vec_id)], abs=1e-12)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
    assert hits >= 0.9 * 40
    hundred = [r.vec_id for r in got if r.query_id == 100]
    assert hundred == [7, 101, 102, 103, 104]


@pytest.mark.parametrize("scale", [1e-200, 1.0, 1e200])
def test_nearest_of_very_large_and_small_components(spark, scale):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 9)) * scale
    x[20:] *= 10.0 ** rng.integers(-60, 60, (40, 1))
    got = nearest.nearest(*[spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")] * 2).collect()
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert len(got) == 60 * 5
    for r in got:
        assert r.score == pytest.approx(float(unit[r.query_id] @ unit[r.vec_id]), abs=1e-12)


@pytest.mark.parametrize("rows, queries", [(100, 3), (8192, 32768)])
def test_recall_on_clusters_with_noise(spark, monkeypatch, rows, queries):
    """Every query's five nearest of 1,500 vectors in 12 noisy clusters, in one block or in many."""
    monkeypatch.setattr(nearest, "BLOCK_ROWS", rows)
    monkeypatch.setattr(nearest, "QUERY_ROWS", queries)
    rng = np.random.default_rng(9)
    x = (rng.standard_normal((12, 48))[rng.integers(0, 12, 1500)] + 0.7 * rng.standard_normal((1500, 48))).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = nearest.nearest(vectors, vectors.where("vec_id % 50 = 0")).collect()
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        near = unit @ unit[q]
        near[q] = -2
        hits += len(set(np.argsort(-near)[:5].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits >= 0.95 * 150


def test_nearest_with_few_or_no_vectors(spark, vectors):
    assert nearest.nearest(vectors.limit(0), vectors.limit(0)).count() == 0
    two = spark.createDataFrame([(50, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in nearest.nearest(two, two.where("vec_id = 50")).collect()] == [(50, 1, 3)]


def test_licenses_against_brute_force(docs, texts, no_docs, spark):
    extra = ["Licensed under CC  BY-NC 4.0.", "this is under the GNU Genral Public\nLicense", "All rights  reserved. all RIGHTS reserved", "x all rights reservedlywise", "general public license cc by", "Permision is herby granted, free of charge", "é all rights reserved é"]
    rows = list(enumerate(texts + extra))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, x in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    at = len(texts)
    assert got[at + 1].labels == "gpl" and got[at + 1].base_labels == "" and 0.8 < got[at + 1].score < 1
    assert got[at + 5].labels == "mit"
    assert got[at + 3].labels == ""
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(no_docs).count() == 0


def test_every_damaged_notice_beside_a_better_one_is_found():
    found = lambda text: [text[a:b] for _, a, b, _ in licenses.fuzzy_matches(text)]
    assert found("creatve comons attribution creative commons attribution") == ["creatve comons attribution", "creative commons attribution"]
    assert found("mit licence mit license") == ["mit licence", "mit license"]
    assert found("x mit license mit licence mit licnse y mit license") == ["mit license", "mit licence", "mit licnse", "mit license"]


def plain_matches(text, notice):
    """The matcher over the whole text, best first, then what stands before and after: no seeds, no windows."""
    _, (matcher,) = licenses._compiled((notice,))
    parts, found = [(0, len(text))], []
    while parts:
        a, b = parts.pop()
        if a < b and (m := matcher.search(text, a, b)):
            found.append((0, m.start(), m.end(), sum(m.fuzzy_counts)))
            parts += [(a, m.start() - 1), (m.end() + 1, b)]
    return sorted(found)


def test_fuzzy_matches_against_the_plain_matcher():
    rng = random.Random(0)
    for notice in licenses.NOTICES:
        for copies in (1, 2, 7, 30):
            parts = []
            for _ in range(copies):
                edited = list(notice.phrase)
                for _ in range(rng.randint(0, notice.errors + 1)):
                    k = rng.randrange(1, len(edited) - 1)
                    edited[k : k + rng.randint(0, 1)] = rng.choice(["", "q"])
                parts += ["".join(edited), *(rng.choice(["zz", "y", notice.phrase.split()[0], "w" * 40]) for _ in range(rng.randint(0, 6)))]
            text = " ".join(" ".join(parts).split())
            assert sorted(licenses.fuzzy_matches(text, (notice,))) == plain_matches(text, notice), (notice, text)


def test_license_scan_of_long_texts_is_linear(spark):
    """Seeds, base places and damaged notices that recur all through a text."""
    import time

    for unit in ("all rights reserved ", "general public lice nse ", "mit licence ", "permission is hereby "):
        took = []
        for times in (2000, 16000):
            began = time.process_time()
            list(licenses.fuzzy_matches((unit * times).strip()))
            licenses.words_before(unit * times, [at for at, _ in licenses.base_places(unit * times)])
            took.append(time.process_time() - began)
        assert took[1] < 8 * 3 * took[0] + 0.5, (unit, took)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def test_leaks_with_substitutions(spark):
    words = ITEM.split()
    broken = lambda at: " ".join("WRONG" if k in at else w for k, w in enumerate(words))
    filler = " ".join(f"f{k}" for k in range(40))
    rows = {
        1: f"{filler} {ITEM} {filler}",
        2: f"{filler} x {broken({5, 13, 20})} {filler}",
        3: ITEM.upper().replace(" ", ",  "),
        4: f"{filler} {' '.join(words[:9])} {filler}",
        5: filler,
        6: None,
        7: "",
        8: " ".join(reversed(words)),
        9: f"{filler} the quick brown fox runs",
        10: f"{filler} the quick brown cat runs",
        11: broken(set(range(0, 24, 2))),
    }
    docs = spark.createDataFrame([*rows.items(), (1, rows[1]), (None, rows[1])], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "the quick brown fox runs"), (3, "too short"), (4, None), (5, ""), (None, ITEM)], "item_id long, text string")
    got = decontaminate.leaks_by_document(docs, items).collect()
    assert sorted(((r.doc_id or 0), r.item_id) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (9, 2)]
    first = {r.doc_id: r for r in got}
    assert (first[1].first_word, first[1].similarity) == (40, 1.0)
    assert 0.8 <= first[2].similarity < 1
    kept = decontaminate.clean_documents(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8, 10, 11]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_leaks_by_shuffled_joins_too(docs, spark, texts, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
    monkeypatch.setattr(decontaminate, "BROADCAST_TEXTS", limit)
    items = spark.createDataFrame([(1, " ".join(texts[1].split()[:40])), (2, " ".join(texts[99].split()[777:800]))], "item_id long, text string").withColumn("words", F.lit(0))
    got = {r.doc_id for r in decontaminate.leaks_by_document(docs, items).where("item_id = 2").collect()}
    assert 99 in got
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns and kept.where("doc_id = 99").count() == 0
    assert decontaminate.clean_documents(docs.limit(0), items).count() == 0
    assert decontaminate.clean_documents(docs, items.limit(0)).count() == docs.count()


def test_masks_meet_every_agreement_that_counts():
    for n in range(decontaminate.SPAN, decontaminate.WINDOW + 1):
        laid = [sum(1 << k + at for k, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for at in range(n - len(m) + 1)]
        for changed in itertools.combinations(range(n), n - -(-3 * n // 4)):
            gone = sum(1 << k for k in changed)
            assert any(not m & gone for m in laid), (n, changed)


def test_substituted_items_at_any_word_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(300)]
    items = {n: [rng.choice(vocabulary) for _ in range(n)] for n in [*range(8, 21), 33]}
    texts = []
    for n, words in items.items():
        for offset in (0, 1, 6, 7):
            for changed in {0, 1, n // 4, n // 4 + 1}:
                copy = list(words)
                for k in rng.sample(range(n), changed):
                    copy[k] = "changed"
                texts.append([f"f{rng.randrange(10**6)}" for _ in range(offset)] + copy + ["end"] * rng.randint(0, 3))
        texts.append(words[n // 4 :] + ["cut"])
    best = {}
    for i, text in enumerate(texts):
        for n, words in items.items():
            size = min(n, 20)
            for shift in range(-n, len(text)):
                same = [0 <= shift + j < len(text) and text[shift + j] == w for j, w in enumerate(words)]
                for s in range(n - size + 1):
                    matched = sum(same[s : s + size])
                    if matched >= 0.75 * size:
                        best[i, n] = max(best.get((i, n), (0, -(10**6))), (matched, -(shift + s)))
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = decontaminate.leaks_by_document(docs, spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.n_matched, -r.first_word) for r in got} == best
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_items_without_an_id_and_short_items(spark):
    rows = [(1, f"x {ITEM}"), (2, "Yes, we can!"), (3, "yes we can do it"), (4, "one two three four five six"), (5, "no"), (6, "--"), (7, "yes we")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(None, ITEM), (1, "yes we can"), (None, "yes we can"), (2, "two three four five six"), (None, "no"), (3, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks_by_document(docs, items).collect()}
    assert got == {(1, None), (2, 1), (4, 2), (5, None)}
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, items).collect()) == [3, 6, 7]
