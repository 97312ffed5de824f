import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatloom.llm import jaccard_join as j
from chatloom.llm.hashing import mix


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def brute(rows):
    """doc_id -> (set size, smallest doc_id reachable) by comparing all pairs."""
    sets = [(i, shingles(x)) for i, x in rows]
    group = {i: i for i, _ in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for n, (i, a) in enumerate(sets):
        for k, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(k)))
                group[y] = x
    return {i: (len(a), find(i)) for i, a in sets}


def test_matches_brute_force(spark, texts):
    rows = list(enumerate(texts))
    got = j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


@pytest.mark.parametrize("small", [1, 3])
def test_large_tiles_lose_no_link(spark, texts, monkeypatch, small):
    monkeypatch.setattr(j, "SMALL_TILE", small)
    monkeypatch.setattr(j, "BLOCK", 4)
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(60)]
    chain = []
    for k in range(25):  # neighbours are near copies, the ends are not
        base = list(base)
        base[rng.integers(len(base))] = f"c{k}"
        chain.append(" ".join(base))
    rows = list(enumerate(texts + chain))
    got = j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


@pytest.mark.parametrize("contractions", [0, 2])
def test_contraction_changes_no_component(spark, monkeypatch, contractions):
    """A group whose copies link by chance only, in blocks of a few sets: with and without contraction as by brute force."""
    monkeypatch.setattr(j, "SMALL_TILE", 3)
    monkeypatch.setattr(j, "BLOCK", 7)
    monkeypatch.setattr(j, "CONTRACTIONS", contractions)
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(36):
        copy = list(base)
        for at in rng.choice(len(base), 1):
            copy[at] = f"e{k}x{at}"
        rows.append((k, " ".join(copy)))
    got = j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 1 < len({c for _, c in want.values()}) < len(rows)


def test_block_pairs_lose_no_link_at_any_width():
    rng = np.random.default_rng(3)
    pool = np.unique(mix(np.arange(1, 1200, dtype=np.uint64)))
    sets = sorted((np.sort(rng.choice(pool[: int(s * 1.1)], s, replace=False)) for s in rng.integers(2, 600, 150)), key=len)
    n, root = np.array([len(x) for x in sets]), np.arange(len(sets)) % 9
    for across in (False, True):
        side = np.arange(len(sets)) % 2
        i, k, most = j.block_pairs(n, root, side, [j.bitmap(x) for x in sets], across)
        found = set(zip(i.tolist(), k.tolist(), strict=True))
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                common = len(np.intersect1d(sets[a], sets[b]))
                if root[a] != root[b] and (not across or side[a] != side[b]) and j.links(common, n[a], n[b]):
                    assert (a, b) in found
        assert all(m >= len(np.intersect1d(sets[a], sets[b])) for a, b, m in zip(i, k, most, strict=True))


def test_null_ids_keep_their_links(spark, texts):
    words = [f"n{k}" for k in range(80)]
    near = [" ".join("changed" if k == i else w for k, w in enumerate(words)) for i in (7, 30, 61)]
    mixed = [f"m{k}" for k in range(50)]
    rows = list(enumerate(texts)) + [(None, x) for x in [*near, near[0], " ".join(mixed)]] + [(900, " ".join([*mixed, "more"]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(list(enumerate(x for _, x in rows)))
    groups = lambda pairs: {frozenset(x) for x in pairs.values()}
    expected, found = {}, {}
    for k, (_, x) in enumerate(rows):
        if shingles(x):
            expected.setdefault(want[k][1], set()).add(shingles(x))
    marks = {r.mark: r.text for r in frame.selectExpr("xxhash64(text) AS mark", "text").collect()}
    got = j.jaccard_components(frame).where("root IS NOT NULL").collect()
    for r in got:
        found.setdefault(r.root, set()).add(shingles(marks[r.mark]))
    assert groups(found) == groups(expected)
    assert {r.component_id for r in got if marks[r.mark].startswith("m0 ")} == {900}
    left = j.one_of_each(frame)
    assert left.where("text LIKE 'n0 %'").count() == 1 and [r.doc_id for r in left.where("text LIKE 'm0 %'").collect()] == [900]


def test_odd_rows_and_clashing_columns(docs, no_docs):
    got = j.jaccard_components(docs)
    assert got.count() == docs.count()
    assert got.where("doc_id IS NULL").first().component_id == 3
    assert j.jaccard_components(no_docs).count() == 0


def test_one_of_each_keeps_one_row_per_component(docs, no_docs):
    left = j.one_of_each(docs)
    assert left.columns == docs.columns
    found = j.jaccard_components(docs)
    roots = found.where("root IS NOT NULL").select("root").distinct().count()
    empty = found.where("root IS NULL").count()
    assert left.count() == roots + empty
    assert j.one_of_each(no_docs).count() == 0
    assert left.where(F.col("doc_id").isNull()).count() == 0


def test_bitmaps_bound_the_overlap_from_above():
    rng = np.random.default_rng(0)
    for _ in range(200):
        pool = np.unique(mix(rng.integers(0, 1 << 60, rng.integers(2, 900), dtype=np.uint64)))
        a, b = (np.sort(rng.choice(pool, rng.integers(1, len(pool) + 1), replace=False)) for _ in range(2))
        assert j.bound(j.bitmap(a).tobytes(), j.bitmap(b).tobytes(), len(a), len(b)) >= len(np.intersect1d(a, b))


def test_prefix_length_covers_the_threshold():
    for n in range(1, 400):
        assert j.prefix_length(n) >= 1 and n - j.prefix_length(n) + 1 <= -(-75 * n // 100)


def test_tile_rows_do_not_depend_on_batches():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x = pd.DataFrame({"h": rng.integers(0, 12, 900), "n": rng.integers(50, 90, 900), "fp": rng.integers(0, 300, 900)}).sort_values(["h", "n", "fp"], ignore_index=True)
    out = []
    for size in (900, 100, 7):
        batches = [pa.RecordBatch.from_pandas(x.iloc[i : i + size], preserve_index=False) for i in range(0, 900, size)]
        rows = pd.concat([b.to_pandas() for b in j._tile_rows(iter(batches))])
        members = rows[rows.kind == 1][["h", "a", "n"]].drop_duplicates()
        out.append(set(map(tuple, members.values.tolist())))
    assert out[0] == out[1] == out[2]
