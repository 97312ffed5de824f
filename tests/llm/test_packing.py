import random
import zlib

import numpy as np
import pytest

from chatloom.llm import packing


def check(rows, length=packing.LENGTH):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(by)


def test_ids_are_those_of_the_file():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["", " a  b\n\nc", "<|endoftext|>", "日本語 naïve 🎉 don't", "x" * 5000, "\u0000  "]
    rng = random.Random(0)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000)])) for _ in range(200)) for _ in range(50)]
    encode = packing.encoder(packing.default_tokenizer())
    assert [encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_and_places(docs, texts, no_docs):
    rows = packing.pack(docs, length=64).collect()
    encode = packing.encoder(packing.default_tokenizer())
    assert sum(r.length for r in rows) == sum(len(encode(r.text or "")) + 1 for r in docs.collect())
    check(rows, 64)
    for doc_id in (0, 1, 92, 93, 99):
        ids = np.array([*encode(texts[doc_id] or ""), 0], "<u4")
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert sum(r.length for r in own) == len(ids) and all(r.length == 64 for r in own[1:])
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("bins", [1, 4, 1000])
def test_best_fit_against_a_plain_model(bins):
    rng = random.Random(bins)
    sizes = [rng.randint(1, 50) for _ in range(500)]
    got, offsets, fill, still = packing.best_fit(sizes, 50, bins)
    open_, filled, expected = [], [], []
    for s in sizes:
        fits = [b for b in open_ if 50 - filled[b] >= s]
        if fits:
            best = min(50 - filled[b] for b in fits)
            b = next(b for b in expected_order(open_, filled, best))
        else:
            if len(open_) == bins:
                fullest = max(filled[b] for b in open_)
                open_.remove(next(b for b in expected_order(open_, filled, 50 - fullest)))
            b = len(filled)
            filled.append(0)
            open_.append(b)
        expected.append(filled[b])
        filled[b] += s
        open_.remove(b)
        if filled[b] < 50:
            open_.append(b)
    assert sorted(fill.tolist()) == sorted(filled)
    assert offsets.tolist() == expected
    assert all(f <= 50 for f in fill) and still.sum() <= bins


def expected_order(open_, filled, free):
    """Bins with this much free space, the one that got it first in front."""
    return (b for b in open_ if 50 - filled[b] == free)


def test_few_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "STREAM_ROWS", 100)
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " x" * rng.randint(1, 40)) for i in range(800)], "doc_id long, text string").repartition(4)
    rows = packing.pack(docs, length=128).collect()
    assert check(rows, 128) <= 1.03 * sum(r.length for r in rows) / 128 + 2
