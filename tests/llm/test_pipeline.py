import random

import pytest

import corpus_pipeline
from chatloom.llm import jaccard_join, packing

from .conftest import prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    item = " ".join(f"bench{k}" for k in range(30))
    rows = [(i, prose(rng, rng.randint(30, 80)), "en") for i in range(120)]
    labels = [(i, 1, 0) for i in range(120)]
    for i in range(120, 180):
        rows.append((i, " | ".join(w + "!!!" for w in prose(rng, 40).split()), "en"))
        labels.append((i, 0, 0))
    rows += [(200, rows[4][1], "en"), (201, rows[5][1] + " extra", "en"), (202, f"{rows[6][1]} {item}", "en"), (203, None, "en"), (204, "", None), (205, "12345 !!!", "en")]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_stages_keep_columns_and_take_effect(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        path = f"{folder}/{name.replace(' ', '-')}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        ids.append({r.doc_id for r in docs.collect()})
    assert ids[0] == {r[0] for r in rows} - {203, 204, 205}
    assert ids[1] <= ids[0] and not ids[1] & set(range(120, 180)) and len(ids[1] & set(range(120))) >= 115
    assert ids[1] - ids[2] == {200, 201} & ids[1]
    assert ids[3] == ids[2] - {202}
    got = corpus_pipeline.run(spark, folder).collect()
    encode = packing.encoder(packing.default_tokenizer())
    texts = {r[0]: r[1] for r in rows}
    assert {r.doc_id for r in got} == ids[3]
    assert sum(r.length for r in got) == sum(len(encode(texts[i])) + 1 for i in ids[3])


def test_the_joins_constants():
    assert (jaccard_join.PERCENT, jaccard_join.WIDTH) == (75, 5)


def test_written_tables_give_the_drivers_freed_memory_back(spark, monkeypatch):
    """The driver's JVM is asked after a table is written, but not after each of many small ones."""
    from chatloom.llm import workspace

    said = []
    monkeypatch.setattr(workspace, "trim_driver", lambda spark, trim=workspace.trim_driver: said.append(trim(spark)))
    monkeypatch.setattr(workspace, "_trimmed", [float("-inf")])
    monkeypatch.setattr(workspace, "TRIM_S", 1000.0)
    work = workspace.Workspace(spark, "test")
    assert [work.save(spark.range(n), f"range-{n}").count() for n in (3, 4)] == [3, 4]
    assert "Trim native heap" in said[0] and said[1] is None
