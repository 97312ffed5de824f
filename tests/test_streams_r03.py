"""Streams that hold no rows in Python."""

import time

from chatloom.streaming import state


def _run(spark, tmp_path, batches, **options):
    schema = "k string, v long"
    for rows, pause in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        once = state.exactly_once(spark.readStream.schema(schema).json(f"{tmp_path}/in"), ["k"], **options)
        once.writeStream.format("json").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        time.sleep(pause)
    return once, sorted(map(tuple, spark.read.schema(schema).json(f"{tmp_path}/out").collect()), key=repr)


def test_rows_once_without_python(spark, tmp_path):
    once, got = _run(spark, tmp_path, [([("a", 1), ("a", 1), ("b", 1), (None, 1)], 0), ([("a", 2), ("c", 2), (None, 2)], 0)], expires=False)
    assert got == sorted([(None, 1), ("a", 1), ("b", 1), ("c", 2)], key=repr)
    assert "Pandas" not in once._jdf.queryExecution().analyzed().toString() and once.columns == ["k", "v"]


def test_rows_within_a_while_once(spark, tmp_path):
    once, got = _run(spark, tmp_path, [([("a", 1), ("a", 1), ("b", 1)], 0), ([("a", 2), ("c", 2)], 9), ([("d", 3)], 0), ([("e", 4)], 0), ([("a", 5)], 0)], replay_ms=8_000)
    assert got == [("a", 1), ("a", 5), ("b", 1), ("c", 2), ("d", 3), ("e", 4)]
    assert "Pandas" not in once._jdf.queryExecution().analyzed().toString() and once.columns == ["k", "v"]
