"""A stream that is killed and started again takes every file once."""

import random

import pytest

from gridloom.streaming import ingest

SCHEMA = "k string, t long, v double"


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


@pytest.mark.parametrize("keep", ["last", "first"])
def test_killed_and_restarted_run_equals_one_batch(spark, tmp_path, keep):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", "c", "d", None]), r.randrange(9), float(i)) for i in range(90)]
    source, target, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    for i in range(6):
        put(spark, source, f"part={i}", rows[i * 10 : i * 10 + 10])
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(source)
    seen = []

    def dies(batch):
        seen.append(batch)
        if batch == 1:
            raise RuntimeError("killed after writing, before the batch counts as done")

    with pytest.raises(Exception, match="killed"):
        ingest.ingest(stream(), ["k"], ["t"], target, checkpoint, keep=keep, after=dies).awaitTermination()
    ingest.ingest(stream(), ["k"], ["t"], target, checkpoint, keep=keep, after=seen.append).awaitTermination()
    assert seen[:3] == [0, 1, 1] and sorted(set(seen)) == list(range(len(set(seen))))
    table = lambda: sorted(map(tuple, ingest.ingested(spark, SCHEMA, ["k"], ["t"], target, keep=keep).collect()), key=str)
    best = max if keep == "last" else min
    whole = lambda rows: sorted([(k, *best((t, v) for q, t, v in rows if q == k)) for k in {q for q, _, _ in rows}], key=str)
    assert table() == whole(rows[:60])
    n = len(seen)
    for i in range(6, 9):
        put(spark, source, f"part={i}", rows[i * 10 : i * 10 + 10])
    ingest.ingest(stream(), ["k"], ["t"], target, checkpoint, keep=keep, after=seen.append).awaitTermination()
    assert table() == whole(rows) and min(seen[n:]) > max(seen[:n])  # only new batches
    n = len(seen)
    ingest.ingest(stream(), ["k"], ["t"], target, checkpoint, keep=keep, after=seen.append).awaitTermination()
    assert len(seen) == n  # nothing is new


def test_wrong_keep(spark):
    with pytest.raises(ValueError):
        ingest.one_of_each(spark.range(1), ["id"], ["id"], "any")
