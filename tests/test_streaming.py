"""A conversation split over files in any way gives the batch's utterances; batches are written exactly once."""

import random
import threading

import pytest
from parley.operators.prepare import load_volleys, split_utterances
from parley.sources import batches
from parley.streaming import incremental
from pyspark.sql import functions as F

SHAPE = "conv_id long, turn long, role string, text string"


def turns_of(rnd, n=25):
    return [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["Hello. I try!", "", None, "One\ntwo? Three.", "..."])) for c in range(n) for t in range(rnd.randint(1, 9))]


def stream(spark, tmp_path, **how):
    q = incremental.annotate_stream(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], SHAPE).schema, str(tmp_path / "out"), str(tmp_path / "cp"), lambda u: u.withColumn("code", F.upper("speaker")), **how)
    assert q.awaitTermination(120) and q.exception() is None


def rows_of(df):
    return sorted(tuple(r) for r in df.select("conv_id", "conv_vol_idx", "conv_utt_idx", "speaker", "utt_text").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_and_a_restart_give_the_batch_rows(spark, tmp_path, seed):
    rnd = random.Random(seed)
    turns = turns_of(rnd)
    rnd.shuffle(turns)
    cuts = sorted(rnd.sample(range(1, len(turns)), 4))
    parts = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)])]
    for n, part in enumerate(parts):
        if n == 3:
            stream(spark, tmp_path, files_at_once=1)  # what came so far; the query is then started again
            part = part + parts[0][:5]  # turns that come twice
        spark.createDataFrame(part, SHAPE).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    stream(spark, tmp_path, files_at_once=1)
    got = batches.read_batches(spark, str(tmp_path / "out"))
    assert rows_of(got) == rows_of(split_utterances(load_volleys(spark.createDataFrame(turns, SHAPE))))
    assert got.filter("code <> upper(speaker)").count() == 0 and len(batches.committed(spark, str(tmp_path / "out"))) >= 5


def test_a_silent_conversation_is_passed_on_with_its_gap(spark, tmp_path):
    write = lambda rows, n: spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    write([(1, 0, "user", "A. B."), (1, 2, "user", "C."), (1, 4, "user", "D.")], 0)
    stream(spark, tmp_path, silence_ms=1)
    assert [r[2] for r in rows_of(batches.read_batches(spark, str(tmp_path / "out")))] == [0, 1]
    write([(2, 0, "user", "Other.")], 1)
    stream(spark, tmp_path, silence_ms=1)
    write([(3, 0, "user", "Other."), (1, 5, "user", "Late. Later.")], 2)
    stream(spark, tmp_path, silence_ms=1)
    got = [r[1:3] + (r[4],) for r in rows_of(batches.read_batches(spark, str(tmp_path / "out"))) if r[0] == 1]
    assert got == [(0, 0, "A."), (0, 1, "B."), (2, 2, "C."), (4, 3, "D."), (5, 4, "Late."), (5, 5, "Later.")]


def test_a_batch_replaces_itself_and_no_other(spark, tmp_path):
    path, of = str(tmp_path / "t"), lambda *values: spark.createDataFrame([(v,) for v in values], "x int")
    with pytest.raises(FileNotFoundError):
        batches.read_batches(spark, path)
    assert batches.write_batch(of(1, 2), path, "a") == 2 and batches.write_batch(of(), path, "empty") == 0
    batches.write_batch(of(3), path, "b")
    batches.write_batch(of(7, 8, 9), path, "a")
    read = lambda: sorted(r["x"] for r in batches.read_batches(spark, path).collect())
    assert read() == [3, 7, 8, 9]
    of(99).write.parquet(f"{path}/batch=c/attempt=lost")  # a writer that failed before it committed
    assert read() == [3, 7, 8, 9] and batches.remove_uncommitted(spark, path) == 0
    assert batches.remove_uncommitted(spark, path, 0) == 1 and read() == [3, 7, 8, 9]
    batches.write_batch(of(5).withColumn("y", F.lit("new")), path, "d")
    assert batches.read_batches(spark, path).filter("y IS NULL").count() == 4
    with pytest.raises(ValueError):
        batches.write_batch(of(1), path, "../x")


def test_an_append_reads_no_old_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    batches.write_batch(spark.range(5), path, "a")
    for f in (tmp_path / "t" / "batch=a").rglob("*.parquet"):
        f.write_bytes(b"no parquet any more")
    assert batches.write_batch(spark.range(3), path, "b") == 3


def test_writers_at_the_same_time(spark, tmp_path):
    path, failed = str(tmp_path / "t"), []

    def work(own):
        try:
            for n in range(3):
                batches.write_batch(spark.range(10).select((F.col("id") + 10 * n).alias("id")), path, f"shared-{n}")
                batches.write_batch(spark.range(1).select(F.lit(-own).cast("long").alias("id")), path, f"{own}-{n}")
        except Exception as e:  # noqa: BLE001 shown below
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = sorted(r["id"] for r in batches.read_batches(spark, path).collect())
    assert not failed and got == [*[-2] * 3, *[-1] * 3, *range(30)]
