"""Nothing is lost with a stored map of another shape, in long chains of near copies, or beyond a stated bound."""

import random
import subprocess
import sys

import numpy as np
import pyarrow.fs as pafs
import pytest
from parley.llm import planes, similar, slots, tiling, toxicity


@pytest.mark.parametrize("stored, asked, shards, fewer", [(256, 512, 16, 16), (512, 64, 16, 5), (64, 64, 4, 12)])
def test_stored_map_of_another_shape(spark, tmp_path, stored, asked, shards, fewer):
    docs = spark.range(1000).selectExpr("id AS doc_id", "repeat('x', int(id % 90)) AS text")
    path = f"file://{tmp_path}/map"
    slots.shard_by_slots(docs, shards, stored, path=path)
    rows, maps = slots.shard_by_slots(docs, fewer, asked, path=path)
    got = rows.collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1000))
    assert {r["shard"] for r in got} == set(range(fewer)) and max(r["vslot"] for r in got) < stored
    for s in range(fewer):
        assert sorted(r["pos"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(fewer)]
    assert max(load) - min(load) <= 4 * 91 and maps.filter("version = 2").count() == stored


def test_rows_of_other_slots_than_the_map_are_refused(spark, tmp_path):
    docs = spark.range(200).selectExpr("id AS doc_id", "string(id) AS text")
    slots.shard_by_slots(docs, 4, 16, path=f"file://{tmp_path}/map")
    with pytest.raises(ValueError):
        slots.edit_map(spark, f"file://{tmp_path}/map", slots.slotted(docs, 64), 4)


@pytest.mark.parametrize("n, length, missed", [(20, 100, 0), (6, 400, 0), (100, 20, 1)])
def test_chains_of_near_copies_are_one_group_each(spark, n, length, missed):
    """Each text of a chain is similar to the next one only; a refuted pair of a forest must not part it. ``missed``: pairs
    that share no bucket at all (as one in 60,000 of this similarity does), so parts that a chain may fall into besides."""
    rnd, texts = random.Random(1), []
    for _ in range(n):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
        for _ in range(length):
            texts.append((len(texts), " ".join(words)))
            for _ in range(2):
                words[rnd.randrange(120)] = f"w{rnd.randrange(10**6)}"
    got = sorted(r["doc_id"] for r in similar.survivors(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert set(got) >= {i * length for i in range(n)} and len(got) <= n + missed


def test_families_in_many_blocks_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(similar, "TILE_SHINGLES", 1500)
    test_chains_of_near_copies_are_one_group_each(spark, 10, 40, 0)


@pytest.mark.parametrize("first", [9, 30])
def test_tiles_join_what_all_pairs_join(first):
    rnd = random.Random(first)
    sets = [np.unique(np.array(rnd.sample(range(14), rnd.randint(0, 12)), np.uint64)) for _ in range(30)]
    roots = [bytes([rnd.randrange(20)]) for _ in sets]
    pairs = [(i, j) for i in range(30) for j in range(i + 1, 30) if first == 30 or (i < first <= j)]
    near = [(roots[i], roots[j]) for i, j in pairs if len(sets[i]) and len(a := np.intersect1d(sets[i], sets[j])) >= 0.5 * (len(sets[i]) + len(sets[j]) - len(a)) and len(a)]

    def parts(links):
        of = {r: {r} for r in roots}
        for x, y in links:
            both = of[x] | of[y]
            of.update({r: both for r in both})
        return {frozenset(v) for v in of.values()}

    got = similar.tile_links(sets, roots, first, 0.5)
    assert parts(got) == parts(near) and len(got) < len(set(roots))


def test_array_index_of_a_large_benchmark_is_small():
    """8 MB of items in a worker of its own, so that its memory is told apart."""
    code = (
        "import resource, random, time\n"
        "from parley.llm.tiling import Bench\n"
        "rnd = random.Random(1)\n"
        "words = [''.join(rnd.choices('abcdefghij', k=rnd.randint(2, 9))) for _ in range(20000)]\n"
        "items = [(i, ' '.join(rnd.choices(words, k=200))) for i in range(6200)]\n"
        "rss = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024\n"
        "before, t = rss(), time.process_time()\n"
        "bench = Bench(items, 5)\n"
        "print(sum(len(x) for _, x in items), rss() - before, time.process_time() - t, len(list(bench.covered(items[77][1]))))\n"
    )
    size, grown, seconds, found = map(float, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert size > 7.5e6 and grown < 100 and seconds < 6 and found == 1


def test_training_rows_of_a_repeated_id_are_one(spark):
    docs = spark.range(6500).selectExpr("id % 5 AS doc_id", "string(id) AS text")
    labels = spark.range(5).selectExpr("id AS doc_id", "int(id % 2) AS toxic")
    assert toxicity.training_rows(docs, labels, 10).count() <= 5


def test_files_of_other_schemes():
    assert isinstance(planes.file_system("file:///tmp/x")[0], pafs.LocalFileSystem)
    assert planes.arrow_uri("s3a://bucket/some/folder") == "s3://bucket/some/folder"
    assert planes.arrow_uri("hdfs://host:9000/x") == "hdfs://host:9000/x" and planes.arrow_uri("file:///x") == "file:///x"
