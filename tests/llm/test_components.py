"""Connected components: blocks of any size against brute force, and the number of tasks they take."""

import random

import pytest
from parley.llm import components


def roots_of(pairs):
    root = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        if a in root and b in root:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("limit", [1, 7, 1 << 17])
def test_blocks_of_any_size(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "BLOCK_EDGES", limit)
    monkeypatch.setattr(components, "MAX_ROUNDS", 12)
    rnd = random.Random(limit)
    chain = [(i, i + 1) for i in range(-40, 40)]
    rnd.shuffle(chain)
    hub = [(500, x) for x in range(501, 560)]
    loose = [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(90)]
    pairs = [*chain, *hub, *loose, *loose[:9], (7, 7), (2000, 2000), (None, 3), (3, None), (-(2**63), 2**63 - 1)]
    for kind, of in (("long", lambda x: x), ("binary", lambda x: x.to_bytes(16, "big", signed=True))):
        rows = [tuple(x if x is None else of(x) for x in p) for p in pairs]
        found = components.connected_components(spark.createDataFrame(rows, f"src {kind}, dst {kind}").repartition(9)).collect()
        assert len(found) == len({bytes(r["node"]) if kind == "binary" else r["node"] for r in found})
        got = {r["node"]: r["root"] for r in found}
        assert {(bytes(k), bytes(v)) if kind == "binary" else (k, v) for k, v in got.items()} == set(roots_of(rows).items())


def test_few_tasks_for_what_fits_in_a_block(spark):
    """The driver holds figures of every task: rounds of shuffles over 16 forests of 3000 nodes took thousands of them."""
    rnd, forests = random.Random(3), []
    for _ in range(16):
        nodes = list(range(3000))
        rnd.shuffle(nodes)
        forests += [(a, b) for a, b in zip(nodes, nodes[1:]) if a % 9 and a % 100 == b % 100 or a // 50 == b // 50]
    parts, sc = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("components", "components")
    try:
        got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(forests, "src long, dst long").repartition(40)).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == roots_of(forests)
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("components") for s in told.getJobInfo(j).stageIds}
    tasks = sum(i.numTasks for s in stages if (i := told.getStageInfo(s)))
    assert 0 < tasks < 400, tasks
