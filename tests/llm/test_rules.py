"""Quality cascade, virtual slots and benchmark tiling against brute force."""

import re
import zlib
from collections import Counter

import pytest
from parley.llm import quality, slots, tiling


def slow_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def row(r):
    return r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]


def test_quality_query(spark, sf, documents):
    got = {r["doc_id"]: r for r in quality.op1_rule_cascade(spark, sf).collect()}
    rules = quality.make_rules()
    for d, t in zip(documents["doc_id"], documents["text"]):
        assert row(got[d]) == slow_base(t)
        m = quality.measure(t)
        assert got[d]["kept"] == (not m.base_failed and not any(f(m) for f in rules.values()))


def test_quality_query_equals_its_sql(spark, sf):
    from compare import difference, run_sql

    assert difference(quality.op1_rule_cascade(spark, sf).toPandas(), run_sql(quality.OP1_SQL, sf)) is None


def test_quality_edges(spark, edge, empty):
    got = quality.cascade(edge).collect()
    assert len(got) == edge.count() and quality.cascade(empty).count() == 0
    assert sorted(map(row, got)) == sorted(slow_base(r["text"]) for r in edge.collect())
    assert all(not r["kept"] for r in got if r["doc_id"] in (1, 2, 3))


def test_order_never_changes_the_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality.make_rules()
    keep = lambda order: {r["doc_id"]: r["kept"] for r in quality.cascade(docs, rules, order).collect()}
    assert keep(list(rules)) == keep(list(rules)[::-1])


def test_order_puts_cheap_rejection_first():
    rules = quality.make_rules()
    found = [("pairs", 1e-3, 0.5), ("symbols", 1e-6, 0.2), ("upper", 1e-6, 0.0), ("letters", 1e-5, 0.0)]
    assert quality.best_order(found, rules)[:4] == ["symbols", "pairs", "upper", "letters"]


def test_estimates_cover_all_rules(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = quality.estimate(docs, quality.make_rules(), sample_rows=50)
    assert {x[0] for x in found} == set(quality.make_rules()) and all(c >= 0 and 0 <= r <= 1 for _, c, r in found)


def test_slots_query(spark, sf, documents):
    texts = dict(zip(documents["doc_id"], documents["text"]))
    got = slots.op8_fixed_virtual_slots(spark, sf).collect()
    assert len(got) == len(texts)
    load, places = Counter(), {}
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert set(load) == set(range(16)) and max(load.values()) < 1.02 * min(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_slot_edges(spark, edge, empty):
    rows, maps = slots.shard_by_slots(edge, 4, 64, grow_to=5)
    assert rows.count() == edge.count() and slots.shard_by_slots(empty, 4, 64)[0].count() == 0
    by = {}
    for r in maps.collect():
        by.setdefault(r["version"], {})[r["slot"]] = r["shard"]
    assert set(by) == {0, 1, 2} and all(len(m) == 64 for m in by.values())
    assert {r["size"] for r in rows.filter("doc_id in (1, 2)").collect()} == {1}


def test_stored_map_is_read_and_edited(spark, sf, tmp_path):
    path = "file://" + str(tmp_path / "map")
    rows = slots.slotted(spark.read.parquet(f"{sf}/documents.parquet"), 256).cache()
    slots.shard_by_slots(spark.read.parquet(f"{sf}/documents.parquet"), 4, 256, path=path)
    assert slots.load_map(spark, path)[0] == 1
    before = slots.load_map(spark, path)[1]
    assert slots.edit_map(spark, path, rows, 4) == 2 and slots.load_map(spark, path)[1] == before  # balanced: nothing moves
    assert slots.edit_map(spark, path, rows, 5) == 3
    after = slots.load_map(spark, path, 3)[1]
    moved = [s for s in before if after[s] != before[s]]
    assert moved and len(moved) < 128 and {after[s] for s in moved} >= {4} and slots.load_map(spark, path, 1)[1] == before
    got = slots.placed(rows, path, 3).collect()
    assert all(after[r["vslot"]] == r["shard"] for r in got)


def test_equal_rows_are_numbered_in_parts(spark):
    docs = spark.createDataFrame([(None, "same text")] * 500 + [(i, str(i)) for i in range(50)], "doc_id long, text string")
    got = slots.shard_by_slots(docs, 4, 64)[0].collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["pos"])
    assert len(got) == 550 and all(sorted(p) == list(range(len(p))) for p in by.values())


@pytest.mark.parametrize("seed", range(4))
def test_rebalancing_moves_whole_slots_until_even(seed):
    import random

    rnd = random.Random(seed)
    n_bytes = {s: int(rnd.paretovariate(1.3) * 100) for s in range(2000) if rnd.random() < 0.9}
    first = slots.initial_map(2000, 16)
    second = slots.rebalance(first, n_bytes, 16)
    load = Counter()
    for s, shard in second.items():
        load[shard] += n_bytes.get(s, 0)
    biggest, mean = max(n_bytes.values()), sum(load.values()) / 16
    assert set(second) == set(first) and max(load.values()) <= max(1.01 * mean, biggest)
    grown = slots.rebalance(second, n_bytes, 17)
    moved = [s for s in second if grown[s] != second[s]]
    assert any(grown[s] == 16 for s in moved) and len(moved) < 500


def slow_tiles(a, b, k):
    """Greedy tiling by trying all pairs of places, longest match first."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = (k - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return out
        out.append((i, j, n))
        used_a.update(range(i, i + n))
        used_b.update(range(j, j + n))


@pytest.mark.parametrize("seed", range(30))
def test_tiles_are_greedy(seed):
    import random

    rnd = random.Random(seed)
    a, b = ([rnd.choice("abc").encode() for _ in range(rnd.randint(0, 30))] for _ in range(2))
    k = 3
    at = [(i, j) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i : i + k] == b[j : j + k]]
    assert sorted(tiling.tiles(a, b, at, k)) == sorted(slow_tiles(a, b, k))


ITEM = "The quick survey of rivers found that seven bridges, built long ago, still carry the road across the valley every single day."


@pytest.mark.parametrize("limit", [tiling.BROADCAST_BYTES, 0])
def test_contamination(spark, limit):
    words = ITEM.split()
    turned = " ".join(words[11:] + ["and", "so"] + words[:11])
    docs = [
        (1, "Before it. " + ITEM.upper() + " After it."),
        (2, "Moved about: " + turned),
        (3, "Only a part of it: " + " ".join(words[:9]) + " and nothing more."),
        (4, "A clean text about other rivers and other bridges that shares hardly a word in a row with any item."),
        (5, None),
        (6, ""),
        (None, ITEM),
    ]
    items = [(10, ITEM), (11, "too short here"), (12, None), (13, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in tiling.contaminated(d, b, broadcast_bytes=limit).collect()}
    assert got == {(1, 10), (2, 10), (None, 10)}
    assert {r["doc_id"] for r in tiling.decontaminate(d, b, broadcast_bytes=limit).collect()} == {3, 4, 5, 6}


def test_contamination_query(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = set()
    for d, t in zip(documents["doc_id"], documents["text"]):
        words = tiling.words_of(t)
        grams = {tuple(words[j : j + 5]) for j in range(len(words) - 4)}
        for r in items:
            item = tiling.words_of(r["text"])
            if len(item) >= 5 and any(tuple(item[i : i + 5]) in grams for i in range(len(item) - 4)):
                at = [(i, j) for i in range(len(item) - 4) for j in range(len(words) - 4) if item[i : i + 5] == words[j : j + 5]]
                if sum(x[2] for x in tiling.tiles(item, words, at)) >= 0.8 * len(item):
                    want.add((d, r["item_id"]))
    assert {(r["doc_id"], r["item_id"]) for r in tiling.op2_string_tiling(spark, sf).collect()} == want
    far = tiling.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"), broadcast_bytes=0)
    assert {(r["doc_id"], r["item_id"]) for r in far.collect()} == want


def test_decontamination_keeps_columns(spark, edge, empty):
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert tiling.decontaminate(edge, b).count() == edge.count() and tiling.decontaminate(edge, b).columns == edge.columns
    assert tiling.contaminated(empty, b).count() == 0 and tiling.contaminated(edge, b.filter("false")).count() == 0


def test_seeds_that_all_documents_share_may_be_left_out(spark):
    """Every document holds the item's first seven words; both ways agree, and the hot seeds are not looked for."""
    words = ITEM.split()
    docs = [(i, " ".join(words[:7]) + f" own words number {i} of this text") for i in range(60)]
    docs += [(100, ITEM), (101, " ".join(words[:7] + ["x"] + words[7:14] + ["y"] + words[14:])), (102, " ".join(words[14:] + words[:14]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    ways = [sorted((r["doc_id"], r["n_covered"]) for r in tiling.contaminated(d, b, broadcast_bytes=n).collect()) for n in (0, 1 << 20)]
    assert ways[0] == ways[1] and [x for x, _ in ways[0]] == [100, 101, 102]
    key = lambda f: f.selectExpr("md5(text) AS key", "text")
    left = tiling.needed_seeds(tiling.seed_table(key(b)), tiling.seed_table(key(d)), 5, 0.8)
    hot = set(tiling.rolling(tiling.word_hashes(tiling.words_of(" ".join(words[:7]))), 5).astype("int64").tolist())
    assert hot.isdisjoint({r["seed"] for r in left.collect()})


def test_repetitive_texts_are_tiled(spark):
    item, text = "same " * 40, "same " * 3000 + "end"
    found = list(tiling.Bench([(1, item)], 5).covered(text))
    assert [(x[0], x[1], x[2]) for x in found] == [(1, 40, 40)]
    assert list(tiling.Bench([(1, "other words than these stand here " * 3)], 5).covered(text)) == []
