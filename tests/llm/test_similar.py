"""Groups of near duplicates against the similarity of all pairs."""

import functools
import random

import numpy as np
import pytest
from parley.llm import similar, simhash


@functools.lru_cache(maxsize=4)
def _slow_groups(rows, k, similarity):
    sets = {}
    for d, t in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[d] = frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()
    ids = sorted(sets)
    root = {d: d for d in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for d in ids:
        for g in sets[d]:
            holders.setdefault(g, []).append(d)
    empty = [d for d in ids if not sets[d]]
    pairs = {(empty[0], d) for d in empty[1:]} | {(a, b) for of in holders.values() for i, a in enumerate(of) for b in of[i + 1 :]}
    for a, b in sorted(pairs):
        both = len(sets[a] & sets[b])
        if both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {d: top(d) for d in ids}


def slow_groups(texts, k=similar.SHINGLE, similarity=similar.SIMILARITY):
    return _slow_groups(tuple(sorted(texts.items())), k, similarity)


def kept(spark, texts):
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    return sorted(r["doc_id"] for r in similar.survivors(docs).collect())


def test_survivors_of_the_given_documents(spark, documents):
    texts = dict(zip(documents["doc_id"].tolist(), documents["text"]))
    want = slow_groups(texts)
    assert kept(spark, texts) == sorted(set(want.values()))


def edited(rnd, words, share):
    out = list(words)
    for i in range(len(out)):
        if rnd.random() < share:
            out[i] = f"w{rnd.randrange(10**6)}"
    return out


def test_edited_copies_are_found(spark):
    """Families of copies with scattered edits, similarities about the threshold; groups found are those of all pairs."""
    rnd = random.Random(9)
    texts, i = {}, 0
    for family in range(60):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(60, 300))]
        for share in (0, 0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.2):
            texts[i] = " ".join(edited(rnd, base, share))
            i += 1
    want = sorted(set(slow_groups(texts).values()))
    got = kept(spark, texts)
    wrong = set(got) ^ set(want)
    print(len(got), len(want), len(wrong))
    assert set(want) <= set(got) and len(wrong) <= 0.01 * len(texts)


def test_buckets_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_ROWS", 8)
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(edited(rnd, base, 0.004)) for i in range(60)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    sets = similar.marked(docs)
    pairs = similar.candidate_pairs(sets, block_rows=8)
    assert pairs.count() >= 50 and set(slow_groups(texts).values()) == {0}
    assert kept(spark, texts) == [0]


def _joined(pairs, n):
    """The least member of each set's group."""
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def _near(i, j, fps, n):
    return int(fps[i] ^ fps[j]).bit_count() <= similar.RADIUS and min(n[i], n[j]) >= similar.SIMILARITY * max(n[i], n[j])


@pytest.mark.parametrize("tile_rows", [7, 1000])
def test_pairs_across_the_blocks_of_a_large_bucket(spark, tile_rows):
    """Sets that share one large bucket only; partners stand far apart in the order of its blocks, or a range parts them."""
    rng = np.random.default_rng(4)
    fps, n = np.tile(rng.integers(0, 2**63, 60, dtype=np.uint64), 2), [100] * 118 + [100, 200]
    rows = []
    for i in range(120):
        others = [i * 1000 + b if i < 60 else (180 - i) * 10**6 + b for b in range(1, similar.BANDS)]
        rows.append((bytes([i]), int(fps[i].view(np.int64)), n[i], [7 if i % 60 < 50 else 8, *others]))
    sets = spark.createDataFrame(rows, "set_key binary, fp long, n int, keys array<long>")
    pairs = similar.candidate_pairs(sets, block_rows=21, tile_rows=tile_rows).collect()
    got = [(r["src"][0], r["dst"][0]) for r in pairs]
    share = lambda i, j: (i % 60 < 50) == (j % 60 < 50)
    assert all(share(i, j) and _near(i, j, fps, n) for i, j in got)
    want = [(i, j) for j in range(120) for i in range(j) if share(i, j) and _near(i, j, fps, n)]
    assert (59, 119) not in want and len(want) >= 59 and _joined(got, 120) == _joined(want, 120)


@pytest.mark.parametrize("first", [40, 1500, 2500])
def test_bridges_join_what_all_pairs_of_a_tile_join(first, monkeypatch):
    monkeypatch.setattr(similar, "_STEP", 600)
    rng = np.random.default_rng(first)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    fps = base[rng.integers(0, 300, 2500)] ^ (np.uint64(1) << rng.integers(0, 64, 2500).astype(np.uint64))
    n, labels = rng.integers(50, 80, 2500), rng.integers(0, 2000, 2500)
    got = similar.bridging(fps, n, labels, first)
    i, j = np.triu_indices(2500, 1) if first == 2500 else (x.ravel() for x in np.meshgrid(np.arange(first), np.arange(first, 2500)))
    near = (np.bitwise_count(fps[i] ^ fps[j]) <= similar.RADIUS) & (np.minimum(n[i], n[j]) >= similar.SIMILARITY * np.maximum(n[i], n[j]))
    want = list(zip(labels[i[near]].tolist(), labels[j[near]].tolist()))
    assert all(_near(a, b, fps, n) for a, b in got)
    joined = _joined([(labels[a], labels[b]) for a, b in got], 2000)
    assert joined == _joined(want, 2000) and len(got) == 2000 - len(set(joined))


def test_edges(spark, edge, empty):
    got = [(r["doc_id"], r["text_key"]) for r in similar.survivors(edge).collect()]
    assert similar.survivors(empty).count() == 0 and len(got) == len(set(got))
    assert sorted(i for i, _ in got if i is not None and i < 7) == [1, 3, 4, 5]


@pytest.mark.parametrize("radius", [3, 7, 20])
def test_counters_of_any_width(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = np.array([base[i % 3] ^ np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, i % 30)))) for i in range(200)], np.uint64)
    keys = np.sort(rng.integers(0, 5, 200))
    want = sorted((i, j, int(fps[i] ^ fps[j]).bit_count()) for j in range(200) for i in range(j) if keys[i] == keys[j] and int(fps[i] ^ fps[j]).bit_count() <= radius)
    assert sorted(simhash.grouped_pairs(keys, fps, radius)) == want
