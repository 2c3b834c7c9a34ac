"""The prefix trie, spelling variants and top-k search against plain versions, on edge cases and whole small tables."""

import hashlib
import importlib.util
import os
import random
import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from parley.llm import prefixes, products, spellings
from parley.llm.queries import ORACLE_SQL, QUERIES

spec = importlib.util.spec_from_file_location("compare", os.path.join(os.path.dirname(os.path.dirname(__file__)), "compare.py"))
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)


@pytest.mark.parametrize("name", sorted(n for n in ORACLE_SQL if n[:4] in ("op11", "op12", "op13")))
def test_same_as_sql(spark, name):
    assert compare.difference(QUERIES[name](spark, SF).toPandas(), compare.run_sql(ORACLE_SQL[name], SF)) is None


# -- prefix trie


def plain_trie(rows, shared=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        paths[c] = (own.get(c - c % 20, [])[:h] if h else []) + v[h:]
    members = {}
    for c, v in paths.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = set()
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        words = lambda q: len([w for w in q[-1][1].replace("\t", " ").replace("\n", " ").split(" ") if w]) if q else 0
        saved = sum((len(members[q]) - 1) * words(q) for q in below)
        ends = ",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.add((min(cs), len(p), parent, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


SHAPE = "conv_id long, turn long, role string, text string, depth int, top string, name string, n long, length int, rank int, key string, chunk string"


def found_trie(spark, rows, shared=True):
    df = spark.createDataFrame([(*r, 1, "z", "z", 1, 1, 1, "z", "z") for r in rows], SHAPE)
    got = prefixes.prefix_trie(df, F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4) if shared else prefixes.prefix_trie(df)
    return {tuple(r) for r in got.collect()}


def test_trie_of_random_conversations(spark):
    rnd = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rnd.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rnd.choice([t, t, None]) if c % 7 == 0 else t, rnd.choice(["a", "b", None]), rnd.choice(["one word", "x", "", None, "two  words\tmore"])))
    rows += [(3, 1, "a", "x"), (3, 1, "a", "x"), (None, 0, "a", "x"), (45, 2, None, None)]
    assert found_trie(spark, rows) == plain_trie(rows)
    assert found_trie(spark, rows, shared=False) == plain_trie(rows, shared=False)


def test_trie_of_one_long_conversation_and_many_copies(spark):
    rows = [(1, t, "a", "w " * (t % 3) + str(t % 11)) for t in range(150)] + [(2, t, "a", "w " * (t % 3) + str(t % 11)) for t in range(101)]
    rows += [(10_000 + 50 * c, t, "b", "same words") for c in range(90) for t in range(3)] + [(9, 0, "a", "x" * 300_000)]
    assert found_trie(spark, rows, shared=False) == plain_trie(rows, shared=False)


def test_turnless_conversations_and_empty_table(spark):
    lone = next(c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4)  # its first turn goes, none is given
    assert found_trie(spark, [(lone, 0, "a", "x")]) == plain_trie([(lone, 0, "a", "x")])
    empty = spark.createDataFrame([], SHAPE)
    assert prefixes.prefix_trie(empty).count() == 0


# -- spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    out = set()
    form = {}
    others = {w: [o for o in counts if near(w, o)] for w in counts}
    for w, n in counts.items():
        best = min(others[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(others[w]), counts[form[w]] if form[w] else None))
    return out


def test_variants_of_random_words(spark):
    rnd = random.Random(8)
    words = {"abcdef": 5}
    while len(words) < 500:
        w = list(rnd.choice(list(words)))
        for _ in range(rnd.choice([1, 1, 2, 6])):
            kind, at, c = rnd.randrange(3), rnd.randrange(len(w)), rnd.choice("abcdefzàÀÿ×")
            w[at : at + (kind != 0)] = [c] if kind < 2 else []
        if len(w) >= 6:
            words["".join(w)] = rnd.choice([5, 6, 30, 150, 800, 4000])
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {tuple(r) for r in spellings.variant_groups(df).collect()} == plain_variants(words)
    assert spellings.variant_groups(df.filter("false")).count() == 0


def test_words_of_edge_texts(spark, edge, empty):
    import re

    want = []
    for r in edge.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run
            want += [run] if len(run) >= 6 else []
    assert sorted(r["word"] for r in spellings.words_of(edge, 3).collect()) == sorted(want)
    assert spellings.words_of(empty).count() == 0


# -- top-k search


def plain_search(rows, k=5, every=3):
    whole = [(i, [int(np.floor(256.0 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(whole):
        if i is None or i % every:
            continue
        scored = sorted((-max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(q, p)))), j is None, j or 0) for b, (j, p) in enumerate(whole) if b != a)
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def found_search(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v, "z", "z", 0) for i, v in rows], "vec_id long, embedding array<double>, x string, norm string, place int")
    return sorted((tuple(r) for r in products.top_products(df, F.col("vec_id") % 3 == 0, **sizes).collect()), key=repr)


def test_search_over_strips_blocks_and_ties(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 8))
    rows = [(int(i), (centres[i % 5] * s + rng.normal(size=8) * 0.05).tolist()) for i, s in enumerate(np.exp(rng.normal(size=300)))]
    rows += [(1000 + i, [0.25] * 8) for i in range(90)] + [(5, [0.1] * 8), (6, [0.0] * 8), (6, [1.0, 2.0]), (None, [3.0] * 8), (9, []), (12, None), (15, [None] * 8), (18, [float("nan")] * 8)]
    assert found_search(spark, rows, strip=(64, 64), block=50) == plain_search(rows)
    assert found_search(spark, rows) == plain_search(rows)


def test_search_of_few_or_large_vectors(spark):
    rows = [(0, [1.0, -2.0]), (3, [0.5, 0.5]), (7, [1e10, 1e10]), (9, [-3e9, 2e9])]
    assert found_search(spark, rows) == plain_search(rows)
    assert found_search(spark, [(0, [1.0])]) == [] and found_search(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert found_search(spark, [(0, [1e300]), (1, [1e300])]) == [(0, 1, 1, 2**63 - 1)]


@pytest.mark.parametrize("look_up", [(6.0, 500), (0.01, -50)])
def test_buckets_prune_nothing_that_counts(monkeypatch, look_up):
    monkeypatch.setattr(products, "LOOKUP", look_up[0])
    monkeypatch.setattr(products, "LOOKUP_ALONE", look_up[1])
    rng, listed = np.random.default_rng(1), 0
    for trial in range(25):
        d, n = int(rng.integers(1, 20)), int(rng.integers(1, 300))
        x = np.floor(256 * (rng.normal(size=(4, d))[rng.integers(0, 4, n)] + rng.normal(size=(n, d)) * 0.05) * np.exp(rng.normal(size=(n, 1)) * (trial % 3) / 3))
        if trial % 5 == 0:
            x[: n // 2] = x[0]
        norms = np.sqrt((x * x).sum(1))
        x, norms = x[np.argsort(-norms, kind="stable")], np.sort(norms)[::-1]
        ids, places, q = rng.integers(0, 200, n), np.arange(n), np.arange(0, n, 3)
        best = products.Best(np.full(len(q), -np.inf), 5)
        for a in range(0, n, 64):
            s = slice(a, a + 64)
            listed += products.Bucket(x[s], norms[s], places[s], ids[s], np.zeros(n, bool)[s]).search(best, x[q], norms[q], places[q])[0]
        for i, at in enumerate(q):
            score = x @ x[at]
            want = sorted((-score[j], ids[j]) for j in range(n) if j != at)[:5]
            assert sorted(zip(-best.score[best.of == i], best.vec_id[best.of == i])) == want
    assert listed > 0 or look_up[0] > 1
