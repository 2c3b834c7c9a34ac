"""SimHash components, repeated passages and their building blocks against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from parley.llm import repeats, simhash
from parley.llm.components import connected_components


def components_of(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [2, simhash.HOT_BUCKET])
def test_near_duplicates_query(spark, sf, documents, hot):
    docs = documents.sort_values("doc_id").reset_index(drop=True)
    f = [slow_fingerprint(t) for t in docs["text"]]
    close = [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2]
    want = components_of(len(f), close)
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame, hot).collect()}
    assert all(got[d]["fp"] % 2**64 == f[i] for i, d in enumerate(docs["doc_id"]))
    assert all(got[d]["component_id"] == docs["doc_id"][want[i]] for i, d in enumerate(docs["doc_id"]))


def test_query_columns(spark, sf):
    r = simhash.op5_bit_sliced_simhash(spark, sf).first()
    assert re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) and set(r.asDict()) == {"doc_id", "fingerprint", "component_id"}


def test_near_duplicate_edges(spark, edge, empty):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == edge.count() and simhash.near_duplicates(empty).count() == 0
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["component_id"])
    assert by[1] == by[2] == {1} and by[5] == by[6] == {5} and by[None] == {None}


@pytest.mark.parametrize("seed", range(6))
def test_links_reach_all_that_brute_force_reaches(spark, seed):
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    made = {rnd.choice(centres) ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randrange(5))}) for _ in range(400)}
    fps = np.array(sorted(made), np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    close = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) % 2**64).bit_count() <= 2]
    want = components_of(len(fps), close)
    for hot in (3, 10_000) if seed < 2 else (10_000,):
        place = {x: i for i, x in enumerate(fps)}
        found = [(place[r["src"]], place[r["dst"]]) for r in simhash.links(frame, hot).collect()]
        assert components_of(len(fps), found) == want
        if hot > 3:
            assert all(((fps[a] ^ fps[b]) % 2**64).bit_count() <= 2 for a, b in found)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.array([base[i % 5] ^ np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, i % 4)))) for i in range(300)], np.uint64)
    group = np.sort(rng.integers(0, 4, 300))
    table = np.pad(simhash.bit_planes(fps), ((0, 0), (0, 8)))
    for shift in (1, 5, 63, 64, 65, 130, 299, 400):
        want = [i for i in range(300 - shift) if group[i] == group[i + shift] and int(fps[i] ^ fps[i + shift]).bit_count() <= radius]
        assert simhash.close_pairs(fps, group, shift, table, radius).tolist() == want


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(9, i) for i in range(9)] + [(20, 21), (21, 20)]])
def test_components(spark, pairs):
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    nodes = sorted({x for p in pairs for x in p if p[0] != p[1]})
    place = {x: i for i, x in enumerate(nodes)}
    want = components_of(len(nodes), [(place[a], place[b]) for a, b in pairs if a != b])
    assert got == {x: nodes[want[i]] for i, x in enumerate(nodes)}


def slow_units(text):
    """Pieces by their definition, word by word, without the operator's code: (start, end, words, line, normal form)."""
    M = 2**64
    found, line_no = [], 0
    lines, at = [], 0
    for raw in text.split("\n"):
        lines.append((at, raw))
        at += len(raw) + 1
    for line_no, (base, raw) in enumerate(lines):
        spans = [(m.start() + base, m.end() + base) for m in re.finditer(r"\S+", raw)]
        words = [w for a, b in spans for w in text[a:b].lower().split()]
        assert len(words) == len(spans)
        found += [(a, b, w, line_no) for (a, b), w in zip(spans, words)]
    code = [xxhash.xxh32_intdigest(w) << 1 | (w[-1] in ".!?…") for _, _, w, _ in found]
    rank = []
    for i, c in enumerate(code):
        x = (c >> 1) * 0x9E3779B97F4A7C15 % M
        if i + 1 < len(code):
            x = (x + code[i + 1] * 0xC2B2AE3D27D4EB4F) % M
        rank.append((x ^ x >> 29) * 0x9E3779B97F4A7C15 % M)
    out, begin = [], 0
    for i, (_, end, word, line) in enumerate(found):
        last = i + 1 == len(found) or found[i + 1][3] != line
        near = [j for j in range(max(0, i - 4), min(len(found), i + 5)) if found[j][3] == line]
        least = min(near, key=lambda j: (rank[j], j)) == i
        if last or ((word[-1] in ".!?…" or least) and i + 1 - begin >= 4):
            form = " ".join(w for _, _, w, _ in found[begin : i + 1]).strip(" \t.,;:!?…\"'()[]«»|-")
            out.append((found[begin][0], end, i + 1 - begin, line, form))
            begin = i + 1
    return out


def slow_runs(texts, min_words=repeats.MIN_WORDS, min_line=repeats.MIN_LINE_WORDS):
    """doc -> [(start, end)] by dictionaries over all pieces."""
    first, count, per = {}, defaultdict(int), {}
    for d in sorted(texts):
        per[d] = slow_units(texts[d])
        for i, u in enumerate(per[d]):
            first.setdefault(u[4], (d, i))
            count[u[4]] += 1
    out = defaultdict(list)
    for d, us in per.items():
        hits = [i for i, u in enumerate(us) if count[u[4]] > 1 and first[u[4]] != (d, i)]
        runs = []
        for i in hits:
            if runs and runs[-1][-1] == i - 1:
                runs[-1].append(i)
            else:
                runs.append([i])
        for r in runs:
            lines = {us[i][3] for i in r}
            whole = max((sum(u[2] for u in us if u[3] == n) for n in lines if all(i in r for i, u in enumerate(us) if u[3] == n)), default=0)
            if sum(us[i][2] for i in r) >= min_words or whole >= min_line:
                out[d].append((us[r[0]][0], us[r[-1]][1]))
    return dict(out)


def test_repeats_query(spark, sf, documents):
    texts = dict(zip(documents["doc_id"], documents["text"]))
    want = slow_runs(texts)
    got = defaultdict(list)
    for r in repeats.op6_line_hashing(spark, sf).collect():
        got[r["doc_id"]].append((r["start"], r["end"]))
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}
    cut = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert cut == {d: repeats.cut(t, want.get(d, [])) for d, t in texts.items()}


PASSAGE = (
    "The committee met on the first floor of the old library to discuss the matter of the missing ledgers. Nobody could say with certainty when they "
    "had last been seen in the cabinet. Three of the clerks remembered a green binding. One of them spoke of a stain in the shape of a key on the cover."
)


@pytest.mark.parametrize("joint", ["\n", " ", "\n\n"])
def test_passages_in_mid_sentence_are_found(spark, joint):
    rows = [
        (1, "Some words that open the first text without an end" + joint + PASSAGE + joint + "and then go on with other words of its own. Last one here."),
        (2, "Quite another beginning that ends properly here." + joint + PASSAGE + joint + "A different end of the second text follows now."),
        (3, "A clean text that shares nothing with the others but is of a similar length, and has several sentences. Here is one more. And one."),
    ]
    got = repeats.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {2} and got[0]["kept_doc_id"] == 1 and got[0]["n_words"] >= 20


def test_repeat_edges(spark, edge, empty):
    got = {r["doc_id"]: r for r in repeats.remove_repeats(edge).collect()}
    assert repeats.remove_repeats(empty).count() == 0 and repeats.remove_repeats(edge).columns == edge.columns
    assert got[1]["text"] is None and got[1]["n_chars"] is None and got[2]["text"] == "" and got[6]["text"] == "" and got[5]["text"]
    assert got[6]["n_chars"] == 0 and got[None]["text"] and got[8]["text"] == "x" * 5000
    assert repeats.remove_repeats(edge).count() == edge.count()


def test_units_are_those_of_the_definition(documents, odd_texts):
    codes = repeats.word_codes()
    for t in [*documents["text"], *odd_texts[:300]]:
        us = repeats.units(t, codes)
        want = slow_units(t)
        assert [u[:4] for u in us] == [u[:4] for u in want] and sum(u[2] for u in us) == len(t.split())
        assert [u[5] for u in us] == [xxhash.xxh3_128_digest(u[4]) for u in want]
    assert repeats.units("Same words here now.", codes)[0][5] == repeats.units("  same   WORDS here now", codes)[0][5]


def test_short_repeated_lines_go(spark):
    line = "Subscribe here."
    rows = [(1, "First text of its own.\n" + line + "\nMore of it."), (2, line + "\nSecond text, another one."), (3, "Third text altogether.\n" + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(docs, min_line_words=1).collect()}
    assert got == {1: rows[0][1], 2: "\nSecond text, another one.", 3: "Third text altogether.\n"} or all(line not in got[d] for d in (2, 3)) and line in got[1]


def test_passages_without_punctuation_are_found(spark):
    """Random passages of 51 to 60 words, in the middle of a line, without a sentence end: found, and how much of them."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(800)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    rows, size = [], {}
    for i in range(300):
        passage = words(rnd.randint(51, 60))
        for d in (2 * i, 2 * i + 1):
            rows.append((d, " ".join(words(40) + passage + words(40))))
        size[2 * i + 1] = len(passage)
    got = {r["doc_id"]: r["n_words"] for r in repeats.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) <= set(size) and len(got) >= 0.98 * len(size)
    assert sum(got.values()) >= 0.6 * sum(size.values())
    print(len(got) / len(size), sum(got.values()) / sum(size.values()))
