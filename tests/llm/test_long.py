"""Texts of megabytes, at default settings, through the operators and the pipeline's stages."""

import importlib.util
import os
import random
import re
import sys
from collections import Counter

import pytest

from parley.llm import quality, repeats, similar, simhash, spellings, tiling, toxicity

rnd = random.Random(31)
WORDS = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 9))) for _ in range(4000)]
make = lambda n: " ".join(rnd.choices(WORDS, k=n))
ITEM = make(60)
PASSAGE = make(80) + "."
#: About 2.5 MB: a benchmark item and a passage that a short document has, too, near the end.
LONG = "\n".join(make(2000) for _ in range(150)) + f" {ITEM} " + make(5000) + f". {PASSAGE} " + make(5000)
NEAR = LONG.replace(LONG.split(" ", 5)[3], "changed", 1)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, f"{make(300)}. {PASSAGE} {make(200)}"), (2, LONG), (3, NEAR), (4, make(400)), (5, LONG)]
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_measures_of_a_long_text(docs):
    got = {r["doc_id"]: r for r in quality.cascade(docs).collect()}
    words = re.findall(r"[^\x20\x09-\x0D]+", LONG)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    assert len(LONG) > 2_000_000 and (got[2]["n_words"], got[2]["word_chars"], got[2]["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))


@pytest.mark.parametrize("limit", [tiling.BROADCAST_BYTES, 0])
def test_an_item_near_the_end_is_found(spark, docs, limit):
    items = spark.createDataFrame([(7, ITEM), (8, make(60))], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in tiling.contaminated(docs, items, broadcast_bytes=limit).collect()) == [(2, 7), (3, 7), (5, 7)]


def test_a_passage_near_the_end_is_found(docs):
    spans = [(r["start"], r["end"]) for r in repeats.repeated_runs(docs.filter("doc_id < 3")).collect()]
    assert len(spans) == 1
    found = LONG[spans[0][0] : spans[0][1]]
    assert len(set(found.split()) & set(PASSAGE.split())) > 50


def test_groups_of_long_texts(docs):
    assert sorted(r["doc_id"] for r in similar.survivors(docs).collect()) == [1, 2, 4]
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}[5] == 2


def test_scores_and_words_of_long_texts(docs):
    model = toxicity.Model(["grubble"], [3.0], toxicity.np.zeros(1 + len(toxicity.FEATURES)))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.5}
    counted = Counter(w for w in re.findall("[A-Za-zÀ-ÿ]+", LONG) if len(w) >= 6)
    assert Counter(r["word"] for r in spellings.words_of(docs.filter("doc_id = 2"), None).collect()) == counted


def test_pipeline_stages_of_long_texts(spark, docs, sf):
    root = os.path.dirname(os.path.dirname(os.path.dirname(__file__)))
    if not importlib.util.find_spec("corpus_pipeline"):
        sys.path.insert(0, root)
    import corpus_pipeline

    now = docs
    for name, stage in corpus_pipeline.STAGES[1:]:
        now = stage(spark, now, sf)
        kept = sorted(r["doc_id"] for r in now.select("doc_id").collect())
        assert kept == [1, 2, 4], name
    assert min(r["n_tokens"] for r in now.collect()) > 300
