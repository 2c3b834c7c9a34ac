"""Rows that share an id, or have none, are decided one by one."""

import itertools
from collections import Counter

import corpus_pipeline
import pytest
from parley.llm import repeats, tiling

OWN = [
    "The ferry left the northern harbour an hour late because fog lay thick upon the water that morning.",
    "A gardener planted nine rows of beans behind the chapel and watered them twice a day through June.",
    "Seven violins were found in the attic, each one wrapped in newspaper printed before the great flood.",
]
SHARED = "Nobody could say with certainty when the green ledgers of the old library had last been seen inside the locked oak cabinet upstairs."


@pytest.mark.parametrize("i", [None, 7])
def test_near_duplicates_keep_different_texts_of_one_id(spark, i):
    rows = [(i, t) for t in OWN] + [(i, OWN[0]), (1, OWN[1])]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["text"], r["doc_id"]) for r in got) == sorted([(OWN[0], i), (OWN[1], 1), (OWN[2], i)])


@pytest.mark.parametrize("i", [None, 7])
def test_repeats_are_cut_from_their_own_row(spark, i):
    first = [(0 if i else None, OWN[2] + " " + SHARED)]
    rows = [(i, OWN[0] + " " + SHARED), (i, OWN[1] + " The rest of it is its own and is long enough for a cut to show."), (9, SHARED)]
    got = repeats.remove_repeats(spark.createDataFrame(first + rows, "doc_id long, text string")).collect()
    texts = sorted(r["text"] for r in got)
    assert any(t.startswith(OWN[1]) and t.endswith("to show.") for t in texts) and sum(SHARED in t for t in texts) == 1 and "" in texts


def test_copies_of_a_row_do_not_lengthen_a_run(spark):
    short = "These ten words in one line stand alone here twice"
    rows = [(1, short), *[(2, OWN[0] + "\n" + short)] * 3]
    assert repeats.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), min_line_words=11).count() == 0


def leaks(spark):
    item, other = OWN[0], OWN[1] + " " + OWN[2]
    docs = [(1, item), (1, item), (1, OWN[2]), (1, "So: " + other), (None, item), (None, OWN[1]), (None, "Both: " + item + other), (2, None), (2, OWN[2])]
    items = [(10, item), (10, item), (10, other), (None, item), (None, other), (11, "too short"), (12, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [tiling.BROADCAST_BYTES, 0])
def test_both_ways_give_the_rows_of_brute_force(spark, limit):
    docs, items = leaks(spark)
    pairs = itertools.product(docs.collect(), items.collect())
    want = [(d["doc_id"], i["item_id"]) for d, i in pairs if d["text"] and i["text"] and len(i["text"]) > 20 and i["text"] in d["text"]]
    got = [(r["doc_id"], r["item_id"]) for r in tiling.contaminated(docs, items, broadcast_bytes=limit).collect()]
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("limit", [tiling.BROADCAST_BYTES, 0])
def test_decontamination_decides_by_row(spark, limit):
    docs, items = leaks(spark)
    got = [(r["doc_id"], r["text"]) for r in tiling.decontaminate(docs, items, broadcast_bytes=limit).collect()]
    assert Counter(got) == Counter([(1, OWN[2]), (None, OWN[1]), (2, None), (2, OWN[2])])
