"""Substring dedup by hashing lines and their pieces.

A text is cut into lines, and lines into pieces, so that a passage that stands in the middle of a line is found as
well: a piece ends with a sentence or at a word whose hash, with the next word's, is the least of the ``NEAR`` words
to each side in its line (so a cut depends on nearby words of its line alone, and one is never far). Equal lines are
so cut alike, and equal passages are wherever they stand, but for their ends. Pieces are normalised (case, white
space, outer punctuation) and digested to 128 bits. Digests are counted over all documents; of every repeated one the
earliest occurrence by (doc_id, text_key, place) stays. Neighbouring repeats form runs. A run goes if it has
``MIN_WORDS`` words or holds a whole line of ``MIN_LINE_WORDS``; code point offsets of the original text are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import portions, remove, small_batches, table, text_key, unused, written
from parley.llm.memo import Memo, of_worker

#: A piece of fewer words joins the next one of its line.
SHORT_WORDS = 4
#: Words to each side among which the word at a cut has the least hash.
NEAR = 4
#: Words in a run of repeated pieces that is removed, and in a repeated whole line that is. Shorter lines go if asked for:
#: they are headings and footers, which documents without any passage in common share too.
MIN_WORDS = 15
MIN_LINE_WORDS = 15

_WORD = re.compile(r"\S+")
_LINE = re.compile(r"\n")
_STOPS = frozenset(".!?…")
_OUTER = " \t.,;:!?…\"'()[]«»|-"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word_code(word: str) -> int:
    """Twice the word's hash, and one more if the word ends a sentence."""
    return xxhash.xxh32_intdigest(word) << 1 | (word[-1] in _STOPS)


def word_codes() -> Memo:
    return of_worker("line words", lambda: Memo(_word_code))


def least_nearby(values: np.ndarray, line: np.ndarray, near: int = NEAR) -> np.ndarray:
    """Places whose value is the least of the ``near`` places to each side in the same line; of equal ones the first."""
    out = np.ones(len(values), bool)
    for d in range(1, near + 1):
        same = line[d:] == line[:-d]
        out[d:] &= ~same | (values[d:] < values[:-d])
        out[:-d] &= ~same | (values[:-d] <= values[d:])
    return out


def units(text: str, codes: Memo) -> list[tuple[int, int, int, int, int, bytes]]:
    """(start, end, words, line, words of the line, digest) of every piece, in order; offsets in code points."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return []
    sizes = np.fromiter(map(len, text.split()), np.int64, n)
    if sizes.sum() + n - 1 == len(text):  # one white space between words, none around
        starts = np.cumsum(sizes + 1) - sizes - 1
    else:
        starts = np.fromiter((m.start() for m in _WORD.finditer(text)), np.int64, n)
    line = np.searchsorted(np.array([m.start() for m in _LINE.finditer(text)], np.int64), starts)
    of_line = np.bincount(line)
    code = np.fromiter(map(codes.__getitem__, words), np.uint64, n)
    hard = np.ones(n, bool)
    hard[:-1] = line[1:] != line[:-1]
    pair = (code >> np.uint64(1)) * _MIX
    pair[:-1] += code[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pair ^= pair >> np.uint64(29)
    soft = least_nearby(pair * _MIX, line) | (code & np.uint64(1)).astype(bool)
    begins, ends, lines = starts.tolist(), (starts + sizes).tolist(), line.tolist()
    out, begin = [], 0
    for at in np.flatnonzero(hard | soft).tolist():
        if at + 1 - begin < SHORT_WORDS and not hard[at]:
            continue
        digest = xxhash.xxh3_128_digest(" ".join(words[begin : at + 1]).strip(_OUTER))
        out.append((begins[begin], ends[at], at + 1 - begin, lines[at], int(of_line[lines[at]]), digest))
        begin = at + 1
    return out


UNIT_FIELDS = "idx int, start int, end int, n_words int, line int, line_words int, digest binary"


def unit_table(docs: DataFrame) -> DataFrame:
    """One row a piece: doc_id, text_key, idx, start, end, n_words, line, line_words, digest. Null and empty texts have none."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = word_codes()
        for batch in portions(batches, 2):
            found = [units(x, codes) if x else [] for x in batch.column(2).to_pylist()]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            rows = [u for us in found for u in us]
            *numbers, digests = zip(*rows) if rows else ((), (), (), (), (), ())
            idx = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            of = pa.array(np.repeat(np.arange(len(found)), counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), *(pa.array(x, pa.int32()) for x in (idx, *numbers)), pa.array(digests, pa.binary())],
                names=["doc_id", "text_key", "idx", "start", "end", "n_words", "line", "line_words", "digest"],
            )

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key long, {UNIT_FIELDS}")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """Runs to remove: doc_id, text_key, start, end, n_words, n_units, kept_doc_id (the document of an earliest occurrence).

    Rows that share both doc_id and text count as one document: repeats among them are not seen, repeats of them
    elsewhere are. Rows that share an id, a null one too, but not the text are documents of their own, told apart by
    text_key. Rows with a null id rank first. A digest that many documents share is counted by partial sums, and
    its rows are split by adaptive joins; no task holds a digest's rows together.
    """
    spark = docs.sparkSession
    every, at_units = written(unit_table(docs), "units")  # read twice below; cutting costs more than reading again
    first = F.min(F.struct("doc_id", "text_key", "idx")).alias("first")
    known = every.groupBy("digest").agg(F.count("*").alias("n"), first).filter("n > 1")
    known, at_known = written(known.select("digest", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.text_key").alias("kept_key"), F.col("first.idx").alias("kept_idx")), "repeated-units")
    kept = F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("text_key") == F.col("kept_key")) & (F.col("idx") == F.col("kept_idx"))
    # Copies of a row give the same hits; each counts once.
    hits = every.join(known, "digest").filter(~kept).select("doc_id", "text_key", "idx", "start", "end", "n_words", "line", "line_words", "kept_doc_id").distinct()
    by_doc = Window.partitionBy("doc_id", "text_key").orderBy("idx")
    runs = hits.withColumn("run", F.col("idx") - F.dense_rank().over(by_doc))
    measures = [F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"), F.min("kept_doc_id").alias("kept_doc_id")]
    of_line = runs.groupBy("doc_id", "text_key", "run", "line").agg(*measures, F.count("*").alias("n_units"), F.max("line_words").alias("line_words"))
    whole = F.max(F.when(F.col("n_words") == F.col("line_words"), F.col("line_words")).otherwise(0)).alias("whole_line")
    found = of_line.groupBy("doc_id", "text_key", "run").agg(*measures, F.sum("n_units").alias("n_units"), whole)
    found = found.filter((F.col("n_words") >= min_words) | (F.col("whole_line") >= min_line_words)).drop("run", "whole_line")
    out, _ = written(found, "repeated-runs")
    for path in (at_units, at_known):
        remove(spark, path)
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; white space around a cut shrinks to what stood before it."""
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at:a])
        at = b
        while at < len(text) and text[at].isspace() and (a == 0 or text[a - 1].isspace()):
            at += 1
    return "".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with repeated runs cut out of ``text``; ``n_chars``, if there, follows.

    Every document stays, an entirely repeated one with what is left of its text (perhaps nothing); null stays null.
    """
    small_batches(docs.sparkSession)
    runs = repeated_runs(docs, min_words, min_line_words)
    spans = runs.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    owner, key, own, held = (unused(docs, x) for x in ("_spans_of", "_spans_key", "_own_key", "_spans"))
    spans = spans.select(F.col("doc_id").alias(owner), F.col("text_key").alias(key), F.col("spans").alias(held))
    keyed = docs.withColumn(own, text_key())
    joined = keyed.join(spans, keyed["doc_id"].eqNullSafe(spans[owner]) & (keyed[own] == spans[key]), "left").drop(owner, key, own)

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, at):
            texts = [
                t if not (s and t) else cut(t, [(x["start"], x["end"]) for x in s])
                for t, s in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())
            ]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    out = joined.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op6_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(table(spark, sf_dir, "documents")).drop("text_key")
