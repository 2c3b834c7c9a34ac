"""Toxicity scores from a learned lexicon, matched with misspellings, in context.

The lexicon holds words whose presence in toxic training documents exceeds chance (log-likelihood ratio). It is a
trie; a token is matched by walking the trie with the token's Levenshtein automaton, so all terms within the
allowed edits are found in one walk. Every hit is seen in a window of words: quotation marks, words of reporting
(known ones, and words that stand before hits of clean documents beyond chance) and other hits around it tell quotation
from abuse. A logistic regression turns hits into a score. Lexicon and
regression are fitted on a bounded sample of labelled rows (``SAMPLE_DOCS``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import held_out, portions, small_batches, table
from parley.llm.memo import Memo, of_worker

SAMPLE_DOCS = 20_000
#: Lengths of stems, and the share of toxic groups that a stem needs.
STEM_CHARS = (4, 5, 6, 7)
STEM_SHARE = 0.6
MAX_TERMS = 2_000
MIN_LLR = 15.0
#: Words of the windows whose least hash names a text's group of copies.
GROUP_WORDS = 5
FUZZY_CHARS = 5
THRESHOLD = 0.3
WINDOW = 8
#: Words before hits that tell clean documents are learned, so many at most.
MAX_CONTEXT = 50
#: Bytes of tokens and their codes that a worker keeps, twice.
CACHE_BYTES = 64 << 20

_TOKEN = re.compile(r"\w+")
_QUOTES = set("\"“”„«»‘’‹›")
#: Words that introduce what others said, in four languages: what is known before anything is learned.
REPORTING = frozenset("said says quote quoted called wrote dit écrit cité sagte schrieb zitat dijo escribió cita".split())


class Trie:
    """Terms as nested dicts; the key '' holds a term's number, '*' that of a stem ("stem*"), which any ending may follow."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        self.heads, self.tails = {}, {}  # beginnings and ends of terms, with the terms' lengths as bits
        self.stem_halves: dict[int, tuple[set, set]] = {}  # length of stems: their first and second halves
        for n, term in enumerate(terms):
            node = self.root
            for c in term.rstrip("*"):
                node = node.setdefault(c, {})
            node["*" if term[-1:] == "*" else ""] = n
            if term[-1:] == "*":
                size = len(term) - 1
                first, second = self.stem_halves.setdefault(size, (set(), set()))
                first.add(term[: size // 2])
                second.add(term[size // 2 : size])
                continue
            for i in range(len(term) + 1):
                self.heads[term[:i]] = self.heads.get(term[:i], 0) | 1 << len(term)
                self.tails[term[i:]] = self.tails.get(term[i:], 0) | 1 << len(term)

    def exact(self, token: str) -> int | None:
        """The term that the token is, else the longest stem that it starts with."""
        node, stem = self.root, None
        for c in token:
            stem = node.get("*", stem)
            if (node := node.get(c)) is None:
                return stem
        return node.get("", node.get("*", stem))

    def _stem_may_be_near(self, token: str) -> bool:
        """One edit leaves one half of a stem as it is: the first at the token's start, the second moved by one at most."""
        for size, (first, second) in self.stem_halves.items():
            half = size // 2
            if token[:half] in first or any(token[at : at + size - half] in second for at in (max(0, half - 1), half, half + 1)):
                return True
        return False

    def near(self, token: str) -> int | None:
        """The first term, in order of number, one edit away: the automaton's states are (place, edits) sets. A stem is
        one edit away if a beginning of the token is.

        One edit leaves one half of the token as it is and changes its length by one at most, so a token whose
        halves start or end no term of such a length is skipped.
        """
        half = len(token) // 2
        word = (self.heads.get(token[:half], 0) | self.tails.get(token[half:], 0)) >> max(0, len(token) - 1) & 7
        if not word and not self._stem_may_be_near(token):
            return None
        found, n = [], len(token)
        stack = [(self.root, frozenset([(0, 0), (1, 1)]))]
        while stack:
            node, states = stack.pop()
            for c, child in node.items():
                if c == "*":
                    found.append(child)  # a node is reached with states left only: what follows is the ending
                    continue
                if c == "":
                    if any(n - place <= 1 - edits for place, edits in states):
                        found.append(child)
                    continue
                after = set()
                for place, edits in states:
                    if place < n and token[place] == c:
                        after.add((place + 1, edits))
                    if edits == 0:
                        after.update(((place, 1), (min(place + 1, n), 1)))  # a letter more in the term; another letter
                for place, edits in tuple(after):
                    if edits == 0 and place < n:
                        after.add((place + 1, 1))  # a letter less in the term
                if after:
                    stack.append((child, frozenset(after)))
        return min(found) if found else None


FEATURES = ("exact", "best", "sum", "fuzzy", "fuzzy_best", "open", "quoted", "reported", "clustered", "density")


@dataclass
class Model:
    terms: list[str]
    weights: list[float]
    beta: np.ndarray
    context: frozenset[str] = REPORTING

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.beta[1:] + self.beta[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Matcher:
    def __init__(self, terms: list[str], weights: list[float], context: frozenset[str] = REPORTING):
        self.trie, self.weights, self.context = Trie(terms), weights, context
        self.memo = Memo(self._code, CACHE_BYTES)

    def _code(self, token: str) -> int:
        """0: no hit; n+1: term n exactly; -n-1: term n with an edit."""
        if (n := self.trie.exact(token)) is not None:
            return n + 1
        if len(token) >= FUZZY_CHARS and (n := self.trie.near(token)) is not None:
            return -n - 1
        return 0

    def before_hits(self, text: str | None) -> set[str]:
        """Words (no hits) in the windows before the text's hits."""
        tokens = _TOKEN.findall((text or "").lower())
        codes = [self.memo[t] for t in tokens]
        return {tokens[j] for i, c in enumerate(codes) if c for j in range(max(0, i - WINDOW), i) if not codes[j]}

    def features(self, text: str | None) -> list[float]:
        text = (text or "").lower()
        tokens = _TOKEN.findall(text)
        if not tokens:
            return [0.0] * len(FEATURES)
        codes = np.fromiter(map(self.memo.__getitem__, tokens), np.int64, len(tokens))
        at = np.flatnonzero(codes)
        if not len(at):
            return [0.0] * len(FEATURES)
        spans = [m.span() for m in _TOKEN.finditer(text)]
        exact = [self.weights[c - 1] for c in codes[at].tolist() if c > 0]
        fuzzy = [self.weights[-c - 1] for c in codes[at].tolist() if c < 0]
        quoted = reported = 0
        for i in at.tolist():
            low, high = max(0, i - WINDOW), min(len(tokens), i + WINDOW + 1)
            before, after = text[spans[low][0] : spans[i][0]], text[spans[i][1] : spans[high - 1][1] + 1]
            quoted += any(c in _QUOTES for c in before) and any(c in _QUOTES for c in after)
            reported += not self.context.isdisjoint(tokens[low:i])
        clustered = int((np.diff(at) <= WINDOW).sum())
        opened = len(at) - max(quoted, reported)
        log = np.log1p
        return [
            float(x)
            for x in (
                log(len(exact)),
                max(exact, default=0.0),
                log(sum(exact)),
                log(len(fuzzy)),
                max(fuzzy, default=0.0),
                log(opened),
                log(quoted),
                log(reported),
                log(clustered),
                log(1000 * len(exact) / len(tokens)),
            )
        ]


def copy_group(text: str, k: int = GROUP_WORDS) -> int:
    """The least hash of the text's word windows: equal for most near copies, different for texts of their own."""
    words = text.lower().split()
    windows = (" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))
    return min(map(xxhash.xxh64_intdigest, windows)) - (1 << 63)


def grouped_terms(sample: DataFrame) -> DataFrame:
    """(toxic, group, term, low, high): words of three letters or more of each group of copies, and stems ("stem*")
    with the least and largest 16-bit hash of an ending of the group's words that start so: they differ where endings do."""
    small_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            which, terms, of = [], [], []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for i, text in enumerate(texts):
                words = {w for w in _TOKEN.findall(text.lower()) if len(w) > 2}
                stems = [(w[:n] + "*", xxhash.xxh32_intdigest(w[n:]) & 0xFFFF) for w in words for n in STEM_CHARS if len(w) > n]
                terms += [*words, *(t for t, _ in stems)]
                of += [*[None] * len(words), *(e for _, e in stems)]
                which += [i] * (len(words) + len(stems))
            at = pa.array(which, pa.int64())
            groups = pa.array(map(copy_group, texts), pa.int64())
            columns = [batch.column(0).take(at), groups.take(at), pa.array(terms, pa.string()), pa.array(of, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["toxic", "group", "term", "of"])

    kind = sample.schema["toxic"].dataType.simpleString()
    rows = sample.select("toxic", "text").mapInArrow(run, f"toxic {kind}, group long, term string, of int")
    return rows.groupBy("toxic", "group", "term").agg(F.min("of").alias("low"), F.max("of").alias("high"))


def lexicon(sample: DataFrame, max_terms: int = MAX_TERMS, min_llr: float = MIN_LLR) -> tuple[list[str], list[float]]:
    """Terms over-represented among toxic documents of the sample (text, toxic), with their log odds ratios.

    Groups of copies count once, so the rare words of a copied document are no evidence. Stems are terms if they
    stand in several words, mostly in toxic groups; of stems that contain each other the best stays.
    """
    seen = grouped_terms(sample)
    groups = sample.select("toxic", "text").mapInArrow(_groups_of, "toxic int, group long").distinct()
    n = groups.agg(F.count("*"), F.sum("toxic")).first()
    total, bad = n[0] or 0, n[1] or 0
    if not bad or bad == total:
        return [], []
    counted = seen.groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    a, k = F.col("a"), F.col("n")
    p, share = a / k, F.lit(bad / total)
    half = lambda x, r, e: F.when(x > 0, x * F.log(r / e)).otherwise(0.0)
    llr = 2 * (half(a, p, share) + half(k - a, 1 - p, 1 - share))
    odds = F.log((a + 0.5) / (bad - a + 0.5)) - F.log((k - a + 0.5) / (total - bad - k + a + 0.5))
    fit = ~F.col("term").endswith("*") | ((F.col("low") < F.col("high")) & (p >= STEM_SHARE))
    top = counted.filter((a >= 3) & (p > share) & fit).select("term", llr.alias("llr"), odds.alias("odds")).filter(F.col("llr") >= min_llr)
    rows = top.orderBy(F.desc("llr"), F.length("term"), "term").limit(max_terms).collect()
    stems: list[str] = []
    out = []
    for r in rows:
        if r["term"].endswith("*"):
            stem = r["term"][:-1]
            if any(stem.startswith(x) or x.startswith(stem) for x in stems):
                continue
            stems.append(stem)
        out.append((r["term"], float(r["odds"])))
    return [t for t, _ in out], [w for _, w in out]


def _groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, 1):
        groups = pa.array(map(copy_group, [x or "" for x in batch.column(1).to_pylist()]), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), groups], names=["toxic", "group"])


def context_words(sample: DataFrame, terms: list[str], weights: list[float], max_words: int = MAX_CONTEXT, min_llr: float = MIN_LLR) -> list[str]:
    """Words that stand before hits in clean documents of the sample (text, toxic) beyond chance, as words of reporting do.

    Groups of copies count once. Documents without a hit say nothing.
    """
    spark = sample.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast((terms, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = of_worker(("matcher", held), lambda: Matcher(*held.value))
        for batch in portions(batches, 1):
            which, words = [], []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for i, text in enumerate(texts):
                found = matcher.before_hits(text)
                words += ["", *found] if found else []
                which += [i] * (len(found) + 1 if found else 0)
            groups = pa.array([copy_group(t) for t in texts], pa.int64())
            at = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()).take(at), groups.take(at), pa.array(words, pa.string())], names=["toxic", "group", "word"])

    seen = sample.select("toxic", "text").mapInArrow(run, "toxic int, group long, word string").distinct()
    counted = seen.groupBy("word").agg(F.count_if(F.col("toxic") == 0).alias("a"), F.count("*").alias("n"))
    total = counted.filter("word = ''").first()  # every document with a hit has the empty word
    if not total or not total["a"] or total["a"] == total["n"]:
        return []
    a, n, share = F.col("a"), F.col("n"), F.lit(total["a"] / total["n"])
    half = lambda x, r, e: F.when(x > 0, x * F.log(r / e)).otherwise(0.0)
    llr = 2 * (half(a, a / n, share) + half(n - a, 1 - a / n, 1 - share))
    top = counted.filter((F.col("word") != "") & (a >= 3) & (a / n > share)).select("word", llr.alias("llr")).filter(F.col("llr") >= min_llr)
    return [r["word"] for r in top.orderBy(F.desc("llr"), "word").limit(max_words).collect()]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Penalised logistic regression by Newton steps; the first coefficient is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def training_rows(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(text, toxic) of at most about ``sample_docs`` labelled ids (never above twice that) outside the held-out fold,
    chosen by a hash of the id; of documents that share an id the one of the least text."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    share = min(1.0, sample_docs / max(1, usable.count()))
    mixed = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 30))
    ids = usable.filter(mixed < int(share * (1 << 30))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).limit(2 * sample_docs)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # 2 * sample_docs rows at most
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def feature_rows(docs: DataFrame, keep: list[str], terms: list[str], weights: list[float], context: frozenset[str] = REPORTING) -> DataFrame:
    """``keep`` columns and ``x``, the features of ``text``, of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast((terms, weights, context))
    rows = docs.select(*keep, "text")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = of_worker(("matcher", held), lambda: Matcher(*held.value))
        for batch in portions(batches, len(keep)):
            x = [matcher.features(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return rows.mapInArrow(run, f"{shape}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn lexicon, words of context and regression. Without labelled rows of both classes every score is the share of toxic rows."""
    sample = training_rows(docs, labels, sample_docs)
    terms, weights = lexicon(sample)
    context = REPORTING | set(context_words(sample, terms, weights)) if terms else REPORTING
    rows = feature_rows(sample, ["toxic"], terms, weights, context).collect()
    if not rows:
        return Model(terms, weights, np.array([-30.0, *[0.0] * len(FEATURES)]))
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)
    order = np.lexsort([*x.T, y])  # collected rows come in any order; sums then round alike
    return Model(terms, weights, logistic(x[order], y[order]), context)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted of every row; null and empty texts score as texts without a hit."""
    beta = [float(b) for b in model.beta]
    rows = feature_rows(docs, ["doc_id"], model.terms, model.weights, model.context)
    z = F.aggregate(F.zip_with("x", F.array(*map(F.lit, beta[1:])), lambda a, b: a * b), F.lit(beta[0]), lambda a, b: a + b)
    p = 1 / (1 + F.exp(-z))
    return rows.select("doc_id", p.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_lexicon_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
