"""Quality rules as a short-circuit cascade, ordered by what a sample says about cost and selectivity.

Base measures are taken of every text. Rules then run one after another on what still stands; the first that
rejects ends the row's cascade. Rules are a conjunction, so their order changes the cost and never the
verdict; it is chosen by rejections per second, measured on a bounded sample of rows that passed the base.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import portions, small_batches, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Rows on which the rules' cost and selectivity are estimated; nothing else is taken from the sample.
SAMPLE_ROWS = 2000

_SYMBOL = re.compile("[" + re.escape(SYMBOLS) + "]")
_SPACE = b" \t\n\x0b\x0c\r"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@dataclass
class Measured:
    """A text with its words and base measures; rules read from it."""

    text: str
    words: list[bytes]
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def base_failed(self) -> bool:
        n = len(self.words)
        return n < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * n


def repeated_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words inside windows of k words that the text holds twice or more, the first included.

    Hashes propose repeated windows, the words themselves decide.
    """
    n = len(words) - k + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * _MIX[0]
    w = np.zeros(n, np.uint64)
    for i in range(k):
        w += (h[i : i + n] ^ _MIX[i]) * _MIX[(i + 1) % k]
        w ^= w >> np.uint64(29)
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice).tolist()
    seen = Counter(tuple(words[i : i + k]) for i in at)
    covered = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i : i + k])] > 1:
            covered[i] += 1
            covered[i + k] -= 1
    return int((np.cumsum(covered) > 0).sum())


def measure(text: str | None) -> Measured:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return Measured(text, words, len(text) - spaces, len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated_words(words))


# Each rule: True rejects. Thresholds are parameters of make_rules.
Rule = Callable[[Measured], bool]


def make_rules(
    max_symbol_share: float = 0.1,
    max_dup_line_share: float = 0.3,
    mean_word_chars: tuple[float, float] = (1.5, 20.0),
    min_letter_share: float = 0.5,
    max_upper_share: float = 0.7,
    min_distinct_share: float = 0.1,
    max_top_word_share: float = 0.3,
    min_distinct_pairs: float = 0.12,
) -> dict[str, Rule]:
    def symbols(m: Measured) -> bool:
        return m.n_symbols > max_symbol_share * m.word_chars

    def dup_lines(m: Measured) -> bool:
        lines = m.text.count("\n") + 1
        return lines > 3 and m.n_dup_lines > max_dup_line_share * lines

    def word_length(m: Measured) -> bool:
        return not mean_word_chars[0] <= m.word_chars / len(m.words) <= mean_word_chars[1]

    def letters(m: Measured) -> bool:
        return sum(map(str.isalpha, m.text)) < min_letter_share * m.word_chars

    def upper(m: Measured) -> bool:
        return sum(c.isupper() and c.isalpha() for c in m.text) > max_upper_share * m.word_chars

    def distinct(m: Measured) -> bool:
        n = min(len(m.words), 1000)  # the share of distinct words falls with length; compare per thousand words
        return len(set(m.words)) < min_distinct_share * n

    def top_word(m: Measured) -> bool:
        return Counter(m.words).most_common(1)[0][1] > max_top_word_share * len(m.words)

    def pairs(m: Measured) -> bool:
        return len(set(zip(m.words, m.words[1:]))) < min_distinct_pairs * min(len(m.words) - 1, 1000)

    return {f.__name__: f for f in (symbols, dup_lines, word_length, letters, upper, distinct, top_word, pairs)}


def estimate(docs: DataFrame, rules: dict[str, Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a row, share rejected) on at most ``sample_rows`` sampled rows; every rule sees every row."""
    small_batches(docs.sparkSession)
    total = docs.count()
    share = min(1.0, 1.5 * sample_rows / max(1, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hit, seen = Counter(), Counter(), 0
        for batch in portions(batches, 0):
            for text in batch.column(0).to_pylist():
                m = measure(text)
                if m.base_failed:
                    continue
                seen += 1
                for name, rule in rules.items():
                    t = time.perf_counter()
                    hit[name] += rule(m)
                    spent[name] += time.perf_counter() - t
        yield pa.RecordBatch.from_pydict(
            {"rule": list(rules), "s": [float(spent[x]) for x in rules], "hits": [int(hit[x]) for x in rules], "n": [seen] * len(rules)}
        )

    sample = docs.select("text").sample(share, seed=7).limit(sample_rows)
    got = sample.mapInArrow(run, "rule string, s double, hits long, n long").groupBy("rule").agg(F.sum("s"), F.sum("hits"), F.sum("n")).collect()
    return [(r[0], (r[1] or 0.0) / max(1, r[3] or 0), (r[2] or 0) / max(1, r[3] or 0)) for r in got]


def best_order(estimates: list[tuple[str, float, float]], rules: dict[str, Rule]) -> list[str]:
    """Most rejections per second first; rules that rejected nothing follow, cheapest first. Optimal for independent rules."""
    found = {name: (cost, rejects) for name, cost, rejects in estimates}
    key = lambda name: (-found[name][1] / max(found[name][0], 1e-9), found[name][0], name)
    return sorted((x for x in rules if x in found), key=key) + [x for x in rules if x not in found]


def cascade(docs: DataFrame, rules: dict[str, Rule] | None = None, order: list[str] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base measures and verdict of every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, rejected_by (base, a rule, or null where kept; among several rules it names the one the order met first).

    Null and empty texts have no words and fail the base. Repeated rows are judged alike; other columns are ignored.
    """
    rules = rules or make_rules()
    docs = docs.select("doc_id", "text")
    order = order or best_order(estimate(docs, rules, sample_rows), rules)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = [(name, rules[name]) for name in order]
        for batch in portions(batches, 1):
            out = {x: [] for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "rejected_by")}
            for text in batch.column(1).to_pylist():
                m = measure(text)
                by = "base" if m.base_failed else next((name for name, rule in steps if rule(m)), None)
                for name, value in zip(out, (len(m.words), m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, by)):
                    out[name].append(value)
            by = pa.array(out.pop("rejected_by"), pa.string())
            base = pa.array([x == "base" for x in by.to_pylist()], pa.bool_())
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in out.values()), base, by.is_null(), by]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *out, "base_failed", "kept", "rejected_by"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{x} long" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return docs.mapInArrow(run, f"doc_id {kind}, {longs}, base_failed boolean, kept boolean, rejected_by string")


def op1_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rejected_by`` stays out: it may name another rule when measured costs differ."""
    return cascade(table(spark, sf_dir, "documents")).drop("rejected_by")


#: The same rows in SQL, with the thresholds of make_rules().
OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS g, lead(w, 4) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE whole),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t-\r]') GROUP BY doc_id),
u AS (SELECT doc_id, count(*) AS n_distinct, max(n) AS top FROM (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL) GROUP BY doc_id),
p AS (SELECT doc_id, count(DISTINCT [w, v]) AS n_pairs FROM (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM w) WHERE v IS NOT NULL GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ \t-\r]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS uppers,
  len(string_split(t, chr(10))) AS n_lines, coalesce(n_distinct, 0) AS n_distinct, coalesce(top, 0) AS top, coalesce(n_pairs, 0) AS n_pairs
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 0.1::DOUBLE * word_chars OR (n_lines > 3 AND n_dup_lines > 0.3::DOUBLE * n_lines) OR word_chars / n_words < 1.5::DOUBLE OR word_chars / n_words > 20::DOUBLE
    OR letters < 0.5::DOUBLE * word_chars OR uppers > 0.7::DOUBLE * word_chars OR n_distinct < 0.1::DOUBLE * least(n_words, 1000) OR top > 0.3::DOUBLE * n_words OR n_pairs < 0.12::DOUBLE * least(n_words - 1, 1000)) AS kept
FROM b
"""
