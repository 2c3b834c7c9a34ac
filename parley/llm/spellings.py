"""Spelling variants by letter-parity masks.

A word's mask has, for each class of letters, the parity of how often it occurs. One inserted or deleted letter flips one
bit, a replaced one two at most; so of three bands of the mask at least one is equal in both words. Words meet where a
band is equal, and a length filter, the whole masks (two differing bits at most) and the edit distance decide. As one
edit leaves the first or the last three letters of words of six or more alone, those letters stand in the key, too, once
for each end: no near pair is lost by it, and a bucket stays small however many words there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import remove, table, written
from parley.llm.prefixes import CRC32_TABLE, crc32_sql

#: Code points of words. Fixed values.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form has so many times the occurrences of its variants at least.
FORM_RATIO = 5
#: Bits of a mask, three interleaved bands; letters whose code points agree modulo BITS share one.
BITS = 60
BANDS = [sum(1 << i for i in range(b, BITS, 3)) for b in range(3)]
#: Letters at either end that stand in a bucket's key: with MIN_LENGTH 6, an edit leaves those of one end alone.
END = 3
MAX_ROUNDS = 64


def words_of(docs: DataFrame, typo_every: int | None = 199) -> DataFrame:
    """word, one row an occurrence: maximal runs of LETTERS, A-Z lower-cased, of MIN_LENGTH code points or more.

    ``typo_every``: where it divides crc32 of ``doc_id:run``, the code point at crc32 % length is left out first; None
    leaves all as they are. Null texts have no words; a null doc_id counts as an empty one.
    """
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"([{LETTERS}]{{{MIN_LENGTH},}})"), 1)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("of"), F.explode(runs).alias("run"))
    if not typo_every:
        return rows.select(F.col("run").alias("word"))
    rows = rows.withColumn("hash", F.crc32(F.concat_ws(":", "of", "run").cast("binary")))
    at = (F.col("hash") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("hash") % typo_every == 0, cut).otherwise(F.col("run"))
    return rows.select(word.alias("word")).filter(F.length("word") >= MIN_LENGTH)


def vocabulary(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the words that occur ``min_count`` times or more."""
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def parity_mask(word: Column) -> Column:
    """A bit for each class of letters: 1 if the word has an odd number of them."""
    bit = F.array(*[F.lit(1 << i).cast("long") for i in range(BITS)])
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: mask.bitwiseXOR(F.get(bit, F.ascii(c) % BITS)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, n_other) of every two words with one inserted, deleted or replaced code point between them; each
    pair once, word < other. ``words``: word (distinct, MIN_LENGTH or more code points), n."""
    masked = words.select("word", "n", F.length("word").alias("size"), parity_mask(F.col("word")).alias("mask"))
    ends = [F.substring("word", 1, END), F.expr(f"right(word, {END})")]
    keys = [F.struct(F.lit(len(BANDS) * e + b).alias("slot"), end.alias("end"), F.col("mask").bitwiseAND(F.lit(band)).alias("band")) for e, end in enumerate(ends) for b, band in enumerate(BANDS)]
    rows = masked.select("word", "n", "size", "mask", F.inline(F.array(*keys)))
    a, b = rows.alias("a"), rows.alias("b")
    flips = F.col("a.mask").bitwiseXOR(F.col("b.mask"))
    # A pair that meets in several buckets counts in the first of them.
    first = (F.col("a.slot") < len(BANDS)) | (F.substring("a.word", 1, END) != F.substring("b.word", 1, END))
    for b_at in range(1, len(BANDS)):
        differ = [flips.bitwiseAND(F.lit(BANDS[i])) != 0 for i in range(b_at)]
        rule = differ[0]
        for d in differ[1:]:
            rule = rule & d
        first = first & ((F.col("a.slot") % len(BANDS) != b_at) | rule)
    met = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("slot", "end", "band")]
    near = (
        (F.abs(F.col("a.size") - F.col("b.size")) <= 1) & (F.bit_count(flips) <= 2) & (F.col("a.word") < F.col("b.word")) & first
        & (F.levenshtein("a.word", "b.word", 1) == 1)
    )
    return a.join(b, met[0] & met[1] & met[2] & near).select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("n_other"))


def forms(words: DataFrame, pairs: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """word, n, n_near, form, form_n of every word: form is the most frequent near word (of equally frequent ones the
    first) if it has ``ratio`` times the word's occurrences or more, else null, as is form_n."""
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("n_other").alias("n"), F.col("word").alias("other"), F.col("n").alias("n_other")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    best = best.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("n_other"))
    leads = F.col("n_other") >= ratio * F.col("n")
    out = words.join(best, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("other")).alias("form"), F.when(leads, F.col("n_other")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last word reached from ``word`` by following ``links`` (word, form). Each round doubles the
    steps; n grows by FORM_RATIO with each step, so there is no circle and few rounds."""
    spark = links.sparkSession
    now, path = written(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new, at = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        remove(spark, path)
        path, moved = at, new.filter("moved").limit(1).count()
        now = new.select("word", "root")
        if not moved:
            return now
    raise RuntimeError(f"forms did not end in {MAX_ROUNDS} rounds")


def variant_groups(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n). An empty one gives no rows."""
    spark = words.sparkSession
    words, at_words = written(words, "vocabulary")
    found, _ = written(forms(words, near_pairs(words)), "forms")
    remove(spark, at_words)
    ends = roots(found.filter("form IS NOT NULL"))
    out = found.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_parity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(vocabulary(words_of(table(spark, sf_dir, "documents"))))


#: Near words in SQL: two words of one length agree but for the code point left out at the same place; of two lengths, the
#: longer one is the other with one code point left out.
OP12_SQL = f"""
WITH RECURSIVE tab AS ({CRC32_TABLE}),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS of, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[{LETTERS}]+')) AS run FROM documents),
each AS (SELECT of, run, count(*) AS times FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY of, run),
hashed AS (SELECT run, times, {crc32_sql("of || ':' || run")} AS hash FROM each, tab),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN hash % 199 = 0 THEN substr(run, 1, (hash % length(run))::BIGINT) || substr(run, (hash % length(run))::BIGINT + 2) ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(times) >= {MIN_COUNT}),
less AS (SELECT word, n, i AS at, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS n_other FROM less a JOIN less b ON a.at = b.at AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
counts AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
best AS (SELECT word, n, other, n_other FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n_other DESC, other) = 1),
form AS (SELECT word, other AS form, n_other AS form_n FROM best WHERE n_other >= {FORM_RATIO} * n),
walk AS (SELECT word, form AS root, 1 AS step FROM form UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN form f ON f.word = w.root),
ends AS (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word)
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(c.n_near, 0)::BIGINT AS n_near, f.form_n
FROM words w LEFT JOIN counts c USING (word) LEFT JOIN form f USING (word) LEFT JOIN ends e USING (word)"""
