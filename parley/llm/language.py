"""Language identification by a linear-chain conditional random field over words.

Words carry affix, character n-gram and lexicon features; transitions are learned; forward-backward gives every
word's label distribution, so code-switched text gets a share of each language. The field, its lexicon included,
is fitted on a bounded sample of labelled rows (``SAMPLE_DOCS``, ``SAMPLE_WORDS``); half of the training chains
are spliced from two languages, so that switches are seen. Every word of every text is then labelled by
forward-backward over its whole chain: blocks of words are summed up as transfer matrices, whose products carry the
messages from block to block, and all blocks of many texts are worked on at once.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import held_out, portions, small_batches, table
from parley.llm.memo import Memo, of_worker

#: Bounds of the sample that the field is fitted on: documents of one language, words of one document, and documents
#: in all. Every language of the labelled rows is learned; many languages share the last bound evenly.
SAMPLE_DOCS = 400
SAMPLE_WORDS = 160
SAMPLE_TOTAL = 40_000
LEXICON_WORDS = 400
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Words of a block of the scan; messages pass from block to block.
BLOCK = 64
TRAIN_CHAIN = 32
STEPS = 60
UNDETERMINED = "und"
#: The pipeline's stage keeps documents whose leading language has this share of the words' weight.
MIN_SHARE = 0.5

_LETTER = regex.compile(r"\p{L}")
_NOT_WORD = bytes(b if b >= 0x80 or chr(b).isalpha() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words in UTF-8: runs of ASCII letters and non-ASCII characters."""
    return text.lower().encode().translate(_NOT_WORD).split()


def _bucket(codes: np.ndarray, tag: int) -> np.ndarray:
    """Buckets of up to four bytes under a tag, by multiplicative hashing."""
    return ((codes.astype(np.uint64) + np.uint64(tag << 32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class Field:
    """Weights of hashed features and of transitions, with the lexicon (word -> its number and languages)."""

    def __init__(self, labels: list[str], lexicon: dict[bytes, tuple[int, ...]]):
        k = len(labels)
        self.labels = labels
        self.lexicon = {w: (i, ys) for i, (w, ys) in enumerate(sorted(lexicon.items()))}
        self.weights, self.moves = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k))

    def features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all words one after another, their number by word).

        Affixes of 1 to 4 bytes, 2- and 3-grams of the padded word and, three times, lexicon entries. All words are
        taken at once; each n-gram is one number made from shifted copies of the joined bytes.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        joined = np.frombuffer(b"".join([b"^%b$\0\0\0" % w for w in words]), np.uint8).astype(np.uint64)
        ends = np.cumsum(sizes + 5)
        begins = ends - sizes - 5
        who = np.repeat(np.arange(len(words)), sizes + 5)
        place = np.arange(len(joined)) - begins[who]
        grown = [joined]
        for _ in range(3):
            grown.append(grown[-1][:-1] << np.uint64(8) | joined[len(joined) - len(grown[-1]) + 1 :])
        parts, owners = [], []
        for n in (2, 3):
            at = np.flatnonzero(place <= sizes[who] + 2 - n)  # up to the closing mark
            parts.append(_bucket(grown[n - 1][at], n))
            owners.append(who[at])
        every = np.arange(len(words))
        for n in (1, 2, 3, 4):
            head, tail = np.minimum(n, sizes), np.maximum(sizes - n, 0)
            parts.append(_bucket(grown[n - 1][begins + 1] >> (8 * (n - head)).astype(np.uint64), 10 + n))
            parts.append(_bucket(grown[n - 1][begins + 1 + tail] >> (8 * (n - head)).astype(np.uint64), 20 + n))
            owners += [every, every]
        known = [(i, found) for i, w in enumerate(words) if (found := self.lexicon.get(w))]
        for i, (number, ys) in known:
            parts.append(np.concatenate([_bucket(np.array([number]), 30), _bucket(np.array(ys), 31)]).repeat(3))
            owners.append(np.full(len(parts[-1]), i))
        flat, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(words))

    def emissions(self, words: list[bytes]) -> list[bytes]:
        """Label scores of words: the sum of their features' weights over the root of their number."""
        flat, sizes = self.features(words)
        sums = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)
        packed = (sums / np.sqrt(sizes)[:, None]).astype(np.float32).tobytes()
        step = 4 * len(self.labels)
        return [packed[i : i + step] for i in range(0, len(packed), step)]


def marginals(scores: np.ndarray, moves: np.ndarray, mask: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None):
    """Forward-backward on many chains at once: scores (chains, length, labels), mask (chains, length) of real words.

    ``enter`` and ``leave`` (chains, labels) are the messages from before the first and from behind the last word;
    without them chains begin and end there. Returns the words' label distributions, the expected transition counts
    inside the chains and each chain's log normaliser.
    """
    n, length, k = scores.shape
    move = np.exp(moves)
    emit = np.exp(scores - scores.max(2, keepdims=True))
    ahead, scale = np.zeros((n, length, k)), np.ones((n, length))
    now = emit[:, 0] if enter is None else emit[:, 0] * enter
    for t in range(length):
        if t:
            now = np.where(mask[:, t, None], (ahead[:, t - 1] @ move) * emit[:, t], ahead[:, t - 1])
        scale[:, t] = now.sum(1)
        ahead[:, t] = now = now / scale[:, t, None]
    back = np.ones((n, length, k))
    if leave is not None:
        back[:, -1] = leave
    expected = np.zeros((k, k))
    for t in range(length - 2, -1, -1):
        after = emit[:, t + 1] * back[:, t + 1] / scale[:, t + 1, None]
        live = mask[:, t + 1, None]
        back[:, t] = np.where(live, after @ move.T, back[:, t + 1])
        expected += (ahead[:, t] * mask[:, t + 1, None]).T @ after * move
    post = ahead * back
    post /= post.sum(2, keepdims=True)
    norm = (np.log(scale) * mask).sum(1) + (scores.max(2) * mask).sum(1)
    return post, expected, norm


def whole_chain(scores: np.ndarray, moves: np.ndarray, mask: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Label distributions of the words of chains that go on over several blocks (rows of ``scores``), ``place``
    being a block's number in its chain, from 0; blocks of a chain follow each other.

    A block takes the message at the word before it to the one at its last word by a matrix (labels by labels), the
    product of its words' transitions. Messages go through these matrices from block to block, all chains at once;
    then every block is worked on by itself between the messages that reach it.
    """
    n, length, k = scores.shape
    if not n or place.max() == 0:
        return marginals(scores, moves, mask)[0]
    move = np.exp(moves)
    emit = np.exp(scores - scores.max(2, keepdims=True))
    first = place == 0
    through = np.where(first[:, None, None], 1.0, move) * emit[:, 0][:, None, :]
    for t in range(1, length):
        through = np.where(mask[:, t, None, None], (through @ move) * emit[:, t][:, None, :], through)
        through /= through.sum((1, 2))[:, None, None]
    last = np.append(first[1:], True)
    ahead, back = np.full((n, k), 1.0 / k), np.ones((n, k))  # a first block's matrix has equal rows: any message will do
    by_place = np.argsort(place, kind="stable")
    waves = np.split(by_place, np.cumsum(np.bincount(place))[:-1])
    for at in waves[1:]:
        went = np.einsum("bi,bij->bj", ahead[at - 1], through[at - 1])
        ahead[at] = went / went.sum(1)[:, None]
    for at in reversed(waves):
        on = at[~last[at]] + 1
        if len(on):
            came = np.einsum("bij,bj->bi", through[on], back[on])
            back[on - 1] = came / came.sum(1)[:, None]
    enter = np.where(first[:, None], 1.0, ahead @ move)
    return marginals(scores, moves, mask, enter, back)[0]


def _training_chains(sample: list[tuple[str, list[bytes]]], labels: list[str], rng: np.random.Generator):
    """Chains of TRAIN_CHAIN words with a label each; every second chain switches language inside."""
    by_label = defaultdict(list)
    for lang, words in sample:
        for i in range(0, len(words), TRAIN_CHAIN):
            by_label[labels.index(lang)].append(words[i : i + TRAIN_CHAIN])
    chains = []
    for y, parts in by_label.items():
        others = [z for z in by_label if z != y]
        for i, words in enumerate(parts):
            tags = [y] * len(words)
            if i % 2 and others and len(words) > 8:
                z = others[rng.integers(len(others))]
                cut = int(rng.integers(4, len(words) - 3))
                more = by_label[z][rng.integers(len(by_label[z]))][: len(words) - cut]
                words, tags = words[:cut] + more, tags[:cut] + [z] * len(more)
            chains.append((words, tags))
    return chains


def fit(sample: list[tuple[str, str]], steps: int = STEPS, seed: int = 1) -> Field:
    """Fit on (language, text) rows; their number is what bounds the work. Deterministic."""
    labels = sorted({lang for lang, _ in sample})
    rng = np.random.default_rng(seed)
    rows, counts = [], defaultdict(Counter)
    for lang, text in sorted(sample):
        words = words_of(text)
        if len(words) > SAMPLE_WORDS:
            at = int(rng.integers(0, len(words) - SAMPLE_WORDS + 1))
            words = words[at : at + SAMPLE_WORDS]
        if words:
            rows.append((lang, words))
            counts[lang].update(words)
    lexicon: dict[bytes, list[int]] = defaultdict(list)
    for y, lang in enumerate(labels):
        for word, n in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS]:
            if n > 1:
                lexicon[word].append(y)
    field = Field(labels, {w: tuple(ys) for w, ys in lexicon.items()})
    k, chains = len(labels), _training_chains(rows, labels, rng)
    if k < 2 or not chains:
        return field
    vocabulary = {w: i for i, w in enumerate(sorted({w for words, _ in chains for w in words}))}
    flat, sizes = field.features(list(vocabulary))
    begin = np.cumsum(sizes) - sizes
    root = np.sqrt(sizes)[:, None]
    ids, gold = np.zeros((len(chains), TRAIN_CHAIN), np.int64), np.zeros((len(chains), TRAIN_CHAIN), np.int64)
    mask = np.zeros((len(chains), TRAIN_CHAIN), bool)
    for i, (words, tags) in enumerate(chains):
        ids[i, : len(words)], gold[i, : len(words)], mask[i, : len(words)] = [vocabulary[w] for w in words], tags, True
    pairs = (mask[:, 1:]).ravel()
    seen_moves = np.bincount((gold[:, :-1] * k + gold[:, 1:]).ravel()[pairs], minlength=k * k).reshape(k, k)
    truth = np.eye(k)[gold] * mask[..., None]
    first, second = [np.zeros((BUCKETS, k)), np.zeros((k, k))], [np.zeros((BUCKETS, k)), np.zeros((k, k))]
    weights, moves = np.zeros((BUCKETS, k)), np.zeros((k, k))
    total = mask.sum()
    for step in range(1, steps + 1):
        emit = np.add.reduceat(weights[flat], begin) / root
        post, expected, _ = marginals(emit[ids], moves, mask)
        diff = (truth - post * mask[..., None]).reshape(-1, k)
        per_word = np.stack([np.bincount(ids.ravel(), diff[:, y], len(vocabulary)) for y in range(k)], 1) / root
        spread = np.repeat(per_word, sizes, axis=0)
        grads = [np.stack([np.bincount(flat, spread[:, y], BUCKETS) for y in range(k)], 1) / total - 1e-6 * weights, (seen_moves - expected) / total - 1e-5 * moves]
        for i, (value, grad) in enumerate(zip((weights, moves), grads)):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.99 * second[i] + 0.01 * grad**2
            value += 0.15 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    field.weights, field.moves = weights.astype(np.float32), moves
    return field


def training_sample(docs: DataFrame, per_language: int = SAMPLE_DOCS, total: int = SAMPLE_TOTAL) -> list[tuple[str, str]]:
    """At most ``per_language`` (lang, text) rows of each language, and about ``total`` in all (one a language at least).

    Rows of the held-out fold, with a null language or without text are left out. Which rows, is decided by a
    hash of the id, so it does not depend on partitioning.
    """
    usable = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").count().collect()  # languages, not rows
    if not counts:
        return []
    per_language = max(1, min(per_language, total // len(counts)))
    share = F.create_map(*[x for r in sorted(counts) for x in (F.lit(r["lang"]), F.lit(min(1.0, (1.3 * per_language + 20) / r["count"])))])
    mixed = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 30))
    picked = usable.withColumn("mixed", mixed).filter(F.col("mixed") < F.element_at(share, F.col("lang")) * (1 << 30))
    middle = F.greatest(F.lit(1), (F.length("text") - 16 * SAMPLE_WORDS) / 2).cast("int")
    rows = picked.select("lang", "mixed", F.col("text").substr(middle, F.lit(16 * SAMPLE_WORDS)).alias("text"))
    rows = rows.groupBy("lang", "mixed").agg(F.min("text").alias("text"))  # one of the rows that share an id
    rows = rows.limit((2 * per_language + 40) * len(counts)).collect()
    out: dict[str, list] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["mixed"], r["text"])):
        if len(out[r["lang"]]) < per_language:
            out[r["lang"]].append((r["lang"], r["text"]))
    return [x for lang in sorted(out) for x in out[lang]]


def scores_memo(field: Field) -> Memo:
    return Memo(lambda word: field.emissions([word])[0])


def _labeller(held):
    """The broadcast field and its cache, kept by the worker as long as it works on this stage."""
    return of_worker(("field", held), lambda: (held.value, scores_memo(held.value)))


def label_texts(field: Field, memo: Memo, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
    """Leading language, its share of the words (weighted by length) and switches between labels, of every text."""
    k = len(field.labels)
    words = [words_of(x) if x and _LETTER.search(x) else [] for x in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    if not flat or not k:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts), [0] * len(texts)
    memo.fill(set(flat), field.emissions)
    scores = np.frombuffer(b"".join(map(memo.__getitem__, flat)), np.float32).reshape(-1, k)
    length = np.fromiter(map(len, flat), np.float64, len(flat))
    blocks = -(-counts // BLOCK)
    doc = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    before = np.cumsum(blocks) - blocks
    row = np.repeat(before, counts) + place // BLOCK
    grid, mask = np.zeros((int(blocks.sum()), BLOCK, k), np.float32), np.zeros((int(blocks.sum()), BLOCK), bool)
    grid[row, place % BLOCK], mask[row, place % BLOCK] = scores, True
    post = whole_chain(grid, field.moves, mask, np.arange(len(grid)) - np.repeat(before, blocks))[row, place % BLOCK]
    mass = np.stack([np.bincount(doc, post[:, y] * length, len(texts)) for y in range(k)], 1)
    best = post.argmax(1)
    change = np.zeros(len(flat), bool)
    change[1:] = (best[1:] != best[:-1]) & (doc[1:] == doc[:-1])
    switches = np.bincount(doc, change, len(texts)).astype(int).tolist()
    total = mass.sum(1)
    lead = mass.argmax(1)
    share = np.where(total > 0, mass.max(1) / np.where(total > 0, total, 1), 0.0)
    named = [field.labels[y] if t > 0 else UNDETERMINED for y, t in zip(lead.tolist(), total.tolist())]
    return named, np.clip(share, 0, 1).tolist(), switches


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, lang_pred, score (share of the leading language), n_switches (label changes between words) of every row.

    ``und`` with score 0 where the text is null or has no letter. Repeated rows stay; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(field)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, memo = _labeller(held)
        for batch in portions(batches, 1):
            named, share, switches = label_texts(field, memo, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(named, pa.string()), pa.array(share, pa.float64()), pa.array(switches, pa.int32())],
                names=["doc_id", "lang_pred", "score", "n_switches"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_switches int")


def keep_identified(docs: DataFrame, field: Field, min_share: float = MIN_SHARE) -> DataFrame:
    """All rows and columns of documents with a language of share ``min_share`` or more; null ids compare like values."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(field)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, memo = _labeller(held)
        for batch in portions(batches, at):
            texts = batch.column(at).to_pylist()
            named, share, _ = label_texts(field, memo, texts)
            yield batch.filter(pa.array([x != UNDETERMINED and s >= min_share for x, s in zip(named, share)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(training_sample(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_switches")
