"""Token counts of whole texts, huge documents spliced from overlapping chunks.

White space never joins two tokens of the vocabulary used here: the normaliser maps it to one space and the
pre-tokeniser drops it. A place right after an ASCII white space is therefore a proven stable boundary: the
tokens on each side depend on that side alone. Documents above ``HUGE_CHARS`` are encoded in overlapping
chunks with offsets and spliced at such places, where both encodings start a token; where an overlap holds
none, it is widened. Shorter documents use the same boundary for single words, whose counts are memoised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import ASCII_SPACE, portions, small_batches, table
from parley.llm.memo import Memo, of_worker

HUGE_CHARS = 32_768
CHUNK_CHARS = 8_192
OVERLAP_CHARS = 256
TOKEN_LIMIT = 2048


def library_tokenizer(path: str):
    """The library's tokenizer of a .json file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


Encoded = list[tuple[int, int, int]]  # id, start, end in code points


def library_encode(tok) -> Callable[[str], Encoded]:
    def encode(text: str) -> Encoded:
        got = tok.encode(text, add_special_tokens=False)
        return [(i, a, b) for i, (a, b) in zip(got.ids, got.offsets)]

    return encode


def splice(text: str, encode: Callable[[str], Encoded], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Encoded:
    """Tokens of the whole text from chunks of it, with offsets in the whole text.

    ``chunk`` and ``overlap`` are starting sizes: a chunk without a stable boundary in its overlap is met again
    with twice the overlap, in the end with a longer chunk, so text without any white space is encoded whole.
    """
    n, out, start = len(text), [], 0
    end = min(n, chunk)
    left = encode(text[:end])
    while end < n:
        back, step = min(overlap, max(1, end - start - 1)), chunk
        while True:
            at = end - back
            stop = min(n, at + max(step, 2 * back))
            right = [(i, a + at, b + at) for i, a, b in encode(text[at:stop])]
            starts = {a for _, a, _ in left}
            cut = next((a for _, a, _ in reversed(right) if at < a < end and a in starts and text[a - 1] in ASCII_SPACE), None)
            if cut is not None:
                out += [t for t in left if t[1] < cut]
                left, start, end = [t for t in right if t[1] >= cut], cut, stop
                break
            if back < end - start - 1:
                back = min(2 * back, end - start - 1)
                continue
            end = min(n, end + 2 * (end - start))  # no boundary in all of the chunk: lengthen it
            left = [(i, a + start, b + start) for i, a, b in encode(text[start:end])]
            if end == n:
                break
            back = min(overlap, end - start - 1)
    return out + left


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = TOKEN_LIMIT, huge: int = HUGE_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; a null text counts as empty.

    ``tokenizer``: path of a .json file of the tokenizers library on every executor, whose pre-tokeniser drops
    white space. Rows are kept as they are, repeated ones too; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def counter():
        tok = library_tokenizer(tokenizer)

        def count_all(words: list[bytes]) -> list[int]:
            return [len(x.ids) for x in tok.encode_batch([w.decode() for w in words], add_special_tokens=False)]

        return library_encode(tok), count_all, Memo(lambda word: count_all([word])[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, count_all, memo = of_worker(("counts", tokenizer), counter)
        for batch in portions(batches, 1):
            texts = batch.column(1).to_pylist()
            raws = [(x or "").encode() for x in texts]
            long = [len(raw) > huge and len(text) > huge for raw, text in zip(raws, texts)]
            words = [[] if far else raw.split() for raw, far in zip(raws, long)]
            memo.fill({w for ws in words for w in ws}, count_all)
            counts = [len(splice(text, encode)) if far else sum(map(memo.__getitem__, ws)) for text, far, ws in zip(texts, long, words)]
            sizes = list(map(len, raws))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_overlap_resync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
