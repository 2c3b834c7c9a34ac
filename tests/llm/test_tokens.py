"""Token counts, byte-level BPE and plane files against the libraries."""

import hashlib
import io
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from parley.llm import byte_bpe, planes, token_counts
from tokenizers import Tokenizer

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library_on_odd_texts(library, odd_texts):
    model = byte_bpe.Bpe(RANKS)
    got = model.encode(odd_texts)
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in odd_texts]
    assert all(model.decode(g.tolist()) == t.encode() for g, t in zip(got, odd_texts))


def test_bpe_does_not_depend_on_its_cache(library, odd_texts):
    model = byte_bpe.Bpe(RANKS)
    model.cache.limit = 7
    assert [model.encode([t])[0].tolist() for t in odd_texts[:200]] == [library.encode_ordinary(t) for t in odd_texts[:200]]
    long = ("abcdefg" * 40).encode()
    assert model._merge_long(long) == model._merge_short(long) == np.frombuffer(model.merge_all([b"zq" + long[:30]])[0] * 0 + model._packed(long), "<u4").tolist()


def test_bpe_query(spark, sf, documents, library):
    got = {r["doc_id"]: r for r in byte_bpe.op9_scan_bpe(spark, sf).collect()}
    assert len(got) == len(documents)
    for d, t in zip(documents["doc_id"], documents["text"]):
        ids = library.encode_ordinary(t)
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_edges(spark, edge, empty):
    rows = byte_bpe.decode(byte_bpe.encode(edge, RANKS), RANKS).collect()
    assert len(rows) == edge.count() and byte_bpe.digests(empty, RANKS).count() == 0
    texts = {r["doc_id"]: r["text"] or "" for r in edge.collect()}
    assert all(bytes(r["decoded"]).decode() == texts[r["doc_id"]] for r in rows)


def test_offsets_cut_the_text(spark, edge):
    vocab = byte_bpe.Bpe(RANKS).vocab
    for r, t in zip(byte_bpe.encode(edge, RANKS, with_offsets=True).collect(), edge.collect()):
        raw = (t["text"] or "").encode()
        assert all(raw[a : a + len(vocab[i])] == vocab[i] for i, a in zip(r["ids"], r["starts"]))


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_counts_equal_the_library(spark, sf, documents, name):
    tok = Tokenizer.from_file(P.path(name))
    got = {r["doc_id"]: r for r in token_counts.op4_overlap_resync_counts(spark, sf).collect()}
    for d, t in zip(documents["doc_id"], documents["text"]):
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (got[d]["n_tokens"], got[d]["n_bytes"], got[d]["over_limit"]) == (n, len(t.encode()), n > 2048)


def test_splicing_is_exact(odd_texts):
    encode = token_counts.library_encode(token_counts.library_tokenizer(P.path("word_bpe_49k.json")))
    for chunk, overlap in ((12, 3), (40, 5), (7, 1)):
        for t in odd_texts:
            assert [i for i, _, _ in token_counts.splice(t, encode, chunk, overlap)] == [i for i, _, _ in encode(t)]


def test_counts_edges(spark, edge, empty):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for huge in (token_counts.HUGE_CHARS, 20):  # both ways of counting
        got = token_counts.count_tokens(edge, P.path("word_bpe_49k.json"), huge=huge).collect()
        assert len(got) == edge.count()
        for r, t in zip(got, edge.collect()):
            assert r["n_tokens"] == len(tok.encode(t["text"] or "", add_special_tokens=False).ids)
    assert token_counts.count_tokens(empty, P.path("word_bpe_49k.json")).count() == 0


def test_planes_round_trip():
    ids = np.random.default_rng(1).integers(0, 2**32, 1000, dtype=np.uint32)
    assert (planes.from_planes(planes.to_planes(ids), 1000) == ids).all()
    held = io.BytesIO()
    writer = planes.PlaneWriter(held, pa.int64(), block=16)
    docs = {7: ids[:5], 8: ids[:0], 9: ids[5:200], None: ids[200:216]}
    for k, v in docs.items():
        writer.add(k, v)
    assert writer.close() == (4, 216)
    got = list(planes.read_documents(pa.PythonFile(io.BytesIO(held.getvalue()), mode="r")))
    assert [g[0] for g in got] == list(docs) and [g[1] for g in got] == [0, 5, 5, 200]
    assert all((g[2] == docs[g[0]]).all() for g in got)


def test_library_encoder_equals_the_library(odd_texts):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = planes.encoder(P.path("byte_bpe_50k.json"))(odd_texts)
    assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in odd_texts]


def test_planes_query(spark, sf, documents):
    tok, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in planes.op7_bit_planes(spark, sf).collect()}
    for d, t in sorted(zip(documents["doc_id"], documents["text"])):
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("range_bytes, file_ids", [(4000, 300), (1 << 20, 1 << 20)])
def test_planes_edges(spark, edge, empty, range_bytes, file_ids):
    files = planes.write_planes(edge, P.path("byte_bpe_50k.json"), 2, range_bytes=range_bytes, file_ids=file_ids)
    got = sorted(planes.read_planes(files).collect(), key=lambda r: r["start"])
    assert len(got) == edge.count() and files.count() > (1 if file_ids == 300 else 0)
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in edge.collect()), key=lambda x: (x is not None, x))
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]
    assert planes.read_planes(planes.write_planes(empty, P.path("byte_bpe_50k.json"), 2)).count() == 0


def test_planes_take_ids_of_other_types(spark, documents):
    rows = [(f"doc-{i:05d}", t) for i, t in zip(documents["doc_id"], documents["text"])]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(7)
    files = planes.write_planes(docs, P.path("byte_bpe_50k.json"), 2, range_bytes=40_000)
    got = sorted(planes.read_planes(files, "string").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in rows) and files.count() > 3


def test_rows_of_one_id_spread_over_files(spark):
    docs = spark.createDataFrame([(None, f"text number {i} " * 20) for i in range(400)], "doc_id long, text string")
    files = planes.write_planes(docs, P.path("byte_bpe_50k.json"), 2, range_bytes=20_000).collect()
    assert len(files) >= 4 and max(r["n_docs"] for r in files) < 200


def test_a_file_of_a_lost_task_does_not_count(spark, edge, tmp_path):
    files = planes.write_planes(edge, P.path("byte_bpe_50k.json"), 2, path=str(tmp_path / "out"))
    one = files.first()["file"].removeprefix("file://")
    import shutil

    shutil.copy(one, one.replace("part-", "part-9"))
    assert planes.read_planes(files).count() == edge.count()


def test_long_text_is_cut_into_parts(library, monkeypatch, odd_texts):
    monkeypatch.setattr(byte_bpe, "PART", 37)
    monkeypatch.setattr(byte_bpe, "GROUP", 5)
    text = "".join(odd_texts)
    assert byte_bpe.Bpe(RANKS).encode([text, "", text[:50]])[0].tolist() == library.encode_ordinary(text)
