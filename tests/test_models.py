"""Text embeddings, adapters and experiments side by side."""

import threading
import time

import numpy as np
import pytest
from parley.operators import adapter, embed, experiments, plots
from parley.plans import fixtures
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def sparse(text, sizes=(3, 4, 5)):
    raw = (" " + " ".join(text.lower().split()) + " ").encode() if text.strip() else b""
    out = {}
    for n in sizes:
        for i in range(len(raw) - n + 1):
            out[raw[i : i + n]] = out.get(raw[i : i + n], 0) + 1
    return {k: v**0.5 for k, v in out.items()}


def cosine(a, b):
    norm = lambda v: sum(x * x for x in v.values()) ** 0.5
    return sum(v * b.get(k, 0.0) for k, v in a.items()) / (norm(a) * norm(b)) if a and b else 0.0


def test_ngrams_are_counted_as_by_hand():
    texts = ["Ab abab", "", "  ", "é", "a  b\nc", "xx"]
    owner, h, weight = embed.HashedNgrams().counts(texts)
    for i, t in enumerate(texts):
        want = sparse(t)
        assert sorted(weight[owner == i]) == pytest.approx(sorted(want.values())) and len(set(h[owner == i])) == len(want)


def test_neighbours_by_embedding_are_those_of_the_sparse_vectors(spark):
    """Recall of the ten nearest utterances among 400, exact cosines of n-gram counts as the truth; the texts are unrelated,
    so their cosines differ by little: twenty vectors are looked at for the ten, or ten of four times the size."""
    rows = [r["utt_text"] for r in fixtures.utterances(spark, SF.replace("0.001", "0.01")).orderBy("conv_id", "conv_utt_idx").limit(400).collect()]
    exact = [sparse(t) for t in rows]
    true = {i: np.array([cosine(exact[i], e) if j != i else -1 for j, e in enumerate(exact)]) for i in range(0, 400, 20)}
    for dim, looked_at in ((4096, 20), (16384, 10)):
        vectors, hit = embed.HashedNgrams(dim=dim).embed(rows), 0
        for i, t in true.items():
            near = vectors @ vectors[i]
            near[i] = -1
            hit += len(set(np.argsort(-t)[:10]) & set(np.argsort(-near)[:looked_at]))
        assert hit / 200 >= 0.9


def test_embedding_column(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None), (3, ""), (4, "some text")], "id int, t string")
    got = {r["id"]: np.array(r["v"]) for r in embed.with_embeddings(df, "t", lambda: embed.HashedNgrams(dim=64), "v").collect()}
    assert all(len(v) == 64 for v in got.values()) and (got[1] == got[4]).all() and not got[2].any() and not got[3].any()
    assert (got[1] @ got[1]) == pytest.approx(1, abs=1e-5)

    class Lengths:
        def embed(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

    assert {r["id"]: r["v"] for r in embed.with_embeddings(df, "t", Lengths, "v").collect()}[1] == [9.0, 1.0]


def test_adapter_learns_what_its_base_lacks(spark):
    """Classes that the base confuses: a rank-two change tells them apart, on rows of the held-out fold."""
    rng = np.random.default_rng(0)
    centres = np.array([[1.0, 0, 0, 0, 0, 0], [0.9, 0.4, 0, 0, 0, 0], [0, 0, 1.0, 0, 0, 0]])
    rows = [((centres[c] + rng.normal(size=6) * 0.12).tolist(), "abc"[c], int(i % 3)) for i, c in enumerate(rng.integers(0, 3, 360))]
    df = spark.createDataFrame(rows, "x array<double>, label string, fold int")
    labels, base = ["a", "b", "c"], np.array([[1.0, 0, 0, 0, 0, 0], [1.0, 0, 0, 0, 0, 0], [0, 0, 1.0, 0, 0, 0]])
    models = adapter.train(df.repartition(5), labels, base, folds=3, rank=2, steps=25)
    again = adapter.train(df.repartition(2), labels, base, folds=3, rank=2, steps=25)
    assert all((m.base == base).all() and np.allclose(m.weights, o.weights, atol=1e-6) for m, o in zip(models, again))
    assert models[0].share == pytest.approx((3 * 2 + 2 * 6) / 18)
    named = df.withColumn("said", adapter.predicted([m.weights for m in models], labels, F.col("x"), F.col("fold")))
    named = named.withColumn("before", adapter.predicted([base] * 3, labels, F.col("x"), F.col("fold")))
    r = named.agg(F.avg((F.col("said") == F.col("label")).cast("double")).alias("after"), F.avg((F.col("before") == F.col("label")).cast("double")).alias("before")).first()
    assert r["after"] > 0.9 > 0.75 > r["before"]


def test_experiments_side_by_side(spark, tmp_path):
    path, running, most, lock = str(tmp_path / "runs"), [0], [0], threading.Lock()
    names = [f"e{i}" for i in range(5)]

    def run(e):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            time.sleep(0.3)
            if e["experiment_id"] == "e2":
                raise RuntimeError("no model")
            return spark.range(1000).selectExpr("sum(id) AS s").first()["s"]
        finally:
            with lock:
                running[0] -= 1

    got = experiments.run_parallel(spark, [{"experiment_id": n} for n in names], run, path, 2)
    assert most[0] == 2 and got["e2"] == {"success": False, "error": "no model"} and got["e1"] == {"success": True, "result": 499500}
    known = experiments.progress(spark, path)
    assert {n: known[n]["state"] for n in names} == {n: "failed" if n == "e2" else "done" for n in names} and known["e2"]["error"] == "no model"
    seen = []
    experiments.run_parallel(spark, [{"experiment_id": n} for n in names], lambda e: seen.append(e["experiment_id"]), path, 3)
    assert seen == ["e2"] and experiments.progress(spark, path)["e2"]["state"] == "done"


def test_a_failing_run_cancels_its_own_jobs_only(spark, tmp_path):
    ended = {}

    def slow(seconds):
        def wait(frames):
            for f in frames:
                time.sleep(seconds)
                yield f

        return spark.range(0, 2, 1, 1).mapInPandas(wait, "id long").count()

    def run(e):
        if e["experiment_id"] == "good":
            ended["good"] = slow(4)
            return ended["good"]
        from pyspark import inheritable_thread_target

        def behind():
            try:
                ended["orphan"] = slow(20)
            except Exception as error:  # noqa: BLE001 cancelled
                ended["orphan"] = "cancelled" if "cancel" in str(error).lower() else str(error)

        other = threading.Thread(target=inheritable_thread_target(behind))
        other.start()
        time.sleep(1.5)
        ended["thread"] = other
        raise RuntimeError("stop")

    got = experiments.run_parallel(spark, [{"experiment_id": "bad"}, {"experiment_id": "good"}], run, str(tmp_path / "runs"), 2)
    ended["thread"].join(30)
    assert got["good"] == {"success": True, "result": 2} and not got["bad"]["success"] and ended["orphan"] == "cancelled"


def test_densities_and_boxes_by_their_definitions(spark):
    rng = np.random.default_rng(3)
    values = np.r_[rng.normal(size=200), [9.0, 9.0, -8.0]]
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("flat", 1.0), ("flat", 1.0), ("none", None)], "s string, v double")
    box = {r["group"]: r for r in plots.boxes(df, "s", ["v"]).collect()}
    q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
    g = box["g"]
    assert (g["q1"], g["median"], g["q3"], g["mean"]) == pytest.approx((q1, q2, q3, values.mean()))
    assert (g["whisker_low"], g["whisker_high"], g["n_outliers"]) == (inside.min(), inside.max(), len(values) - len(inside))
    assert g["outliers"] == sorted(set(values) - set(inside)) and set(box) == {"g", "flat"} and box["flat"]["n_outliers"] == 0
    got = plots.violins(df, "s", ["v"], grid=400).orderBy("k").collect()
    assert {r["group"] for r in got} == {"g"}
    x, h = np.array([r["x"] for r in got]), values.std(ddof=1) * len(values) ** -0.2
    exact = np.exp(-0.5 * ((x[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert np.array([r["density"] for r in got]) == pytest.approx(exact, abs=2e-3) and np.trapezoid(exact, x) == pytest.approx(1, abs=0.05)


def test_adapter_query_by_fold(spark):
    from parley.plans.registry import QUERIES

    rows = QUERIES["adapter_by_fold"](spark, SF.replace("0.001", "0.01")).collect()
    assert len(rows) == 3 and all(r["adapter"] >= r["base"] and r["adapter"] > 0.9 and r["share"] < 0.5 for r in rows)


def test_adapter_query_embeds_each_text_once(spark, tmp_path, monkeypatch):
    from parley.operators import embed
    from parley.plans.registry import QUERIES

    log, real = str(tmp_path / "rows"), embed.with_embeddings

    def counted(df, *args):
        def run(batches):
            for b in batches:
                with open(log, "a") as f:
                    f.write(f"{b.num_rows}\n")
                yield b

        out = real(df, *args)
        return out.mapInArrow(run, out.schema)

    monkeypatch.setattr(embed, "with_embeddings", counted)
    rows = QUERIES["adapter_by_fold"](spark, SF).collect()
    n = spark.read.parquet(f"{SF}/documents.parquet").filter("lang IS NOT NULL AND text IS NOT NULL").count()
    with open(log) as f:
        assert len(rows) == 3 and sum(map(int, f)) == n


def test_token_lengths_are_the_library_s(spark):
    import public_tokenizers
    from parley.operators import prompts
    from parley.plans.registry import QUERIES
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = fixtures.coded(spark, SF).select(F.concat(prompts.bare_prompt(F.col("speaker"), F.col("utt_text"), "t2"), prompts.completion(F.col("t2_gold"))).alias("x")).collect()
    n = np.array([len(tok.encode(r["x"], add_special_tokens=False).ids) for r in rows if r["x"] is not None] + [0] * sum(r["x"] is None for r in rows))
    r = QUERIES["prompt_token_lengths"](spark, SF).first()
    assert (r["n"], r["longest"], r["too_long"], r["cut"]) == (len(n), n.max(), (n > 128).sum(), np.maximum(n - 128, 0).sum())
    assert (r["median"], r["p95"]) == pytest.approx((np.quantile(n, 0.5), np.quantile(n, 0.95)))
