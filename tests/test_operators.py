"""Operators on small frames with known results."""


import numpy as np
import pytest
from parley.functions import labels as L
from parley.functions import stats
from parley.functions.text import normal_speaker, segments
from parley.operators import agreement, context, dtw, experiments, learn, metrics, order, prepare, rollup, sessions, splits, trajectory
from parley.vocab import CLIENT_T2, COUNSELLOR_T2, SCALES, T2_TO_T1, vocabulary
from pyspark.sql import functions as F


def frame(spark, rows, shape):
    return spark.createDataFrame(rows, shape)


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_vocabulary():
    assert len(COUNSELLOR_T2) == 19 and len(CLIENT_T2) == 17 and len(vocabulary("t2")) == 36
    assert set(T2_TO_T1) == set(COUNSELLOR_T2) | set(CLIENT_T2)
    assert SCALES["motiv5"]["O+"] == 0 and SCALES["motiv17"]["TS-"] == -8 and SCALES["plot_t2"]["TS+"] == 1
    with pytest.raises(ValueError):
        vocabulary("t3")


def pairs_2x2(spark):
    cells = {("a", "a"): 20, ("a", "b"): 5, ("b", "a"): 10, ("b", "b"): 15}
    return frame(spark, [k for k, n in cells.items() for _ in range(n)], "x string, y string")


def test_kappa(spark):
    r = agreement.kappa(pairs_2x2(spark), "x", "y").first()
    assert (round(r["p0"], 9), round(r["pe"], 9), round(r["kappa"], 9)) == (0.7, 0.5, 0.4)
    assert r["variance"] == pytest.approx(0.01728) and r["z"] == pytest.approx(3.042903, abs=1e-6)
    other = agreement.with_p_value(agreement.kappa(pairs_2x2(spark), "x", "y", theta4="textbook")).first()
    assert other["variance"] == pytest.approx(0.016128) and other["p_value"] == pytest.approx(0.0016344, abs=1e-6)
    with pytest.raises(ValueError):
        agreement.kappa(pairs_2x2(spark), "x", "y", theta4="none")


def test_kappa_is_symmetric_and_handles_missing(spark):
    rows = frame(spark, [("a", "b"), ("a", "a"), (None, "a"), ("b", None), ("c", "c")], "x string, y string")
    assert agreement.kappa(rows, "x", "y").first()["kappa"] == pytest.approx(agreement.kappa(rows, "y", "x").first()["kappa"])
    assert agreement.kappa(rows, "x", "y").first()["n"] == 3
    assert agreement.kappa(frame(spark, [("a", "a")], "x string, y string"), "x", "y").first()["kappa"] is None


def test_fleiss_published_example(spark):
    counts = [[0, 0, 0, 0, 14], [0, 2, 6, 4, 2], [0, 0, 3, 5, 6], [0, 3, 9, 2, 0], [2, 2, 8, 1, 1], [7, 7, 0, 0, 0], [3, 2, 6, 3, 0], [2, 5, 3, 2, 2], [6, 5, 2, 1, 0], [0, 2, 2, 3, 7]]
    rows = [(i, f"c{j}") for i, row in enumerate(counts) for j, n in enumerate(row) for _ in range(n)]
    rows += [(99, "c0")]  # an item without all raters does not count
    r = agreement.fleiss_kappa(frame(spark, rows, "item int, label string"), ["item"], 14).first()
    assert r["kappa"] == pytest.approx(0.209931, abs=1e-6) and r["n_items"] == 10


def test_mcnemar_and_distributions():
    assert stats.binomial_two_sided(1, 5) == pytest.approx(14 / 64) and stats.binomial_two_sided(0, 0) == 1
    assert stats.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.f_upper(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)


def test_confusion_and_report(spark):
    cells = agreement.confusion_matrix(pairs_2x2(spark), "x", "y", ["a", "b", "c"])
    assert cells.count() == 9 and cells.agg(F.sum("n")).first()[0] == 50
    report = {r["label"]: r for r in metrics.class_report(pairs_2x2(spark), "x", "y", ["a", "b", "c"]).collect()}
    assert report["a"]["precision"] == pytest.approx(20 / 30) and report["c"]["f1"] == 0 and report["c"]["support"] == 0
    s = metrics.summary(pairs_2x2(spark), "x", "y", ["a", "b", "c"]).first()
    assert s["accuracy"] == 0.7 and s["f1_macro"] == pytest.approx((report["a"]["f1"] + report["b"]["f1"]) / 3)
    assert metrics.summary(pairs_2x2(spark), "x", "y").first()["f1_macro"] == pytest.approx((report["a"]["f1"] + report["b"]["f1"]) / 2)


def test_momentum(spark):
    t1 = frame(spark, [(1, i, c) for i, c in enumerate(["C", "C", "N", "S", None])], "conv_id long, conv_utt_idx long, code string")
    got = [r[0] for r in trajectory.momentum(t1, "code").orderBy("conv_utt_idx").select("momentum").collect()]
    assert got == pytest.approx([0, 0.1, 0.09, -0.01, -0.01])
    t2 = frame(spark, [(1, i, c) for i, c in enumerate(["N", "C+", "R+", "O+", "TS-"])], "conv_id long, conv_utt_idx long, code string")
    got = [r[0] for r in trajectory.momentum(t2, "code", tier="t2").orderBy("conv_utt_idx").select("momentum").collect()]
    assert got == pytest.approx([0, 0.2, 0.3, 0.27, 0.07])


def test_leave_one_out(spark):
    rows = frame(spark, list(zip(range(5), [1.0, 2.0, 3.0, 4.0, 5.0], [1.0, 3.0, 2.0, 5.0, 4.0])), "conv_id int, x double, y double")
    got = trajectory.leave_one_out(rows, "x", "y")
    assert [r[0] for r in got.orderBy("conv_id").select("predicted").collect()] == pytest.approx([2, 1.857143, 3.25, 3.285714, 5.5], abs=1e-6)
    r = trajectory.leave_one_out_summary(got).first()
    assert (r["mse"], r["r2"]) == pytest.approx((1.811480, 0.094260), abs=1e-5)
    one = trajectory.simple_regressions(rows, ["x"], "y").first()
    assert (one["slope"], one["intercept"]) == pytest.approx((0.8, 0.6))
    many = learn.multiple_regression(rows, ["x"], "y").first()
    assert many["r2"] == pytest.approx(one["r2"]) and many["p_value"] == pytest.approx(0.1040880, abs=1e-5)


def test_sweep_is_a_regression_for_every_setting(spark):
    random = np.random.default_rng(3)
    points = [(s, 100.0 * i / 11, float(v)) for s in range(30) for i, v in enumerate(random.normal(size=12))]
    outcomes = frame(spark, [(s, float(v) if s != 4 else None) for s, v in enumerate(random.normal(size=30))], "conv_id int, y double")
    points = frame(spark, points, "conv_id int, progress double, score double")
    values_ = trajectory.grids(points, [2, 5, 40]).join(outcomes, "conv_id").select(F.col("size").alias("k"), F.col("cells.y").alias("x"), "y")
    got = {r["k"]: r for r in learn.sweep(values_, [2, 5, 40, 50]).collect()}
    for k in (2, 5):
        wide = trajectory.resample(points, k).groupBy("conv_id").pivot("k", list(range(k))).agg(F.first("y").alias("v"))
        want = learn.multiple_regression(wide.join(outcomes, "conv_id"), [str(i) for i in range(k)], "y").first()
        for c in ("n", "r2", "r2_adjusted", "f", "p_value"):
            assert got[k][c] == pytest.approx(want[c], rel=1e-8)
        assert got[k]["r"] == pytest.approx(want["r2"] ** 0.5)
    assert (got[40]["n"], got[40]["r2"], got[50]["n"], got[50]["r"]) == (29, None, 0, None)


def test_local_slopes_are_lines_through_the_points_of_a_part(spark):
    random = np.random.default_rng(5)
    points = [(s, 100.0 * i / (n - 1), float(v)) for s, n in enumerate((4, 5, 9, 40)) for i, v in enumerate(random.normal(size=n))]
    got = {(r["conv_id"], r["size"], r["chunk"]): r["slope"] for r in trajectory.local_slopes(frame(spark, points, "conv_id int, progress double, score double"), list(range(1, 21))).collect()}
    want = {}
    for s, n in enumerate((4, 5, 9, 40)):
        own = np.array([p[1:] for p in points if p[0] == s])
        for size in range(1, 21):
            for c in range(size if n >= max(5, size) else 0):
                step = 100.0 / size
                part = own[(own[:, 0] >= max(0, c - 1) * step) & (own[:, 0] < (c + 2 if c < size - 2 else c + 1) * step)]
                want[s, size, c] = np.polyfit(*part.T, 1)[0] if len(part) > 1 else 0.0
    assert got.keys() == want.keys() and [got[k] for k in want] == pytest.approx(list(want.values()), abs=1e-9)


def test_single_points_and_flat_sessions_have_no_slope(spark):
    rows = frame(spark, [(1, 0.0, 1.0), (2, 0.0, 1.0), (2, 50.0, 1.0)], "conv_id int, progress double, score double")
    got = {r["conv_id"]: r for r in trajectory.slopes(rows).collect()}
    assert got[1]["slope"] is None and got[2]["slope"] == 0 and got[2]["r"] is None


def test_slopes_at_the_edge_of_a_trend_fall_as_in_sql(spark):
    import duckdb

    scores = {1: (-0.0, 0.0, -1.0), 2: (1.0, 1.0, 2.0), 3: (1.0, -1.0, 2.0), 4: (2.0, 0.0, 2.0, 1.0, -2.0, 2.0, 1.0)}
    points = [(s, 10.0 * i, v) for s, own in scores.items() for i, v in enumerate(own)] + [(5, 10.0, None), (5, 20.0, 1.0)]
    con = duckdb.connect()
    con.execute("SET threads = 1; CREATE TABLE p (s INT, x DOUBLE, y DOUBLE)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", points)
    want = dict(con.execute("SELECT s, CASE WHEN var_pop(x) > 0 THEN regr_slope(y, x) END FROM (FROM p WHERE y IS NOT NULL ORDER BY s, x) GROUP BY s").fetchall())
    for parts in (1, 5):  # the order and the dealing of rows do not matter
        rows = frame(spark, points[::-1], "conv_id int, progress double, score double").repartition(parts)
        assert {r["conv_id"]: r["slope"] for r in trajectory.slopes(rows).collect()} == want


def test_dtw(spark):
    assert dtw.dtw(np.array([0.0, 1, 2]), np.array([0.0, 2, 2]))[0] == 1
    s = frame(spark, [(1, [0.0, 1.0, 2.0]), (2, [0.0, 2.0, 2.0]), (3, [9.0, 9.0, 9.0])], "conv_id long, values array<double>")
    assert values(dtw.pair_distances(s, frame(spark, [(1, 2)], "id_1 long, id_2 long")), "distance") == [(1.0,)]
    got = {r["conv_id"]: r["cluster"] for r in dtw.cluster(s, 2).collect()}
    assert got[1] == got[2] != got[3]


def test_session_metrics(spark):
    rows = [("counsellor", "CRL", "SR"), ("counsellor", "Q", "OQ"), ("counsellor", "IMI", "ADW"), ("counsellor", "CRL", "AF"), ("client", "C", "C+"), ("client", "C", "D+"), ("client", "S", "D-")]
    r = sessions.session_metrics(frame(spark, [(1, *x) for x in rows], "conv_id int, speaker string, t1 string, t2 string")).first()
    assert (r["pct_mic"], r["r_to_q"]) == (0.75, 1.0) and r["pct_ct"] == pytest.approx(2 / 3)
    none = sessions.session_metrics(frame(spark, [(1, "client", "N", "N")], "conv_id int, speaker string, t1 string, t2 string")).first()
    assert none["pct_ct"] == 0
    d = sessions.describe(frame(spark, [(1.0,), (2.0,), (3.0,), (10.0,)], "v double"), ["v"]).first()
    assert (d["p25"], d["median"], d["p75"]) == (1.75, 2.5, 4.75) and d["std"] == pytest.approx(3.535534, abs=1e-6)


UTTERANCES = [(0, "client", 0, "a"), (1, "counsellor", 1, "b"), (2, "counsellor", 1, "c"), (3, "client", 2, "d"), (4, "client", 2, "e"), (5, "client", 2, "f")]


def test_context(spark):
    rows = frame(spark, [(7, i, s, v, t) for i, s, v, t in UTTERANCES], "conv_id int, conv_utt_idx int, speaker string, conv_vol_idx int, utt_text string")
    at = lambda mode: context.with_context(rows, mode, 1).filter("utt_text = 'e'").first()["context"]
    assert at("interval") == "counsellor: b c\nclient: d e"
    assert at("cumulative") == "client: a\ncounsellor: b c\nclient: d e"
    assert at("all").endswith("client: d e f")
    with pytest.raises(ValueError):
        context.with_context(rows, "near")


@pytest.mark.parametrize(
    ("text", "head", "field", "lenient"),
    [
        ("`SR`. because", "SR", "SR", "SR"),
        ('the label is OQ {"label": "GI"}', "OQ", "GI", "OQ"),
        ("ADWP", "ADW", "ADW", "ADW"),
        ("no idea", "UNKNOWN", "UNKNOWN", "UNKNOWN"),
        ("", "UNKNOWN", "UNKNOWN", "UNKNOWN"),
        ("not GI but CR", "GI", "CR", "GI"),
    ],
)
def test_label_readers(spark, text, head, field, lenient):
    row = frame(spark, [(text,)], "t string").withColumn("allowed", L.array_of(COUNSELLOR_T2))
    got = row.select(L.parse_head(F.col("t"), F.col("allowed")), L.parse_field(F.col("t"), F.col("allowed")), L.parse_lenient(F.col("t"), F.col("allowed"))).first()
    assert tuple(got) == (head, field, lenient)


def test_votes_and_reduction(spark):
    votes = frame(spark, [(1, "SR"), (1, "CR"), (1, "SR"), (1, "CR"), (2, None), (3, "GI")], "item int, code_in string")
    assert values(rollup.majority_vote(votes, ["item"], "code_in"), "item", "codes") == [(1, ["CR", "SR"]), (3, ["GI"])]
    coded = frame(spark, [(1, "client", "R+"), (1, "client", "R-"), (1, "client", "N"), (2, "counsellor", "FI"), (3, "client", None)], "item int, speaker string, code_in string")
    assert values(rollup.reduce_to_scheme(coded, ["item"], "code_in"), "item", "code") == [(1, "C"), (2, "O"), (3, "N")]


def test_segments_and_speakers(spark):
    row = frame(spark, [("One? Two.\n Three", " Therapist", None)], "t string, s string, n string")
    got = row.select(segments(F.col("t")), normal_speaker(F.col("s")), segments(F.col("n"))).first()
    assert got[0] == ["One?", "Two.", "Three"] and got[1] == "counsellor" and got[2] is None
    raw = frame(spark, [("['SR', 'CR']",), ("[]",), ("GI",)], "r string")
    assert [r[0] for r in raw.select(L.first_label(F.col("r"))).collect()] == ["SR", None, "GI"]


@pytest.mark.parametrize("parts", [1, 5])
def test_running_index_and_sums(spark, parts):
    rows = frame(spark, [(i // 7, i) for i in range(100)], "a int, b int").repartition(parts)
    got = order.running_index(rows, ["a", "b"], "i").collect()
    assert len(got) == 100 and all(r["i"] == r["b"] for r in got)
    sums = order.running_sums(rows, ["a", "b"], {"before": "b"}).collect()
    assert all(r["before"] == r["b"] * (r["b"] - 1) // 2 for r in sums)
    assert order.running_index(rows.filter("a < 0"), ["a", "b"], "i").count() == 0
    hot = frame(spark, [(None, i) for i in range(50)] + [(1, i) for i in range(3)], "a int, b int")
    assert [r["i"] for r in order.running_index(hot, ["a", "b"], "i").orderBy("a", "b").collect()] == list(range(53))


def test_indices_of_a_corpus(spark):
    rows = frame(spark, [(c, v, u) for c, sizes in ((3, [2, 1]), (5, [1]), (9, [1, 1, 4])) for u, v in enumerate(x for v, n in enumerate(sizes) for x in [v * 2] * n)], "conv_id long, conv_vol_idx long, conv_utt_idx long")
    got = values(prepare.index_utterances(rows), "conv_id", "conv_vol_idx", "conv_utt_idx", "corp_conv_idx", "corp_vol_idx", "corp_utt_idx")
    volleys = sorted({g[:2] for g in got})
    assert [g[5] for g in got] == list(range(10)) and [g[3] for g in got] == [[3, 5, 9].index(g[0]) for g in got]
    assert [g[4] for g in got] == [volleys.index(g[:2]) for g in got]


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=57).round(1), rng.normal(size=57)
    rows = frame(spark, [(float(a), None if i % 5 == 0 else float(b)) for i, (a, b) in enumerate(zip(x, y))], "x double, y double")
    got = {r["metric"]: r for r in order.percentiles(rows, ["x", "y"], {"a": 0.25, "b": 0.5, "c": 0.95}).collect()}
    kept = np.array([b for i, b in enumerate(y) if i % 5])
    for name, v in (("x", x), ("y", kept)):
        assert [got[name][c] for c in "abc"] == pytest.approx([np.quantile(v, p) for p in (0.25, 0.5, 0.95)])


@pytest.mark.parametrize("alpha, n", [(0.1, 9000), (0.5, 3000)])
def test_momentum_of_long_sessions(spark, alpha, n):
    rng = np.random.default_rng(3)
    codes = [None if x == 3 else "CSN"[x] for x in rng.choice(4, n, p=[0.1, 0.1, 0.7, 0.1])]
    got = [r["momentum"] for r in trajectory.momentum(frame(spark, [(1, i, c) for i, c in enumerate(codes)], "conv_id long, conv_utt_idx long, code string"), "code", alpha).orderBy("conv_utt_idx").collect()]
    want, m = [], 0.0
    for i, c in enumerate(codes):
        m = 0.0 if i == 0 else m if c is None else m + alpha if c == "C" else m - alpha if c == "S" else m * (1 - alpha)
        want.append(m)
    assert got == pytest.approx(want, abs=1e-9)


def test_warping_equals_the_plain_recurrence():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (1, 7), (9, 4), (20, 20)):
        a, b = rng.normal(size=n), rng.normal(size=m)
        cost = np.full((n + 1, m + 1), np.inf)
        cost[0, 0] = 0
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                cost[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1])
        distance, path = dtw.dtw(a, b)
        assert distance == pytest.approx(np.sqrt(cost[n, m])) and sum((a[i] - b[j]) ** 2 for i, j in path) == pytest.approx(cost[n, m])
        assert path[0] == (0, 0) and path[-1] == (n - 1, m - 1)


def test_many_series_warp_as_one_by_one():
    rng = np.random.default_rng(6)
    centre, rows = rng.normal(size=8), rng.integers(0, 3, (30, 11)).astype(float)
    distances, sums, counts = dtw.dtw_many(centre, rows)
    for r in range(30):
        distance, path = dtw.dtw(centre, rows[r])
        assert distances[r] == pytest.approx(distance)
        assert counts[r].sum() >= 11 and sum(rows[r][j] for _, j in path) == pytest.approx(sums[r].sum()) and len(path) == counts[r].sum()


def test_session_metrics_count_the_second_tier_alone(spark):
    rows = [(1, "counsellor", "UNKNOWN", "SR"), (1, "client", "Q", "OQ"), (1, "client", "C", "ADW"), (1, "client", "S", "N")]
    r = sessions.session_metrics(frame(spark, rows, "conv_id long, speaker string, t1 string, t2 string")).first()
    assert (r["n_r"], r["n_q"], r["n_mico"], r["n_miin"], r["n_c"], r["n_s"]) == (1, 1, 2, 1, 1, 1)


def test_crosswalk_goes_by_speaker(spark):
    rows = [("client", "GI"), ("client", "SR"), ("client", "C"), ("Therapist", "C"), ("therapist", "['SR', 'OQ']"), ("system", "S")]
    got = rollup.crosswalk(frame(spark, rows, "speaker string, label string"), "label").collect()
    assert [(r["t1_label"], r["t2_label"]) for r in got] == [(None, None), (None, None), ("C", None), (None, None), ("SRL", "SR"), ("S", None)]


def test_evaluations_are_known_by_name(spark):
    assert list(experiments.evaluate(["a"], {"a": lambda: 1, "b": lambda: 2})) == ["a"]
    with pytest.raises(ValueError):
        experiments.evaluate(["c"], {"a": lambda: 1})


def test_folds_and_splits(spark):
    rows = frame(spark, [(i % 13, i) for i in range(100)], "conv_id int, k int")
    folds = splits.conversation_folds(rows, 5)
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert folds.count() == 13 and max(sizes) - min(sizes) <= 1
    parts = splits.fold_rows(rows, folds, 0)
    assert parts.count() == 100 and parts.groupBy("conv_id").agg(F.countDistinct("part").alias("n")).filter("n > 1").count() == 0
    assert splits.train_valid(rows, ["k"], 0.1).filter("part = 'valid'").count() == 10
    assert splits.train_valid(rows, ["k"], 0.001).filter("part = 'valid'").count() == 0
    with pytest.raises(ValueError):
        splits.leave_dataset_out(rows.withColumn("dataset", F.lit("a")), ["a"], "a")


def test_interpolation_and_resampling(spark):
    rows = frame(spark, [(1, 0, None), (1, 1, 1.0), (1, 2, None), (1, 3, 3.0), (1, 4, None)], "conv_id int, i int, v double")
    assert [r["v"] for r in trajectory.fill_linear(rows, "i", "v").orderBy("i").collect()] == [1, 1, 2, 3, 3]
    points = frame(spark, [(1, 20.0, 2.0), (1, 80.0, 8.0)], "conv_id int, progress double, score double")
    assert [r["y"] for r in trajectory.resample(points, 5).orderBy("k").collect()] == pytest.approx([2, 2.5, 5, 7.5, 8])


def test_splines_sum_to_one():
    b = learn.spline_basis(np.array([0.0, 33.0, 100.0]))
    assert b.shape == (3, 10) and np.allclose(b.sum(1), 1)


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 4)), rng.normal(size=60)
    model = learn.ridge(frame(spark, [(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").withColumnRenamed("x", "f"), "f", "y")
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(model.coefficients.toArray(), np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ yc), atol=1e-8)


def test_experiments(spark, tmp_path):
    c = experiments.Config.from_dict({"parser": "p", "annotators": ["a", "b"]})
    assert c.parsers == ["p"] and not c.problems() and experiments.Config(context_mode="x").problems()
    grid = experiments.grid(spark, c)
    assert grid.count() == 2 and grid.select("experiment_id").distinct().count() == 2
    ids = [r["experiment_id"] for r in grid.collect()]

    def run(e):
        if e["experiment_id"] == ids[1]:
            raise RuntimeError("no model")
        return 1

    got = experiments.run_all([r.asDict() for r in grid.collect()], set(), run)
    assert got[ids[0]]["success"] and not got[ids[1]]["success"]
    experiments.save_checkpoint(str(tmp_path / "c.json"), c, ids[:1])
    assert experiments.load_checkpoint(str(tmp_path / "c.json")) == set(ids[:1]) and experiments.load_checkpoint(str(tmp_path / "none")) == set()


def test_recorded_scores_are_reproduced(spark):
    """A recorded evaluation of 300 rows over 36 codes: two codes predicted, all others missed."""
    rows = [("N", "N")] * 126 + [("FI", "FI")] * 35 + [("OQ", "N")] * 16 + [("CR", "FI")] * 123
    s = metrics.summary(frame(spark, rows, "gold string, said string"), "gold", "said", vocabulary("t2")).first()
    assert (round(s["accuracy"], 4), round(s["f1_macro"], 6), round(s["f1_weighted"], 6)) == (0.5367, 0.036194, 0.43724)
    families = {"neutral": ["N"], "utility": ["FI"], "questions": ["OQ", "CQ"]}
    got = {r["family"]: r for r in metrics.family_recall(frame(spark, rows, "gold string, said string"), "gold", "said", families).collect()}
    assert got["neutral"]["recall"] == got["utility"]["recall"] == 1 and got["questions"]["recall"] == 0
    assert round(got["neutral"]["precision"], 2) == 0.89 and round(got["utility"]["precision"], 2) == 0.22
