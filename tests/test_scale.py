"""Least squares, momentum and context where offsets, small weights or long conversations used to spoil or slow them."""

import os
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from parley.operators import context, dtw, factors, learn, order, reports, trajectory
from parley.plans import analysis, fixtures
from parley.vocab import SCALES
from pyspark.sql import functions as F

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def direct_r2(x, y):
    x = x - x.mean(axis=0)
    norms = np.sqrt((x * x).sum(axis=0))
    x, y = x / np.where(norms > 0, norms, 1), y - y[0]
    y = y - y.mean()
    return 1 - ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum() / (y @ y)


@pytest.mark.parametrize("shift", [0.0, 1.7e9])
def test_regression_of_shifted_outcomes_and_nearly_dependent_columns(spark, shift):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(2000, 3))
    x = np.column_stack([base, base[:, 0] + 1e-6 * rng.normal(size=2000)]) + [1e3, -5, 0, 7]
    y = base @ [1, 2, -1] + 2 * rng.normal(size=2000) + shift
    rows = spark.createDataFrame([(4, a.tolist(), float(b)) for a, b in zip(x, y)], "k int, x array<double>, y double").repartition(9)
    got = learn.sweep(rows.unionByName(spark.createDataFrame([(4, [1.0, None, 2.0, 3.0], 1.0), (4, [1.0] * 4, float("nan"))], rows.schema)), [4]).first()
    assert got["n"] == 2000 and got["r2"] == pytest.approx(direct_r2(x, y), abs=1e-9)


def test_coefficients_rank_and_penalty(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) + [1e6, 0, 0]
    y = x @ [2.0, -1.0, 0.0] + 5 + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([([*map(float, a), float(a[1])], float(b)) for a, b in zip(x, y)], "f array<double>, y double")
    found = factors.fitted(df, "f", "y")
    assert found.rank == 3 and found.coefficients[1] == pytest.approx(found.coefficients[3])
    predicted = [r[0] for r in df.select(found.predict(F.col("f"))).collect()]
    z = np.column_stack([np.ones(300), x - [1e6, 0, 0]])
    assert predicted == pytest.approx(z @ np.linalg.lstsq(z, y, rcond=None)[0], abs=1e-6)
    centred, alpha = x - x.mean(axis=0), 7.0
    want = np.linalg.solve(centred.T @ centred + alpha * np.eye(3), centred.T @ (y - y.mean()))
    ridge = learn.ridge(df.select(F.slice("f", 1, 3).alias("f"), "y"), "f", "y", alpha)
    assert ridge.coefficients.toArray() == pytest.approx(want, rel=1e-9)
    assert (ridge.intercept + x @ ridge.coefficients.toArray()).mean() == pytest.approx(y.mean())


def test_factors_merge_to_the_factor_of_all_rows():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(500, 6)) * [1, 1e4, 1, 1, 1e-3, 1] + 1e8
    parts = factors.Factor.all([factors.Factor.of(z[a:b]) for a, b in ((0, 1), (1, 3), (3, 200), (200, 500))])
    whole = factors.Factor.of(z)
    assert parts.n == 500 and parts.solve().r2 == pytest.approx(whole.solve().r2, abs=1e-10)
    assert parts.solve().r2 == pytest.approx(direct_r2(z[:, :5], z[:, 5]), abs=1e-9)


def _direct(rows, k):
    kept = [r for r in rows if r["y"] is not None and None not in r["x"]]
    x, y = np.array([r["x"] for r in kept], float).reshape(len(kept), k), np.array([r["y"] for r in kept], float)
    return len(kept), direct_r2(x, y) if len(kept) > k + 1 and y.var() else None


@pytest.mark.parametrize("name", ["grid_regression_sweep", "segment_regression_sweep"])
@pytest.mark.parametrize("shift", [0.0, 1.7e9])
def test_sweep_queries_against_direct_least_squares(spark, monkeypatch, name, shift):
    seen, sweep = {}, learn.sweep

    def watched(rows, settings):
        rows = rows.withColumn("y", F.col("y") + shift)
        for r in rows.collect():
            seen.setdefault(r["k"], []).append(r)
        return sweep(rows, settings)

    monkeypatch.setattr(analysis.learn, "sweep", watched)
    sf = SF.replace("sf0.001", "sf0.01")
    for r in analysis.QUERIES[name](spark, sf).collect():
        n, r2 = _direct(seen.get(r["k"], []), r["k"])
        if r2 is not None and r["k"] < 25:  # beyond that many columns some are dependent, and how many is a matter of tolerance
            assert r["n"] == n and r["r2"] == pytest.approx(r2, abs=1e-8)


@pytest.mark.parametrize("alpha", [1e-12, 0.0005, 0.001, 0.1, 0.999999, 1.0])
def test_momentum_forgets_nothing(spark, alpha):
    rng = np.random.default_rng(3)
    codes = ["N", "C", *rng.choice(["C", "S", "N", None], size=9998, p=[0.002, 0.001, 0.927, 0.07])]
    got = trajectory.momentum(spark.createDataFrame([(1, i, c) for i, c in enumerate(codes)], "conv_id long, conv_utt_idx long, code string"), "code", alpha)
    m, want = 0.0, []
    for i, c in enumerate(codes):
        if i and c:
            m = m + alpha if c == "C" else m - alpha if c == "S" else m * (1 - alpha)
        want.append(m)
    assert [r["momentum"] for r in got.orderBy("conv_utt_idx").collect()] == pytest.approx(want, rel=1e-9, abs=1e-12)


def plain_context(rows, at, mode, before):
    """Lines of (utt, vol, speaker, text) rows by their definition."""
    if mode == "interval":
        rows = [r for r in rows if rows[at][1] - before <= r[1] <= rows[at][1] and r[0] <= rows[at][0]]
    elif mode == "cumulative":
        rows = rows[: at + 1]
    lines = []
    for _, _, who, text in rows:
        if lines and lines[-1][0] == who:
            lines[-1][1].append(text)
        else:
            lines.append((who, [text]))
    return "\n".join(f"{who}: {' '.join(parts)}" for who, parts in lines)


def test_context_by_its_definition(spark):
    rng, rows = np.random.default_rng(4), []
    for c in range(12):
        vol = 0
        for u in range(int(rng.integers(1, 25))):
            vol += int(rng.choice([0, 0, 1, 2]))
            rows.append((c, u, vol, str(rng.choice(["client", "counsellor"])), str(rng.choice(["é", "naïve word", "", "😀", "x y"])), "kept"))
    df = spark.createDataFrame(rows, "conv_id long, conv_utt_idx long, conv_vol_idx long, speaker string, utt_text string, other string")
    for mode, before in (("interval", 0), ("interval", 1), ("interval", 3), ("cumulative", 3), ("all", 3)):
        got = {(r["conv_id"], r["conv_utt_idx"]): r["context"] for r in context.with_context(df, mode, before).collect()}
        for c in range(12):
            own = [r[1:5] for r in rows if r[0] == c]
            assert [got[c, u] for u in range(len(own))] == [plain_context(own, u, mode, before) for u in range(len(own))]
    assert context.with_context(df, "all").columns == [*df.columns, "context"]


def test_context_of_a_long_conversation(spark):
    n = 100_000
    turn = F.floor(F.col("id") / 4)
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("conv_utt_idx"), turn.alias("conv_vol_idx"), F.when(turn % 3 == 0, "a").otherwise("b").alias("speaker"), F.concat(F.lit("utterance é "), "id").alias("utt_text"))
    got = context.with_context(rows).agg(F.count("*").alias("n"), F.max(F.length("context")).alias("longest")).first()
    assert got["n"] == n and 250 < got["longest"] < 350


def test_sums_inside_groups_of_any_size(spark):
    rows = [(g, i, i % 5) for g, n in ((None, 7), (1, 3000), (2, 1), (3, 40), (4, 900)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int, v int").repartition(5)
    got = order.running_by(df, ["g"], ["i"], {"before": F.col("v").cast("long"), "rank": F.lit(1).cast("long")})
    want, sums = {}, {}
    for g, i, v in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        want[g, i] = (sums.get(g, 0), i)
        sums[g] = sums.get(g, 0) + v
    assert {(r["g"], r["i"]): (r["before"], r["rank"]) for r in got.collect()} == want


def test_alignment_by_halves_is_the_full_table_s():
    rng = np.random.default_rng(5)
    for t in range(150):
        a, b = (np.round(rng.normal(size=int(n)), 0 if t % 3 == 0 else 9) for n in rng.integers(1, 40, 2))
        want, _ = dtw.dtw(a, b)
        for cells in (4, 30, 100):
            got, path = dtw.dtw(a, b, cells)
            assert got == pytest.approx(want) and sum((a[i] - b[j]) ** 2 for i, j in path) ** 0.5 == pytest.approx(want)
            assert path[0] == (0, 0) and path[-1] == (len(a) - 1, len(b) - 1)
            assert all((i - x, j - y) in ((0, 1), (1, 0), (1, 1)) for (x, y), (i, j) in zip(path, path[1:]))
        many = dtw.dtw_many(a, b[None, :], 3)
        assert many[0][0] == pytest.approx(want) and many[1].sum() == pytest.approx(sum(b[j] for _, j in dtw.dtw(a, b, 3)[1]))
        assert dtw.least_distances(a, b[None, :])[0] <= want + 1e-12


def test_rows_aligned_side_by_side_are_aligned_as_alone():
    rng = np.random.default_rng(8)
    for t in range(12):
        n, m = rng.integers(1, 40, 2)
        centres, rows = np.round(rng.normal(size=(3, n)), t % 3), np.round(rng.normal(size=(50, m)), t % 3)
        alone = [[dtw.dtw(c, r) for r in rows] for c in centres]
        for c, own in zip(centres, alone):
            distances, sums, counts = dtw.dtw_many(c, rows)
            assert distances.tolist() == [d for d, _ in own]
            for r, (_, path) in enumerate(own):
                assert [(i, j) for i, j in zip(sums[r], counts[r])] == [(sum(rows[r][j] for i, j in path[::-1] if i == x), sum(i == x for i, _ in path)) for x in range(n)]
            limit = distances * rng.choice([0.9, 1.0, 1.1], 50)
            found = dtw.distances_many(c, rows, limit)  # what is left out lies above its limit
            assert ((found == distances) | (np.isinf(found) & (distances > limit))).all() and (found == distances)[distances <= limit].all()
        best, distance, sums, counts, _ = dtw.nearest(list(centres), rows)
        want = np.array([[d for d, _ in own] for own in alone])
        assert best.tolist() == want.argmin(axis=0).tolist() and distance.tolist() == want.min(axis=0).tolist()
        assert all((sums[r] == dtw.dtw_many(centres[c], rows[r : r + 1])[1][0]).all() for r, c in enumerate(best))


def test_a_round_of_clustering_brings_few_rows_from_its_tasks():
    run, shape = dtw._totals([np.zeros(5), np.ones(5)])
    rows = [[0.1] * 5, [0.9] * 5, [1.1] * 5]
    got = pd.concat(run([pd.DataFrame({"values": rows * 100, "who": range(300)})]))
    assert got["cluster"].tolist() == [0, 1] and np.stack(got["sums"].tolist()) == pytest.approx(np.array([[10.0] * 5, [200.0] * 5]))


def test_alignment_of_long_sessions_needs_little_memory():
    rng = np.random.default_rng(6)
    a, b = np.cumsum(rng.normal(size=9000)), np.cumsum(rng.normal(size=9000))
    tracemalloc.start()
    distance, path = dtw.dtw(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and distance == pytest.approx(dtw.edge_costs(a, b)[-1] ** 0.5) and distance == pytest.approx(sum((a[i] - b[j]) ** 2 for i, j in path) ** 0.5)


def test_bounds_spare_centres_and_change_nothing(spark):
    rng = np.random.default_rng(7)
    centres = [np.full(12, v) + rng.normal(size=12) * 0.1 for v in (-3.0, 0.0, 0.0, 4.0)]
    rows = rng.choice([-3.0, 0.0, 4.0], 60)[:, None] + rng.normal(size=(60, 9)) * 0.3
    best, distance, _, _, aligned = dtw.nearest(centres, rows)
    want = np.array([[dtw.dtw(c, r)[0] for c in centres] for r in rows])
    assert best.tolist() == want.argmin(axis=1).tolist() and distance == pytest.approx(want.min(axis=1))
    assert aligned.min() == 1 and aligned.mean() < 2.5
    sessions = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "conv_id long, values array<double>")
    report = dtw.cluster_report(dtw.cluster(sessions, 3), 3).collect()
    assert sum(r["n"] for r in report) == 60 and any(r["spared"] > 0 for r in report)


def test_pair_query_by_the_plain_recurrence(spark):
    """Whole sessions on the three-step scale, gaps filled, each with the next one by id."""
    got = {(r["id_1"], r["id_2"]): r["distance"] for r in analysis.QUERIES["dtw_pairs"](spark, SF).collect()}
    by = {}
    for r in fixtures.coded(spark, SF).collect():
        by.setdefault(r["conv_id"], []).append((r["conv_utt_idx"], SCALES["motiv7"].get(r["t2_auto"])))
    series = {}
    for c, rows in by.items():
        values = [v for _, v in sorted(rows)]
        known = [i for i, v in enumerate(values) if v is not None]
        if known:
            series[c] = np.interp(np.arange(len(values)), known, [values[i] for i in known])
    pairs = [(c, c + 1) for c in series if c + 1 in series]
    assert sorted(got) == sorted(pairs)
    for x, y in pairs[:8]:
        a, b = series[x], series[y]
        cost = np.full((len(a) + 1, len(b) + 1), np.inf)
        cost[0, 0] = 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                cost[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1])
        assert got[x, y] == pytest.approx(cost[-1, -1] ** 0.5)


def test_reports_are_written_by_group(spark, tmp_path):
    rows = spark.createDataFrame([("client", "C", "C", "C+", "C+"), ("client", "S", "C", "C-", "C+"), ("counsellor", "Q", "Q", "OQ", "CQ"), ("counsellor", "C", "Q", None, "CQ")], "speaker string, t1_gold string, t1_auto string, t2_gold string, t2_auto string")
    tables = reports.agreement_tables(rows, {"t1": ("t1_gold", "t1_auto"), "t2": ("t2_gold", "t2_auto")})
    n = {(r["tier"], r["speaker"]): r["n"] for r in tables["kappa"].collect()}
    assert n == {("t1", "client"): 2, ("t1", "counsellor"): 1, ("t1", "all"): 3, ("t2", "client"): 2, ("t2", "counsellor"): 1, ("t2", "all"): 3}
    reports.write_tables(tables, str(tmp_path))
    back = spark.read.csv(f"{tmp_path}/classes/tier=t1/speaker=client", header=True, inferSchema=True)
    assert {r["label"]: r["support"] for r in back.collect()} == {"C": 1, "S": 1, "N": 0}


def test_outcome_tables_are_written(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, float(a), float(b), float(a + c) if i else None) for i, (a, b, c) in enumerate(rng.normal(size=(40, 3)))], "conv_id long, a double, b double, y double")
    tables = reports.outcome_tables(rows, ["a", "b"], "y")
    reports.write_outcome_tables(tables, str(tmp_path))
    back = {n: spark.read.csv(f"{tmp_path}/{n}", header=True, inferSchema=True).toPandas() for n in tables}
    assert len(back["agg"]) == 40 and len(back["loocv"]) == 78 and sorted(back["correlation"]["metric"]) == ["a", "b"]
    kept = np.array([[r["a"], r["y"]] for r in rows.filter("y IS NOT NULL").orderBy("conv_id").collect()])
    by_hand = [np.polyval(np.polyfit(*np.delete(kept, i, 0).T, 1), kept[i, 0]) for i in range(39)]
    got = back["loocv"][back["loocv"]["metric"] == "a"].sort_values("conv_id")["predicted"].to_numpy()
    assert got == pytest.approx(by_hand)
    line = back["correlation"].set_index("metric").loc["a"]
    assert line["r"] == pytest.approx(np.corrcoef(kept.T)[0, 1]) and line["p_value"] < 0.05 and -1 <= line["rank_r"] <= 1
