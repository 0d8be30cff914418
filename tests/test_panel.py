"""Panel operators on a planted panel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmesh import cli
from signalmesh import queries as registered
from signalmesh.functions.columns import at_lag, avg_rank, interpolated, safe_corr
from signalmesh.operators import cluster_methods, holdout, ic, linear, multiplicity, shapes, trees
from signalmesh.operators.composite import DedupComposite
from signalmesh.operators.cv import cross_validate, paired_against
from signalmesh.operators.gate import GateDecision, fit_selected
from signalmesh.plans.panel import SignalPanel, complete_cases, reflected
from signalmesh.sources.panels import class_paths, load_class, synthetic


@pytest.fixture(scope="module")
def frame(spark):
    return synthetic(spark, 140, 40, (4, 3, 1), (0.05, 0.05, 0.05), 0.5, reversed_variants=(1, 5), seed=1).persist()


@pytest.fixture(scope="module")
def panel(frame):
    return SignalPanel.of(frame)


def test_alignment_finds_planted_reversals(panel):
    a = panel.aligned()
    assert set(a.reflected) in ({"f2", "f6"}, set(panel.features) - {"f2", "f6"})
    assert a.aligned().reflected == a.reflected
    assert a.subset([0, 1]).reflected == tuple(c for c in a.reflected if c in ("f1", "f2"))


def test_moments_equal_rows(panel):
    pdf = panel.df.toPandas()
    days = np.zeros(panel.n_days, bool)
    days[10:60] = True
    x = pdf[pdf["date"].isin(panel.dates[days])][panel.features]
    m = panel.moments(days)
    assert m.n == len(x) and m.sd() == pytest.approx(x.std(ddof=0).to_numpy())
    assert m.correlation() == pytest.approx(np.corrcoef(x.T))


def test_sql_and_arrow_scoring_agree(panel):
    w = np.random.default_rng(1).normal(size=panel.p)
    sql = {r["date"]: r["ic"] for r in ic.daily_ic(panel.signal(w)).collect()}
    assert panel.ic_of(w)[:, 0] == pytest.approx([sql[d] for d in panel.dates], abs=1e-9)


def test_every_method_gives_a_finite_vector(panel):
    days = panel.all_days
    for name, fn in (linear.METHODS | cluster_methods.METHODS).items():
        w = fn(panel, days)
        assert w.shape == (panel.p,) and np.isfinite(w).all(), name
    assert np.isfinite(cluster_methods.eb_within(panel, days)[0]).all()
    single = cluster_methods.cluster_signal(panel, days, rho=0.9999)
    z = linear.signs(panel.mean_ic(days)) / panel.moments().sd()
    assert single / np.linalg.norm(single) == pytest.approx(z / np.linalg.norm(z))


def test_cross_validation_and_pairs(panel):
    rows, series = cross_validate(panel, {"naive_averaged": linear.naive_averaged, "cluster_eq": cluster_methods.cluster_eq})
    assert {r["method"] for r in rows} == {"naive_averaged", "cluster_eq"} and rows[0]["cv_mean_ic"] >= rows[1]["cv_mean_ic"]
    assert paired_against(series, "naive_averaged")[0]["vs"] == "naive_averaged"


def test_composite_round_trip_and_errors(panel, tmp_path):
    comp = DedupComposite().fit(panel)
    comp.save(str(tmp_path / "c.json"))
    again = DedupComposite.load(str(tmp_path / "c.json"))
    a, b = (sorted(map(tuple, c.transform_panel(panel).select("date", "identifier", "s").limit(50).collect())) for c in (comp, again))
    assert a == b and len(comp.blocks()) == comp.diagnostics["n_blocks"] and "block 1" in comp.describe()
    with pytest.raises(ValueError):
        comp.transform_panel(panel.subset([0, 1]))
    with pytest.raises(RuntimeError):
        DedupComposite().transform(panel.df)


def test_gate_is_coherent(panel):
    comp, d = fit_selected(panel, n_stumps=20, min_rows=50)
    assert d.adopt_shapes == (d.pass_a and d.pass_b) and comp.shapes == d.adopt_shapes and "shapes" in str(d)


def test_trees_score_as_mllib_does(panel):
    from pyspark.ml.feature import VectorAssembler

    model = trees._model(panel.df, panel.features, 12, 100, 0)
    got = trees._scores(panel.df, panel.features, model, [1, 12])
    want = model.transform(VectorAssembler(inputCols=panel.features, outputCol="_x").transform(panel.df))
    both = got.join(want.select("date", "identifier", "prediction"), ["date", "identifier"]).toPandas()
    assert len(both) == panel.df.count() and both["s_12"].to_numpy() == pytest.approx(both["prediction"].to_numpy(), abs=1e-12)
    assert both["s_1"].nunique() == 8 < both["s_12"].nunique()


def test_tree_signal_chooses_by_inner_days(panel):
    out, best = trees.tree_signal(panel, panel.all_days, (2, 6, 12), 100)
    assert best in (2, 6, 12) and out.count() == panel.df.count() and out.columns == ["date", "identifier", "target", "s"]
    assert ic.daily_ic(out).agg(F.avg("ic")).first()[0] > 0


def test_tree_query_is_the_whole_grid(panel, monkeypatch):
    asked = []
    monkeypatch.setattr(registered, "panel", lambda *_: panel)
    monkeypatch.setattr(trees, "_model", lambda rows, features, n, min_rows, seed, fit=trees._model: asked.append((n, min_rows)) or fit(rows, features, 2, min_rows, seed))
    registered.queries()["tree_signal"](None, "")
    assert asked[0] == (600, 1000) and trees.ROUNDS == (25, 50, 100, 150, 200, 300, 400, 600)


def test_shape_queries_have_the_whole_fit(spark, panel, monkeypatch):
    fits = []
    boost = shapes.boost_stumps
    monkeypatch.setattr(shapes, "boost_stumps", lambda joint, sums, mean, p, rounds, min_rows, seed: fits.append((rounds, min_rows)) or boost(joint, sums, mean, p, rounds, min_rows, seed))
    monkeypatch.setattr(registered, "panel", lambda *_: panel)
    monkeypatch.setattr(registered, "supplier_panel", lambda *_: panel.df)
    assert registered.queries()["shape_gate"](spark, "").count() == 1
    assert registered.queries()["stump_shapes"](spark, "").count() == 400 * panel.p
    assert len(fits) > 2 and set(fits) == {(600, 1000)}


def test_range_lag_equals_shift_join(panel):
    s = panel.df.select("date", "identifier", F.col("f1").alias("s"), "target")
    a = {(r[0], r[1]): r[2] for r in s.withColumn("l", at_lag("s", 5)).select("date", "identifier", "l").where("l is not null").collect()}
    b = s.select((F.col("date") + 5).alias("date"), "identifier", F.col("s").alias("l"))
    assert a == {(r[0], r[1]): r[2] for r in b.join(s.select("date", "identifier"), ["date", "identifier"]).collect()}


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 1.0), (1, 1.0), (2, None)], "date long, x double")
    assert sorted((r[0], r[1]) for r in df.select("date", avg_rank("x", ["date"])).collect() if r[1]) == [(1, 1.5), (1, 1.5), (1, 3.0)]
    assert df.where("x = 1").agg(safe_corr("x", "x")).first()[0] is None
    assert df.limit(1).select(interpolated(F.lit(5.0), [0.0, 1.0])).first()[0] == 1.0
    holes = spark.createDataFrame([(1, "a", 0.5, None), (1, "b", float("nan"), 1.0), (1, "c", 0.25, 2.0)], "date long, identifier string, f1 double, target double")
    assert [r["identifier"] for r in complete_cases(holes, ["f1"]).collect()] == ["c"]
    assert complete_cases(holes, ["f1"], strict_nulls=True).count() == 2
    assert reflected(holes, ["f1", "zz"], ["f1"]).where("identifier = 'c'").first()["f1"] == 0.75


def test_curves(spark):
    half = lambda v: ic.half_life(spark.createDataFrame(list(enumerate(v)), "lag int, value double")).first()[0]
    assert half([1.0, 0.75, 0.5, 0.25]) == pytest.approx(2.0)
    assert half([1.0, 0.8, 0.4]) == pytest.approx(1.75)
    assert half([1.0, 0.9, 0.8]) is None
    roll = ic.rolling_mean_ic(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 4.0), (5, 5.0)], "date long, ic double"), 2)
    assert [r[1] for r in roll.orderBy("date").collect()] == [None, 1.5, 2.0, 4.0, 4.5]


def test_bootstrap_is_calibrated(spark):
    rng = np.random.default_rng(5)
    tests = [("c", f"m{k}", rng.normal(size=300)) for k in range(4)]
    table, bar = multiplicity.multiplicity_table(spark, tests, 20, 100)
    assert 1.5 < bar < 5 and table["p_wy"].between(0, 1).all() and table["p"].is_monotonic_increasing


def test_multiplicity_query_is_the_whole_family(spark, panel, monkeypatch):
    drawn, bootstrap = [], multiplicity.westfall_young
    monkeypatch.setattr(multiplicity, "westfall_young", lambda spark, diffs, t, block, n_boot, seed: drawn.append(n_boot) or bootstrap(spark, diffs, t, block, n_boot, seed))
    monkeypatch.setattr(registered, "panel", lambda *_: panel)
    rows = registered.queries()["multiplicity_table"](spark, "").toPandas()
    assert drawn == [4000] and set(rows["method"]) == set(panel.features) - {"f3"}


def test_constant_differences_are_defined(spark):
    same, always = np.zeros(120), np.full(120, 0.25)
    table, bar = multiplicity.multiplicity_table(spark, [("c", "same", same), ("c", "always", always), ("c", "noise", np.random.default_rng(3).normal(size=120))], 20, 100)
    by = table.set_index("method")
    assert by.loc["same", ["diff", "t", "p", "p_holm", "p_bh", "p_wy"]].tolist() == [0, 0, 1, 1, 1, 1]
    assert by.loc["always", ["p", "p_holm", "p_bh", "p_wy"]].tolist() == [0, 0, 0, 0] and np.isfinite(by.loc["always", "t"]) and np.isfinite(bar)


def test_files_stream_and_demo(spark, frame, panel, tmp_path):
    for path, cols in zip(class_paths(str(tmp_path), 1), (["date", "identifier", *panel.features], ["date", "identifier", "target"]), strict=True):
        frame.select(cols).write.parquet(path)
    assert load_class(spark, str(tmp_path), 1).count() == frame.count()
    comp = DedupComposite().fit(panel)
    frame.write.parquet(str(tmp_path / "in"))
    from signalmesh.streaming.scorer import score_stream

    q = score_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), comp).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").where("s is not null").count() == frame.count()
    assert any("composite" in x for x in cli.demo(spark, 150, 30))


def test_study_scores_the_hold_out_once(spark, frame, tmp_path):
    features = [c for c in frame.columns if c.startswith("f")]
    for split, rows in (("in_sample", frame.where("date < 1090")), ("out_of_sample", frame.where("date >= 1111"))):
        for path, cols in zip(class_paths(str(tmp_path), 1, split), (features, ["target"]), strict=True):
            rows.select("date", "identifier", *cols).write.parquet(path)
    cli.study(spark, str(tmp_path), [1], str(tmp_path / "out"), skip_cv=True)
    held = spark.read.csv(str(tmp_path / "out/holdout_c1"), header=True, inferSchema=True).toPandas().set_index("method")
    assert list(held.columns) == list(holdout.COLUMNS) and list(held.index) == ["naive_averaged", "ic_weight", "pca_pc1", "cluster_eq", "cluster_eb"]
    train = cli.open_panel(spark, str(tmp_path), 1)
    test = cli.open_panel(spark, str(tmp_path), 1, ",".join(train.reflected), "out_of_sample")
    for m in holdout.VECTORS:
        assert held.loc[m, "mean_ic"] == pytest.approx(np.nanmean(test.ic_of(linear.METHODS[m](train, train.all_days))), abs=1e-6)
    assert held.loc["cluster_eb", "mean_ic"] == pytest.approx(np.nanmean(DedupComposite(block_weights="eb").fit(train).day_ics(test)), abs=1e-6)
    assert "hold-out" in (tmp_path / "out/summary.md").read_text() and (tmp_path / "out/diagnostics_c1.txt").exists() and (tmp_path / "out/pls_sweep_c1").is_dir()


def test_shaped_arms_share_one_fit(panel, monkeypatch):
    fits, fit = [], shapes.fit_stump_shapes
    monkeypatch.setattr(shapes, "fit_stump_shapes", lambda *a: fits.append(a) or fit(*a))
    for adopted, chosen in ((True, "cluster_eb_shaped"), (False, "cluster_eq")):
        arms = holdout.frozen_arms(panel, GateDecision(adopted, 0, 0, adopted, 0, 0, 0, 0, adopted), n_stumps=5, min_rows=50)
        assert arms["selected (gated)"] is arms[chosen] and {"cluster_eq_shaped", "cluster_eb"} <= set(arms)
    assert len(fits) == 2
    with pytest.raises(ValueError):
        arms["ic_weight"](panel.subset([0, 1]))


def test_composite_of_a_matrix_and_other_weights(panel):
    comp = DedupComposite().fit(panel)
    rows = comp(panel.df).limit(200).toPandas()
    assert comp(rows[panel.features].to_numpy()) == pytest.approx(rows["s"].to_numpy())
    assert comp.reweighted("eb").weights == pytest.approx(DedupComposite(block_weights="eb").fit(panel).weights)
    with pytest.raises(ValueError):
        comp(np.zeros((3, 1)))


def test_registered_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "ic_summary" in e.queries()


def test_alignment_only_where_it_raises_the_coherence(panel, monkeypatch):
    from signalmesh.operators import clustering

    monkeypatch.setattr(clustering, "orientation_flips", lambda corr, names: list(names[:1]))
    monkeypatch.setattr(clustering, "orientation_is_artifact", lambda corr: False)
    assert panel.aligned() is panel
    monkeypatch.setattr(clustering, "orientation_is_artifact", lambda corr: True)
    assert panel.aligned().reflected != panel.reflected


def test_spectral_hac_is_the_sum_over_lags():
    from signalmesh.functions.numeric import newey_west

    rng = np.random.default_rng(4)
    for n in (8, 60, 300):
        d = rng.normal(0.1, 1, (n, 5)).cumsum(0) * 0.1 + 0.3
        for lags in (0, 5, 25):
            assert multiplicity.hac_t_columns(d, lags) == pytest.approx([newey_west(d[:, k], min(lags, n - 1) if lags < n else lags)[1] for k in range(5)], rel=1e-8)
    series, starts = rng.normal(size=(70, 3)), rng.integers(0, 70, (20, 4))
    one = [max(abs(newey_west(series[[(s + k) % 70 for s in row for k in range(20)][:70], c], 9)[1]) for c in range(3)) for row in starts]
    assert multiplicity.resampled_tops(series, starts, 20, 9) == pytest.approx(one, rel=1e-8)


def test_notes_follow_the_facts():
    from signalmesh.operators import diagnostics

    facts = diagnostics.Facts(0.5, 2, (0.1, 0.4), True, 2, 1, 3, 0.7)
    told = diagnostics.notes_of(facts)
    assert [t.split()[0] for t in told] == ["One", "2", "A", "Estimators", "Selected:"] and "reflect them" in told[1]
    facts.artifact, facts.best_k, facts.pc1, facts.heterogeneous = False, None, 0.4, 3
    assert [t.split()[0] for t in diagnostics.notes_of(facts)] == ["Between", "2", "Blocks", "Selected:"] and "leave them" in diagnostics.notes_of(facts)[1]
