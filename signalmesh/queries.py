"""Registered queries of the panel operators and the SQL that states what they compute, on the derived supplier panel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import avg_rank, interpolated, r6
from .operators import cluster_methods, clustering, cv, holdout, ic, linear, multiplicity, shapes, shrinkage, trees
from .operators.composite import DedupComposite
from .operators.diagnostics import diagnose
from .operators.gate import gate_decision
from .plans.panel import SignalPanel, calendar, complete_cases, reflected
from .sources.panels import supplier_panel, synthetic, user_panel

FEATURES = [f"f{k}" for k in range(1, 9)]
LABELS = (1, 1, 1, 1, 2, 3, 4, 5)
HORIZON, FOLDS = 21, 5


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_panel(spark, sf_dir).repartition("date")


def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("date", "identifier", F.col("f3").alias("s"), "target")


def holed(df: DataFrame) -> DataFrame:
    """The panel with missing values planted by key."""
    return df.withColumns({
        "f3": F.when(F.col("identifier") % 17 != 0, F.col("f3")),
        "f4": F.when(F.col("identifier") % 19 == 0, F.lit(float("nan"))).otherwise(F.col("f4")),
        "target": F.when(F.col("date") % 23 != 0, F.col("target")),
    })


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in names})


def roles(df: DataFrame) -> DataFrame:
    return cv.fold_roles(calendar(df), FOLDS, HORIZON, HORIZON)


def pseudo_p(df: DataFrame) -> DataFrame:
    return ic.hac(ic.feature_ic(df, FEATURES), by=["feature"]).select(F.col("feature").alias("id"), F.round(F.exp(-F.abs("t")), 8).alias("p"))


def number(x: float) -> float | None:
    """Six digits; an undefined value is NULL."""
    return None if np.isnan(x) else round(float(x), 6) + 0.0


def of_panel(schema: str, rows: Callable) -> Callable:
    """A query whose rows a library operator makes of the whole panel."""
    return lambda spark, sf_dir: spark.createDataFrame([tuple(r) for r in rows(panel(spark, sf_dir))], schema)


SIMPLE = {m: linear.METHODS[m] for m in ("naive_averaged", "ic_weight")}


def days_of(p: SignalPanel, ics: np.ndarray):
    return zip(p.dates.tolist(), map(number, ics), strict=True)


def out_of_fold(method: str) -> Callable:
    """(fold, date, ic) of the tested days of an out-of-fold run."""

    def rows(p: SignalPanel):
        _, series = cv.oof_run(p, SIMPLE[method])
        return [(f, int(p.dates[d]), number(series[d])) for f, _, test in p.folds() for d in np.flatnonzero(test)]

    return of_panel("fold int, date long, ic double", rows)


def summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    _, series = cv.oof_run(p, SIMPLE["naive_averaged"])
    rows = [(d, None if np.isnan(x) else float(x)) for d, x in zip(p.dates.tolist(), series, strict=True)]
    return rounded(ic.summary(spark.createDataFrame(rows, "date long, ic double")), "mean_ic", "ic_ir", "nw_t", "hit_rate")


def fold_rows(p: SignalPanel):
    for f, train, _ in p.folds():
        m = p.moments(train)
        yield from ((f, c, int(m.n), number(mean), number(sd)) for c, mean, sd in zip(p.features, m.mean, m.sd(), strict=False))


def pair_rows(p: SignalPanel):
    c = p.moments().correlation()
    return [(f"{a}_{b}", number(c[i, i + 1 + j])) for i, a in enumerate(p.features) for j, b in enumerate(p.features[i + 1 :])]


def paired_rows(p: SignalPanel):
    _, series = cv.cross_validate(p, SIMPLE)
    return [(r["method"], number(r["ic_diff"]), number(r["nw_t"])) for r in cv.paired_against(series, "naive_averaged")]


def given_blocks(p: SignalPanel) -> cluster_methods.Blocks:
    return cluster_methods.blocks(p, p.all_days, labels=LABELS)


def member_rows(p: SignalPanel):
    w = given_blocks(p).members
    return [(f, label, number(w[i, label - 1])) for i, (f, label) in enumerate(zip(p.features, LABELS, strict=True))]


def side_rows(p: SignalPanel):
    w = shrinkage.equal_block_weights(given_blocks(p).ic)
    return [(k, float(np.sign(x))) for k, x in enumerate(w, 1)]


def effects(p: SignalPanel) -> tuple[np.ndarray, np.ndarray]:
    """Absolute mean IC and HAC error of each feature."""
    e, s = linear.feature_effects(p, p.all_days)
    return np.abs(e), s


CURVES = [[(i / 399) ** 2 - 0.3 * (i / 399) for i in range(400)], [np.cos(i / 50) for i in range(400)]]


def two_features(fit: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = SignalPanel.of(supplier_panel(spark, sf_dir).select("date", "identifier", "f1", "f6", "target"))
        return spark.createDataFrame([(f, round(float(x), 6) + 0.0) for f, x in zip(p.features, fit(p), strict=True)], "feature string, w double")

    return run


def panel(spark: SparkSession, sf_dir: str) -> SignalPanel:
    return SignalPanel.of(supplier_panel(spark, sf_dir), name="suppliers")


def vectors(methods: dict) -> Callable:
    """(method, feature, w) of methods fitted on all days."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = panel(spark, sf_dir)
        rows = [(m, f, float(x)) for m, fn in methods.items() for f, x in zip(p.features, np.ravel(fn(p, p.all_days)), strict=True)]
        return spark.createDataFrame(rows, "method string, feature string, w double")

    return run


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, feature, label) of every partition rule."""
    p = panel(spark, sf_dir)
    c = p.moments().correlation()
    found = {"cut": clustering.cluster_labels(c), "divisive": clustering.divisive_labels(c, 4), "profile": clustering.ic_profile_labels(p.feature_ic, 4), "random": clustering.random_labels(p.p, 4, 7)}
    found |= {m: clustering.hier_labels_k(c, 4, m) for m in clustering.LINKAGES}
    return spark.createDataFrame([(k, f, int(x)) for k, v in found.items() for f, x in zip(p.features, v, strict=True)], "kind string, feature string, label int")


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, value): between-variance estimates and the pooled interval of the feature effects."""
    p = panel(spark, sf_dir)
    e, s = linear.feature_effects(p, p.all_days)
    e, t = np.abs(e), {f.__name__: f(np.abs(e), s) for f in (shrinkage.tau2_dl, shrinkage.tau2_pm, shrinkage.tau2_reml)}
    t |= dict(zip(("pooled", "low", "high"), shrinkage.hartung_knapp_interval(e, s, t["tau2_dl"]), strict=True))
    return spark.createDataFrame([(k, float(v)) for k, v in t.items()], "name string, value double")


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    rows, _ = cv.cross_validate(p, linear.METHODS | cluster_methods.METHODS)
    return spark.createDataFrame([tuple(r.values()) for r in rows], "method string, cv_mean_ic double, cv_ic_std double, worst_fold double")


def multiplicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    tests = [("suppliers", f, p.feature_ic[:, j] - p.feature_ic[:, 2]) for j, f in enumerate(p.features) if f != "f3"]
    return spark.createDataFrame(multiplicity.multiplicity_table(spark, tests)[0])


def composite_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).aligned()
    return DedupComposite().fit(p).transform_panel(p)


def gate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = gate_decision(panel(spark, sf_dir))
    return spark.createDataFrame([(d.adopt_shapes, float(d.oof_diff), float(d.oof_t), d.pass_a, d.pass_b)], "adopt_shapes boolean, oof_diff double, oof_t double, pass_a boolean, pass_b boolean")


#: The first date behind the training days of the hold-out query.
CUT = 110


def holdout_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_panel(spark, sf_dir)
    train, test = (SignalPanel.of(rows.where(days)) for days in (f"date < {CUT}", f"date >= {CUT + HORIZON}"))
    table = holdout.holdout_table({m: holdout.vector_arm(train, fn) for m, fn in SIMPLE.items()}, test)
    return rounded(table.select("method", "n_days", "mean_ic", "nw_t", "ic_ir_ann"), "mean_ic", "nw_t", "ic_ir_ann")


def report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(line,) for line in diagnose(panel(spark, sf_dir)).render().split("\n")], "line string")


def shapes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = shapes.fit_stump_shapes(supplier_panel(spark, sf_dir), FEATURES)
    return spark.createDataFrame([(f, k, float(v)) for f, row in zip(FEATURES, table, strict=True) for k, v in enumerate(row)], "feature string, k int, value double")


def tree_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    return trees.tree_signal(p, p.all_days)[0].select("date", "identifier", "s")


def pls_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = linear.pls_sweep(panel(spark, sf_dir))
    return spark.createDataFrame(list(zip(s["k"], s["mean"], s["std"], strict=True)), "k int, mean double, std double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    over = lambda fn: lambda spark, d: fn(base(spark, d))
    one = lambda fn: lambda spark, d: fn(f3(spark, d))
    feature_hac = lambda df: ic.hac(ic.feature_ic(df, FEATURES), by=["feature"])
    first_half = lambda df: calendar(df).where("day_idx < 89")
    feature_daily = lambda df, f: ic.feature_ic(df, [f])
    keys = ["date", "identifier"]
    return {
        "panel_complete_case": over(lambda df: rounded(complete_cases(holed(df), FEATURES), *FEATURES).withColumn("target", F.round("target", 3))),
        "panel_reflect": over(lambda df: rounded(reflected(df, ["f5", "absent"], FEATURES), *FEATURES).withColumn("target", F.round("target", 3))),
        "panel_users": lambda spark, d: rounded(user_panel(spark, d), *FEATURES),
        "calendar_day_idx": over(calendar),
        "target_rank": over(lambda df: df.select(*keys, avg_rank("target", ["date"]).alias("target_rank"))),
        "rank_by_day": over(lambda df: df.select(*keys, avg_rank("f3", ["date"]).alias("f3_rank"))),
        "daily_rank_ic": one(lambda df: rounded(ic.daily_ic(df), "ic")),
        "feature_ic": over(lambda df: rounded(ic.feature_ic(df, FEATURES), "ic")),
        "feature_ic_mean": of_panel("feature string, mean_ic double", lambda p: zip(p.features, map(number, p.mean_ic(p.all_days)), strict=True)),
        "ic_summary": summary_query,
        "newey_west": over(lambda df: feature_hac(df).select("feature", "n", r6("mean").alias("mean"), r6("t").alias("t"))),
        "hac_se": over(lambda df: feature_hac(df).select("feature", r6("se").alias("se"))),
        "paired_newey_west": over(lambda df: ic.paired(feature_daily(df, "f3").select("date", "ic"), feature_daily(df, "f6")).select("n", r6("mean").alias("mean"), r6("t").alias("t"))),
        "decay_curve": one(lambda df: rounded(ic.decay_curve(df), "value")),
        "autocorr_curve": one(lambda df: rounded(ic.autocorr_curve(df), "value")),
        "half_life": one(lambda df: rounded(ic.half_life(ic.autocorr_curve(df)), "half_life")),
        "tradeability": one(lambda df: rounded(ic.tradeability(df), "half_life", "ret_5d", "turn_l1", "turn_l5")),
        "weekly_ic_series": one(lambda df: rounded(ic.weekly_ic(df), "ic")),
        "weekly_score": one(lambda df: rounded(ic.weekly_score(df, first_half(df)), "score")),
        "portfolio_ir": one(lambda df: rounded(ic.portfolio_ir(df), "port_ir")),
        "rolling_mean_ic": one(lambda df: rounded(ic.rolling_mean_ic(ic.daily_ic(df), 26), "value")),
        "quantile_bucket": one(lambda df: ic.quantile_bucket(df, 5)),
        "purged_kfold": over(roles),
        "inner_split": over(lambda df: cv.inner_roles(roles(df), HORIZON)),
        "fold_moments": of_panel("fold int, feature string, n long, mean double, sd double", fold_rows),
        "feature_correlation": of_panel("pair string, corr double", pair_rows),
        "coherence": of_panel("coherence double", lambda p: [(number(clustering.coherence(p.moments().correlation())),)]),
        "naive_averaged_full": of_panel("date long, ic double", lambda p: days_of(p, p.ic_of(linear.naive_averaged(p, p.all_days))[:, 0])),
        "naive_averaged_oof": out_of_fold("naive_averaged"),
        "ic_weight_oof": out_of_fold("ic_weight"),
        "cv_table_simple": of_panel("method string, cv_mean_ic double, cv_ic_std double, worst_fold double", lambda p: [(m, *map(number, x)) for m, *x in (r.values() for r in cv.cross_validate(p, SIMPLE)[0])]),
        "paired_against_simple": of_panel("method string, ic_diff double, nw_t double", paired_rows),
        "block_matrix": of_panel("feature string, label long, w double", member_rows),
        "block_signal": of_panel("label long, mean_ic double, se double", lambda p: ((k, number(x), number(y)) for b in [given_blocks(p)] for k, (x, y) in enumerate(zip(b.ic, b.se, strict=True), 1))),
        "cluster_eq_given_labels": of_panel("date long, ic double", lambda p: days_of(p, p.ic_of(cluster_methods.cluster_signal(p, p.all_days, labels=LABELS))[:, 0])),
        "tau2_dl": of_panel("tau2 double", lambda p: [(round(shrinkage.tau2_dl(*effects(p)), 9),)]),
        "dl_shrink": of_panel("feature string, shrunk double", lambda p: zip(p.features, map(number, shrinkage.dl_shrink(*effects(p))[0]), strict=True)),
        "shrink_with_tau2": of_panel("feature string, shrunk double", lambda p: zip(p.features, map(number, shrinkage.shrink_with_tau2(*effects(p), 1e-4)), strict=True)),
        "equal_block_weights": of_panel("label long, w double", side_rows),
        "holm": over(lambda df: rounded(multiplicity.adjusted(pseudo_p(df)).select("id", "p_holm"), "p_holm")),
        "benjamini_hochberg": over(lambda df: rounded(multiplicity.adjusted(pseudo_p(df)).select("id", "p_bh"), "p_bh")),
        "apply_shapes": over(lambda df: df.select(*keys, r6(interpolated(F.col("f1"), CURVES[0])).alias("x1"), r6(interpolated(F.col("f6"), CURVES[1])).alias("x6"))),
        "shape_response_split": lambda spark, d: spark.createDataFrame([tuple(round(x, 6) for x in shapes.shape_response_split(np.array(CURVES)))], "low double, mid double, high double"),
        "score_signal": one(lambda df: rounded(ic.scorecard(df), "mean_ic", "ic_ir_ann", "hit_rate", "nw_t", "port_ir_ann", "half_life", "ret_5d", "turn_l5")),
        "ridge_2feature": two_features(lambda p: linear.ridge(p, p.all_days, 0.1)),
        "uniqueness_2feature": two_features(lambda p: linear.uniqueness_reg(p, p.all_days, 0.1)),
        "ols_2feature": two_features(lambda p: linear.ols(p, p.all_days)),
        "linear_methods": vectors(linear.METHODS),
        "cluster_methods": vectors(cluster_methods.METHODS | {"eb_within": lambda p, d: cluster_methods.eb_within(p, d)[0], "eb_flat": cluster_methods.eb_flat}),
        "partitions": partitions,
        "pooled_effects": pooled,
        "cv_table": compared,
        "pls_sweep": pls_query,
        "multiplicity_table": multiplicity_query,
        "stump_shapes": shapes_query,
        "tree_signal": tree_query,
        "dedup_composite": composite_query,
        "shape_gate": gate_query,
        "holdout_simple": holdout_query,
        "report_card": report_query,
        "synthetic_panel": lambda spark, d: synthetic(spark, 60, 20, (2, 1), horizon=5),
    }


# --------------------------------------------------------------------------- SQL
_PANEL = """
base as (
  select cast(floor(datediff('day', date '1995-01-01', cast(l_shipdate as date)) / 14.0) as bigint) as date, l_suppkey as identifier,
         sum(l_quantity) a1, cast(count(*) as double) a2, round(sum(l_extendedprice), 4) a3, round(sum(l_extendedprice * (1 - l_discount)), 4) a4,
         round(avg(l_extendedprice), 6) a5, max(l_extendedprice) a6, round(avg(l_discount), 10) a7, round(avg(l_tax), 10) a8
  from lineitem group by 1, 2),
ahead as (select *, lead(a4) over (partition by identifier order by date) as fwd from base),
wide as (select date, identifier, {features}, round(fwd - avg(fwd) over (partition by date), 6) as target from ahead),
panel as materialized (select * from wide where target is not null),
cal as (select date, row_number() over (order by date) - 1 as day_idx from (select distinct date from panel)),
long as ({long}),
""".format(
    features=", ".join(f"{'1 - ' if k == 5 else ''}percent_rank() over (partition by date order by a{k}) as f{k}" for k in range(1, 9)),
    long=" union all ".join(f"select date, identifier, '{f}' as feature, {f} as s, target from panel" for f in FEATURES),
)


def _corr(a: str, b: str) -> str:
    return f"(case when isnan(corr({a}, {b})) then null else corr({a}, {b}) end)"


def _rank(x: str, by: str) -> str:
    return f"(rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0e0)"


def _ic(source: str, by: str = "") -> str:
    k = f"{by}, date" if by else "date"
    return f"(select {k}, {_corr('r', 'q')} as ic from (select {k}, {_rank('s', k)} as r, {_rank('target', k)} as q from (select {k}, round(s, 12) as s, target from {source})) group by {k})"


def _hac(source: str, by: str = "") -> str:
    """(by, n, mean, se, t) of ic by the definition: a self-join on positions."""
    k, on, g = (f"{by}, ", f"a.{by} = b.{by} and ", f"a.{by}, ") if by else ("", "", "")
    part = f"partition by {by}" if by else ""
    return f"""(with x as (select {k}ic - avg(ic) over ({part}) as d, row_number() over ({part} order by date) as pos from {source} where ic is not null),
  m as (select {k}count(*) as n, avg(ic) as mean from {source} where ic is not null {f'group by {by}' if by else ''}),
  c as (select {g}sum(case when b.pos = a.pos then 1.0e0 else 2.0e0 * (1.0e0 - (b.pos - a.pos) / 26.0e0) end * a.d * b.d) as v
        from x a join x b on {on}b.pos between a.pos and a.pos + 25 {f'group by a.{by}' if by else ''})
  select {f'm.{by}, ' if by else ''}n, mean, sqrt(greatest(v / n, 1e-18) / n) as se, case when n > 1 then mean / sqrt(greatest(v / n, 1e-18) / n) end as t from m {f'join c on c.{by} = m.{by}' if by else ', c'})"""


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0e0"


_FIC = f"fic as materialized (select * from {_ic('long', 'feature')})"
_F3 = "f3 as (select date, identifier, f3 as s, target from panel)"
_ROLES = """roles as (select fold, date, day_idx, case when day_idx >= a and day_idx < b then 'test' when day_idx < a - 21 or day_idx >= b + 21 then 'train' else 'purged' end as role
  from (select fold, date, day_idx, fold * n // 5 as a, (fold + 1) * n // 5 as b from (select *, count(*) over () as n from cal), (select unnest(range(5))::int as fold)))"""
_SIGN = "case when round({}, 10) >= 0 then 1.0e0 else -1.0e0 end"
_SUM = " + ".join(f"w{k} * f{k}" for k in range(1, 9))
_WIDE = ", ".join(f"max(case when feature = 'f{k}' then w end) as w{k}" for k in range(1, 9))
_FOLDIC = "foldic as (select fold, feature, avg(ic) as ic from fic join roles using (date) where role = 'train' group by 1, 2)"
_FOLDSD = "foldsd as (select fold, feature, count(*) as n, avg(s) as mean, stddev_pop(s) as sd from long join roles using (date) where role = 'train' group by 1, 2)"
_NAIVE = f"nw as (select fold, {_WIDE} from (select fold, feature, ({_SIGN.format('ic')}) / 8.0e0 as w from foldic) group by 1), noof as materialized (select * from {_ic(f'(select fold, date, {_SUM} as s, target from panel join roles using (date) join nw using (fold) where role = ' + chr(39) + 'test' + chr(39) + ')', 'fold')})"
_ICW = f"iw as (select fold, {_WIDE} from (select fold, feature, ic / sqrt(sum(ic * ic) over (partition by fold)) / sd as w from foldic join foldsd using (fold, feature)) group by 1), ioof as materialized (select * from {_ic(f'(select fold, date, {_SUM} as s, target from panel join roles using (date) join iw using (fold) where role = ' + chr(39) + 'test' + chr(39) + ')', 'fold')})"
_OOF = f"{_FIC}, {_ROLES}, {_FOLDIC}, {_FOLDSD}, {_NAIVE}, {_ICW}"
_HELD = f"""{_FIC}, tic as (select feature, avg(ic) as ic from fic where date < {CUT} group by 1), tsd as (select feature, stddev_pop(s) as sd from long where date < {CUT} group by 1),
hw as (select 'naive_averaged' as method, {_WIDE} from (select feature, ({_SIGN.format('ic')}) / 8.0e0 as w from tic) union all select 'ic_weight', {_WIDE} from (select feature, ic / sqrt(sum(ic * ic) over ()) / sd as w from tic join tsd using (feature))),
hic as materialized (select * from {_ic(f'(select method, date, {_SUM} as s, target from panel, hw where date >= {CUT + HORIZON})', 'method')})"""
_LAGGED = "lagged as (select t.date, l.lag, s.s, t.target from f3 t, (select unnest(range(22)) as lag) l, f3 s where s.identifier = t.identifier and s.date = t.date - l.lag)"
_LIC = f"{_F3}, {_LAGGED}, lic as materialized (select * from {_ic('lagged', 'lag')}), decay as (select lag::int as lag, avg(ic) as value from lic group by 1)"
_AUTO = f"""auto as (select 0 as lag, 1.0e0 as value union all select lag::int, avg(c) from (select l.lag, t.date, {_corr('s.s', 't.s')} as c
  from f3 t, (select unnest(range(1, 11)) as lag) l, f3 s where s.identifier = t.identifier and s.date = t.date - l.lag group by 1, 2) group by 1)"""
_HALF = "(select min(lag) as lag from {c} where lag > 0 and value <= (select value / 2 from {c} where lag = 0))"
_HALFLIFE = "(select case when k.lag is not null then k.lag - 1 + (p.value - z.value / 2) / (p.value - v.value) end as half_life from " + _HALF + " k left join {c} v on v.lag = k.lag left join {c} p on p.lag = k.lag - 1, (select value from {c} where lag = 0) z)"
_PORT = f"(select avg(ret) / stddev_samp(ret) * sqrt(252.0e0) as port_ir from (select date, case when sum(abs(z)) > 0 then sum(z * target) / sum(abs(z)) end as ret from (select date, target, r - avg(r) over (partition by date) as z from (select date, target, {_rank('s', 'date')} as r from (select date, target, round(s, 12) as s from f3))) group by 1))"
_LABEL = "(list_value(1, 1, 1, 1, 2, 3, 4, 5))[cast(feature[2:2] as int)]"
_BLOCKS = f"""mic as (select feature, avg(ic) as ic from fic group by 1), sds as (select feature, stddev_pop(s) as sd from long group by 1),
members as (select feature, label, sg / count(*) over (partition by label) as w from (select feature, {_LABEL} as label, {_SIGN.format('ic')} as sg from mic)),
bw as (select label, {', '.join(f"coalesce(max(case when feature = 'f{k}' then w / sd end), 0) as w{k}" for k in range(1, 9))} from members join sds using (feature) group by 1),
bic as materialized (select * from {_ic(f'(select label, date, {_SUM} as s, target from panel, bw)', 'label')})"""
_EFFECTS = f"h as materialized (select * from {_hac('fic', 'feature')}), eff as (select feature, abs(mean) as e, se, 1 / (se * se) as w from h), pool as (select sum(w) as sw, sum(w * w) as sw2, count(*) as k, sum(w * e) / sum(w) as mu from eff), tau as (select greatest(0.0e0, (sum(w * (e - mu) * (e - mu)) - (max(k) - 1)) / (max(sw) - max(sw2) / max(sw))) as tau2 from eff, pool)"
_PAIRS = " union all ".join(f"select '{a}_{b}' as pair, {_corr(a, b)} as corr from panel" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :])
_ALL = ", ".join(f"{_r(f)} as {f}" for f in FEATURES)
_TWO = """two as (select n, s1, s6, sy, c16 / (s1 * s6) as rho, c1y / s1 as g1, c6y / s6 as g6 from (select count(*) as n, stddev_pop(f1) as s1, stddev_pop(f6) as s6, stddev_pop(target) as sy,
  covar_pop(f1, f6) as c16, covar_pop(f1, target) as c1y, covar_pop(f6, target) as c6y from panel))"""


def _solve(lam: str, g1: str = "g1", g6: str = "g6") -> str:
    det = f"((1 + {lam}) * (1 + {lam}) - rho * rho)"
    return f"((1 + {lam}) * {g1} - rho * {g6}) / {det} as u1, ((1 + {lam}) * {g6} - rho * {g1}) / {det} as u6"


def _shape(x: str, value: str) -> str:
    at = f"least(greatest(({x} - 0.001e0) / (0.998e0 / 399), 0.0e0), 399.0e0)"
    low = f"least(floor({at}), 398.0e0)"
    f = lambda i: "(" + value.replace("i", f"({i})") + ")"
    return f"{f(low)} + ({f(f'{low} + 1')} - {f(low)}) * ({at} - {low})"


_G1, _G2 = "(i / 399.0e0) * (i / 399.0e0) - 0.3e0 * (i / 399.0e0)", "cos(i / 50.0e0)"


def oracle_sql() -> dict[str, str]:
    q = lambda ctes, body: f"with {_PANEL.strip().rstrip(',')}{', ' + ctes if ctes else ''} {body}"
    holed = "(select date, identifier, f1, f2, case when identifier % 17 <> 0 then f3 end as f3, case when identifier % 19 = 0 then 'nan'::double else f4 end as f4, f5, f6, f7, f8, case when date % 23 <> 0 then target end as target from panel)"
    return {
        "panel_complete_case": q("", f"select date, identifier, {_ALL}, round(target, 3) as target from {holed} where f3 is not null and not isnan(f4) and target is not null"),
        "panel_reflect": q("", f"select date, identifier, {', '.join((_r('1 - f5') if f == 'f5' else _r(f)) + f' as {f}' for f in FEATURES)}, round(target, 3) as target from panel"),
        "panel_users": """with base as (select datediff('day', date '2024-01-01', cast(ts as date))::bigint as date, user_id as identifier, count(*)::double a1, round(sum(value), 4) a2, max(value) a3, round(avg(value), 6) a4,
  count(*) filter (event_type = 'click')::double a5, count(*) filter (event_type = 'view')::double a6, count(*) filter (event_type = 'purchase')::double a7, count(*) filter (event_type = 'error')::double a8 from events group by 1, 2),
ahead as (select *, lead(a2) over (partition by identifier order by date) as fwd from base),
wide as (select date, identifier, """ + ", ".join(f"round(percent_rank() over (partition by date order by a{k}), 6) + 0.0e0 as f{k}" for k in range(1, 9)) + """, round(fwd - avg(fwd) over (partition by date), 6) as target from ahead)
select * from wide where target is not null""",
        "calendar_day_idx": q("", "select date, day_idx from cal"),
        "target_rank": q("", f"select date, identifier, {_rank('target', 'date')} as target_rank from panel"),
        "rank_by_day": q("", f"select date, identifier, {_rank('f3', 'date')} as f3_rank from panel"),
        "daily_rank_ic": q(_F3, f"select date, {_r('ic')} as ic from {_ic('f3')}"),
        "feature_ic": q(_FIC, f"select feature, date, {_r('ic')} as ic from fic"),
        "feature_ic_mean": q(_FIC, f"select feature, {_r('avg(ic)')} as mean_ic from fic group by 1"),
        "ic_summary": q(_OOF, f"select {_r('avg(ic)')} as mean_ic, {_r('avg(ic) / stddev_pop(ic)')} as ic_ir, {_r('max(t)')} as nw_t, {_r('avg(case when round(ic, 10) > 0 then 1.0e0 else 0.0e0 end)')} as hit_rate, count(ic) as n_days from noof, {_hac('noof')}"),
        "newey_west": q(_FIC, f"select feature, n, {_r('mean')} as mean, {_r('t')} as t from {_hac('fic', 'feature')}"),
        "hac_se": q(_FIC, f"select feature, {_r('se')} as se from {_hac('fic', 'feature')}"),
        "paired_newey_west": q(f"{_FIC}, d as (select a.date, a.ic - b.ic as ic from fic a join fic b using (date) where a.feature = 'f3' and b.feature = 'f6')", f"select n, {_r('mean')} as mean, {_r('t')} as t from {_hac('d')}"),
        "decay_curve": q(_LIC, f"select lag, {_r('value')} as value from decay"),
        "autocorr_curve": q(f"{_F3}, {_AUTO}", f"select lag, {_r('value')} as value from auto"),
        "half_life": q(f"{_F3}, {_AUTO}", f"select {_r('half_life')} as half_life from {_HALFLIFE.format(c='auto')}"),
        "tradeability": q(f"{_LIC}, {_AUTO}", f"select {_r('half_life')} as half_life, {_r('(select value from decay where lag = 5) / (select value from decay where lag = 0)')} as ret_5d, {_r('1 - (select value from auto where lag = 1)')} as turn_l1, {_r('1 - (select value from auto where lag = 5)')} as turn_l5 from {_HALFLIFE.format(c='decay')}"),
        "weekly_ic_series": q(_LIC, f"select a.date, {_r('case when a.ic is null then b.ic when b.ic is null then a.ic else (a.ic + b.ic) / 2 end')} as ic from lic a join lic b using (date) where a.lag = 0 and b.lag = 5"),
        "weekly_score": q(_LIC, f"select {_r('avg(m)')} as score from (select lag, avg(ic) as m from lic join cal using (date) where lag in (0, 5) and day_idx < 89 group by 1)"),
        "portfolio_ir": q(_F3, f"select {_r('port_ir')} as port_ir from {_PORT}"),
        "rolling_mean_ic": q(_F3, f"select date, {_r('case when row_number() over (order by date) >= 26 then avg(ic) over (order by date rows between 25 preceding and current row) end')} as value from {_ic('f3')}"),
        "quantile_bucket": q(_F3, "select date, identifier, cast(floor((row_number() over (partition by date order by s, identifier) - 1) * 5 / count(*) over (partition by date)) as bigint) as bucket from f3"),
        "purged_kfold": q(_ROLES, "select fold, date, day_idx, role from roles"),
        "inner_split": q(f"{_ROLES}, tr as (select *, row_number() over (partition by fold order by day_idx) - 1 as k, count(*) over (partition by fold) as m from roles where role = 'train'), cut as (select fold, day_idx as c from tr where k = floor(m * 0.75e0))", "select fold, date, day_idx, case when day_idx > c then 'inner_val' when day_idx <= c - 21 then 'inner_train' else 'inner_purged' end as role from tr join cut using (fold)"),
        "fold_moments": q(f"{_ROLES}, {_FOLDSD}", f"select fold, feature, n, {_r('mean')} as mean, {_r('sd')} as sd from foldsd"),
        "feature_correlation": q("", f"select pair, {_r('corr')} as corr from ({_PAIRS})"),
        "coherence": q("", f"select {_r('avg(corr)')} as coherence from ({_PAIRS})"),
        "naive_averaged_full": q(f"{_FIC}, w as (select {_WIDE} from (select feature, ({_SIGN.format('avg(ic)')}) / 8.0e0 as w from fic group by 1))", f"select date, {_r('ic')} as ic from {_ic(f'(select date, {_SUM} as s, target from panel, w)')}"),
        "naive_averaged_oof": q(_OOF, f"select fold, date, {_r('ic')} as ic from noof"),
        "ic_weight_oof": q(_OOF, f"select fold, date, {_r('ic')} as ic from ioof"),
        "cv_table_simple": q(_OOF, f"select method, {_r('avg(m)')} as cv_mean_ic, {_r('stddev_samp(m)')} as cv_ic_std, {_r('min(m)')} as worst_fold from (select 'naive_averaged' as method, fold, avg(ic) as m from noof group by fold union all select 'ic_weight', fold, avg(ic) from ioof group by fold) group by 1"),
        "paired_against_simple": q(f"{_OOF}, d as (select date, i.ic - n.ic as ic from ioof i join noof n using (date))", f"select 'ic_weight' as method, {_r('mean')} as ic_diff, {_r('t')} as nw_t from {_hac('d')}"),
        "block_matrix": q(f"{_FIC}, {_BLOCKS}", f"select feature, cast(label as bigint) as label, {_r('w')} as w from members"),
        "block_signal": q(f"{_FIC}, {_BLOCKS}", f"select cast(label as bigint) as label, {_r('mean')} as mean_ic, {_r('se')} as se from {_hac('bic', 'label')}"),
        "cluster_eq_given_labels": q(f"{_FIC}, {_BLOCKS}, side as (select label, ({_SIGN.format('avg(ic)')}) / sqrt(5.0e0) as b from bic group by 1), cw as (select {_WIDE} from (select feature, w * b / sd as w from members join side using (label) join sds using (feature)))", f"select date, {_r('ic')} as ic from {_ic(f'(select date, {_SUM} as s, target from panel, cw)')}"),
        "tau2_dl": q(f"{_FIC}, {_EFFECTS}", "select round(tau2, 9) as tau2 from tau"),
        "dl_shrink": q(f"{_FIC}, {_EFFECTS}, m as (select sum(e / (se * se + tau2)) / sum(1 / (se * se + tau2)) as mu from eff, tau)", f"select feature, {_r('mu + tau2 / (tau2 + se * se) * (e - mu)')} as shrunk from eff, tau, m"),
        "shrink_with_tau2": q(f"{_FIC}, {_EFFECTS}, m as (select sum(e / (se * se + 1e-4)) / sum(1 / (se * se + 1e-4)) as mu from eff)", f"select feature, {_r('mu + 1e-4 / (1e-4 + se * se) * (e - mu)')} as shrunk from eff, m"),
        "equal_block_weights": q(f"{_FIC}, {_BLOCKS}", f"select cast(label as bigint) as label, {_SIGN.format('avg(ic)')} as w from bic group by 1"),
        "holm": q(f"{_FIC}, p as (select feature as id, round(exp(-abs(t)), 8) as p from {_hac('fic', 'feature')}), o as (select *, row_number() over (order by p, id) as r, count(*) over () as m from p)", f"select id, {_r('least(1.0e0, max((m - r + 1) * p) over (order by r))')} as p_holm from o"),
        "benjamini_hochberg": q(f"{_FIC}, p as (select feature as id, round(exp(-abs(t)), 8) as p from {_hac('fic', 'feature')}), o as (select *, row_number() over (order by p, id) as r, count(*) over () as m from p)", f"select id, {_r('least(1.0e0, min(p * m / r) over (order by r desc))')} as p_bh from o"),
        "apply_shapes": q("", f"select date, identifier, {_r(_shape('f1', _G1.replace('0.3e0', '0.3e0')))} as x1, {_r(_shape('f6', 'COS(i / 50.0e0)'))} as x6 from panel"),
        "shape_response_split": f"with g as (select i, abs({_G1.replace('i /', '(i + 1) /')} - ({_G1})) + abs(cos((i + 1) / 50.0e0) - cos(i / 50.0e0)) as m from (select unnest(range(399)) as i)) select round(sum(m) filter (i < 133) / sum(m), 6) as low, round(sum(m) filter (i >= 133 and i < 266) / sum(m), 6) as mid, round(sum(m) filter (i >= 266) / sum(m), 6) as high from g",
        "score_signal": q(f"{_LIC}, {_AUTO}, d as materialized (select * from {_ic('f3')})", f"select {_r('avg(ic)')} as mean_ic, {_r('avg(ic) / stddev_samp(ic) * sqrt(252.0e0)')} as ic_ir_ann, {_r('avg(case when round(ic, 10) > 0 then 1.0e0 else 0.0e0 end)')} as hit_rate, count(ic) as n_days, {_r('max(t)')} as nw_t, {_r('max(port_ir)')} as port_ir_ann, {_r('max(half_life)')} as half_life, {_r('(select value from decay where lag = 5) / (select value from decay where lag = 0)')} as ret_5d, {_r('1 - (select value from auto where lag = 5)')} as turn_l5 from d, {_hac('d')}, {_PORT}, {_HALFLIFE.format(c='decay')} where ic is not null"),
        "holdout_simple": q(_HELD, f"select method, count(ic) as n_days, {_r('avg(ic)')} as mean_ic, {_r('max(t)')} as nw_t, {_r('avg(ic) / stddev_samp(ic) * sqrt(252.0e0)')} as ic_ir_ann from hic join {_hac('hic', 'method')} h using (method) group by 1"),
        "ridge_2feature": q(f"{_TWO}, sol as (select s1, s6, {_solve('0.1e0')} from two)", f"select 'f1' as feature, {_r('u1 / s1')} as w from sol union all select 'f6', {_r('u6 / s6')} from sol"),
        "uniqueness_2feature": q(f"{_FIC}, {_TWO}, m as (select avg(ic) filter (feature = 'f1') as i1, avg(ic) filter (feature = 'f6') as i6 from fic), sol as (select s1, s6, {_solve('0.1e0', 'i1', 'i6')} from two, m)", f"select 'f1' as feature, {_r('u1 / sqrt(u1 * u1 + u6 * u6) / s1')} as w from sol union all select 'f6', {_r('u6 / sqrt(u1 * u1 + u6 * u6) / s6')} from sol"),
        "ols_2feature": q(f"{_TWO}, sol as (select s1, s6, {_solve('0.0e0')} from two)", f"select 'f1' as feature, {_r('u1 / s1')} as w from sol union all select 'f6', {_r('u6 / s6')} from sol"),
    }
