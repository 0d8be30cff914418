"""Command line: diagnose, compare, freeze, demo; `study` writes the tables of several classes."""

from __future__ import annotations

import argparse
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from .operators import cluster_methods, linear
from .operators.composite import DedupComposite
from .operators.cv import cross_validate, paired_against
from .operators.diagnostics import diagnose
from .operators.gate import gate_decision
from .operators.holdout import COLUMNS, frozen_arms, holdout_table
from .operators.ic import scorecard
from .plans.panel import SignalPanel
from .session import session
from .sources.panels import load_class, synthetic, write_csv

QUICK = ("naive_averaged", "ic_weight", "pca_pc1", "uniqueness_reg", "eb_weight", "cluster_eq", "cluster_eb")
SLOW = ("uniqueness_tuned", "ridge_tuned", "pls_tuned", "cluster_eq_tuned", "cluster_ic_tuned")


def methods(slow: bool = False) -> dict:
    known = linear.METHODS | cluster_methods.METHODS
    return {m: known[m] for m in QUICK + SLOW * slow}


def open_panel(spark: SparkSession, data_dir: str, number: int, reflect: str = "auto", split: str = "in_sample") -> SignalPanel:
    names = [] if reflect in ("auto", "") else reflect.split(",")
    panel = SignalPanel.of(load_class(spark, data_dir, number, split), reflect=names, name=f"class {number} {split}")
    return panel.aligned() if reflect == "auto" else panel


def shown(rows: list[dict]) -> str:
    return "\n".join("  ".join(f"{k} {v:+.4f}" if isinstance(v, float) else f"{v:<20}" for k, v in r.items()) for r in rows)


def holdout_lines(panel: SignalPanel, comp: DedupComposite) -> list[str]:
    """Scorecards of the composite and of the rank average with the training signs."""
    out = []
    for name, df in (("composite", comp.transform_panel(panel)), ("rank average", panel.signal(np.asarray(comp.signs) / panel.p))):
        m = scorecard(df).first().asDict()
        out.append(f"{name:14s} " + ", ".join(f"{k} {m[k]:+.4f}" if m[k] is not None else f"{k} -" for k in ("mean_ic", "nw_t", "ret_5d", "turn_l5")))
    return out


def demo(spark: SparkSession, n_days: int = 500, n_names: int = 150, seed: int = 0) -> list[str]:
    """Synthetic panel, report card, comparison, frozen composite, hold-out."""
    df = synthetic(spark, n_days, n_names, (5, 3, 2, 1, 1), within_noise=0.5, reversed_variants=(1, 7), seed=seed).persist()
    cut = 1000 + int(0.7 * n_days)
    train = SignalPanel.of(df.where(f"date < {cut}"), name="synthetic in-sample")
    out = [repr(train), diagnose(train).render()]
    rows, _ = cross_validate(train, methods())
    comp = DedupComposite().fit(train)
    test = SignalPanel.of(df.where(f"date >= {cut + train.horizon}"), name="synthetic hold-out")
    return [*out, shown(rows), comp.describe(), *holdout_lines(test, comp)]


def grid(title: str, numbers: list[int], columns: list[dict[str, str]]) -> str:
    """A Markdown table: a row for each name, a column for each class."""
    table = [["", *(f"class {n}" for n in numbers)], ["---"] * (1 + len(numbers))]
    table += [[name, *(c.get(name, "") for c in columns)] for name in dict.fromkeys(k for c in columns for k in c)]
    return "\n".join([f"## {title}", "", *(f"| {' | '.join(r)} |" for r in table)])


def study(spark: SparkSession, data_dir: str, numbers: list[int], out: str, tuned: bool = False, shapes: bool = False, skip_cv: bool = False) -> None:
    """Report card, PLS sweep, comparison, paired and hold-out tables of several classes, and a summary of all.

    Methods are frozen on the in-sample split and scored once on the out-of-sample one; `shapes` adds the gate and the shaped arms.
    """
    folder, facts, in_sample, held_out, gates = Path(out), [], [], [], []
    folder.mkdir(parents=True, exist_ok=True)
    for n in numbers:
        panel = open_panel(spark, data_dir, n)
        card = diagnose(panel)
        (folder / f"diagnostics_c{n}.txt").write_text(card.render() + "\n")
        write_csv(spark.createDataFrame(list(zip(card.pls_k, card.pls_oof_ic, strict=True)), "k int, oof_ic double"), f"{out}/pls_sweep_c{n}")
        if not skip_cv:
            rows, series = cross_validate(panel, methods(tuned))
            write_csv(spark.createDataFrame(rows), f"{out}/cv_c{n}")
            write_csv(spark.createDataFrame(paired_against(series, "naive_averaged")), f"{out}/paired_c{n}")
            in_sample.append({r["method"]: f"{r['cv_mean_ic']:.4f}" for r in rows})
        other = open_panel(spark, data_dir, n, ",".join(panel.reflected), "out_of_sample")
        decision = gate_decision(panel) if shapes else None
        held = holdout_table(frozen_arms(panel, decision), other).collect()
        write_csv(spark.createDataFrame(held, "method string, n_days long, " + ", ".join(f"{c} double" for c in COLUMNS)).drop("n_days"), f"{out}/holdout_c{n}")
        number = lambda x: "-" if x is None else f"{x:.4f}"
        held_out.append({r["method"]: f"{number(r['mean_ic'])} (t {number(r['nw_t'])})" for r in held})
        facts.append({"variants": str(card.n_features), "blocks": str(card.n_blocks), "first component": f"{card.pc1_share:.2f}", "in-sample days": str(panel.n_days), "hold-out days": str(other.n_days), "reflected": ", ".join(panel.reflected) or "none"})
        gates += [f"## Gate of class {n}\n\n{decision}"] if decision else []
        panel.df.unpersist(), other.df.unpersist()
    tables = [("Classes", facts), ("Mean IC out of fold", in_sample), ("Mean IC on the hold-out, frozen in sample", held_out)]
    (folder / "summary.md").write_text("\n\n".join([*(grid(title, numbers, t) for title, t in tables if t), *gates]) + "\n")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="signalmesh", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("diagnose", "compare", "freeze"):
        s = sub.add_parser(name)
        s.add_argument("--data-dir", required=True)
        s.add_argument("--feature-class", type=int, required=True)
        s.add_argument("--reflect", default="auto", help="auto, empty for none, or comma-separated names")
        s.add_argument("--rho", type=float, default=0.7)
        {"diagnose": lambda s: s.add_argument("--no-pls", action="store_true"), "compare": lambda s: s.add_argument("--tuned", action="store_true"),
         "freeze": lambda s: [s.add_argument("--shapes", action="store_true"), s.add_argument("--out"), s.add_argument("--score-holdout", action="store_true")]}[name](s)
    s = sub.add_parser("demo")
    for k, v in (("--n-days", 500), ("--n-names", 150), ("--seed", 0)):
        s.add_argument(k, type=int, default=v)
    s = sub.add_parser("study")
    s.add_argument("--data-dir", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--classes", type=int, nargs="+", default=[1, 2, 3, 4])
    for flag in ("--tuned", "--shapes", "--skip-cv"):
        s.add_argument(flag, action="store_true")
    a = p.parse_args(argv)
    spark = session()
    if a.command == "demo":
        print("\n\n".join(demo(spark, a.n_days, a.n_names, a.seed)))
        return 0
    if a.command == "study":
        study(spark, a.data_dir, a.classes, a.out, a.tuned, a.shapes, a.skip_cv)
        return 0
    panel = open_panel(spark, a.data_dir, a.feature_class, a.reflect)
    print(panel)
    if a.command == "diagnose":
        print(diagnose(panel, a.rho, not a.no_pls).render())
    elif a.command == "compare":
        rows, series = cross_validate(panel, methods(a.tuned))
        print(shown(rows), "paired against the rank average:", shown(sorted(paired_against(series, "naive_averaged"), key=lambda r: -r["ic_diff"])), sep="\n")
    else:
        comp = DedupComposite(rho=a.rho, shapes=a.shapes).fit(panel)
        print(comp.describe())
        if a.out:
            comp.save(a.out)
        if a.score_holdout:
            other = open_panel(spark, a.data_dir, a.feature_class, ",".join(comp.flipped), "out_of_sample")
            print("\n".join(holdout_lines(other, comp)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
