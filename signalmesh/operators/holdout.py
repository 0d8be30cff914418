"""Hold-out scores: methods frozen on a training panel, each scored once on another panel; all arms are one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .composite import DedupComposite
from .gate import GateDecision
from .ic import scorecard

#: Columns of a hold-out table behind the method's name (fixed values).
COLUMNS = ("mean_ic", "nw_t", "ic_ir_ann", "port_ir_ann", "half_life", "ret_5d", "turn_l5")
VECTORS = ("naive_averaged", "ic_weight", "pca_pc1")

Arm = Callable[..., DataFrame]


def vector_arm(train, method: Callable) -> Arm:
    """The weight vector of all training days, for panels of the same features and reflections."""
    weights = method(train, train.all_days)

    def signal(panel) -> DataFrame:
        if (list(panel.features), set(panel.reflected)) != (list(train.features), set(train.reflected)):
            raise ValueError("the panel's features or reflections differ from those of the training panel")
        return panel.signal(weights)

    return signal


def frozen_arms(train, decision: GateDecision | None = None, **shaping) -> dict[str, Arm]:
    """Every frozen method by name; with a gate's decision also the shaped composites and the arm that it selects.

    Both block weightings share one fit, so response curves are learned once.
    """
    arms = {m: vector_arm(train, linear.METHODS[m]) for m in VECTORS}
    linear_fit = DedupComposite().fit(train)
    fits = {"": linear_fit} if decision is None else {"": linear_fit, "_shaped": DedupComposite(shapes=True, **shaping).fit(train)}
    arms |= {f"cluster_{rule}{suffix}": fit.reweighted(rule).transform_panel for suffix, fit in fits.items() for rule in ("eq", "eb")}
    if decision is not None:
        arms["selected (gated)"] = arms["cluster_eb_shaped" if decision.adopt_shapes else "cluster_eq"]
    return arms


def holdout_table(arms: Mapping[str, Arm], test) -> DataFrame:
    """(method, n_days, scorecard columns), one row for each arm."""
    return reduce(DataFrame.unionByName, [scorecard(arm(test)).select(F.lit(m).alias("method"), "n_days", *COLUMNS) for m, arm in arms.items()])
