"""Variants and repairs of many strategies in one job each (GA09, GA11): who is worth its parent's place.

Variants of all parents are cases of one table. A race drops them stage by stage, and each stage simulates only those that
the ones before left: on the training part, on the validation part, on the stitched paths. What is chosen, and why others
are not, are rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import evaluation as V
from quantloom.operators.simulate import AllRules
from quantloom.sources.staging import staged

#: What a gene costs, and the share of its own fitness by which a variant must beat its parent.
GENE_COST, IMPROVEMENT = 0.1, 0.05


def _sound(orders: DataFrame, split: str, rules: AllRules, annual: float) -> DataFrame:
    cases = (*V.KEYS, "split")
    returns = V.net_returns(V.shifted(V.in_splits(orders).where(F.col("split") == split), cases), rules, cases)
    made = returns.groupBy(*V.KEYS).agg(*[c.alias(n) for n, c in V._ratios(annual).items()])
    return made.select(*V.KEYS, F.col("total_return").alias("ret"), (F.col("sortino") * F.when(F.col("stability") > 0.6, 0.6).otherwise(1.0)).alias("sortino"))


def race(orders: DataFrame, members: DataFrame, rules: AllRules, least_sortino: float = 0.0, improvement: float = IMPROVEMENT, gene_cost: float = GENE_COST, annual: float = 1.0) -> DataFrame:
    """(series, parent, strategy_id, verdict, fitness) for every variant and parent (GA09), by series.

    ``orders`` has those of all parents and variants, ``members`` (strategy_id, parent, genes) names them; a parent is its
    own. A variant is out at ``train`` or ``val`` where its return there is not over zero or its Sortino ratio under the
    least, at ``paths`` where its least path score is missing or under zero, and at ``parent`` where its fitness, that
    score less a cost a gene, isn't better than the parent's by a share of it (0.1, where that is zero). Of the others the
    fittest is ``chosen``, of equal ones the first by name; the rest are ``beaten``. Parents are only measured.
    """
    known = staged(members, "members")
    is_parent = F.col("strategy_id") == F.col("parent")
    here = staged(orders.join(known.select("strategy_id"), "strategy_id", "left_semi"), "race-orders")
    state = here.select(*V.KEYS).distinct().join(known, "strategy_id")
    left, out = state, []
    for split in ("train", "val"):
        figures = _sound(here.join(left.where(~is_parent).select(*V.KEYS), list(V.KEYS), "left_semi"), split, rules, annual)
        judged = staged(left.join(figures, list(V.KEYS), "left").withColumn("_good", is_parent | ((F.col("ret") > 0) & (F.col("sortino") >= least_sortino))), f"race-{split}")
        out.append(judged.where(~F.coalesce("_good", F.lit(False))).select("series", "parent", "strategy_id", F.lit(split).alias("verdict"), F.lit(None).cast("double").alias("fitness")))
        left = judged.where("_good").select(*state.columns)
    paths = V.path_scores(here.join(left.select(*V.KEYS), list(V.KEYS), "left_semi"), rules, annual).select(*V.KEYS, "cpcv_min")
    scored = left.join(paths, list(V.KEYS), "left").withColumn("fitness", F.coalesce("cpcv_min", F.lit(-999.0)) - gene_cost * F.col("genes"))
    scored = staged(scored, "race-paths")
    own = scored.where(is_parent).select("series", "parent", F.col("fitness").alias("own"))
    rows = scored.join(own, ["series", "parent"], "left")
    need = F.col("own") + F.when(F.col("own") == 0, 0.1).otherwise(F.abs("own") * improvement)
    stage = F.when(is_parent, "measured").when(F.coalesce(F.col("cpcv_min") < 0, F.lit(True)), "paths").when(F.coalesce(F.col("fitness") <= need, F.lit(False)), "parent")
    rows = rows.withColumn("_stage", stage)
    best = rows.where("_stage is null").groupBy("series", "parent").agg(F.min(F.struct((-F.col("fitness")).alias("less"), "strategy_id"))["strategy_id"].alias("_best"))
    verdict = F.coalesce("_stage", F.when(F.col("strategy_id") == F.col("_best"), "chosen"), F.lit("beaten"))
    made = rows.join(best, ["series", "parent"], "left").select("series", "parent", "strategy_id", verdict.alias("verdict"), "fitness")
    for o in out:
        made = made.unionByName(o)
    return made


def repairs(audit: DataFrame, least_trades: int = 1) -> DataFrame:
    """What becomes of each strategy whose one side is dead (GA11), from ``evaluation.side_audit``: series, strategy_id,
    action (`keep`, `long` or `short`: the side that alone stays), name, and the returns of what stays on each split.

    A side is dead where it loses or trades fewer than ``least_trades`` times on the training part. With both dead, or
    neither, the strategy stays as it is.
    """
    at = lambda side, split, c: F.coalesce(F.max(F.when((F.col("side") == side) & (F.col("split") == split), F.col(c))), F.lit(0))
    cells = {f"{side}_{split}": at(side, split, "total_return") for side in ("total", "long", "short") for split in ("train", "val", "test")} | {f"{side}_trades": at(side, "train", "trades") for side in ("long", "short")}
    wide = audit.groupBy(*V.KEYS).agg(*[c.alias(n) for n, c in cells.items()])
    dead = {side: (F.col(f"{side}_trades") < least_trades) | (F.col(f"{side}_train") < 0) for side in ("long", "short")}
    action = F.when(dead["long"] & ~dead["short"], "short").when(dead["short"] & ~dead["long"], "long").otherwise("keep")
    kept = lambda split: F.when(action == "keep", F.col(f"total_{split}")).when(action == "long", F.col(f"long_{split}")).otherwise(F.col(f"short_{split}"))
    name = F.when(action == "keep", F.col("strategy_id")).otherwise(F.concat_ws("_", "strategy_id", action))
    return wide.select(*V.KEYS, action.alias("action"), name.alias("name"), *[kept(s).alias(f"{s}_return") for s in ("train", "val", "test")])
