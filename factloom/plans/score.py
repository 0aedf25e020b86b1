"""The specification score: the mean of six ratios, those without a denominator left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.aggregates import score as mean_score
from factloom.operators.aggregates import share, weakest
from factloom.plans.scan import Model

DIMENSIONS = ("source_read", "contract_declared", "behaviour_traced", "data_described", "evidence_verified", "intent_authored")


def score(model: Model, coverage: DataFrame, flows: DataFrame, citations: DataFrame | None = None, authored: list[str] = ()) -> DataFrame:
    """One row: the six ratios, score (0 to 100, rounded down) and weakest.

    `coverage` has read and unread; `citations` a state each; `authored` the ids of operations with answers.
    """
    one = lambda df, **kw: df.agg(*[v.alias(k) for k, v in kw.items()])
    ops = one(model.operations, ops=F.count("*"), typed=F.count_if(F.col("confidence") == "typed"), answered=F.count_if(F.col("id").isin(list(authored) or [""])))
    traced = one(flows.select("entry").distinct().join(model.operations.select(F.col("id").alias("entry")).distinct(), "entry", "left_semi"), traced=F.count("*"))
    described = one(model.entities, tables=F.count("*"), described=F.count_if(F.size("columns") > 0))
    cited = one(citations, cited=F.count("*"), good=F.count_if(F.col("state") == "verified")) if citations is not None else ops.select(F.lit(0).alias("cited"), F.lit(0).alias("good"))
    rows = coverage.select("read", "unread")
    for part in (ops, traced, described, cited):  # one row each
        rows = rows.join(F.broadcast(part), F.lit(True))
    ratios = {
        "source_read": share(F.col("read"), F.col("read") + F.col("unread")), "contract_declared": share(F.col("typed"), F.col("ops")), "behaviour_traced": share(F.col("traced"), F.col("ops")),
        "data_described": share(F.col("described"), F.col("tables")), "evidence_verified": share(F.col("good"), F.col("cited")), "intent_authored": share(F.col("answered"), F.col("ops")),
    }
    named = rows.select(*[v.alias(k) for k, v in ratios.items()])
    cols = {k: F.col(k) for k in DIMENSIONS}
    return named.select("*", mean_score(list(cols.values())).alias("score"), weakest(cols).alias("weakest"))
