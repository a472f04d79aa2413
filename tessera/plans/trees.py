"""Queries of context trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import integer
from ..functions.dialect import PLAIN
from ..operators import lossless, trees
from . import base

TREE = ("p9", 130, ("p10", 8, (0, 5, 0, 1), ("p11", -6, (1, 4, 0, 1), (2, 3, 1, 1))), ("p4", 120, (3, 13, 0, 1), (4, 1, -2, 2)))
BOUNDARIES = [-20, -8, -3, 0, 3, 8, 20]


def tree_residuals(spark: SparkSession, d: str) -> DataFrame:
    return trees.tree_residuals(base.plane(spark, d), TREE).selectExpr("y", "cast(x as bigint) as x", "ctx", "cast(res as bigint) as res")


def context_entropy(spark: SparkSession, d: str) -> DataFrame:
    tokened = lossless.tokens(trees.tree_residuals(base.plane(spark, d), TREE), "res")
    return lossless.entropy(lossless.token_histogram(tokened, "ctx"), "ctx")


def split_costs(spark: SparkSession, d: str) -> DataFrame:
    return trees.split_costs(base.plane(spark, d), "p10", BOUNDARIES)


QUERIES = {"tree_residuals": tree_residuals, "context_entropy": context_entropy, "split_costs": split_costs}

_PROPS = ", ".join(f"{v} as {k}" for k, v in integer.PROPERTIES.items())
_COLUMNS = trees.tree_columns(PLAIN, TREE)
_TREE = f"{base.CAUSAL}, props as (select *, {_PROPS} from causal), leaf as (select y, x, {_COLUMNS['ctx']} as ctx, cast({_COLUMNS['res']} as bigint) as res from props)"
_TOKEN = f"packed as (select *, {integer.zigzag('res')} as u from leaf), tokened as (select *, {integer.hybrid_token(PLAIN, 'u')} as token, {integer.hybrid_bits(PLAIN, 'u')} as bits from packed)"
ORACLE_SQL = {
    "tree_residuals": f"with {_TREE} select y, x, ctx, res from leaf",
    "context_entropy": f"with {_TREE}, {_TOKEN}, hist as (select ctx, token, count(*) as n, sum(bits) as bits from tokened group by ctx, token) select ctx, cast(sum(n) as bigint) as n, count(*) as kinds, round(sum(n) * log2(cast(sum(n) as double)) - sum(n * log2(cast(n as double))), 4) as entropy_bits, cast(sum(bits) as bigint) as extra_bits from hist group by ctx",
    "split_costs": f"with {base.CAUSAL}, leaf as (select {integer.PROPERTIES['p10']} as p, v - ({integer.predictors(PLAIN)[5]}) as res from causal), {_TOKEN}, tried as (select boundary, p > boundary as above, token, count(*) as n from tokened, (values {', '.join(f'({b})' for b in BOUNDARIES)}) b(boundary) group by boundary, p > boundary, token), side as (select boundary, above, sum(n) * log2(cast(sum(n) as double)) - sum(n * log2(cast(n as double))) as bits from tried group by boundary, above) select boundary, round(sum(bits), 3) as cost from side group by boundary",
}
