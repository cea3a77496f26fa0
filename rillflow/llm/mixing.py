"""Mixing sources to target weights with hierarchical budgets.  DataFrame functions only.

A tree of domain, language and source has a target weight at each node among its siblings; which domain a
source belongs to and the weights are parameters (``Targets``).  The token budget
goes down the tree: a node's budget is shared by its children in proportion to their weights, but
none gets more than its subtree holds (its tokens times ``max_epochs``).  What a child cannot take is
shared among its siblings, so a shortage leaves a node only when its whole subtree is used up; that is,
siblings make it up before ancestors' other children do.

The share is found in closed form: with children sorted by capacity over weight, those that are full
form a prefix, and the others share the rest by weight.

A leaf reads epoch after epoch, each in an order of its own from a seeded digest of doc_id, until its
budget is covered: a row is taken while the tokens before it are fewer than the leaf's budget.  Prefix
sums are built in two steps, over digest slices and then within a slice, so that no task sorts a leaf.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, unused

LEVELS = ("domain", "lang", "source")
SEED = 20240
#: Share of the corpus's tokens that the mixture has, and how often a row may be read.
BUDGET_SHARE, MAX_EPOCHS = 0.5, 2
#: Slices of an epoch's order (16 bits): a hot leaf's slice holds about 1/65536 of it.
SLICES = 65536
#: Leaves whose plan is broadcast at most; a larger plan is joined by Spark's skew join.
BROADCAST_LEAVES = 50_000
#: The domain of a source that has none, and what joins the names of a path.
OTHER, JOINT = "other", "\x1f"


@dataclass(frozen=True)
class Targets:
    """``domains``: the domain of each source (``OTHER`` for one not named).  ``weights``: the weight of a node
    among its siblings by its path, (domain,), (domain, lang) or (domain, lang, source); 1 for one not named."""

    domains: Mapping[str, str] = field(default_factory=dict)
    weights: Mapping[tuple[str, ...], float] = field(default_factory=dict)

    def __post_init__(self):
        if not all(0 < w < float("inf") for w in self.weights.values()):
            raise ValueError("weights must be above zero")
        if not all(1 <= len(path) <= len(LEVELS) for path in self.weights):
            raise ValueError("a path has one to three names")

    def domain_of(self, source: Column) -> Column:
        return F.coalesce(_looked_up(self.domains, source), F.lit(OTHER))

    def weight_of(self, *path: Column) -> Column:
        named = {JOINT.join(p): float(w) for p, w in self.weights.items() if len(p) == len(path)}
        return F.coalesce(_looked_up(named, F.concat_ws(JOINT, *path)), F.lit(1.0))


def _looked_up(table: Mapping, key: Column) -> Column:
    if not table:
        return F.lit(None)
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def token_count(text: Column) -> Column:
    """Words of a whole text; a null or blank one has none."""
    bare = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, " +"))).cast("long")


def water_fill(children: DataFrame, parent: list[str], budget: Column, order: str) -> DataFrame:
    """Adds ``share`` to children with ``capacity`` and ``weight``: the parent's budget, by weight, within capacities."""
    by_ratio = W.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), order)
    before, whole = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*parent)
    filled = F.coalesce(F.sum("capacity").over(before), F.lit(0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    fits = children.withColumn("__level", (budget - filled) / open_weight).withColumn("__full", F.col("capacity") / F.col("weight") <= F.col("__level"))
    # the full ones are a prefix in this order: the first that is not full sets the level of all others
    level = F.min(F.when(~F.col("__full"), F.struct((F.col("capacity") / F.col("weight")).alias("r"), F.col(order).alias("o"), F.col("__level").alias("l")))).over(whole)["l"]
    return fits.withColumn("share", F.when(F.col("__full"), F.col("capacity").cast("double")).otherwise(F.col("weight") * level)).drop("__level", "__full")


def leaf_budgets(leaves: DataFrame, budget_share: float, max_epochs: int, targets: Targets = Targets()) -> DataFrame:
    """domain, lang, source, tokens, share from one row a leaf with ``tokens``: a table as small as the tree."""
    sized = leaves.filter("tokens > 0").withColumn("capacity", F.col("tokens") * max_epochs)
    carried: DataFrame | None = None
    for depth, name in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = sized.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("weight", targets.weight_of(*map(F.col, keys)))
        if carried is None:  # over the domains, a handful of rows
            nodes = nodes.withColumn("__budget", F.sum("capacity").over(W.partitionBy()) / max_epochs * F.lit(budget_share))
        else:
            nodes = nodes.join(carried, keys[:-1])
        filled = water_fill(nodes, keys[:-1], F.col("__budget"), name)
        carried = filled.select(*keys, F.col("share").alias("__budget"))
    return sized.join(carried, list(LEVELS)).select(*LEVELS, "tokens", F.col("__budget").alias("share"))


def epoch_digest(doc_id: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")).cast("binary"))


def mix(docs: DataFrame, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, targets: Targets = Targets()) -> DataFrame:
    """doc_id, domain, lang, source, tokens, epoch of each row taken; a row read in two epochs stands twice.

    Null lang, source or doc_id count as the values ``-``, ``-`` and -1.  Rows without words are never
    taken.  Ties (repeated rows) share a place in the order and are taken or left together.  A very long
    text is one row of its tokens and may carry a leaf past its budget, being never cut.  Further columns
    are not read.  An empty table gives none.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"),
        targets.domain_of(F.coalesce(F.col("source").cast("string"), F.lit("-"))).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("-")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("-")).alias("source"),
        token_count(F.col("text").cast("string")).alias("tokens"),
    )
    rows = cut(rows.filter("tokens > 0"))  # texts are read once, what follows handles numbers
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, budget_share, max_epochs, targets)
    # whole epochs are taken as they are; one epoch of a leaf is read in part
    plan = cut(
        budgets.withColumn("whole", F.floor(F.col("share") / F.col("tokens")).cast("int")).withColumn("rest", F.col("share") - F.col("whole") * F.col("tokens"))
    ).select(*LEVELS, "whole", "rest")
    small = plan.count() <= BROADCAST_LEAVES
    placed = rows.join(F.broadcast(plan) if small else plan, list(LEVELS))
    complete = placed.filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    partial = placed.filter("rest > 0").withColumn("epoch", F.col("whole")).withColumn("digest", epoch_digest(F.col("doc_id"), F.col("epoch"), seed)).withColumn("slice", F.conv(F.substring("digest", 1, 4), 16, 10).cast("int"))
    slices = partial.groupBy(*LEVELS, "slice").agg(F.sum("tokens").alias("slice_tokens"), F.max("rest").alias("rest"))
    blocks = slices.groupBy(*LEVELS, (F.col("slice") / 256).cast("int").alias("block")).agg(F.sum("slice_tokens").alias("block_tokens"))
    so_far = W.partitionBy(*LEVELS).orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # 256 rows a leaf at most
    block_start = blocks.select(*LEVELS, "block", F.coalesce(F.sum("block_tokens").over(so_far), F.lit(0)).alias("block_start"))
    in_block = W.partitionBy(*LEVELS, "block").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # likewise
    starts = (
        slices.withColumn("block", (F.col("slice") / 256).cast("int"))
        .join(block_start, [*LEVELS, "block"])
        .withColumn("slice_start", F.col("block_start") + F.coalesce(F.sum("slice_tokens").over(in_block), F.lit(0)))
        .filter("slice_start < rest")
        .select(*LEVELS, "slice", "slice_start")
    )
    in_slice = W.partitionBy(*LEVELS, "slice").orderBy("digest").rangeBetween(W.unboundedPreceding, W.currentRow)
    same = W.partitionBy(*LEVELS, "slice", "digest")
    part = (
        partial.join(starts, [*LEVELS, "slice"])
        .withColumn("__before", F.col("slice_start") + F.sum("tokens").over(in_slice) - F.sum("tokens").over(same))
        .filter("__before < rest")
    )
    columns = ["doc_id", *LEVELS, "tokens", "epoch"]
    return complete.select(*columns).unionByName(part.select(*columns))


def keep_mixed(docs: DataFrame, budget_share: float = BUDGET_SHARE, seed: int = SEED, targets: Targets = Targets()) -> DataFrame:
    """The documents that a mixture of single epochs takes, with their columns; rows without words go.

    A leaf's rows are a prefix of its order, so its last digest decides: texts do not move.
    """
    *keys, reached = unused(docs, "__domain", "__lang", "__source", "__last")
    taken = mix(docs, budget_share, 1, seed, targets)
    last = taken.groupBy(*(F.col(c).alias(k) for c, k in zip(LEVELS, keys))).agg(F.max(epoch_digest(F.col("doc_id"), F.lit(0), seed)).alias(reached))
    last = cut(last)
    source = F.coalesce(F.col("source").cast("string"), F.lit("-"))
    placed = docs.withColumns(dict(zip(keys, (targets.domain_of(source), F.coalesce(F.col("lang").cast("string"), F.lit("-")), source))))
    joined = placed.join(F.broadcast(last) if last.count() <= BROADCAST_LEAVES else last, keys)
    digest = epoch_digest(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.lit(0), seed)
    return joined.filter((digest <= F.col(reached)) & (token_count(F.col("text").cast("string")) > 0)).select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE_SQL = r"""
WITH w(path, weight) AS ({weights}),
dm(named, domain) AS ({domains}),
r AS (
  SELECT coalesce(doc_id, -1) AS doc_id, coalesce(lang, '-') AS lang, coalesce(source, '-') AS source,
         coalesce((SELECT dm.domain FROM dm WHERE dm.named = coalesce(source, '-')), 'other') AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
  FROM documents),
rows_ AS (SELECT * FROM r WHERE tokens > 0),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {epochs} AS capacity FROM rows_ GROUP BY ALL),
n1 AS (SELECT domain, sum(capacity)::BIGINT AS capacity, coalesce((SELECT w.weight FROM w WHERE path = leaf.domain), 1.0::DOUBLE) AS weight, (SELECT sum(tokens)::BIGINT * {share} FROM leaf)::DOUBLE AS budget FROM leaf GROUP BY domain),
l1 AS (SELECT *, (budget - coalesce(sum(capacity) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lev FROM n1
       WINDOW b AS (ORDER BY capacity / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f1 AS (SELECT domain, CASE WHEN capacity / weight <= lev THEN capacity ELSE weight * min_by(lev, (capacity / weight, domain)) FILTER (capacity / weight > lev) OVER () END AS share FROM l1),
n2 AS (SELECT leaf.domain, lang, sum(capacity)::BIGINT AS capacity, coalesce((SELECT w.weight FROM w WHERE path = leaf.domain || chr(31) || leaf.lang), 1.0::DOUBLE) AS weight, max(f1.share) AS budget FROM leaf JOIN f1 USING (domain) GROUP BY ALL),
l2 AS (SELECT *, (budget - coalesce(sum(capacity) OVER b, 0)) / (sum(weight) OVER p - coalesce(sum(weight) OVER b, 0)) AS lev FROM n2
       WINDOW p AS (PARTITION BY domain), b AS (PARTITION BY domain ORDER BY capacity / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f2 AS (SELECT domain, lang, CASE WHEN capacity / weight <= lev THEN capacity ELSE weight * min_by(lev, (capacity / weight, lang)) FILTER (capacity / weight > lev) OVER (PARTITION BY domain) END AS share FROM l2),
n3 AS (SELECT leaf.domain, leaf.lang, source, tokens, capacity, coalesce((SELECT w.weight FROM w WHERE path = leaf.domain || chr(31) || leaf.lang || chr(31) || leaf.source), 1.0::DOUBLE) AS weight, f2.share AS budget FROM leaf JOIN f2 USING (domain, lang)),
l3 AS (SELECT *, (budget - coalesce(sum(capacity) OVER b, 0)) / (sum(weight) OVER p - coalesce(sum(weight) OVER b, 0)) AS lev FROM n3
       WINDOW p AS (PARTITION BY domain, lang), b AS (PARTITION BY domain, lang ORDER BY capacity / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f3 AS (SELECT domain, lang, source, tokens AS leaf_tokens, CASE WHEN capacity / weight <= lev THEN capacity ELSE weight * min_by(lev, (capacity / weight, source)) FILTER (capacity / weight > lev) OVER (PARTITION BY domain, lang) END AS share FROM l3),
plan AS (SELECT domain, lang, source, floor(share / leaf_tokens)::INT AS whole, share - floor(share / leaf_tokens)::INT * leaf_tokens AS rest FROM f3),
part AS (SELECT rows_.*, whole AS epoch, rest, md5('{seed}:' || whole || ':' || doc_id) AS digest FROM rows_ JOIN plan USING (domain, lang, source) WHERE rest > 0),
sums AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY digest RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              - sum(tokens) OVER (PARTITION BY domain, lang, source, digest) AS before FROM part)
SELECT doc_id, domain, lang, source, tokens, epoch::INT AS epoch FROM sums WHERE before < rest
UNION ALL
SELECT doc_id, domain, lang, source, tokens, e.epoch::INT AS epoch FROM rows_ JOIN plan USING (domain, lang, source), LATERAL (SELECT unnest(range(whole)) AS epoch) e WHERE whole > 0
"""


def _sql_rows(rows: list[tuple]) -> str:
    text = lambda v: repr(v) + "::DOUBLE" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join(f"({text(a)}, {text(b)})" for a, b in rows) if rows else "SELECT NULL, NULL WHERE false"


def oracle_sql(budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, targets: Targets = Targets()) -> str:
    weights = _sql_rows([(JOINT.join(p), float(w)) for p, w in targets.weights.items()])
    domains = _sql_rows(list(targets.domains.items()))
    return ORACLE_SQL.replace("{share}", repr(budget_share)).replace("{epochs}", str(max_epochs)).replace("{seed}", str(seed)).replace("{weights}", weights).replace("{domains}", domains)
