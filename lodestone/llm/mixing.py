"""Mixing sources to target weights by hierarchical budgeting, in native operations only.

Documents stand in the leaves of a tree, say domain / language / source. A budget of
tokens is handed down from the root: at every node the children share it by weight,
and a child whose whole subtree cannot give its share (its tokens times `max_epochs`)
leaves the rest to its siblings. As a subtree's budget only shrinks when the subtree
is exhausted, shortages reach siblings before cousins and ancestors. Budgets are whole
tokens; what division leaves over goes to the first open children, one each.

A leaf's budget takes whole epochs of the leaf and then the token-prefix of one more.
The order of an epoch is the MD5 of seed, epoch and document id. The prefix is found
from the sums of hash buckets; only the bucket in which it ends is sorted.

Defined results
* null and empty texts have no tokens: they are used once for each whole epoch, and in
  the last one if the prefix goes on behind them
* null levels are values of their own; a budget above the capacity takes the capacity
* rows that share an id are in order of their text hash, equal rows in any order
* a leaf without tokens gives no documents; an empty table gives an empty table
* input columns that are named like result columns or levels are replaced
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut_lineage, fits

#: Documents of a hash bucket, about.
BUCKET_ROWS = 4096
_SPAN = 1 << 32
RESULT = ("n_tokens", "copies", "used_tokens")


def count_words(text: Column) -> Column:
    """Words between white space as a measure of tokens."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _named(value: Column) -> Column:
    """A level's value as a key that is not null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    given = weights.get(level, {})
    if any(not isinstance(w, int) or w < 1 for w in given.values()):
        raise ValueError(f"weights of {level} must be whole and positive")
    out = F.lit(1)
    for value, weight in given.items():
        out = F.when(F.col(level) == F.lit("=" + value), F.lit(weight)).otherwise(out)
    return out.cast("decimal(38,0)")


def _share(children: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Children with `capacity`, `weight` and the parent's `budget`: the budget becomes each child's own."""
    big = "decimal(38,0)"
    order = [F.col("capacity") / F.col("weight"), F.col(level)]
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = family.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = family.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    tested = children.withColumns(
        {
            "taken": F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast(big),
            "open_weight": F.sum("weight").over(onward).cast(big),
        }
    )
    # In order of capacity / weight the children that get all they have come first.
    full = (F.col("budget") - F.col("taken")) * F.col("weight") >= F.col("capacity") * F.col("open_weight")
    tested = tested.withColumn("full", full)
    everything = family.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = tested.withColumns(
        {
            "left_over": (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(everything), F.lit(0))).cast(big),
            "rest_weight": F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything).cast(big),
        }
    )
    floor = F.expr("(left_over * weight) div rest_weight").cast(big)
    rest = rest.withColumn("part", F.when(F.col("full"), F.col("capacity")).otherwise(floor))
    open_turn = family.orderBy(F.col("full"), *order)
    rest = rest.withColumns(
        {"turn": F.row_number().over(open_turn), "extra": (F.col("budget") - F.sum("part").over(everything)).cast(big)}
    )
    own = F.col("part") + F.when(~F.col("full") & (F.col("turn") <= F.col("extra")), 1).otherwise(0)
    return rest.withColumn("budget", own.cast(big))


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int, max_epochs: int) -> DataFrame:
    """Leaves (levels, supply, ...) with the tokens of their `budget`."""
    big = "decimal(38,0)"
    capacity = (F.col("supply") * max_epochs).cast(big)
    sized = leaves.withColumn("capacity", capacity)
    total = sized.agg(F.coalesce(F.sum("capacity"), F.lit(0)).alias("c")).first()["c"]
    nodes = None
    for i, level in enumerate(levels):
        children = sized.groupBy(*levels[: i + 1]).agg(F.sum("capacity").cast(big).alias("capacity"))
        children = children.withColumn("weight", _weight(level, weights))
        if nodes is None:
            children = children.withColumn("budget", F.lit(min(int(budget), int(total))).cast(big))
        else:
            children = children.join(nodes.select(*levels[:i], "budget"), levels[:i])
        nodes = _share(children, levels[:i], level).select(*levels[: i + 1], "budget")
    return leaves.join(nodes, levels).withColumn("budget", F.col("budget").cast("long"))


def _draw(seed: str, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch's order, as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _bucket(draw: Column) -> Column:
    return F.floor(F.conv(F.substring(draw, 1, 8), 16, 10).cast("long") * F.col("buckets") / _SPAN).cast("long")


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, int]],
    budget: int | None = None,
    share: float | None = None,
    max_epochs: int = 1,
    seed: str = "mix",
    doc_id: str = "doc_id",
    text: str = "text",
    tokens: Column | None = None,
) -> DataFrame:
    """The chosen documents with n_tokens, copies (how often each is used) and used_tokens.

    `levels` are the tree's levels from the top, `weights` the weight of a level's value
    where it is not 1. The budget is in tokens or a share of all tokens. used_tokens add up
    to each leaf's budget: of the document in which the prefix ends only a part is used.
    """
    names = list(levels)
    keys = [f"_level{i}" for i in range(len(names))]
    kept = [c for c in docs.columns if c not in RESULT and c not in names]
    given = docs.select("*", *[_named(c).alias(k) for k, c in zip(keys, levels.values())], F.xxhash64(text).alias("_hash"))
    given = given.withColumn("_tokens", tokens if tokens is not None else count_words(F.col(text)))
    slim = cut_lineage(given.select(F.col(doc_id).alias("_id"), "_hash", *keys, "_tokens"))

    leaves = cut_lineage(slim.groupBy(*keys).agg(F.sum("_tokens").alias("supply"), F.count(F.lit(1)).alias("docs")))
    if budget is None:
        total = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("t")).first()["t"]
        budget = int(total * (1.0 if share is None else share))
    keyed = {k: weights[n] for k, n in zip(keys, names) if n in weights}
    plan = leaf_budgets(leaves, keys, keyed, budget, max_epochs).where("supply > 0 and budget > 0")
    plan = plan.withColumns(
        {
            "epochs": F.expr("budget div supply"),
            "prefix": F.expr("budget % supply"),
            "buckets": F.ceil(F.col("docs") / BUCKET_ROWS).cast("long"),
        }
    )
    plan = cut_lineage(plan.select(*keys, "epochs", "prefix", "buckets"))
    side = F.broadcast(plan) if fits(plan) else plan
    draw = _draw(seed, F.col("epochs"), F.col("_id"))
    sums = slim.join(side, keys).withColumn("bucket", _bucket(draw)).groupBy(*keys, "bucket").agg(F.sum("_tokens").alias("sum"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    # The bucket that holds the end of the prefix: the last that starts before it.
    ends = sums.join(side, keys).where("start < prefix").groupBy(*keys).agg(F.max_by(F.struct("bucket", "start"), "bucket").alias("end"))
    plan = cut_lineage(plan.join(ends, keys, "left").select(*keys, "epochs", "prefix", "buckets", F.col("end.bucket").alias("end_bucket"), F.col("end.start").alias("end_start")))
    side = F.broadcast(plan) if fits(plan) else plan

    met = given.withColumn("_id", F.col(doc_id)).join(side, keys)
    met = met.withColumns({"_draw": draw}).withColumn("_bucket", _bucket(F.col("_draw")))
    inside = F.col("_bucket") < F.col("end_bucket")
    at_end = F.col("_bucket") == F.col("end_bucket")
    sure = met.where(at_end.isNull() | ~at_end).withColumn(
        "_part", F.when(inside, F.col("_tokens"))  # null where the last epoch does not use the document
    )
    order = Window.partitionBy(*keys).orderBy("_draw", "_id", "_hash").rowsBetween(Window.unboundedPreceding, -1)
    cut = met.where(at_end).withColumn("_start", F.col("end_start") + F.coalesce(F.sum("_tokens").over(order), F.lit(0)))
    cut = cut.withColumn("_part", F.when(F.col("_start") < F.col("prefix"), F.least(F.col("_tokens"), F.col("prefix") - F.col("_start")))).drop("_start")
    found = sure.unionByName(cut)
    copies = F.col("epochs") + F.col("_part").isNotNull().cast("long")
    shown = [F.when(F.col(k) != "", F.substring(F.col(k), 2, 1 << 30)).alias(n) for k, n in zip(keys, names)]
    return found.where(copies > 0).select(
        *kept,
        *shown,
        F.col("_tokens").alias("n_tokens"),
        copies.alias("copies"),
        (F.col("epochs") * F.col("_tokens") + F.coalesce("_part", F.lit(0))).alias("used_tokens"),
    )


def in_epochs(chosen: DataFrame) -> DataFrame:
    """One row for each use of a document, with `epoch` from 0."""
    return chosen.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
