"""Mixing sources to target weights: budgets down a tree of sources, and a seeded token prefix from each leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldwise.kernels.scan import join_on, slice_count, sums_before
from foldwise.kernels.store import materialize
from foldwise.llm.columns import quoted


def _whole(c: Column | str, digits: int = 18) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal({digits},0)")


def _fill(children: DataFrame, parent: list[str], node: str) -> DataFrame:
    """Give each child its ``budget``: the parent's, dealt by ``weight``, where a child holds at most its ``capacity``.

    What full children cannot take goes to their siblings by weight. Children are ordered by capacity per weight: the full
    ones are a prefix, and the others share the rest in whole tokens that add up exactly.
    """
    first = W.partitionBy(*parent).orderBy(F.col("capacity").cast("double") / F.col("weight").cast("double"), node)
    before = first.rowsBetween(W.unboundedPreceding, -1)
    onward = first.rowsBetween(W.currentRow, W.unboundedFollowing)
    dealt = children.withColumns({
        "_used": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "_weights": F.sum("weight").over(onward),
    })
    full = _whole("capacity") * _whole("_weights") <= _whole(F.col("parent_budget") - F.col("_used")) * _whole("weight")
    dealt = dealt.withColumn("_full", full)
    group = W.partitionBy(*parent)
    among = W.partitionBy(*parent, "_full").orderBy(node).rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = F.col("parent_budget") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(F.lit(0))).over(group)
    open_weight = F.sum(F.when(F.col("_full"), F.lit(0)).otherwise(F.col("weight"))).over(group)
    dealt = dealt.withColumns({"_rest": rest, "_open": open_weight, "_sum": F.sum("weight").over(among)})
    upto = lambda c: F.floor(F.try_divide(_whole("_rest") * _whole(c), _whole("_open"))).cast("bigint")
    share = upto(F.col("_sum")) - upto(F.col("_sum") - F.col("weight"))
    return dealt.withColumn("budget", F.when(F.col("_full"), F.col("capacity")).otherwise(share))


def leaf_budgets(
    leaves: DataFrame, levels: list[str], weights: DataFrame, total_tokens: int, max_epochs: int = 1
) -> DataFrame:
    """``(levels..., have, capacity, budget)`` for a table with one row per leaf and its tokens ``have``.

    ``weights`` has ``(node, weight)``: ``node`` is a path such as ``web/en/src0`` or a part of it from the root, ``weight`` a whole
    number; a node that is not listed weighs 1, a node of weight 0 gets nothing. A leaf can give its tokens ``max_epochs``
    times; an inner node what its leaves can. Budgets go down level by level, so a shortage is made good among siblings
    before it is felt further up; only what the whole tree cannot give is left over. NULL names are nodes called ``NULL``.
    """
    paths = [F.concat_ws("/", *[F.coalesce(F.col(c), F.lit("NULL")) for c in levels[: k + 1]]) for k in range(len(levels))]
    known = weights.select(F.col("node").alias("_at"), F.col("weight").cast("bigint").alias("_w"))
    tree = leaves.withColumns({f"_p{k}": p for k, p in enumerate(paths)})
    for k in range(len(levels)):
        named = known.withColumnRenamed("_at", f"_p{k}").withColumnRenamed("_w", f"_w{k}")
        tree = tree.join(named, f"_p{k}", "left").withColumn(f"_w{k}", F.coalesce(f"_w{k}", F.lit(1)))
    open_leaf = F.lit(True)
    for k in range(len(levels)):
        open_leaf = open_leaf & (F.col(f"_w{k}") > 0)
    tree = materialize(tree.withColumn("capacity", F.when(open_leaf, F.col("have") * max_epochs).otherwise(F.lit(0))))
    above = None
    for k in range(len(levels)):
        child = tree.filter(F.col("capacity") > 0).groupBy(*[f"_p{j}" for j in range(k + 1)], F.col(f"_w{k}").alias("weight"))
        child = child.agg(F.sum("capacity").alias("capacity"))
        if above is None:
            child = child.withColumn("parent_budget", F.lit(total_tokens).cast("bigint"))
        else:
            child = child.join(above, f"_p{k - 1}")
        filled = _fill(child, [f"_p{k - 1}"] if k else [], f"_p{k}")
        above = filled.select(f"_p{k}", F.col("budget").alias("parent_budget"))
    last = f"_p{len(levels) - 1}"
    budgets = tree.join(above.withColumnRenamed("parent_budget", "budget"), last, "left")
    return budgets.select(*levels, "have", "capacity", F.coalesce("budget", F.lit(0)).alias("budget"))


def mix(
    pool: DataFrame,
    weights: DataFrame,
    total_tokens: int | None = None,
    share: tuple[int, int] = (1, 2),
    max_epochs: int = 1,
    seed: int = 0,
    id: str = "entry_id",
    levels: tuple[str, ...] = ("season", "episode", "source"),
    tokens: str = "n_tokens",
) -> DataFrame:
    """``(entry_id, levels..., n_tokens, epoch, taken)``: one row per record and epoch that it is drawn in.

    ``pool`` are parsed writeup entries with their token counts, or any rows with an id, level columns from the root of a
    source tree to its leaves, and a count. ``total_tokens`` (or the share of all tokens given as a fraction) is split by
    ``leaf_budgets``. A leaf with a budget over its tokens gives whole epochs first; the last epoch gives the prefix of a
    seeded order whose tokens reach the rest of the budget: its last record is taken in part (``taken`` < ``n_tokens``), so the
    budget is met to the token. The order is the MD5 of seed, epoch and id.

    The running totals of a leaf are summed over slices of the seeded order, so a leaf with a third of all records is spread
    over all tasks. Only ids and counts are shuffled, never texts. NULL and negative counts are 0 tokens; records without
    tokens come along if the prefix reaches beyond them; a NULL level is a node called ``NULL``; a NULL id is a record like
    others. Records that share id and count are interchangeable. An empty pool or budget gives no rows.
    """
    names = [f"_l{k}" for k in range(len(levels))]
    rows = pool.select(
        quoted(id).alias("entry_id"), *[quoted(c).cast("string").alias(n) for c, n in zip(levels, names)],
        F.greatest(F.coalesce(quoted(tokens).cast("bigint"), F.lit(0)), F.lit(0)).alias("n_tokens"),
    )
    rows = rows.withColumns({n: F.coalesce(n, F.lit("NULL")) for n in names})
    rows = materialize(rows)
    leaves = materialize(rows.groupBy(*names).agg(F.sum("n_tokens").alias("have")))
    if total_tokens is None:
        everything = leaves.agg(F.sum("have")).first()[0] or 0
        total_tokens = everything * share[0] // share[1]
    budgets = materialize(leaf_budgets(leaves, names, weights, int(total_tokens), max_epochs))
    budgets = budgets.filter((F.col("budget") > 0) & (F.col("have") > 0))
    whole, rest = F.floor(F.col("budget") / F.col("have")), F.col("budget") % F.col("have")
    budgets = budgets.select(*names, whole.cast("int").alias("epochs"), rest.alias("rest"))
    drawn = rows.join(budgets, names)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("entry_id").cast("string")))
    drawn = drawn.withColumn("_order", key)
    parts = slice_count(drawn)
    place = F.conv(F.substring("_order", 1, 8), 16, 10).cast("bigint") * F.lit(parts)
    drawn = drawn.withColumn("_slice", F.floor(place / F.lit(1 << 32)).cast("int"))
    order = ["_order", "entry_id", "n_tokens"]
    placed = sums_before(drawn, names, order, {"_before": F.col("n_tokens")}, "_slice")
    left = F.col("rest") - F.col("_before")
    last = F.when(left > 0, F.struct(F.col("epochs").alias("epoch"), F.least("n_tokens", left).alias("taken")))
    earlier = F.transform(
        F.when(F.col("epochs") > 0, F.sequence(F.lit(0), F.col("epochs") - 1)).otherwise(F.array().cast("array<int>")),
        lambda e: F.struct(e.alias("epoch"), F.col("n_tokens").alias("taken")),
    )
    draws = F.explode(F.filter(F.concat(earlier, F.array(last)), lambda d: d.isNotNull())).alias("draw")
    picked = placed.select("entry_id", *names, "n_tokens", draws)
    return picked.select(
        "entry_id", *[F.col(n).alias(c) for n, c in zip(names, levels)], "n_tokens", "draw.epoch", "draw.taken"
    )


def words_in(text: Column) -> Column:
    """Runs without ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
