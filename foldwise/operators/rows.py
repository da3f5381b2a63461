"""Folds, splits, unions, row filters, resampling, weights and targets.

Every random choice is a hash of the row key, so it does not depend on partitioning. Positions in hash order are
computed in slices of the hash range: no task ever holds a whole class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.functions.hashing import MODULUS, hash_slice, key_hash
from foldwise.kernels.lookup import attach_row, lookup
from foldwise.kernels.quantiles import exact_quantiles, quantile_name
from foldwise.kernels.scan import SLICE, join_on, row_numbers, slice_count
from foldwise.kernels.store import materialize


def hash_positions(df: DataFrame, id: str, seed: int, by: list[str] | None = None, name: str = "position") -> DataFrame:
    """1-based position of each row in ``(hash, id)`` order, inside ``by``."""
    marked = df.withColumn("_h", key_hash(id, seed))
    marked = marked.withColumn(SLICE, hash_slice(F.col("_h"), slice_count(df)))
    return row_numbers(marked, by or [], ["_h", id], SLICE, name).drop("_h", SLICE)


def kfold(df: DataFrame, id: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """Folds whose sizes differ by at most one."""
    placed = hash_positions(df, id, seed, name="_pos")
    return placed.withColumn(name, F.pmod(F.col("_pos") - 1, F.lit(k)).cast("int")).drop("_pos")


def hashed_fold(df: DataFrame, id: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """Folds straight from the hash: no shuffle, sizes only about equal."""
    return df.withColumn(name, (key_hash(id, seed) % k).cast("int"))


def stratified_kfold(df: DataFrame, id: str, y: str, k: int, seed: int, name: str = "fold", within: list[str] | None = None) -> DataFrame:
    """Folds balanced per class; with ``within=['fold']`` the inner folds of a nested scheme."""
    placed = hash_positions(df, id, seed, [*(within or []), y], "_pos")
    return placed.withColumn(name, F.pmod(F.col("_pos") - 1, F.lit(k)).cast("int")).drop("_pos")


def class_sizes(df: DataFrame, y: str) -> DataFrame:
    """Rows per class, stored: a join with it is then planned by its real size and never shuffles the rows by class."""
    return materialize(df.groupBy(y).agg(F.count(F.lit(1)).alias("_n")))


def stratified_split(df: DataFrame, id: str, y: str, frac: float, seed: int, name: str = "part") -> DataFrame:
    """'A' for the first ``floor(frac * n)`` rows of each class in hash order, 'R' for the rest."""
    sizes = class_sizes(df, y)
    placed = join_on(hash_positions(df, id, seed, [y], "_pos"), sizes, [y])
    chosen = F.col("_pos") <= F.floor(F.lit(float(frac)) * F.col("_n"))
    return placed.withColumn(name, F.when(chosen, "A").otherwise("R")).drop("_pos", "_n")


def union_frames(*frames: DataFrame) -> DataFrame:
    """Union by column name; a column missing in one frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append_external(df: DataFrame, orig: DataFrame, k: int, fold: str = "fold", orig_fold: str = "fold") -> DataFrame:
    """One copy of the data per outer fold ``f``: role 'hold' for rows of that fold, 'fit' for the others, and
    external rows always 'fit', those of their own matching fold left out."""
    folds = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = df.withColumn("outer", folds).withColumn("role", F.when(F.col(fold) == F.col("outer"), "hold").otherwise("fit"))
    ext = orig.withColumn("outer", folds).filter(F.col(orig_fold) != F.col("outer")).withColumn("role", F.lit("fit"))
    return union_frames(own.withColumn("external", F.lit(0)), ext.withColumn("external", F.lit(1)))


def replicate(df: DataFrame, id: str, n: int, seed: int) -> DataFrame:
    """``n`` copies of the table, each with its own shuffled position."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    marked = copies.withColumn("_h", key_hash(F.col(id) * n + F.col("copy"), seed)).withColumn(SLICE, hash_slice(F.col("_h"), slice_count(df)))
    return row_numbers(marked, ["copy"], ["_h", id], SLICE, "position").drop("_h", SLICE)


def trim_residuals(df: DataFrame, y: str, pred: str, pct: float) -> DataFrame:
    """Drop the rows whose absolute residual is above the ``100 - pct`` percentile."""
    out = df.withColumn("_r", F.abs(F.col(y) - F.col(pred)))
    q = 1.0 - pct / 100.0
    limit = exact_quantiles(out.select("_r"), ["_r"], [q]).select(F.col(quantile_name("_r", q)).alias("_limit"))
    return attach_row(out, limit).filter(F.col("_r") <= F.col("_limit")).drop("_r", "_limit")


def confident_error(y: str, pred: str, threshold: float) -> Column:
    p = F.col(pred)
    return ((F.col(y) == 1) & (p < F.lit(1.0 - threshold))) | ((F.col(y) == 0) & (p > F.lit(threshold)))


def prune_confident_errors(df: DataFrame, y: str, pred: str, threshold: float) -> DataFrame:
    """Drop rows whose out-of-fold prediction contradicts the label beyond the threshold."""
    return df.filter(~F.coalesce(confident_error(y, pred, threshold), F.lit(False)))


def restore_predictions(base: DataFrame, preds: DataFrame, id: str, old: str, new: str, name: str) -> DataFrame:
    """New prediction where one exists, the old one for dropped rows."""
    joined = base.join(preds.select(id, F.col(new).alias("_new")), id, "left")
    return joined.withColumn(name, F.coalesce("_new", old)).drop("_new")


def pseudo_label(train: DataFrame, test: DataFrame, y: str, pred: str, low: float, high: float, weight: float) -> DataFrame:
    """Training rows with weight 1, and confidently predicted test rows with a hard label and their own weight."""
    p = F.col(pred)
    sure = test.filter((p >= high) | (p <= low)).withColumn(y, (p >= 0.5).cast("int")).drop(pred)
    return union_frames(train.withColumn("weight", F.lit(1.0)), sure.withColumn("weight", F.lit(float(weight))))


def min_max_weights(df: DataFrame, value: Column, low: float, high: float, name: str = "weight") -> DataFrame:
    """``low + (v - min) / (max - min + 1e-8) * (high - low)``."""
    out = df.withColumn("_v", value)
    out = attach_row(out, out.agg(F.min("_v").alias("_min"), F.max("_v").alias("_max")))
    unit = (F.col("_v") - F.col("_min")) / (F.col("_max") - F.col("_min") + F.lit(1e-8))
    return out.withColumn(name, F.lit(low) + unit * F.lit(high - low)).drop("_v", "_min", "_max")


def difficulty_weights(df: DataFrame, y: str, pred: str, low: float, high: float) -> DataFrame:
    return min_max_weights(df, F.abs(F.col(pred) - F.col(y)), low, high)


def class_weights(df: DataFrame, y: str, positive_factor: float | None = None) -> DataFrame:
    """``weight = n / (classes * n_class)``; with ``positive_factor`` also the cost ``neg / pos * factor`` of positives."""
    sizes = class_sizes(df, y)
    totals = sizes.agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_classes"))
    out = attach_row(lookup(df, sizes, [y]), totals)
    out = out.withColumn("weight", F.col("_total") / (F.col("_classes") * F.col("_n")))
    if positive_factor is not None:
        cost = (F.col("_total") - F.col("_n")) / F.col("_n") * F.lit(float(positive_factor))
        out = out.withColumn("cost", F.when(F.col(y) == 1, cost).otherwise(F.lit(1.0)))
    return out.drop("_n", "_total", "_classes")


def soft_targets(df: DataFrame, y: str, teacher: str, alpha: float | Column, name: str = "soft") -> DataFrame:
    """``(1 - a) * y + a * teacher``; a value outside [0, 1] stops the job."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    mixed = (F.lit(1.0) - a) * F.col(y) + a * F.col(teacher)
    checked = F.when((mixed < 0.0) | (mixed > 1.0), F.raise_error(F.lit("soft target outside [0, 1]"))).otherwise(mixed)
    return df.withColumn(name, checked)


def random_groups(df: DataFrame, id: str, size: int, seed: int) -> DataFrame:
    """Groups of ``size`` rows (the last may be smaller) cut from the hash order."""
    placed = hash_positions(df, id, seed, name="_pos")
    return placed.withColumn("group", F.floor((F.col("_pos") - 1) / F.lit(size))).drop("_pos")


def decompose_target(df: DataFrame, y: str, columns: list[str], scale: float) -> DataFrame:
    """``linear``: scaled mean of the set columns; ``remainder``: label minus it."""
    n, s = F.lit(0), F.lit(0.0)
    for c in columns:
        n = n + F.when(F.col(c).isNotNull(), 1).otherwise(0)
        s = s + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    out = df.withColumn("linear", F.when(n > 0, s / n) * F.lit(float(scale)))
    return out.withColumn("remainder", F.col(y) - F.col("linear"))


def recompose_target(df: DataFrame, pred: str, name: str = "restored") -> DataFrame:
    return df.withColumn(name, F.col(pred) + F.col("linear"))


def draw(j: Column, n: Column, seed: int) -> Column:
    """Number in ``[0, n)`` for draw ``j``, with replacement."""
    return F.pmod(key_hash(j, seed) * F.lit(MODULUS) + key_hash(j, seed + 1), n)


def undersample(df: DataFrame, id: str, y: str, fractions: dict, seed: int) -> DataFrame:
    """Per class the first ``max(floor(n * fraction), smallest class)`` rows in hash order; other classes stay whole."""
    sizes = class_sizes(df, y)
    least = sizes.agg(F.min("_n").alias("_least"))
    fraction = F.lit(1.0)
    for level, f in fractions.items():
        fraction = F.when(F.col(y) == F.lit(level), F.lit(float(f))).otherwise(fraction)
    target = attach_row(sizes, least).withColumn("_target", F.greatest(F.floor(F.col("_n") * fraction), F.col("_least")))
    placed = join_on(hash_positions(df, id, seed, [y], "_pos"), target.select(y, "_target"), [y])
    return placed.filter(F.col("_pos") <= F.col("_target")).drop("_pos", "_target")


def oversample(df: DataFrame, id: str, y: str, seed: int) -> DataFrame:
    """Every smaller class is redrawn with replacement up to the size of the largest, whose rows stay as they are.

    ``draw`` numbers the drawn rows of a class; it is NULL for rows kept as they are.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(y).count().collect()}
    top = max(sizes.values())
    small = {c: n for c, n in sizes.items() if n < top}
    kept = df.filter(~F.col(y).isin(list(small))).withColumn("draw", F.lit(None).cast("bigint"))
    if not small:
        return kept
    numbered = hash_positions(df.filter(F.col(y).isin(list(small))), id, seed, [y], "_pos")
    classes = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(n).cast("bigint").alias("n")) for c, n in small.items()]))
    draws = df.sparkSession.range(top).withColumnRenamed("id", "draw").withColumn("_class", classes)
    draws = draws.select("draw", F.col("_class.c").alias("_c"), (draw(F.col("draw"), F.col("_class.n"), seed + 2) + 1).alias("_p"))
    drawn = draws.join(numbered, (F.col("_c") == F.col(y)) & (F.col("_p") == F.col("_pos"))).drop("_c", "_p", "_pos")
    return kept.unionByName(drawn)


def subsample(df: DataFrame, id: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement."""
    return hash_positions(df, id, seed, name="_pos").filter(F.col("_pos") <= n).drop("_pos")


def swap_noise(df: DataFrame, id: str, columns: list[str], ratio: float, seed: int) -> DataFrame:
    """In each column ``floor(ratio * n)`` rows take the value of a drawn row of the same column."""
    size = df.agg(F.count(F.lit(1)).alias("_size"))
    donors = hash_positions(df.select(id, *columns), id, seed, name="_row").drop(id)
    out = attach_row(df, size)
    for i, c in enumerate(columns):
        out = hash_positions(out, id, seed + 11 * (i + 1), name="_pos")
        noisy = F.col("_pos") <= F.floor(F.lit(float(ratio)) * F.col("_size"))
        probe = F.when(noisy, draw(F.col("_pos"), F.col("_size"), seed + 5 + i) + 1).otherwise(-F.col("_pos"))
        value = donors.select(F.col("_row").alias("_probe"), F.col(c).alias("_donor"))
        out = out.withColumn("_probe", probe).join(value, "_probe", "left")
        out = out.withColumn(c, F.when(F.col("_probe") > 0, F.col("_donor")).otherwise(F.col(c))).drop("_probe", "_donor", "_pos")
    return out.select(*df.columns)
