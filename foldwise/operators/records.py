"""Tagged Markdown records: parsing, tag roll-up and consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The record format. An entry starts with a heading holding its id (season, episode, rank) and lists
# its fields as bold labels; the architecture field holds one primary tag and further modifier tags in backquotes.
ENTRY_ID = r"S\d+E\d+-\d+"
HEADING = r"(?m)^#+ +(?=S\d+E\d+-\d+)"
PRIMARY_TAGS = ["SINGLE", "SEED", "FLAT", "STACK2", "STACKN", "CASCADE", "PSEUDO", "AUTOML", "AGENT"]


def field(text, label: str):
    return F.regexp_extract(text, rf"(?m)^[-* ]*\*\*{label}:\*\* *(.*)$", 1)


def parse_records(df: DataFrame, text: str, source: str) -> DataFrame:
    """One row per entry: ``(source, entry_id, season, episode, rank, primary, modifiers, stages, body)``."""
    entry = F.explode(F.filter(F.split(F.col(text), HEADING), lambda s: s.rlike(f"^{ENTRY_ID}")))
    rows = df.select(F.col(source).alias("source"), entry.alias("body"))
    rows = rows.withColumn("entry_id", F.regexp_extract("body", f"^({ENTRY_ID})", 1))
    line = field(F.col("body"), "Architecture")
    tags = F.regexp_extract_all(line, F.lit("`([^`]+)`"), F.lit(1))
    rows = rows.withColumn("_tags", tags)
    return rows.select(
        "source",
        "entry_id",
        F.regexp_extract("entry_id", r"^S(\d+)E", 1).cast("int").alias("season"),
        F.regexp_extract("entry_id", r"E(\d+)-", 1).cast("int").alias("episode"),
        F.regexp_extract("entry_id", r"-(\d+)$", 1).cast("int").alias("rank"),
        F.try_element_at("_tags", F.lit(1)).alias("primary"),
        F.slice("_tags", F.lit(2), F.greatest(F.size("_tags"), F.lit(1))).alias("modifiers"),
        F.expr("try_cast(regexp_extract(body, 'stages[:=] *([0-9]+)', 1) as int)").alias("stages"),
        "body",
    )


def tag_rollup(records: DataFrame) -> DataFrame:
    """Entries and best rank per season and primary tag, with season and overall totals (NULL levels)."""
    return records.rollup("season", "primary").agg(
        F.count(F.lit(1)).alias("entries"), F.min("rank").alias("best_rank"), F.grouping_id().cast("int").alias("level")
    )


def modifier_counts(records: DataFrame) -> DataFrame:
    """Entries per modifier tag."""
    return records.select(F.explode("modifiers").alias("modifier")).groupBy("modifier").agg(F.count(F.lit(1)).alias("entries"))


def check_records(records: DataFrame, index: DataFrame, ledger: DataFrame, required: list[str]) -> DataFrame:
    """Defects as ``(kind, item)``: ids of the index that are missing or repeated, unknown ids, entries without a
    required field, unknown primary tags, and sources without exactly one ledger row."""
    counts = records.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"))
    ids = index.select("entry_id").distinct()
    matched = ids.withColumn("_in", F.lit(1)).join(counts, "entry_id", "full_outer")
    kind = (
        F.when(F.col("_in").isNull(), "unknown id").when(F.col("n").isNull(), "missing entry").when(F.col("n") > 1, "repeated entry")
    )
    defects = [matched.select(kind.alias("kind"), F.col("entry_id").alias("item")).filter("kind is not null")]
    for label in required:
        empty = records.filter(field(F.col("body"), label) == "")
        defects.append(empty.select(F.lit(f"no {label}").alias("kind"), F.col("entry_id").alias("item")))
    odd = records.filter(F.col("primary").isNull() | ~F.col("primary").isin(PRIMARY_TAGS))
    defects.append(odd.select(F.lit("unknown tag").alias("kind"), F.col("entry_id").alias("item")))
    rows = ledger.groupBy("source").agg(F.count(F.lit(1)).alias("_rows"))
    files = records.select("source").distinct().join(rows, "source", "left")
    unlisted = files.filter(F.coalesce(F.col("_rows"), F.lit(0)) != 1)
    defects.append(unlisted.select(F.lit("ledger rows").alias("kind"), F.col("source").cast("string").alias("item")))
    out = defects[0]
    for d in defects[1:]:
        out = out.unionByName(d)
    return out
