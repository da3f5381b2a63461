"""Preparation of a training corpus: documents that stay and their token ids.

Every stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept; all but the last return the columns of
``documents``. Documents without an id cannot be named by a group, so the near-duplicate stage keeps them; rows that share an id
and a text are one document there. NULL texts are empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.kernels.store import materialize
from foldwise.llm import mixing, near_copies, tiling, token_files, toxicity
from foldwise.llm.inputs import MIX_WEIGHTS, TOKENIZER, bound_batches, bounded_batches, pool_of, table, toxicity_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """``stage`` in a session whose Arrow batches are bounded by bytes from then on, see ``bound_batches``."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity grade is more likely above 0 than not go."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels", ["doc_id", "toxic"]))
    return toxicity.keep_clean(docs, model, "text")


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names that no column of ``docs`` has, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    mark = next(k for k in range(len(taken) + 1) if not any(f"{w}_{k}" in taken for w in wanted))
    return [f"{w}_{mark}" for w in wanted]


@in_small_batches
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more (five-word shingles) the smallest id's document stays."""
    key, of, what = free_names(docs, "text_key", "kept_id", "kept_key")
    rows, groups = near_copies.near_copies(docs, "doc_id", "text", width=5)
    row = F.when(F.col("entry_id").isNotNull(), F.struct(F.col("entry_id").alias(of), F.col("text_key").alias(what)))
    first = rows.groupBy("node").agg(F.min(row).alias("first")).join(groups, "node", "left")
    kept = first.groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first")).select("first.*")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    named = keyed.join(kept, (F.col("doc_id") == F.col(of)) & (F.col(key) == F.col(what)), "left_semi")
    named = named.dropDuplicates(["doc_id", key]).drop(key)
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))


@in_small_batches
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover four fifths of a benchmark item go."""
    return tiling.remove_leaks(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]), "text", item_body="text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the words that are left, shared out by target weights; a document is taken whole or not at all."""
    weights = spark.createDataFrame(MIX_WEIGHTS, "node string, weight bigint")
    drawn = mixing.mix(
        pool_of(docs), weights, share=(9, 10), max_epochs=1, seed=7, levels=("domain", "lang", "source")
    )
    (chosen,) = free_names(docs, "chosen")
    drawn = drawn.select(F.col("entry_id").alias(chosen)).distinct()
    return docs.join(drawn, F.col("doc_id").eqNullSafe(F.col(chosen)), "left_semi")


@in_small_batches
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and per document its place, length and checksum read back from them."""
    found = token_files.token_round_trip(docs, TOKENIZER, "doc_id", "text", end_id=2)
    return found.select(F.col("entry_id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("source_mix", mix_sources),
    ("token_files", write_tokens),
]

#: SQL cannot express the fitted model, the links or the tokenizer; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result stored and reread as the next one's input. What is left to run after the
    return is the reading of the token files, whose workers are handed paths only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with bounded_batches(spark):
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
