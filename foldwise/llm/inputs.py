"""What the queries and the corpus pipeline share: tables, the pool of sources, target weights, the fitted severity model."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.llm import mixing, toxicity
from foldwise.sources.tables import read_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


#: Bytes of an Arrow batch that a worker is handed. Spark's 64 MB hold a whole task's texts, and several copies of them are alive at once
#: in the executor (buffers, stream) and in each worker (batch, texts, result).
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session's jobs by bytes, unless the session has a bound of its own. It stays, since the jobs of
    a lazy frame run after the call that made it."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """``bound_batches`` for the jobs run inside alone."""
    before = spark.conf.get(BATCH_SETTING, None)
    bound_batches(spark)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_SETTING)


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", format="parquet", columns=columns)


#: Target weights of the mix: whole numbers per node of the domain-language-source tree; sources weigh alike.
MIX_WEIGHTS = [
    ("web", 5), ("books", 3), ("code", 2),
    *[(f"{d}/{l}", w) for d in ("web", "books", "code") for l, w in (("en", 4), ("de", 2), ("fr", 2), ("es", 1))],
]


def pool_of(docs: DataFrame) -> DataFrame:
    """Documents as a pool: a domain by source number, language, source and words."""
    number = F.try_to_number(F.regexp_extract("source", "([0-9]{1,9})$", 1), F.lit("999999999")) % 3
    domain = F.when(number == 1, "books").when(number == 2, "code").otherwise("web")
    return docs.select(
        F.col("doc_id").alias("entry_id"), domain.alias("domain"), "lang", "source", mixing.words_in(F.col("text")).alias("n_tokens")
    )


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.OrdinalModel:
    """Fitted on a bounded sample of labelled documents: unmarked ones have grade 0, marked ones are spread over grades 1 to 3."""
    marks = labels.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    sample = toxicity.labelled_sample(docs, marks, "toxic", "doc_id", "text", rows=toxicity.SAMPLE_ROWS)
    return toxicity.fit_model(sample, levels=3)
