"""Query registry and the labelled views every query starts from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foldwise.functions.hashing import MODULUS, hash_sql, key_hash
from foldwise.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` as query ``name`` with its SQL, if SQL can express it."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


class Tables:
    """The Parquet tables of one scale folder, and views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str, columns: list[str] | None = None) -> DataFrame:
        return read_table(self.spark, f"{self.sf_dir}/{name}.parquet", format="parquet", columns=columns)

    def base(self, split: str | None = None) -> DataFrame:
        """Orders with their customer: id, role, categorical keys, two numbers and a planted binary label."""
        orders = self.table("orders")
        key = F.col("o_orderkey")
        role = key % 10
        if split == "train":
            orders = orders.filter(role < 6)
        elif split == "test":
            orders = orders.filter((role >= 6) & (role < 8))
        elif split == "orig":
            orders = orders.filter(role >= 8)
        joined = orders.join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        urgency = (
            F.when(F.col("o_orderpriority") == "1-URGENT", 1.0)
            .when(F.col("o_orderpriority") == "2-HIGH", 0.5)
            .otherwise(0.0)
        )
        segment = F.when(F.col("c_mktsegment") == "BUILDING", 0.6).otherwise(0.0)
        signal = F.col("o_totalprice") / 250000.0 + urgency + segment + key_hash(key, 13) / float(MODULUS)
        return joined.select(
            key.alias("id"),
            F.when(role < 6, "train").when(role < 8, "test").otherwise("orig").alias("split"),
            F.col("o_orderpriority").alias("pri"),
            F.col("c_mktsegment").alias("seg"),
            F.col("c_nationkey").cast("bigint").alias("nat"),
            F.when(key % 17 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("price"),
            F.col("c_acctbal").alias("bal"),
            (signal > 2.2).cast("int").alias("y"),
        )

    def folded(self, k: int = 5, seed: int = 1) -> DataFrame:
        """Training rows with a hashed fold column."""
        return self.base("train").withColumn("fold", fold_of("id", k, seed))

    def ratings(self) -> DataFrame:
        """Orders with six 0..5 ratings, 0 meaning not rated."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            *[((F.col("o_orderkey") * k + F.floor("o_totalprice")) % 6).cast("int").alias(f"r{k}") for k in RATING_STEPS],
        )

    def scores(self, split: str = "train", models: int = 4) -> DataFrame:
        """Rows with ``models`` predictions that agree with the label to different degrees."""
        made = [model_score(m).alias(f"m{m}") for m in range(models)]
        rows = self.base(split).withColumn("fold", fold_of("id", 5, 1))
        return rows.select("id", "fold", "pri", "seg", "price", "bal", "y", *made)

    def archive(self, models: int = 4) -> DataFrame:
        """The same predictions in long form: model, id, pred."""
        wide = self.scores(models=models)
        return wide.select("id", *[f"m{m}" for m in range(models)]).unpivot(
            ["id"], [f"m{m}" for m in range(models)], "model", "pred"
        ).select("model", "id", "pred")


RATING_STEPS = [1, 5, 7, 11, 13, 17]


def fold_of(key: str, k: int, seed: int) -> Column:
    return (key_hash(key, seed) % k).cast("int")


def model_score(m: int) -> Column:
    """Share of the label plus hashed noise, on a grid of 1/1000 so that ties occur."""
    noise = F.floor(key_hash("id", 100 + m) * 1000 / MODULUS)
    weight = 150 + 60 * m
    return (F.lit(1.0) * F.floor((F.col("y") * weight + noise) * 1000 / (1000 + weight)) / 1000.0).cast("double")


def model_score_sql(m: int) -> str:
    weight = 150 + 60 * m
    noise = f"floor({hash_sql('id', 100 + m)} * 1000 / {MODULUS})"
    return f"(1.0e0 * floor((y * {weight} + {noise}) * 1000 / ({1000 + weight})) / 1000.0e0)"


BASE_SQL = f"""base as (
  select o_orderkey as id,
    case when o_orderkey % 10 < 6 then 'train' when o_orderkey % 10 < 8 then 'test' else 'orig' end as split,
    o_orderpriority as pri, c_mktsegment as seg, cast(c_nationkey as bigint) as nat,
    case when o_orderkey % 17 = 0 then null else o_totalprice end as price,
    c_acctbal as bal,
    cast(case when o_totalprice / 250000.0e0
      + (case when o_orderpriority = '1-URGENT' then 1.0e0 when o_orderpriority = '2-HIGH' then 0.5e0 else 0.0e0 end)
      + (case when c_mktsegment = 'BUILDING' then 0.6e0 else 0.0e0 end)
      + {hash_sql('o_orderkey', 13)} / {MODULUS}.0e0 > 2.2e0 then 1 else 0 end as int) as y
  from orders join customer on o_custkey = c_custkey),
train as (select * from base where split = 'train'),
test as (select * from base where split = 'test'),
orig as (select * from base where split = 'orig'),
folded as (select *, cast({hash_sql('id', 1)} % 5 as int) as fold from train),
ratings as (select o_orderkey as id, {', '.join(
    f"cast((o_orderkey * {k} + cast(floor(o_totalprice) as bigint)) % 6 as int) as r{k}" for k in RATING_STEPS)} from orders),
scores as (select id, fold, pri, seg, price, bal, y, {', '.join(f"{model_score_sql(m)} as m{m}" for m in range(4))}
  from folded),
archive as ({' union all '.join(f"select 'm{m}' as model, id, m{m} as pred from scores" for m in range(4))})
"""


def with_base(body: str) -> str:
    """SQL text whose CTEs are the base views; ``body`` starts with further CTEs (after a comma) or a select."""
    text = body.strip()
    return f"with {BASE_SQL}{text}" if text.startswith(",") else f"with {BASE_SQL} {text}"


def rounded(df: DataFrame, keep: list[str], digits: int = 6) -> DataFrame:
    """Round every double column outside ``keep``; negative zero becomes zero."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if field.dataType.typeName() == "double" and field.name not in keep:
            c = (F.round(c, digits) + F.lit(0.0)).alias(field.name)
        out.append(c)
    return df.select(*out)
