"""Queries of the operators on the given tables: each maps a table to an operator's interface and its result back."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.llm import (
    conversations, licences, mixing, pieces, pii, posting_lists, simhash, superkmers, tiling, token_files, toxicity, url_templates, whitening,
)
from foldwise.llm.inputs import MIX_WEIGHTS, PIECES, TOKENIZER, pool_of, table, toxicity_model


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as records: ``(entry_id, body)``."""
    return table(spark, sf_dir, "documents", ["doc_id", "text"]).toDF("entry_id", "body")


def op1_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = documents(spark, sf_dir)
    found = pii.find_pii(records, pii.fit_on(records))
    joined = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        F.col("entry_id").alias("doc_id"), *[number(k) for k in pii.KINDS],
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), radius=4, blocks=6, width=4)
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select(F.col("entry_id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = superkmers.remove_repeats(documents(spark, sf_dir), window=13)
    return found.select(F.col("entry_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    weights = spark.createDataFrame(MIX_WEIGHTS, "node string, weight bigint")
    drawn = mixing.mix(
        pool_of(docs), weights, share=(1, 2), max_epochs=2, seed=7, levels=("domain", "lang", "source")
    )
    return drawn.withColumnRenamed("entry_id", "doc_id")


def _mix_sql() -> str:
    rows = ", ".join(f"('{n}', {w})" for n, w in MIX_WEIGHTS)
    fills, above = "", "(select '' as node, (select cast(sum(have) as bigint) // 2 from leaves) as budget)"
    for k in range(3):
        parent = "''" if k == 0 else f"p{k - 1}"
        fills += f"""
child{k} as (select {parent} as parent, p{k} as node, w{k} as weight, cast(sum(capacity) as hugeint) as capacity
  from tree where capacity > 0 group by all),
ranked{k} as (select c.*, cast(a.budget as hugeint) as given,
    coalesce(sum(capacity) over (o rows between unbounded preceding and 1 preceding), 0) as used,
    sum(weight) over (o rows between current row and unbounded following) as onward
  from child{k} c join {above} a on c.parent = a.node
  window o as (partition by c.parent order by capacity::double / weight::double, c.node)),
full{k} as (select *, capacity * onward <= (given - used) * weight as is_full from ranked{k}),
rest{k} as (select *, given - sum(case when is_full then capacity else 0 end) over (partition by parent) as rest,
    sum(case when is_full then 0 else weight end) over (partition by parent) as open_weight,
    sum(weight) over (partition by parent, is_full order by node rows unbounded preceding) as upto from full{k}),
node{k} as (select node, cast(case when is_full then capacity
    else (rest * upto) // open_weight - (rest * (upto - weight)) // open_weight end as bigint) as budget from rest{k}),"""
        above = f"node{k}"
    return rf"""
with pool as (
  select doc_id, case coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') as bigint), 0) % 3
      when 1 then 'books' when 2 then 'code' else 'web' end as domain,
    coalesce(lang, 'NULL') as lang, coalesce(source, 'NULL') as source,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) as bigint) as n_tokens from documents),
weights(node, weight) as (values {rows}),
leaves as (select domain, lang, source, cast(sum(n_tokens) as bigint) as have from pool group by all),
tree as (
  select l.*, l.domain as p0, concat_ws('/', domain, lang) as p1, concat_ws('/', domain, lang, source) as p2,
    coalesce(a.weight, 1) as w0, coalesce(b.weight, 1) as w1, coalesce(c.weight, 1) as w2, have * 2 as capacity
  from leaves l left join weights a on a.node = l.domain left join weights b on b.node = concat_ws('/', domain, lang)
    left join weights c on c.node = concat_ws('/', domain, lang, source)),{fills}
budgets as (select t.domain, t.lang, t.source, t.have, n.budget from tree t join node2 n on t.p2 = n.node
  where n.budget > 0 and have > 0),
drawn as (select p.*, b.budget // b.have as epochs, b.budget % b.have as rest from pool p join budgets b using (domain, lang, source)),
placed as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source
    order by md5(concat_ws(':', '7', epochs, doc_id)), doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) as before
  from drawn)
select doc_id, domain, lang, source, n_tokens, cast(epoch as int) as epoch, n_tokens as taken
from (select *, unnest(range(0, epochs)) as epoch from placed)
union all
select doc_id, domain, lang, source, n_tokens, cast(epochs as int), cast(least(n_tokens, rest - before) as bigint)
from placed where rest > before
"""


def op4_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark", ["item_id", "text"]).toDF("item_id", "body")
    found = tiling.leaks(documents(spark, sf_dir), items, shortest=3, threshold=0.8)
    return found.withColumnRenamed("entry_id", "doc_id")


OP5_SQL = r"""
with split as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
  from documents),
windows as (
  select doc_id, unnest(range(1, len(words) - 11)) as pos, words from split where len(words) >= 13),
keyed as (select doc_id, pos, array_to_string(words[pos:pos + 12], ' ') as w from windows),
earliest as (select w, min(doc_id) as first_id from keyed group by w having min(doc_id) < max(doc_id)),
covered as (
  select distinct k.doc_id, unnest(range(k.pos, k.pos + 13)) as pos
  from keyed k join earliest e on k.w = e.w and k.doc_id > e.first_id),
numbered as (
  select s.doc_id, unnest(range(1, len(words) + 1)) as pos, unnest(words) as word from split s),
kept as (
  select n.doc_id, string_agg(n.word, ' ' order by n.pos) as kept, count(*) as n_kept
  from numbered n anti join covered c on n.doc_id = c.doc_id and n.pos = c.pos group by n.doc_id)
select s.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n_kept, 0) as bigint) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from split s left join kept k on s.doc_id = k.doc_id
"""


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.token_round_trip(documents(spark, sf_dir), TOKENIZER, end_id=2)
    return found.select(F.col("entry_id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    found = toxicity.severity(docs, toxicity_model(docs, labels), "doc_id", "text")
    return found.select(
        F.col("entry_id").alias("doc_id"), F.col("severity").alias("expected_severity"), "grade", F.col("rejected").alias("toxic")
    )


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(documents(spark, sf_dir))
    distinct = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        F.col("entry_id").alias("doc_id"), "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        distinct(F.col("phrase_labels")).alias("base_labels"),
        distinct(F.concat("phrase_labels", "template_labels")).alias("labels"), "score",
    )


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_templates.judge_links(table(spark, sf_dir, "pages", ["page_id", "url"]), RULES, "page_id", "url")
    return found.select(F.col("entry_id").alias("page_id"), "host", "path", "rule", "verdict")


def op10_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]).toDF("id", "features")
    found = posting_lists.nearest_rows(vectors, vectors.filter(F.col("id") % 100 == 0), k=10)
    return found.select("query_id", "rank", F.col("entry_id").alias("vec_id"), F.col("distance").alias("score"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    found = conversations.repair(conversations.damage(turns), "conversation")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = found.select("conversation", *counts, "audit", F.sha2("repaired", 256).alias("digest"))
    all_ids = turns.select("conv_id").distinct()
    joined = all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("conversation")), "left")
    return joined.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.piece_round_trip(documents(spark, sf_dir), PIECES)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(
        F.col("entry_id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    rows = rows.select(F.col("vec_id").alias("id"), whitening.quantised(F.col("embedding")).alias("features"))
    found = whitening.whiten(rows, components=32).withColumnRenamed("id", "vec_id")
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_semi_markov_pii, op2_simhash_near_duplicates, op3_source_mix, op4_greedy_string_tiling, op5_substring_dedup,
        op6_toxicity_severity, op7_token_files, op8_licence_scan, op9_url_templates, op10_posting_lists,
        op11_conversation_repair, op12_sentencepiece, op13_whitening, pipeline,
    )
    return {f.__name__: f for f in found}


def oracles() -> dict[str, str]:
    return {
        "op3_source_mix": _mix_sql(),
        "op5_substring_dedup": OP5_SQL,
        "op9_url_templates": url_templates.oracle(RULES, "pages", "page_id", "url"),
    }
