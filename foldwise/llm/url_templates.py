"""Verdicts on links by host rules and, beyond them, by a path-template tree per host."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldwise.kernels.scan import join_on
from foldwise.kernels.store import materialize
from foldwise.llm.columns import quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A segment is a literal branch if it has this share (1/20) of its parent's links, and more than one.
LITERAL_SHARE = 20
#: Labelled links that a branch needs before it is compared with its siblings.
LEAST_LABELLED = 5
#: Squared z value up to which two branches count as similar (95 %).
SIMILAR = 3.84
#: A template is rejected from this smoothed share of bad links on.
REJECT_AT = 0.8


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """``(rule, action)`` of the longest rule that fits, NULL without one; of equally long ones the first in text order.

    A rule such as ``example.net/en/`` fits its host and all subdomains if the path starts with ``/en/``.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(action)
    return rule, action


def _branches(links: DataFrame) -> DataFrame:
    """``(node, segment, step)`` of the literal branches of one level; ``step`` names the branch after merging.

    A parent has at most ``LITERAL_SHARE`` of them, so the windows below are small. In order of their share of bad links,
    neighbours that a two-proportion test does not tell apart become one branch; branches with few labels stay alone.
    """
    child = links.groupBy("node", "segment").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    child = materialize(child)
    whole = child.groupBy("node").agg(F.sum("n").alias("all_n"))
    literal = child.filter(F.col("n") > 1).join(whole, "node").filter(F.col("n") * LITERAL_SHARE >= F.col("all_n"))
    literal = literal.select(
        "node", "segment", (F.col("known") >= LEAST_LABELLED).alias("tested"), F.col("known").cast("double").alias("k"),
        F.col("bad").cast("double").alias("b"),
    )
    order = W.partitionBy("node", "tested").orderBy(F.try_divide("b", "k"), "segment")
    k, b, k0, b0 = F.col("k"), F.col("b"), F.lag("k").over(order), F.lag("b").over(order)
    apart = b * k0 - b0 * k
    similar = apart * apart * (k + k0) <= F.lit(SIMILAR) * k * k0 * (b + b0) * (k + k0 - b - b0)
    literal = literal.withColumn("starts", F.when(F.col("tested") & similar, 0).otherwise(1))
    group = F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    literal = literal.withColumn("group", group)
    members = F.array_sort(F.collect_list("segment").over(W.partitionBy("node", "tested", "group")))
    step = F.when(F.size(members) > 1, F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))).otherwise(F.col("segment"))
    return literal.select("node", "segment", step.alias("step"))


def judge_links(
    links: DataFrame, rules: list[tuple[str, str]], id: str = "entry_id", url: str = "url", label: str | None = None
) -> DataFrame:
    """``(entry_id, host, path, rule, verdict, template, purity)``, one row per link.

    ``links`` are the writeup links, ``entry_id`` and ``url``, or any rows with an id and a URL; ``rules`` are pairs of
    ``allow`` or ``block`` and a rule, a stated list that becomes one expression. The longest fitting rule decides. For every
    other link the template of its path does: below each host, a segment that holds little of its parent's links becomes
    ``*``, and literal branches whose labelled shares of bad links a two-proportion test does not tell apart become one, such
    as ``{de,en}``. Rounds go level by level over counts per distinct host and path, of which only those with a further segment and
    company at their node go on: a path that is alone there, however deep, has its template at once. ``purity`` is the template's
    share of bad links, smoothed by one good and one bad link; from ``REJECT_AT`` on the verdict is ``block``, else ``allow``. Labels are the column ``label`` (1 bad, 0 good, NULL unknown), or
    else the rules' own decisions.

    Only counts per branch are compared, so a host with a third of all links is summed up before it meets itself. NULL URLs
    and URLs without ``://`` have an empty host and path and form one template. Repeated rows and NULL ids each keep their
    row.
    """
    address = quoted(url).cast("string")
    base = links.select(
        quoted(id).alias("entry_id"), host_of(address).alias("host"), path_of(address).alias("path"),
        (F.lit(None) if label is None else quoted(label)).cast("int").alias("bad"),
    )
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "action": action})
    if label is None:
        base = base.withColumn("bad", F.when(F.col("action").isNotNull(), (F.col("action") == "block").cast("int")))
    base = materialize(base)
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    paths = base.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    open_paths = materialize(paths.withColumns({"segments": segments, "node": F.col("host")}))
    done = []
    while True:
        single = open_paths.groupBy("node").count().filter(F.col("count") == 1).select("node", F.lit(True).alias("single"))
        marked = materialize(join_on(open_paths, single, ["node"]).withColumn("single", F.coalesce("single", F.lit(False)) | (F.size("segments") == 0)))
        rest = F.when(F.col("n") > 1, F.col("segments")).otherwise(F.transform("segments", lambda s: F.lit("*")))
        ended = marked.filter("single")
        done.append(ended.select("host", "path", "known", "bad", F.array_join(F.concat(F.array("node"), rest), "/").alias("template")))
        going = marked.filter(~F.col("single")).drop("single").withColumn("segment", F.element_at("segments", 1))
        if going.isEmpty():
            break
        placed = join_on(going, _branches(going), ["node", "segment"])
        below = F.concat_ws("/", "node", F.coalesce("step", F.lit("*")))
        onward = F.slice("segments", 2, F.size("segments"))
        open_paths = materialize(placed.withColumns({"node": below, "segments": onward}).select(*open_paths.columns))
    tree = reduce(lambda a, b: a.unionByName(b), done)
    counts = tree.groupBy("template").agg(F.sum("known").alias("known"), F.sum("bad").alias("n_bad"))
    purity = (F.col("n_bad") + 1).cast("double") / (F.col("known") + 2).cast("double")
    named = join_on(tree.select("host", "path", "template"), counts.select("template", purity.alias("purity")), ["template"])
    judged = join_on(base, materialize(named), ["host", "path"])
    verdict = F.coalesce("action", F.when(F.col("purity") >= REJECT_AT, "block").otherwise("allow"))
    return judged.select("entry_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def oracle(rules: list[tuple[str, str]], table: str, id: str, url: str, levels: int = 3) -> str:
    """The same judgement, with the rules' decisions as labels, as DuckDB SQL.

    SQL has no loop over levels: it spells out ``levels`` of them and is the same judgement only where no path has more segments.
    """
    rule = action = "null"
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = text.partition("/")
        fits = f"(host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{slash + rest}')"
        rule, action = f"case when {fits} then '{text}' else {rule} end", f"case when {fits} then '{verdict}' else {action} end"
    steps = ""
    for level in range(levels):
        steps += f"""
at{level} as (select *, segments[{level + 1}] as segment from tree{level}),
child{level} as (select node, segment, count(*) as n, count(bad) as known, coalesce(sum(bad), 0) as bad
  from at{level} where segment is not null group by node, segment),
literal{level} as (select node, segment, known >= {LEAST_LABELLED} as tested, known::double as k, bad::double as b
  from (select *, sum(n) over (partition by node) as all_n from child{level}) where n > 1 and n * {LITERAL_SHARE} >= all_n),
near{level} as (select *, lag(k) over o as k0, lag(b) over o as b0, case when k > 0 then b / k end as rate from literal{level}
  window o as (partition by node, tested order by case when k > 0 then b / k end nulls first, segment)),
starts{level} as (select *, case when tested and (b * k0 - b0 * k) * (b * k0 - b0 * k) * (k + k0)
    <= {SIMILAR}e0 * k * k0 * (b + b0) * (k + k0 - b - b0) then 0 else 1 end as starts from near{level}),
grouped{level} as (select *, sum(starts) over (partition by node, tested order by rate nulls first, segment rows unbounded preceding) as g
  from starts{level}),
kept{level} as (select node, segment, case when count(*) over p > 1
    then '{{' || array_to_string(list_sort(list(segment) over p), ',') || '}}' else segment end as step
  from grouped{level} window p as (partition by node, tested, g)),
tree{level + 1} as (select a.* exclude (node, segment),
    case when a.segment is null then a.node else concat(a.node, '/', coalesce(k.step, '*')) end as node
  from at{level} a left join kept{level} k on a.node = k.node and a.segment = k.segment),"""
    return rf"""
with parts as (
  select {id}, translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
    coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from {table}),
ruled as (select *, {rule} as rule, {action} as action from parts),
tree0 as (select *, case when action is not null then cast(action = 'block' as int) end as bad,
  list_filter(string_split(path, '/'), lambda s: s <> '') as segments, host as node from ruled),{steps}
named as (select *, case when len(segments) > {levels} then concat(node, '/**') else node end as template from tree{levels}),
counts as (select template, (sum(bad) + 1)::double / (count(bad) + 2)::double as purity
  from named where bad is not null group by template)
select {id}, host, path, rule,
  coalesce(action, case when coalesce(purity, 0.5) >= {REJECT_AT} then 'block' else 'allow' end) as verdict
from named n left join counts c on n.template = c.template
"""
