"""Calendar, daily series, group bounds, duplicate collapse, and Markdown records made from the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import records as R
from foldwise.operators import series as S
from foldwise.plans.cases import case, rounded, with_base


@case("calendar_features", """
select o_orderkey, cast(extract(year from o_orderdate) as int) as year, cast(extract(month from o_orderdate) as int) as month, cast(extract(day from o_orderdate) as int) as day,
 cast(extract(dow from o_orderdate) + 1 as int) as weekday, cast(extract(doy from o_orderdate) as int) as yearday,
 round(sin(2 * pi() * extract(month from o_orderdate) / 12.0e0), 6) + 0.0e0 as month_sin1, round(cos(2 * pi() * extract(month from o_orderdate) / 12.0e0), 6) + 0.0e0 as month_cos1,
 round(sin(2 * pi() * extract(doy from o_orderdate) / 365.0e0), 6) + 0.0e0 as yearday_sin1, round(cos(2 * pi() * extract(doy from o_orderdate) / 365.0e0), 6) + 0.0e0 as yearday_cos1 from orders""")
def _(t):
    return rounded(S.calendar_features(t.table("orders", ["o_orderkey", "o_orderdate"]), "o_orderdate").drop("o_orderdate"), [])


def frame_sql(name, frame):
    w = f"over (partition by user_id order by d {frame})"
    return f"""round(avg(v) {w}, 10) as {name}_mean, round(var_samp(v) {w}, 10) as {name}_var, round(median(v) {w}, 10) as {name}_median,
 round(min(v) {w}, 10) as {name}_min, round(max(v) {w}, 10) as {name}_max"""


@case("rolling_day_features", f"""
with s as (select user_id, cast(cast(ts as date) - date '1970-01-01' as int) as d, avg(value) as v, count(*) as n from events group by all)
select user_id, d as _day, round(v, 10) as value, n, round(lag(v) over (partition by user_id order by d), 10) as previous,
{frame_sql('last3', 'range between 3 preceding and 1 preceding')}, {frame_sql('last5', 'range between 5 preceding and 1 preceding')}, {frame_sql('last10', 'range between 10 preceding and 1 preceding')}, {frame_sql('before', 'rows between unbounded preceding and 1 preceding')} from s""")
def _(t):
    out = S.rolling_features(S.daily(t.table("events"), ["user_id"], "ts", "value"), ["user_id"], [3, 5, 10])
    return rounded(out, [], 10)


@case("factor_decomposition", with_base("""
, a as (select seg, avg(price) / (select avg(price) from base) as e from base group by seg), r1 as (select id, nat, price / e as r from base join a using (seg)),
b as (select nat, avg(r) / (select avg(r) from r1) as e from r1 group by nat)
select 'seg' as factor, seg as level, round(e, 6) as effect from a union all select 'nat', cast(nat as varchar), round(e, 6) from b"""))
def _(t):
    return rounded(S.factor_decompose(t.base(), "price", ["seg", "nat"])[1], [])


@case("group_bounds", with_base("""
, g as (select nat, seg, quantile_cont(price, 0.25) as a, quantile_cont(price, 0.75) as b, min(price) as lo, count(*) as n from train group by all having count(*) > 5)
select id, round(greatest(least(bal * 60.0e0, coalesce(b + 1.5e0 * 0.8e0 * (b - a), bal * 60.0e0)), coalesce(lo, bal * 60.0e0)), 4) as p from base left join g using (nat, seg)"""))
def _(t):
    df = t.base().withColumn("p", F.col("bal") * 60.0)
    return rounded(S.clip_by_group(df, "p", t.base("train"), ["nat", "seg"], "price", 0.8).select("id", "p"), [], 4)


@case("iqr_outlier_flag", """
with q as (select quantile_cont(o_totalprice, 0.25) as a, quantile_cont(o_totalprice, 0.75) as b from orders)
select o_orderkey, cast(o_totalprice > b + 0.4e0 * (b - a) as int) as o_totalprice_outlier from orders, q""")
def _(t):
    return S.iqr_flag(t.table("orders", ["o_orderkey", "o_totalprice"]), "o_totalprice", 0.4).drop("o_totalprice")


@case("duplicate_collapse", with_base("select pri, seg, nat, round(avg(y), 6) as y, count(*) as weight from base group by all"))
def _(t):
    return rounded(S.collapse_duplicates(t.base(), ["pri", "seg", "nat"], "y"), [])


# ---------------------------------------------------------------------------------------------------------------
# records: every document becomes a Markdown file with one entry, some of them with planted defects

TAGS = R.PRIMARY_TAGS


def entry_id(doc):
    return F.concat(F.lit("S"), (doc % 6 + 1).cast("string"), F.lit("E"), (F.floor(doc / 6) % 12 + 1).cast("string"), F.lit("-"), (F.floor(doc / 72) + 1).cast("string"))


ENTRY_SQL = "'S' || (doc_id % 6 + 1) || 'E' || ((doc_id // 6) % 12 + 1) || '-' || (doc_id // 72 + 1)"


def markdown(t):
    d = t.table("documents", ["doc_id", "text", "n_chars"])
    doc = F.col("doc_id")
    primary = F.element_at(F.array(*[F.lit(x) for x in TAGS]), (doc % 9 + 1).cast("int"))
    primary = F.when(doc % 83 == 7, "OTHER").otherwise(primary)
    extra = F.concat(F.when(doc % 3 == 0, " `adv`").otherwise(""), F.when(F.col("n_chars") % 2 == 0, " `rank-blend`").otherwise(""))
    link = F.when(doc % 101 == 5, "").otherwise(F.concat(F.lit("- **Link:** doc/"), doc.cast("string"), F.lit("\n")))
    one = F.concat(F.lit("\n## "), entry_id(doc), F.lit("\n"), link, F.lit("- **Architecture:** `"), primary, F.lit("`"), extra,
                   F.lit(" stages="), (doc % 4 + 1).cast("string"), F.lit("\n\n"))
    text = F.concat(F.lit("# Digest\n"), one, F.col("text"), F.lit("\n"), F.when(doc % 97 == 3, one).otherwise(F.lit("")))
    return d.select(doc.alias("source"), text.alias("text"))


RECORD_SQL = """with r as (select doc_id, """ + ENTRY_SQL + """ as entry_id, case when doc_id % 83 = 7 then 'OTHER' else (['""" + "', '".join(TAGS) + """'])[doc_id % 9 + 1] end as primary_tag,
 list_concat(case when doc_id % 3 = 0 then ['adv'] else [] end, case when n_chars % 2 = 0 then ['rank-blend'] else [] end) as mods, unnest(range(case when doc_id % 97 = 3 then 2 else 1 end)) as copy from documents)"""


@case("record_parsing", RECORD_SQL + """
select doc_id as source, entry_id, cast(doc_id % 6 + 1 as int) as season, cast((doc_id // 6) % 12 + 1 as int) as episode, cast(doc_id // 72 + 1 as int) as rank, primary_tag as "primary",
 array_to_string(mods, ',') as modifiers, cast(doc_id % 4 + 1 as int) as stages from r""")
def _(t):
    parsed = R.parse_records(markdown(t), "text", "source")
    return parsed.withColumn("modifiers", F.array_join("modifiers", ",")).drop("body")


@case("tag_rollup", RECORD_SQL + """
, p as (select cast(doc_id % 6 + 1 as int) as season, primary_tag as "primary", cast(doc_id // 72 + 1 as int) as rank from r)
select season, "primary", count(*) as entries, min(rank) as best_rank, cast(grouping(season) * 2 + grouping("primary") as int) as level from p group by rollup (season, "primary")""")
def _(t):
    return R.tag_rollup(R.parse_records(markdown(t), "text", "source"))


@case("modifier_counts", RECORD_SQL + ", m as (select unnest(mods) as modifier from r) select modifier, count(*) as entries from m group by modifier")
def _(t):
    return R.modifier_counts(R.parse_records(markdown(t), "text", "source"))


@case("record_checks", RECORD_SQL + """
, i as (select distinct entry_id from r where doc_id % 89 <> 4 union all select 'S9E9-' || doc_id from documents where doc_id % 250 = 1),
c as (select entry_id, count(*) as n from r group by entry_id)
select case when i.entry_id is null then 'unknown id' when c.n is null then 'missing entry' else 'repeated entry' end as kind, coalesce(i.entry_id, c.entry_id) as item
 from i full join c on i.entry_id = c.entry_id where i.entry_id is null or c.n is null or c.n > 1
union all select 'no Link', entry_id from r where doc_id % 101 = 5
union all select 'unknown tag', entry_id from r where primary_tag = 'OTHER'
union all select 'ledger rows', cast(doc_id as varchar) from documents where doc_id % 120 = 9 or doc_id % 130 = 11""")
def _(t):
    records = R.parse_records(markdown(t), "text", "source")
    docs = t.table("documents", ["doc_id"])
    index = docs.filter("doc_id % 89 <> 4").select(entry_id(F.col("doc_id")).alias("entry_id"))
    extra = docs.filter("doc_id % 250 = 1").select(F.concat(F.lit("S9E9-"), F.col("doc_id").cast("string")).alias("entry_id"))
    rows = F.when(F.col("doc_id") % 120 == 9, 0).when(F.col("doc_id") % 130 == 11, 2).otherwise(1)
    ledger = docs.select(F.col("doc_id").alias("source"), F.explode(F.array_repeat(F.lit("AUDITED"), rows)).alias("status"))
    return R.check_records(records, index.unionByName(extra), ledger, ["Link", "Architecture"])
