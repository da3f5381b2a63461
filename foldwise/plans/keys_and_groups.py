"""Composite keys, vocabularies, frequencies, lifts, group profiles and cell statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import groups as G
from foldwise.operators import keys as K
from foldwise.plans.cases import case, rounded, with_base

PRI = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def pool_of(t):
    return t.base().filter(F.col("split") != "orig")


def orig_cut(t):
    """Original rows without one cell, so that unseen keys occur."""
    return t.base("orig").filter(~((F.col("pri") == "1-URGENT") & (F.col("seg") == "BUILDING")))


CUT = """, cut as (select * from orig where not (pri = '1-URGENT' and seg = 'BUILDING')),
pool as (select * from base where split <> 'orig')"""


@case("ngram_keys", with_base("""
select id, pri || '_' || seg as pri__seg, pri || '_' || nt as pri__nt, seg || '_' || nt as seg__nt
from (select *, case when id % 13 = 0 then 'nan' else cast(nat as varchar) end as nt from base)"""))
def _(t):
    df = t.base().withColumn("nt", F.when(F.col("id") % 13 == 0, None).otherwise(F.col("nat")))
    return K.ngram_keys(df, ["pri", "seg", "nt"], 2).select("id", "pri__seg", "pri__nt", "seg__nt")


@case("trigram_keys", with_base("select id, pri || '_' || seg || '_' || cast(nat as varchar) as pri__seg__nat from base"))
def _(t):
    return K.ngram_keys(t.base(), ["pri", "seg", "nat"], 3).select("id", "pri__seg__nat")


@case("quantisation_ladder", """
select o_orderkey as id, cast(floor(round_even(o_totalprice, 0) / 10.0e0) as bigint) as p_div10,
 cast(floor(round_even(o_totalprice, 0) / 500.0e0) as bigint) as p_div500, cast(floor(round_even(o_totalprice, 0) / 5000.0e0) as bigint) as p_div5000 from orders""")
def _(t):
    df = t.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("p"))
    return K.ladder_keys(df, "p", [10, 500, 5000]).drop("p")


@case("label_encoding", with_base("""
, pool as (select * from base where split <> 'orig' and seg <> 'MACHINERY'),
vp as (select pri, dense_rank() over (order by pri) - 1 as code from (select distinct pri from pool)),
vs as (select seg, dense_rank() over (order by seg) - 1 as code from (select distinct seg from pool)),
vb as (select bal, dense_rank() over (order by bal) - 1 as code from (select distinct bal from pool))
select b.id, cast(coalesce(vp.code, -1) as int) as pri_code, cast(coalesce(vs.code, -1) as int) as seg_code, cast(coalesce(vb.code, -1) as int) as bal_code
from base b left join vp using (pri) left join vs using (seg) left join vb using (bal)"""))
def _(t):
    pool = pool_of(t).filter(F.col("seg") != "MACHINERY")
    return K.label_encode(t.base(), pool, ["pri", "seg", "bal"]).select("id", "pri_code", "seg_code", "bal_code")


@case("fit_vocabulary_encoding", with_base("""
, v as (select nat, dense_rank() over (order by nat) as code from (select distinct nat from train where nat <> 5))
select b.id, cast(coalesce(v.code, 0) as int) as nat_code from base b left join v using (nat)"""))
def _(t):
    return K.integer_encode(t.base(), t.base("train").filter("nat <> 5"), ["nat"]).select("id", "nat_code")


@case("factorize", with_base("""
, f as (select price, min(id) as first from base where price is not null group by price),
c as (select price, row_number() over (order by first) - 1 as code from f)
select b.id, cast(coalesce(c.code, -1) as int) as price_code from base b left join c using (price)"""))
def _(t):
    return K.factorize(t.base(), "price", "id").select("id", "price_code")


@case("one_hot", with_base("""
select id, cast(seg = 'BUILDING' as int) as seg_is_building, cast(seg = 'FURNITURE' as int) as seg_is_furniture from base"""))
def _(t):
    return K.one_hot(t.base(), "seg", ["BUILDING", "FURNITURE"]).select("id", "seg_is_building", "seg_is_furniture")


@case("dual_representation", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, """ + ", ".join(f"cast(l_linenumber = {i} as int) as l_linenumber_is_{i}" for i in range(1, 8)) + " from lineitem")
def _(t):
    df = t.table("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return K.one_hot(df, "l_linenumber", K.level_list(df, "l_linenumber"), keep=True)


@case("numeric_as_category", with_base("select id, cast(nat as varchar) as nat_cat, nat from base"))
def _(t):
    return K.as_category(t.base().select("id", "nat"), ["nat"])


@case("coverage_filter", with_base("""
, pool as (select pri, seg, case when id % 50 = 0 then null else nat end as nat from base where split <> 'orig' and nat <> 5 and seg <> 'MACHINERY'),
a as (select id, pri, seg, case when id % 8 = 0 then null else nat end as nat from orig)
select * from a where seg in (select seg from pool) and pri in (select pri from pool) and (nat is null or nat in (select nat from pool where nat is not null))"""))
def _(t):
    pool = pool_of(t).filter("nat <> 5 and seg <> 'MACHINERY'")
    pool = pool.withColumn("nat", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("nat")))
    a = t.base("orig").select("id", "pri", "seg", F.when(F.col("id") % 8 == 0, None).otherwise(F.col("nat")).alias("nat"))
    return K.filter_representable(a, pool, ["pri", "seg", "nat"], cap=0.5)


@case("novelty_flag", with_base("""
, o as (select distinct cast(floor(bal / 10) as bigint) as b10 from orig)
select id, case when o.b10 is null then 1 else 0 end as b10_novel from (select id, cast(floor(bal / 10) as bigint) as b10 from base) b left join o using (b10)"""))
def _(t):
    df = t.base().withColumn("b10", F.floor(F.col("bal") / 10))
    return K.novelty_flag(df, df.filter("split = 'orig'"), ["b10"]).select("id", "b10_novel")


@case("frequency_encoding", with_base("""
, pool as (select * from base where split <> 'orig'),
fp as (select pri, count(*) / (select count(*) from pool) as f from pool group by pri),
fr as (select price, count(*) / (select count(price) from pool) as f from pool where price is not null group by price)
select id, round(coalesce(fp.f, 0), 6) as pri_freq, round(coalesce(fr.f, 0), 9) as price_freq from base left join fp using (pri) left join fr using (price)"""))
def _(t):
    df = K.freq_encode(t.base(), pool_of(t), ["pri", "price"]).select("id", "pri_freq", "price_freq")
    return rounded(df.withColumn("price_freq", F.round("price_freq", 9)), ["price_freq"])


@case("count_encoding", with_base("""
, n as (select nat, count(*) as n from base group by nat) select id, n as nat_freq from base join n using (nat)"""))
def _(t):
    return K.freq_encode(t.base(), t.base(), ["nat"], normalize=False).select("id", "nat_freq")


@case("generator_lift", with_base(CUT + """
, p as (select nat, count(*) / (select count(*) from pool) as f from pool group by nat), o as (select nat, count(*) / (select count(*) from cut where nat <> 3) as f from cut where nat <> 3 group by nat)
select id, round(coalesce(coalesce(p.f, 0) / o.f, 0), 6) as nat_lift from base left join p using (nat) left join o using (nat)"""))
def _(t):
    return rounded(K.lift_encode(t.base(), pool_of(t), orig_cut(t).filter("nat <> 3"), ["nat"]).select("id", "nat_lift"), [])


@case("pair_lift", with_base(CUT + """
, p as (select pri, seg, count(*) / (select count(*) from pool) as f from pool group by all), o as (select pri, seg, count(*) / (select count(*) from cut) as f from cut group by all),
p2 as (select pri, nat, count(*) / (select count(*) from pool) as f from pool group by all), o2 as (select pri, nat, count(*) / (select count(*) from cut) as f from cut group by all),
p3 as (select seg, nat, count(*) / (select count(*) from pool) as f from pool group by all), o3 as (select seg, nat, count(*) / (select count(*) from cut) as f from cut group by all)
select id, round(coalesce(coalesce(p.f, 0) / o.f, 0), 6) as pri__seg_lift, cast(o.f is null as int) as pri__seg_novel,
 round(coalesce(coalesce(p2.f, 0) / o2.f, 0), 6) as pri__nat_lift, cast(o2.f is null as int) as pri__nat_novel,
 round(coalesce(coalesce(p3.f, 0) / o3.f, 0), 6) as seg__nat_lift, cast(o3.f is null as int) as seg__nat_novel
from base b left join p using (pri, seg) left join o using (pri, seg) left join p2 using (pri, nat) left join o2 using (pri, nat) left join p3 using (seg, nat) left join o3 using (seg, nat)"""))
def _(t):
    df = K.pair_lift(t.base(), pool_of(t), orig_cut(t), ["pri", "seg", "nat"])
    return rounded(df.drop("split", "pri", "seg", "nat", "price", "bal", "y"), [])


@case("rarity_encoding", with_base("""
, f as (select nat, count(*) / (select count(*) from train where nat <> 4) as f from train where nat <> 4 group by nat)
select id, round(-ln(greatest(coalesce(f, 0), 1.0e0 / (select count(*) from train where nat <> 4))), 6) as nat_rarity from base left join f using (nat)"""))
def _(t):
    return rounded(K.rarity_encode(t.base(), t.base("train").filter("nat <> 4"), ["nat"]).select("id", "nat_rarity"), [])


@case("group_profile", """
with pool as (select * from lineitem where l_suppkey % 10 <> 0),
g as (select l_suppkey, avg(l_quantity) as mq, stddev_samp(l_quantity) as sq, avg(l_discount) as md, stddev_samp(l_discount) as sd, count(*) as n from pool group by l_suppkey)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(mq, 8) as profile_l_quantity_mean, round(sq, 8) as profile_l_quantity_std, round(l_quantity - mq, 8) + 0.0e0 as profile_l_quantity_resid,
 round(md, 8) as profile_l_discount_mean, round(sd, 8) as profile_l_discount_std, round(l_discount - md, 8) + 0.0e0 as profile_l_discount_resid, coalesce(n, 1) as profile_count
from lineitem left join g using (l_suppkey)""")
def _(t):
    df = t.table("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"])
    out = G.group_profile(df, df.filter("l_suppkey % 10 <> 0"), "l_suppkey", ["l_quantity", "l_discount"])
    return rounded(out.drop("l_quantity", "l_discount"), [], 8)


SHARE = [(v, v.lower().replace("-", "_").replace(" ", "_")) for v in PRI]


@case("group_shares", with_base("""
, pool as (select * from base where split <> 'orig' and nat % 6 <> 0),
pr as (select """ + ", ".join(f"avg(cast(pri = '{v}' as int)) as p{i}" for i, (v, _) in enumerate(SHARE)) + """ from pool),
g as (select nat, """ + ", ".join(f"avg(cast(pri = '{v}' as int)) as g{i}" for i, (v, _) in enumerate(SHARE)) + """ from pool group by nat)
select id, """ + ", ".join(f"round(coalesce(g{i}, p{i}), 6) as share_pri_is_{n}" for i, (_, n) in enumerate(SHARE)) + " from base left join g using (nat), pr"))
def _(t):
    out = G.group_shares(t.base(), pool_of(t).filter("nat % 6 <> 0"), "nat", "pri", PRI)
    return rounded(out.drop("split", "pri", "seg", "nat", "price", "bal", "y"), [])


@case("group_share_table", with_base("""
select seg, nat, round(count(*) / cast(sum(count(*)) over (partition by seg) as double), 6) as share from base group by seg, nat"""))
def _(t):
    return rounded(G.group_share_table(t.base(), "seg", "nat"), [])


@case("group_deviation", with_base("""
, pool as (select * from base where split <> 'orig'),
a as (select pri, avg(price) as m, stddev_samp(price) as s from pool group by pri), b as (select nat, avg(bal) as m, stddev_samp(bal) as s from pool group by nat),
c as (select nat, avg(price) as m, stddev_samp(price) as s from pool group by nat), d as (select pri, avg(bal) as m, stddev_samp(bal) as s from pool group by pri)
select id, round((price - a.m) / (coalesce(a.s, 0) + 1e-6), 6) as pri_price_dev, round((bal - b.m) / (coalesce(b.s, 0) + 1e-6), 6) as nat_bal_dev,
 round((price - c.m) / (coalesce(c.s, 0) + 1e-6), 6) as nat_price_dev, round((bal - d.m) / (coalesce(d.s, 0) + 1e-6), 6) as pri_bal_dev
from base left join a using (pri) left join b using (nat) left join c using (nat) left join d using (pri)"""))
def _(t):
    out = G.group_deviation(t.base(), pool_of(t), ["pri", "nat"], ["price", "bal"])
    return rounded(out.select("id", "pri_price_dev", "pri_bal_dev", "nat_price_dev", "nat_bal_dev"), [])


@case("group_zscore", with_base("""
, g as (select seg, avg(bal) as m, stddev_samp(bal) as s from base group by seg)
select id, round(m, 6) as bal_seg_mean, round(s, 6) as bal_seg_std, round((bal - m) / (coalesce(s, 0) + 1e-6), 6) as bal_seg_z from base join g using (seg)"""))
def _(t):
    return rounded(G.group_zscore(t.base(), "seg", "bal").select("id", "bal_seg_mean", "bal_seg_std", "bal_seg_z"), [])


@case("group_stat_matrix", with_base("""
, a as (select nat, avg(price) as m, stddev_samp(price) as s, median(price) as d from base group by nat), b as (select nat, avg(bal) as m, stddev_samp(bal) as s, median(bal) as d from base group by nat)
select id, round(a.m, 6) as nat_price_mean, round(a.s, 6) as nat_price_std, round(a.d, 6) as nat_price_median, round(price - a.m, 6) as nat_price_diff,
 round(b.m, 6) as nat_bal_mean, round(b.s, 6) as nat_bal_std, round(b.d, 6) as nat_bal_median, round(bal - b.m, 6) as nat_bal_diff
from base join a using (nat) join b using (nat)"""))
def _(t):
    out = G.group_stats(t.base(), ["nat"], ["price", "bal"])
    return rounded(out.drop("split", "pri", "seg", "nat", "price", "bal", "y"), [])


@case("lookup_with_default", with_base("""
, m as (select pri, seg, avg(y) as p from (select * from orig where not (pri = '1-URGENT' and seg = 'BUILDING')) group by all)
select id, round(coalesce(p, 0.5), 6) as p from base left join m using (pri, seg)"""))
def _(t):
    from foldwise.kernels.lookup import lookup

    table = orig_cut(t).groupBy("pri", "seg").agg(F.avg("y").alias("p"))
    return rounded(lookup(t.base(), table, ["pri", "seg"], {"p": 0.5}).select("id", "p"), [])


@case("entity_aggregates", """
with fit as (select * from events where event_id % 10 < 8 and user_id % 9 <> 0),
g as (select user_id, event_type, max(value) as mx, avg(value) as mn, stddev_samp(value) as sd, min(value) as mi, max(value) - min(value) as rg, count(value) as n from fit group by all),
r as (select event_id, mx, mn, sd, mi, rg, cast(n as double) as n from events left join g using (user_id, event_type)),
a as (select avg(mx) as mx, avg(mn) as mn, avg(sd) as sd, avg(mi) as mi, avg(rg) as rg, avg(n) as n from r)
select event_id, round(coalesce(r.mx, a.mx), 6) as v_max, round(coalesce(r.mn, a.mn), 6) as v_mean, round(coalesce(r.sd, a.sd), 6) as v_std,
 round(coalesce(r.mi, a.mi), 6) as v_min, round(coalesce(r.rg, a.rg), 6) as v_range, round(coalesce(r.n, a.n), 6) as v_count from r, a""")
def _(t):
    events = t.table("events", ["event_id", "user_id", "event_type", "value"])
    spec = {f"v_{s}": ("value", s) for s in ("max", "mean", "std", "min", "range", "count")}
    out = G.entity_aggregates(events, events.filter("event_id % 10 < 8 and user_id % 9 <> 0"), ["user_id", "event_type"], spec)
    return rounded(out.drop("user_id", "event_type", "value"), [])


SLOPE_SQL = """
with p as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as pos from events)
select user_id, event_type, round(coalesce(regr_slope(value, pos), 0), 6) + 0.0e0 as slope, count(*) as n from p group by all"""


def slope(t, hot_rows):
    events = t.table("events", ["event_id", "ts", "user_id", "event_type", "value"])
    lead = F.unix_micros(F.col("ts").cast("timestamp"))
    return rounded(G.group_slope(events, ["user_id", "event_type"], ["ts", "event_id"], lead, "value", hot_rows), [])


@case("group_slope", SLOPE_SQL)
def _(t):
    return slope(t, None)


@case("group_slope_hot_groups", SLOPE_SQL)
def _(t):
    return slope(t, 10)


@case("exact_match_lookup", with_base("""
, fit as (select *, cast(floor(bal / 1000) as bigint) as b from train), q as (select *, cast(floor(bal / 1000) as bigint) as b from base where split = 'test'),
m as (select pri, seg, nat, b, cast(max_by(y, id) as double) as y from fit group by all)
select q.id, coalesce(m.y, 0.5e0) as match_pred, cast(m.y is not null as int) as matched from q left join m on q.pri = m.pri and q.seg = m.seg and q.nat = m.nat and q.b = m.b"""))
def _(t):
    b = F.floor(F.col("bal") / 1000).alias("b")
    fit, q = t.base("train").select("*", b), t.base("test").select("*", b)
    return G.exact_match(q, fit, ["pri", "seg", "nat", "b"], "y", "id").select("id", "match_pred", "matched")


@case("overlap_removal", with_base("""
, pool as (select distinct pri, seg, nat, cast(floor(price / 20000) as bigint) as b from base where split <> 'orig'),
o as (select id, pri, seg, nat, cast(floor(price / 20000) as bigint) as b, y from orig),
f as (select * from o where not exists (select 1 from pool p where p.pri = o.pri and p.seg = o.seg and p.nat = o.nat and p.b is not distinct from o.b))
select id, pri, seg, nat, b, y from (select *, row_number() over (partition by pri, seg, nat, b order by id) as rn from f) where rn = 1"""))
def _(t):
    b = F.floor(F.col("price") / 20000).alias("b")
    orig = t.base("orig").select("id", "pri", "seg", "nat", b, "y")
    return G.remove_overlap(orig, pool_of(t).select("*", b), ["pri", "seg", "nat", "b"], "id")


@case("disjointness_check", with_base("""
select pri, seg, nat, cast(floor(price / 20000) as bigint) as b from train intersect select pri, seg, nat, cast(floor(price / 20000) as bigint) as b from orig"""))
def _(t):
    b = F.floor(F.col("price") / 20000).alias("b")
    return G.shared_rows(t.base("train").select("*", b), t.base("orig").select("*", b), ["pri", "seg", "nat", "b"])


REGION_SQL = ""
for _i, (_k, _ko) in enumerate([("pri", "pri"), ("pri, seg", "pri, seg"), ("seg, nat", "seg, nat")]):
    REGION_SQL += f""", o{_i} as (select {_k}, avg(y) as o from orig group by {_k} having count(*) >= 8 and (avg(y) >= 0.8e0 or avg(y) <= 1.0e0 - 0.8e0)),
f{_i} as (select {_k}, avg(y) as f from train group by {_k} having count(*) >= 10),
c{_i} as (select {_k}, greatest(case when o >= 0.8e0 then 1.0e0 - f else f end, 0.0e0) as rho{_i} from o{_i} join f{_i} using ({_k}))"""


@case("region_purity", with_base(REGION_SQL + """
, r as (select id, greatest(rho0, rho1, rho2) as rho from train left join c0 using (pri) left join c1 using (pri, seg) left join c2 using (seg, nat)),
b as (select avg(rho) as bar from r)
select id, round(coalesce(rho, 0), 6) as rho, cast(rho is not null as int) as mapped,
 round(case when rho is not null and bar > 1e-9 then least(greatest(0.2e0 * rho / bar, 0.05e0), 0.6e0) else 0.2e0 end, 6) as alpha from r, b"""))
def _(t):
    marked = G.region_purity(t.base("train"), t.base("orig"), [["pri"], ["pri", "seg"], ["seg", "nat"]], "y", 0.8, 8, 10)
    return rounded(G.region_alpha(marked, 0.2, 0.05, 0.6).select("id", "rho", "mapped", "alpha"), [])


@case("subgroup_centroids", with_base("""
, s as (select avg(price) as mp, stddev_pop(price) as sp, avg(bal) as mb, stddev_pop(bal) as sb from train where seg <> 'MACHINERY'),
z as (select id, split, seg, y, coalesce((price - mp) / nullif(sp, 0), 0) as zp, coalesce((bal - mb) / nullif(sb, 0), 0) as zb from base, s),
c as (select seg, case when count(*) filter (y = 1) >= 10 then avg(zp) filter (y = 1) else 0 end as cp, case when count(*) filter (y = 1) >= 10 then avg(zb) filter (y = 1) else 0 end as cb
 from z where split = 'train' and seg <> 'MACHINERY' group by seg)
select id, round(case when cp is null then 0.0e0 else sqrt((zp - cp) * (zp - cp) + (zb - cb) * (zb - cb)) end, 6) as centroid_distance from z left join c using (seg)"""))
def _(t):
    fit = t.base("train").filter("seg <> 'MACHINERY'")
    return rounded(G.centroid_distance(t.base(), fit, "seg", ["price", "bal"], "y").select("id", "centroid_distance"), [])
