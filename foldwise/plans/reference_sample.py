"""Ranks, z-scores, quantile distances and densities against a reference sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import groups as G
from foldwise.operators import reference as X
from foldwise.plans.cases import case, rounded, with_base


def ranks_sql(where="true"):
    return f"(select count(*) from orig o where o.price < b.price and {where}) / cast((select count(price) from orig o where {where}) as double)"


@case("pctrank_against_reference", with_base(f"""
, r as (select id, price, {ranks_sql()} as p, {ranks_sql('o.y = 0')} as p0, {ranks_sql('o.y = 1')} as p1 from base b where split <> 'orig')
select id, case when price is not null then round(p, 6) end as price_pct, case when price is not null then round(p0, 6) end as price_pct0,
 case when price is not null then round(p1, 6) end as price_pct1, case when price is not null then round(p1 - p0, 6) + 0.0e0 end as price_pct_gap from r"""))
def _(t):
    out = X.pctrank_against(t.base().filter("split <> 'orig'"), t.base("orig"), "price", "y")
    return rounded(out.select("id", "price_pct", "price_pct0", "price_pct1", "price_pct_gap"), [])


def mid_sql(c):
    return f"""coalesce(((select count(*) from part o where o.v < b.v and o.y = {c}) + (select count(*) from part o where o.v <= b.v and o.y = {c}))
 / (2.0e0 * (select count(v) from part o where o.y = {c})), 0.5e0)"""


@case("midrank_against_reference", with_base(f"""
, whole as (select id, split, y, floor(price / 1000) as v from base), part as (select * from whole where split = 'orig'),
r as (select id, v, {mid_sql(0)} as p0, {mid_sql(1)} as p1 from whole b)
select id, round(case when v is null then 0.5e0 else p0 end, 6) as v_mid0, round(case when v is null then 0.5e0 else p1 end, 6) as v_mid1,
 round(case when v is null then 0.0e0 else p1 - p0 end, 6) + 0.0e0 as v_mid_gap from r"""))
def _(t):
    whole = t.base().withColumn("v", F.floor(F.col("price") / 1000))
    return rounded(X.midrank_against(whole, whole.filter("split = 'orig'"), "v", "y").select("id", "v_mid0", "v_mid1", "v_mid_gap"), [])


@case("conditional_pctrank", with_base("""
, ref as (select * from orig where seg <> 'MACHINERY' or id % 500 = 8),
r as (select id, price, (select count(*) from ref o where o.price < b.price and o.seg = b.seg and o.nat % 3 = b.nat % 3) as below,
 (select count(price) from ref o where o.seg = b.seg and o.nat % 3 = b.nat % 3) as size,
 (select count(*) from ref o where o.price < b.price) as gbelow, (select count(price) from ref) as gsize from train b)
select id, case when price is null then null when size >= 5 then round(below / size, 6) else round(gbelow / gsize, 6) end as price_pct_in_seg_n3 from r"""))
def _(t):
    n3 = (F.col("nat") % 3).alias("n3")
    ref = t.base("orig").filter("seg <> 'MACHINERY' or id % 500 = 8").select("*", n3)
    out = X.conditional_pctrank(t.base("train").select("*", n3), ref, "price", ["seg", "n3"])
    return rounded(out.select("id", "price_pct_in_seg_n3"), [])


@case("zscore_against_reference", with_base("""
, s as (select avg(bal) as m, stddev_pop(bal) as s, avg(bal) filter (y = 0) as m0, stddev_pop(bal) filter (y = 0) as s0, avg(bal) filter (y = 1) as m1, stddev_pop(bal) filter (y = 1) as s1 from orig)
select id, round((bal - m) / s, 6) as bal_z, round((bal - m0) / s0, 6) as bal_z0, round((bal - m1) / s1, 6) as bal_z1,
 round(abs((bal - m1) / s1) - abs((bal - m0) / s0), 6) as bal_z_gap from base, s"""))
def _(t):
    return rounded(X.zscore_against(t.base(), t.base("orig"), "bal", "y").select("id", "bal_z", "bal_z0", "bal_z1", "bal_z_gap"), [])


QD = [("q25", 0.25), ("q50", 0.5), ("q75", 0.75)]


@case("class_quantile_distance", with_base("""
, s as (select """ + ", ".join(f"quantile_cont(price, {q}) filter (y = {c}) as {n}_{c}" for n, q in QD for c in (0, 1)) + """ from orig)
select id, """ + ", ".join(f"""round(abs(price - {n}_0), 6) as price_d0_{n}, round(abs(price - {n}_1), 6) as price_d1_{n},
 round(abs(price - {n}_0) - abs(price - {n}_1), 6) as price_dgap_{n}""" for n, _ in QD) + " from base, s"))
def _(t):
    out = X.quantile_distance(t.base(), t.base("orig"), "price", "y")
    return rounded(out.drop("split", "pri", "seg", "nat", "price", "bal", "y"), [])


@case("group_residuals", with_base("""
, g as (select nat, avg(bal) as m, median(bal) as d, stddev_samp(bal) as s from orig where nat <> 2 group by nat)
select id, round(bal - m, 6) as bal_nat_resid_mean, round(bal - d, 6) as bal_nat_resid_median, round((bal - m) / (coalesce(s, 1) + 1e-5), 6) as bal_nat_resid_z
from base left join g using (nat)"""))
def _(t):
    out = G.group_residual(t.base(), t.base("orig").filter("nat <> 2"), "nat", "bal")
    return rounded(out.select("id", "bal_nat_resid_mean", "bal_nat_resid_median", "bal_nat_resid_z"), [])


def kde_sql(c):
    return f"""(select sum(k.n * exp(-((b.v - k.v) * (b.v - k.v)) / (2 * b.h{c} * b.h{c}))) / (b.n{c} * b.h{c} * sqrt(2 * pi())) from ref k where k.y = {c})"""


@case("kde_log_ratio", with_base(f"""
, ref as (select bal as v, y, count(*) as n from orig group by all),
s as (select stddev_samp(bal) filter (y = 0) * pow(count(*) filter (y = 0), -0.2e0) as h0, stddev_samp(bal) filter (y = 1) * pow(count(*) filter (y = 1), -0.2e0) as h1,
  count(*) filter (y = 0) as n0, count(*) filter (y = 1) as n1 from orig),
b as (select distinct bal as v, s.* from base, s), d as (select v, ln(({kde_sql(1)} + 1e-10) / ({kde_sql(0)} + 1e-10)) as r from b)
select id, round(r, 6) + 0.0e0 as bal_kde_log_ratio from base join d on bal = v"""))
def _(t):
    return rounded(X.kde_log_ratio(t.base(), t.base("orig"), "bal", "y").select("id", "bal_kde_log_ratio"), [])
