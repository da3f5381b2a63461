"""Label encodings: external, ordered, cross-fitted, weight of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import encodings as E
from foldwise.operators import keys as K
from foldwise.operators import metrics as M
from foldwise.plans.cases import case, rounded, with_base

DROP = ["split", "pri", "seg", "nat", "price", "bal", "y"]
CUT = """, cut as (select * from orig where not (pri = '1-URGENT' and seg = 'BUILDING') and nat <> 3)"""


def cut(t):
    return t.base("orig").filter("not (pri = '1-URGENT' and seg = 'BUILDING') and nat <> 3")


@case("external_target_mean", with_base(CUT + """
, p as (select avg(y) as p from cut), a as (select nat, avg(y) as v from cut group by nat), b as (select seg, avg(y) as v from cut group by seg)
select id, round(coalesce(a.v, p), 6) as nat_ext, round(coalesce(b.v, p), 6) as seg_ext from base left join a using (nat) left join b using (seg), p"""))
def _(t):
    return rounded(E.external_target_mean(t.base(), cut(t), ["nat", "seg"], "y").select("id", "nat_ext", "seg_ext"), [])


@case("external_pair_mean", with_base("""
, a as (select pri, seg, avg(y) as v from orig group by all)
select id, round(coalesce(a.v, 0.5e0), 6) as pri__seg_ext from base left join a using (pri, seg)"""))
def _(t):
    keyed = K.ngram_keys(t.base(), ["pri", "seg"], 2)
    return rounded(E.external_target_mean(keyed, keyed.filter("split = 'orig'"), ["pri__seg"], "y", default=0.5).select("id", "pri__seg_ext"), [])


@case("shrunk_external_mean", with_base(CUT + """
, p as (select avg(y) as p from cut), a as (select nat, (sum(y) + 30 * (select p from p)) / (count(*) + 30) as v from cut group by nat)
select id, round(coalesce(a.v, p), 6) as nat_ext from base left join a using (nat), p"""))
def _(t):
    return rounded(E.external_target_mean(t.base(), cut(t), ["nat"], "y", m=30).select("id", "nat_ext"), [])


@case("saturation_census", with_base("""
, k as (select id, split, y, unnest(['b', 'n']) as "column", unnest([cast(cast(floor(price / 3000) as bigint) as varchar), cast(nat as varchar)]) as key from base),
c as (select "column", key, count(*) as n, sum(y) as s from k where split = 'orig' and key is not null group by all), r as (select "column", key, count(*) as n from k where split = 'train' and key is not null group by all)
select c."column", count(*) as cells, cast(sum(cast(s = c.n as int)) as bigint) as cells_one, cast(sum(cast(s = 0 as int)) as bigint) as cells_zero, min(case when s = 0 or s = c.n then c.n end) as saturated_min_n,
 max(case when s = 0 or s = c.n then c.n end) as saturated_max_n, cast(coalesce(sum(case when s = 0 or s = c.n then r.n end), 0) as bigint) as saturated_rows from c left join r on c."column" = r."column" and c.key = r.key group by c."column\""""))
def _(t):
    df = t.base().select("id", "split", "y", F.floor(F.col("price") / 3000).alias("b"), F.col("nat").alias("n"))
    return E.saturation_census(df.filter("split = 'train'"), df.filter("split = 'orig'"), ["b", "n"], "y")


@case("external_target_quantiles", """
with o as (select o_orderkey as id, o_orderkey % 10 >= 8 as orig, c_nationkey as nat, o_totalprice as v from orders join customer on o_custkey = c_custkey),
r as (select * from o where orig and nat <> 3), g as (select nat, avg(v) as m, stddev_samp(v) as s, count(*) as n, quantile_cont(v, 0.25) as a, quantile_cont(v, 0.5) as b, quantile_cont(v, 0.75) as c from r group by nat),
w as (select avg(v) as m, stddev_samp(v) as s from r)
select id, round(coalesce(g.m, w.m), 4) as nat_y_mean, round(coalesce(g.s, w.s), 4) as nat_y_std, coalesce(g.n, 1) as nat_y_count,
 round(coalesce(a, w.m), 4) as nat_y_q25, round(coalesce(b, w.m), 4) as nat_y_q50, round(coalesce(c, w.m), 4) as nat_y_q75 from o left join g using (nat), w""")
def _(t):
    df = t.table("orders").join(t.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("nat"), F.col("o_totalprice").alias("v"))
    out = E.external_target_stats(df, df.filter("id % 10 >= 8 and nat <> 3"), "nat", "v")
    return rounded(out.drop("nat", "v"), [], 4)


ORDERED_SQL = with_base("""
, s as (select *, cast(floor(price / 100000) as int) as cls, case when id % 19 = 0 then null else seg end as sg from base where price is not null),
p as (select avg(cast(cls = 0 as int)) as p0, avg(cast(cls = 1 as int)) as p1 from s where split = 'train'),
f as (select id, (coalesce(sum(cast(cls = 0 as int)) over w, 0) + p0) / (count(*) over w + 1) as o0, (coalesce(sum(cast(cls = 1 as int)) over w, 0) + p1) / (count(*) over w + 1) as o1
  from s, p where split = 'train' window w as (partition by sg order by id rows between unbounded preceding and 1 preceding)),
g as (select sg, count(*) as n, sum(cast(cls = 0 as int)) as s0, sum(cast(cls = 1 as int)) as s1 from s where split = 'train' group by sg),
q as (select id, coalesce((s0 + p0) / (n + 1), p0) as o0, coalesce((s1 + p1) / (n + 1), p1) as o1 from s left join g on s.sg is not distinct from g.sg, p where split = 'test')
select id, round(o0, 6) as sg_ote_0, round(o1, 6) as sg_ote_1 from f union all select id, round(o0, 6), round(o1, 6) from q""")


def ordered(t, hot_rows):
    df = t.base().filter("price is not null").select(
        "id", "split", F.floor(F.col("price") / 100000).cast("int").alias("cls"), F.when(F.col("id") % 19 == 0, None).otherwise(F.col("seg")).alias("sg"))
    fit, query = df.filter("split = 'train'"), df.filter("split = 'test'")
    a, b = E.ordered_te(fit, ["sg"], "cls", [0, 1], "id", 1.0, query, hot_rows)
    cols = ["id", "sg_ote_0", "sg_ote_1"]
    return rounded(a.select(cols).unionByName(b.select(cols)), [])


@case("ordered_target_encoding", ORDERED_SQL)
def _(t):
    return ordered(t, None)


@case("ordered_target_encoding_hot_keys", ORDERED_SQL)
def _(t):
    return ordered(t, 500)


def kfold_sql(key, out, forms):
    """Cross-fitted sums n, s, q and N, S, Q of the other folds for train rows; of all folds for test rows."""
    return with_base(f"""
, own as (select {key} as k, fold, count(*) as n, sum(y) as s, sum(y * y) as q from folded group by all), tot as (select k, sum(n) as n, sum(s) as s, sum(q) as q from own group by k),
pf as (select fold, count(*) as n, sum(y) as s, sum(y * y) as q from folded group by fold), pt as (select count(*) as n, sum(y) as s, sum(y * y) as q from folded),
tb as (select o.k, o.fold, cast(t.n - o.n as double) as n, cast(t.s - o.s as double) as s, cast(t.q - o.q as double) as q from own o join tot t on o.k is not distinct from t.k union all select k, -1, n, s, q from tot),
ov as (select fold, cast(pt.n - pf.n as double) as nn, cast(pt.s - pf.s as double) as ss, cast(pt.q - pf.q as double) as qq from pf, pt union all select -1, n, s, q from pt),
v0 as (select tb.k, fold, n, s, q, nn, ss, qq, ss / nn as p, qq / nn - (ss / nn) * (ss / nn) as tau, s / nullif(n, 0) as mean, greatest(q / nullif(n, 0) - (s / nullif(n, 0)) * (s / nullif(n, 0)), 0) as var from tb join ov using (fold)),
v as (select *, sum(n * (mean - p) * (mean - p)) over (partition by fold) / sum(n) over (partition by fold) as spread from v0),
w as (select k, fold, {forms} from v),
r as (select id, {key} as k, fold from folded union all select id, {key}, -1 from test)
""") + out


SMOOTHED = """coalesce((n * tau / nullif(n * tau + var, 0)) * mean + (1 - n * tau / nullif(n * tau + var, 0)) * p, p) as auto,
 coalesce((s + 10 * p) / (n + 10), p) as m10, coalesce((s + 100 * p) / (n + 100), p) as m100"""


@case("kfold_target_encoding", kfold_sql("pri", "select id, round(coalesce(m10, (select ss / nn from ov where fold = -1)), 6) as pri_te_m10 from r left join w on r.k is not distinct from w.k and r.fold = w.fold", SMOOTHED))
def _(t):
    fit, query = E.kfold_te(t.folded(), ["pri"], "y", "fold", 10, t.base("test"))
    return rounded(fit.select("id", "pri_te_m10").unionByName(query.select("id", "pri_te_m10")), [])


@case("empirical_bayes_encoding", kfold_sql("cast(floor(price / 4000) as bigint)", "select id, round(coalesce(auto, (select ss / nn from ov where fold = -1)), 6) as b_te_auto from r left join w on r.k is not distinct from w.k and r.fold = w.fold", SMOOTHED))
def _(t):
    b = F.floor(F.col("price") / 4000).alias("b")
    fit, query = E.kfold_te(t.folded().select("*", b), ["b"], "y", "fold", "auto", t.base("test").select("*", b))
    return rounded(fit.select("id", "b_te_auto").unionByName(query.select("id", "b_te_auto")), [])


@case("multi_smoothing_encoding", kfold_sql("pri || '_' || seg", """select id, round(coalesce(auto, g), 6) as pri__seg_te_auto, round(coalesce(m10, g), 6) as pri__seg_te_m10, round(coalesce(m100, g), 6) as pri__seg_te_m100
 from r left join w on r.k is not distinct from w.k and r.fold = w.fold, (select ss / nn as g from ov where fold = -1)""", SMOOTHED))
def _(t):
    fit, query = (K.ngram_keys(d, ["pri", "seg"], 2) for d in (t.folded(), t.base("test")))
    a, b = E.kfold_te(fit, ["pri__seg"], "y", "fold", ["auto", 10, 100], query)
    cols = ["id", "pri__seg_te_auto", "pri__seg_te_m10", "pri__seg_te_m100"]
    return rounded(a.select(cols).unionByName(b.select(cols)), [])


@case("james_stein_encoding", kfold_sql("nat", "select id, round(coalesce(js, (select ss / nn from ov where fold = -1)), 6) as nat_js from r left join w on r.k is not distinct from w.k and r.fold = w.fold", """
 case when n = 0 then p else coalesce((1 - (var / n) / nullif(var / n + spread, 0)) * mean + (var / n) / nullif(var / n + spread, 0) * p, mean, p) end as js"""))
def _(t):
    a, b = E.james_stein_te(t.folded(), ["nat"], "y", "fold", t.base("test"))
    return rounded(a.select("id", "nat_js").unionByName(b.select("id", "nat_js")), [])


@case("woe_crossfit", kfold_sql("nat", "select id, round(coalesce(woe, 0), 6) + 0.0e0 as nat_woe from r left join w on r.k is not distinct from w.k and r.fold = w.fold", """
 ln(s + 20 * p) - ln(n - s + 20 * (1 - p)) - (ln(p) - ln(1 - p)) as woe"""))
def _(t):
    a, b = E.woe_crossfit(t.folded(), ["nat"], "y", "fold", 20, t.base("test"))
    return rounded(a.select("id", "nat_woe").unionByName(b.select("id", "nat_woe")), [])


@case("woe_encoding", with_base("""
, p as (select count(*) as nn, sum(y) as ss from train where seg <> 'MACHINERY'), g as (select seg, count(*) as n, sum(y) as s from train where seg <> 'MACHINERY' group by seg),
w as (select seg, ln(((n - s + 0.0001e0) / (nn - ss + 0.0001e0)) / ((s + 0.0001e0) / (ss + 0.0001e0))) as w from g, p)
select id, round(coalesce(w, 0), 6) + 0.0e0 as seg_woe from base left join w using (seg)"""))
def _(t):
    return rounded(E.woe_encode(t.base(), t.base("train").filter("seg <> 'MACHINERY'"), ["seg"], "y").select("id", "seg_woe"), [])


def stats_sql(key, label, stats, defaults):
    picks = ", ".join(f"round(coalesce(g.{s}, {d}), 6) as {label}_y_{s}" for s, d in zip(stats, defaults))
    return with_base(f"""
, r as (select {key} as k, fold as reader, y from folded), f as (select unnest([0, 1, 2, 3, 4]) as reader),
g as (select k, f.reader, avg(y) as mean, stddev_samp(y) as std, cast(min(y) as double) as min, cast(max(y) as double) as max, cast(count(*) as double) as count from r join f on r.reader <> f.reader where k is not null group by all
  union all select k, -1, avg(y), stddev_samp(y), min(y), max(y), count(*) from r where k is not null group by all),
q as (select id, {key} as k, fold as reader from folded union all select id, {key}, -1 from test)
select id, {picks} from q left join g on q.k = g.k and q.reader = g.reader""")


@case("kfold_target_stats", stats_sql("cast(floor(price / 4000) as bigint)", "b", ["std", "min", "max"], [0, 0, 0]))
def _(t):
    b = F.floor(F.col("price") / 4000).alias("b")
    a, q = E.kfold_target_stats(t.folded().select("*", b), ["b"], "y", "fold", 5, query=t.base("test").select("*", b))
    cols = ["id", "b_y_std", "b_y_min", "b_y_max"]
    return rounded(a.select(cols).unionByName(q.select(cols)), [])


@case("per_fold_group_stats", stats_sql("nat", "nat", ["mean", "std"], [0.5, 0]))
def _(t):
    a, q = E.kfold_target_stats(t.folded(), ["nat"], "y", "fold", 5, ("mean", "std"), {"mean": 0.5}, query=t.base("test"))
    cols = ["id", "nat_y_mean", "nat_y_std"]
    return rounded(a.select(cols).unionByName(q.select(cols)), [])


@case("mean_rank_encoding", with_base("""
, b as (select id, split, y, cast(cast(floor(price / 1500) as bigint) as varchar) as b, seg from base), m as (select b, row_number() over (order by avg(y), b nulls first) - 1 as rank from b where split = 'train' group by b),
s as (select seg, row_number() over (order by avg(y), seg) - 1 as rank from b where split = 'train' group by seg)
select id, m.rank as b_rank, s.rank as seg_rank from b left join m on b.b is not distinct from m.b left join s using (seg)"""))
def _(t):
    df = t.base().select("id", "split", "y", F.floor(F.col("price") / 1500).alias("b"), "seg")
    return E.mean_rank_encode(df, df.filter("split = 'train'"), ["b", "seg"], "y").select("id", "b_rank", "seg_rank")


TAGS = ["auto", "m10", "m100"]


@case("encoding_scoreboard", kfold_sql("pri || '_' || seg", """
, e as (select f.id, f.fold, f.y, unnest(['pri__seg_te_auto', 'pri__seg_te_m10', 'pri__seg_te_m100']) as model, unnest([round(auto, 9), round(m10, 9), round(m100, 9)]) as pred from folded f join w on w.k = f.pri || '_' || f.seg and w.fold = f.fold),
c as (select fold, model, pred, sum(y) as pos, sum(1 - y) as neg from e group by all),
u as (select *, coalesce(sum(neg) over (partition by fold, model order by pred rows between unbounded preceding and 1 preceding), 0) as below from c),
a as (select fold, model, sum(pos * (below + neg / 2.0e0)) / (sum(pos) * cast(sum(neg) as double)) as auc, cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg from u group by all)
select fold, model, round(auc, 6) as auc, n_pos, n_neg from a order by round(auc, 6) desc, fold, model limit 10""", SMOOTHED))
def _(t):
    """The flagship: scan, join, hashed folds, pair key, cross-fitted encoding at three smoothings, exact AUC per fold."""
    fit = K.ngram_keys(t.folded(), ["pri", "seg"], 2)
    encoded, _ = E.kfold_te(fit, ["pri__seg"], "y", "fold", ["auto", 10, 100])
    names = [f"pri__seg_te_{g}" for g in TAGS]
    steady = encoded.select("fold", "y", *[F.round(n, 9).alias(n) for n in names])
    return M.top_k(rounded(M.auc(steady, "y", names, ["fold"]), []), "auc", 10, ["fold", "model"])
