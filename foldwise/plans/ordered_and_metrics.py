"""Ordered windows, ranks, range rates, metrics, significance and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import metrics as M
from foldwise.operators import ordered as O
from foldwise.functions.hashing import hash_sql
from foldwise.plans.cases import case, rounded, with_base

MODELS = ["m0", "m1", "m2", "m3"]


def rate_sql(own, cross, by, widths=(3, 20)):
    """Range-window rates by a correlated count over distinct values."""
    group = "and c.g = q.g" if by else ""
    parts = []
    for w in widths:
        cond = f"from c where c.v between q.v - {w} and q.v + {w} {group} {'and c.fold <> q.fold' if cross else ''}"
        parts.append(f"(select coalesce(sum(s), 0) {cond}) as s{w}, (select coalesce(sum(n), 0) {cond}) as n{w}")
    g = "seg" if by else "1"
    return with_base(f"""
, f as (select id, fold, y, cast(floor(price / 100) as bigint) as v, {g} as g from folded {'where nat <> 5' if own else ''}),
c as (select v, g, fold, count(*) as n, sum(y) as s from f where v is not null group by all), mu as (select avg(y) as mu from f),
a as (select id, {'fold' if cross else '-1'} as fold, cast(floor(price / 100) as bigint) as v, {g} as g from {'folded' if cross else 'base'}),
q as (select distinct fold, v, g from a where v is not null), r as (select q.*, {', '.join(parts)} from q)
select id, {', '.join(f"round(coalesce((s{w} + 25 * mu) / (n{w} + 25), mu), 6) as rate_{w}" for w in widths)} from a left join r on a.v = r.v and a.g = r.g and a.fold = r.fold, mu""")


def bucketed(df):
    return df.withColumn("v", F.floor(F.col("price") / 100))


@case("range_window_rate", rate_sql(True, False, False))
def _(t):
    fit = bucketed(t.base("train")).filter("nat <> 5")
    return rounded(O.range_rate(bucketed(t.base()), fit, "v", "y", [3, 20], 25.0).select("id", "rate_3", "rate_20"), [])


@case("range_window_rate_by_group", rate_sql(True, False, True))
def _(t):
    fit = bucketed(t.base("train")).filter("nat <> 5")
    return rounded(O.range_rate(bucketed(t.base()), fit, "v", "y", [3, 20], 25.0, ["seg"]).select("id", "rate_3", "rate_20"), [])


@case("range_window_rate_crossfit", rate_sql(False, True, False))
def _(t):
    return rounded(O.range_rate_crossfit(bucketed(t.folded()), "v", "y", [3, 20], 25.0, "fold").select("id", "rate_3", "rate_20"), [])


LAG_SQL = """select event_id, coalesce(lag(value) over w, 0.0e0) as value_lag1, coalesce(cast(lag(event_type) over w = event_type as int), 0) as same_type
from events window w as (partition by user_id order by ts, event_id)"""


def lagged(t, hot_rows):
    events = t.table("events", ["event_id", "ts", "user_id", "event_type", "value"])
    events = events.withColumn("kind", F.xxhash64("event_type").cast("double"))
    lead = F.unix_micros(F.col("ts").cast("timestamp"))
    out = O.add_lags(events, ["user_id"], ["ts", "event_id"], lead, ["value", "kind"], 0.0, hot_rows)
    return out.select("event_id", "value_lag1", (F.col("kind_lag1") == F.col("kind")).cast("int").alias("same_type"))


@case("entity_lags", LAG_SQL)
def _(t):
    return lagged(t, None)


@case("entity_lags_hot_groups", LAG_SQL)
def _(t):
    return lagged(t, 20)


@case("rolling_mean", """select event_id, row_number() over o as position, case when row_number() over o >= 200 then round(avg(value) over (order by ts, event_id rows between 199 preceding and current row), 6) end as rolling
from events window o as (order by ts, event_id)""")
def _(t):
    events = t.table("events", ["event_id", "ts", "value"])
    lead = F.unix_micros(F.col("ts").cast("timestamp"))
    out = O.rolling_mean(events, ["ts", "event_id"], lead, "value", 200, chunk=700)
    return rounded(out.select("event_id", "position", "rolling"), [])


@case("shift_detector", """
with r as (select row_number() over o as pos, avg(value) over (order by ts, event_id rows between 199 preceding and current row) as m from events window o as (order by ts, event_id)),
a as (select avg(value) as overall from events), f as (select min(pos) as position from r, a where pos >= 200 and m > 1.1e0 * overall)
select position, (select round(m, 6) from r where pos = position) as rolling, round(overall, 6) as overall from f, a""")
def _(t):
    events = t.table("events", ["event_id", "ts", "value"])
    lead = F.unix_micros(F.col("ts").cast("timestamp"))
    return rounded(O.rolling_shift(events, ["ts", "event_id"], lead, "value", 200, 1.1, chunk=700), [])


@case("percent_rank", with_base("""
select id, round(case when price is not null then (rank() over (order by price nulls last) + (count(*) over (partition by price) - 1) / 2.0e0) / (select count(price) from base) end, 6) as price_rank from base"""))
def _(t):
    return rounded(O.pct_rank(t.base(), ["price"]).select("id", "price_rank"), [])


@case("percent_rank_in_group", with_base("""
, f as (select id, seg, floor(bal / 100) as b from base)
select id, round((rank() over (partition by seg order by b) + (count(*) over (partition by seg, b) - 1) / 2.0e0) / count(*) over (partition by seg), 6) as b_rank from f"""))
def _(t):
    df = t.base().withColumn("b", F.floor(F.col("bal") / 100))
    return rounded(O.pct_rank(df, ["b"], ["seg"]).select("id", "b_rank"), [])


LONG = ", l as (select id, fold, y, unnest(['m0', 'm1', 'm2', 'm3']) as model, unnest([m0, m1, m2, m3]) as pred from scores)"


def auc_sql(source, by, name="au"):
    keys = ", ".join(by)
    part = f"partition by {keys}" if by else ""
    lead = f"{keys}, " if by else ""
    return f""", {name}_c as (select {lead}pred, sum(y) as pos, sum(1 - y) as neg from {source} group by all),
{name}_u as (select *, coalesce(sum(neg) over ({part} order by pred rows between unbounded preceding and 1 preceding), 0) as below from {name}_c),
{name} as (select {lead}sum(pos * (below + neg / 2.0e0)) / (sum(pos) * cast(sum(neg) as double)) as auc, cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg from {name}_u {'group by ' + keys if by else ''})"""


@case("exact_auc", with_base(LONG + auc_sql("l", ["model", "fold"]) + " select model, fold, round(auc, 6) as auc, n_pos, n_neg from au"))
def _(t):
    return rounded(M.auc(t.scores(), "y", MODELS, ["fold"]), [])


@case("regression_errors", """select l_returnflag, round(sqrt(avg((p - l_extendedprice) * (p - l_extendedprice))), 4) as rmse, round(avg(abs(p - l_extendedprice)), 4) as mae,
 round(avg(p - l_extendedprice), 4) as bias, count(*) as n from (select *, l_quantity * 1400 as p from lineitem) group by l_returnflag""")
def _(t):
    df = t.table("lineitem", ["l_returnflag", "l_quantity", "l_extendedprice"]).withColumn("p", F.col("l_quantity") * 1400)
    return rounded(M.regression_metrics(df, "l_extendedprice", "p", ["l_returnflag"]), [], 4)


@case("probability_metrics", with_base("""
select fold, round(avg((m3 - y) * (m3 - y)), 6) as brier, round(avg(-case when y = 1 then ln(greatest(m3, 1e-15)) else ln(1 - least(m3, 1.0e0 - 1e-15)) end), 6) as log_loss,
 round(avg(cast(cast(m3 >= 0.5e0 as int) = y as int)), 6) as accuracy, count(*) as n from scores group by fold"""))
def _(t):
    return rounded(M.prob_metrics(t.scores(), "y", "m3", ["fold"]), [])


@case("balanced_accuracy", with_base("""
, c as (select fold, cast(floor(price / 100000) as int) as cls, cast(floor(price / 90000) as int) as p from folded where price is not null),
r as (select fold, cls, avg(cast(p = cls as int)) as recall from c group by all)
select fold, round(avg(recall), 6) as balanced_accuracy, count(*) as classes from r group by fold"""))
def _(t):
    df = t.folded().filter("price is not null").select(
        "fold", F.floor(F.col("price") / 100000).cast("int").alias("cls"), F.floor(F.col("price") / 90000).cast("int").alias("p"))
    return rounded(M.balanced_accuracy(df, "cls", "p", ["fold"]), [])


@case("calibration_curve", with_base(f"""
, b as (select m3, y, cast({' + '.join(f'cast(m3 > {i}e0 / 10.0e0 as int)' for i in range(1, 10))} as int) as bin from scores)
select bin, round(avg(m3), 6) as mean_pred, round(avg(y), 6) as observed, count(*) as n from b group by bin"""))
def _(t):
    return rounded(M.calibration_curve(t.scores(), "y", "m3", 10), [])


def placement_sql(m):
    return f"""{m}_c as (select {m} as s, sum(y) as pos, sum(1 - y) as neg from scores group by {m}),
{m}_u as (select s, pos, neg, coalesce(sum(pos) over w, 0) as pb, coalesce(sum(neg) over w, 0) as nb, sum(pos) over () as mm, sum(neg) over () as nn from {m}_c window w as (order by s rows between unbounded preceding and 1 preceding)),
{m}_p as (select s, (nb + neg / 2.0e0) / nn as v10, 1 - (pb + pos / 2.0e0) / mm as v01 from {m}_u)"""


@case("delong_test", with_base(f"""
, {placement_sql('m3')}, {placement_sql('m2')},
v as (select y, case when y = 1 then a.v10 else a.v01 end as va, case when y = 1 then b.v10 else b.v01 end as vb from scores join m3_p a on a.s = m3 join m2_p b on b.s = m2),
g as (select y, avg(va) as a, avg(vb) as b, (var_samp(va) + var_samp(vb) - 2 * covar_samp(va, vb)) / count(*) as var from v group by y),
o as (select max(a) filter (y = 1) as auc_a, max(b) filter (y = 1) as auc_b, sqrt(greatest(sum(var), 0)) as se from g)
select round(auc_a, 6) as auc_a, round(auc_b, 6) as auc_b, round(se, 6) as se, round((auc_a - auc_b) / se, 6) as z from o"""))
def _(t):
    return rounded(M.delong(t.scores(), "y", "m3", "m2"), [])


def bootstrap_sql(reps, seed):
    u = f"(h1 * ((rep * {M.REPLICATE_STEP} + 1) % {M.MODULUS}) + h2) % {M.MODULUS}"
    weight = " + ".join(f"cast({'h'} >= {edge} as int)" for edge in M.POISSON_ONE)
    return with_base(f"""
, hashed as (select y, m2, m3, {hash_sql('id', seed)} as h1, {hash_sql('id', seed + 1)} as h2 from scores),
drawn as (select y, m2, m3, rep, {u} as h from hashed, (select unnest(range({reps})) as rep)),
w as (select rep, y, m2, m3, {weight} as w from drawn),
l as (select rep, y, w, unnest(['m2', 'm3']) as model, unnest([m2, m3]) as pred from w),
c as (select rep, model, pred, sum(case when y = 1 then w else 0 end) as pos, sum(case when y = 0 then w else 0 end) as neg from l group by all),
b as (select *, coalesce(sum(neg) over (partition by rep, model order by pred rows between unbounded preceding and 1 preceding), 0) as below from c),
a as (select rep, model, sum(pos * (below + neg / 2.0e0)) / (cast(sum(pos) as double) * sum(neg)) as auc from b group by all),
d as (select rep, sum(case when model = 'm3' then auc else -auc end) as gap from a group by rep)
select round(avg(gap), 6) as mean, round(stddev_samp(gap), 6) as sd, round(quantile_cont(gap, 0.025), 6) as low,
  round(quantile_cont(gap, 0.975), 6) as high, avg(cast(gap > 0 as int)) as share_above from d""")


@case("bootstrap_auc_difference", bootstrap_sql(120, 5))
def _(t):
    return rounded(M.bootstrap_auc_diff(t.scores(), "id", "y", "m3", "m2", 120, 5), ["share_above"])


PAIRS = [(a, b) for i, a in enumerate(MODELS) for b in MODELS[i + 1:]]


@case("pearson_matrix", with_base(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from scores" for a, b in PAIRS)))
def _(t):
    return rounded(M.corr_matrix(t.scores(), MODELS), [])


RANKED = ", rk as (select id, " + ", ".join(
    f"(rank() over (order by {m}) + (count(*) over (partition by {m}) - 1) / 2.0e0) / count(*) over () as {m}" for m in MODELS) + " from scores)"


@case("spearman_matrix", with_base(RANKED + " " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from rk" for a, b in PAIRS)))
def _(t):
    return rounded(M.corr_matrix(t.scores(), MODELS, "spearman"), [])


@case("rank_shift", with_base(RANKED + " select round(avg(abs(m2 - m3)), 6) as mean_shift, round(max(abs(m2 - m3)), 6) as max_shift from rk"))
def _(t):
    return rounded(M.rank_shift(t.scores(), "m2", "m3"), [])


@case("resolution_table", with_base("""
, e as (select min(price) as lo, max(price) as hi from train), n as (select unnest([0, 4, 16, 64]) as bins),
l as (select bins, y, case when bins = 0 then price else floor((price - lo) * (cast(bins as double) / (hi - lo + 1.0e0))) end as pred from train, e, n where price is not null)""" + auc_sql("l", ["bins"]) + """
select bins, round(auc, 6) as auc, round(auc / (select auc from au where bins = 0), 6) as kept from au"""))
def _(t):
    return rounded(M.resolution_table(t.base("train"), "y", "price", [4, 16, 64]), [])


@case("fold_report", with_base(LONG + auc_sql("l", ["model", "fold"]) + """
select a.model, round(avg(a.auc), 6) as mean_auc, round(stddev_samp(a.auc), 6) as std_auc, round(min(a.auc), 6) as min_auc, round(max(a.auc), 6) as max_auc,
 cast(sum(cast(a.auc > b.auc as int)) as bigint) as wins from au a join au b on a.fold = b.fold and b.model = 'm1' group by a.model"""))
def _(t):
    return rounded(M.fold_report(t.scores(), "y", MODELS, "fold", "m1"), [])


@case("top_scores", with_base("select id, m3 from scores order by m3 desc, id limit 25"))
def _(t):
    return M.top_k(t.scores().select("id", "m3"), "m3", 25, ["id"])


@case("worst_scores", with_base("select id, m3 from scores order by m3, id limit 25"))
def _(t):
    return M.top_k(t.scores().select("id", "m3"), "m3", 25, ["id"], worst=True)
