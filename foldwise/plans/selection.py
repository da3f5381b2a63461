"""Folds, splits, row selection, resampling, weights and preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.hashing import MODULUS, hash_sql, key_hash
from foldwise.operators import preparation as P
from foldwise.operators import rows as R
from foldwise.plans.cases import case, rounded, with_base


def h(seed, key="id"):
    return hash_sql(key, seed)


@case("kfold", with_base(f"select id, cast((row_number() over (order by {h(3)}, id) - 1) % 5 as int) as fold from train"))
def _(t):
    return R.kfold(t.base("train"), "id", 5, 3).select("id", "fold")


@case("hashed_fold", with_base(f"select id, cast({h(3)} % 5 as int) as fold from train"))
def _(t):
    return R.hashed_fold(t.base("train"), "id", 5, 3).select("id", "fold")


@case("stratified_kfold", with_base(f"""
, o as (select id, y, cast((row_number() over (partition by y order by {h(4)}, id) - 1) % 5 as int) as fold from train)
select id, fold, cast((row_number() over (partition by fold, y order by {h(9)}, id) - 1) % 3 as int) as inner_fold from o"""))
def _(t):
    outer = R.stratified_kfold(t.base("train"), "id", "y", 5, 4)
    return R.stratified_kfold(outer, "id", "y", 3, 9, "inner_fold", within=["fold"]).select("id", "fold", "inner_fold")


@case("multi_seed_folds", with_base(f"""
select id, {', '.join(f"cast((row_number() over (partition by y order by {h(s)}, id) - 1) % 5 as int) as fold_{s}" for s in (21, 22, 23))} from train"""))
def _(t):
    df = t.base("train").select("id", "y")
    for s in (21, 22, 23):
        df = R.stratified_kfold(df, "id", "y", 5, s, f"fold_{s}")
    return df.drop("y")


@case("stratified_split", with_base(f"""
select id, case when row_number() over (partition by y order by {h(5)}, id) <= floor(0.35e0 * count(*) over (partition by y)) then 'A' else 'R' end as part from orig"""))
def _(t):
    return R.stratified_split(t.base("orig"), "id", "y", 0.35, 5).select("id", "part")


@case("pool_union", with_base("""
select id, pri, null as seg, y, 'train' as origin from train union all select id, pri, seg, null as y, 'test' from test"""))
def _(t):
    train = t.base("train").select("id", "pri", "y", F.lit("train").alias("origin"))
    test = t.base("test").select("seg", "id", "pri", F.lit("test").alias("origin"))
    return R.union_frames(train, test).select("id", "pri", "seg", "y", "origin")


@case("external_append", with_base(f"""
, o as (select id, cast((row_number() over (order by {h(6)}, id) - 1) % 5 as int) as fold from orig), f as (select unnest([0, 1, 2, 3, 4]) as outer_fold)
select id, cast(outer_fold as int) as outer, case when fold = outer_fold then 'hold' else 'fit' end as role, 0 as external from folded, f
union all select id, cast(outer_fold as int), 'fit', 1 from o, f where fold <> outer_fold""".replace(" as outer,", ' as "outer",')))
def _(t):
    orig = R.kfold(t.base("orig"), "id", 5, 6)
    return R.append_external(t.folded(), orig, 5).select("id", "outer", "role", "external")


@case("value_filter", "select o_orderkey, o_totalprice from orders where extract(year from o_orderdate) <> 1995")
def _(t):
    orders = t.table("orders", ["o_orderkey", "o_totalprice", "o_orderdate"])
    kept = (F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")) | (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return orders.filter(kept).drop("o_orderdate")


@case("replicated_rows", with_base(f"""
, c as (select id, cast(copy as int) as copy, {hash_sql('id * 3 + copy', 7)} as hh from base, (select unnest([0, 1, 2]) as copy))
select id, copy, row_number() over (partition by copy order by hh, id) as position from c"""))
def _(t):
    return R.replicate(t.base().select("id"), "id", 3, 7)


@case("residual_trimming", with_base("""
, r as (select id, abs(y - m3) as r from scores) select id from r where r <= (select quantile_cont(r, 0.98) from r)"""))
def _(t):
    return R.trim_residuals(t.scores(), "y", "m3", 2).select("id")


@case("confident_error_pruning", with_base("""
select id, case when (y = 1 and m2 < 1.0e0 - 0.7e0) or (y = 0 and m2 > 0.7e0) then m2 else round(m3 * 0.5e0, 6) end as restored from scores"""))
def _(t):
    scored = t.scores()
    kept = R.prune_confident_errors(scored, "y", "m2", 0.7).select("id", (F.col("m3") * 0.5).alias("again"))
    return rounded(R.restore_predictions(scored, kept, "id", "m2", "again", "restored").select("id", "restored"), [])


@case("pseudo_labels", with_base(f"""
, s as (select id, pri, {h(8)} / {MODULUS}.0e0 as p from test)
select id, pri, y, 1.0e0 as weight from train union all select id, pri, cast(p >= 0.5e0 as int), 0.3e0 from s where p >= 0.9e0 or p <= 0.05e0"""))
def _(t):
    train = t.base("train").select("id", "pri", "y")
    test = t.base("test").select("id", "pri", (key_hash("id", 8) / float(MODULUS)).alias("p"))
    return R.pseudo_label(train, test, "y", "p", 0.05, 0.9, 0.3)


@case("difficulty_weights", with_base("""
, d as (select id, abs(m3 - y) as d from scores), e as (select min(d) as lo, max(d) as hi from d)
select id, round(0.5e0 + (d - lo) / (hi - lo + 1e-8) * 1.5e0, 6) as weight from d, e"""))
def _(t):
    return rounded(R.difficulty_weights(t.scores(), "y", "m3", 0.5, 2.0).select("id", "weight"), [])


@case("class_weights", with_base("""
, n as (select y, count(*) as n from train group by y), a as (select sum(n) as total, count(*) as k from n)
select id, round(total / (k * n), 6) as weight, round(case when y = 1 then (total - n) / n * 1.5e0 else 1.0e0 end, 6) as cost from train join n using (y), a"""))
def _(t):
    return rounded(R.class_weights(t.base("train"), "y", 1.5).select("id", "weight", "cost"), [])


@case("soft_targets", with_base("select id, round((1 - 0.25e0) * y + 0.25e0 * m3, 6) as soft from scores"))
def _(t):
    return rounded(R.soft_targets(t.scores(), "y", "m3", 0.25).select("id", "soft"), [])


@case("random_groups", with_base(f'select id, cast(floor((row_number() over (order by {h(12)}, id) - 1) / 256) as bigint) as "group" from train'))
def _(t):
    return R.random_groups(t.base("train"), "id", 256, 12).select("id", "group")


@case("target_decomposition", with_base("""
, l as (select id, y, (coalesce(price, 0) + bal) / (case when price is null then 1 else 2 end) * 0.00001e0 as linear from base)
select id, round(linear, 9) as linear, round(y - linear, 9) as remainder, cast(y as double) as restored from l"""))
def _(t):
    parts = R.decompose_target(t.base(), "y", ["price", "bal"], 0.00001)
    return rounded(R.recompose_target(parts, "remainder").select("id", "linear", "remainder", "restored"), [], 9)


@case("class_undersampling", """
with s as (select o_orderkey as id, case when o_totalprice < 60000 then 'low' when o_totalprice < 180000 then 'mid' else 'high' end as cls from orders),
n as (select cls, count(*) as n, min(count(*)) over () as least from s group by cls),
p as (select id, cls, row_number() over (partition by cls order by """ + h(14) + """, id) as pos from s)
select id, cls from p join n using (cls) where pos <= greatest(floor(n * (case cls when 'mid' then 0.5e0 when 'low' then 0.3e0 else 1.0e0 end)), least)""")
def _(t):
    p = F.col("o_totalprice")
    df = t.table("orders").select(F.col("o_orderkey").alias("id"), F.when(p < 60000, "low").when(p < 180000, "mid").otherwise("high").alias("cls"))
    return R.undersample(df, "id", "cls", {"mid": 0.5, "low": 0.3}, 14)


DRAW = f"""((({hash_sql('j', 17)}) * {MODULUS} + {hash_sql('j', 18)}) % n)"""


@case("class_oversampling", with_base(f"""
, n as (select y, count(*) as n from train group by y), top as (select max(n) as top from n),
numbered as (select id, y, row_number() over (partition by y order by {h(15)}, id) as pos from train),
draws as (select y, j, {DRAW} + 1 as p from n, top, (select unnest(range((select top from top))) as j) where n < top)
select id, y, cast(null as bigint) as draw from train where y in (select y from n, top where n = top)
union all select r.id, r.y, d.j from draws d join numbered r on d.y = r.y and d.p = r.pos"""))
def _(t):
    return R.oversample(t.base("train").select("id", "y"), "id", "y", 15)


@case("random_subsample", with_base(f"select id, price from (select id, price, row_number() over (order by {h(16)}, id) as pos from train) where pos <= 2500"))
def _(t):
    return R.subsample(t.base("train"), "id", 2500, 16).select("id", "price")


def swap_sql(column, i):
    step = (f"(({hash_sql('pos', 30 + 5 + i)}) * {MODULUS} + {hash_sql('pos', 30 + 6 + i)}) % size")
    return f"""(select p.id, case when pos <= floor(0.15e0 * size) then d.{column} else p.{column} end as {column}
 from (select id, {column}, size, row_number() over (order by {h(30 + 11 * (i + 1))}, id) as pos from sized) p
 left join donors d on d.row = {step} + 1)"""


@case("swap_noise", with_base(f"""
, sized as (select *, count(*) over () as size from train), donors as (select row_number() over (order by {h(30)}, id) as row, bal, seg from train)
select id, a.bal, b.seg from {swap_sql('bal', 0)} a join {swap_sql('seg', 1)} b using (id)"""))
def _(t):
    return R.swap_noise(t.base("train").select("id", "bal", "seg"), "id", ["bal", "seg"], 0.15, 30)


@case("median_fill", with_base("""
, m as (select median(price) as p, min(seg) as s from train)
select id, coalesce(price, p) as price, coalesce(case when id % 7 = 0 then null else seg end, s) as seg from base, m"""))
def _(t):
    df = t.base().select("id", "split", "price", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("seg")).alias("seg"))
    return P.fill_medians(df, t.base("train"), ["price"], ["seg"]).drop("split")


@case("standard_scaling", with_base("""
, s as (select avg(price) as mp, stddev_pop(price) as sp, avg(bal) as mb, stddev_pop(bal) as sb from train)
select id, round((price - mp) / sp, 6) as price_std, round((bal - mb) / sb, 6) as bal_std, 0.0e0 as one_std from base, s"""))
def _(t):
    one = lambda d: d.withColumn("one", F.lit(3))
    out = P.standard_scale(one(t.base()), one(t.base("train")), ["price", "bal", "one"])
    return rounded(out.select("id", "price_std", "bal_std", "one_std"), [])


@case("robust_scaling", with_base("""
, q as (select quantile_cont(price, 0.25) as a, quantile_cont(price, 0.5) as b, quantile_cont(price, 0.75) as c, quantile_cont(bal, 0.25) as d, quantile_cont(bal, 0.5) as e, quantile_cont(bal, 0.75) as f,
 min(spike) as lo, max(spike) as hi, quantile_cont(spike, 0.5) as m from (select *, cast(id % 20 = 0 as int) as spike from train)),
x as (select id, (price - b) / (c - a) as p, (bal - e) / (f - d) as v, (cast(id % 20 = 0 as int) - m) * 2.0e0 / (hi - lo) as s from base, q),
y as (select id, p / sqrt(1 + (p / 3) * (p / 3)) as p, v / sqrt(1 + (v / 3) * (v / 3)) as v, s / sqrt(1 + (s / 3) * (s / 3)) as s from x),
n as (select *, sqrt(coalesce(p * p, 0) + v * v + s * s) as norm from y)
select id, round(p / norm, 6) + 0.0e0 as price_rob, round(v / norm, 6) + 0.0e0 as bal_rob, round(s / norm, 6) + 0.0e0 as spike_rob from n"""))
def _(t):
    spiked = lambda d: d.withColumn("spike", (F.col("id") % 20 == 0).cast("int"))
    out = P.robust_scale(spiked(t.base()), spiked(t.base("train")), ["price", "bal", "spike"], smooth_clip=True, l2=True)
    return rounded(out.select("id", "price_rob", "bal_rob", "spike_rob"), [])


def polynomial_sql(x, coefficients):
    out = f"{coefficients[0]!r}e0" if "e" not in repr(coefficients[0]) else repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c if 'e' in repr(c) else repr(c) + 'e0'})"
    return out


def normal_sql(p):
    from foldwise.functions import scalar as S

    centre = f"{polynomial_sql('r', S.NORMAL_CENTRE_NUM)} * q / {polynomial_sql('r', S.NORMAL_CENTRE_DEN)}"
    tail = lambda s: f"{polynomial_sql(s, S.NORMAL_TAIL_NUM)} / {polynomial_sql(s, S.NORMAL_TAIL_DEN)}"
    return f"""(case when {p} < 0.02425e0 then {tail('lo')} when {p} > 1.0e0 - 0.02425e0 then -({tail('hi')}) else {centre} end)"""


@case("quantile_normal", with_base("""
, s as (select price, count(*) as n from train where price is not null group by price), c as (select price, n, sum(n) over (order by price) as upto from s), tot as (select sum(n) as total from s),
k as (select b.id, b.price, total, (select count(*) from train t where t.price < b.price) as below, (select count(*) from train t where t.price = b.price) as eq from base b, tot),
p as (select id, case when price is null then null else least(greatest((2 * below + eq) / (2 * total), 1e-7), 1.0e0 - 1e-7) end as p from k),
w as (select id, p, p - 0.5e0 as q, (p - 0.5e0) * (p - 0.5e0) as r, sqrt(-2.0e0 * ln(p)) as lo, sqrt(-2.0e0 * ln(1.0e0 - p)) as hi from p)
select id, round(""" + normal_sql("p") + """, 6) + 0.0e0 as price_norm from w"""))
def _(t):
    return rounded(P.quantile_normal(t.base(), t.base("train"), ["price"]).select("id", "price_norm"), [])


@case("redundant_column_removal", with_base("select id, price, bal from base"))
def _(t):
    df = t.base().select("id", "price", "bal", F.lit(7).alias("fixed"), (F.col("bal") * -2.5 + 3).alias("mirror"))
    return P.drop_redundant(df, ["price", "bal", "fixed", "mirror"])


@case("expanded_width", with_base("""
, l as (select count(distinct pri) as a, count(distinct seg) as b, count(distinct nat) as c from train)
select 2 + a + b + 8 as width, 2 + a + b + c as worst, 2 as one_hot, 1 as embedded from l"""))
def _(t):
    return P.expanded_width(t.base("train"), ["price", "bal"], ["pri", "seg", "nat"], limit=9, embedding=8)
