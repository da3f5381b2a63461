"""Scans, sinks, schema work and row-wise features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foldwise.functions.scalar import from_logit, to_logit
from foldwise.kernels.store import shared_folder
from foldwise.operators import rowwise as R
from foldwise.operators import schema as S
from foldwise.plans.cases import RATING_STEPS, case, rounded, with_base
from foldwise.sources import tables as T

RATINGS = [f"r{k}" for k in RATING_STEPS]


def scratch(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/queries/{uuid.uuid4().hex}"


@case("csv_scan", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def _(t):
    customer = t.table("customer")
    path = scratch(t.spark)
    T.write_table(customer, path, format="csv")
    return T.read_table(t.spark, path, schema=customer.schema)


@case("projected_scan", "select o_orderkey, o_totalprice from orders where o_totalprice > 100000")
def _(t):
    return t.table("orders", ["o_orderkey", "o_totalprice"]).filter(F.col("o_totalprice") > 100000)


@case("parquet_round_trip", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def _(t):
    path = scratch(t.spark)
    T.write_table(t.table("supplier"), path)
    return T.read_table(t.spark, path, format="parquet")


@case("prediction_sink", with_base("select id, least(greatest(m3 * 1.2e0 - 0.1e0, 0.0e0), 1.0e0) as target from scores"))
def _(t):
    path = scratch(t.spark)
    scored = t.scores().withColumn("raw", F.col("m3") * 1.2 - 0.1)
    T.write_predictions(scored, path, pred="raw", name="target")
    return T.read_table(t.spark, path, schema="id bigint, target double")


def stored_archive(t, models=4):
    folder = scratch(t.spark)
    scores = t.scores(models=models)
    for m in range(models):
        T.write_predictions(scores, f"{folder}/oof_m{m}.csv", pred=f"m{m}")
    return T.read_archive(t.spark, folder, "oof_")


@case("archive_scan", with_base("select model, id, pred from archive"))
def _(t):
    return stored_archive(t)


@case("archive_alignment", with_base("""
, kept as (select id from train where id % 4 <> 3),
damaged as (select model, id, case when model = 'm2' and id % 40 = 0 then null else pred end as pred
            from archive where not (model = 'm1' and id % 100 = 0)),
inside as (select d.* from damaged d semi join kept k on d.id = k.id),
whole as (select model from inside group by model
          having count(*) = count(pred) and count(distinct id) = (select count(*) from kept))
select i.model, i.id, i.pred from inside i semi join whole w on i.model = w.model"""))
def _(t):
    kept = t.base("train").filter(F.col("id") % 4 != 3)
    damaged = t.archive().filter(~((F.col("model") == "m1") & (F.col("id") % 100 == 0)))
    damaged = damaged.withColumn("pred", F.when((F.col("model") == "m2") & (F.col("id") % 40 == 0), None).otherwise(F.col("pred")))
    return T.align_archive(damaged, kept)


@case("target_mapping", """select o_orderkey, case o_orderstatus when 'F' then 0 when 'O' then 1 when 'P' then 2 end as y
from orders""")
def _(t):
    noisy = t.table("orders").select("o_orderkey", F.concat(F.lit(" "), F.lower("o_orderstatus"), F.lit(" ")).alias("status"))
    return S.map_target(noisy, "status", {"F": 0, "O": 1, "P": 2}).select("o_orderkey", "y")


@case("lenient_cast", """
with texts as (select o_orderkey, case when o_orderkey % 11 = 0 then ' ' else cast(cast(floor(o_totalprice) as bigint) as varchar) end as txt from orders),
parsed as (select o_orderkey, try_cast(trim(txt) as double) as v from texts)
select o_orderkey, coalesce(v, (select quantile_cont(v, 0.5) from parsed)) as amount from parsed""")
def _(t):
    price = F.floor("o_totalprice").cast("string")
    texts = t.table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise(price).alias("txt"))
    return S.cast_numeric(texts, "txt", name="amount").select("o_orderkey", "amount")


@case("schema_alignment", with_base("""
select id, pri, seg, price, y, cast(null as double) as extra from (
  select id, pri, seg, price, y from train union all select id, pri, seg, price, y from orig)"""))
def _(t):
    like = t.base("train").select("id", "pri", "seg", "price", "y", F.lit(None).cast("double").alias("extra"))
    orig = t.base("orig").select("y", "seg", "nat", "price", "id", "pri")
    return like.unionByName(S.align_schema(orig, like))


@case("column_sanitising", "select c_custkey as c_custkey, c_acctbal as account_balance, c_mktsegment as market_segment from customer")
def _(t):
    c = t.table("customer")
    odd = c.select("c_custkey", F.col("c_acctbal").alias(" Account Balance"), F.col("c_mktsegment").alias("Market-Segment "))
    return S.sanitize_columns(odd)


@case("column_roles", """select 'categorical' as role, 2 as n_columns, count(*) as n_rows from lineitem
union all select 'numeric', 8, count(*) from lineitem""")
def _(t):
    lineitem = t.table("lineitem")
    roles = S.column_roles(lineitem)
    counted = lineitem.agg(F.count(F.lit(1)).alias("n_rows"))
    parts = [counted.select(F.lit(r).alias("role"), F.lit(len(c)).alias("n_columns"), "n_rows") for r, c in roles.items()]
    return parts[0].unionByName(parts[1])


@case("label_census", with_base("""
, l as (select case when split = 'test' then null else y end as label from base)
select label, count(*) as n, case when label is null then null
  else round(count(*) / cast((select count(label) from l) as double), 6) end as share from l group by label"""))
def _(t):
    hidden = t.base().withColumn("label", F.when(F.col("split") == "test", None).otherwise(F.col("y")))
    return rounded(S.label_census(hidden, "label"), [])


DIGITS = ", ".join(f"cast(((floor(o_totalprice {'/' if k >= 0 else '*'} {10.0 ** abs(k)}e0) % 10) + 10) % 10 as int) as \"price_digit{k}\"" for k in range(-4, 4))


@case("digit_extraction", f"select o_orderkey as id, {DIGITS} from orders")
def _(t):
    df = t.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return R.add_digits(df, ["price"]).drop("price")


@case("magnitude_rounding", """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
 round_even(l_tax, case when mt < 10 then 3 when mt < 100 then 2 else 1 end) as l_tax,
 round_even(l_quantity / 7, case when mq < 10 then 3 when mq < 100 then 2 else 1 end) as q,
 round_even(l_extendedprice, case when mp < 10 then 3 when mp < 100 then 2 else 1 end) as l_extendedprice
 from lineitem, (select max(l_tax) mt, max(l_quantity / 7) mq, max(l_extendedprice) mp from lineitem)""")
def _(t):
    df = t.table("lineitem").withColumn("q", F.col("l_quantity") / 7)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return R.round_by_magnitude(df.select(*keys, "l_tax", "q", "l_extendedprice"), ["l_tax", "q", "l_extendedprice"])


@case("digit_strings", """
with s as (select o_orderkey as id, o_totalprice as p, cast(floor(o_totalprice) as bigint) as w,
  cast(cast(floor(o_totalprice) as bigint) as varchar) as s from orders)
select id, cast(s[1] as int) as p_first_digit, cast(case when len(s) > 1 then s[2] else '0' end as int) as p_second_digit,
 cast(s[-1] as int) as p_last_digit, cast(len(s) as int) as p_num_digits, round(p - w, 6) as p_fractional,
 w % 12 as p_mod12, round(p / (len(s) + 0.001e0), 6) as p_per_digit,
 w % 10 as p_mod10, cast(w % 10 = 0 as int) as p_is_multiple_10, round(abs(p - round_even(p / 10.0e0, 0) * 10.0e0), 6) as p_dev_from_round10,
 w % 100 as p_mod100, cast(w % 100 = 0 as int) as p_is_multiple_100, round(abs(p - round_even(p / 100.0e0, 0) * 100.0e0), 6) as p_dev_from_round100
from s""")
def _(t):
    df = t.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("p"))
    return rounded(R.add_digit_strings(df, "p").drop("p"), [])


@case("arithmetic_interactions", with_base("""
select id, round(price * bal, 5) as price_bal, round(price - nat * bal, 6) as gap, round(price / (bal + 20000.0e0), 6) as price_per_bal,
 round(price / (bal * bal + 1.0e0), 6) as price_per_bal2, case when price is null then null else round(ln(1 + greatest(price, 0.0e0)) - ln(1 + greatest(bal, 0.0e0)), 6) end as log_gap
from base"""))
def _(t):
    df = R.add_interactions(t.base(), {
        "price_bal": F.round(R.product("price", "bal"), 5),
        "gap": R.product_gap("price", "nat", "bal"),
        "price_per_bal": R.ratio("price", "bal", 20000.0),
        "price_per_bal2": R.ratio_square("price", "bal"),
        "log_gap": R.log_ratio("price", "bal"),
    })
    return rounded(df.select("id", "price_bal", "gap", "price_per_bal", "price_per_bal2", "log_gap"), ["price_bal"])


@case("monotone_transforms", """
with s as (select avg(l_quantity) as mu, stddev_samp(l_quantity) as sd from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
 round(ln(1 + greatest(l_quantity, 0)), 6) as l_quantity_log1p, round(sqrt(greatest(l_quantity, 0)), 6) as l_quantity_sqrt,
 round(cbrt(l_quantity), 6) as l_quantity_cbrt, l_quantity * l_quantity as l_quantity_square, l_quantity * l_quantity * l_quantity as l_quantity_cube,
 round(1.0e0 / (l_quantity + 1.0e0), 6) as l_quantity_inverse, round(tanh(l_quantity / 10.0e0), 6) as l_quantity_tanh,
 round(1.0e0 - exp(-l_quantity / 10.0e0), 6) as l_quantity_saturate, round(1.0e0 / (1.0e0 + exp(-(l_quantity - mu) / (sd + 1e-5))), 6) as l_quantity_sigmoid
from lineitem, s""")
def _(t):
    df = t.table("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    kinds = ["log1p", "sqrt", "cbrt", "square", "cube", "inverse", "tanh", "saturate", "sigmoid"]
    return rounded(R.add_transforms(df, ["l_quantity"], kinds, scale=10.0).drop("l_quantity"), ["l_quantity_square", "l_quantity_cube"])


@case("periodic_encoding", """select p_partkey, round(sin(2 * pi() * p_size / 12.0e0), 6) + 0.0e0 as p_size_sin, round(cos(2 * pi() * p_size / 12.0e0), 6) + 0.0e0 as p_size_cos from part""")
def _(t):
    return rounded(R.add_periodic(t.table("part", ["p_partkey", "p_size"]), "p_size", 12).drop("p_size"), [])


@case("linear_formula", with_base("""
select id, round(-1.5e0 + coalesce(price * 0.0001e0, 0.0e0) + bal * 0.0002e0 + (case when pri = '1-URGENT' then 1.0e0 else 0.0e0 end)
  + (case when seg = 'BUILDING' then 0.6e0 else 0.0e0 end), 6) as score from base"""))
def _(t):
    df = R.linear_score(t.base(), {"price": 0.0001, "bal": 0.0002}, {("pri", "1-URGENT"): 1.0, ("seg", "BUILDING"): 0.6}, -1.5)
    return rounded(df.select("id", "score"), [])


@case("rule_flags", with_base("""
select id, coalesce(cast(price > 170537 as int), 0) as high_price, cast(pri = '1-URGENT' and seg = 'BUILDING' as int) as recipe,
 cast(bal between 0 and 1000 as int) as low_balance, cast(nat = 7 or nat = 9 as int) as spike from base"""))
def _(t):
    c = F.col
    df = R.add_flags(t.base(), {
        "high_price": c("price") > 170537,
        "recipe": (c("pri") == "1-URGENT") & (c("seg") == "BUILDING"),
        "low_balance": c("bal").between(0, 1000),
        "spike": (c("nat") == 7) | (c("nat") == 9),
    })
    return df.select("id", "high_price", "recipe", "low_balance", "spike")


@case("ordinal_map", with_base("""
select id, case pri when '1-URGENT' then 4 when '2-HIGH' then 3 when '3-MEDIUM' then 2 else -1 end as rank from base"""))
def _(t):
    levels = {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2}
    return R.ordinal_map(t.base(), "pri", levels, -1, "rank").select("id", "rank")


@case("banding", with_base("""
select id, case when price is null then 'none' when price < 50000 then 'low' when price < 200000 then 'mid' else 'high' end as band from base"""))
def _(t):
    p = F.col("price")
    conditions = [(p.isNull(), "none"), (p < 50000, "low"), (p < 200000, "mid")]
    return R.banded(t.base(), "band", conditions, "high").select("id", "band")


def unnested(body):
    listed = ", ".join(RATINGS)
    return with_base(f", long as (select id, unnest([{listed}]) as v from ratings) {body}")


@case("row_stats", unnested("""
select id, round(avg(nullif(v, 0)), 6) as row_mean, round(stddev_samp(nullif(v, 0)), 6) as row_std, cast(min(nullif(v, 0)) as double) as row_min,
 cast(max(nullif(v, 0)) as double) as row_max, cast(max(nullif(v, 0)) - min(nullif(v, 0)) as double) as row_range from long group by id"""))
def _(t):
    return rounded(R.row_stats(t.ratings(), RATINGS, ignore=0).drop(*RATINGS), [])


@case("row_counts", unnested("""
select id, cast(sum(cast(v >= 4 as int)) as int) as n_ge4, cast(sum(cast(v <= 2 and v > 0 as int)) as int) as n_le2,
 cast(sum(cast(v = 5 as int)) as int) as n_eq5, cast(sum(cast(v = 0 as int)) as int) as n_0 from long group by id"""))
def _(t):
    tests = {"n_ge4": lambda c: c >= 4, "n_le2": lambda c: (c <= 2) & (c > 0), "n_eq5": lambda c: c == 5, "n_0": lambda c: c == 0}
    return R.row_counts(t.ratings(), RATINGS, tests).drop(*RATINGS)


@case("row_sorted", unnested("""
, s as (select id, list_sort(list(cast(v as double))) as s, avg(v) as m, stddev_pop(v) as sd, max(v) as hi, min(v) as lo from long group by id)
select id, s[1] as sorted_0, s[2] as sorted_1, s[3] as sorted_2, s[4] as sorted_3, s[5] as sorted_4, s[6] as sorted_5,
 round(m, 6) as sorted_mean, round(sd, 6) as sorted_std, cast(lo as double) as sorted_min, cast(hi as double) as sorted_max,
 cast(hi - lo as double) as sorted_range from s"""))
def _(t):
    return rounded(R.row_sorted(t.ratings(), RATINGS).drop(*RATINGS), [])


@case("row_centering", with_base(f"""
, m as (select id, {', '.join(RATINGS)}, ({' + '.join(RATINGS)}) / nullif(cast({' + '.join(f'cast({r} <> 0 as int)' for r in RATINGS)} as double), 0) as m from ratings)
select id, {', '.join(f'case when {r} = 0 then 0.0e0 else round({r} - m, 6) + 0.0e0 end as {r}_centred' for r in RATINGS)} from m"""))
def _(t):
    return rounded(R.row_center(t.ratings(), RATINGS).drop(*RATINGS), [])


@case("prediction_summary", with_base("""
, l as (select id, unnest([m0, m1, m2, m3]) as v from scores)
select id, round(avg(v), 6) as pred_mean, round(stddev_samp(v), 6) as pred_std, min(v) as pred_min, max(v) as pred_max,
 round(max(v) - min(v), 6) as pred_range from l group by id"""))
def _(t):
    models = ["m0", "m1", "m2", "m3"]
    return rounded(R.row_stats(t.scores().select("id", *models), models, prefix="pred").drop(*models), ["pred_min", "pred_max"])


@case("delay_features", """
with d as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity - 25 as dep,
  case when (l_orderkey + l_linenumber) % 9 = 0 then null else l_quantity * l_tax end as arr, l_extendedprice as dist from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(dep > 0 as int) as dep_positive, cast(arr is null as int) as arr_missing,
 round(arr - dep, 6) as delay_gap, round(dep + coalesce(arr, dep), 6) as delay_total,
 round((dep + coalesce(arr, dep)) / (dist / 100.0e0), 6) as delay_per_100 from d""")
def _(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    missing = (F.col("l_orderkey") + F.col("l_linenumber")) % 9 == 0
    df = t.table("lineitem").select(
        *keys, (F.col("l_quantity") - 25).alias("dep"),
        F.when(missing, None).otherwise(F.col("l_quantity") * F.col("l_tax")).alias("arr"), F.col("l_extendedprice").alias("dist"))
    return rounded(R.delay_features(df, "dep", "arr", "dist").drop("dep", "arr", "dist"), [])


@case("logit_round_trip", with_base("""
select id, round(least(greatest(ln(p / (1.0e0 - p)), -30), 30), 6) as z, round(1.0e0 / (1.0e0 + exp(-ln(p / (1.0e0 - p)))), 6) as p
from (select id, least(greatest(m3, 1e-6), 1.0e0 - 1e-6) as p from scores)"""))
def _(t):
    df = t.scores().select("id", to_logit("m3").alias("z"))
    return rounded(df.withColumn("p", from_logit("z")), [])


@case("cell_code", with_base("""
select id, (case when price is null then 1 when price <= 100000 then 0 when price <= 200000 then 1 else 2 end) * 9
 + (case when bal <= 2000 then 0 when bal <= 6000 then 1 else 2 end) * 3 + cast(nat % 3 as int) as cell from base"""))
def _(t):
    p, b = F.col("price"), F.col("bal")
    df = R.banded(t.base(), "pb", [(p.isNull(), 1), (p <= 100000, 0), (p <= 200000, 1)], 2)
    df = R.banded(df, "bb", [(b <= 2000, 0), (b <= 6000, 1)], 2).withColumn("nb", (F.col("nat") % 3).cast("int"))
    return R.cell_code(df, ["pb", "bb", "nb"], [3, 3, 3]).select("id", "cell")


@case("rule_routing", with_base("""
select id, case when price > 200000 and bal > 5000 then m3 when price < 60000 then m0 when bal < 0 then m1
  else round(0.4e0 * m2 + 0.3e0 * m3 + 0.3e0 * m0, 6) end as routed from scores"""))
def _(t):
    c = F.col
    rules = [((c("price") > 200000) & (c("bal") > 5000), c("m3")), (c("price") < 60000, c("m0")), (c("bal") < 0, c("m1"))]
    blend = 0.4 * c("m2") + 0.3 * c("m3") + 0.3 * c("m0")
    return rounded(R.route(t.scores(), rules, blend).select("id", "routed"), [])
