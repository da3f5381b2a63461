"""Binning, encodings over edges, and nearest-neighbour features."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import binning as B
from foldwise.operators import neighbours as N
from foldwise.operators import optimal_bins as O
from foldwise.plans.cases import case, rounded, with_base


def edges_sql(name, source, column, k, inner=True):
    qs = [i / k for i in range(k + 1)]
    listed = ", ".join(f"{q!r}e0" for q in qs)
    unique = f"list_sort(list_distinct(quantile_cont({column}, [{listed}])))"
    cut = f"{unique}[2:-2]" if inner else unique
    return f"{name} as (select {cut} as edges from {source})"


@case("quantile_bins", with_base(f"""
, md as (select median(price) as md from train), tr as (select coalesce(price, md) as price from train, md), {edges_sql('e', 'tr', 'price', 8)}
select id, cast(len(list_filter(edges, lambda x: x <= coalesce(price, md))) as int) as price_q8 from base, e, md"""))
def _(t):
    return B.quantile_bins(t.base(), t.base("train"), "price", 8).select("id", "price_q8")


@case("tied_quantile_bins", with_base(f"""
, f as (select id, split, nat % 3 as v from base), {edges_sql('e', "(select v from f where split = 'train')", 'v', 6)}
select id, cast(len(list_filter(edges, lambda x: x <= v)) as int) as v_q6 from f, e"""))
def _(t):
    df = t.base().withColumn("v", F.col("nat") % 3)
    return B.quantile_bins(df, df.filter("split = 'train'"), "v", 6).select("id", "v_q6")


@case("fold_quantile_bins", with_base(f"""
, r as (select unnest([0, 1, 2, 3, 4]) as fold), e as (select r.fold, list_distinct(quantile_cont(bal, [{', '.join(f'{i / 7!r}e0' for i in range(1, 7))}])) as edges from folded f join r on f.fold <> r.fold group by r.fold)
select id, cast(len(list_filter(edges, lambda x: x <= bal)) as int) as bal_fq7 from folded join e using (fold)"""))
def _(t):
    return B.fold_quantile_bins(t.folded(), "bal", 7, "fold", 5).select("id", "bal_fq7")


@case("qcut", with_base(f", {edges_sql('e', 'base', 'bal', 5)} select id, cast(len(list_filter(edges, lambda x: x < bal)) as int) as bal_qcut5 from base, e"))
def _(t):
    return B.qcut(t.base(), "bal", 5).select("id", "bal_qcut5")


@case("equal_width_cut", with_base(f"""
, e as (select min(price) as lo, max(price) as hi from base)
select id, {' + '.join(f'cast(price > lo + (hi - lo) / 6.0e0 * {i}.0e0 as int)' for i in range(1, 6))} as price_cut6 from base, e"""))
def _(t):
    return B.cut_equal(t.base(), "price", 6).select("id", "price_cut6")


@case("equal_width_integer_bins", with_base("""
, e as (select min(price) as lo, max(price) as hi from base) select id, cast(floor((price - lo) * (32.0e0 / (hi - lo + 1.0e0))) as bigint) as price_w32 from base, e"""))
def _(t):
    return B.equal_width_bin(t.base(), "price", 32).select("id", "price_w32")


@case("fixed_edge_bands", with_base("""
select id, case when bal >= 0 and bal <= 1000 then 0 when bal > 1000 and bal <= 5000 then 1 when bal > 5000 and bal <= 8000 then 2 else -1 end as bal_band from base"""))
def _(t):
    return B.cut_edges(t.base(), "bal", [0.0, 1000.0, 5000.0, 8000.0], [0, 1, 2]).select("id", "bal_band")


@case("reference_quantile_code", with_base(f"""
, q as (select quantile_cont(price, [{', '.join(f'{i / 10!r}e0' for i in range(1, 10))}]) as edges from orig)
select id, case when price is not null then cast(1 + len(list_filter(edges, lambda x: x <= price)) as int) end as price_ref10 from base, q"""))
def _(t):
    return B.ref_quantile_code(t.base(), t.base("orig"), "price", 10).select("id", "price_ref10")


@case("supervised_tree_bins")
def _(t):
    return B.tree_bins(t.base(), t.base("train"), "price", "y", 8).select("id", "price_tree")


@case("piecewise_linear_encoding", with_base(f"""
, q as (select quantile_cont(price, [0.25e0, 0.5e0, 0.75e0]) as e from train)
select id, cast(price >= e[1] as double) as price_ple0, case when price is not null then round(least(greatest((price - e[1]) / (e[2] - e[1]), 0), 1), 6) end as price_ple1,
 case when price is not null then round(least(greatest((price - e[2]) / (e[3] - e[2]), 0), 1), 6) end as price_ple2, case when price is not null then 0.0e0 end as price_ple3 from base, q"""))
def _(t):
    from foldwise.kernels.quantiles import quantile_values

    edges = quantile_values(t.base("train"), "price", [0.25, 0.5, 0.75])
    out = B.ple(t.base(), "price", edges)
    return rounded(out.select("id", "price_ple0", "price_ple1", "price_ple2", "price_ple3"), [])


@case("hinge_segments", with_base("""
select id, round(least(greatest(bal - 0.0e0, 0), 3000), 6) as bal_seg0, round(least(greatest(bal - 3000.0e0, 0), 3000), 6) as bal_seg1, round(greatest(bal - 6000.0e0, 0), 6) as bal_seg2 from base"""))
def _(t):
    return rounded(B.ple(t.base(), "bal", [0.0, 3000.0, 6000.0], scaled=False).select("id", "bal_seg0", "bal_seg1", "bal_seg2"), [])


def iv_sql(cells, keys):
    return with_base(f"""
, md as (select median(price) as mp, median(bal) as mb from train), tr as (select coalesce(price, mp) as price, coalesce(bal, mb) as bal, y from train, md),
{edges_sql('ep', 'tr', 'price', 5)}, {edges_sql('eb', 'tr', 'bal', 5)},
g as (select {cells}, count(*) as n, cast(sum(y) as bigint) as events from tr, ep, eb group by all), tt as (select sum(y) as pos, sum(1 - y) as neg from tr),
w as (select g.*, events / cast(pos as double) as p, (n - events) / cast(neg as double) as q from g, tt)
select {keys}, n, events, round(case when p > 0 and q > 0 then ln(q / p) else 0 end, 6) as woe, round(case when p > 0 and q > 0 then (q - p) * ln(q / p) else 0 end, 6) as iv from w""")


P_BIN = "cast(len(list_filter(ep.edges, lambda x: x <= price)) as int)"
B_BIN = "cast(len(list_filter(eb.edges, lambda x: x <= bal)) as int)"


@case("information_value", iv_sql(f"{P_BIN} as bin", "bin"))
def _(t):
    return rounded(B.iv_table(t.base("train"), "price", "y", 5), [])


@case("information_value_pairs", iv_sql(f"{P_BIN} as bin_a, {B_BIN} as bin_b", "bin_a, bin_b"))
def _(t):
    return rounded(B.iv_table_2d(t.base("train"), "price", "bal", "y", 5), [])


def partitions_sql(by_rate, max_bins, share, result):
    """Every contiguous partition of the counted pre-bins ``cnt(col, code, n, events)`` into monotone bins, and the one with the most
    information value; ``by_rate`` is SQL for "columns whose pre-bins stand in the order of event rate"."""
    return f""", tot as (select sum(y) * 1.0e0 as pos, sum(1 - y) * 1.0e0 as neg, count(*) as n from train),
ord as (select *, row_number() over (partition by col order by case when {by_rate} then events / cast(n as double) else code end, code) as p from cnt where code is not null),
cum as (select col, p, sum(n) over w as cn, sum(events) over w as ce, max(p) over (partition by col) as m from ord window w as (partition by col order by p)),
seg0 as (select b.col, coalesce(a.p, 0) + 1 as i, b.p as j, b.m, b.cn - coalesce(a.cn, 0) as n, b.ce - coalesce(a.ce, 0) as ev
  from cum b join (select col, p, cn, ce from cum union all select distinct col, 0, 0, 0 from cum) a on a.col = b.col and a.p < b.p),
seg as (select s.*, ev / cast(s.n as double) as rate, case when ev > 0 and s.n > ev then ((s.n - ev) / neg - ev / pos) * ln(((s.n - ev) / neg) / (ev / pos)) else 0 end as iv
  from seg0 s, tot where s.n >= {share} * tot.n),
paths as (select col, j, m, 1 as bins, rate, iv, [i - 1] as starts, d from seg, (select unnest([1, -1]) as d) where i = 1
  union all select s.col, s.j, s.m, bins + 1, s.rate, p.iv + s.iv, list_append(starts, s.i - 1), d from paths p join seg s on s.col = p.col and s.i = p.j + 1
  where bins < {max_bins} and (s.rate - p.rate) * d >= 0),
top as (select col, arg_max(starts, (round(iv, 9), d, -bins)) as starts from paths where j = m group by col),
assigned as (select o.col, o.code, o.n, o.events, cast(len(list_filter(starts, lambda x: x < o.p)) - 1 as int) as bin from ord o join top on o.col = top.col
  union all select col, code, n, events, -1 from cnt where code is null),
bins as (select col, bin, cast(sum(n) as bigint) as n, cast(sum(events) as bigint) as events from assigned group by all),
valued as (select bins.*, case when events > 0 and bins.n > events then ln(((bins.n - events) / neg) / (events / pos)) else 0 end as woe, pos, neg from bins, tot)
{result}"""


def recursive(sql):
    return sql.replace("with base as", "with recursive base as", 1)


BIN_ROWS = """select col as "column", bin, n, events, round(woe, 6) + 0.0e0 as woe, round(((n - events) / neg - events / pos) * woe, 6) + 0.0e0 as iv from valued"""
TWELFTHS = ", ".join(f"{i / 12!r}e0" for i in range(1, 12))
OPTIMAL_COUNTS = f""", e as (select list_distinct(quantile_cont(price, [{TWELFTHS}])) as ep, list_distinct(quantile_cont(bal, [{TWELFTHS}])) as eb from train),
kp as (select list_sort(list(distinct pri)) as kp, list_sort(list(distinct seg)) as ks from train),
cnt as (select 'price' as col, case when price is not null then len(list_filter(ep, lambda x: x <= price)) end as code, count(*) as n, cast(sum(y) as bigint) as events from train, e group by all
 union all select 'bal', len(list_filter(eb, lambda x: x <= bal)), count(*), sum(y) from train, e group by all
 union all select 'pri', list_position(kp, pri) - 1, count(*), sum(y) from train, kp group by all
 union all select 'seg', list_position(ks, seg) - 1, count(*), sum(y) from train, kp group by all)"""
BY_RATE = "col in ('pri', 'seg')"


def optimal(t):
    return O.optimal_bins(t.base("train"), ["price", "bal"], ["pri", "seg"], "y", prebins=12, max_bins=4, share=0.05)


@case("optimal_binning", recursive(with_base(OPTIMAL_COUNTS + partitions_sql(BY_RATE, 4, "0.05e0", BIN_ROWS))))
def _(t):
    return rounded(O.bin_table(optimal(t)[1]), [])


@case("optimal_woe_encoding", recursive(with_base(OPTIMAL_COUNTS + partitions_sql(BY_RATE, 4, "0.05e0", """,
w as (select a.col, a.code, any_value(v.woe) as woe from assigned a join valued v on a.col = v.col and a.bin = v.bin group by all),
p as (select base.*, case when price is not null then len(list_filter(ep, lambda x: x <= price)) end as cp, len(list_filter(eb, lambda x: x <= bal)) as cb, list_position(kp, pri) - 1 as c1, list_position(ks, seg) - 1 as c2 from base, e, kp)
select id, round(coalesce(a.woe, 0), 6) + 0.0e0 as price_woe, round(coalesce(b.woe, 0), 6) + 0.0e0 as bal_woe, round(coalesce(c.woe, 0), 6) + 0.0e0 as pri_woe, round(coalesce(d.woe, 0), 6) + 0.0e0 as seg_woe
from p left join w a on a.col = 'price' and a.code is not distinct from cp left join w b on b.col = 'bal' and b.code is not distinct from cb
 left join w c on c.col = 'pri' and c.code is not distinct from c1 left join w d on d.col = 'seg' and d.code is not distinct from c2"""))))
def _(t):
    columns = ["price", "bal", "pri", "seg"]
    out = O.optimal_woe(t.base(), *optimal(t), columns)
    return rounded(out.select("id", *[f"{c}_woe" for c in columns]), [])


@case("optimal_binning_pairs", recursive(with_base(""", e as (select list_distinct(quantile_cont(price, [0.3333333333333333e0, 0.6666666666666666e0])) as ep, list_distinct(quantile_cont(bal, [0.3333333333333333e0, 0.6666666666666666e0])) as eb from train),
kp as (select list_sort(list(distinct pri)) as kp, list_sort(list(distinct seg)) as ks from train),
cnt as (select 'price*bal' as col, case when price is not null then len(list_filter(ep, lambda x: x <= price)) end * 3 + len(list_filter(eb, lambda x: x <= bal)) as code, count(*) as n, cast(sum(y) as bigint) as events from train, e group by all
 union all select 'price*seg', case when price is not null then len(list_filter(ep, lambda x: x <= price)) end * 6 + list_position(ks, seg) - 1, count(*), sum(y) from train, e, kp group by all)"""
+ partitions_sql("true", 4, "0.05e0", BIN_ROWS))))
def _(t):
    table = O.optimal_bins_2d(t.base("train"), [("price", "bal"), ("price", "seg")], ["price", "bal"], "y", prebins=3, max_bins=4, share=0.05)[1]
    return rounded(O.bin_table(table), [])


# ---------------------------------------------------------------------------------------------------------------

AXES = """, st as (select avg(price) as mp, stddev_samp(price) as sp, avg(bal) as mb, stddev_samp(bal) as sb from orig),
z as (select id, split, y, coalesce((price - mp) / (sp + 1e-9), 0) as u, coalesce((bal - mb) / (sb + 1e-9), 0) as v from base, st)"""


def near_sql(k, queries, refs, tag="nn", filter="true"):
    """The k nearest by one aggregate per row: the k smallest (distance, id, label) of all reference rows."""
    entry = "struct_pack(distance := sqrt((q.u - r.u) * (q.u - r.u) + (q.v - r.v) * (q.v - r.v)), ref_id := r.id, label := r.y)"
    return f""", {tag}_l as (select q.id, min({entry}, {k}) as best from (select * from z where {queries}) q, (select * from z where {refs}) r where {filter} group by q.id),
{tag}_u as (select id, unnest(best) as e, generate_subscripts(best, 1) as rank from {tag}_l), {tag} as (select id, rank, e.distance as distance, e.ref_id as ref_id, e.label as label from {tag}_u)"""


def near_grid_sql(k, queries, refs, tag):
    """The same by a grid: rows whose k-th distance in the nine squares around them is within a square's side are settled, the
    others are compared with every reference row."""
    entry = "struct_pack(distance := sqrt((q.u - r.u) * (q.u - r.u) + (q.v - r.v) * (q.v - r.v)), ref_id := r.id, label := r.y)"
    square = "cast(floor(u / h) as bigint) as bu, cast(floor(v / h) as bigint) as bv"
    return f""", {tag}_h as (select 3.0e0 * sqrt({k}.0e0 / count(*)) as h from z where {refs}),
{tag}_r as (select id, y, u, v, {square} from z, {tag}_h where {refs}), {tag}_q as (select id, u, v, h, {square} from z, {tag}_h where {queries}),
{tag}_9 as (select q.*, bu + dx as cu, bv + dy as cv from {tag}_q q, (select unnest([-1, 0, 1]) as dx), (select unnest([-1, 0, 1]) as dy)),
{tag}_n as (select q.id, min({entry}, {k}) as best, any_value(q.h) as h from {tag}_9 q join {tag}_r r on r.bu = q.cu and r.bv = q.cv group by q.id),
{tag}_ok as (select id, best from {tag}_n where len(best) = {k} and best[{k}].distance <= h),
{tag}_l as (select * from {tag}_ok union all select q.id, min({entry}, {k}) as best from (select * from {tag}_q anti join {tag}_ok using (id)) q, {tag}_r r group by q.id),
{tag}_u as (select id, unnest(best) as e, generate_subscripts(best, 1) as rank from {tag}_l), {tag} as (select id, rank, e.distance as distance, e.ref_id as ref_id, e.label as label from {tag}_u)"""


POOL, ORIG = "split <> 'orig'", "split = 'orig'"


def axes(t, role):
    rows = t.base("orig") if role == "orig" else t.base().filter("split <> 'orig'")
    return N.standardize(rows, t.base("orig"), ["price", "bal"])


NEIGHBOUR_SQL = with_base(AXES + near_sql(5, POOL, ORIG) + " select id, cast(rank as int) as rank, ref_id, round(distance, 6) as distance, cast(label as double) as label from nn")


@case("nearest_neighbours", NEIGHBOUR_SQL)
def _(t):
    return rounded(N.knn_join(axes(t, "pool"), axes(t, "orig"), ["price_z", "bal_z"], 5, label="y"), [])


@case("nearest_neighbours_ranges", NEIGHBOUR_SQL)
def _(t):
    """The same through cells around pivots, as for a reference set too large to ship."""
    return rounded(N.knn_join(axes(t, "pool"), axes(t, "orig"), ["price_z", "bal_z"], 5, label="y", shipped=1200), [])


@case("knn_label_mean", with_base(AXES + near_sql(15, POOL, ORIG) + """
, m as (select id, avg(label) as m from nn where distance > 1e-9 group by id)
select t.id, round(coalesce(m, (select avg(y) from orig)), 6) as knn_mean from base t left join m using (id) where split <> 'orig'"""))
def _(t):
    return rounded(N.knn_label_mean(axes(t, "pool"), axes(t, "orig"), ["price_z", "bal_z"], "y", 15).select("id", "knn_mean"), [])


@case("knn_weighted_vote", with_base(AXES + near_sql(10, POOL, ORIG) + """
select id, round(sum(label / (distance + 1e-6)) / sum(1 / (distance + 1e-6)), 6) as knn_vote from nn group by id"""))
def _(t):
    return rounded(N.knn_vote(axes(t, "pool"), axes(t, "orig"), ["price_z", "bal_z"], "y", 10).select("id", "knn_vote"), [])


@case("class_neighbour_distance", with_base(AXES + near_sql(5, POOL, ORIG, "n0", "r.y = 0") + near_sql(5, POOL, ORIG, "n1", "r.y = 1") + """
, a as (select id, avg(distance) as m, min(distance) as f from n0 group by id), b as (select id, avg(distance) as m, min(distance) as f from n1 group by id)
select id, round(a.m, 6) as near_0_mean, round(a.f, 6) as near_0_first, round(b.m, 6) as near_1_mean, round(b.f, 6) as near_1_first,
 round(b.m / (a.m + 1e-6), 4) as near_ratio, round(a.m - b.m, 6) + 0.0e0 as near_gap from a join b using (id)"""))
def _(t):
    out = N.knn_class_distance(axes(t, "pool"), axes(t, "orig"), ["price_z", "bal_z"], "y", 5)
    out = out.select("id", "near_0_mean", "near_0_first", "near_1_mean", "near_1_first", "near_ratio", "near_gap")
    return rounded(out.withColumn("near_ratio", F.round("near_ratio", 4)), ["near_ratio"])


@case("knn_density_ratio", with_base("""
, pool as (select * from base where split <> 'orig'), md as (select median(price) as p, median(bal) as b from pool), st as (select avg(price) as mp, stddev_pop(price) as sp, avg(bal) as mb, stddev_pop(bal) as sb from pool),
z as (select id, split, y, (coalesce(price, p) - mp) / sp as u, (coalesce(bal, b) - mb) / sb as v from base, md, st)""" + near_grid_sql(15, "true", POOL, "np") + near_grid_sql(15, "true", ORIG, "no") + """,
l as (select a.id, a.rank, ln((b.distance + 1e-6) / (a.distance + 1e-6)) as r from np a join no b on a.id = b.id and a.rank = b.rank where a.rank in (5, 15)),
e as (select list_sort(list_distinct(quantile_cont(r, [0.25e0, 0.5e0, 0.75e0]))) as edges from l semi join pool on l.id = pool.id where rank = 15)
select x.id, round(x.r, 6) as dens_k5, round(w.r, 6) as dens_k15, cast(len(list_filter(edges, lambda c: c <= w.r)) as int) as dens_bin from l x join l w on x.id = w.id and x.rank = 5 and w.rank = 15, e"""))
def _(t):
    base = t.base()
    out = N.knn_density_ratio(base, base.filter("split <> 'orig'"), t.base("orig"), ["price", "bal"], [5, 15], 4)
    return rounded(out.select("id", "dens_k5", "dens_k15", "dens_bin"), [])


SEVEN = """, s as (select o_orderkey as id, o_orderkey % 10 >= 8 as ref, l_quantity, o_totalprice / 10000.0e0 as p, r1, r5, r7, r11, r13 from orders
 join (select l_orderkey, sum(l_quantity) / 10.0e0 as l_quantity from lineitem group by l_orderkey) on l_orderkey = o_orderkey join ratings on ratings.id = o_orderkey),
d as (select q.id, r.id as ref_id, sqrt((q.l_quantity - r.l_quantity) * (q.l_quantity - r.l_quantity) + (q.p - r.p) * (q.p - r.p) + (q.r1 - r.r1) * (q.r1 - r.r1) + (q.r5 - r.r5) * (q.r5 - r.r5)
  + (q.r7 - r.r7) * (q.r7 - r.r7) + (q.r11 - r.r11) * (q.r11 - r.r11) + (q.r13 - r.r13) * (q.r13 - r.r13)) as distance from s q, s r where r.ref and not q.ref),
b as (select id, min(struct_pack(distance := distance, ref_id := ref_id), 5) as best from d group by id), u as (select id, unnest(best) as e, generate_subscripts(best, 1) as rank from b)"""


@case("neighbours_in_seven_columns", with_base(SEVEN + " select id, cast(rank as int) as rank, e.ref_id as ref_id, round(e.distance, 6) as distance from u"))
def _(t):
    """Seven columns through cells around pivots: orders by their goods, price and five ratings."""
    goods = t.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.sum("l_quantity") / F.lit(10.0)).alias("goods"))
    price = t.table("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / F.lit(10000.0)).alias("p"))
    rows = goods.join(price, "id").join(t.ratings(), "id")
    columns = ["goods", "p", "r1", "r5", "r7", "r11", "r13"]
    found = N.knn_join(rows.filter("id % 10 < 8"), rows.filter("id % 10 >= 8"), columns, 5, shipped=3000)
    return rounded(found.drop("label"), [])


@case("embedding_neighbours", """
with p as (select q.vec_id as id, r.vec_id as ref_id, r.label, sqrt(list_sum(list_transform(range(1, 65), lambda i: (cast(q.embedding[i] as double) - r.embedding[i]) * (cast(q.embedding[i] as double) - r.embedding[i])))) as distance
 from embeddings q, embeddings r),
n as (select *, row_number() over (partition by id order by distance, ref_id) as rank from p)
select id, cast(rank as int) as rank, ref_id, round(distance, 5) as distance, cast(label as double) as label from n where rank <= 4""")
def _(t):
    e = t.table("embeddings")
    wide = e.select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return rounded(N.knn_join(wide, wide, [f"e{i}" for i in range(64)], 4, label="label"), [], 5)
