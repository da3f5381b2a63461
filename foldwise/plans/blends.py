"""Blends, searches, thresholds and prediction post-processing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from foldwise.operators import blending as B
from foldwise.operators import optimisers as S
from foldwise.operators import metrics as M
from foldwise.plans.cases import case, model_score_sql, rounded, with_base
from foldwise.plans.ordered_and_metrics import LONG, MODELS, RANKED, auc_sql


def logit_sql(m):
    p = f"least(greatest({m}, 1e-6), 1.0e0 - 1e-6)"
    return f"least(greatest(ln({p} / (1.0e0 - {p})), -30.0e0), 30.0e0)"


@case("archive_pivot", with_base("select id, m0, m1, m2, m3 from scores"))
def _(t):
    return B.to_wide(t.archive(), MODELS)


@case("rank_mean_blend", with_base(RANKED + " select id, round((m0 + m1 + m2 + m3) / 4.0e0, 6) as blend from rk"))
def _(t):
    return rounded(B.blend(t.scores(), MODELS, "rank").select("id", "blend"), [])


@case("logit_mean_blend", with_base(f"select id, round(({' + '.join(logit_sql(m) for m in MODELS)}) / 4.0e0, 6) + 0.0e0 as blend from scores"))
def _(t):
    return rounded(B.blend(t.scores(), MODELS, "logit").select("id", "blend"), [])


@case("weighted_mean_blend", with_base("select id, round(0.1e0 * m0 + 0.2e0 * m1 + 0.3e0 * m2 + 0.4e0 * m3, 6) as blend from scores"))
def _(t):
    return rounded(B.blend(t.scores(), MODELS, "mean", [0.1, 0.2, 0.3, 0.4]).select("id", "blend"), [])


@case("power_mean_blend", with_base("""
select id, round(pow(""" + " + ".join(f"0.25e0 * pow(least(greatest({m}, 1e-15), 1.0e0 - 1e-15), 3.0e0)" for m in MODELS) + """, 1.0e0 / 3.0e0), 6) as blend from scores"""))
def _(t):
    return rounded(B.blend(t.scores(), MODELS, "power", p=3.0).select("id", "blend"), [])


@case("model_eligibility", with_base(LONG + auc_sql("l", ["model"]) + " select model, round(auc, 6) as auc from au where auc >= (select max(auc) from au) - 0.05"))
def _(t):
    return rounded(B.eligible(M.auc(t.scores(), "y", MODELS), 0.05).select("model", "auc"), [])


@case("duplicate_merge", with_base("select id, m0, m1, m2, m3 from scores"))
def _(t):
    near = t.scores().withColumns({"twin": F.col("m3") * 0.5 + 0.1, "near": F.col("m2") * F.col("m2")})
    kept = B.merge_duplicates(near, "y", [*MODELS, "twin", "near"], 0.9999)
    return near.select("id", *kept)


@case("hill_climb_weights")
def _(t):
    weights, _ = B.hill_climb(t.scores(), "y", MODELS, step=0.05)
    return rounded(B.blend(t.scores(), list(weights), "mean", list(weights.values())).select("id", "blend"), [])


@case("power_blend_search")
def _(t):
    """Continuous weights and exponent; the blend is their power mean."""
    found = S.fit_power_blend(t.scores(), "y", MODELS)
    score = S.power_score(MODELS, np.array([found.weights[m] for m in MODELS]), found.p)
    return rounded(t.scores().select("id", score.alias("blend"), F.lit(found.auc).alias("auc")), [])


@case("hill_climb_rmse_weights")
def _(t):
    weights, _ = B.hill_climb_rmse(t.scores(), "y", MODELS)
    return rounded(B.blend(t.scores(), list(weights), "mean", list(weights.values())).select("id", "blend"), [])


def mixed_sql(grid):
    z = f"select id, fold, y, {logit_sql('m2')} as a, {logit_sql('m3')} as b from scores"
    weights = ", ".join(f"{w!r}e0" for w in grid)
    return with_base(f"""
, z as ({z}), e as (select z.*, w, a * (1.0e0 - w) + b * w as pred from z, (select unnest([{weights}]) as w)),
rd as (select e.w, e.y, e.pred, r as fold from e, (select unnest([0, 1, 2, 3, 4]) as r) where r <> e.fold)""" + auc_sql("rd", ["fold", "w"]) + """,
best as (select fold, max(auc) as auc from au group by fold), pick as (select au.fold, min(w) as w from au join best on au.fold = best.fold and au.auc = best.auc group by au.fold)
select z.id, cast(p.w as double) as weight, round(a * (1.0e0 - p.w) + b * p.w, 6) + 0.0e0 as blend from z join pick p on z.fold = p.fold""")


@case("cross_fitted_blend", mixed_sql([0.0, 0.25, 0.5, 0.75, 1.0]))
def _(t):
    rows, table = B.cross_fitted_blend(t.scores(), "y", "m2", "m3", "fold", 5, [0.0, 0.25, 0.5, 0.75, 1.0])
    joined = rows.join(table.select("fold", "weight"), "fold")
    return rounded(joined.select("id", "weight", "blend"), ["weight"])


def products_sql(name, source, by, columns):
    """Cross products of the columns with each other and with the label, per group."""
    pairs = ", ".join(f"cast(sum({a} * {b}) as double) as g{i}{j}" for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j)
    return f", {name} as (select {by + ', ' if by else ''}{pairs}, {', '.join(f'cast(sum({c} * y) as double) as b{i}' for i, c in enumerate(columns))} from {source} {'group by ' + by if by else ''})"


def descent_sql(name, source, columns, nonnegative=True, steps=2000):
    """Solution ``x`` of the normal equations ``g x = b`` of every row, one unknown after the other, not below 0 if asked."""
    k = len(columns)
    rest = lambda i: "".join(f" - g{min(i, j)}{max(i, j)} * x{j}" for j in range(k) if j != i)
    best = lambda i: ("greatest(0.0e0, {})" if nonnegative else "{}").format(f"(b{i}{rest(i)}) / g{i}{i}")
    moved = ", ".join(f"case when step % {k} = {i} then {best(i)} else x{i} end as x{i}" for i in range(k))
    names = ", ".join(f"x{i}" for i in range(k))
    return f""", {name}_steps as (select *, 0 as step, {', '.join(f'0.0e0 as x{i}' for i in range(k))} from {source}
union all select * exclude (step, {names}), step + 1 as step, {moved} from {name}_steps where step < {steps}), {name} as (select * from {name}_steps where step = {steps})"""


def share_sql(weights, columns):
    """The columns mixed with the solution scaled to sum 1, equally if all are 0."""
    whole = " + ".join(f"{weights}.x{i}" for i in range(len(columns)))
    mixed = " + ".join(f"{c} * {weights}.x{i}" for i, c in enumerate(columns))
    return f"(case when {whole} > 0 then ({mixed}) / ({whole}) else ({' + '.join(columns)}) / {len(columns)}.0e0 end)"


def recursive(sql):
    return sql.replace("with base as", "with recursive base as", 1)


@case("nnls_combiner", recursive(with_base(products_sql("g", "scores", "", MODELS) + descent_sql("w", "g", MODELS) + f"""
select id, round({share_sql("w", MODELS)}, 6) as blend from scores, w""")))
def _(t):
    w = B.nnls_weights(t.scores(), "y", MODELS)
    return rounded(B.blend(t.scores(), list(w), "mean", list(w.values())).select("id", "blend"), [])


SUBSETS = [s for n in (1, 2, 3) for s in combinations(MODELS, n)]


@case("greedy_equal_weight_selection", with_base(", z as (select id, y, " + ", ".join(f"{logit_sql(m)} as z{m[1]}" for m in MODELS) + " from scores), sets as (" + " union all ".join(
    f"select id, y, {list(s)!r} as legs, ({' + '.join('z' + m[1] for m in s)}) / {len(s)}.0e0 as pred from z" for s in SUBSETS) + ")" + auc_sql("sets", ["legs"]) + """,
one as (select legs from au where len(legs) = 1 order by auc desc limit 1), two as (select au.legs from au, one where len(au.legs) = 2 and list_has_all(au.legs, one.legs) order by auc desc limit 1),
three as (select au.legs from au, two where len(au.legs) = 3 and list_has_all(au.legs, two.legs) order by auc desc limit 1)
select id, round(pred, 6) + 0.0e0 as blend from sets join three on sets.legs = three.legs"""))
def _(t):
    legs = B.greedy_select(t.scores(), "y", MODELS, 3)
    return rounded(B.blend(t.scores(), legs, "logit").select("id", "blend"), [])


@case("fold_sealed_combiners")
def _(t):
    kinds = ["equal_rank", "mean_logit", "nnls_logit", "stack_logit", "greedy_logit"]
    _, table = B.sealed_score(t.scores(), "id", "y", MODELS, "fold", 5, kinds)
    return rounded(table, [])


LEGS = ["z0", "z1", "z2", "z3"]


@case("sealed_pair_scores", recursive(with_base(RANKED + f"""
, z as (select s.id, s.fold, s.y, {', '.join(f"{logit_sql('s.' + m)} as z{m[1]}" for m in MODELS)}, (rk.m0 + rk.m1 + rk.m2 + rk.m3) / 4.0e0 as r from scores s join rk using (id)),
rd as (select z.*, q as reader from z, (select unnest([0, 1, 2, 3, 4]) as q) where q <> fold)""" +
    products_sql("gf", "rd", "reader", LEGS) + descent_sql("wf", "gf", LEGS) + products_sql("ga", "z", "", LEGS) + descent_sql("wa", "ga", LEGS) + f"""
, p as (select z.id, z.y, unnest(['equal_rank', 'mean_logit', 'nnls_logit', 'equal_rank', 'mean_logit', 'nnls_logit']) as combiner, unnest([1, 1, 1, 0, 0, 0]) as kind,
 unnest([r, (z0 + z1 + z2 + z3) / 4.0e0, {share_sql("wf", LEGS)}, r, (z0 + z1 + z2 + z3) / 4.0e0, {share_sql("wa", LEGS)}]) as pred from z join wf on z.fold = wf.reader, wa)""" + auc_sql("p", ["combiner", "kind"]) + """
select combiner, round(max(auc) filter (kind = 1), 6) as sealed, round(max(auc) filter (kind = 0), 6) as insample, round(max(auc) filter (kind = 1) - max(auc) filter (kind = 0), 6) * -1 + 0.0e0 as optimism from au group by combiner""")))
def _(t):
    _, table = B.sealed_score(t.scores(), "id", "y", MODELS, "fold", 5, ["equal_rank", "mean_logit", "nnls_logit"])
    return rounded(table, [])


@case("sealed_winner")
def _(t):
    kinds = ["equal_rank", "mean_logit", "nnls_logit"]
    _, table = B.sealed_score(t.scores(), "id", "y", MODELS, "fold", 5, kinds)
    return rounded(B.pick_winner(table, kinds, 0.002), [])


THREE = """, c as (select id, cast(least(floor(price / 100000), 2) as int) as cls, (0.2e0 + 0.6e0 * m2) as a, (0.5e0 - 0.3e0 * m3) as b from scores where price is not null),
p as (select id, cls, a / (a + b + 0.4e0) as p0, b / (a + b + 0.4e0) as p1, 0.4e0 / (a + b + 0.4e0) as p2 from c)"""


def three(t):
    df = t.scores().filter("price is not null")
    a, b = F.col("m2") * 0.6 + 0.2, F.lit(0.5) - F.col("m3") * 0.3
    df = df.select("id", F.least(F.floor(F.col("price") / 100000), F.lit(2)).cast("int").alias("cls"), a.alias("a"), b.alias("b"))
    total = F.col("a") + F.col("b") + 0.4
    return df.select("id", "cls", (F.col("a") / total).alias("p0"), (F.col("b") / total).alias("p1"), (0.4 / total).alias("p2"))


GRID = [[1.0, 1.0, 1.0], [0.7, 1.1, 1.3], [1.2, 0.9, 1.4], [0.5, 1.5, 0.8]]


def candidate_sql(guesses):
    parts = " union all ".join(f"select {i} as candidate, cls, {g} as guess from p" for i, g in enumerate(guesses))
    return with_base(THREE + f""", g as ({parts}), r as (select candidate, cls, avg(cast(guess = cls as int)) as r from g group by all)
select candidate, round(avg(r), 6) as balanced_accuracy from r group by candidate""")


@case("class_weight_tuning", candidate_sql([
    f"case when p0 * {a}e0 >= p1 * {b}e0 and p0 * {a}e0 >= p2 * {c}e0 then 0 when p1 * {b}e0 >= p2 * {c}e0 then 1 else 2 end" for a, b, c in GRID]))
def _(t):
    return rounded(B.tune_class_weights(three(t), "cls", ["p0", "p1", "p2"], GRID), [])


CUTS = [(0.3, 0.4), (0.45, 0.38), (0.5, 0.36), (0.35, 0.42)]


@case("threshold_tuning", candidate_sql([f"case when p2 >= {h}e0 then 2 when p0 >= {l}e0 then 0 else 1 end" for l, h in CUTS]))
def _(t):
    return rounded(B.tune_thresholds(three(t), "cls", "p0", "p2", CUTS), [])


TEMPS = [[1.0, 1.0, 1.0], [0.5, 1.0, 2.0], [2.0, 2.0, 2.0]]


@case("temperature_scaling", with_base(THREE + ", q as (" + " union all ".join(
    f"""select {i} as candidate, cls, exp(ln(p0) / {a}e0) as e0, exp(ln(p1) / {b}e0) as e1, exp(ln(p2) / {c}e0) as e2 from p""" for i, (a, b, c) in enumerate(TEMPS)) + """)
select candidate, round(avg(-ln((case cls when 0 then e0 when 1 then e1 else e2 end) / (e0 + e1 + e2))), 6) as log_loss from q group by candidate"""))
def _(t):
    return rounded(B.temperature_scale(three(t), "cls", ["p0", "p1", "p2"], TEMPS), [])


@case("oracle_selection", with_base("""
, e as (select *, abs(m0 - y) as e0, abs(m1 - y) as e1, abs(m2 - y) as e2, abs(m3 - y) as e3 from scores),
b as (select *, least(e0, e1, e2, e3) as e, case least(e0, e1, e2, e3) when e0 then 'm0' when e1 then 'm1' when e2 then 'm2' else 'm3' end as best_model from e)
select best_model, count(*) as n, round(avg(e), 6) as mae, round(avg(bal), 4) as mean_bal from b group by best_model"""))
def _(t):
    _, table = B.oracle_select(t.scores(), "y", MODELS, ["bal"])
    return rounded(table.withColumn("mean_bal", F.round("mean_bal", 4)), ["mean_bal"])


CELL_SUMS = ", ".join(f"sum({m}) as s{i}" for i, m in enumerate(MODELS))
CELL_CENTRED = ", ".join(f"h.g{i}{j} - s{i} * s{j} / n{' + 1' if i == j else ''} as g{i}{j}" for i in range(4) for j in range(i, 4))


@case("cell_blend", recursive(with_base(products_sql("h", "scores", "seg, pri", MODELS) + f"""
, u as (select seg, pri, count(*) as n, sum(y) as sy, {CELL_SUMS} from scores group by all having count(*) > 350),
c as (select u.*, {CELL_CENTRED}, {', '.join(f'b{i} - s{i} * sy / n as b{i}' for i in range(4))} from u join h using (seg, pri))""" + descent_sql("w", "c", MODELS, False) + f"""
select id, round(coalesce({' + '.join(f'{m} * x{i}' for i, m in enumerate(MODELS))} + (sy - {' - '.join(f's{i} * x{i}' for i in range(4))}) / n, ({' + '.join(MODELS)}) / 4.0e0), 6) as blend
from scores left join w using (seg, pri)""")))
def _(t):
    df = t.scores().withColumn("cell", F.concat_ws("|", "seg", "pri"))
    return rounded(B.cell_blend(df, "y", MODELS, "cell", 350).select("id", "blend"), [])


@case("prediction_clipping", """
with q as (select quantile_cont(l_extendedprice, 0.01) as lo, quantile_cont(l_extendedprice, 0.99) as hi from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(greatest(l_quantity * 3000, lo), hi), 4) as p from lineitem, q""")
def _(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df = t.table("lineitem", [*keys, "l_quantity", "l_extendedprice"]).withColumn("p", F.col("l_quantity") * 3000)
    return rounded(B.clip_predictions(df, "p", df, "l_extendedprice", (0.01, 0.99)).select(*keys, "p"), [], 4)


@case("range_clipping", "select p_partkey, least(greatest(p_size * 40.0e0, lo), hi) as p from part, (select min(p_retailprice) as lo, max(p_retailprice) as hi from part)")
def _(t):
    df = t.table("part", ["p_partkey", "p_size", "p_retailprice"]).withColumn("p", F.col("p_size") * 40.0)
    return B.clip_predictions(df, "p", df, "p_retailprice").select("p_partkey", "p")


@case("quantile_matching", with_base("""
, tr as (select id, floor(bal / 50) * 1.0e0 as p, price as v from train where price is not null), te as (select id, floor(bal / 50) * 1.0e0 + 0.5e0 * (id % 2) as p from base where split = 'test'),
s as (select te.id, (select count(*) from tr where tr.p <= te.p) as below, (select count(*) from tr) as n from te),
spot as (select id, (below / n) * (n - 1) as sp from s), ord as (select v, row_number() over (order by v) - 1 as pos from tr)
select spot.id, round(a.v + (b.v - a.v) * (sp - floor(sp)), 4) as matched from spot join ord a on a.pos = floor(sp) join ord b on b.pos = ceil(sp)"""))
def _(t):
    p = F.floor(F.col("bal") / 50) * 1.0
    train = t.base("train").filter("price is not null").select("id", p.alias("p"), F.col("price").alias("v"))
    test = t.base("test").select("id", (p + 0.5 * (F.col("id") % 2)).alias("p"))
    return rounded(B.quantile_match(test, "p", train, "p", "v").select("id", "matched"), [], 4)


@case("agreement_blend", with_base("""
, w as (select corr(m0, m3) as a, corr(m1, m3) as b, corr(m2, m3) as c from scores)
select id, round((m0 * a + m1 * b + m2 * c + m3) / (a + b + c + 1), 6) as blend from scores, w"""))
def _(t):
    return rounded(B.agreement_blend(t.scores(), MODELS, "m3").select("id", "blend"), [])


@case("rank_blend_on_label_scale", with_base("""
, s as (select id, price as v, m0, m1, m2, m3 from scores where price is not null), n as (select count(*) as n from s),
k as (select i, (select quantile_cont(v, i / 99.0e0) from s) as q from (select unnest(range(100)) as i)),
r as (select id, (RANKS) / 4.0e0 as r from s),
spot as (select id, (r - 1) / (n - 1) * 99.0e0 as sp from r, n), ix as (select id, sp, least(greatest(floor(sp), 0), 98) as i from spot)
select id, round(a.q + (b.q - a.q) * (sp - ix.i), 2) as blend from ix join k a on a.i = ix.i join k b on b.i = ix.i + 1""".replace("quantile_cont(v, i / 99.0e0)", "quantile_cont(v, [" + ", ".join(f"{i / 99!r}e0" for i in range(100)) + "])[i + 1]").replace(
    "RANKS", " + ".join(f"(rank() over (order by {m}) + (count(*) over (partition by {m}) - 1) / 2.0e0)" for m in MODELS))))
def _(t):
    df = t.scores().filter("price is not null").select("id", F.col("price").alias("v"), *MODELS)
    return rounded(B.rank_blend_scaled(df, MODELS, "v").select("id", "blend"), [], 2)


@case("combined_test_prediction", with_base(f"""
, made as (select *, {', '.join(f"{model_score_sql(m)} as m{m}" for m in range(4))} from test)
select id, round(({' + '.join(logit_sql(m) for m in MODELS)}) / 4.0e0, 6) + 0.0e0 as mean_logit,
  round(({' + '.join(f"(rank() over (order by {m}) + (count(*) over (partition by {m}) - 1) / 2.0e0) / count(*) over ()" for m in MODELS)}) / 4.0e0, 6) as equal_rank from made"""))
def _(t):
    return rounded(B.combined_test(t.scores(), t.scores("test"), "id", "y", MODELS, ["mean_logit", "equal_rank"]), [])


@case("sealed_test_prediction")
def _(t):
    return rounded(B.combined_test(t.scores(), t.scores("test"), "id", "y", MODELS, list(B.COMBINERS)), [])


DRAWN = B.drawn_weights(200, 3, 0.5, 3.0, 11)


def drawn_sql():
    guess = lambda a, b, c: f"case when p0 * {a!r}e0 >= p1 * {b!r}e0 and p0 * {a!r}e0 >= p2 * {c!r}e0 then 0 when p1 * {b!r}e0 >= p2 * {c!r}e0 then 1 else 2 end"
    parts = " union all ".join(f"select {i} as candidate, id, cls, {guess(*w)} as guess from p" for i, w in enumerate(DRAWN))
    return with_base(THREE + f""", g as ({parts}), r as (select candidate, cls, avg(cast(guess = cls as int)) as r from g group by all),
top as (select candidate from r group by candidate order by avg(r) desc, candidate limit 1)
select id, cast(guess as int) as guess from g join top using (candidate)""")


@case("drawn_class_weights", drawn_sql())
def _(t):
    return B.weighted_argmax(three(t), "cls", ["p0", "p1", "p2"], DRAWN)[1].select("id", "guess")


@case("temperature_fit", with_base(THREE + """, l as (select id, 2 - cls as cls, ln(p0) as z0, ln(p1) as z1, ln(p2) as z2 from p),
it as (select 0 as k, 1.0e0 as b union all select k + 1, b - g / h from (select k, b, sum(m - case cls when 0 then z0 when 1 then z1 else z2 end) as g, sum(q - m * m) as h
  from (select k, b, cls, z0, z1, z2, (e0 * z0 + e1 * z1 + e2 * z2) / (e0 + e1 + e2) as m, (e0 * z0 * z0 + e1 * z1 * z1 + e2 * z2 * z2) / (e0 + e1 + e2) as q
    from (select it.k, it.b, cls, z0, z1, z2, exp(b * z0) as e0, exp(b * z1) as e1, exp(b * z2) as e2 from it, l)) group by k, b) where k < 15),
t as (select b from it order by k desc limit 1)
select id, round(exp(b * z0) / (exp(b * z0) + exp(b * z1) + exp(b * z2)), 5) as q0, round(exp(b * z2) / (exp(b * z0) + exp(b * z1) + exp(b * z2)), 5) as q2 from l, t""").replace("with base as", "with recursive base as", 1))
def _(t):
    """One temperature for all classes, whose optimum SQL finds by Newton steps."""
    found = S.fit_temperatures(three(t).withColumn("cls", 2 - F.col("cls")), "cls", ["p0", "p1", "p2"], shared=True)
    scaled = B.temperature_probs(["p0", "p1", "p2"], list(found.values))
    return rounded(three(t).select("id", scaled[0].alias("q0"), scaled[2].alias("q2")), [], 5)


@case("class_temperatures")
def _(t):
    found = S.fit_temperatures(three(t).withColumn("cls", 2 - F.col("cls")), "cls", ["p0", "p1", "p2"])
    scaled = B.temperature_probs(["p0", "p1", "p2"], list(found.values))
    return rounded(three(t).select("id", *[e.alias(f"q{c}") for c, e in enumerate(scaled)]), [])


SWEEP_COUNTS = """, sc as (select m2 as s, cast(least(floor(price / 100000), 2) as int) as cls from scores where price is not null),
d as (select s, count(*) filter (cls = 0) as n0, count(*) filter (cls = 1) as n1, count(*) filter (cls = 2) as n2 from sc group by s),
b as (select s, coalesce(sum(n0) over w, 0) * 1.0e0 / (select sum(n0) from d) as f0, coalesce(sum(n1) over w, 0) * 1.0e0 / (select sum(n1) from d) as f1,
  coalesce(sum(n2) over w, 0) * 1.0e0 / (select sum(n2) from d) as f2 from d window w as (order by s rows between unbounded preceding and 1 preceding))"""


@case("threshold_sweep", with_base(""", d as (select m3 as s, count(*) filter (y = 0) as n0, count(*) filter (y = 1) as n1 from scores group by m3),
b as (select s, coalesce(sum(n0) over w, 0) * 1.0e0 / (select sum(n0) from d) as f0, coalesce(sum(n1) over w, 0) * 1.0e0 / (select sum(n1) from d) as f1 from d window w as (order by s rows between unbounded preceding and 1 preceding))
select s as threshold, round((f0 + 1.0e0 - f1) / 2, 12) as balanced_accuracy from b order by 2 desc, 1 limit 1"""))
def _(t):
    return S.sweep_threshold(t.scores(), "y", "m3")


@case("two_threshold_sweep", with_base(SWEEP_COUNTS + """
select l.s as low, h.s as high, round((round(l.f0 - l.f1, 12) + h.f1 + 1.0e0 - h.f2) / 3, 12) as balanced_accuracy from b l join b h on l.s <= h.s order by 3 desc, 2, 1 limit 1"""))
def _(t):
    df = t.scores().filter("price is not null").withColumn("cls", F.least(F.floor(F.col("price") / 100000), F.lit(2)).cast("int"))
    return S.sweep_two_thresholds(df, "cls", "m2")
