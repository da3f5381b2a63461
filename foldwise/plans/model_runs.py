"""Model-driven operators. Fits with a closed form have SQL; tests bound the quality of the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.hashing import hash_sql
from foldwise.operators import groups as G
from foldwise.operators import metrics as Q
from foldwise.operators import models as M
from foldwise.plans.cases import RATING_STEPS, case, model_score_sql, rounded, with_base

FEATURES = ["price0", "price_missing", "bal", "urgent", "high", "building"]


def frame(df):
    """Numeric model columns of the base view, without NULLs."""
    return df.withColumns({
        "price0": F.coalesce(F.col("price"), F.lit(0.0)) / 100000.0,
        "price_missing": F.col("price").isNull().cast("int"),
        "bal": F.col("bal") / 1000.0,
        "urgent": (F.col("pri") == "1-URGENT").cast("int"),
        "high": (F.col("pri") == "2-HIGH").cast("int"),
        "building": (F.col("seg") == "BUILDING").cast("int"),
    })


@case("oof_prediction")
def _(t):
    oof, tested, _ = M.oof_predict(frame(t.folded()), "id", "y", FEATURES, "fold", 5, M.logistic(), frame(t.base("test")))
    return rounded(oof.select("id", "fold", "pred").unionByName(tested.select("id", F.lit(-1).alias("fold"), "pred")), [])


@case("teacher_column")
def _(t):
    clean = G.remove_overlap(t.base("orig"), t.base().filter("split <> 'orig'"), ["pri", "seg", "nat", "price", "bal"], "id")
    out = M.teacher_column(frame(clean), frame(t.base("test")), FEATURES, "y", M.boosted_trees(5, 3))
    return rounded(out.select("id", "teacher"), [])


def rated(t, split):
    cols = [f"r{k}" for k in RATING_STEPS]
    ids = t.base(split).select("id", "y")
    return t.ratings().select("id", *cols).join(ids, "id"), cols


@case("auxiliary_expected_value")
def _(t):
    df, cols = rated(t, "test")
    return rounded(M.aux_expected_value(rated(t, "orig")[0], df, cols, 6).drop(*cols, "y"), [])


@case("auxiliary_posteriors")
def _(t):
    df, cols = rated(t, "test")
    return rounded(M.aux_posteriors(rated(t, "orig")[0], df, cols, 6).drop(*cols, "y"), [])


@case("two_stage_model")
def _(t):
    oof, tested = M.two_stage(frame(t.folded(3)), "id", "y", FEATURES, "fold", 3, M.ridge(0.01), M.logistic(), frame(t.base("test")))
    scored = oof.select("id", F.lit("train").alias("split"), "stage1", "pred")
    return rounded(scored.unionByName(tested.select("id", F.lit("test").alias("split"), F.lit(None).cast("double").alias("stage1"), "pred")), [])


@case("backbone_margin")
def _(t):
    out = M.backbone_margin(frame(t.folded(3)), "id", "y", FEATURES, "fold", 3, 3, 31, M.logistic(), frame(t.base("test")))
    return rounded(out, [])


@case("train_test_drift")
def _(t):
    scores = M.drift_scores(frame(t.base("train")), frame(t.base("test")), "id", FEATURES, 3, 41, M.logistic())
    return rounded(M.drift_verdict(scores), [])


@case("adversarial_weights")
def _(t):
    train = frame(t.base("train"))
    scores = M.drift_scores(train, frame(t.base("test")), "id", FEATURES, 3, 41, M.logistic())
    return rounded(M.adversarial_weights(train, scores, "id", 2.0, 2.0).select("id", "weight"), [])


@case("noise_scores")
def _(t):
    out = M.noise_scores(frame(t.folded()), "id", "y", FEATURES, "fold", 5, M.logistic())
    return rounded(out.select("id", "noise"), [])


@case("full_data_refit")
def _(t):
    out = M.full_refit(frame(t.folded(3)), frame(t.base("orig")), frame(t.base("test")), "id", "y", FEATURES, "fold", 3, M.logistic(), 0.5)
    return rounded(out.select("id", "fold_mean", "refit", "pred"), [])


@case("factorial_ablation")
def _(t):
    arms = {"all": FEATURES, "no_price": FEATURES[2:], "no_flags": FEATURES[:3]}
    return rounded(M.ablate(frame(t.folded(3)), "id", "y", arms, "fold", 3, M.logistic()), [])


@case("isotonic_calibration", with_base("""
, rd as (select unnest([0, 1, 2, 3, 4]) as reader),
pts as (select reader, m3 as x, sum(y) as s, count(*) as w from scores join rd on fold <> reader group by all),
c as (select reader, x, row_number() over o as i, sum(s) over o as cs, sum(w) over o as cw, sum(s) over o - s as bs, sum(w) over o - w as bw from pts window o as (partition by reader order by x)),
pairs as (select a.reader, a.i as j, b.i as k, (b.cs - a.bs) / cast(b.cw - a.bw as double) as v from c a join c b on a.reader = b.reader and a.i <= b.i),
low as (select reader, j, k, min(v) over (partition by reader, j order by k rows between current row and unbounded following) as g from pairs),
iso as (select reader, k as i, max(g) as v from low group by all), curve as (select c.reader, c.x, iso.v from c join iso on c.reader = iso.reader and c.i = iso.i),
ends as (select reader, min(x) as x0, max(x) as x1 from curve group by reader),
q as (select id, fold as reader, least(greatest(m3, x0), x1) as x from scores join ends on fold = reader),
l as (select q.id, q.reader, q.x, lo.x as lx, lo.v as lv from q asof join curve lo on q.reader = lo.reader and q.x >= lo.x),
h as (select l.*, hi.x as hx, hi.v as hv from l asof join curve hi on l.reader = hi.reader and l.x <= hi.x)
select id, round(case when hx = lx then lv else lv + (hv - lv) * (x - lx) / (hx - lx) end, 6) as calibrated from h"""))
def _(t):
    return rounded(M.isotonic(t.scores(), "m3", "y", "fold", 5).select("id", "calibrated"), [])


@case("boosted_pseudo_labels")
def _(t):
    first, tested, _ = M.oof_predict(frame(t.folded(3)), "id", "y", FEATURES, "fold", 3, M.ridge(1.0), frame(t.base("test")))
    train = frame(t.folded(3)).join(first.select("id", F.col("pred").alias("oof")), "id")
    test = frame(t.base("test")).join(tested, "id")
    out, _ = M.boosted_pseudo(train, test, "id", "y", FEATURES, "fold", 3, M.ridge(0.01), "oof", "pred", 0.5, 2, 0.0, 1.0)
    return rounded(out.select("id", "pseudo"), [])


def both(oof, tested, name="pred"):
    """Out-of-fold and test predictions in one table, told apart by ``split``."""
    parts = [d.select("id", F.lit(s).alias("split"), name) for d, s in ((oof, "train"), (tested, "test"))]
    return rounded(parts[0].unionByName(parts[1]), [])


@case("stacking")
def _(t):
    return both(*M.stack(t.scores(), "id", "y", ["m0", "m1", "m2", "m3"], "fold", 5, test=t.scores("test")))


@case("ridge_stacking")
def _(t):
    return both(*M.stack(t.scores(), "id", "y", ["m0", "m1", "m2", "m3"], "fold", 5, "ridge", t.scores("test")))


@case("feature_screening")
def _(t):
    return rounded(M.screen_features(frame(t.base("train")), "y", FEATURES, "id", 3, M.boosted_trees(5, 3)), [])


@case("forward_selection")
def _(t):
    train = frame(t.folded())
    found = M.forward_select(train, "id", "y", ["bal"], {"flags": ["urgent", "building"], "price": ["price0"]}, 3, M.logistic, confirm_folds=5)
    oof, _, _ = M.oof_predict(train, "id", "y", ["bal", *found["selected"]], "fold", 5, M.logistic())
    return rounded(oof.select("id", "pred"), [])


@case("kmeans_features")
def _(t):
    df = t.base()
    return rounded(M.kmeans_features(df, t.base("orig"), ["price", "bal"], 5, "y").select("id", "cluster", "cluster_distance", "cluster_rate"), [])


@case("model_fold_scores")
def _(t):
    oof, _, _ = M.oof_predict(frame(t.folded()), "id", "y", FEATURES, "fold", 5, M.logistic())
    return rounded(Q.auc(oof, "y", ["pred"], ["fold"]), [])


@case("isotonic_test_prediction")
def _(t):
    return both(*M.isotonic(t.scores(), "m3", "y", "fold", 5, test=t.scores("test")), "calibrated")


@case("sigmoid_calibration")
def _(t):
    return both(*M.sigmoid_calibration(t.scores(), "id", "m3", "y", "fold", 5, t.scores("test")), "calibrated")


@case("multi_seed_oof")
def _(t):
    train = frame(t.base("train"))
    return both(*M.multi_seed_oof(train, "id", "y", FEATURES, 3, [1, 2, 3], M.logistic(), frame(t.base("test"))))


# Models with a closed form: a logistic model without a penalty on the indicators of one column gives its class shares, and one or two
# columns of least squares have their normal equations.

LEVELS = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
DUMMIES = ["pri2", "pri3", "pri4", "pri5"]


NUDGE = 1e-8


def nudged(df, digits=6):
    """Rounded like ``rounded``, a little above: shares such as 13/64 lie on a rounding edge, where a fit may fall to either side."""
    double = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return rounded(df.withColumns({c: F.col(c) + F.lit(NUDGE) for c in double}), [], digits)


def levelled(df):
    return df.withColumns({d: (F.col("pri") == v).cast("int") for d, v in zip(DUMMIES, LEVELS)})


def shares_sql(tag, source, fold, folds, y="y"):
    """``{tag}(fold, pri, p)``: share of ``y`` per level among the rows of ``source`` outside the fold."""
    return f"""{tag}_c as (select {fold} as fold, pri, count(*) as n, sum({y}) as s from {source} group by all), {tag}_t as (select pri, sum(n) as n, sum(s) as s from {tag}_c group by pri),
{tag} as (select f.fold, t.pri, (t.s - coalesce(c.s, 0)) / cast(t.n - coalesce(c.n, 0) as double) as p from (select unnest(range({folds})) as fold) f cross join {tag}_t t left join {tag}_c c on c.fold = f.fold and c.pri = t.pri)"""


@case("oof_by_level", with_base(f""", {shares_sql('sh', 'folded', 'fold', 5)}
select id, folded.fold, round(p + 1e-8, 6) as pred from folded join sh on folded.fold = sh.fold and folded.pri = sh.pri
union all select id, -1, round(avg(p) + 1e-8, 6) from test join sh on test.pri = sh.pri group by id"""))
def _(t):
    oof, tested, _ = M.oof_predict(levelled(t.folded()), "id", "y", DUMMIES, "fold", 5, M.logistic(0.0), levelled(t.base("test")))
    return nudged(oof.select("id", "fold", "pred").unionByName(tested.select("id", F.lit(-1).alias("fold"), "pred")))


@case("teacher_by_level", with_base("select id, round(p + 1e-8, 6) as teacher from test join (select pri, avg(y) as p from orig group by pri) using (pri)"))
def _(t):
    out = M.teacher_column(levelled(t.base("orig")), levelled(t.base("test")), DUMMIES, "y", M.logistic(0.0))
    return nudged(out.select("id", "teacher"))


def rated_levels(t, split):
    return levelled(t.ratings().select("id", "r1").join(t.base(split).select("id", "pri"), "id"))


RATING_SHARES = """, rt as (select base.id, split, pri, r1 from base join ratings on base.id = ratings.id),
sh as (select pri, k, avg(cast(r1 = k as int)) as p from rt, (select unnest(range(6)) as k) where split = 'orig' group by all)"""


@case("auxiliary_posteriors_by_level", with_base(RATING_SHARES + f"""
select id, {', '.join(f'round(sum(p) filter (k = {k}) + 1e-8, 6) + 0.0e0 as r1_p{k}' for k in range(6))} from rt join sh on rt.pri = sh.pri where split = 'test' group by id"""))
def _(t):
    out = M.aux_posteriors(rated_levels(t, "orig"), rated_levels(t, "test"), ["r1"], 6, DUMMIES, reg=0.0)
    return nudged(out.select("id", *[f"r1_p{k}" for k in range(6)]))


@case("auxiliary_value_by_level", with_base(RATING_SHARES + """
select id, round(sum(k * p) + 1e-8, 6) as r1_ev from rt join sh on rt.pri = sh.pri where split = 'test' group by id"""))
def _(t):
    out = M.aux_expected_value(rated_levels(t, "orig"), rated_levels(t, "test"), ["r1"], 6, DUMMIES, reg=0.0)
    return nudged(out.select("id", "r1_ev"))


def line_sql(tag, source, x, y, folds, reg):
    """``{tag}(fold, b, a)``: ridge line of ``y`` on ``x`` over the rows outside the fold."""
    slope = f"covar_pop({x}, {y}) / (var_pop({x}) * (1 + {reg}))"
    return f"{tag} as (select f.fold, {slope} as b, avg({y}) - {slope} * avg({x}) as a from {source} s join (select unnest(range({folds})) as fold) f on s.fold <> f.fold group by f.fold)"


def plane_sql(tag, source, u, v, y, folds, reg):
    """``{tag}(fold, b, c, a)``: the same for two columns."""
    return f"""{tag}_m as (select f.fold, var_pop({u}) * (1 + {reg}) as p, covar_pop({u}, {v}) as q, var_pop({v}) * (1 + {reg}) as r, covar_pop({u}, {y}) as g, covar_pop({v}, {y}) as h, avg({u}) as mu, avg({v}) as mv, avg({y}) as my
 from {source} s join (select unnest(range({folds})) as fold) f on s.fold <> f.fold group by f.fold),
{tag} as (select fold, (r * g - q * h) / (p * r - q * q) as b, (p * h - q * g) / (p * r - q * q) as c, my - mu * (r * g - q * h) / (p * r - q * q) - mv * (p * h - q * g) / (p * r - q * q) as a from {tag}_m)"""


FOLD3 = ", f3 as (select id, pri, y, bal / 1000.0e0 as bal, fold % 3 as fold from folded), t3 as (select id, pri, bal / 1000.0e0 as bal from test)"


def three_folds(t):
    return t.folded().withColumns({"bal": F.col("bal") / 1000.0, "fold": F.col("fold") % 3})


@case("two_stage_ridge", with_base(FOLD3 + f""", {line_sql('one', 'f3', 'bal', 'y', 3, '0.0e0')}, s1 as (select f3.*, one.a + one.b * bal as stage1 from f3 join one using (fold)),
t1 as (select t3.id, any_value(bal) as bal, avg(a + b * bal) as stage1 from t3, one group by t3.id), {plane_sql('two', 's1', 'bal', 'stage1', 'y', 3, '0.5e0')}
select id, 'train' as split, round(stage1, 6) as stage1, round(a + b * bal + c * stage1, 6) as pred from s1 join two using (fold)
union all select id, 'test', round(any_value(stage1), 6), round(avg(a + b * bal + c * stage1), 6) from t1, two group by id"""))
def _(t):
    test = t.base("test").withColumn("bal", F.col("bal") / 1000.0)
    _, one_test, _ = M.oof_predict(three_folds(t), "id", "y", ["bal"], "fold", 3, M.ridge(0.0), test, name="stage1")
    oof, tested = M.two_stage(three_folds(t), "id", "y", ["bal"], "fold", 3, M.ridge(0.0), M.ridge(0.5), test)
    parts = [oof.select("id", F.lit("train").alias("split"), "stage1", "pred"), tested.join(one_test, "id").select("id", F.lit("test").alias("split"), "stage1", "pred")]
    return rounded(parts[0].unionByName(parts[1]), [])


@case("backbone_by_level", with_base(f""", i as (select id, pri, y, fold % 3 as fold, cast({hash_sql('id', 31)} % 3 as int) as inn from folded),
c as (select fold, inn, pri, count(*) as n, sum(y) as s from i group by all), fg as (select f, g from (select unnest(range(3)) as f), (select unnest(range(3)) as g)),
sh as (select f, g, pri, sum(s) / cast(sum(n) as double) as p from c, fg where fold <> f and inn <> g group by all), lg as (select f, g, pri, ln(p / (1 - p)) as z from sh),
m as (select f, pri, avg(z) as z from lg group by all)
select id, cast(f as int) as outer, 'fit' as role, round(z, 6) as margin from i join lg on i.pri = lg.pri and lg.g = i.inn and lg.f <> i.fold
union all select id, cast(f as int), 'hold', round(z, 6) from i join m on i.pri = m.pri and m.f = i.fold
union all select id, cast(f as int), 'test', round(z, 6) from test join m on test.pri = m.pri""".replace(" as outer,", ' as "outer",')))
def _(t):
    train = levelled(t.folded().withColumn("fold", F.col("fold") % 3))
    return rounded(M.backbone_margin(train, "id", "y", DUMMIES, "fold", 3, 3, 31, M.logistic(0.0), levelled(t.base("test"))), [])


DRIFT = f""", b as (select id, pri, cast(split = 'test' as int) as is_test, cast({hash_sql('id', 41)} % 3 as int) as fold from base where split <> 'orig'), {shares_sql('sh', 'b', 'fold', 3, 'is_test')},
sc as (select b.id, is_test, round(p, 9) as pred from b join sh on b.fold = sh.fold and b.pri = sh.pri)"""


def drift_by_level(t):
    scores = M.drift_scores(levelled(t.base("train")), levelled(t.base("test")), "id", DUMMIES, 3, 41, M.logistic(0.0))
    return scores.withColumn("pred", F.round("pred", 9))


@case("drift_by_level", with_base(DRIFT + """, c as (select pred, sum(is_test) as pos, sum(1 - is_test) as neg from sc group by pred),
o as (select *, coalesce(sum(neg) over (order by pred rows between unbounded preceding and 1 preceding), 0) as below from c), a as (select sum(pos * (below + neg / 2.0e0)) / (cast(sum(pos) as double) * sum(neg)) as auc from o)
select round(auc, 6) as auc, case when auc > 0.6 then 'significant' when auc > 0.55 then 'mild' else 'low' end as drift from a"""))
def _(t):
    return rounded(M.drift_verdict(drift_by_level(t)), [])


@case("adversarial_weights_by_level", with_base(DRIFT + """, v as (select id, pred * pred as v from sc where is_test = 0)
select id, round(0.5e0 + (v - (select min(v) from v)) / ((select max(v) - min(v) from v) + 1e-8) * 1.5e0, 6) as weight from v"""))
def _(t):
    return rounded(M.adversarial_weights(t.base("train"), drift_by_level(t), "id", 2.0, 2.0).select("id", "weight"), [])


@case("noise_by_level", with_base(f""", {shares_sql('sh', 'folded', 'fold', 5)}
select id, round(abs(y - p) + 1e-8, 6) as noise from folded join sh on folded.fold = sh.fold and folded.pri = sh.pri"""))
def _(t):
    out = M.noise_scores(levelled(t.folded()), "id", "y", DUMMIES, "fold", 5, M.logistic(0.0))
    return nudged(out.select("id", "noise"))


@case("refit_by_level", with_base(f""", {shares_sql('sh', 'folded', 'fold', 5)}, w as (select pri, avg(y) as p from base where split <> 'test' group by pri),
m as (select pri, avg(p) as p from sh group by pri)
select id, round(m.p + 1e-8, 6) as fold_mean, round(w.p + 1e-8, 6) as refit, round(0.25e0 * m.p + 0.75e0 * w.p + 1e-8, 6) as pred from test join m using (pri) join w using (pri)"""))
def _(t):
    parts = [levelled(x) for x in (t.folded(), t.base("orig"), t.base("test"))]
    out = M.full_refit(*parts, "id", "y", DUMMIES, "fold", 5, M.logistic(0.0), 0.75)
    return nudged(out.select("id", "fold_mean", "refit", "pred"))


@case("ridge_stacking_pair", with_base(f""", ts as (select id, {model_score_sql(1)} as m1, {model_score_sql(3)} as m3 from test), {plane_sql('two', 'scores', 'm1', 'm3', 'y', 5, '0.001e0')}
select id, 'train' as split, round(a + b * m1 + c * m3, 6) as pred from scores join two using (fold)
union all select id, 'test', round(avg(a + b * m1 + c * m3), 6) from ts, two group by id"""))
def _(t):
    return both(*M.stack(t.scores(), "id", "y", ["m1", "m3"], "fold", 5, "ridge", t.scores("test")))


@case("boosted_pseudo_line", with_base(FOLD3 + f""", r0 as (select *, y - 0.3e0 as r from f3), {line_sql('l0', 'r0', 'bal', 'r', 3, '0.01e0')},
r1 as (select r0.* exclude (r), r - 0.5e0 * (a + b * bal) as r from r0 join l0 using (fold)), {line_sql('l1', 'r1', 'bal', 'r', 3, '0.01e0')},
r2 as (select r1.* exclude (r), r - 0.5e0 * (a + b * bal) as r from r1 join l1 using (fold)), {line_sql('l2', 'r2', 'bal', 'r', 3, '0.01e0')},
d as (select id, (select avg(a + b * t3.bal) from l0) as d0, (select avg(a + b * t3.bal) from l1) as d1, (select avg(a + b * t3.bal) from l2) as d2 from t3),
p as (select id, d1, d2, least(greatest(0.3e0 + 0.5e0 * d0, 0.33e0), 1.0e0) as p from d), q as (select id, d2, least(greatest(p + 0.5e0 * d1, 0.33e0), 1.0e0) as p from p)
select id, round(least(greatest(p + 0.5e0 * d2, 0.33e0), 1.0e0), 6) as pseudo from q"""))
def _(t):
    train = three_folds(t).withColumn("oof", F.lit(0.3))
    test = t.base("test").select("id", (F.col("bal") / 1000.0).alias("bal"), F.lit(0.3).alias("pred"))
    out, _ = M.boosted_pseudo(train, test, "id", "y", ["bal"], "fold", 3, M.ridge(0.01), "oof", "pred", 0.5, 3, 0.33, 1.0)
    return rounded(out.select("id", "pseudo"), [])
