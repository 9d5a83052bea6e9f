"""Queries of probes. Vectors of one number let SQL fit the same models, by Newton steps in a recursive query; the same operators
run on vectors of 32 in the queries whose names end in _wide, which have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions import expressions as X
from veritrail.operators import metrics, probes
from veritrail.plans import base
from veritrail.plans.base import query, rounded, table


def determinant(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    minors = [f"{'-' if j % 2 else '+'} {m[0][j]} * ({determinant([row[:j] + row[j + 1 :] for row in m[1:]])})" for j in range(len(m))]
    return "(" + " ".join(minors) + ")"


def newton(name: str, data: str, keys: str, features: list[str], steps: int = 14) -> str:
    """CTE `name`: keys with b0.. (one a feature) and c, the balanced logistic fit of data (keys, y, features), as probes.fit_logistic's
    minimum; groups of one class have zeros."""
    k, n = len(features), len(features) + 1
    b = [*[f"b{i}" for i in range(k)], "c"]
    x = [*features, "1.0"]
    h = [[f"h{min(i, j)}_{max(i, j)}" for j in range(n)] for i in range(n)]
    z = " + ".join(f"{b[i]} * {x[i]}" for i in range(n))
    sums = ", ".join([f"sum(w * (1 / (1 + exp(-({z}))) - y) * {x[i]}) + {'any_value(' + b[i] + ')' if i < k else '0'} as g{i}" for i in range(n)] + [f"sum(w / (1 + exp(-({z}))) / (1 + exp({z})) * {x[i]} * {x[j]}) + {1.0 if i == j and i < k else 0.0} as {h[i][j]}" for i in range(n) for j in range(i, n)])
    det = determinant(h)
    # Cramer's rule: column i of the matrix replaced by the gradient
    moves = ", ".join(f"{b[i]} - ({determinant([[f'g{r}' if col == i else h[r][col] for col in range(n)] for r in range(n)])}) / {det} as {b[i]}" for i in range(n))
    weighted = f"{name}_d as (select *, count(*) over (partition by {keys}) / (2.0 * count(*) over (partition by {keys}, y)) as w from {data}), {name}_k as (select {keys}, count(*) as n_train, min(y) < max(y) as mixed from {data} group by {keys})"
    start = f"select {keys}, 0 as it, {', '.join(f'0.0::double as {v}' for v in b)} from {name}_k where mixed"
    step = f"select {keys}, it + 1, {moves} from (select {keys}, it, {', '.join(f'any_value({v}) as {v}' for v in b)}, {sums} from {name}_r join {name}_d using ({keys}) where it < {steps} group by {keys}, it)"
    last = f"{name} as (select {name}_k.*, {', '.join(f'coalesce({v}, 0.0) as {v}' for v in b)} from {name}_k left join (select * from {name}_r where it = {steps}) using ({keys}))"
    return f"{weighted}, {name}_r as ({start} union all {step}), {last}"


def auroc_sql(name: str, rows: str, keys: str) -> str:
    """CTE `name`: keys, n, n_pos, auroc, ap of rows (keys, y, p)."""
    part, group, by = (f"partition by {keys}, " if keys else "partition by ", f"{keys}, " if keys else "", f"group by {keys}" if keys else "")
    over = f"partition by {keys} " if keys else ""
    return f"""{name}_r as (select *, rank() over ({over}order by p) + (count(*) over ({part}p) - 1) / 2.0 as r, sum(y) over ({over}order by p desc) as tp, count(*) over ({over}order by p desc) as seen from {rows}),
{name} as (select {group}count(*) as n, sum(y)::bigint as n_pos, case when sum(y) between 1 and count(*) - 1 then (sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) end as auroc, case when sum(y) > 0 then sum(y * tp::double / seen) / sum(y) end as ap from {name}_r {by})"""


P = "1 / (1 + exp(-(b0 * x + c)))"
ROWS = "v as (select vec_id as id, (vec_id % 6)::int as fold, (label < 3)::int as y, layer::int as layer, embedding[1 + 32 * layer]::double as x from embeddings, range(0, 2) l(layer))"


def narrow(spark, d):
    """Embeddings as two layers of one number each; documents are six folds."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 6).cast("int").alias("fold"), (F.col("label") < 3).cast("int").alias("y"), "embedding")
    layers = F.array(*[F.struct(F.lit(i).alias("layer"), F.slice("embedding", 1 + 32 * i, 1).alias("vec")) for i in range(2)])
    return e.select("id", "fold", "y", F.explode(layers).alias("x")).select("id", "fold", "y", "x.layer", "x.vec")


def wide(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 6).cast("int").alias("fold"), (F.col("label") == 1).cast("int").alias("y"), "embedding")
    layers = F.array(*[F.struct(F.lit(i).alias("layer"), F.slice("embedding", 1 + 32 * i, 32).alias("vec")) for i in range(2)])
    return e.select("id", "fold", "y", F.explode(layers).alias("x")).select("id", "fold", "y", "x.layer", "x.vec")


RANKED = ("auroc_mean", "auroc_std", "auroc", "ap")


@query(f"with recursive {ROWS}, {newton('fit', 'v', 'layer', ['x'])} select layer, round(b0, 6) as beta, round(c, 6) as bias, n_train from fit")
def stat_fit(spark, d):
    out = probes.fit_layers(narrow(spark, d))
    return rounded(out.select("layer", F.col("beta")[0].alias("beta"), "bias", "n_train"), "beta", "bias", digits=6)


HELD = f"tr as (select f.fold as hold, v.* from v join (select distinct fold from v) f on f.fold <> v.fold), {newton('fit', 'tr', 'hold, layer', ['x'])}, pv as (select v.*, {P} as p from v join fit on fit.hold = v.fold and fit.layer = v.layer)"
FOLDS = f"{auroc_sql('each', 'pv', 'layer, fold')}, {auroc_sql('pooled', 'pv', 'layer')}, fm as (select layer, count(auroc) as n_folds, avg(auroc) as auroc_mean, stddev_pop(auroc) as auroc_std from each group by layer)"
FOLDED = "select layer, n_folds, round(auroc_mean, 6) as auroc_mean, round(auroc_std, 6) as auroc_std, n, n_pos, round(auroc, 6) as auroc, round(ap, 6) as ap from fm join pooled using (layer)"


@query(f"with recursive {ROWS}, {HELD}, {FOLDS} {FOLDED}")
def stat_lodo(spark, d):
    return rounded(probes.held_out_ranking(narrow(spark, d)), *RANKED, digits=6)


@query()
def stat_lodo_wide(spark, d):
    return rounded(probes.held_out_ranking(wide(spark, d)), *RANKED, digits=6)


NESTED = f"""fo as (select distinct fold from v), ti as (select o.fold as outr, i.fold as innr, v.* from v, fo o, fo i where o.fold <> i.fold and v.fold <> o.fold and v.fold <> i.fold), {newton('inf', 'ti', 'outr, innr, layer', ['x'])},
pi as (select i.outr, v.layer, v.fold, v.y, {P} as p from v join inf i on i.innr = v.fold and i.layer = v.layer where i.mixed), {auroc_sql('ia', 'pi', 'outr, layer, fold')},
im as (select outr, layer, avg(auroc) as a from ia group by outr, layer having count(auroc) > 0), ch as (select outr as fold, layer from (select *, row_number() over (partition by outr order by a desc, layer) as r from im) where r = 1),
mx as (select fold from v group by fold having min(y) < max(y)), {HELD}, po as (select pv.* from pv join ch using (fold, layer) join mx using (fold)), {auroc_sql('oe', 'po', 'fold, layer')}, {auroc_sql('op', 'po', '')}, ol as (select layer, count(*) as n_folds from oe group by layer)"""


@query(f"with recursive {ROWS}, {NESTED} select (select count(auroc) from oe)::int as n_folds, round((select avg(auroc) from oe), 6) as auroc_mean, round((select stddev_pop(auroc) from oe), 6) as auroc_std, (select string_agg(layer || ':' || n_folds, ' ' order by layer) from ol) as layers, n, n_pos, round(auroc, 6) as auroc, round(ap, 6) as ap from op")
def stat_nested(spark, d):
    out = probes.nested_ranking(narrow(spark, d))
    layers = F.array_join(F.transform("layers", lambda x: F.concat_ws(":", x["layer"].cast("string"), x["n_folds"].cast("string"))), " ")
    return rounded(out.withColumn("layers", layers), *RANKED, digits=6)


@query()
def stat_nested_wide(spark, d):
    return rounded(probes.nested_ranking(wide(spark, d)), *RANKED, digits=6)


def _transfer(way: str, train: str, unit: bool) -> str:
    x = "sign(x)" if unit else "x"
    return f"{way}_v as (select * replace ({x} as x) from v), {way}_t as (select * from {way}_v where {train}), {newton(way, f'{way}_t', 'layer', ['x'])}, {way}_p as (select v.layer, v.y, {P} as p from {way}_v v join {way} using (layer) where not ({train})), {auroc_sql(way + '_a', way + '_p', 'layer')}"


WAYS = {"ab": ("fold < 3", False), "ba": ("fold >= 3", False), "ab_unit": ("fold < 3", True), "ba_unit": ("fold >= 3", True)}


@query(f"with recursive {ROWS}, {', '.join(_transfer(w, *a) for w, a in WAYS.items())} " + " union all ".join(f"select '{w}' as way, layer, n, n_pos, round(auroc, 6) as auroc, round(ap, 6) as ap from {w}_a" for w in WAYS))
def stat_transfer(spark, d):
    """Both directions, vectors as they are and at length one."""
    v, out = narrow(spark, d), None
    for way, (train, unit) in WAYS.items():
        one = metrics.ranking(probes.transfer_scores(v.where(train), v.where(f"not ({train})"), normalise=unit), ["layer"], "p").withColumn("way", F.lit(way))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "auroc", "ap", digits=6)


TOKENS = "tk as (select vec_id as id, (vec_id % 6)::int as fold, (label < 3)::int as y, 0 as layer, t, embedding[1 + 8 * t]::double as x from embeddings, range(0, 4) r(t) where t <= vec_id % 4)"


def token_rows(spark, d):
    tokens = F.transform(F.sequence(F.lit(0), (F.col("vec_id") % 4).cast("int")), lambda t: F.slice("embedding", 1 + 8 * t, 1))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 6).cast("int").alias("fold"), (F.col("label") < 3).cast("int").alias("y"), F.lit(0).alias("layer"), tokens.alias("tokens"))


def _span_sql(how: str) -> str:
    base_rows = {"last": "select * from (select *, row_number() over (partition by id order by t desc) as r from tk) where r = 1", "mean": "select id, fold, y, layer, avg(x) as x from tk group by all", "max": "select * from tk"}[how]
    rows = f"{how}_v as ({base_rows}), {how}_t as (select f.fold as hold, s.* from {how}_v s join (select distinct fold from tk) f on f.fold <> s.fold), {newton(how, f'{how}_t', 'hold', ['x'])}"
    return rows + f", {how}_p as (select id, s.fold, layer, any_value(s.y) as y, max({P}) as p from {how}_v s join {how} on {how}.hold = s.fold group by id, s.fold, layer), {auroc_sql(how + '_a', how + '_p', 'layer')}"


@query(f"with recursive {TOKENS}, {', '.join(_span_sql(h) for h in ('last', 'mean', 'max'))} " + " union all ".join(f"select '{h}' as how, n, n_pos, round(auroc, 6) as auroc from {h}_a" for h in ("last", "mean", "max")))
def stat_span(spark, d):
    out = None
    for how in ("last", "mean", "max"):
        one = probes.fold_ranking(probes.span_scores(token_rows(spark, d), how)).select(F.lit(how).alias("how"), "n", "n_pos", "auroc")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "auroc", digits=6)


@query(f"with recursive {ROWS}, va as (select v.id, v.fold, v.y, 0 as layer, v.x, w.x as s from v join v w on w.id = v.id and v.layer = 0 and w.layer = 1), ct as (select f.fold as hold, va.* from va join (select distinct fold from v) f on f.fold <> va.fold), {newton('cf', 'ct', 'hold, layer', ['x', 's'])}, pv as (select va.*, 1 / (1 + exp(-(b0 * x + b1 * s + c))) as p from va join cf on cf.hold = va.fold), {FOLDS} {FOLDED}")
def stat_combined(spark, d):
    """A vector with a signal appended."""
    v = narrow(spark, d)
    signal = v.where("layer = 1").select("id", F.col("vec")[0].alias("s"))
    return rounded(probes.held_out_ranking(probes.with_features(v.where("layer = 0").join(signal, "id"), "s")), *RANKED, digits=6)


@query("""with recursive hc as (select vec_id as id, (vec_id % 6)::int as fold, (label < 3)::int as y, 0 as layer, length(t) / 10.0 as x, regexp_matches(t, '[A-Z]')::int::double as u from (select *, case when label % 3 = 0 then 'Value ' || vec_id else repeat('x', 1 + vec_id % 9) end as t from embeddings)), """ + f"ht as (select f.fold as hold, hc.* from hc join (select distinct fold from hc) f on f.fold <> hc.fold), {newton('hf', 'ht', 'hold, layer', ['x', 'u'])}, pv as (select hc.*, 1 / (1 + exp(-(b0 * x + b1 * u + c))) as p from hc join hf on hf.hold = hc.fold), {FOLDS} {FOLDED}")
def stat_handcrafted(spark, d):
    """Two of the hand-crafted features, the length by tens; stat_handcrafted_wide has all seven."""
    text = F.when(F.col("label") % 3 == 0, F.concat(F.lit("Value "), "vec_id")).otherwise(F.expr("repeat('x', cast(1 + vec_id % 9 as int))"))
    f = X.handcrafted(text, F.lit("a.b"))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 6).cast("int").alias("fold"), (F.col("label") < 3).cast("int").alias("y"), F.lit(0).alias("layer"), F.array(f["n_chars"] / 10.0, f["has_upper"].cast("double")).alias("vec"))
    return rounded(probes.held_out_ranking(rows), *RANKED, digits=6)


@query()
def stat_handcrafted_wide(spark, d):
    labels = base.labels(spark, d)
    features = F.array(*[c.cast("double") for c in X.handcrafted(F.col("extracted_value"), F.col("path_str")).values()])
    rows = labels.select(F.col("pos").alias("id"), F.substring("doc_id", 2, 9).cast("int").alias("u"), F.col("is_error").alias("y"), F.lit(0).alias("layer"), features.alias("vec"))
    return rounded(probes.held_out_ranking(rows.withColumn("fold", F.col("u") % 6).drop("u")), *RANKED, digits=6)


CONFLICT = f"""{HELD}, {auroc_sql('la', 'pv', 'layer')}, bl as (select layer from la where auroc is not null order by auroc desc, layer limit 1), cs as (select id, stddev_pop(p) as s from pv group by id), cv as (select v.id, v.fold, v.y, v.layer, v.x, cs.s from v join bl using (layer) join cs using (id)),
ct as (select f.fold as hold, cv.* from cv join (select distinct fold from v) f on f.fold <> cv.fold), {newton('c1', 'ct', 'hold', ['x'])}, {newton('c2', 'ct', 'hold', ['x', 's'])}, p1 as (select cv.y, {P} as p from cv join c1 on c1.hold = cv.fold), p2 as (select cv.y, 1 / (1 + exp(-(b0 * x + b1 * s + c))) as p from cv join c2 on c2.hold = cv.fold), {auroc_sql('a1', 'p1', '')}, {auroc_sql('a2', 'p2', '')}"""


@query(f"with recursive {ROWS}, {CONFLICT} select bl.layer as best_layer, a1.n, a1.n_pos, round(a1.auroc, 6) as auroc_baseline, round(a2.auroc, 6) as auroc_conflict, round(a2.auroc - a1.auroc, 6) as delta from bl, a1, a2")
def stat_conflict(spark, d):
    return rounded(probes.conflict_ranking(narrow(spark, d)), "auroc_baseline", "auroc_conflict", "delta", digits=6)


THREE = f"""sv as (select v.id, v.fold, v.y, 0 as layer, v.x, w.x as s1, abs(v.x - w.x) as s2 from v join v w on w.id = v.id and v.layer = 0 and w.layer = 1 where v.id % 23 > 0), sh as (select f.fold as hold, sv.* from sv cross join (select distinct fold from sv) f), st as (select * from sh where hold <> fold), {newton('s0', 'st', 'hold', ['x'])},
sz as (select sh.*, {P} as p0 from sh join s0 using (hold)), sm as (select hold, avg(p0) as m0, stddev_pop(p0) as d0, avg(s1) as m1, stddev_pop(s1) as d1, avg(s2) as m2, stddev_pop(s2) as d2 from sz where hold <> fold group by hold),
zz as (select hold, fold, id, y, (p0 - m0) / d0 as z0, (s1 - m1) / d1 as z1, (s2 - m2) / d2 as z2 from sz join sm using (hold)), zt as (select * from zz where hold <> fold), {newton('s3', 'zt', 'hold', ['z0', 'z1', 'z2'])},
pv as (select zz.id, zz.fold, zz.y, 0 as layer, 1 / (1 + exp(-(b0 * z0 + b1 * z1 + b2 * z2 + c))) as p from zz join s3 using (hold) where zz.fold = hold), {FOLDS}, co as (select unnest([{{'signal': 'probe', 'v': b0}}, {{'signal': 's1', 'v': b1}}, {{'signal': 's2', 'v': b2}}]) as u from s3),
cm as (select u.signal as signal, round(avg(u.v), 5) as weight, round(stddev_pop(u.v), 5) as weight_std from co group by 1)"""


@query(f"with recursive {ROWS}, {THREE} select n_folds, round(auroc_mean, 5) as auroc_mean, round(auroc_std, 5) as auroc_std, n, n_pos, round(auroc, 5) as auroc, round(ap, 5) as ap, signal, weight, weight_std from fm join pooled using (layer), cm")
def stat_three(spark, d):
    """A probe's held-out score with two signals, one of them not there for some rows."""
    v = narrow(spark, d)
    other = v.where("layer = 1").select("id", F.col("vec")[0].cast("double").alias("s1"))
    rows = v.where("layer = 0").join(other, "id").withColumn("s2", F.when(F.col("id") % 23 == 0, F.lit(float("nan"))).otherwise(F.abs(F.col("vec")[0].cast("double") - F.col("s1"))))
    out = probes.three_signal_ranking(rows, ["s1", "s2"]).withColumn("x", F.explode("coefficients"))
    each = out.withColumns({"signal": F.col("x.signal"), "weight": F.col("x.mean"), "weight_std": F.col("x.std")}).drop("x", "coefficients")
    return rounded(each, *RANKED, "weight", "weight_std", digits=5)


PROBED = f"""hs as (select *, md5('42|' || id) as h1, md5('43|' || id) as h2 from v), pr as (select *, (row_number() over (partition by layer, y order by h1, id) - 1) % 5 as part, row_number() over (partition by layer order by h2, id) <= greatest(1, round(0.2 * count(*) over (partition by layer))) as test from hs),
ft as (select 'all' as kind, -1 as k, * from pr union all select 'test', -1, * from pr where not test union all select 'part', k, pr.* from pr, range(0, 5) r(k) where part <> k), {newton('fit', 'ft', 'layer, kind, k', ['x'])},
pk as (select pr.layer, k, y, {P} as p from pr join fit on fit.layer = pr.layer and kind = 'part' and k = part), {auroc_sql('ka', 'pk', 'layer, k')}, ks as (select layer, count(auroc)::int as n_parts, round(avg(auroc), 6) as part_auroc from ka group by layer),
pt as (select pr.layer, y, {P} as p from pr join fit on fit.layer = pr.layer and kind = 'test' where test), {auroc_sql('ta', 'pt', 'layer')}, tm as (select layer, avg(pow(p - y, 2)) as brier, avg(((p > 0.5)::int = y)::int::double) as accuracy from pt group by layer),
tq as (select layer, min(p) as threshold_at_50 from (select *, row_number() over (partition by layer order by p desc) as r, count(*) over (partition by layer) as n from pt where y = 1) where r <= ceil(0.5 * n) group by layer)"""


@query(f"with recursive {ROWS}, {PROBED} select layer, round(fit.b0, 6) as beta, round(fit.c, 6) as bias, fit.n_train, n_parts, part_auroc, ta.n as n_test, ta.n_pos as n_test_errors, round(ta.auroc, 6) as auroc, round(ta.ap, 6) as ap, round(brier, 6) as brier, accuracy, round(threshold_at_50, 6) as threshold_at_50 from fit join ks using (layer) join ta using (layer) join tm using (layer) join tq using (layer) where kind = 'all'")
def stat_probe(spark, d):
    found = F.col("fold_auroc")
    mean = F.aggregate(found, F.lit(0.0), lambda s, a: s + a) / F.size(found)
    out = probes.train_probes(narrow(spark, d)).withColumns({"beta": F.col("beta")[0], "n_parts": F.size(found), "part_auroc": mean}).drop("fold_auroc")
    return rounded(out, "beta", "bias", "part_auroc", "auroc", "ap", "brier", "threshold_at_50", digits=6)


@query()
def stat_probe_wide(spark, d):
    return probes.train_probes(wide(spark, d)).drop("beta", "bias")


@query(f"with recursive {ROWS}, {HELD}, {FOLDS}, r as (select layer, row_number() over (order by auroc desc, layer) as r from pooled) select layer from r where r = 1")
def top_layer_fitted(spark, d):
    from veritrail.sinks.tables import best_probe

    return best_probe(probes.held_out_ranking(narrow(spark, d))).select("layer")
