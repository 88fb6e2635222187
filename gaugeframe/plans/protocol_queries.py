"""Certificates, pairs, the frozen protocol, sweeps and ablations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import scalars
from gaugeframe.functions.hashing import stable_hex
from gaugeframe.operators import conformal, inference, pairs, rankstats, report, splits
from gaugeframe.operators.prefix import on, once
from gaugeframe.plans import protocol, views
from gaugeframe.plans.metric_queries import RADII, THRESHOLD
from gaugeframe.plans.registry import query

#: The fit of the frozen protocol on the tree: orientation, threshold and quantiles.
FIT = (
    "with "
    + views.TREE
    + ","
    + views.SPLIT.format(rows="tree")
    + ","
    + RADII
    + """,
cells as (select t.unit_id, t.label, s.split, round(avg(t.score), 9) as score from tree t join split s on s.unit_id = t.unit_id
  where t.kind <> 'variant' and (t.kind <> 'counter' or t.eligible) group by all),
g as (select score as s, sum(label)::double as p, sum(1 - label)::double as n from cells where split = 'train' group by all),
c as (select *, coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding), 0) as below from g),
a as (select sum(p * (below + n / 2)) / (sum(p) * sum(n)) as auroc from c),
turned as (select case when auroc < 0.5 then -1 else 1 end as orientation, greatest(auroc, 1 - auroc) as train_auroc from a),
oriented as (select label, score * orientation as score from cells, turned where split = 'train'),"""
    + THRESHOLD.format(keys="", score="score", rows="oriented", part="", group="", join=", best")
    + """,
cal as (select unit_id, case when label = 1 then 'positive' else 'negative' end as side, max(radius) as r from radii join split using (unit_id) where split = 'calibration' group by all),
ck as (select *, row_number() over (partition by side order by r) as i, count(*) over (partition by side) as n from cal),
qs as (select side, max(n) as n, coalesce(max(case when i = cast(ceil((n + 1) * (1 - {alpha}::double)) as bigint) then r end), 'infinity'::double) as q from ck group by side),
state as (select orientation, train_auroc, threshold, balanced_accuracy as train_balanced_accuracy, (select q from qs where side = 'positive') as q_positive, (select q from qs where side = 'negative') as q_negative,
  (select n from qs where side = 'positive') as n_positive, (select n from qs where side = 'negative') as n_negative, (select max(q) from qs) as q from turned, cut)"""
).replace("{alpha}", "0.1")
ROOTS = """,
jr as (select t.*, t.score * orientation as o, case when t.score * orientation - st.q > threshold then 'valid' when t.score * orientation + st.q < threshold then 'invalid' else 'abstain' end as decision,
    case when label = 1 then 'positive' else 'negative' end as side, orientation, threshold, q_positive, q_negative, st.q
  from tree t join split s using (unit_id), state st where s.split = 'test' and t.kind <> 'variant' and (t.kind <> 'counter' or t.eligible)),
jv as (select jr.unit_id, jr.side, jr.o, v.score * jr.orientation as ch, jr.threshold, case when jr.side = 'positive' then jr.q_positive else jr.q_negative end as q
  from jr join tree v on v.parent_id = jr.item_id and v.kind = 'variant' and v.eligible)"""


def _fitted(spark, d):
    rows = once(views.tree(spark, d))
    split = once(splits.exact_split(rows, "unit_id", 17))
    return rows, split, protocol.fit(rows, split, [], 0.1)


@query(FIT + " select orientation, round(train_auroc, 6) as train_auroc, round(threshold, 6) as threshold, round(train_balanced_accuracy, 6) as train_balanced_accuracy, round(q_positive, 6) as q_positive, n_positive, round(q_negative, 6) as q_negative, n_negative, round(q, 6) as q from state")
def protocol_fit_state(spark, d):
    return _fitted(spark, d)[2]


@query(FIT + ROOTS + " select item_id, label, eligible, round(o, 6) as score, round(o - q, 6) as low, round(o + q, 6) as high, decision from jr")
def protocol_items(spark, d):
    rows, split, state = _fitted(spark, d)
    low, high = conformal.interval(F.col("score"), F.col("q"))
    return protocol.judged(rows, split, state, []).select("item_id", "label", "eligible", "score", low.alias("low"), high.alias("high"), "decision")


@query(FIT + ROOTS + " select decision, label, count(*) as n from jr group by all")
def certificate_decisions(spark, d):
    rows, split, state = _fitted(spark, d)
    return protocol.judged(rows, split, state, []).groupBy("decision", "label").agg(F.count("*").alias("n"))


PAIRS = """,
pr as (select c.pair_id, p.unit_id, p.score - c.score as gap, rp.radius as pr, rc.radius as nr
  from tree c join tree p on p.item_id = c.positive_id join radii rp on rp.item_id = p.item_id join radii rc on rc.item_id = c.item_id where c.kind = 'counter' and c.eligible and p.eligible{test})"""
METRICS = """,
tcell as (select label, score * orientation as score from cells, state where split = 'test'),
tg2 as (select score as s, sum(label)::double as p, sum(1 - label)::double as n from tcell group by all),
up as (select *, coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding), 0) as below from tg2),
dn as (select *, sum(p) over w as tp, sum(p + n) over w as seen from tg2 window w as (order by s desc rows unbounded preceding)),
k as (select count(*) filter (score > threshold and label = 1)::double as tp, count(*) filter (score > threshold and label = 0)::double as fp, count(*) filter (score <= threshold and label = 1)::double as fn, count(*) filter (score <= threshold and label = 0)::double as tn from tcell, state),
uv as (select unit_id, avg(cast((o > threshold) <> (ch > threshold) as double)) as f, avg(cast(abs(ch - o) <= q as double)) as c from jv group by 1),
tp as (select pr.*, gap * orientation as g, q_positive, q_negative from pr, state),
up2 as (select unit_id, avg(cast(g > 0 as double)) as s from tp group by 1)
select round((select sum(p * (below + n / 2)) / (sum(p) * sum(n)) from up), 6) as auroc, round((select sum(p * tp / seen) / sum(p) from dn), 6) as average_precision,
  round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as balanced_accuracy,
  (select round(avg(cast(decision = 'abstain' as double)), 6) from jr where eligible) as abstention,
  (select round(avg(cast((decision = 'valid') = (label = 1) as double)), 6) from jr where eligible and decision <> 'abstain') as selective_accuracy,
  (select round(avg(cast((o > threshold) <> (ch > threshold) as double)), 6) from jv) as flip_rate, (select round(avg(cast(abs(ch - o) <= q as double)), 6) from jv) as coverage,
  (select round(avg(f), 6) from uv) as unit_flip_rate, (select round(avg(c), 6) from uv) as unit_coverage,
  (select count(*) from tp) as n_pairs, (select round(avg(cast(g > 0 as double)), 6) from tp) as sensitivity, (select round(avg(s), 6) from up2) as unit_sensitivity,
  (select round(avg(cast(g > pr + nr as double)), 6) from tp) as separated, (select round(avg(cast(g > q_positive + q_negative as double)), 6) from tp) as certified
from k"""
TEST_PAIRS = PAIRS.replace("{test}", " and p.unit_id in (select unit_id from split where split = 'test')")
HEADLINE = ["auroc", "average_precision", "accuracy", "balanced_accuracy", "abstention", "selective_accuracy", "flip_rate", "coverage", "unit_flip_rate", "unit_coverage", "n_pairs", "sensitivity", "unit_sensitivity", "separated", "certified"]


@query(FIT + ROOTS + TEST_PAIRS + METRICS)
def protocol_test_metrics(spark, d):
    rows, split, state = _fitted(spark, d)
    return protocol.evaluate(rows, split, state, []).select(*HEADLINE)


@query(FIT + ROOTS + TEST_PAIRS + METRICS.replace("select round((select", ", wide as (select round((select", 1) + ") select metric, value from (unpivot (select auroc, accuracy, coverage, certified from wide) on auroc, accuracy, coverage, certified into name metric value value)")
def metric_unpivot(spark, d):
    rows, split, state = _fitted(spark, d)
    wide = protocol.evaluate(rows, split, state, []).withColumn("_id", F.lit(0))
    return report.unpivot(wide, ["_id"], ["auroc", "accuracy", "coverage", "certified"]).drop("_id")


WITH_PAIRS = "with " + views.TREE + "," + RADII + PAIRS.replace("{test}", "")


@query("with " + views.TREE + " select pair_id, positive_id, item_id as negative_id from tree where kind = 'counter'")
def pair_resolution(spark, d):
    return pairs.resolve(views.tree(spark, d))


def _pairs(spark, d):
    rows = views.tree(spark, d)
    return pairs.measure(pairs.resolve(rows), rows, conformal.root_radii(rows))


@query(WITH_PAIRS + """, u as (select unit_id, avg(cast(gap > 0 as double)) as s, avg(cast(gap > pr + nr as double)) as c from pr group by 1)
select count(*) as n_pairs, round(avg(cast(gap > 0 as double)), 6) as sensitivity, round(avg(cast(gap > pr + nr as double)), 6) as separated, round(avg(gap), 6) as mean_gap, (select round(avg(s), 6) from u) as unit_sensitivity, (select round(avg(c), 6) from u) as unit_separated from pr""")
def pair_metrics(spark, d):
    return pairs.summarise(_pairs(spark, d), [])


@query(WITH_PAIRS + " select count(*) as n, round(avg(gap), 6) as mean, round(avg(gap) / stddev_samp(gap), 6) as effect from pr")
def effect_size(spark, d):
    return inference.effect_size(_pairs(spark, d), [], "gap")


@query(WITH_PAIRS + """, s as (select count(*) filter (gap > 0) as a, count(*) filter (gap < 0) as b from pr),
k as (select *, least(a, b) as m, a + b as n from s),
t as (select i, sum(case when i = 0 then 0 else ln((n - i + 1)::double / i) end) over (order by i) as c, n from k, unnest(range(m + 1)) as r(i))
select (select a from s) as n_pos, (select b from s) as n_neg, round(least(1, 2 * sum(exp(c - n * ln(2::double)))), 6) as p_value from t""")
def sign_test(spark, d):
    return inference.sign_test(_pairs(spark, d), [], "gap")


@query("with " + views.FLAT + """, k0 as (select cast(quantity > 25 as integer) = label as a, cast(price > 30000 as integer) = label as b from flat),
s as (select count(*) filter (a and not b) as x, count(*) filter (b and not a) as y from k0), k as (select *, least(x, y) as m, x + y as n from s),
t as (select i, sum(case when i = 0 then 0 else ln((n - i + 1)::double / i) end) over (order by i) as c, n from k, unnest(range(m + 1)) as r(i))
select (select x from s) as only_first, (select y from s) as only_second, round(least(1, 2 * sum(exp(c - n * ln(2::double)))), 6) as p_value from t""")
def mcnemar(spark, d):
    rows = views.flat_scores(spark, d).withColumn("a", (F.col("quantity") > 25).cast("int")).withColumn("b", (F.col("price") > 30000).cast("int"))
    return inference.mcnemar(rows, [], "label", "a", "b")


@query("""with p as (select user_id, round(avg(value) / (max(value) + 1), 6) as p from events group by user_id),
k as (select *, row_number() over (order by p, user_id) as k, count(*) over () as n from p)
select user_id, p, round(least(min(p * n / k) over (order by k rows between current row and unbounded following), 1), 6) as p_adjusted from k""")
def bh_adjust(spark, d):
    p = views.read(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value") / (F.max("value") + 1), 6).alias("p"))
    return rankstats.benjamini_hochberg(p, [], "p", "user_id")


DRAWS = """,
units as (select {unit} as u, row_number() over (order by {unit}) - 1 as i from (select distinct {unit} from {rows})),
g as (select count(*) as g from units),
slots as (select rep, unnest(range(g)) as slot, g from g, unnest(range({reps})) as r(rep)),
draws as (select rep, cast('0x' || substr(sha256('{seed}' || ':' || rep || ':' || slot), 1, 15) as bigint) % g as i from slots),
drawn as (select rep, u, count(*) as times from draws join units using (i) group by all)"""


@query("with " + views.DOCS + DRAWS.format(unit="lang", rows="docscores", reps=200, seed=5) + """,
s as (select lang as u, sum(score) as s, count(*) as c from docscores group by 1),
st as (select rep, sum(s * times) / sum(c * times) as v from drawn join s using (u) group by rep)
select round(quantile_cont(v, (1 - 0.95::double) / 2), 6) as low, round(quantile_cont(v, 1 - (1 - 0.95::double) / 2), 6) as high, count(*) as replicates, (select round(avg(score), 6) from docscores) as estimate from st""")
def bootstrap_ci(spark, d):
    return inference.bootstrap_mean(views.document_scores(spark, d), "lang", "score", 200, 5)


@query("with " + views.DOCS + ", ds as (select *, doc_id % 97 as second from docscores)" + DRAWS.format(unit="unit_id", rows="ds", reps=40, seed=9) + """,
l as (select rep, label, times, unnest([1, 2]) as w, unnest([score, second::double]) as s from drawn join ds on ds.unit_id = drawn.u),
gg as (select rep, w, s, sum(times * label)::double as p, sum(times * (1 - label))::double as n from l group by all),
cc as (select *, coalesce(sum(n) over (partition by rep, w order by s rows between unbounded preceding and 1 preceding), 0) as below from gg),
au as (select rep, w, sum(p * (below + n / 2)) / (sum(p) * sum(n)) as a from cc group by all),
df as (select rep, sum(case when w = 1 then a else -a end) as v from au group by rep)
select round(quantile_cont(v, (1 - 0.95::double) / 2), 6) as low, round(quantile_cont(v, 1 - (1 - 0.95::double) / 2), 6) as high, count(*) as used, 0::bigint as skipped from df""")
def paired_auc_bootstrap(spark, d):
    rows = views.document_scores(spark, d).withColumn("second", (F.col("doc_id") % 97).cast("double"))
    return inference.bootstrap_auc_difference(rows, "unit_id", "label", "score", "second", 40, 9)


@query(WITH_PAIRS + """, few as (select pair_id, gap from pr order by pair_id limit 12), x as (select list(gap order by pair_id) as d, count(*) as n, avg(gap) as o from few),
m as (select o, unnest(range(pow(2, n)::bigint)) as mask, d, n from x),
v as (select o, list_sum([case when (mask >> (i - 1)) & 1 = 1 then -d[i] else d[i] end for i in range(1, n + 1)]) / n as m, n from m)
select n::integer as n, round(o, 6) as observed, round(avg(cast(abs(m) >= abs(o) - 8 * 2.220446049250313e-16::double * greatest(1, abs(o)) as double)), 6) as p_value, count(*) as patterns from v group by n, o""")
def permutation_exact(spark, d):
    few = _pairs(spark, d).orderBy("pair_id").limit(12)
    return inference.permutation_exact(few, "gap", "pair_id")


@query(WITH_PAIRS + """, b as (select rep, avg(case when cast('0x' || substr(sha256('3:' || rep || ':' || pair_id), 1, 8) as bigint) % 2 = 1 then -gap else gap end) as m from pr, unnest(range(100)) as r(rep) group by rep),
o as (select avg(gap) as o from pr)
select round(o, 6) as observed, round((count(*) filter (abs(m) >= abs(o) - 8 * 2.220446049250313e-16::double * greatest(1, abs(o))) + 1)::double / (count(*) + 1), 6) as p_value, count(*) as replicates from b, o group by o""")
def permutation_mc(spark, d):
    return inference.permutation_sampled(_pairs(spark, d), "pair_id", "gap", 100, 3)


# sweeps ---------------------------------------------------------------------------------------

SWEEP = "with " + views.LONG + "," + views.SPLIT.format(rows="flat") + """,
cl as (select candidate, unit_id, label, round(avg(l.score), 9) as score from long l join split s using (unit_id) where split = 'train' group by all),
g as (select candidate, score as s, sum(label)::double as p, sum(1 - label)::double as n from cl group by all),
c as (select *, coalesce(sum(n) over (partition by candidate order by s rows between unbounded preceding and 1 preceding), 0) as below from g),
a as (select candidate, sum(p * (below + n / 2)) / (sum(p) * sum(n)) as auroc from c group by candidate),
t as (select candidate, case when auroc < 0.5 then -1 else 1 end as orientation, greatest(auroc, 1 - auroc) as train_auroc, case when candidate in ('price', 'quantity') then 'size' else 'rate' end as family from a)"""


def _sweep(spark, d):
    family = F.when(F.col("candidate").isin("price", "quantity"), "size").otherwise("rate")
    return views.candidates(spark, d).withColumn("family", family).withColumn("kind", F.lit("root")).withColumn("eligible", F.lit(True))


@query(SWEEP + " select family, candidate, orientation, round(train_auroc, 5) as train_auroc from (select *, row_number() over (partition by family order by train_auroc desc, candidate) as r from t) where r = 1")
def family_selection(spark, d):
    rows = _sweep(spark, d)
    chosen = protocol.select_family(rows, splits.exact_split(rows, "unit_id", 17), ["family"], "candidate")
    return chosen.withColumn("train_auroc", F.round("train_auroc", 5))  # one value lies on the edge of six decimals


@query(SWEEP + """, tests as (select l.candidate, l.label, l.score * orientation as score from long l join split s using (unit_id) join t using (candidate) where split = 'test'),
g2 as (select candidate, score as s, sum(label)::double as p, sum(1 - label)::double as n from tests group by all),
c2 as (select *, coalesce(sum(n) over (partition by candidate order by s rows between unbounded preceding and 1 preceding), 0) as below from g2)
select candidate, sum(p)::bigint as n_pos, sum(n)::bigint as n_neg, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) as auroc from c2 group by candidate""")
def observational_transfer(spark, d):
    rows = _sweep(spark, d)
    split = splits.exact_split(rows, "unit_id", 17)
    turned = protocol.orientation(protocol.cells(rows.join(split.filter("split = 'train'"), "unit_id"), ["candidate"]), ["candidate"])
    test = on(["candidate"], rows.join(split.filter("split = 'test'"), "unit_id"), turned).withColumn("score", F.col("score") * F.col("orientation"))
    return rankstats.auroc(test, ["candidate"], "score", "label")


@query("with " + views.LONG + """, v as (select candidate, label, case when cast(substr(unit_id, length(unit_id), 1) as integer) = 3 then null else score end as s from long)
select candidate, round(avg(s), 6) as mean, round(coalesce(stddev_samp(s), 0), 6) as std, round(min(s), 6) as min, round(max(s), 6) as max, count(s) as n, string_agg(distinct cast(label as varchar), '|' order by cast(label as varchar)) as labels from v group by candidate""")
def finite_summary(spark, d):
    odd = F.when(F.col("unit_id").endswith("3"), F.lit(float("nan"))).otherwise(F.col("score"))
    return report.finite_summary(views.candidates(spark, d).withColumn("value", odd), ["candidate"], label="label")


@query("with " + views.TREE + "," + views.SPLIT.format(rows="tree") + "," + RADII + """,
cal as (select unit_id, case when label = 1 then 'positive' else 'negative' end as side, max(radius) as r from radii join split using (unit_id) where split = 'calibration' group by all),
h as (select *, row_number() over (partition by side order by sha256('calibration-subsample' || chr(0) || '17' || chr(0) || side || '|' || unit_id), unit_id) as o, count(*) over (partition by side) as pool from cal),
grid as (select unnest([0.05::double, 0.2::double, 0.05::double, 0.2::double, 0.05::double, 0.2::double]) as alpha, unnest([5, 5, 20, 20, 1000000, 1000000]) as size),
k as (select alpha, size, side, pool, r, row_number() over (partition by alpha, size, side order by r) as i, count(*) over (partition by alpha, size, side) as n from h, grid where o <= size)
select alpha, size, side, case when max(pool) < size then 'not_applicable' else 'ok' end as status, n, cast(ceil((n + 1) * (1 - alpha)) as bigint) as k,
  round(case when ceil((n + 1) * (1 - alpha)) > n then 'infinity'::double else max(case when i = cast(ceil((n + 1) * (1 - alpha)) as bigint) then r end) end, 6) as q from k group by alpha, size, side, n""")
def ablation_grid(spark, d):
    """Quantiles over a grid of error levels and calibration sizes, all in one plan."""
    rows = views.tree(spark, d)
    assigned = rows.join(splits.exact_split(rows, "unit_id", 17), "unit_id")
    per = protocol.calibration_radii(assigned.filter("split = 'calibration'"), [], None, 17)
    from gaugeframe.operators.prefix import hash_rank

    ranked = hash_rank(per.withColumn("_h", stable_hex("calibration-subsample", 17, F.concat_ws("|", "side", "unit_id"))), ["side"], "_h", "_r", ("unit_id",))
    grid = spark.createDataFrame([(a, s) for a in (0.05, 0.2) for s in (5, 20, 1_000_000)], "alpha double, size int")
    pool = ranked.groupBy("side").agg(F.count("*").alias("pool"))
    points = ranked.join(F.broadcast(grid), F.col("_r") <= F.col("size"))
    q = conformal.quantile(points, ["alpha", "size", "side"], "radius", F.col("alpha")).join(F.broadcast(pool), "side")
    return q.select("alpha", "size", "side", F.when(F.col("pool") < F.col("size"), "not_applicable").otherwise("ok").alias("status"), "n", "k", "q")


@query("with " + views.TREE + "," + views.SPLIT.format(rows="tree") + "," + RADII + """,
cal as (select unit_id, case when label = 1 then 'positive' else 'negative' end as side, max(radius) as r from radii join split using (unit_id) where split = 'calibration' group by all),
h as (select *, row_number() over (partition by side order by sha256('calibration-subsample' || chr(0) || '17' || chr(0) || side || '|' || unit_id), unit_id) as o from cal)
select side, unit_id, round(r, 6) as radius from h where o <= 15""")
def calibration_subsample(spark, d):
    rows = views.tree(spark, d)
    assigned = rows.join(splits.exact_split(rows, "unit_id", 17), "unit_id").filter("split = 'calibration'")
    return protocol.calibration_radii(assigned, [], 15, 17).select("side", "unit_id", "radius")


@query("""with r as (select count(*)::double as n from documents) select round(sqrt(ln(2 * 4.0::double / 0.05::double) / (2 * n)), 6) as bound from r""")
def selection_bound(spark, d):
    n = views.read(spark, d, "documents").agg(F.count("*").cast("double").alias("n"))
    return n.select(report.selection_bound(F.col("n"), F.lit(4.0), 0.05).alias("bound"))


@query("with " + views.FLAT + """, m as (select unnest(case when quantity > 5 then ['price', 'layer_10.energy', 'layer_2.energy'] else ['price', 'layer_2.energy'] end) as name from flat)
select case when name like 'layer%' then 'energy' else name end as family, name from m group by name having count(*) = (select count(*) from flat)""")
def family_discovery(spark, d):
    rows = views.flat_scores(spark, d)
    scores = F.when(F.col("quantity") > 5, F.create_map(F.lit("price"), F.col("price"), F.lit("layer_10.energy"), F.col("tax"), F.lit("layer_2.energy"), F.col("tax"))).otherwise(F.create_map(F.lit("price"), F.col("price"), F.lit("layer_2.energy"), F.col("tax")))
    return report.score_families(rows.select(scores.alias("scores")), "scores")


@query("""with o as (select o_orderkey, o_custkey, (select max(c_custkey) from customer) as most from orders)
select case when o_custkey % 5 = 0 then 'group' when o_orderkey % 7 = 0 then 'hash' else 'ok' end as status, count(*) as n from o group by all""")
def three_key_join(spark, d):
    """Exact join of scores with prepared rows: the item must be there, group and hash must agree."""
    prepared = views.read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("group_id"), F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("target_hash"))
    scores = prepared.select("o_orderkey", F.when(F.col("group_id") % 5 == 0, F.col("group_id") + 1).otherwise(F.col("group_id")).alias("g"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("x")).otherwise(F.col("target_hash")).alias("h"))
    joined = scores.join(prepared, "o_orderkey", "left")
    status = F.when(F.col("group_id").isNull(), "absent").when(F.col("g") != F.col("group_id"), "group").when(F.col("h") != F.col("target_hash"), "hash").otherwise("ok")
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("select l_returnflag as flag, count(*) as n from lineitem where l_suppkey not in (select s_suppkey from supplier where s_suppkey % 3 = 0) group by 1")
def anti_exclusion(spark, d):
    out = views.read(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return views.read(spark, d, "lineitem").join(out, "l_suppkey", "left_anti").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))


@query("with " + views.FLAT + " select item_id, round(quantity - 2, 6) as low, round(quantity + 2, 6) as high, case when quantity - 2 > 25 then 'valid' when quantity + 2 < 25 then 'invalid' else 'abstain' end as decision from flat")
def certificate_intervals(spark, d):
    low, high = conformal.interval(F.col("quantity"), F.lit(2.0))
    return views.flat_scores(spark, d).select("item_id", low.alias("low"), high.alias("high"), conformal.decision(F.col("quantity"), F.lit(25.0), F.lit(2.0)).alias("decision"))


@query("""with t as (select i, i % 2 as y, i / 100.0::double as s, case when i % 2 = 1 then (100 + i) / 100.0::double else (100 - i) / 100.0::double end as m from range(1, 101) r(i))
select round(avg(cast((s > 0.5) <> (s > 0.5) as double)), 6) as semantic_flip, round(avg(cast(m + 0.5 > m as double)), 6) as semantic_sensitivity, round(avg(cast(s > s as double)), 6) as surface_sensitivity from t""")
def toy_identities(spark, d):
    """Synthetic scores with known identities: a semantic score ignores preserving edits and always
    reacts to violating ones, a surface score never reacts."""
    t = spark.range(1, 101).select((F.col("id") / 100.0).alias("s"), F.when(F.col("id") % 2 == 1, (100 + F.col("id")) / 100.0).otherwise((100 - F.col("id")) / 100.0).alias("m"))
    rate = lambda c, n: F.avg(c.cast("double")).alias(n)
    return t.agg(rate((F.col("s") > 0.5) != (F.col("s") > 0.5), "semantic_flip"), rate(F.col("m") + 0.5 > F.col("m"), "semantic_sensitivity"), rate(F.col("s") > F.col("s"), "surface_sensitivity"))


@query("select event_id, case when event_id % 11 = 0 then null else round(value, 6) end as value from events")
def null_if_not_finite(spark, d):
    odd = F.when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return views.read(spark, d, "events").select("event_id", scalars.null_if_not_finite(odd).alias("value"))
