"""Ranking, calibration, threshold, split and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import scalars
from gaugeframe.functions.hashing import stable_hex, unit_interval_split
from gaugeframe.operators import conformal, rankstats, report, rules, splits
from gaugeframe.plans import protocol, views
from gaugeframe.plans.registry import query

AUROC_SQL = """
g as (select {keys} {score} as s, sum(label)::double as p, sum(1 - label)::double as n from {rows} group by all),
c as (select *, coalesce(sum(n) over ({part} order by s rows between unbounded preceding and 1 preceding), 0) as below from g)
select {keys} sum(p)::bigint as n_pos, sum(n)::bigint as n_neg, round(sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0), 6) as auroc from c {group}"""


@query("with " + views.FLAT + "," + AUROC_SQL.format(keys="", score="price", rows="flat", part="", group=""))
def auroc_global(spark, d):
    return rankstats.auroc(views.flat_scores(spark, d), [], "price", "label")


@query("with " + views.LONG + "," + AUROC_SQL.format(keys="candidate,", score="score", rows="long", part="partition by candidate", group="group by candidate"))
def auroc_by_key(spark, d):
    return rankstats.auroc(views.candidates(spark, d), ["candidate"], "score", "label")


@query("with " + views.LONG + """,
g as (select candidate, score as s, sum(label)::double as p, count(*)::double as n from long group by all),
c as (select *, sum(p) over w as tp, sum(n) over w as seen from g window w as (partition by candidate order by s desc rows unbounded preceding))
select candidate, round(sum(p * tp / seen) / sum(p), 6) as average_precision from c group by candidate""")
def average_precision(spark, d):
    return rankstats.average_precision(views.candidates(spark, d), ["candidate"], "score", "label")


BINS = "with " + views.FLAT + """,
b as (select least(cast(floor(least(discount / 0.1::double, 1) * 15) as integer), 14) as bin, least(discount / 0.1::double, 1) as p, label from flat),
bins as (select bin, count(*) as n, avg(label::double) as ml, avg(p) as mp from b group by bin)"""


def _probability(spark, d):
    return views.flat_scores(spark, d).withColumn("p", F.least(F.col("discount") / F.lit(0.1), F.lit(1.0)))


@query(BINS + "select bin, n, round(ml, 6) as mean_label, round(mp, 6) as mean_probability from bins")
def ece_bins(spark, d):
    return rankstats.ece_bins(_probability(spark, d), [], "p", "label")


@query(BINS + "select round(sum(n * abs(ml - mp)) / sum(n), 6) as ece from bins")
def ece_value(spark, d):
    return rankstats.ece(_probability(spark, d), [], "p", "label")


@query("with " + views.FLAT + """,
e as (select cast((price > 30000) <> (label = 1) as integer) as err, price, item_id from flat),
c as (select avg(err::double) over (order by price desc, item_id rows unbounded preceding) as risk from e)
select round(avg(risk), 6) as aurc from c""")
def aurc(spark, d):
    rows = views.flat_scores(spark, d).withColumn("err", ((F.col("price") > 30000) != (F.col("label") == 1)).cast("int"))
    return rankstats.aurc(rows, [], "price", "err", "item_id")


@query("with " + views.FLAT + """,
c as (select count(*) filter (quantity > 25 and label = 1)::double as tp, count(*) filter (quantity > 25 and label = 0)::double as fp,
  count(*) filter (quantity <= 25 and label = 1)::double as fn, count(*) filter (quantity <= 25 and label = 0)::double as tn, avg(power(least(discount / 0.1::double, 1) - label, 2)) as brier from flat)
select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as balanced_accuracy,
  round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fn + fp)) / 2, 6) as macro_f1, round(2 * (tp / (tp + fn)) * (tn / (tn + fp)) / (tp / (tp + fn) + tn / (tn + fp)), 6) as harmonic, round(brier, 6) as brier from c""")
def binary_suite(spark, d):
    return rankstats.binary_suite(_probability(spark, d), [], "quantity", "label", F.lit(25.0), "p")


THRESHOLD = """
tg as (select {keys} {score} as s, sum(label)::double as p, sum(1 - label)::double as n from {rows} group by all),
tc as (select *, sum(p) over w as pu, sum(n) over w as nu, lead(s) over w as nxt, sum(p) over a as tp, sum(n) over a as tn, min(s) over a as least
  from tg window w as ({part} order by s), a as ({part})),
points as (select {keys} coalesce((s + nxt) / 2, s) as t, ((tp - pu) / tp + nu / tn) / 2 as ba from tc union all select distinct {keys} least - abs(least) * 1e-16::double, 0.5::double from tc),
best as (select {keys} max(ba) as best from points {group}),
cut as (select {keys} min(t) as threshold, max(best) as balanced_accuracy from points {join} where best - ba <= 1e-15::double {group})"""


@query("with " + views.LONG + "," + THRESHOLD.format(keys="candidate,", score="score", rows="long", part="partition by candidate", group="group by candidate", join="join best using (candidate)") + " select candidate, round(threshold, 6) as threshold, round(balanced_accuracy, 6) as balanced_accuracy from cut")
def threshold_argmax(spark, d):
    return rankstats.threshold_argmax(views.candidates(spark, d), ["candidate"], "score", "label")


@query("with " + views.FLAT + """,
l as (select price, unnest(['discount', 'tax', 'quantity']) as control, unnest([discount, tax, quantity]) as v from flat),
r as (select control, rank() over (partition by control order by price) + (count(*) over (partition by control, price) - 1) / 2.0::double as a,
  rank() over (partition by control order by v) + (count(*) over (partition by control, v) - 1) / 2.0::double as b from l)
select control, round(corr(a, b), 6) as rho from r group by control""")
def spearman_controls(spark, d):
    return rankstats.spearman(views.flat_scores(spark, d), [], "price", ["discount", "tax", "quantity"])


TREE_SPLIT = "with " + views.TREE + "," + views.SPLIT.format(rows="tree")


@query(TREE_SPLIT + " select split, count(*) as n from split group by split")
def exact_split_counts(spark, d):
    return splits.exact_split(views.tree(spark, d), "unit_id", 17).groupBy("split").agg(F.count("*").alias("n"))


@query(TREE_SPLIT + " select unit_id, split from split")
def exact_split_members(spark, d):
    return splits.exact_split(views.tree(spark, d), "unit_id", 17)


@query("with " + views.TREE + """,
h as (select unit_id, sha256('interval-split' || chr(0) || '42' || chr(0) || unit_id) as h from (select distinct unit_id from tree))
select unit_id, case when h < '9999999999999800000000000000000000000000000000000000000000000000' then 'train' when h < 'ccccccccccccd000000000000000000000000000000000000000000000000000' then 'calibration' else 'test' end as split from h""")
def threshold_split_members(spark, d):
    return splits.threshold_split(views.tree(spark, d), "unit_id", 42)


@query("with " + views.DOCS + """,
r as (select unit_id, lang, row_number() over (partition by lang order by sha256('sample' || chr(0) || '97' || chr(0) || unit_id), unit_id) as r from docscores)
select unit_id, lang from r order by r, lang limit 37""")
def stratified_roundrobin(spark, d):
    return splits.round_robin_sample(views.document_scores(spark, d).select("unit_id", "lang"), "unit_id", "lang", 37, 97)


@query("with " + views.DOCS + """,
z as (select lang, count(*) as n, sum(count(*)) over () as total from docscores group by lang),
q as (select *, 137 * n / total::double as quota from z),
s as (select *, floor(quota) as seat, quota - floor(quota) as frac from q),
t as (select *, seat + cast(row_number() over (order by frac desc, sha256('stratum-tie' || chr(0) || '17' || chr(0) || lang), lang) <= 137 - sum(seat) over () as integer) as seats from s),
r as (select unit_id, lang, row_number() over (partition by lang order by sha256('proportional-sample' || chr(0) || '17' || chr(0) || unit_id), unit_id) as r from docscores)
select r.unit_id, r.lang from r join t on r.lang = t.lang where r.r <= case when total <= 137 then n else seats end""")
def stratified_proportional(spark, d):
    return splits.proportional_sample(views.document_scores(spark, d).select("unit_id", "lang"), "unit_id", "lang", 137, 17).select("unit_id", "lang")


@query("with " + views.TREE + """,
r as (select *, row_number() over (partition by parent_id order by sha256('keep-variants' || chr(0) || '17' || chr(0) || item_id), item_id) as r from tree where kind = 'variant')
select parent_id, item_id from r where r <= 2""")
def topk_variants_per_root(spark, d):
    return splits.top_per_parent(views.tree(spark, d).filter("kind = 'variant'"), "parent_id", "item_id", 2, 17, "keep-variants").select("parent_id", "item_id")


@query("with " + views.TREE + """,
c as (select unit_id, count(*) as n, sha256('group-pack' || chr(0) || '17' || chr(0) || unit_id) as h from tree where kind = 'root' or kind = 'counter' group by unit_id),
top as (select *, row_number() over (order by h) as r from c)
select count(*) > 0 as any_kept, (select count(*) from c) > 0 as any_unit from top where r <= 40""")
def packing_is_whole(spark, d):
    roots = views.tree(spark, d).filter("kind <> 'variant'")
    kept = splits.pack_groups(roots.join(splits.top_per_parent(roots.select("unit_id").distinct().withColumn("all", F.lit(1)), "all", "unit_id", 40, 17, "group-pack").select("unit_id"), "unit_id"), "unit_id", 30, 17)
    return kept.agg((F.count("*") > 0).alias("any_kept")).crossJoin(roots.limit(1).agg((F.count("*") > 0).alias("any_unit")))


@query()
def packed_groups(spark, d):
    roots = views.document_scores(spark, d)
    return splits.pack_groups(roots, "lang", 300, 17)


@query("with " + views.CONV + """,
recursive_rows as (select conv_id, generate_subscripts(steps, 1) - 1 as i, length(unnest(steps)) as len from conv)
select conv_id, cast(i as integer) as step, len as length from recursive_rows""")
def step_lengths(spark, d):
    return views.conversations(spark, d).select("conv_id", F.posexplode("steps").alias("step", "s")).select("conv_id", "step", F.length("s").cast("bigint").alias("length"))


@query()
def greedy_batches(spark, d):
    steps = step_lengths(spark, d)
    return splits.greedy_batches(steps, ["conv_id"], "step", "length", 2000, 4)


@query("with " + views.CONV + """
select conv_id, cast(i as integer) as step, case when first_error = -1 or i < first_error then true when i = first_error then false end as label
from (select conv_id, first_error, unnest(range(n_steps)) as i from conv)""")
def step_labels_prefix(spark, d):
    c = views.conversations(spark, d)
    return c.select("conv_id", F.posexplode(scalars.first_error_steps(F.col("first_error"), F.col("n_steps"))).alias("step", "label"))


@query("with " + views.CONV + " select conv_id, case when first_error >= 0 then false when n_steps > 0 then true end as valid from conv")
def three_valued_valid(spark, d):
    c = views.conversations(spark, d)
    return c.select("conv_id", scalars.three_valued_valid(scalars.first_error_steps(F.col("first_error"), F.col("n_steps"))).alias("valid"))


@query("with " + views.CONV + " select conv_id, array_to_string(steps, chr(10)) as reasoning from conv")
def reasoning_text(spark, d):
    return views.conversations(spark, d).select("conv_id", scalars.steps_text(F.col("steps")).alias("reasoning"))


@query("select event_id, case when event_type = 'purchase' then 1 else 0 end as label, case when event_id % 11 = 0 then null when event_id % 13 = 0 then 'Infinity' else 'number' end as kind from events")
def json_safe_numbers(spark, d):
    e = views.read(spark, d, "events").select("event_id", (F.col("event_type") == "purchase").cast("int").alias("label"))
    odd = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).when(F.col("event_id") % 13 == 0, F.lit(float("inf"))).otherwise(F.lit(1.5))
    text = scalars.json_number(odd)
    return e.select("event_id", "label", F.when(text == "1.5", "number").otherwise(text).alias("kind"))


@query("""with i as (select doc_id, cast(n_chars as integer) as n from documents)
select doc_id, unnest(case when n <= 8 then range(n) else [cast(floor(k * (n - 1) / 7.0::double) as bigint) for k in range(8)] end)::integer as idx from i where n > 0""")
def even_token_indices(spark, d):
    docs = views.read(spark, d, "documents").filter("n_chars > 0")
    return docs.select("doc_id", F.explode(scalars.even_indices(F.col("n_chars").cast("int"), 8)).alias("idx"))


@query("""select p_partkey, v, case when length(cast(v + 1 as varchar)) = length(cast(v as varchar)) then v + 1 else v - 1 end as neighbour
from (select p_partkey, p_partkey % 1000 as v from part) where v > 0""")
def same_width_literals(spark, d):
    p = views.read(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 1000).alias("v")).filter("v > 0")
    return p.select("p_partkey", "v", scalars.same_width_neighbour(F.col("v")).alias("neighbour"))


@query("""select user_id, choice from (select distinct user_id,
  cast((('0x' || substr(sha256('pick' || chr(0) || '17' || chr(0) || user_id), 1, 16))::ubigint) % 7 as bigint) as choice from events)""")
def hash_choice(spark, d):
    from gaugeframe.functions.hashing import choose_index

    return views.read(spark, d, "events").select("user_id").distinct().select("user_id", choose_index(stable_hex("pick", 17, F.col("user_id")), F.lit(7)).alias("choice"))


@query("""select trim(l_returnflag) as flag, case when l_linestatus = 'O' then 1 else 0 end as label, count(*) as n from lineitem group by all""")
def text_labels(spark, d):
    t = scalars.text_label(F.when(F.col("l_linestatus") == "O", " VALID ").otherwise("False"))
    return views.read(spark, d, "lineitem").groupBy(F.trim("l_returnflag").alias("flag"), t.alias("label")).agg(F.count("*").alias("n"))


@query("with " + views.TREE + """,
u as (select unit_id, unit_id as s, label from tree where kind = 'root'),
h as (select *, sha256('interval-split' || chr(0) || '17' || chr(0) || unit_id) as h from u),
t as (select label, case when h < '9999999999999800000000000000000000000000000000000000000000000000' then 'train' when h < 'ccccccccccccd000000000000000000000000000000000000000000000000000' then 'calibration' else 'test' end as split_17 from h)
select 'label' as "column", cast(label as varchar) as value, count(*) as n from t group by all union all select 'split_17', split_17, count(*) from t group by all""")
def label_counts(spark, d):
    rows = views.tree(spark, d).filter("kind = 'root'").withColumn("split_17", unit_interval_split(stable_hex("interval-split", 17, F.col("unit_id"))))
    return report.label_counts(rows, "label", ["split_17"])


# certificates ---------------------------------------------------------------------------------

RADII = """radii as (
  select r.item_id, r.unit_id, r.label, r.kind, r.eligible, r.score, max(abs(v.score - r.score)) as radius
  from tree r join tree v on v.parent_id = r.item_id and v.kind = 'variant' and v.eligible where r.kind <> 'variant' group by all)"""
WITH_RADII = "with " + views.TREE + "," + RADII


@query("with " + views.TREE + """ select unit_id, label, round(avg(score), 6) as score from tree where kind <> 'variant' and (kind <> 'counter' or eligible) group by all""")
def cell_means(spark, d):
    return protocol.cells(views.tree(spark, d), [])


@query(WITH_RADII + " select item_id, unit_id, label, round(radius, 6) as radius from radii")
def root_radii(spark, d):
    return conformal.root_radii(views.tree(spark, d)).select("item_id", "unit_id", "label", "radius")


@query(WITH_RADII + " select unit_id, round(max(radius), 6) as radius, count(*) as n_roots from radii group by unit_id")
def unit_radii(spark, d):
    return conformal.unit_radii(conformal.root_radii(views.tree(spark, d)), [])


@query(WITH_RADII + " select unit_id, case when label = 1 then 'positive' else 'negative' end as side, round(max(radius), 6) as radius, count(*) as n_roots from radii group by all")
def side_radii(spark, d):
    radii = conformal.root_radii(views.tree(spark, d)).withColumn("side", conformal.side(F.col("label")))
    return conformal.unit_radii(radii, ["side"])


@query(WITH_RADII + """,
u as (select unit_id, case when label = 1 then 'positive' else 'negative' end as side, max(radius) as r from radii group by all),
k as (select *, row_number() over (partition by side order by r) as i, count(*) over (partition by side) as n from u),
a as (select unnest([0.05::double, 0.1::double, 0.2::double]) as alpha)
select side, alpha, n, cast(ceil((n + 1) * (1 - alpha)) as bigint) as k, round(max(case when i = cast(ceil((n + 1) * (1 - alpha)) as bigint) then r end), 6) as q from k, a group by side, alpha, n""")
def conformal_quantile(spark, d):
    radii = conformal.root_radii(views.tree(spark, d)).withColumn("side", conformal.side(F.col("label")))
    per = conformal.unit_radii(radii, ["side"]).crossJoin(spark.createDataFrame([(0.05,), (0.1,), (0.2,)], "alpha double"))
    return conformal.quantile(per, ["side", "alpha"], "radius", F.col("alpha"))


# validation -----------------------------------------------------------------------------------


@query("with " + views.RAW_TREE + """ select v.item_id as key from raw_tree v left join raw_tree r on r.item_id = v.parent_id and r.kind <> 'variant' where v.kind = 'variant' and r.item_id is null""")
def orphan_variants(spark, d):
    return rules.tree_violations(views.raw_tree(spark, d)).filter("rule = 'orphan'").select("key")


@query("with " + views.RAW_TREE + """,
j as (select v.item_id, v.label as vl, r.label as rl, v.eligible as ve, r.eligible as re, r.item_id as rid from raw_tree v left join raw_tree r on r.item_id = v.parent_id and r.kind <> 'variant' where v.kind = 'variant')
select rule, count(*) as n from (
  select 'orphan' as rule from j where rid is null union all select 'label' from j where rid is not null and vl is distinct from rl union all select 'eligible' from j where rid is not null and ve and not re) group by rule""")
def tree_rule_counts(spark, d):
    return rules.tree_violations(views.raw_tree(spark, d)).groupBy("rule").agg(F.count("*").alias("n"))


@query("select l_orderkey || '-' || l_linenumber as item, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_ids(spark, d):
    rows = views.read(spark, d, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("item"))
    return rules.duplicates(rows, "item")


@query("select l_orderkey, count(distinct l_suppkey) as n from lineitem group by 1 having count(distinct l_suppkey) > 1")
def functional_violations(spark, d):
    return rules.not_functional(views.read(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("with " + views.RAW_TREE + """ select 'label' as rule, count(*) as n from raw_tree where label is null having count(*) > 0""")
def row_rule_counts(spark, d):
    rows = views.raw_tree(spark, d)
    return rules.violations(rows, "item_id", rules.row_rules()).groupBy("rule").agg(F.count("*").alias("n"))
