"""Identities, canonical rows, metadata, selections, exclusions and sweep summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import canonical
from gaugeframe.operators import filters, identity, prepare
from gaugeframe.plans import sweep, views
from gaugeframe.plans.model_queries import _sources
from gaugeframe.plans.registry import query

STATEMENTS = """part_rows as (
  select p_partkey as n, 't' || p_partkey as name, cast(p_partkey % 90 as varchar) as group_id,
    sha256('["(","a","b",":","ℕ",")","(","h",":","a","≤","' || (p_partkey % 90 + 10) || '",")",":","a","+","b","=","b","+","a"]') as statement_sha256 from part)"""


def _base(spark, d):
    """One base row per part; parts with equal statements share a group."""
    rows = _sources(spark, d).select(F.col("id").alias("item_id"), (F.col("id").cast("bigint") % 90).cast("string").alias("group_id"), "text")
    return identity.statement_identities(rows, ["item_id", "group_id"], "text")


@query("with " + STATEMENTS + " select cast(n as varchar) as item_id, group_id, name, statement_sha256, cast(null as varchar) as error from part_rows")
def statement_identity(spark, d):
    return _base(spark, d)


@query("with " + STATEMENTS + """, g as (select group_id, min(name) as name, min(statement_sha256) as s from part_rows group by 1)
select l.item_id, l.group_id, l.group_id as source_group, 'statement::' || g.s as unit_id, g.name, g.s as statement_sha256
from (select l_orderkey || '-' || l_linenumber || '-' || row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice) as item_id, cast(l_partkey % 90 as varchar) as group_id from lineitem) l join g on g.group_id = l.group_id""")
def identity_propagation(spark, d):
    """Each order line is a descendant of its part's group."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    lines = views.read(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", place).alias("item_id"), (F.col("l_partkey") % 90).cast("string").alias("group_id"))
    return identity.propagated(lines, _base(spark, d))


@query("with " + STATEMENTS + """ select (select count(*) from part_rows) as n_base, count(distinct group_id) as n_groups, count(distinct statement_sha256) as n_statements, count(distinct name) as n_names,
  (select count(*) from (select statement_sha256 from part_rows group by 1 having count(distinct name) > 1)) as n_aliased from part_rows""")
def identity_diagnostics(spark, d):
    return identity.diagnostics(_base(spark, d))


@query("with " + STATEMENTS + """, b as (select cast(n as varchar) as item_id, cast(n % 7 as varchar) as group_id, case when n % 10 = 0 then 'same' else name end as name, statement_sha256 from part_rows),
v as (select 'group_statements' as rule, group_id as key from b group by group_id having count(distinct statement_sha256) > 1
union all select 'name_statements', name from b group by name having count(distinct statement_sha256) > 1
union all select 'no_base', cast(o_orderkey as varchar) from orders where o_orderkey % 9 > 6)
select rule, count(*) as n from v group by rule""")
def identity_violations(spark, d):
    base = _base(spark, d).withColumn("group_id", (F.col("item_id").cast("bigint") % 7).cast("string")).withColumn("name", F.when(F.col("item_id").cast("bigint") % 10 == 0, "same").otherwise(F.col("name")))
    rows = views.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("item_id"), (F.col("o_orderkey") % 9).cast("string").alias("group_id"))
    return identity.violations(rows, base).groupBy("rule").agg(F.count("*").alias("n"))


def _examples(spark, d):
    c = views.conversations(spark, d)
    n = F.col("conv_id")
    valid = F.when(n % 7 != 0, F.col("first_error") == -1)
    meta = F.create_map(F.lit("z"), n.cast("string"), F.lit("proof_path"), F.lit("/local"), F.lit("theorem_name"), F.concat(F.lit("t"), n.cast("string")))
    labels = F.transform("steps", lambda _s, i: F.when(i < F.col("first_error"), F.lit(True)).when(i == F.col("first_error"), F.lit(False)))
    return c.select(n.cast("string").alias("item_id"), (n % 40).cast("string").alias("group_id"), F.concat(F.lit("conv::group::"), (n % 40).cast("string")).alias("unit_id"), F.lit("conv").alias("dataset"), F.get("steps", F.lit(0)).alias("prompt"), "steps", labels.alias("step_labels"), valid.alias("valid"), F.lit("upstream").alias("source_hash"), meta.alias("metadata"))


def _edge(share: float) -> str:
    return format(int(share * (1 << 53)) << 203, "064x")


SPLITS = ", ".join(f"case when sha256('split' || chr(0) || '{s}' || chr(0) || unit) < '{_edge(0.6)}' then 'train' when sha256('split' || chr(0) || '{s}' || chr(0) || unit) < '{_edge(0.6 + 0.2)}' then 'calibration' else 'test' end as split_s{s}" for s in (17, 42, 97))
NONE = ", ".join(f"cast(null as varchar) as {c}" for c in ("statement_sha256", "parent_item_id", "parent_variant_id", "pair_id", "pair_side", "positive_item_id", "negative_item_id", "positive_semantic_variant_id", "negative_semantic_variant_id"))
FALSE = ", ".join(f"false as {c}" for c in ("mechanically_verified", "syntactic_contract_verified", "compiler_outcomes_match", "paired_validity_approved", "cavis_eligible"))
BASE = ", ".join(f"'base' as {c}" for c in ("transformation_id", "transform_family", "transform_name", "transform_kind"))


@query("with " + views.CONV + f""", e as (select cast(conv_id as varchar) as item_id, cast(conv_id % 40 as varchar) as g, 'conv::group::' || (conv_id % 40) as unit, array_to_string(steps, chr(10)) as reasoning, steps, first_error, n_steps, conv_id from conv where conv_id % 7 <> 0)
select item_id, g as group_id, g as source_group_id, unit as dependence_id, 't' || conv_id as theorem_name, 'conv' as dataset, steps[1] as prompt, reasoning, cast(first_error = -1 as integer) as label, {BASE}, {NONE}, {FALSE},
  '{{}}' as transform_parameters_json, item_id as semantic_variant_id, '[]' as pair_ids_json, sha256(reasoning) as source_hash, sha256(reasoning) as target_hash, 'upstream' as upstream_source_hash, 'observed_label' as semantic_status, 'upstream_annotation' as evidence_state,
  '[' || array_to_string(list_transform(range(n_steps), lambda i: case when i < first_error then 'true' when i = first_error then 'false' else 'null' end), ',') || ']' as step_labels_json,
  '{{"dependence_id":"' || unit || '","source_group_id":"' || g || '","theorem_name":"t' || conv_id || '","z":"' || conv_id || '"}}' as metadata_json, {SPLITS}
from e where trim(reasoning) <> ''""")
def canonical_rows(spark, d):
    return prepare.canonical_rows(_examples(spark, d))


@query("with " + views.CONV + " select count(*) filter (conv_id % 7 <> 0) as labelled, count(*) filter (conv_id % 7 = 0) as unlabelled from conv")
def labelled_counts(spark, d):
    return prepare.labelled(_examples(spark, d), "valid")[1]


def _prepared(spark, d):
    t = views.tree(spark, d)
    kind = F.when(F.col("kind") == "root", "base").when(F.col("kind") == "counter", "g1").otherwise("g0")
    none = F.lit(None).cast("string")
    return t.select("item_id", F.col("unit_id").alias("group_id"), none.alias("source_group_id"), F.when(F.length("item_id") % 5 != 0, F.col("unit_id")).alias("dependence_id"), kind.alias("transform_kind"), F.concat(F.lit("root-"), "unit_id").alias("semantic_variant_id"),
        F.col("parent_id").alias("parent_variant_id"), F.col("unit_id").alias("pair_id"), F.lit("negative").alias("pair_side"), F.col("positive_id").alias("positive_semantic_variant_id"), F.concat(F.lit('["'), "unit_id", F.lit('"]')).alias("pair_ids_json"),
        F.when(F.col("eligible"), F.lit('{"k": "v"}')).alias("metadata_json"), F.col("eligible").alias("cavis_eligible"), F.lit(False).alias("mechanically_verified"))


PREPARED = "with " + views.TREE + ", p as (select *, case kind when 'root' then 'base' when 'counter' then 'g1' else 'g0' end as k from tree)"


@query(PREPARED + """ select item_id, item_id as semantic_variant_id, 'root-' || unit_id as semantic_root_id, unit_id as source_group_id, case when k = 'g0' then 'g0' else 'base' end as variant_kind, k as source_transform_kind,
  case when k = 'g0' then parent_id end as g0_parent_id, case when k = 'g1' then unit_id end as g1_pair_id, case when k = 'g1' then 'negative' end as g1_side, case when k = 'g1' then positive_id end as g1_positive_id, unit_id as pair_ids, case when eligible then 'v' end as extra from p""")
def normalised_metadata(spark, d):
    out, _ = prepare.normalised_metadata(_prepared(spark, d))
    return out.select("item_id", "semantic_variant_id", "semantic_root_id", "source_group_id", "variant_kind", "source_transform_kind", "g0_parent_id", "g1_pair_id", "g1_side", "g1_positive_id", F.array_join("pair_ids", ",").alias("pair_ids"), F.col("extra")["k"].alias("extra"))


@query(PREPARED + " select 'unit' as rule, count(*) as n from p where length(item_id) % 5 = 0 having count(*) > 0")
def metadata_rule_counts(spark, d):
    from gaugeframe.operators.rules import violations

    rows = _prepared(spark, d)
    return violations(rows, "item_id", prepare.normalised_metadata(rows)[1]).groupBy("rule").agg(F.count("*").alias("n"))


@query("select event_id, '{\"k\":\"' || (props::json->>'k') || '\"}' as canonical, sha256('[\"' || event_type || '\",\"' || user_id || '\"]') as list_hash from events")
def canonical_json(spark, d):
    e = views.read(spark, d, "events")
    return e.select("event_id", canonical.canonical_text(F.col("props")).alias("canonical"), canonical.list_hash(F.array("event_type", F.col("user_id").cast("string"))).alias("list_hash"))


@query("""select p_partkey, p_partkey || ':respace:s17:' || substr(sha256(p_name), 1, 16) as edit_id, sha256(p_partkey || chr(0) || 'base') || '.parquet' as artifact,
  case when p_partkey % 80 - 40 between -32 and -1 then p_partkey % 80 - 40 + 32 when p_partkey % 80 - 40 between 0 and 31 then p_partkey % 80 - 40 end as layer, right(p_name, 5) as tail from part""")
def content_ids(spark, d):
    p = views.read(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    return p.select("p_partkey", canonical.edit_id(key, F.lit("respace"), 17, F.col("p_name")).alias("edit_id"), canonical.artifact_name(key, F.lit("base")).alias("artifact"), canonical.layer_index(F.col("p_partkey") % 80 - 40, F.lit(32)).alias("layer"), filters.tail(F.col("p_name"), 5).alias("tail"))


@query("with " + views.TREE + " select kind, count(*) as n, count(*) filter (kind = 'counter') as n_counter_roots, count(*) filter (kind <> 'variant' and (kind <> 'counter' or eligible)) as n_fit from tree group by kind")
def row_masks(spark, d):
    t = views.tree(spark, d)
    kind = F.col("kind")
    mask, _ = filters.fit_mask(kind, F.lit(None).cast("string"), F.col("eligible"))
    return t.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(filters.is_counter_root(kind, kind)).alias("n_counter_roots"), F.count_if(mask).alias("n_fit"))


@query("with " + views.TREE + " select count(*) filter (kind = 'root' or eligible) as retained, count(*) filter (kind <> 'root' and not eligible) as dropped from tree")
def defensible_counts(spark, d):
    return filters.defensible(views.tree(spark, d))[1]


@query("select l_linenumber as source, count(*) as n_rows, count(*) filter (l_orderkey in (select o_orderkey from orders where o_orderkey % 10 < 3)) as n_dropped from lineitem group by 1")
def exclusion_counts(spark, d):
    """Dropped rows per source when the units of an exclusion list go."""
    lines = views.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("source"))
    out = views.read(spark, d, "orders").filter("o_orderkey % 10 < 3").select(F.col("o_orderkey").alias("unit_id"))
    return filters.exclude_units(lines, out, "unit_id", "source")[1]


@query("select n_nationkey as k, 'left' as side from nation where n_nationkey not in (select r_regionkey from region) union all select r_regionkey, 'right' from region where r_regionkey not in (select n_nationkey from nation)")
def set_differences(spark, d):
    return filters.set_difference(views.read(spark, d, "nation").select(F.col("n_nationkey").alias("k")), views.read(spark, d, "region").select(F.col("r_regionkey").alias("k")), "k")


@query("select distinct o_orderkey as unit_id from orders where o_orderkey % 5 = 0 union select distinct l_orderkey from lineitem where l_linenumber = 7")
def pooled_units(spark, d):
    return filters.pooled("unit_id", views.read(spark, d, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("unit_id")), views.read(spark, d, "lineitem").filter("l_linenumber = 7").select(F.col("l_orderkey").alias("unit_id")))


@query("with " + views.EVIDENCE + " select distinct pair_id from ledger where b % 3 = 0 and pair_id not in (select pair_id from erows where pair_id is not null and substr(target_hash, 1, 1) < '8')".replace("from ledger where", "from (select l.*, n.b from ledger l join numbered n on n.pair_id = l.pair_id and n.kind = 'counter') where"))
def unknown_ledger_keys(spark, d):
    """Reviewed pairs that a part of the input does not hold."""
    rows, _, ledger = views.evidence_rows(spark, d)
    number = F.conv(F.substring("negative_hash", 7, 6), 16, 10).cast("bigint")
    return filters.missing(ledger.filter(number % 3 == 0), rows.filter("pair_id is not null and substr(target_hash, 1, 1) < '8'"), "pair_id")


@query("with " + views.TREE + """, e as (select item_id as negative_id, positive_id, pair_id from tree where kind = 'counter'), m as (select pair_id, negative_id as item_id from e union select pair_id, positive_id from e)
select item_id, array_to_string(list(pair_id order by pair_id), ',') as pair_ids from m where item_id is not null group by item_id""")
def pair_membership(spark, d):
    from gaugeframe.operators import pairs

    return filters.pair_membership(pairs.resolve(views.tree(spark, d))).select("item_id", F.array_join("pair_ids", ",").alias("pair_ids"))


@query("with " + views.EVIDENCE + """, hit as (select distinct r.unit_id from erows r join evidence e on e.target_hash = r.target_hash where e.returncode is null), seen as (select distinct target_hash from evidence where returncode is not null and substr(target_hash, 1, 1) < '8')
select target_hash, min(item_id) as item_id, count(*) as n_rows from erows where unit_id not in (select unit_id from hit) and target_hash not in (select target_hash from seen) group by target_hash""")
def before_checking(spark, d):
    rows, evidence, _ = views.evidence_rows(spark, d)
    return filters.before_checking(rows, evidence.filter("returncode is null or substr(target_hash, 1, 1) < '8'"))


def _named(spark, d):
    return views.tree(spark, d).withColumn("edit", F.concat(F.lit("e"), F.right("item_id", F.lit(1))))


@query("with " + views.TREE + """, t as (select *, 'e' || right(item_id, 1) as edit from tree),
kept as (select * from t where kind = 'root' or kind = 'counter'),
v as (select t.*, row_number() over (partition by t.parent_id order by sha256('ablation-variant' || chr(0) || '17' || chr(0) || t.item_id), t.item_id) as r from t join kept k on k.item_id = t.parent_id where t.kind = 'variant' and t.edit <> 'e3')
select item_id from kept union all select item_id from v where r <= 1""")
def subtree_filter(spark, d):
    return filters.subtree(_named(spark, d), 17, drop_variants=("e3",), per_root=1, per_positive=1).select("item_id")


@query("with " + views.TREE + " select item_id from tree where kind = 'root' or (kind = 'variant' and right(parent_id, 1) <> '5')")
def dropped_family(spark, d):
    """Without a family of counters, their variants go too."""
    return filters.subtree(_named(spark, d), 17, drop_counters=("e5",)).select("item_id")


@query("with " + views.LONG + """, v as (select candidate, 'all' as condition, 's' as setting, case when label = 1 then 'frozen_result_from_local_inference' else 'not_applicable' end as status, 'm' as metric, cast(quantity as double) as value from (select l.*, f.quantity from long l join flat f on f.item_id = l.item_id))
select candidate, condition, setting, metric, 'frozen_result_from_local_inference' as status, round(avg(value), 6) as value, round(stddev_samp(value), 6) as std, min(value) as min, max(value) as max, count(value) as n from v where status = 'frozen_result_from_local_inference' group by 1, 2, 3, 4
union all select candidate, condition, setting, metric, status, value, null, null, null, null from v where status <> 'frozen_result_from_local_inference'""")
def ablation_summary(spark, d):
    flat = views.flat_scores(spark, d).select("item_id", "quantity")
    rows = views.candidates(spark, d).join(flat, "item_id")
    status = F.when(F.col("label") == 1, sweep.FROZEN).otherwise(sweep.NOT_APPLICABLE)
    long = rows.select("candidate", F.lit("all").alias("condition"), F.lit("s").alias("setting"), status.alias("status"), F.lit("m").alias("metric"), F.col("quantity").cast("double").alias("value"), F.lit(None).cast("string").alias("reason"))
    return sweep.ablation_summary(long, ["candidate"]).drop("reason")


@query()
def full_data_oracle(spark, d):
    rows = views.tree(spark, d)
    both = rows.withColumn("candidate", F.lit("score")).unionByName(rows.withColumn("score", F.round("score", 0)).withColumn("candidate", F.lit("rounded")))
    return sweep.full_data_oracle(both, [], "candidate")


@query()
def sweep_evaluation(spark, d):
    """The protocol for two candidates and two seeds, with an exclusion list, summarised over seeds."""
    rows = views.tree(spark, d)
    both = rows.withColumn("candidate", F.lit("score")).unionByName(rows.withColumn("score", -F.col("score")).withColumn("candidate", F.lit("negated")))
    gone = rows.filter(F.right("unit_id", F.lit(2)) == "00").select("unit_id")
    return sweep.evaluate(both, ["candidate"], (17, 42), excluded=gone, source="candidate")["summary"]


@query()
def ablation_conditions(spark, d):
    """Calibration sizes, one of them larger than the pool."""
    rows = views.tree(spark, d)
    made = [sweep.ablation(rows, [], "calibration_size", str(n), 17, size=n) for n in (5, 10**9)]
    return made[0].unionByName(made[1])
