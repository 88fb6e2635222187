"""Evidence joins, closures, identities and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions.hashing import scoped_unit, sha256_text
from gaugeframe.operators import eligibility
from gaugeframe.plans import views
from gaugeframe.plans.registry import query


def _decided(spark, d):
    return eligibility.decide(*views.evidence_rows(spark, d))


@query("with " + views.EVIDENCE + " select item_id, kind, side, own_code, parent_code, pair_approved, reason = '' as eligible, reason = '' and (kind = 'base' or (kind = 'variant' and side = 'positive')) as verified from decided")
def evidence_join(spark, d):
    return _decided(spark, d).select("item_id", "kind", "side", "own_code", "parent_code", "pair_approved", "eligible", "verified")


@query("with " + views.EVIDENCE + " select kind, reason, count(*) as n from decided group by all")
def reason_strings(spark, d):
    return _decided(spark, d).groupBy("kind", "reason").agg(F.count("*").alias("n"))


@query("with " + views.EVIDENCE + " select kind, count(*) as n, count(*) filter (reason = '') as n_eligible, count(*) filter (reason = '' and (kind = 'base' or (kind = 'variant' and side = 'positive'))) as n_verified from decided group by kind")
def eligibility_rules(spark, d):
    return eligibility.kind_report(_decided(spark, d))


@query("with " + views.EVIDENCE + """, p as (select pair_id, count(*) filter (kind = 'variant' and reason = '' and side = 'positive') as positive, count(*) filter (kind = 'variant' and reason = '' and side = 'negative') as negative, bool_or(pair_approved) as approved from decided where pair_id is not null group by 1)
select *, approved and positive > 0 and negative > 0 as complete from p""")
def pair_structure(spark, d):
    return eligibility.pair_structure(_decided(spark, d))


CLOSURE = "with " + views.EVIDENCE + """, hit as (select distinct r.unit_id from erows r join evidence e on e.target_hash = r.target_hash where e.returncode is null),
closed as (select r.*, h.unit_id is not null as excluded from erows r left join hit h on h.unit_id = r.unit_id)"""


@query(CLOSURE + " select item_id, excluded from closed")
def timeout_closure(spark, d):
    rows, evidence, _ = views.evidence_rows(spark, d)
    return eligibility.timeout_closure(rows, evidence).select("item_id", "excluded")


@query(CLOSURE + " select excluded, count(*) as n_rows, count(distinct target_hash) as n_hashes, count(distinct unit_id) as n_units from closed group by excluded")
def closure_attrition(spark, d):
    rows, evidence, _ = views.evidence_rows(spark, d)
    return eligibility.attrition(eligibility.timeout_closure(rows, evidence))


@query("select event_id, case when event_id % 3 = 0 then cast(event_id % 60 as double) + 0.5 end as seconds from events")
def timeout_seconds(spark, d):
    e = views.read(spark, d, "events")
    tail = F.concat(F.lit("checker timed out after "), (F.col("event_id") % 60).cast("string"), F.lit(".5 seconds"))
    code = F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.lit(1)).cast("int")
    return e.select("event_id", eligibility.timeout_seconds(F.lit("error"), code, tail).alias("seconds"))


@query("""select case when s is null or t is null then 'error' when s <> 0 then 'unexpected' when t = 0 and e then 'accepted' when t <> 0 and not e then 'rejected' else 'unexpected' end as state, count(*) as n
from (select case when event_id % 7 = 0 then null else event_id % 2 end as s, event_id % 3 % 2 as t, event_id % 5 < 3 as e from events) group by all""")
def verification_states(spark, d):
    i = F.col("event_id")
    state = eligibility.verification_state(F.when(i % 7 != 0, i % 2), i % 3 % 2, i % 5 < 3)
    return views.read(spark, d, "events").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


IDENTITY = "with n as (select doc_id, sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))) as identity from documents)"


def _identity(spark, d):
    norm = F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\x0B\f\r]+", " "))
    return views.read(spark, d, "documents").select("doc_id", sha256_text(norm).alias("identity"))


@query(IDENTITY + " select doc_id, identity, min(doc_id) over (partition by identity) as first_id from n")
def text_identity(spark, d):
    """Each text's identity and its smallest id, by an aggregate and a join (no hot window)."""
    ids = _identity(spark, d)
    return ids.join(ids.groupBy("identity").agg(F.min("doc_id").alias("first_id")), "identity").select("doc_id", "identity", "first_id")


@query(IDENTITY + ", a as (select identity, count(*) as n from n group by 1) select count(*) as n_identities, sum(n)::bigint as n_texts, count(*) filter (n > 1) as n_aliased from a")
def alias_count(spark, d):
    per = _identity(spark, d).groupBy("identity").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_identities"), F.sum("n").alias("n_texts"), F.count_if(F.col("n") > 1).alias("n_aliased"))


@query("select doc_id, 'corpus::group::' || source as unit from documents where source is not null")
def scoped_units(spark, d):
    return views.read(spark, d, "documents").filter("source is not null").select("doc_id", scoped_unit(F.lit("corpus"), F.col("source")).alias("unit"))


@query("""with m as (select n_nationkey as k, n_name as rev from nation), c as (select n_nationkey + 2 as k, n_name as rev from nation)
select coalesce(m.k, c.k) as k, case when m.k is null then 'only_config' when c.k is null then 'only_manifest' else 'revision' end as problem from m full join c on m.k = c.k where m.k is null or c.k is null or m.rev <> c.rev""")
def manifest_mismatches(spark, d):
    """Full-outer comparison of a lock manifest with configs."""
    n = views.read(spark, d, "nation")
    m, c = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("rev")), n.select((F.col("n_nationkey") + 2).alias("k"), F.col("n_name").alias("rev2"))
    j = m.join(c, "k", "full_outer")
    problem = F.when(F.col("rev").isNull(), "only_config").when(F.col("rev2").isNull(), "only_manifest").when(F.col("rev") != F.col("rev2"), "revision")
    return j.select("k", problem.alias("problem")).filter("problem is not null")


@query("select r_name as dataset, n_name as model, p as precision, n_nationkey % 4 as device from region, nation, (select unnest(['full', 'half']) as p) where n_nationkey < 7")
def job_matrix(spark, d):
    """Datasets x models x precisions with a device each: small configuration tables only."""
    models = views.read(spark, d, "nation").filter("n_nationkey < 7").select(F.col("n_name").alias("model"), (F.col("n_nationkey") % 4).alias("device"))
    data = views.read(spark, d, "region").select(F.col("r_name").alias("dataset"))
    return data.crossJoin(F.broadcast(models)).select("dataset", "model", F.explode(F.array(F.lit("full"), F.lit("half"))).alias("precision"), "device")
