"""Views of the driver tables that play the roles of score files, variant trees and ledgers.

Each has the same definition in SQL (a list of common table expressions) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: unit, item, label and four candidate scores."""
    # R is the largest flag: the largest of 0 and 1 aggregates by hash, a string would be sorted
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"), F.max("l_extendedprice").alias("price"), F.max("l_discount").alias("discount"), F.max("l_tax").alias("tax"), F.max("l_quantity").alias("quantity"))
    unit = F.col("l_orderkey").cast("string")
    return lines.select(unit.alias("unit_id"), F.concat_ws("-", unit, F.col("l_linenumber").cast("string")).alias("item_id"), "label", "price", "discount", "tax", "quantity")


FLAT = """flat as (
  select cast(l_orderkey as varchar) as unit_id, cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as item_id,
    cast(max(l_returnflag) = 'R' as integer) as label, max(l_extendedprice) as price, max(l_discount) as discount, max(l_tax) as tax, max(l_quantity) as quantity
  from lineitem group by l_orderkey, l_linenumber)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat scores in long form: one row per item and candidate."""
    return flat_scores(spark, sf_dir).unpivot(["unit_id", "item_id", "label"], ["price", "discount", "tax", "quantity"], "candidate", "score")


LONG = FLAT + """,
long as (
  select unit_id, item_id, label, unnest(['price', 'discount', 'tax', 'quantity']) as candidate, unnest([price, discount, tax, quantity]) as score from flat)"""


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return docs.join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").withColumn("unit_id", F.col("doc_id").cast("string"))


DOCS = """docscores as (
  select d.doc_id, cast(d.doc_id as varchar) as unit_id, d.lang, cast(d.n_chars as double) as score, l.quality as label
  from documents d join labels l on d.doc_id = l.doc_id)"""


def raw_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots, variants and counters from order lines, orphans included."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("own"), F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("score"))
    unit = Window.partitionBy("l_orderkey")
    n = F.col("l_linenumber")
    lines = lines.withColumn("root_label", F.max(F.when(n == 1, F.col("own"))).over(unit)).withColumn("has_counter", F.max((n == 5).cast("int")).over(unit) == 1)
    name = lambda k: F.concat_ws("-", F.col("l_orderkey").cast("string"), F.lit(k))
    kind = F.when(n == 1, "root").when(n == 5, "counter").otherwise("variant")
    return lines.select(
        F.col("l_orderkey").cast("string").alias("unit_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), n.cast("string")).alias("item_id"), kind.alias("kind"),
        F.when(n <= 4, F.col("root_label")).otherwise(0).alias("label"), "score",
        F.when(n.isin(2, 3, 4), name("1")).when(n.isin(6, 7), name("5")).alias("parent_id"), F.when(n == 5, name("1")).alias("positive_id"),
        F.when(n == 5, name("5")).alias("pair_id"), ((n == 1) | (F.col("l_orderkey") % 10 != n)).alias("eligible"),
        F.col("root_label").isNotNull().alias("has_root"), (F.col("has_counter") & (F.coalesce(F.col("root_label"), F.lit(0)) == 1)).alias("counter_ok"), n.alias("line"),
    )


RAW_TREE = """lines as (
  select l_orderkey as k, l_linenumber as n, cast(max(l_returnflag) = 'R' as integer) as own, max(l_extendedprice / l_quantity) as score from lineitem group by 1, 2),
noted as (select *, max(case when n = 1 then own end) over (partition by k) as root_label, max(cast(n = 5 as integer)) over (partition by k) = 1 as has_counter from lines),
raw_tree as (
  select cast(k as varchar) as unit_id, k || '-' || n as item_id, case when n = 1 then 'root' when n = 5 then 'counter' else 'variant' end as kind,
    case when n <= 4 then root_label else 0 end as label, score,
    case when n in (2, 3, 4) then k || '-1' when n in (6, 7) then k || '-5' end as parent_id,
    case when n = 5 then k || '-1' end as positive_id, case when n = 5 then k || '-5' end as pair_id,
    n = 1 or k % 10 <> n as eligible, root_label is not null as has_root, has_counter and coalesce(root_label, 0) = 1 as counter_ok, n as line
  from noted)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree without orphans: lines 1 to 4 need line 1, lines 5 to 7 a counter of a valid root."""
    ok = F.when(F.col("line") <= 4, F.col("has_root")).otherwise(F.col("counter_ok"))
    return raw_tree(spark, sf_dir).filter(ok).drop("has_root", "counter_ok", "line")


TREE = RAW_TREE + """,
tree as (select unit_id, item_id, kind, label, score, parent_id, positive_id, pair_id, eligible from raw_tree where case when line <= 4 then has_root else counter_ok end)"""

SPLIT = """ranked_units as (
  select unit_id, row_number() over (order by sha256('unit-split' || chr(0) || '17' || chr(0) || unit_id), unit_id) as r, count(*) over () as n
  from (select distinct unit_id from {rows})),
seats as (select *, n * 3 // 5 + cast(n % 5 in (1, 3) as integer) as a, n // 5 + cast(n % 5 in (2, 3, 4) as integer) as b from ranked_units),
split as (select unit_id, case when r <= a then 'train' when r <= a + b then 'calibration' else 'test' end as split from seats)"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as ordered steps with a first-error label from the id."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: x["text"]).alias("steps"), (F.col("conv_id") % (F.size("t") + 1) - 1).cast("int").alias("first_error"), F.size("t").alias("n_steps"))


CONV = """conv as (
  select conv_id, list(text order by turn, text) as steps, cast(conv_id % (count(*) + 1) - 1 as integer) as first_error, cast(count(*) as integer) as n_steps
  from conversations group by conv_id)"""


def evidence_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, evidence, ledger): the tree with content hashes, synthetic return codes by hash (null
    for one in twenty: timed out), and reviews of all but one in seven pairs."""
    rows = tree(spark, sf_dir)
    h = F.sha2(F.col("item_id").cast("binary"), 256)
    rows = rows.select("item_id", "unit_id", F.when(F.col("kind") == "root", "base").otherwise(F.col("kind")).alias("kind"), "label", F.when(F.col("kind") == "variant", F.col("parent_id")).otherwise(F.col("positive_id")).alias("parent_id"),
        F.when(F.col("kind") == "variant", F.when(F.col("parent_id").endswith("-5"), F.col("parent_id"))).otherwise(F.col("pair_id")).alias("pair_id"),
        F.when((F.col("kind") == "counter") | F.coalesce(F.col("parent_id").endswith("-5"), F.lit(False)), "negative").otherwise("positive").alias("side"), h.alias("target_hash"), (F.length("item_id") % 9 != 0).alias("contract_ok"), F.lit(True).alias("statement_changed"))
    number = F.conv(F.substring("target_hash", 1, 6), 16, 10).cast("bigint")
    evidence = rows.select("target_hash", F.when(number % 20 == 0, F.lit(None)).when(F.col("side") == "negative", F.when(number % 10 == 1, 0).otherwise(1)).otherwise(F.when(number % 10 == 1, 1).otherwise(0)).cast("int").alias("returncode"))
    pair = rows.filter("kind = 'counter'").join(rows.select(F.col("item_id").alias("parent_id"), F.col("target_hash").alias("p")), "parent_id")
    pair_no = F.conv(F.substring("target_hash", 7, 6), 16, 10).cast("bigint")
    ledger = pair.filter(pair_no % 7 != 0).select("pair_id", F.when(pair_no % 5 == 0, "reject").otherwise("approve").alias("decision"), F.lit("pair-validity").alias("policy"), F.col("p").alias("positive_hash"), F.col("target_hash").alias("negative_hash"), F.lit(True).alias("reviewed"), F.when(pair_no % 11 == 0, " ").otherwise("reviewer").alias("validator"), F.lit("seen").alias("notes"))
    return rows, evidence, ledger


EVIDENCE = TREE + """,
erows as (
  select item_id, unit_id, case when kind = 'root' then 'base' else kind end as kind, label, case when kind = 'variant' then parent_id else positive_id end as parent_id,
    case when kind = 'variant' then case when parent_id like '%-5' then parent_id end else pair_id end as pair_id,
    case when kind = 'counter' or coalesce(parent_id like '%-5', false) then 'negative' else 'positive' end as side, sha256(item_id) as target_hash, length(item_id) % 9 <> 0 as contract_ok
  from tree),
numbered as (select *, cast('0x' || substr(target_hash, 1, 6) as bigint) as a, cast('0x' || substr(target_hash, 7, 6) as bigint) as b from erows),
evidence as (select target_hash, case when a % 20 = 0 then null when side = 'negative' then case when a % 10 = 1 then 0 else 1 end else case when a % 10 = 1 then 1 else 0 end end as returncode from numbered),
ledger as (select pair_id, case when b % 5 = 0 then 'reject' else 'approve' end as decision, case when b % 11 = 0 then ' ' else 'reviewer' end as validator from numbered where kind = 'counter' and b % 7 <> 0),
joined as (
  select r.*, o.returncode as own_code, p.returncode as parent_code,
    case when r.kind = 'counter' then l.pair_id is not null and l.decision = 'approve' and trim(l.validator) <> '' end as review_ok
  from erows r left join evidence o on o.target_hash = r.target_hash left join erows pr on pr.item_id = r.parent_id left join evidence p on p.target_hash = pr.target_hash
  left join ledger l on l.pair_id = r.pair_id),
approvals as (select pair_id, bool_and(review_ok) as pair_approved from joined where kind = 'counter' group by 1),
decided0 as (select j.*, coalesce(a.pair_approved, false) as pair_approved from joined j left join approvals a on a.pair_id = j.pair_id),
decided as (
  select *, case
    when kind = 'counter' then concat_ws(';', case when not coalesce(parent_code = 0, false) then 'parent_not_accepted' end, case when not coalesce(own_code <> 0, false) then 'not_rejected' end, case when not review_ok then 'review' end)
    when kind = 'base' then concat_ws(';', case when not coalesce(label = 1, false) then 'label' end, case when not coalesce(own_code = 0, false) then 'not_accepted' end)
    when side = 'positive' then concat_ws(';', case when not contract_ok then 'contract' end, case when not coalesce(parent_code = 0, false) then 'parent_not_accepted' end, case when not coalesce(own_code = 0, false) then 'not_accepted' end)
    else concat_ws(';', case when not contract_ok then 'contract' end, case when not coalesce(parent_code <> 0, false) then 'parent_not_rejected' end, case when not coalesce(own_code <> 0, false) then 'not_rejected' end, case when not pair_approved then 'pair_not_approved' end)
    end as reason
  from decided0)"""
