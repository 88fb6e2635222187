"""Edits, generated candidates, fitted models, spectral kernels and live decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import lexer
from gaugeframe.operators import crossfit, generate, models, spectral
from gaugeframe.operators.splits import exact_split
from gaugeframe.plans import views
from gaugeframe.plans.registry import query
from gaugeframe.streaming import live


def _sources(spark, d):
    """Small proof sources, one per part."""
    p = views.read(spark, d, "part").select("p_partkey")
    n = F.col("p_partkey")
    text = F.concat(F.lit("theorem t"), n.cast("string"), F.lit(" (a b : ℕ) (h : a ≤ "), (n % 90 + 10).cast("string"), F.lit(") : a + b = b + a := by\n  -- swap\n  simp [h]\n  exact add_comm a b /- done /- twice -/ -/\n"))
    return p.select(n.cast("string").alias("id"), text.alias("text"), (n % 2 == 0).alias("ok"))


@query()
def generated_candidates(spark, d):
    return generate.candidates(_sources(spark, d), "id", "text", "ok", contents=False).drop("text")


@query("""with n as (select count(*) filter (p_partkey % 2 = 0) as even, count(*) filter (p_partkey % 2 = 1) as odd from part)
select unnest(['root', 'counter', 'variant']) as kind, unnest([even + odd, 5 * even, 4 * (even + odd) + 20 * even])::bigint as n, true as contracts_hold from n""")
def candidate_counts(spark, d):
    rows = generate.candidates(_sources(spark, d), "id", "text", "ok", contents=False)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("contract_ok", F.lit(True)) & ~F.col("skipped")).alias("contracts_hold"))


TOKENS = "['theorem', 't' || p_partkey, '(', 'a', 'b', ':', 'ℕ', ')', '(', 'h', ':', 'a', '≤', cast(p_partkey % 90 + 10 as varchar), ')', ':', 'a', '+', 'b', '=', 'b', '+', 'a', ':', '=', 'by', 'simp', '[', 'h', ']', 'exact', 'add_comm', 'a', 'b']"


@query(f"select cast(p_partkey as varchar) as id, {TOKENS} as tokens, 't' || p_partkey as declared from part")
def lexer_tokens(spark, d):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lexer.tokens(t) for t in texts], pa.list_(pa.string())), pa.array([lexer.declaration(t)[0] for t in texts], pa.string())], names=["id", "tokens", "declared"])

    return _sources(spark, d).select("id", "text").mapInArrow(run, "id string, tokens array<string>, declared string")


@query()
def platt(spark, d):
    rows = views.document_scores(spark, d)
    fitted = models.fit_platt(rows, "score", "label")
    return rows.select("unit_id", models.platt(F.col("score"), fitted).alias("probability"))


@query()
def residual(spark, d):
    """Fitted on the rows of train units alone."""
    rows = views.flat_scores(spark, d)
    train = rows.join(exact_split(rows, "unit_id", 17).filter("split = 'train'"), "unit_id")
    return models.residualise(rows, train, "price", ["quantity", "discount"]).select("item_id", "residual")


@query()
def probe(spark, d):
    rows = views.read(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("y"), (F.col("vec_id") % 50).cast("string").alias("unit_id"))
    return models.linear_probe(rows, "embedding", "y", "unit_id", models.hash_folds(F.col("unit_id"), 5, 3) > 1, grid=(0.1, 1.0)).select("vec_id", "logit", "c")


@query()
def spectral_scores(spark, d):
    """A ring graph per embedding, with the vector as signal."""
    e = views.read(spark, d, "embeddings").select("vec_id", "embedding", F.transform("embedding", lambda x: F.array(x.cast("double"))).alias("x"))
    near = lambda i, j: F.when((F.abs(i - j) == 1) | (F.abs(i - j) == F.size("embedding") - 1), 1.0).otherwise(0.0)
    ring = F.transform("embedding", lambda _x, i: F.transform("embedding", lambda _y, j: near(i, j)))
    return spectral.spectral_scores(e.withColumn("g", ring), "vec_id", "g", "x")


@query("""with s as (select conv_id, list(-(length(text)) / 100.0::double order by turn, text) as lp from conversations group by 1)
select conv_id, round(list_sum(lp) / len(lp), 6) as mean_ll, round(exp(-list_sum(lp) / len(lp)), 6) as perplexity from s where list_sum(lp) / len(lp) > -20""")
def token_statistics(spark, d):
    c = views.conversations(spark, d).withColumn("lp", F.transform("steps", lambda s: -F.length(s) / F.lit(100.0)))
    stats = spectral.token_statistics(F.col("lp"), F.col("lp"))
    return c.select("conv_id", stats["mean_ll"].alias("mean_ll"), stats["perplexity"].alias("perplexity")).filter("mean_ll > -20")


@query("""select event_id, case when value - 10 > 50 then 'valid' when value + 10 < 50 then 'invalid' else 'abstain' end as decision from events""")
def live_decisions(spark, d):
    state = spark.createDataFrame([(1, 50.0, 10.0)], "orientation int, threshold double, q double")
    return live.decide(views.read(spark, d, "events"), state).select("event_id", "decision")


@query()
def cross_fitted(spark, d):
    """Out-of-fold predictions of five methods, on document sizes and hashes."""
    rows = views.document_scores(spark, d).select("doc_id", F.col("label"), F.col("score").alias("size"), (F.pmod(F.xxhash64("doc_id"), F.lit(1000)) / 1000.0).alias("signal"), (F.col("doc_id") % 97).cast("double").alias("level"))
    return crossfit.predictions(rows, "doc_id", "label", "size", "signal", "level", seeds=(17,), folds=5)[0]


@query("""with s as (select doc_id, label from (select d.doc_id, l.quality as label from documents d join labels l on d.doc_id = l.doc_id) where label is not null),
n as (select label, count(*) as n from s group by 1)
select seed, fold, label, count(*) as n from (
  select seed, label, cast((row_number() over (partition by seed, label order by sha256('fold' || chr(0) || seed || chr(0) || doc_id), doc_id) - 1) % 5 as integer) as fold from s, (select unnest([17, 42]) as seed)) group by all""")
def fold_counts(spark, d):
    """Stratified folds: each label's rows dealt in hash order."""
    rows = views.document_scores(spark, d)
    return crossfit.stratified_folds(rows, "doc_id", "label", (17, 42), 5).groupBy("seed", "fold", "label").agg(F.count("*").alias("n"))
