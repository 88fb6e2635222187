"""Score files with their bindings, extractions, review ledgers, exclusion lists and result sinks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.canonical import canonical_hash, list_hash
from gaugeframe.functions.scalars import finite, text_label
from gaugeframe.operators.rules import duplicates, require, violations
from gaugeframe.sources import artifacts, readers

EXTRACTION = "file string, label_original string, label_corrected string, proof_text_length double, proof_token_count double, token_baselines struct<mean_logprob:double,perplexity:double,mean_entropy:double,max_entropy:double>, spectral map<string,struct<hfer:double,fiedler:double,smoothness:double,entropy:double>>"
LEDGER = "pair_id string, decision string, policy string, positive_hash string, negative_hash string, reviewed_statement_change boolean, validator string, notes string"


def extraction(spark: SparkSession, path: str, layer: str = "layer_30", expected_sha256: str | None = None) -> DataFrame:
    """The flat table of an extraction: one layer's spectral measures with lengths and token measures.
    A different file hash, missing fields, non-finite numbers and repeated items are refused."""
    if expected_sha256 is not None:
        require(readers.file_digests(spark, path).filter(F.col("sha256") != expected_sha256), "file hash")
    raw = readers.read(spark, path, EXTRACTION)
    part, token = F.col("spectral")[layer], F.col("token_baselines")
    out = raw.select(
        F.col("file").alias("item_id"), text_label(F.col("label_original")).alias("label_original"), text_label(F.col("label_corrected")).alias("label_corrected"), "proof_text_length", "proof_token_count",
        *[token[c].alias(c) for c in ("mean_logprob", "perplexity", "mean_entropy", "max_entropy")], *[part[c].alias(n) for c, n in (("hfer", "hfer"), ("fiedler", "fiedler"), ("smoothness", "smoothness"), ("entropy", "spectral_entropy"))],
    )
    numbers = [c for c, kind in out.dtypes if kind == "double"]
    rules = {f"not_finite_{c}": ~finite(F.col(c)) for c in numbers} | {f"no_{c}": F.col(c).isNull() for c in ("item_id", "label_original", "label_corrected")}
    require(violations(out, "item_id", rules), "extraction")
    require(duplicates(out, "item_id"), "repeated item")
    return out


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Review rows, one per non-blank pair id."""
    rows = readers.read(spark, path, LEDGER)
    require(rows.filter("pair_id is null or trim(pair_id) = ''"), "blank pair id")
    require(duplicates(rows, "pair_id"), "repeated pair id")
    return rows


def exclusions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct unit_id over files with a list selected_dependence_ids; empty lists and repeats within
    a file are refused, and so is a file that changes while it is read."""
    before = {p: artifacts.sha256_file(p) for p in paths}
    raw = spark.read.option("multiLine", True).schema("selected_dependence_ids array<string>").json(paths).select(F.col("_metadata.file_path").alias("file"), F.col("selected_dependence_ids").alias("ids"))
    require(raw.filter("ids is null or size(ids) = 0 or size(ids) <> size(array_distinct(ids)) or exists(ids, x -> x is null or trim(x) = '')"), "exclusion list")
    units = raw.select(F.explode("ids").alias("unit_id")).distinct().persist()
    units.count()
    if {p: artifacts.sha256_file(p) for p in paths} != before:
        raise ValueError("an exclusion list changed while it was read")
    return units


def bind(score_path: str | Path, rows: int, expected: dict) -> dict:
    """The signature of a score file: its hash, its number of rows and what it was made from."""
    body = {"sha256": artifacts.sha256_file(score_path), "rows": rows, "expected": expected}
    return body | {"signature": canonical_hash(body)}


def bound_scores(spark: SparkSession, path: str, schema: str, binding: dict, expected: dict) -> DataFrame:
    """A score file that is read only if its signature holds: own hash of the signature, identity of
    dataset, model and precision, file hash and number of rows."""
    body = {k: v for k, v in binding.items() if k != "signature"}
    problems = []
    if canonical_hash(body) != binding.get("signature"):
        problems.append("signature")
    problems += [f"{k}: {body.get('expected', {}).get(k)!r} is not {v!r}" for k, v in expected.items() if body.get("expected", {}).get(k) != v]
    if artifacts.sha256_file(path) != body.get("sha256"):
        problems.append("file hash")
    if problems:
        raise ValueError(f"{path}: " + "; ".join(problems))
    rows = readers.read(spark, path, schema)
    if rows.count() != body["rows"]:
        raise ValueError(f"{path}: number of rows")
    return rows


def with_vectors(scores: DataFrame, vectors: DataFrame) -> DataFrame:
    """Score rows with the pooled vector of their artifact_hash; a missing one, and one whose content
    does not have that hash, are refused. vectors: (artifact_hash, vector array<double>)."""
    text = F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")
    require(vectors.filter(F.sha2(text.cast("binary"), 256) != F.col("artifact_hash")).select("artifact_hash"), "vector content")
    joined = scores.join(vectors, "artifact_hash", "left")
    require(joined.filter("artifact_hash is not null and vector is null").select("artifact_hash"), "missing vector")
    return joined


def chain_problems(reports: dict[str, dict]) -> list[str]:
    """Reports name each other by path and hash: every (path, sha256) that one names under ``inputs``
    must be that of the report given under that role, and overlaps must be zero."""
    out = []
    for role, report in sorted(reports.items()):
        for other, named in sorted((report.get("inputs") or {}).items()):
            have = reports.get(other)
            if have is None:
                out.append(f"{role}: {other} is not given")
                continue
            out += [f"{role}: {other}.{k} differs" for k in ("path", "sha256") if named.get(k) != have.get(k)]
        if report.get("overlap_count", 0) != 0:
            out.append(f"{role}: overlap")
    return out


def exclusion_report(rows: DataFrame, closure: DataFrame) -> dict:
    """Counts and list hashes of a closure (rows with unit_id, target_hash and excluded)."""
    side = lambda cond: closure.filter(cond).agg(F.count("*").alias("rows"), F.count_distinct("unit_id").alias("units"), list_hash(F.sort_array(F.collect_set("target_hash"))).alias("hashes")).first().asDict()
    return {"input": rows.agg(F.count("*").alias("rows")).first()["rows"], "retained": side("not excluded"), "excluded": side("excluded")}


def verify_exclusion_report(report: dict, rows: DataFrame, closure: DataFrame) -> None:
    """The recorded counts must add up and equal those of the data."""
    problems = [] if report["input"] == report["retained"]["rows"] + report["excluded"]["rows"] else ["retained and excluded do not add up"]
    now = exclusion_report(rows, closure)
    problems += [f"{k} differs" for k in ("input", "retained", "excluded") if report[k] != now[k]]
    if problems:
        raise ValueError("; ".join(problems))


def write_outputs(folder: str, metrics: dict, items: DataFrame, input_path: str, input_sha256: str) -> None:
    """metrics.json, and items as JSON lines and CSV with nested values as JSON."""
    artifacts.write_json(Path(folder) / "metrics.json", metrics | {"input": {"path": str(input_path), "sha256": input_sha256}}, 2)
    readers.write_jsonl(items, f"{folder}/items.jsonl")
    readers.write_csv(items, f"{folder}/items.csv")


def write_tables(folder: str, tables: dict[str, DataFrame]) -> None:
    """One CSV folder per table, columns in order of name."""
    for name, df in tables.items():
        readers.write_csv(df, f"{folder}/{name}.csv")


def write_vectors(vectors: DataFrame, path: str) -> DataFrame:
    """(item_id, vector) with the content hash that names each vector, as Parquet."""
    text = F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")
    named = vectors.withColumn("artifact_hash", F.sha2(text.cast("binary"), 256))
    readers.write_parquet(named, path)
    return named
