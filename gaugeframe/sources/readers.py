"""Readers with a suffix allow-list, atomic sinks, and adapters of labelled trace sets."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeframe.functions import scalars
from gaugeframe.operators.rules import duplicates, require, violations

#: Suffixes that can be read, and those refused because loading them runs code.
READABLE = {".json", ".jsonl", ".parquet", ".csv"}
UNSAFE = {".pkl", ".pickle", ".joblib", ".pt", ".pth", ".npy", ".npz"}


class UnsafePath(ValueError):
    pass


def checked_suffix(path: str, allowed: set[str] = READABLE) -> str:
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix in UNSAFE:
        raise UnsafePath(f"unsafe file type {suffix}: {path}")
    if suffix not in allowed:
        raise ValueError(f"expected one of {sorted(allowed)}: {path}")
    return suffix


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One reader for all formats; malformed JSON fails at once."""
    suffix = checked_suffix(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == ".parquet":
        return reader.parquet(path)
    if suffix == ".csv":
        return reader.option("header", True).csv(path)
    return reader.option("mode", "FAILFAST").option("multiLine", suffix == ".json").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): JSON lines without blank ones, and what is no JSON object, with its file and its
    line number there. Numbers come from places in the file's blocks, not from a global order."""
    checked_suffix(path, {".jsonl"})
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_m"))
    rows = text.filter(F.trim("value") != "")
    objects = F.try_parse_json("value")
    good = F.coalesce(F.schema_of_variant(objects).startswith("OBJECT"), F.lit(False))
    blocks = text.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    ahead = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_o", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    bad = rows.filter(~good).join(blocks, ["file", "_block"]).select("file", (F.col("_o") + F.col("_m") - F.col("_first") + 1).alias("line"), "value")
    return rows.filter(good).select(F.from_json("value", schema).alias("r")).select("r.*"), bad


def read_tree(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Score files of dataset/model/scores.jsonl in one distributed scan; the folders become columns."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(glob)
    path = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1).alias("dataset_dir"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("model_dir"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file; ``require_content`` refuses empty ones."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def require_content(spark: SparkSession, path: str) -> None:
    """Raises if a file is missing or empty (scans skip empty files, so the listing is asked)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at) or []
    empty = [str(x.getPath()) for x in found if x.getLen() == 0]
    if not len(found) or empty:
        raise ValueError(f"empty or missing: {empty or path}")


def write_parquet(df: DataFrame, path: str) -> None:
    """Fails if the target exists or there is no row; the commit protocol makes it all or nothing."""
    if df.isEmpty():
        raise ValueError("nothing to write")
    df.write.option("compression", "zstd").mode("errorifexists").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("errorifexists").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Sorted columns; nested values as JSON."""
    nested = {c for c, kind in df.dtypes if kind.startswith(("struct", "array", "map"))}
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in sorted(df.columns)]).write.mode("errorifexists").option("header", True).csv(path)


# adapters: (item_id, group_id, prompt, steps, step_labels, valid) ----------------------------------


def first_error_traces(raw: DataFrame) -> DataFrame:
    """id, problem, steps and the first wrong step (-1: none)."""
    labels = scalars.first_error_steps(F.col("label"), F.size("steps"))
    return raw.select(F.col("id").alias("item_id"), F.col("id").alias("group_id"), F.col("problem").alias("prompt"), "steps", labels.alias("step_labels"), (F.col("label") == -1).alias("valid"))


def step_supervision(raw: DataFrame) -> DataFrame:
    """Nested completions with ratings; only chosen or identical completions count."""
    labels = scalars.annotated_steps(F.col("question.pre_generated_steps"), F.col("label.steps"))
    group = F.substring(F.sha2(F.col("question.problem").cast("binary"), 256), 1, 20)
    out = raw.select(group.alias("group_id"), F.col("question.problem").alias("prompt"), F.col("question.pre_generated_steps").alias("steps"), labels.alias("step_labels"))
    return out.withColumn("item_id", F.concat_ws(":", "group_id", F.sha2(F.array_join("steps", "\n").cast("binary"), 256))).withColumn("valid", scalars.three_valued_valid(F.col("step_labels")))


def trace_violations(raw: DataFrame) -> DataFrame:
    """(rule, key) of first-error traces: repeated ids, no steps, first errors out of range."""
    c = F.col
    bad = violations(raw, "id", {"blank_id": c("id").isNull() | (F.trim("id") == ""), "no_steps": c("steps").isNull() | (F.size("steps") < 1), "label_range": c("label").isNull() | (c("label") < -1) | (c("label") >= F.size("steps"))})
    return bad.unionByName(duplicates(raw, "id").select(F.lit("repeated_id").alias("rule"), c("id").cast("string").alias("key")))


def completion_violations(raw: DataFrame) -> DataFrame:
    """(rule, key) of completions and labels of unequal length or missing."""
    unequal = F.coalesce(F.size("completions") != F.size("labels"), F.lit(True)) | F.col("completions").isNull() | F.col("labels").isNull()
    return violations(raw, "prompt", {"unequal": unequal, "blank_prompt": F.col("prompt").isNull() | (F.trim("prompt") == "")})


def completion_labels(raw: DataFrame) -> DataFrame:
    """prompt, completions and labels; rows of unequal length are refused, not dropped."""
    require(completion_violations(raw), "completions")
    item = F.sha2(F.concat_ws("\n", "prompt", F.array_join("completions", "\n")).cast("binary"), 256)
    return raw.select(item.alias("item_id"), F.sha2(F.col("prompt").cast("binary"), 256).alias("group_id"), "prompt", F.col("completions").alias("steps"), F.col("labels").alias("step_labels"), scalars.three_valued_valid(F.col("labels")).alias("valid"))


def proof_files(index: DataFrame, files: DataFrame) -> DataFrame:
    """Proofs joined to their files by name: the folder of the label first, then the other, then the
    root. index: (file, valid); files: (path, text). A file that is missing keeps a null text:
    ``missing_files`` lists them."""
    named = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), "text")
    joined = index.join(named, "file", "left")
    want = F.when(F.col("valid"), "valid").otherwise("invalid")
    order = F.when(F.col("folder") == want, 0).when(F.col("folder").isin("valid", "invalid"), 1).otherwise(2)
    best = joined.groupBy("file", "valid").agg(F.min_by(F.col("text"), order).alias("text"))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    stems = index.filter("valid").select(stem.alias("_stem")).distinct()
    base = F.regexp_extract(stem, r"^(.*)_\d+$", 1)
    return best.join(stems, (base == F.col("_stem")) & ~F.col("valid"), "left").select("file", "valid", "text", F.coalesce("_stem", stem).alias("group_id"))


def missing_files(proofs: DataFrame) -> DataFrame:
    """(rule, key) of index entries without a file."""
    return proofs.filter("text is null").select(F.lit("missing_file").alias("rule"), F.col("file").alias("key"))
