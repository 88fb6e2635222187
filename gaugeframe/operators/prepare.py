"""Preparation of examples: canonical base rows, their order, and the metadata a scorer keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.canonical import canonical_map, parse_object, parse_strings
from gaugeframe.functions.hashing import stable_hex, unit_interval_split

#: Metadata that never enters a prepared row, and the total order of prepared rows.
LOCAL_KEYS = ("spectral", "token_baselines", "proof_path")
ORDER = ("dataset", "group_id", "transform_kind", "transform_name", "item_id")
KINDS = ("base", "g0", "g1")


def split_columns(unit: Column, seeds: tuple[int, ...], namespace: str = "split") -> list[Column]:
    """One split_s<seed> column per seed, each by the unit's hash alone."""
    return [unit_interval_split(stable_hex(namespace, seed, unit)).alias(f"split_s{seed}") for seed in seeds]


def base_rows(examples: DataFrame, seeds: tuple[int, ...] = (17, 42, 97)) -> DataFrame:
    """The canonical row of each example: 37 columns and a split per seed.

    examples: item_id, group_id, unit_id, dataset, prompt, steps (array), step_labels (array of
    boolean), valid (boolean), source_hash, metadata (map of strings).
    """
    c, none = F.col, F.lit(None).cast("string")
    reasoning = F.array_join("steps", "\n")
    digest = F.sha2(reasoning.cast("binary"), 256)
    own = F.create_map(F.lit("source_group_id"), c("group_id"), F.lit("dependence_id"), c("unit_id"))
    dropped = (*LOCAL_KEYS, "source_group_id", "dependence_id")
    merged = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*dropped)), own)
    labels = F.concat(F.lit("["), F.array_join(F.transform("step_labels", lambda x: x.cast("string")), ",", "null"), F.lit("]"))
    text = {n: F.lit("base") for n in ("transformation_id", "transform_family", "transform_name", "transform_kind")}
    flags = ("mechanically_verified", "syntactic_contract_verified", "compiler_outcomes_match", "paired_validity_approved", "cavis_eligible")
    columns = {
        "item_id": c("item_id"), "group_id": c("group_id"), "source_group_id": c("group_id"), "dependence_id": c("unit_id"),
        "theorem_name": c("metadata")["theorem_name"], "statement_sha256": c("metadata")["statement_sha256"], "dataset": c("dataset"), "prompt": c("prompt"), "reasoning": reasoning,
        "label": c("valid").cast("int"), **text, "transform_parameters_json": F.lit("{}"), "parent_item_id": none, "parent_variant_id": none, "semantic_variant_id": c("item_id"),
        "pair_id": none, "pair_ids_json": F.lit("[]"), "pair_side": none, "positive_item_id": none, "negative_item_id": none, "positive_semantic_variant_id": none,
        "negative_semantic_variant_id": none, "source_hash": digest, "target_hash": digest, "upstream_source_hash": c("source_hash"), "semantic_status": F.lit("observed_label"),
        "evidence_state": F.lit("upstream_annotation"), **{f: F.lit(False) for f in flags}, "step_labels_json": labels, "metadata_json": canonical_map(merged),
    }
    return examples.select(*[v.alias(k) for k, v in columns.items()], *split_columns(c("unit_id"), seeds))


def canonical_rows(examples: DataFrame, seeds: tuple[int, ...] = (17, 42, 97)) -> DataFrame:
    """Base rows of labelled examples with text."""
    kept = examples.filter(F.col("valid").isNotNull() & (F.trim(F.array_join("steps", "\n")) != ""))
    return base_rows(kept, seeds)


def labelled(df: DataFrame, valid: str) -> tuple[DataFrame, DataFrame]:
    """(labelled rows, one row with their number and that of the others)."""
    return df.filter(F.col(valid).isNotNull()), df.agg(F.count(valid).alias("labelled"), F.count_if(F.col(valid).isNull()).alias("unlabelled"))


def in_order(df: DataFrame) -> DataFrame:
    """The total order in which prepared rows are written."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in ORDER])


def normalised_metadata(rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """(item_id and the metadata the protocol reads, rules): a g1 row is a root of kind base whose
    source kind is g1; pair fields stay on g1 rows alone; semantic_variant_id becomes the item's own
    id and the old one is kept as semantic_root_id. The rules are true where a row is refused."""
    c = F.col
    kind = F.coalesce("transform_kind", F.lit("base"))
    extra, bad = parse_object(c("metadata_json"))
    pairs, bad_pairs = parse_strings(c("pair_ids_json"))
    g1, g0 = kind == "g1", kind == "g0"
    group = F.coalesce("source_group_id", "group_id")
    blank = lambda x: x.isNull() | (F.trim(x) == "")
    rules = {"kind": ~kind.isin(*KINDS), "unit": blank(c("dependence_id")), "group": blank(group), "metadata": bad, "pair_ids": bad_pairs, "eligible": c("cavis_eligible").isNull(), "verified": c("mechanically_verified").isNull()}
    out = rows.select(
        "item_id", c("item_id").alias("semantic_variant_id"), F.coalesce("semantic_variant_id", "item_id").alias("semantic_root_id"), "group_id", group.alias("source_group_id"),
        "dependence_id", F.when(g0, "g0").otherwise("base").alias("variant_kind"), kind.alias("source_transform_kind"), F.when(g0, c("parent_variant_id")).alias("g0_parent_id"),
        F.when(g1, c("pair_id")).alias("g1_pair_id"), F.when(g1, c("pair_side")).alias("g1_side"), F.when(g1, c("positive_semantic_variant_id")).alias("g1_positive_id"),
        pairs.alias("pair_ids"), "mechanically_verified", "cavis_eligible", extra.alias("extra"),
    )
    return out, rules
