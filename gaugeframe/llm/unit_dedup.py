"""Substring dedup by line or paragraph hashing.

Texts are cut into units: lines, paragraphs (which end with a blank line), or lines cut further
after sentence ends, so that a passage inside a long line is a unit too. A unit is normalised (lower
case, runs of white space as one space, trimmed), its 128-bit digest is grouped globally, the
earliest occurrence by rank (document id, then place in the text) stays, and all others go; their
offsets in the original text are kept. Units of fewer than ``min_words`` words or ``min_chars``
characters when normalised are never removed.

A passage that starts or ends inside units is none of them. With ``passage``, runs of so many words
(lower case) that start elsewhere too, wherever they start and end, are found as well, by the
windows and sorting of suffix_dedup on the words' 24-bit codes; they are counted and their places
listed, while only units are removed.

Everything is DataFrame operations. Each text is cut and normalised once; the digests are written to
the shared folder. A digest's occurrences meet only as partial aggregates (their number, and the
earliest place among those that repeat); the way back is a lookup in which frequent digests go by
broadcast, so no task holds a hot digest's occurrences.

Defined cases: null and empty texts have no units and stay as they are; a null id ranks before all
others; rows repeated exactly (id and text) rank the same, so they keep the same units; a separator
goes with the unit before it, and if the last unit goes, so does the separator that is left at the
end; all columns of the input stay, but those named like results (n_units, n_removed, n_repeated,
removed_spans, kept_text; with ``passage`` also n_passage_words, passage_spans) give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm._spark import lookup, stored, table, text_digest
from gaugeframe.llm.suffix_dedup import passages

#: Where a unit ends (a zero-width pattern), and the separator that may be left at a text's end.
CUTS = {
    "line": (r"(?<=\n)", r"\n\z"),
    "paragraph": (r"(?<=\n\n)", r"\n\n\z"),
    "sentence": (r"(?<=\n)|(?<=[.!?][ \t])|(?<=[。！？])", r"[\n \t]\z"),
}
CHUNK = 64
MADE = ("n_units", "n_removed", "n_repeated", "removed_spans", "kept_text")
PASSAGES = ("n_passage_words", "passage_spans")
SPANS = "array<struct<start:bigint,end:bigint>>"


def normalised(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(unit), r"[ \t\n\x0B\f\r]{2,}|[\t\n\x0B\f\r]", " "))


def pieces(text: Column, unit: str) -> Column:
    return F.split(text, CUTS[unit][0])


def digest(value: Column) -> list[Column]:
    """A 128-bit digest as two columns, _d and _e."""
    return [F.xxhash64(value).alias("_d"), F.xxhash64(F.lit("second half"), value).alias("_e")]


def rebuilt(docs: DataFrame, gone: DataFrame, text: str, unit: str, words: DataFrame | None = None) -> DataFrame:
    """Documents (with _gf_id, _gf_text) without the pieces that ``gone`` (_id, _text, _pos,
    removed) lists.

    Adds n_units, n_removed, n_repeated (listed pieces, those that stay included), removed_spans
    (array of start and end in characters, with the separator that follows) and kept_text. The work
    is linear in a text's pieces: starts come from sums over chunks, membership from a byte mask.
    With ``words`` (_id, _text, spans), also n_passage_words and passage_spans (in words).
    """
    more = []
    if words is not None:
        gone = gone.withColumn("spans", F.lit(None).cast(SPANS)).unionByName(words, allowMissingColumns=True)
        more = [F.first("spans", True).alias("_gf_words")]
    per_doc = gone.groupBy("_id", "_text").agg(F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("_pos")))).alias("_gf_gone"), F.count_distinct("_pos").alias("_gf_listed"), *more)
    per_doc = per_doc.withColumnsRenamed({"_id": "_gf_i", "_text": "_gf_t"})
    same = F.col("_gf_id").eqNullSafe(F.col("_gf_i")) & (F.col("_gf_text") == F.col("_gf_t"))
    joined = docs.join(per_doc, same, "left").drop("_gf_i", "_gf_t")
    cut = F.when(F.length(text) > 0, pieces(F.col(text), unit))
    joined = joined.withColumn("_gf_gone", F.coalesce("_gf_gone", F.array().cast("array<int>"))).withColumn("_gf_parts", cut)
    some = F.size("_gf_gone") > 0
    joined = joined.withColumn("_gf_lens", F.when(some, F.transform("_gf_parts", lambda x: F.length(x).cast("bigint"))))
    zero = F.lit(0).cast("bigint")
    chunk = F.transform(F.sequence(F.lit(0), F.floor((F.size("_gf_lens") - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice("_gf_lens", c * CHUNK + 1, CHUNK), zero, lambda a, x: a + x))
    joined = joined.withColumn("_gf_sums", F.when(some, chunk))
    joined = joined.withColumn("_gf_base", F.when(some, F.aggregate("_gf_sums", F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))))

    def start(i: Column) -> Column:
        c = F.floor(i / CHUNK).cast("int")
        return F.get("_gf_base", c) + F.aggregate(F.slice("_gf_lens", c * CHUNK + 1, i - c * CHUNK), zero, lambda a, x: a + x)

    spans = F.transform(F.transform("_gf_gone", lambda i: F.struct(i.alias("i"), start(i).alias("start"))), lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.get("_gf_lens", s["i"])).alias("end")))
    gaps = F.transform("_gf_gone", lambda g, k: F.concat(F.repeat(F.lit("0"), g - F.when(k == 0, F.lit(0)).otherwise(F.get("_gf_gone", k - 1) + 1)), F.lit("1")))
    joined = joined.withColumn("_gf_mask", F.when(some, F.array_join(gaps, "").cast("binary")))
    stay = F.array_join(F.filter("_gf_parts", lambda x, i: F.coalesce(F.substring("_gf_mask", i + 1, F.lit(1)) != F.lit(b"1"), F.lit(True))), "")
    last = F.element_at("_gf_gone", -1) == F.size("_gf_parts") - 1
    kept = F.when(last, F.regexp_replace(stay, CUTS[unit][1], "")).otherwise(stay)
    found = []
    if words is not None:
        covered = F.aggregate("_gf_words", zero, lambda acc, s: acc + s["end"] - s["start"])
        found = [F.coalesce(covered, zero).alias(PASSAGES[0]), F.coalesce("_gf_words", F.array().cast(SPANS)).alias(PASSAGES[1])]
    made = MADE if words is None else MADE + PASSAGES
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in made],
        F.coalesce(F.size("_gf_parts"), F.lit(0)).cast("bigint").alias("n_units"),
        F.size("_gf_gone").cast("bigint").alias("n_removed"),
        F.coalesce("_gf_listed", F.lit(0)).cast("bigint").alias("n_repeated"),
        F.coalesce(F.when(some, spans), F.array().cast(SPANS)).alias("removed_spans"),
        F.when(some, kept).otherwise(F.col(f"`{text}`")).alias("kept_text"),
        *found,
    )


def dedup_units(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = 5, min_chars: int = 1, passage: int = 0) -> DataFrame:
    """The documents with n_units, n_removed, n_repeated (units whose like stands elsewhere in the
    corpus or the text, the earliest ones included), removed_spans and kept_text.

    With ``passage``, also n_passage_words and passage_spans (array of start and end, in words):
    words in passages of so many that start elsewhere in the corpus or the text too."""
    keyed = docs.withColumn("_gf_id", F.col(f"`{doc_id}`")).withColumn("_gf_text", text_digest(F.col(f"`{text}`")))
    cut = keyed.filter(F.length(text) > 0).select(F.col("_gf_id").alias("_id"), F.col("_gf_text").alias("_text"), pieces(F.col(f"`{text}`"), unit).alias("u"))
    # lower-casing at most doubles a character, so pieces of less than half the floor are out early
    cut = cut.select("_id", "_text", F.filter(F.transform("u", lambda x, i: F.struct(i.alias("pos"), x.alias("u"))), lambda s: F.length(s["u"]) * 2 >= min_chars).alias("u"))
    cut = cut.select("_id", "_text", F.explode("u").alias("u")).select("_id", "_text", F.col("u.pos").alias("_pos"), normalised(F.col("u.u")).alias("_norm"))
    cut = cut.filter(F.length("_norm") >= max(1, min_chars))
    if min_words > 1:
        cut = cut.filter(F.size(F.split("_norm", " ")) >= min_words)
    cut = stored(cut.select("_id", "_text", "_pos", *digest(F.col("_norm"))), "units")
    total = max(1, cut.count())
    repeated = cut.groupBy("_d", "_e").agg(F.count("*").alias("_n")).filter("_n > 1")
    seen = stored(lookup(cut, repeated.withColumn("n", F.col("_n")), ["_d", "_e"], "_n", total, how="inner"), "seen")
    first = seen.groupBy("_d", "_e").agg(F.min(F.struct("_id", "_text", "_pos")).alias("_first"), F.count("*").alias("_n"))
    marked = lookup(seen, first, ["_d", "_e"], "_n", total, how="inner")
    marked = marked.select("_id", "_text", "_pos", (~F.struct("_id", "_text", "_pos").eqNullSafe(F.col("_first"))).alias("removed"))
    words = None
    if passage:
        rows = keyed.select(F.col("_gf_id").alias("_key"), F.col("_gf_text").alias("_digest"), F.lower(F.col(f"`{text}`")).alias("_text"))
        words = passages(rows, docs.schema[doc_id].dataType.simpleString(), passage)
        words = words.withColumnsRenamed({"_key": "_id", "_digest": "_text"})
    return rebuilt(keyed, marked, text, unit, words).drop("_gf_id", "_gf_text")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines, cut further after sentence ends; units of fewer than 80 characters stay."""
    out = dedup_units(table(spark, sf_dir, "documents").select("doc_id", "text"), unit="sentence", min_words=1, min_chars=80)
    spans = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "n_units", "n_removed", "n_repeated", spans.alias("removed_spans"), F.md5(F.coalesce("kept_text", F.lit("")).cast("binary")).alias("kept_md5"))


OP4_SQL = r"""
with pieces as (
  select doc_id, text, string_split(regexp_replace(text, '(\n|[.!?][ \t]|[\x{3002}\x{FF01}\x{FF1F}])', '\1' || chr(1), 'g'), chr(1)) as u
  from documents where length(text) > 0),
cut as (select doc_id, text, unnest(u) as unit, generate_subscripts(u, 1) - 1 as pos, len(u) as n from pieces),
placed as (
  select *, sum(length(unit)) over (partition by doc_id order by pos) as stop,
    trim(regexp_replace(lower(unit), '[ \t\n\v\f\r]+', ' ', 'g')) as norm
  from cut),
ranked as (
  select *, length(norm) >= 80 and row_number() over (partition by norm order by doc_id, pos) > 1 as gone,
    length(norm) >= 80 and count(*) over (partition by norm) > 1 as again
  from placed),
per_doc as (
  select doc_id, count(*) as n_units, count(*) filter (where gone) as n_removed, count(*) filter (where again) as n_repeated,
    coalesce(string_agg((stop - length(unit))::bigint || '-' || stop::bigint, ',' order by pos) filter (where gone), '') as removed_spans,
    coalesce(string_agg(unit, '' order by pos) filter (where not gone), '') as kept,
    bool_or(gone and pos = n - 1) as last_gone
  from ranked group by doc_id)
select d.doc_id, coalesce(n_units, 0)::bigint as n_units, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_repeated, 0)::bigint as n_repeated,
  coalesce(removed_spans, '') as removed_spans, md5(coalesce(case when last_gone then regexp_replace(kept, '[\n \t]\z', '') else kept end, '')) as kept_md5
from documents d left join per_doc p on d.doc_id = p.doc_id
"""
