"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's frequency on a host is the number of the host's pages that hold
it, divided by the host's pages; lines above ``ratio`` that stand on at least ``min_pages`` pages
are boilerplate there and go from every page of that host. Lines are compared trimmed.

Everything is DataFrame operations. Each text is cut once; the digests of its lines are written to
the shared folder. (host, line) pairs are aggregated before they are shuffled, and frequent pairs
come back by broadcast (see ``lookup``), so a hot host or line stays spread.

Defined cases: a null host is a host of its own; blank lines are never counted or removed; null and
empty texts count as pages and stay as they are; rows repeated exactly (id, host and text) count as
that many pages and are treated alike; a null page id is an id like any other; columns named like
results give way, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm._spark import lookup, stored, table, text_digest
from gaugeframe.llm.unit_dedup import digest, pieces, rebuilt


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null where it has none."""
    return F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))


def drop_boilerplate(pages: DataFrame, *, page_id: str = "doc_id", text: str = "text", host: str | Column = "source", ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """The pages with n_units (lines), n_removed, n_repeated (the same), removed_spans and kept_text.

    ``host`` is a column or its name; ``host_of`` takes it from a URL.
    """
    name = F.col(f"`{host}`") if isinstance(host, str) else host
    key = F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit("null"))
    keyed = pages.withColumn("_gf_id", F.col(f"`{page_id}`")).withColumn("_gf_text", F.xxhash64(text_digest(F.col(f"`{text}`")), key))
    hosted = keyed.select(F.col("_gf_id").alias("_id"), F.col("_gf_text").alias("_text"), key.alias("_host"), pieces(F.coalesce(F.col(f"`{text}`"), F.lit("")), "line").alias("_u"))
    hosted = hosted.withColumn("_u", F.transform("_u", lambda u: F.btrim(u, F.lit(" \t\x0b\f\r\n"))))
    both = lambda x: F.struct(*digest(F.concat_ws("\n", "_host", x)))
    # a page's own repeats count once
    once = F.transform(F.filter(F.array_distinct("_u"), lambda u: u != ""), both)
    every = F.filter(F.transform("_u", lambda u, i: F.when(u != "", F.struct(i.alias("pos"), both(u).alias("x")))), lambda s: s.isNotNull())
    lines = stored(hosted.select("_id", "_text", "_host", once.alias("once"), every.alias("every")), "lines")
    held = lines.select("_host", F.explode("once").alias("x")).groupBy("_host", F.col("x._d").alias("_d"), F.col("x._e").alias("_e")).agg(F.count("*").alias("_held"))
    pages_of = lines.groupBy("_host").agg(F.count("*").alias("_pages"))
    bad = held.filter(F.col("_held") >= min_pages).join(pages_of, "_host").filter(F.col("_held") > F.lit(ratio) * F.col("_pages"))
    bad = stored(bad.select("_d", "_e", F.col("_held").alias("_n"), F.lit(True).alias("removed")), "boilerplate")
    cut = lines.select("_id", "_text", F.explode("every").alias("s")).select("_id", "_text", F.col("s.pos").alias("_pos"), F.col("s.x._d").alias("_d"), F.col("s.x._e").alias("_e"))
    total = max(1, lines.agg(F.sum(F.size("every"))).first()[0] or 0)
    gone = lookup(cut, bad, ["_d", "_e"], "_n", total, how="inner").select("_id", "_text", "_pos", "removed")
    return rebuilt(keyed, gone, text, "line").drop("_gf_id", "_gf_text")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("n_units").alias("n_lines"), F.col("n_removed").alias("n_dropped"), F.md5(F.coalesce("kept_text", F.lit("")).cast("binary")).alias("kept_md5"))


OP5_SQL = r"""
with cut as (
  select doc_id, coalesce('=' || source, 'null') as host, unnest(string_split(text, chr(10))) as unit,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
  from documents where length(text) > 0),
lines as (select *, trim(unit, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as line from cut),
totals as (select coalesce('=' || source, 'null') as host, count(*) as pages from documents group by 1),
held as (select host, line, count(distinct doc_id) as held from lines where line <> '' group by 1, 2),
bad as (select h.host, h.line from held h join totals t on h.host = t.host where held >= 5 and held > 0.1::double * pages),
marked as (select l.*, b.line is not null as gone from lines l left join bad b on l.host = b.host and l.line = b.line),
per_doc as (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
    coalesce(string_agg(unit, chr(10) order by pos) filter (where not gone), '') as kept
  from marked group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped, md5(coalesce(kept, '')) as kept_md5
from documents d left join per_doc p on d.doc_id = p.doc_id
"""
