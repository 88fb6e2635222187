"""Every operator on null ids, null, empty and very long texts, repeated rows, empty tables and
columns whose names clash with those that operators use."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import decontam, jaccard_join, langid, lm_score, mixing, site_lines, suffix_dedup, toxicity, unit_dedup

CLASHING = ("_id", "_text", "_key", "_digest", "_host", "_t", "_pos", "_block", "cid", "label", "n")
LONG = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta"]) + str(random.Random(i).randint(0, 99)) for i in range(200_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, "one two three four five six"), (1, None), (2, ""), (3, LONG), (4, LONG + "\nand a last line of its own"), (5, "one two three four five six"), (5, "one two three four five six"), (6, "  \n\n"), (7, "ÄÖ 漢字 " * 50)]
    df = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None if i == 3 else "s") for i, t in rows], "doc_id bigint, text string, lang string, source string")
    return df.select("*", *[F.lit("mine").alias(c) for c in CLASHING])


def operators(spark, docs):
    items = spark.createDataFrame([("a", "one two three"), (None, "four five"), ("e", None)], "item_id string, text string")
    labels = spark.createDataFrame([(5, 1), (7, 0), (None, 1)], "doc_id bigint, toxic int")
    return {
        "lm": lm_score.score(docs, F.lit(True), block_bytes=100_000),
        "jaccard": jaccard_join.join(docs),
        "units": unit_dedup.dedup_units(docs, unit="sentence", min_words=1, min_chars=10),
        "lines": site_lines.drop_boilerplate(docs, min_pages=1, ratio=0.9),
        "mix": mixing.mix(docs),
        "decontam": decontam.decontaminate(docs, items),
        "langid": langid.predict(docs, langid.fit(docs)),
        "toxicity": toxicity.predict(docs, toxicity.fit(docs, labels)),
        "suffix": suffix_dedup.dedup(docs, contents=False),
    }


KEEPING = ("units", "lines", "mix", "decontam", "langid", "toxicity")


def test_every_row_comes_back_once(spark, docs):
    for name, out in operators(spark, docs).items():
        rows = out.collect()
        assert len(rows) == 9, name
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i in (None, 1, 2, 3, 4, 5, 5, 6, 7)), name
        if name in KEEPING:
            assert all(r[c] == "mine" for r in rows for c in CLASHING), name


def test_long_texts_are_whole(spark, docs):
    out = operators(spark, docs.filter("doc_id in (3, 4)"))
    assert {r.doc_id: r.n_removed for r in out["suffix"].collect()} == {3: len(LONG.encode()), 4: len(LONG.encode())}
    assert {r.doc_id: r.n_tokens for r in out["lm"].collect()} == {3: 200_001, 4: 200_008}
    assert {r.class_id for r in out["jaccard"].collect()} == {3}
    assert {r.doc_id: (r.n_removed, r.n_repeated) for r in out["units"].collect()} == {3: (0, 1), 4: (1, 1)}
    assert all(r["size"] >= 200_000 for r in out["mix"].collect())
    assert all(r.n_words >= 200_000 for r in out["decontam"].collect())


def test_empty_tables(spark, docs):
    for name, out in operators(spark, docs.limit(0)).items():
        assert out.count() == 0, name


def test_units_keep_offsets_and_count_repeats(spark):
    text = "First sentence that is long enough to count here. Second one that is also long enough.\nA line that is long enough too"
    df = spark.createDataFrame([(1, text), (2, "Something new of a good length stands before it. " + text.upper()), (3, "First sentence that is long enough to count here.")], "doc_id bigint, text string")
    out = {r.doc_id: r for r in unit_dedup.dedup_units(df, unit="sentence", min_words=1, min_chars=20).collect()}
    assert [(out[i].n_units, out[i].n_removed, out[i].n_repeated) for i in (1, 2, 3)] == [(3, 0, 3), (4, 3, 3), (1, 1, 1)]
    assert out[2].kept_text == "Something new of a good length stands before it." and out[3].kept_text == "" and out[1].kept_text == text
    upper = df.filter("doc_id = 2").first().text
    assert "".join(upper[s.start : s.end] for s in out[2].removed_spans) == text.upper()


def test_hosts_come_from_urls(spark):
    df = spark.createDataFrame([("HTTP://A.org:80/x?y",), ("a.org/x",), (None,), ("https://b.A.org",)], "u string")
    assert [r.h for r in df.select(site_lines.host_of(F.col("u")).alias("h")).collect()] == ["a.org", None, None, "b.a.org"]
