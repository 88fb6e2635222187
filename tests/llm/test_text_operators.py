"""Operators on texts against brute force, with nulls, empty texts, repeats and clashing columns."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import decontam, jaccard_join, langid, lm_score, site_lines, suffix_dedup, toxicity, unit_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, score double"


def frame(spark, texts, **columns):
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}" if i % 5 else None, len(t or ""), 1, 0.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def test_lm_matches_the_automaton_and_base(spark):
    rng = random.Random(3)
    texts = [words(rng, rng.randint(0, 30), "abc") for _ in range(40)] + [None, "", "ABC abc\tabc\x0babc", "x"]
    df = frame(spark, texts)
    got = {r.doc_id: r for r in lm_score.score(df, F.col("doc_id") % 3 != 2, order=3, block_bytes=500).collect()}
    toks = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None] for t in texts]
    counts = {}
    for i, t in enumerate(toks):
        if i % 3 != 2:
            for n in (1, 2, 3):
                for k in range(len(t) - n + 1):
                    counts[tuple(t[k : k + n])] = counts.get(tuple(t[k : k + n]), 0) + 1
    one = [v for k, v in counts.items() if len(k) == 1]
    total, ones, twos = sum(one), one.count(1), one.count(2)
    auto = lm_score.BackoffAutomaton(counts, total, ones / (ones + 2 * twos) if ones and twos else 0.5, lm_score.STRENGTH)
    for i, t in enumerate(toks):
        base = sum(math.log10((counts.get((w,), 0) + 1) / (total + len(one) + 1)) for w in t)
        assert got[i].n_tokens == len(t) and got[i].train_tokens == total
        assert got[i].n_known == sum((w,) in counts for w in t)
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(auto.score(t))


def test_lm_automaton_reads_long_texts_in_stretches(spark):
    rng = random.Random(9)
    texts = [words(rng, 900, "ab"), words(rng, 700, "ab"), "a"]
    df = frame(spark, texts)
    for order in (1, 2, 3, 4):
        got = {r.doc_id: r.score for r in lm_score.score(df, F.col("doc_id") < 2, order=order, block_bytes=3000).collect()}
        toks = [re.findall(r"[^\x20\x09-\x0D]+", t) + [None] for t in texts]
        counts = {}
        for t in toks[:2]:
            for n in range(1, order + 1):
                for k in range(len(t) - n + 1):
                    counts[tuple(t[k : k + n])] = counts.get(tuple(t[k : k + n]), 0) + 1
        one = [v for k, v in counts.items() if len(k) == 1]
        ones, twos = one.count(1), one.count(2)
        auto = lm_score.BackoffAutomaton(counts, sum(one), ones / (ones + 2 * twos) if ones and twos else 0.5, (200.0, 5.0, 5.0))
        assert [got[i] for i in range(3)] == pytest.approx([auto.score(t) for t in toks])


def test_lm_without_training_text(spark):
    rows = lm_score.score(frame(spark, ["a b", None]), F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in sorted(rows, key=lambda r: r.doc_id)] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert lm_score.score(frame(spark, []), F.lit(True)).count() == 0


def test_jaccard_join_loses_no_link(spark):
    rng = random.Random(5)
    texts = [words(rng, 60) for _ in range(30)] + [None, "", "only three words", "Only three, words"]
    for i in range(30):
        near = texts[i].split()
        near[rng.randrange(60)] = "changed"
        texts += [" ".join(near), texts[i]]
    texts += [texts[0]] * 40
    sets = []
    for t in texts:
        w = re.findall(r"[0-9a-z\x80-￿]+", (t or "").lower())
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    links = {i: [j for j in range(len(texts)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in range(len(texts))}

    def smallest(i):
        seen, queue = {i}, [i]
        while queue:
            for j in links[queue.pop()]:
                if j not in seen:
                    seen.add(j)
                    queue.append(j)
        return min(seen)

    for options in ({}, {"small": 4, "block": 4}, {"block_tokens": 20}):
        got = {r.doc_id: r for r in jaccard_join.join(frame(spark, texts), **options).collect()}
        assert len(got) == len(texts)
        assert {i: (r.class_id, r.n_links, r.keep) for i, r in got.items()} == {i: (smallest(i), len(links[i]), smallest(i) == i) for i in links}


def test_jaccard_join_without_words(spark):
    rows = jaccard_join.join(frame(spark, [None, "", "..."])).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in rows) == [(0, 0, 0), (1, 1, 0), (2, 2, 0)]


def test_jaccard_join_sketches_compare_across_sizes(spark):
    rng = random.Random(11)
    texts = []
    for more, fewer in ((68, 67), (72, 59)):  # 64 and 63 shingles, 68 and 55
        for _ in range(10):
            long = words(rng, more).split()
            texts += [" ".join(long), " ".join(long[:fewer])]
    got = {r.doc_id: r for r in jaccard_join.join(frame(spark, texts)).collect()}
    assert [(got[i].class_id, got[i].n_links) for i in range(40)] == [(i - i % 2, 1) for i in range(40)]


def test_sketches_estimate_similarity_at_every_size():
    rng = np.random.default_rng(7)
    for n in (1, 5, 20, 55, 63, 64, 80, 200, 900):
        agree = []
        for _ in range(20):
            both = rng.integers(0, 1 << 63, n + -(-n // 5), dtype=np.uint64)
            a, b = jaccard_join.sketches(np.concatenate([both, both[:n]]), np.array([0, len(both), len(both) + n]))
            agree.append(512 - sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)))
        want = 256 * (1 + n / len(both))
        assert abs(sum(agree) / 20 - want) < 12 and (n < 5 or min(agree) >= 430)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(2)
    for window in (1, 3, 5):
        items = [(str(i), words(rng, rng.randint(0, 9), "ab")) for i in range(8)] + [("n", None), ("e", "...")]
        texts = [words(rng, rng.randint(0, 40), "ab") for _ in range(30)] + [None, "", "É" * 10]
        items_df = spark.createDataFrame(items, "item_id string, text string")
        out = decontam.decontaminate(frame(spark, texts), items_df, window=window, chunk_bytes=60).orderBy("doc_id").collect()
        want = decontam.brute_force(texts, items, window)
        assert [(r.n_words, r.n_hit, r.n_items) for r in out] == [w[:3] for w in want]
        for r, text in zip(out, texts, strict=True):
            if not r.contaminated:
                assert r.clean_text == text
            assert sum(1 for _ in r.spans) == len(r.spans)


def test_unit_dedup_keeps_the_first(spark):
    long = "this line has quite a few words"
    texts = [f"{long}\nunique one here with more words\n{long}", f"x\n  {long.upper()}  ", None, "", long, "short\nshort", "a\n\nb"]
    out = {r.doc_id: r for r in unit_dedup.dedup_units(frame(spark, texts)).collect()}
    assert [out[i].n_removed for i in range(7)] == [1, 1, 0, 0, 1, 0, 0]
    assert out[0].kept_text == f"{long}\nunique one here with more words" and out[1].kept_text == "x" and out[4].kept_text == "" and out[2].kept_text is None
    s = out[1].removed_spans[0]
    assert texts[1][s.start : s.end].strip() == long.upper()
    assert unit_dedup.dedup_units(frame(spark, [])).count() == 0
    by_paragraph = unit_dedup.dedup_units(frame(spark, [f"{long}\n\nrest", long]), unit="paragraph").orderBy("doc_id").collect()
    assert [r.kept_text for r in by_paragraph] == [f"{long}\n\nrest", ""]


def test_site_lines(spark):
    texts = [f"menu\nbody {i}" if i < 12 else f"other {i}\n\n" for i in range(40)] + [None, ""]
    df = frame(spark, texts).withColumn("source", F.when(F.col("doc_id") < 39, F.lit("a")))
    out = {r.doc_id: r for r in site_lines.drop_boilerplate(df).collect()}
    assert all(out[i].kept_text == f"body {i}" and out[i].n_removed == 1 for i in range(12))
    assert all(out[i].kept_text == texts[i] for i in range(12, 42))
    few = site_lines.drop_boilerplate(df, min_pages=13)
    assert few.filter("n_removed > 0").count() == 0


@pytest.mark.parametrize("hot", [512, 2])
def test_suffix_dedup_matches_brute_force(spark, hot):
    rng = random.Random(hot)
    shared = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (50, 80, 200)]
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 120))) + (rng.choice(shared) if rng.random() < 0.7 else "") + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 40))) for _ in range(40)]
    texts += [None, "", "a" * 300, texts[0], shared[2] + shared[2]]
    df = frame(spark, texts)
    got = {r.doc_id: r for r in suffix_dedup.dedup(df, length=40, gram=8, hot=hot, shard_bytes=2000).collect()}
    want = suffix_dedup.brute_force(texts, 40)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        left, data = bytes(got[i].kept), (t or "").encode()
        assert left == b"".join(data[a:b] for a, b in zip([0, *[s.end for s in got[i].spans]], [*[s.start for s in got[i].spans], len(data)], strict=True))


def test_suffix_dedup_bisects_windows_of_null_ids(spark):
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdef ") for _ in range(120))
    texts = ["".join(rng.choice("uvwxyz") for _ in range(rng.randint(5, 60))) + shared[rng.randint(0, 30) :] + "".join(rng.choice("uvwxyz") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    df = frame(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") != 4, F.col("doc_id")))
    got = {r.doc_id: r for r in suffix_dedup.dedup(df, length=40, gram=8, hot=2, shard_bytes=2000).collect()}
    want = suffix_dedup.brute_force(texts, 40)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in (got[None if i == 4 else i] for i in range(12))] == want


@pytest.mark.parametrize("hot", [512, 2])
def test_suffix_dedup_at_400_bytes_with_spills_null_ids_and_long_texts(spark, hot):
    rng = random.Random(20)
    shared = ["".join(rng.choice("abcdef é") for _ in range(n)) for n in (420, 900, 395)]
    texts = [words(rng, rng.randint(0, 60)) + rng.choice(shared) + words(rng, rng.randint(0, 60)) for _ in range(25)]
    texts += [words(rng, 1500) + shared[1], words(rng, 3000), shared[1] * 2, None, ""]
    df = frame(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 4 != 1, F.col("doc_id"))).withColumn("_key", F.lit(1)).withColumn("_text", F.lit("x"))
    got = suffix_dedup.dedup(df, hot=hot, sort_memory=1 << 12, shard_bytes=20_000).collect()
    want = suffix_dedup.brute_force(texts, 400)
    key = lambda i: (i is None, i or 0)
    assert sorted([(key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got]) == sorted([(key(None if i % 4 == 1 else i), *w) for i, w in enumerate(want)])
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


def test_language_id(spark):
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))
    texts = [make("thersan") if i % 2 else make("quevoiz") for i in range(60)] + [None, "", "123 !?", "é"]
    df = frame(spark, texts)
    model = langid.fit(df.filter("doc_id < 40"))
    out = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all(out[i].lang_pred == ("en" if i % 2 else "fr") and 0 <= out[i].score <= 1 and not out[i].ambiguous for i in range(40, 60))
    assert [out[i].lang_pred for i in (60, 61, 62)] == ["und"] * 3 and out[60].score == 0 and out[63].lang_pred in ("en", "fr")
    both = frame(spark, [make("thersan") + " " + make("quevoiz")] * 3 + [make("thersan")])
    assert [r.ambiguous for r in langid.predict(both, model).orderBy("doc_id").collect()][3] is False
    close = langid.Model({"en": np.ones((2, langid.BUCKETS)), "fr": np.ones((2, langid.BUCKETS))})
    assert all(r.ambiguous and r.score == 0.5 for r in langid.predict(both, close).collect())
    nothing = langid.fit(df.filter("false"))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}
    code = langid.codebook(9)
    assert len({tuple(c) for c in code.tolist()}) == 9


def test_toxicity(spark):
    rng = random.Random(4)
    texts = [words(rng, 30, "aeiourst") + (" you vile scoundrel " if i % 4 == 0 else " ") + words(rng, 30, "aeiourst") for i in range(120)] + [None, ""]
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), None) for i in range(0, 80)] + [(None, 1, 1), (3, None, 0)], "doc_id bigint, toxic int, quality int")
    out = {r.doc_id: r for r in toxicity.predict(df, toxicity.fit(df, labels)).collect()}
    assert all((out[i].score > 0.5) == (i % 4 == 0) for i in range(80, 120))
    assert out[120].score == out[121].score and 0 <= out[120].score <= 1
    flat = toxicity.fit(df, labels.filter("toxic = 0"))
    assert {round(r.score, 9) for r in toxicity.predict(df, flat).collect()} != set() and toxicity.predict(df, flat).filter("predicted = 1").count() == 0


def test_folds_match_zlib(spark):
    from gaugeframe.llm._spark import fold

    got = spark.range(50).select("id", fold(F.col("id"), 7).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 7 for r in got)
