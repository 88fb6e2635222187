from pyspark.sql import functions as F

from gaugeframe.functions import lexer
from gaugeframe.operators import generate
from gaugeframe.plans import model_queries
from gaugeframe.plans.registry import QUERIES

TEXT = "theorem t{} (a b : ℕ) (h : a ≤ 12) : a + b = b + a := by\n  simp [h]\n"


def test_candidates_of_one_partition_are_made_by_several_tasks(spark):
    df = spark.range(40).coalesce(1).select(F.col("id").cast("string"), F.format_string(TEXT.replace("{}", "%d"), "id").alias("text"), F.lit(True).alias("ok"))
    rows = generate.candidates(df, "id", "text", "ok")
    assert rows.select(F.spark_partition_id()).distinct().count() > 1
    bare = generate.candidates(df, "id", "text", "ok", contents=False)
    assert bare.filter("text is not null").count() == 0
    assert bare.drop("text").exceptAll(rows.drop("text")).isEmpty() and rows.drop("text").exceptAll(bare.drop("text")).isEmpty()


def test_generated_candidates_sends_no_texts(spark, monkeypatch):
    asked = []
    real = generate.candidates
    monkeypatch.setattr(model_queries.generate, "candidates", lambda *a, **k: asked.append(k) or real(*a, **k))
    rows = QUERIES["generated_candidates"](spark, "/root/testdata/sf0.001")
    assert "text" not in rows.columns and asked == [{"contents": False}]


def test_a_text_is_read_once_for_all_edits_and_checks():
    text = TEXT.format(7)
    before = lexer._pieces.__wrapped__
    assert before(text) == tuple(lexer.pieces(text)) and lexer._pieces(text) is lexer._pieces(text)


def test_patterns_agree_with_the_character_tests():
    for ch in "aé́ℕⅧ²٣中𝔸𝟙𐒠\U0001d165'_≤  ​\ud800":
        text = f"a{ch} {ch}b 1{ch}c"
        first = text.split(" ")[0] if not ch.isspace() else "a"
        want = first if lexer.continues_name(ch) else "a"
        assert text[slice(*lexer.names(text)[0])] == want
        assert (ch in lexer.tokens(f" {ch} ")) == (not ch.isspace())
    assert lexer.tokens("1a ²b Ⅷc ٣d") == ["1", "a", "²", "b", "Ⅷ", "c", "٣", "d"] and lexer.names("1a ²b Ⅷc") == [(7, 8)]
    assert [p.kind for p in lexer.pieces('a/- x /- y -/ -/b"c\\"-- d"--e\nf/--/')] == ["code", "comment", "code", "string", "comment", "code", "comment"]
