import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexspan.functions import identity, text as T, vectors as V

TEXTS = ["", " ", "a", "ab", "abc def. Ghi! x", "﻿a\r\nb\rc", "Ｆｕｌｌ  Ｗｉｄｔｈ", "한글 é 한", "😀 emoji 12345", "第一章 foo", None, "x y　z"]


def column(spark, c, rows=TEXTS):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, s string")
    return [r[0] for r in df.select("i", c.alias("v")).orderBy("i").select("v").collect()]


def test_normal_forms(spark):
    got = column(spark, T.canonical_text(F.col("s")))
    assert got[5] == "a\nb\nc" and got[7].startswith("한글 é") and got[10] is None
    got = column(spark, T.analysis_text(F.col("s")))
    assert got[6] == "full width" and got[11] == "x y z" and got[1] == ""
    assert column(spark, T.selection_text(F.col("s")))[6] == "Full Width"


def test_estimate_is_the_same_in_both_worlds(spark):
    got = column(spark, T.token_estimate(F.col("s")))
    assert got == [None if x is None else T.estimate(x) for x in TEXTS]
    assert got[8] == 1 + 2 + 2 and got[9] == 4


def test_grams(spark):
    assert column(spark, T.bigrams(F.col("s")))[:4] == [[], [], [], ["ab"]]
    assert column(spark, T.character_trigrams(F.col("s")))[2:5] == [["a"], ["ab"], ["abc", "bcd", "cde", "def", "ef.", "f.G", ".Gh", "Ghi", "hi!", "i!x"]]
    assert column(spark, T.bigram_jaccard(F.col("s"), F.lit("")))[4] == 0.0


def test_parts_join_to_the_text(spark):
    for f in (T.sentence_parts, T.line_parts):
        got = column(spark, F.array_join(f(F.col("s")), ""))
        assert [g for g in got if g is not None] == [x for x in TEXTS if x is not None]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300), st.integers(1, 9))
def test_windows_cover(s, target):
    w = T.windows(s, target, target * 2)
    assert "".join(s[a:z] for a, z in w) == s
    assert all(T.estimate(s[a:z]) <= target * 2 or z - a == 1 for a, z in w)


@pytest.mark.parametrize(("x", "want"), [(float("nan"), 0.0), (float("inf"), 0.0), (-1.0, 0.0), (0.4, 0.4), (7.0, 1.0)])
def test_clamp(spark, x, want):
    assert spark.range(1).select(T.clamp(F.lit(x))).first()[0] == want


def test_reciprocal_refuses(spark):
    assert spark.range(1).select(T.reciprocal(F.lit(1.0))).first()[0] == 1 / 61
    for bad in (0.0, 1.5):
        with pytest.raises(Exception, match="whole number"):
            spark.range(1).select(T.reciprocal(F.lit(bad))).collect()


def test_formats(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.is_digest(F.lit("sha256:" + "a" * 64))) and not one(T.is_digest(F.lit("sha256:a")))
    assert one(T.is_uuid7(F.lit("01890a5d-ac96-774b-bcce-b302099a8057"))) and not one(T.is_uuid7(F.lit("01890a5d-ac96-474b-bcce-b302099a8057")))
    assert one(T.is_timestamp(F.lit("2024-01-01T00:00:00.000Z"))) and not one(T.is_timestamp(F.lit("2024-01-01")))
    assert one(T.duration(F.lit(3_723_000))) == "1h 2m"


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(V.cosine(v(0, 0), v(1, 0))) == 0.0
    assert one(V.closeness(v(0, 0), v(3, 4))) == pytest.approx(1 / 6)
    assert one(V.matches_profile(v(0.6, 0.8), 2)) and not one(V.matches_profile(v(1, 1), 2)) and not one(V.matches_profile(v(float("nan"), 1), 2))
    assert one(V.term_cosine(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))) == pytest.approx(0.5**0.5)


def test_identity():
    assert identity.canonical_json({"b": 1.0, "a": [True, "é", 0.85], "c": None}) == '{"a":[true,"é",0.85],"b":1}'
    a, b = identity.revision_id("rev", {"x": 1, "y": 2}), identity.revision_id("rev", {"y": 2.0, "x": 1})
    assert a == b and a.startswith("rev_") and len(a) == 4 + 52
    with pytest.raises(ValueError, match="finite"):
        identity.canonical_json(float("nan"))
