import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from onomast.functions import sampling, scripts, text, translit, vectors

NAMES = ["", "José García", "O'Neil MARY-ann", "ﬁnal ½", "Ｊｏｓｅ", "Ångström ﬀ", "Алексей Ёж", "名前 テスト", "a\tb  c", "Żółć", "naïve_x²", "İstanbul", "é"]


def values(spark, rows, column, schema="s string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


@pytest.mark.parametrize(
    ("fn", "plain"),
    [
        (text.nfkd, lambda s: unicodedata.normalize("NFKD", s)),
        (text.nfkc, lambda s: unicodedata.normalize("NFKC", s)),
        (text.drop_diacritics, lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))),
        (text.ascii_fold, lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()),
        (text.title, str.title),
        (text.capitalize, str.capitalize),
        (text.strip, str.strip),
        (text.tidy_spaces, lambda s: " ".join(s.split())),
    ],
)
def test_unicode_forms(spark, fn, plain):
    assert values(spark, [*NAMES, None], fn(F.col("s"))) == [*map(plain, NAMES), None]


def test_canonicalize(spark):
    import re

    want = [re.sub(r"[\W_]+", "", s.lower().strip()) for s in NAMES if s != "İstanbul"]
    assert values(spark, [s for s in NAMES if s != "İstanbul"], text.canonicalize(F.col("s"))) == want


def test_blocking_forms(spark):
    n = text.match_normalize(F.col("s"))
    row = spark.createDataFrame([("José  de-la Cruz 2nd",), ("",), ("123",)], "s string")
    got = row.select(n.alias("n"), text.skeleton(n).alias("k"), text.initials(n).alias("i"), text.surname(n).alias("l")).collect()
    assert [tuple(r) for r in got] == [("jose de la cruz nd", "js d l crz nd", "jd", "nd"), ("", "", "", ""), ("", "", "", "")]


@pytest.mark.parametrize(
    ("word", "script"),
    [("abc", "ascii"), ("Привет", "russian"), ("Ґанок", "cyrillic"), ("їє", "only_ukrainian"), ("漢字", "cjk"), ("かな", "hiragana"), ("カナ", "katakana"), ("한글", "hangul"), ("नमस्ते", "devanagari"), ("Ελλάδα", "greek"), ("ไทย", "thai"), ("ğış", "turkish"), ("سلام", "arabic")],
)
def test_scripts(spark, word, script):
    check = scripts.word_is_in(F.col("s"), script)
    outside = "𝒳" if script != "x" else ""
    assert values(spark, [word, "", word + outside, word + "\n" + outside], check) == [True, True, False, False]


def test_every_script_compiles(spark):
    row = spark.createDataFrame([("\n",)], "s string").select(*scripts.flags(F.col("s"))).first()
    assert len(row) == 20 and row["is_ascii"] and row["is_punctuation"] and not row["is_latin"]


def test_levenshtein_counts_code_points(spark):
    df = spark.createDataFrame([("José", "Jose"), ("", "abc"), ("kitten", "sitting")], "a string, b string")
    assert [tuple(r) for r in df.select(text.edit_distance(F.col("a"), F.col("b")), text.edit_distance(F.col("a"), F.col("b"), 2)).collect()] == [(1, 1), (3, -1), (3, -1)]


def test_transliteration(spark):
    rows = [("Алексей Щука", "ru"), ("Θάλασσα Ψωμί", "el"), ("名前", "ja"), ("x😀", "ru"), (None, "ru"), ("x", None)]
    t = translit.transliterate(F.col("s"), F.col("lang"))
    got = spark.createDataFrame(rows, "s string, lang string").select(t.alias("t")).select("t.*").collect()
    assert [tuple(r) for r in got[:4]] == [("Aleksey Shchuka", "builtin_ru_cyr2lat"), ("Thalassa Psomi", "builtin_el_greeklish"), ("名前", "none"), ("x😀", "builtin_ru_cyr2lat")]
    assert got[4]["text"] is None and got[5]["text"] == "x"
    assert [translit.transliterate_text(*r) for r in rows[:4]] == [tuple(r) for r in got[:4]]


def test_custom_adapter(spark):
    translit.register_adapter("xx", "custom_upper", str.upper)
    translit.register_adapter("yy", "broken", lambda s: 1 / 0)
    try:
        assert translit.transliterate_text("abc", "xx") == ("ABC", "custom_upper")
        df = spark.createDataFrame([("abc", "xx"), ("abc", "yy"), ("да", "ru")], "s string, lang string")
        got = df.select(translit.transliterate(F.col("s"), F.col("lang")).alias("t")).select("t.*").collect()
        assert [tuple(r) for r in got] == [("ABC", "custom_upper"), ("abc", "error"), ("da", "builtin_ru_cyr2lat")]
    finally:
        translit._adapters.clear()


def test_draws_match_md5(spark):
    want = int(hashlib.md5(b"42:ann o:7").hexdigest()[:8], 16)
    df = spark.createDataFrame([("ann o", 7)], "a string, b int")
    assert tuple(df.select(sampling.draw(42, "a", "b"), sampling.unit(42, "a", "b")).first()) == (want, want / 2**32)


def test_half_even(spark):
    assert values(spark, [0.5, 1.5, 2.5, 2.4], sampling.half_even(F.col("s")), "s double") == [0, 2, 2, 2]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(vectors.dot(a, b), vectors.cosine(a, b), vectors.l2_normalize(a), vectors.score_bucket(F.lit(43), "business")).collect()
    assert got[0][0] == 24 and got[0][1] == pytest.approx(0.96) and got[0][2] == [0.6, 0.8] and got[0][3] == "likely"
    assert got[1][1] is None and got[1][2] == [None, None]


def test_masks_hold_their_edges(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.5, 0.25), (0.5, 0.2)], "p double, n double")
    got = df.select(vectors.semi_hard(F.col("p"), F.col("n"), 0.25), vectors.hard(F.col("p"), F.col("n"), 0.25)).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, True), (False, False)]


def test_clean_line_and_clock(spark):
    assert values(spark, ['  {"a": 1234},\r', "[", '{"a":1},', None], text.clean_line(F.col("s"))) == ['{"a": 1234}', None, None, None]
    assert values(spark, [3661, 360000], text.hh_mm_ss(F.col("s")), "s long") == ["01:01:01", "100:00:00"]
