"""Text, code and rule functions on small cases."""

import pytest
from pyspark.sql import functions as F

from draftloom.functions import rules
from draftloom.functions import text as fn


def values(spark, inputs, column):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, v string")
    return [r.out for r in df.select("k", column(F.col("v")).alias("out")).orderBy("k").collect()]


def test_normalisation(spark):
    assert values(spark, ["ｱ１ａ　", None, " ß x"], fn.norm) == ["ア1A", "", "SS X"]
    assert values(spark, ["ｱ１ａ　"], fn.norm_keep_case) == ["ア1a"]
    assert values(spark, ["名 称　/ 規格"], fn.header_key) == ["名称/規格"]
    assert values(spark, ["a\u0000b\tc\u001bd"], fn.strip_controls) == ["ab\tcd"]
    assert values(spark, ["%%c5 %%D %%p1 %%uX %%%"], fn.drawing_symbols) == ["φ5 ° ±1 X %"]


def test_codes(spark):
    texts = ["H B 0 0 2 2 X X X X", "A.B,0,0,1,2.3", "914X2443X0.25", "ab1234 AB1234 uh-3600-01", "1234567890", "0.35", "12345678901", None, "ＨＢ１２３４"]
    got = values(spark, texts, fn.find_codes)
    assert got == [["HB0022XXXX"], ["AB00123"], [], ["AB1234", "UH-3600-01"], ["1234567890"], [], [], [], ["HB1234"]]
    assert values(spark, ["HB0011XXXX", "UH-3600-01", "1234567890", "0277-X", "", "AB12"], fn.is_code) == [True, True, True, False, False, False]


def test_series_and_models(spark):
    codes = ["HB0022XXXX", "HDBY003920", "UH-3600-01", "UH-36001", "1234567890", "", "部品", "AB123"]
    got = [(s.prefix, s.series) for s in values(spark, codes, fn.series_of)]
    assert got == [("HB", "HB0022"), ("HDBY", "HDBY0039"), ("UH", "UH-3600"), ("UH", "UH-3600"), ("数字", "123456"), ("_", "_"), ("他", "部品"), ("AB", "AB123")]
    cases = {
        ("A/B/DXFCAK-40A PLAN.DXF", None): ("CAK", "CAK-40A"), ("JH MULTI/UH-3600.PDF", None): ("JH", "JH"), ("A/CAG/PDF-1/X.PDF", None): ("CAG", "CAG"),
        ("A/X.PDF", "JH-20 SPARE"): ("JH", "JH-20"), ("A/X.PDF", "SPARE"): ("SPARE", "SPARE"), ("A/X.PDF", ""): ("_", "_"), ("", None): ("_", "_"), ("SCAN-1/OLD/X", None): ("_", "_"),
    }
    df = spark.createDataFrame([(p, a) for p, a in cases], "p string, a string")
    rows = df.select("p", "a", fn.model_of(F.col("p"), F.col("a")).alias("m")).collect()
    assert {(r.p, r.a): (r.m.family, r.m.code) for r in rows} == cases


def test_file_names(spark):
    names = ["HB0022XXXX差替3 SPACER", "20-032 CAK-A FULL SET", "DXFCAK-40A HOUSE-221003", "PLAN UH-3600_B", "NOTHING"]
    got = [(f.rule, f.drawing_no, f.revision, f.title, f.job_no, f.model, f.drawn_date) for f in values(spark, names, fn.filename_fields)]
    assert got == [
        ("part", "HB0022XXXX", "3", "SPACER", "", "", ""), ("job", "", "", "FULL SET", "20-032", "CAK-A", ""),
        ("dated", "", "2022-10-03", "HOUSE", "", "CAK-40A", "2022-10-03"), ("", "UH-3600", "B", "", "", "", ""), ("", "", "", "", "", "", ""),
    ]


def test_numbers(spark):
    assert values(spark, ["1,234.5", "", "x", "nan", "123456789", "0.125", None], fn.number) == [1234.5, None, None, None, None, 0.12, None]
    assert values(spark, ["約 1,200.5 mm", "なし"], fn.first_quantity) == ["1200.5", ""]
    assert values(spark, ["1/30", "S=1:25", "NTS", "0/5"], fn.scale_denominator) == [30.0, 25.0, None, None]
    assert values(spark, ["I", "l2", "O7"], fn.ocr_item_no) == ["1", "12", "7"]


def test_keyword_suppression_and_notes(spark):
    assert values(spark, ["確認申請の件", "申請と確認申請", "なし"], lambda c: fn.hits(c, ["確認申請", "申請"])) == [["確認申請"], ["確認申請"], []]
    lines = F.array(F.lit("詳細は、HUCP101040 による"), F.lit("AB1234 参照 CD5678"), F.lit("EF9999"))
    df = spark.range(1).select(fn.note_refs(lines, ["による", "参照"], F.lit("CD5678")).alias("r"))
    assert df.first().r == ["HUCP101040", "AB1234"]


CASES = [
    # path, code, source, confidence, kind, text, pages, is_page -> type, reason
    (("A/契約書.PDF", "HB0001", "attrib", 0.97, "pdf", "", 1, False), ("contract", "file name: contract")),
    (("敷地/組立図.PDF", "", "text", 0.3, "pdf", "", 1, False), ("site", "folder: site")),
    (("A/組立図.PDF", "", "text", 0.3, "pdf", "見積 契約", 1, False), ("drawing", "file name: drawing")),
    (("A/X.PDF", "HB0001", "attrib", 0.97, "pdf", "工程表", 3, False), ("general", "several pages: body")),
    (("A/X.PDF", "HB0001", "attrib", 0.97, "pdf", "工程表", 3, True), ("drawing", "code")),
    (("A/X.PDF", "HB0001", "attrib", 0.97, "pdf", "", 2, False), ("other", "several pages")),
    (("物件対応ファイル他/X.PDF", "HB0001", "attrib", 0.97, "pdf", "図番 尺度", 1, False), ("drawing", "document folder: code and title block")),
    (("物件対応ファイル他/X.PDF", "HB0001", "attrib", 0.97, "pdf", "", 1, False), ("other", "document folder")),
    (("A/X.PDF", "HB0001", "text", 0.75, "pdf", "見積 契約", 1, False), ("drawing", "code")),
    (("A/X.PDF", "HB0001", "text", 0.6, "pdf", "見積 御中", 1, False), ("contract", "body")),
    (("A/X.DXF", "", "text", 0.3, "DXF", "見積", 1, False), ("drawing", "dxf")),
    (("A/X.PDF", "HB0001", "text", 0.6, "pdf", "見積", 1, False), ("drawing", "code, unsure")),
    (("A/X.PDF", "", "text", 0.3, "pdf", "SCALE 材質", 1, False), ("drawing", "title block")),
    (("A/X.PDF", "", "text", 0.3, "pdf", "見積", 1, False), ("other", "no hint")),
    (("A/X.PDF", None, None, None, None, " ", None, None), ("other", "no body")),
    ((None, None, None, None, None, None, None, None), ("other", "no body")),
]


@pytest.fixture(scope="module")
def classified(spark):
    schema = "k int, path string, code string, source string, confidence double, kind string, text string, pages int, is_page boolean"
    df = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(CASES)], schema)
    names = ("path", "code", "source", "confidence", "kind", "text", "pages", "is_page")
    return {r.k: tuple(r.f) for r in df.select("k", rules.classify(*map(F.col, names)).alias("f")).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_rule_cascade(classified, k):
    assert classified[k][:2] == CASES[k][1]


def test_words_of_rules(classified):
    words = {0: "契約書", 1: "敷地@敷地", 2: "組立図", 3: "工程表", 9: "見積・御中"}
    assert {k: w for k, (_, _, w) in classified.items() if w} == words


def test_folding_pages_and_queries(spark):
    assert values(spark, ["Straße", "ＡÉ", "ABC", ""], fn.casefold) == ["strasse", "ａé", "abc", ""]
    pages = spark.createDataFrame([(["a " + "x" * 7000, "  ", "ｂ\nc"],), ([],), (None,)], "p array<string>")
    got = [r.t for r in pages.select(fn.search_text(F.lit("n1"), pages=F.col("p")).alias("t")).collect()]
    assert got == ["N1 A " + "X" * 5998 + " B\nC", "N1", "N1"]
    assert values(spark, ["?q=a+b%2Fc&v=&q=%E5%9B%B3", "", "x", "%zz=1&k=a=b"], fn.query_values) == [{"q": "図", "v": ""}, {}, {"x": ""}, {"k": "a=b"}]


def test_manual_type_stays(spark):
    df = spark.createDataFrame([("site", True, "other"), ("site", False, "other"), ("site", None, None)], "c string, f boolean, n string")
    assert [r.t for r in df.select(rules.apply_type(F.col("c"), F.col("f"), F.col("n")).alias("t")).collect()] == ["site", "other", "other"]


def test_long_texts_reach_python_a_few_at_a_time(spark):
    df = spark.createDataFrame([("ｱ",), ("A B C D E F",), (None,)], "t string")
    found = df.select(fn.nfkc(F.col("t")).alias("n"), fn.compact_codes(F.col("t")).alias("c"), fn.casefold(F.col("t")).alias("f"))
    assert "ArrowEvalPython" not in found._jdf.queryExecution().sparkPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("ア", "ｱ", "ｱ"), ("A B C D E F", "ABCDEF", "a b c d e f"), ("", None, None)]
