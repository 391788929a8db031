"""Part tables from made-up layouts."""

import pytest
from pyspark.sql import functions as F

from draftloom.functions import text as fn
from draftloom.operators import bom, scans

HEAD = [("NO.", 2), ("図 番 又 は 品 番", 16), ("名称/規格", 66), ("員 数", 121), ("材質", 141), ("厚さ", 161), ("幅", 181), ("長さ", 201)]
COLUMNS = ("item_no", "part_no", "name", "qty", "material", "thickness", "width", "length")
EDGES = [-3, 14, 64, 119, 139, 159, 179, 199, 225]


def text(t, x, y, h=3.0):
    return {"text": t, "x": float(x), "y": float(y), "h": h}


def table(rows, up=True, ruled=False, x0=0.0, y0=0.0):
    items = [text(t, x0 + x, y0) for t, x in HEAD]
    for n, row in enumerate(rows, 1):
        y = y0 + 8 * n * (1 if up else -1)
        items += [text(v, x0 + x, y) for v, (_, x) in zip(row, HEAD) if v]
    low, high = (y0 - 3, y0 + 4 + 8 * len(rows)) if up else (y0 - 4 - 8 * len(rows), y0 + 3)
    return items, [(x0 + x, low, high) for x in EDGES] if ruled else []


ROWS = [
    ("1", "QRST004410", "フレーム", "2", "", "", "", ""),
    ("2", "P", "板-900×2400", "1", "C01", "0.25", "900.00", "2400"),
    ("3", "0411-TAPE-W", "ﾃｰﾌﾟ/18×50", "12", "", "", "", ""),
]


def cells(rows):
    return [tuple(r[c] for c in COLUMNS) for r in rows]


@pytest.mark.parametrize("up", [True, False])
@pytest.mark.parametrize("ruled", [True, False])
def test_both_directions_with_and_without_rules(up, ruled):
    items, rules = table(ROWS, up, ruled)
    rows = bom.extract(items, rules)
    assert cells(rows) == [(*r[:2], bom.clean(r[2]), *r[3:]) for r in ROWS]
    assert [r["ref_drawing_no"] for r in rows] == ["QRST004410", "", ""]
    assert [r["confidence"] for r in rows] == [0.9, 1.0, 0.9]


def test_what_is_around_a_table_is_not_read():
    items, rules = table(ROWS, ruled=True)
    around = [text("注記：溶接のこと", 10, 60), text("8", 40, 50), text("適用型式又は特記", 20, -9), text("製図", 60, -9), text("QRST000001", 150, -20)]
    assert cells(bom.extract(items + around, rules)) == cells(bom.extract(items, rules))
    assert bom.extract([text("注記", 0, 0), text("名称", 50, 40)]) == []
    assert bom.extract([]) == []


def test_second_lines_lone_numbers_and_lone_quantities():
    items, rules = table(ROWS, ruled=True)
    more = [text("4", 2, 33.5), text("X", 16, 32), text("塗料", 66, 32), text("下塗り", 66, 36), text("7", 121, 28.5)]
    items += more
    rules = [(x, a, b + 12) for x, a, b in rules]
    row = bom.extract(items, rules)[-1]
    assert (row["item_no"], row["part_no"], row["name"], row["qty"]) == ("4", "X", "下塗り 塗料", "7")


def test_continued_tables_come_in_order_and_once():
    a, ra = table(ROWS[:2], ruled=True)
    b, rb = table([ROWS[2], ROWS[0]], ruled=True, x0=-300.0, y0=-30.0)
    rows = bom.extract(a + b, ra + rb)
    assert [r["item_no"] for r in rows] == ["1", "2", "3"]


def test_branch_quantities_become_a_note():
    items, rules = table([("1", "P/X", "板", "", "", "", "", "100")], ruled=True)
    rules += [(x, -3, 12) for x in (124, 129, 134)]
    items += [text("3", 125, 8), text("5", 135, 8)]
    row = bom.extract(items, rules)[0]
    assert (row["qty"], row["note"], row["length"]) == ("3", "枝番別の員数: - / 3 / - / 5", "100")


def words_frame(spark, lines):
    """Words of OCR lines as rows. lines: lists of (text, x, y, w, h)."""
    rows = [(1, k, n, *map(str, word[:1]), *map(float, word[1:])) for k, line in enumerate(lines) for n, word in enumerate(line)]
    return spark.createDataFrame(rows, "g int, line int, n int, text string, x double, y double, w double, h double")


def rules_frame(spark, rules):
    return spark.createDataFrame([(1, *map(float, r)) for r in rules], "g int, x double, low double, high double")


def test_ocr_lines_are_cut_at_rules(spark):
    items, rules = table(ROWS, ruled=True)
    lines = [[(w, i.x + 0.01 * n, i.y, i.w, i.h) for i in line for n, w in enumerate(i.text.split())] for line in bom.lines_of(bom.to_items(items))]
    found = scans.word_cells(words_frame(spark, lines), rules_frame(spark, rules), ["g"]).collect()
    assert cells(bom.extract([r.asDict() for r in found], rules)) == cells(bom.extract(items, rules))


def test_scans_are_read_by_the_form(spark):
    h, unit = 8.0, 1.01
    at = lambda e: 70 + unit * e
    word = lambda t, x, y: [(t, x, y, 5.0 * len(t), h)]
    rules = [(at(e), 100.0, 280.0) for e in (-24, -12, 0, 118, 296, 362, 380)] + [(at(e), 110.0, 280.0) for e in (314, 326, 409, 444)]
    items = [word("図番双は&番", at(20), 104.0), word("Q.R.S.T.0.0.4.4.1.0", at(1), 121.0), word("I", at(-10), 123.0), word("テスト", at(120), 121.0), word("2", at(300), 121.0)]
    items += [word("12QRSTO04411", at(-11), 137.0), word("テスト板", at(120), 137.0), word("C02", at(364), 137.0), word("QRST00442.0", at(1), 153.0), word("部品", at(120), 153.0)]
    rows = scans.form_rows(words_frame(spark, items), rules_frame(spark, rules), ["g"]).orderBy("row").collect()
    assert [(r["item_no"], r["part_no"], r["name"], r["qty"], r["material"]) for r in rows] == [
        ("1", "QRST004410", "テスト", "2", ""), ("2", "QRST004411", "テスト板", "", "C02"), ("3", "QRST004420", "部品", "", ""),
    ]
    assert [(r.row, r.ref_drawing_no, r.confidence) for r in rows] == [(1, "QRST004410", 0.9), (2, "QRST004411", 0.9), (3, "QRST004420", 0.8)]


def test_a_part_that_runs_into_its_name_is_cut(spark):
    rules = [(70 + e, 100.0, 200.0) for e in (-24, -12, 0, 118, 296, 362, 380, 409)]
    lines = [[("12", 60.0, 121.0, 8.0, 8.0)], [("QRST004410テスト板", 130.0, 121.0, 18 * 6.5, 8.0)], [("3", 370.0, 121.0, 5.0, 8.0)]]
    row = scans.form_rows(words_frame(spark, lines), rules_frame(spark, rules), ["g"]).first()
    assert (row.part_no, row["name"], row.qty) == ("QRST004410", "テスト板", "3")


def test_form_needs_its_edges(spark):
    place = lambda edges: scans.form_places(rules_frame(spark, [(e, 0.0, 200.0) for e in edges]).withColumn("h", F.lit(8.0)), ["g"]).collect()
    found = place([500 + e for e in (-24, -10, 0, 119, 330, 409, 444)])
    assert [(round(r.shift), round(r.scale, 1), r.head, r.top) for r in found] == [(500, 1.0, 12.0, 200.0)]
    assert place([500, 560, 700, 745, 760, 900, 930, 1000]) == []


def test_ocr_repairs(spark):
    codes = {"HB.C.1.D.5.0.0.1.1": "HBCID50011", "004400.8.0.0.2": "0044008002", "HBXPO20244": "HBXP020244", "0411-NO.5X18W": "0411-NO.5X18W", "HBXP.020244": "HBXP020244", "ABC123456|": "ABC123456"}
    df = spark.createDataFrame([(c,) for c in codes], "t string")
    assert {r.t: r.c for r in df.select("t", scans.repaired_code(F.col("t")).alias("c")).collect()} == codes
    numbers = spark.createDataFrame([(x,) for x in ("I", "04", "|", "13", "O", "x")], "t string")
    assert [r.c for r in numbers.select(fn.ocr_item_no(F.col("t")).alias("c")).collect()] == ["1", "4", "1", "13", "0", ""]


def test_parent_assembly(spark):
    items = [text("組 立 図 番", 0, 0), text("QRST000010 1", -2, 6), text("QRST000099", 80, 0), text("QRST000011", 0, -8)]
    assert bom.assembly_refs(items) == ["QRST000010"]
    assert bom.assembly_refs(items, "QRST000010") == []
    rows = [(1, 0, "組立図番", 0.0, 0.0, 32.0, 8.0), (1, 1, "Q.R.S.0.0,1.2,0,4.41", 0.0, 9.0, 90.0, 8.0), (1, 2, "QRS0099999", 300.0, 0.0, 50.0, 8.0)]
    df = spark.createDataFrame(rows, "g int, cell int, text string, x double, y double, w double, h double")
    assert [(r.place, r.code) for r in scans.parent_codes(df, ["g"], bom.ASSEMBLY_LABEL).collect()] == [(1, "QRS0012044")]
    assert scans.parent_codes(df, ["g"], bom.ASSEMBLY_LABEL, "QRS0012044").count() == 0


def test_rows_of_a_table_of_drawings(spark):
    from draftloom.sources import dxf

    items, rules = table(ROWS, ruled=True)
    full = [i | {"w": None, "conf": None, "tokens": None} for i in items]
    lines = [{"x": float(x), "y0": float(a), "y1": float(b)} for x, a, b in rules]
    schema = f"drawing_id long, items array<{dxf.ITEM}>, vlines array<struct<x double, y0 double, y1 double>>"
    df = spark.createDataFrame([(1, full, lines), (2, full, None), (3, None, None), (4, [], [])], schema)
    rows = bom.extract_rows(df).orderBy("drawing_id", "row").collect()
    assert [(r.drawing_id, r.row, r.part_no) for r in rows] == [(d, n + 1, r[1]) for d in (1, 2) for n, r in enumerate(ROWS)]
    assert {r.part_no: float(r.qty) for r in bom.summed_quantity(bom.extract_rows(df)).collect()} == {"QRST004410": 4, "P": 2, "0411-TAPE-W": 24}


def test_fields_come_as_flat_arrays(spark):
    items, rules = table(ROWS, ruled=True)
    schema = "drawing_id int, items array<struct<text string, x double, y double, h double>>, vlines array<struct<x double, y0 double, y1 double>>"
    df = spark.createDataFrame([(1, [(i["text"], i["x"], i["y"], i["h"]) for i in items] + [None], rules), (2, [], []), (3, None, None), (4, [(i["text"], i["x"], i["y"], i["h"]) for i in items], None)], schema)
    found = bom.extract_rows(df)
    assert "tokens" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.drawing_id, r.row, r.part_no) for r in found.collect()) == [(d, n, r[1]) for d in (1, 4) for n, r in enumerate(ROWS, 1)]
