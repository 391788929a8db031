"""Stored results, bulk actions, lists, exports and page layers on small tables."""

from pyspark.sql import functions as F

from draftloom.functions import text as fn
from draftloom.operators import admin, ingest, reports, search
from draftloom.sources import pdf

CHARS = "page int, span int, n int, c string, x0 double, x1 double, y double, size double"
RULES = "page int, x double, low double, high double"


def chars(text, page=1, span=1, step=6.0, y=20.0, skip=None):
    """Characters five wide every six; ``skip`` maps places to a further offset from there on."""
    out, x = [], 0.0
    for n, c in enumerate(text):
        x += (skip or {}).get(n, 0.0)
        out.append((page, span, n, c, x, x + 5, y, 10.0))
        x += step
    return out


def pieces(spark, rows, rules=()):
    got = pdf.text_pieces(spark.createDataFrame(rows, CHARS), spark.createDataFrame(list(rules), RULES), ["page"], "span").collect()
    return sorted((r["page"], r["span"], r["x"], r["text"], r["y"], r["h"]) for r in got)


def test_pieces_are_cut_at_gaps_and_rules(spark):
    assert pieces(spark, chars("ABCD", skip={2: 5.0})) == [(1, 1, 0.0, "ABCD", 20.0, 10.0)], "a gap of six is not more than 0.6 sizes"
    assert [p[3] for p in pieces(spark, chars("ABCD", skip={2: 5.1}))] == ["AB", "CD"]
    assert [p[3] for p in pieces(spark, chars("ABCD"), [(1, 11.5, 0.0, 30.0)])] == ["AB", "CD"]
    assert [p[3] for p in pieces(spark, chars("ABCD"), [(2, 11.5, 0.0, 30.0)])] == ["ABCD"], "a rule of another page"
    assert [p[3] for p in pieces(spark, chars("ABCD"), [(1, 11.5, 0.0, 22.0)])] == ["ABCD"], "a rule that ends below"
    assert [p[3] for p in pieces(spark, chars("ABCD"), [(1, 11.5, 0.0, 30.0), (1, 11.6, 0.0, 30.0)])] == ["AB", "CD"]


def test_blanks_start_no_piece(spark):
    assert [(p[2], p[3]) for p in pieces(spark, chars(" 　A B  "))] == [(12.0, "A B")]
    assert pieces(spark, chars("   ")) == []
    assert pieces(spark, []) == []
    assert [p[:2] for p in pieces(spark, chars("A") + chars("B", span=2) + chars("C", page=2))] == [(1, 1), (1, 2), (2, 1)]


def test_rule_across_bins(spark):
    rows = chars("ABCDEFGH")
    for k in range(1, 8):
        x = rows[k - 1][5] + 0.5
        assert [p[3] for p in pieces(spark, rows, [(1, x, 0.0, 30.0)])] == ["ABCDEFGH"[:k], "ABCDEFGH"[k:]]


def test_vertical_rules(spark):
    rows = [("l", 1.0, 2.0, 1.2, 9.0), ("l", 1.0, 2.0, 1.4, 9.0), ("l", 1.0, 2.0, 1.0, 2.4), ("re", 3.0, 4.0, 8.0, 6.0), ("c", 1.0, 2.0, 1.0, 9.0)]
    paths = spark.createDataFrame([(7, *r, 10.0) for r in rows], "page int, kind string, x0 double, y0 double, x1 double, y1 double, height double")
    assert sorted(map(tuple, pdf.vertical_rules(paths, ["page"]).collect())) == [(7, 1.0, 1.0, 8.0), (7, 3.0, 4.0, 6.0), (7, 8.0, 4.0, 6.0)]


def test_complete(spark):
    jobs = spark.createDataFrame([(1, "a", "running", "x"), (2, "b", "queued", "x"), (3, "c", "running", "x"), (4, "a", "running", "x")], "id int, path string, state string, error string")
    files = spark.createDataFrame([(p, "", "pending", "e") for p in "abc"], "path string, sha256 string, status string, error string")
    drawings = spark.createDataFrame([(p, n, "old") for p in "abc" for n in (1, 2)], "path string, page_no int, drawing_no string")
    results = spark.createDataFrame(
        [(1, 1, "s1", [(1, "A"), (2, "A2")]), (4, 1, "s4" + "z" * 80, [(None, "N"), (3, "first"), (3, "last")]), (4, 2, "late", [(9, "late")]), (2, 1, "s2", [(1, "B")]), (3, 1, None, []), (8, 1, "s8", [(1, "?")])],
        "job_id int, at int, sha256 string, entries array<struct<page_no: int, drawing_no: string>>",
    )
    j, f, d = ingest.complete(jobs, files, drawings, results)
    assert sorted(map(tuple, j.collect())) == [(1, "a", "done", ""), (2, "b", "queued", "x"), (3, "c", "done", ""), (4, "a", "done", "")]
    assert sorted(map(tuple, f.collect())) == [("a", ("s4" + "z" * 80)[:64], "done", ""), ("b", "", "pending", "e"), ("c", "", "done", "")]
    assert sorted(map(tuple, d.collect())) == [("a", 1, "N"), ("a", 3, "last"), ("b", 1, "old"), ("b", 2, "old")]


def test_bulk_actions(spark):
    terms = spark.createDataFrame([("a", "x", False), ("b", "x", True), ("c", "y", False)], "term string, canonical string, approved boolean")
    chosen = spark.createDataFrame([("a", "x"), ("a", "x"), ("z", "z")], "term string, canonical string")
    assert sorted(map(tuple, admin.approve(terms, chosen).collect())) == [("a", "x", True), ("b", "x", True), ("c", "y", False)]
    jobs = spark.createDataFrame([(1, "done", 3, "e"), (2, "failed", 3, "e")], "id int, state string, attempts int, error string")
    assert sorted(map(tuple, admin.reset(jobs, jobs.where("id = 2")).collect())) == [(1, "done", 3, "e"), (2, "queued", 0, "")]
    drawings = spark.createDataFrame([(1, "drawing", False), (2, "drawing", False), (3, "other", True), (4, "other", False)], "id int, doc_type string, doc_type_fixed boolean")
    edits = spark.createDataFrame([(1, "other", 1), (1, "contract", 2), (2, "drawing", 1), (3, "other", 1)], "id int, doc_type string, at int")
    assert sorted(map(tuple, admin.fix_type(drawings, edits).collect())) == [(1, "contract", True), (2, "drawing", False), (3, "other", True), (4, "other", False)]


def test_listing_order_and_missing(spark):
    rows = [(1, "B", "2", "pdf", "done"), (2, "B", "1", "dxf", "done"), (3, "A", "9", "pdf", "missing"), (4, "B", "1", "pdf", "error"), (5, "", "", "pdf", "done")]
    df = spark.createDataFrame(rows, "id int, drawing_no string, revision string, kind string, status string")
    assert [r["id"] for r in search.listing(df).collect()] == [5, 2, 4, 1]
    assert [r["id"] for r in search.listing(df, "pdf").collect()] == [5, 4, 1]
    assert [r["id"] for r in search.listing(df, "doc").collect()] == [5, 2, 4, 1], "an unknown kind is no filter"


def test_export_takes_the_first_drawings_that_have_rows(spark, monkeypatch):
    monkeypatch.setattr(reports, "EXPORT_DRAWINGS", 2)
    drawings = spark.createDataFrame([(1, "C", "t", "m"), (2, "A", "t", "_"), (3, "B", "t", "m"), (4, "A", "t", "m")], "id int, drawing_no string, title string, model string")
    rows = spark.createDataFrame([(1, 1, "", 0.9), (3, 2, None, 0.8), (3, 1, "7", 0.7999), (2, 1, "", 1.0)], "drawing int, row int, item_no string, confidence double")
    got = [(r["id"], r["model"], r["row"], r["item_no"], r["is_low"], r["confidence"]) for r in reports.export_rows(drawings, rows).collect()]
    assert got == [(2, "", 1, "1", False, 1.0), (3, "m", 1, "7", True, 0.8), (3, "m", 2, "2", False, 0.8)]


def test_page_title(spark):
    df = spark.createDataFrame([("own", "set"), ("", "set"), (None, None)], "own string, title string")
    assert [r[0] for r in df.select(fn.page_title(F.col("own"), F.col("title"), F.lit(2), F.lit(5))).collect()] == ["own", "set（2/5）", "（2/5）"]
