"""Operators that deal groups of any size over the cluster: positions, chains, components, listings, settled changes."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from draftloom.functions import text as fn
from draftloom.operators import access, bitmap, geometry, graph, ingest, positions, sheets, titleblock
from draftloom.sources import listing
from draftloom.tables import dealt


def test_positions_with_a_hot_group(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 1, 1, 1, 2]), rnd.choice([None, *range(50)]), k) for k in range(600)]
    df = spark.createDataFrame(rows, "g int, v int, id int")
    key = lambda r: (r[1] is None, r[1] or 0, r[2])
    want = {r[2]: n for n, r in enumerate(sorted(rows, key=key), 1)}
    order = [F.col("v").asc_nulls_last(), "id"]
    placed = positions.with_positions(df, order)
    assert {r.id: r.pos for r in placed.collect()} == want and placed.columns == ["g", "v", "id", "pos"]
    grouped = {}
    for r in sorted(rows, key=key):
        grouped[r[2]] = grouped.get(("n", r[0]), 0) + 1
        grouped[("n", r[0])] = grouped[r[2]]
    assert {r.id: r.pos for r in positions.with_positions(df, order, by=["g"]).collect()} == {k: n for k, n in grouped.items() if isinstance(k, int)}
    plan = placed._jdf.queryExecution().toString()
    assert "Window" not in plan
    sums = {r.id: r.s for r in positions.running_sum(df, ["id"], "id", "s").collect()}
    assert sums == {k: k * (k + 1) // 2 for k in range(600)}
    seen = {r.id: r.w for r in positions.last_before(df, ["id"], "v", "w").collect()}
    last, want = None, {}
    for _, v, k in rows:
        want[k], last = last, v if v is not None else last
    assert seen == want
    assert positions.with_positions(df.limit(0), ["id"]).count() == 0
    assert [r.pos for r in positions.page(df, ["id"], 99, 50).orderBy("pos").collect()] == list(range(551, 601))


def test_boundaries_are_the_greedy_ones(spark, monkeypatch):
    monkeypatch.setattr(geometry, "CELL", 3)
    rnd = random.Random(2)
    rows = [(g, float(rnd.choice([rnd.randrange(-40, 40), rnd.randrange(0, 4000)]))) for g in (1, 1, 1, 2, 3) for _ in range(150)] + [(4, 7.0), (4, None)]
    got = {}
    for r in geometry.boundaries(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", 5.0).collect():
        got.setdefault(r.g, []).append(r.v)
    for g in (1, 2, 3, 4):
        kept = []
        for v in sorted({v for k, v in rows if k == g and v is not None}):
            if not kept or v - kept[-1] > 5:
                kept.append(v)
        assert sorted(got[g]) == kept


def test_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_tilted_rules_are_one(spark):
    tilted = [(1, 50 + y // 30, y) for y in range(120)]
    other = [(1, 80, y) for y in range(40)] + [(1, 80, y) for y in range(60, 100)] + [(1, 10, y) for y in range(4)] + [(2, 51, y) for y in range(30)]
    df = spark.createDataFrame(tilted + other, "page int, c int, y int")
    # strokes that follow each other without a row in common are rules of their own
    rules = sorted(tuple(r) for r in bitmap.ruling_lines(df, ["page"], "c", "y", F.lit(True), 20).collect())
    assert rules == [(1, 50.5, 0, 29, 1), (1, 51.5, 30, 59, 1), (1, 52.5, 60, 89, 1), (1, 53.5, 90, 119, 1), (1, 80.5, 0, 39, 1), (1, 80.5, 60, 99, 1), (2, 51.5, 0, 29, 1)]
    overlapping = spark.createDataFrame([(1, 50 + y // 30 + d, y) for y in range(120) for d in (0, 1)] + other, "page int, c int, y int")
    rules = sorted(tuple(r) for r in bitmap.ruling_lines(overlapping.distinct(), ["page"], "c", "y", F.lit(True), 20).collect())
    assert rules == [(1, 52.5, 0, 119, 5), (1, 80.5, 0, 39, 1), (1, 80.5, 60, 99, 1), (2, 51.5, 0, 29, 1)]


def test_lone_ones(spark):
    one = [("one", 20 + y // 40, y) for y in range(5, 65)] + [("one", 2, y) for y in range(80)]
    pixels = one + [("dash", x, 40) for x in range(10, 50)] + [("two", 20, y) for y in range(60)] + [("two", 40, y) for y in range(60)] + [("box", x, y) for x in range(10, 50) for y in range(10, 60)]
    df = spark.createDataFrame(pixels, "cell string, c int, y int").withColumn("rows", F.lit(80))
    assert [(r.cell, r.x) for r in bitmap.lone_ones(df, ["cell"], "c", "y", F.lit(True), F.col("rows")).collect()] == [("one", 20.5)]


def test_frames_of_entities(spark):
    rows = [
        (1, "LINE", False, [(0.0, 0.0), (400.0, 0.005)]), (1, "LINE", False, [(400.0, 280.0), (0.0, 280.0)]), (1, "LINE", False, [(0.0, 0.0), (0.0, 280.0)]), (1, "LINE", False, [(400.0, 0.0), (400.0, 280.0)]),
        (1, "LINE", False, [(5.0, 5.0), (300.0, 5.0)]), (1, "LWPOLYLINE", True, [(0.0, 0.0), (9.0, 0.0), (9.0, 4.0)]), (1, "ARC", False, [(0.0, 0.0), (999.0, 999.0)]),
        (2, "LINE", False, [(0.0, 0.0), (10.0, 0.0)]), (2, "LINE", False, [(0.0, 5.0), (10.0, 5.0)]), (2, "LINE", False, [(0.0, 0.0), (0.0, 5.0)]),
        (3, "INSERT", False, [(1.0, 2.0), (11.0, 7.0)]), (3, "POLYLINE", False, []),
    ]
    df = spark.createDataFrame(rows, "g int, kind string, closed boolean, points array<struct<x double, y double>>")
    got = {(r.g, r.origin, round(r.w, 3), round(r.h, 3)) for r in sheets.frame_candidates(df, "g").collect()}
    assert got == {(1, "polyline", 9.0, 4.0), (1, "level", 400.0, 280.0), (1, "upright", 400.0, 280.0), (3, "block", 10.0, 5.0)}


@pytest.mark.parametrize("seed", range(3))
def test_administrators_one_by_one(spark, seed):
    rnd = random.Random(seed)
    members = rnd.sample(range(4), rnd.randint(0, 2))
    changes = [(rnd.randrange(4), rnd.random() < 0.35, n) for n in range(60)]
    group, supers = set(members), set(members)
    for user, joins, _ in changes:
        if joins:
            group.add(user)
            supers.add(user)
        else:
            group.discard(user)
            if len(supers) > 1:
                supers.discard(user)
    got = access.settle_admins(spark.createDataFrame([(m,) for m in members], "user int"), spark.createDataFrame(changes, "user int, joins boolean, n int")).collect()
    assert {r.user for r in got if r.in_group} == group and {r.user for r in got if r.is_superuser} == supers


def test_listing_and_guarded_reading(spark, tmp_path):
    for name in ("a/one.pdf", "a/b/two.pdf", "top.dxf", "c/三.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    os.symlink("/etc/hostname", tmp_path / "a" / "out.pdf")
    os.symlink(tmp_path / "nowhere", tmp_path / "a" / "gone.pdf")
    for depth in (1, 2):
        rows = {r.path: (r.size, r.error) for r in listing.list_files(spark, str(tmp_path), depth).collect()}
        assert rows["a/b/two.pdf"] == (11, None) and rows["c/三.pdf"][1] is None and rows["top.dxf"][0] == 7
        assert rows["a/gone.pdf"] == (None, "FileNotFoundError") and len(rows) == 6
    assert {r.path: r.error for r in listing.list_files(spark, str(tmp_path / "none")).collect()} == {"": "FileNotFoundError"}
    asked = [("a/one.pdf",), ("a\\b\\two.pdf",), ("../top.dxf",), (str(tmp_path / "top.dxf"),), ("a/out.pdf",), ("no.pdf",), ("a",), (None,)]
    found = {r.path: (r.content and bytes(r.content).decode(), r.error) for r in listing.read_listed(spark.createDataFrame(asked, "path string"), str(tmp_path)).collect()}
    assert found["a/one.pdf"] == ("a/one.pdf", None) and found["a/b/two.pdf"] == ("a/b/two.pdf", None)
    assert {k: v[1] for k, v in found.items() if v[1]} == {"../top.dxf": "unsafe path", str(tmp_path / "top.dxf"): "unsafe path", "a/out.pdf": "unsafe path", "no.pdf": "FileNotFoundError", "a": "IsADirectoryError", None: "unsafe path"}


def test_nested_values_are_cleaned(spark):
    bad = {"a\x01b": [{"k\x1f": "x\x02y\b\f\t", "\\u0003": "\\\x04z"}, [["\x0b"], "\ud800", "😀", "\ude00"]], "n": 1.5}
    clean = {"ab": [{"k": "xy\t", "\\u0003": "\\z"}, [[""], "", "😀", ""]], "n": 1.5}
    df = spark.createDataFrame([(json.dumps(bad),), ("not json \x01",), (None,)], "j string")
    got = [r[0] for r in df.select(fn.clean_json(F.col("j"))).collect()]
    assert json.loads(got[0]) == clean and got[1:] == ["not json ", None]


def test_changes_in_runs_and_totals(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    runs = spark.createDataFrame([("a", at(0), at(90), 1), ("a", at(60), at(61), 2), ("b", at(0), at(10), 3)], "path string, started timestamp, ended timestamp, run int")
    changes = spark.createDataFrame([("a", at(0), 1), ("a", at(60), 2), ("a", at(90), 3), ("b", at(10), 4), ("c", at(1), 5)], "path string, at timestamp, id int")
    met = ingest.changed_in_runs(changes, runs)
    assert sorted((r.id, r.run) for r in met.collect()) == [(1, 1), (2, 1), (2, 2)] and met.columns == ["path", "at", "id", "started", "ended", "run"]
    totals = ingest.written_with_totals(changes, f"{tmp_path}/t", n=F.count("*"), last=F.max("id"), none=F.sum(F.when(F.lit(False), 1)))
    assert [tuple(r) for r in totals.collect()] == [(5, 5, None)] and spark.read.parquet(f"{tmp_path}/t").count() == 5


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_exploded_sides_are_never_broadcast(spark):
    g = spark.range(3).select(F.col("id").alias("g"))
    lines = g.select("g", F.explode(F.array(*[F.lit(float(x)) for x in (0, 10, 20, 30)])).alias("x"))
    assert "Broadcast" not in _plan(geometry.template_fits(lines, ["g"], [0.0, 10.0, 20.0], (0, 1), least=3))
    texts = F.explode(F.array(*[F.struct(F.lit(n).alias("id"), F.lit(t).alias("text"), F.lit(x).alias("x"), F.lit(0.0).alias("y"), F.lit(2.0).alias("h")) for n, (t, x) in enumerate([("NAME", 0.0), ("HOUSE", 9.0)])]))
    found = titleblock.from_labels(g.select("g", texts.alias("i")).select("g", "i.*"), "g")
    assert "Broadcast" not in _plan(found) and sorted(map(tuple, found.collect())) == [(n, "title", "HOUSE") for n in range(3)]


def test_rows_are_dealt_by_number(spark):
    parts = dealt(spark.range(1000), ["id"], 1000, each=50)
    assert parts.rdd.getNumPartitions() == 20 and parts.count() == 1000


def test_quantity_regions_sort_once(spark):
    ys = {1: [0.0, 8.0, 16.0, 24.0], 2: [0.0, 8.0, 8.5, 24.0], 3: [5.0], 4: [None, 0.0, 8.0, 16.0]}
    rows = spark.createDataFrame([(g, y, 3.0) for g, v in ys.items() for y in v], "g int, y double, h double")
    spans = spark.createDataFrame([(g, c, a, b) for g in ys for c, a, b in (("qty", 1.0, 2.0), ("qty2", 2.0, 4.0), ("name", 0.0, 1.0))], "g int, column string, lo double, hi double")
    found = geometry.quantity_regions(rows, ["g"], spans)
    plan = _plan(found)
    assert plan.count("Sort [g") <= 2 and "Broadcast" not in plan
    got = {}
    for r in found.orderBy("g", F.col("y").asc_nulls_first()).collect():
        assert (r.x0, r.x1) == (1.0, 4.0)
        got.setdefault(r.g, []).append((r.y, r.h))
    assert [y for y, _ in got[1]] == pytest.approx(ys[1]) and got[2] == [(y, 3.0) for y in ys[2]] and got[3] == [(5.0, 3.0)]
    assert [y for y, _ in got[4]] == ys[4]


def test_fits_of_lists_are_those_of_rows(spark):
    rnd = random.Random(5)
    edges, unit = [-20.0, 0.0, 50.0, 75.0, 110.0], (1, 2)
    lines = {g: sorted({round(30 + s * e + rnd.uniform(-3, 3), 2) for e in edges for s in (1.0, 1.02) if rnd.random() < 0.8} | {round(rnd.uniform(0, 200), 2)}) for g in range(40)}
    rows = spark.createDataFrame([(g, x) for g, xs in lines.items() for x in xs], "g int, x double")
    lists = spark.createDataFrame([(g, xs, "kept") for g, xs in lines.items()] + [(98, [], "kept"), (99, None, "kept")], "g int, xs array<double>, other string")
    want = sorted(tuple(r) for r in geometry.template_fits(rows, ["g"], edges, unit, least=0).collect())
    got = geometry.list_fits(lists, "xs", edges, unit).collect()
    assert sorted((r.g, pytest.approx(r.shift, abs=1e-4), pytest.approx(r.scale, abs=1e-6), r.hits) for r in got) == want and {r.other for r in got} == {"kept"}


def test_scans_are_not_shuffled_word_by_word(spark, sf_dir):
    from __spark_entry__ import queries

    plan = queries()["bom_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "scan-rows" not in plan and plan.count("ENSURE_REQUIREMENTS") <= 2
