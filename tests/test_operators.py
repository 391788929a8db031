"""Operators on small cases that the tables do not have."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftloom.operators import access, bitmap, browse, geometry, ingest, relations, search, titleblock
from draftloom.sources import dxf, files
from draftloom.streaming import scan


def test_synonyms_and_visibility(spark):
    words = spark.createDataFrame([("A",), ("z",), ("",)], "word string")
    known = spark.createDataFrame([("a", "one", True), ("b", "One", True), ("c", "one", False), ("q", "two", True)], "term string, canonical string, approved boolean")
    assert {tuple(r) for r in search.expand_terms(words, known).collect()} == {("a", "a"), ("a", "one"), ("a", "b"), ("z", "z")}
    docs = spark.createDataFrame([("x 100% B",), ("b c",), ("one_two",)], "t string")
    assert search.search(docs, F.col("t"), ["a", "100%"], known).count() == 1
    assert search.search(docs, F.col("t"), ["a"], known).count() == 3
    many = docs.where(search.contains_all(F.lower("t"), [["b", *[f"z{k}" for k in range(99)]]]))
    assert many.count() == 2
    typed = spark.createDataFrame([("drawing",), ("contract",), (None,)], "doc_type string")
    assert [search.visible(typed, lv).count() for lv in ("Admin", "User", "Guest", "?")] == [3, 3, 1, 1]
    people = spark.createDataFrame([(["User"], False), (["Admin", "User"], False), ([], True), ([], False)], "g array<string>, s boolean")
    assert [r.v for r in people.select(search.level_of(F.col("g"), F.col("s")).alias("v")).collect()] == ["User", "Admin", "Admin", "Guest"]


def test_audit_and_groups(spark):
    log = access.audit(spark.createDataFrame([(7, "a/b")], "user long, target string"), "view", F.lit(dt.datetime(2024, 1, 1)))
    assert tuple(log.first())[:3] == (7, "view", "a/b")
    members = spark.createDataFrame([(1, "User"), (2, "Admin")], "user long, group string")
    assert {tuple(r) for r in access.set_group(members, 1, "Guest").collect()} == {(1, "Guest"), (2, "Admin")}
    assert {tuple(r) for r in access.set_group(members, 2, "User").collect()} == {(1, "User"), (2, "Admin")}


def test_pages_and_trees(spark):
    df = spark.range(120).withColumnRenamed("id", "n")
    assert [r.n for r in browse.page_rows(df, [F.col("n")], 2).orderBy("n").collect()] == list(range(50, 100))
    assert [r.n for r in browse.page_rows(df, [F.col("n")], 9).orderBy("n").collect()] == list(range(100, 120))
    assert browse.page_numbers(5, 20) == [1, None, 3, 4, 5, 6, 7, None, 20] and browse.page_numbers(1, 1) == [1]
    names = spark.createDataFrame([(s,) for s in ("a10", "a9", "10", "9x", "b", "")], "s string")
    assert [r.s for r in names.orderBy(browse.natural_key(F.col("s"))).collect()] == ["", "9x", "10", "a9", "a10", "b"]
    counts = spark.createDataFrame([("p", f"c{k}", k) for k in range(5)], "p string, c string, n long")
    assert {tuple(r) for r in browse.capped_children(counts, "p", "c", ["c4"], 2).collect()} == {("p", "c0", 0), ("p", "c1", 1), ("p", "c4", 4), ("p", "(more)", 2)}
    paths = spark.createDataFrame([("a/b/c",), ("a/d",), ("e",), ("",)], "p string")
    assert {tuple(r) for r in browse.folder_children(paths, F.col("p"), "a").collect()} == {("b", 1)}
    assert {tuple(r) for r in browse.folder_children(paths, F.col("p"), "").collect()} == {("a", 2)}


def test_relations_by_code(spark):
    drawings = spark.createDataFrame([(1, "A1", ["N1"], []), (2, "B2", [], ["A1"]), (3, "N1", [], []), (4, "", [], [])], "id long, drawing_no string, note_refs array<string>, assembly_refs array<string>")
    bom = spark.createDataFrame([(1, "B2", ""), (1, "Z9", ""), (1, "A1", "A1"), (3, "", "B2")], "id long, ref_drawing_no string, part_no string")
    assert {tuple(r) for r in relations.uses(drawings, drawings, bom).collect()} == {(1, "B2", "bom", 2), (1, "Z9", "bom", None), (1, "A1", "bom", None), (1, "N1", "note", 3)}
    got = {(r.id, r.user_id, r.kind) for r in relations.used_by(drawings, drawings, bom).collect()}
    assert got == {(2, 1, "bom"), (2, 3, "bom"), (3, 1, "note")}
    hidden = drawings.where("id <> 1")
    assert {(r.id, r.user_id) for r in relations.used_by(drawings, hidden, bom).collect()} == {(2, 3)}


def test_snapshots(spark):
    at = dt.datetime(2024, 1, 1)
    ms = dt.timedelta(milliseconds=1)
    known = spark.createDataFrame([("a", 1, at, "done", 5), ("b", 1, at, "missing", 5), ("c", 1, at, "done", None), ("d", 1, at, "done", 5), ("e", 1, at, "done", 5)], "path string, size long, mtime timestamp_ntz, status string, last_seen long")
    seen = spark.createDataFrame([("a", 1, at + 999 * ms), ("b", 1, at), ("d", 1, at + 1000 * ms), ("e", 2, at), ("f", 1, at)], "path string, size long, mtime timestamp_ntz")
    assert {r.path: r.change for r in ingest.snapshot_diff(known, seen).collect()} == {"a": "unchanged", "b": "changed", "c": "absent", "d": "changed", "e": "changed", "f": "created"}
    files_now = ingest.upsert(known, seen, F.lit(9).cast("long"))
    assert {r.path: (r.status, r.last_seen) for r in files_now.collect()} == {"a": ("done", 9), "b": ("pending", 9), "c": ("done", None), "d": ("pending", 9), "e": ("pending", 9), "f": ("pending", 9)}
    assert {r.path for r in ingest.mark_missing(known, F.lit(6), True).where("status = 'missing'").collect()} == {"a", "b", "d", "e"}
    assert ingest.mark_missing(known, F.lit(6), False).where("status = 'missing'").count() == 1
    crawl = spark.createDataFrame([("\\x\\a.PDF", 1, at), ("/b.dxf", 2, at), ("c.txt", 3, at), ("d.pdf", None, at)], "path string, size long, mtime timestamp_ntz")
    assert {(r.path, r.kind) for r in ingest.accepted(crawl).collect()} == {("x/a.PDF", "pdf"), ("b.dxf", "dxf")}


def test_job_state_machine():
    run = lambda actions: __import__("functools").reduce(lambda s, a: scan.advance(*s, a), actions, ("queued", 0))
    assert run(["claim", "done"]) == ("done", 1)
    assert run(["claim", "fail"] * 3) == ("failed", 3)
    assert run(["done", "fail"]) == ("queued", 0)
    assert run(["claim", "fail"] * 3 + ["requeue", "claim"]) == ("running", 4)


def settled(events, now):
    """{job: (state, attempts, since)} of events (job, action, at, event) up to ``now``, one after another."""
    out = {}
    for job, action, at, _ in sorted(events, key=lambda e: (e[2], e[3])):
        if at > now:
            break
        was = scan.leased(out.get(job, ("queued", 0, -1)), at)
        state, attempts = scan.advance(was[0], was[1], action)
        out[job] = was if (state, attempts) == was[:2] else (state, attempts, at)
    return {job: found for job, found in ((j, scan.leased(v, now)) for j, v in out.items()) if found[2] >= 0}


@pytest.mark.parametrize("files", [1, 7])
def test_streamed_states_do_not_depend_on_micro_batches(spark, tmp_path, files):
    """Events that are out of order by up to 50 minutes, within and across micro-batches of a file each; leases end between them."""
    rnd = random.Random(files)
    start = 1_700_000_000_000_000
    events = [(rnd.randrange(12), rnd.choice(["claim", "claim", "done", "fail", "requeue"]), start + k * 240_000_000 + rnd.randrange(240_000_000), k) for k in range(400)]
    arrivals = sorted(events, key=lambda e: e[2] + rnd.randrange(50 * 60_000_000))
    size = -(-len(arrivals) // files)
    for n in range(files):
        df = spark.createDataFrame(arrivals[n * size : (n + 1) * size], "job long, action string, us long, event long")
        df.select("job", "action", F.timestamp_micros("us").alias("at"), "event").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("job long, action string, at timestamp, event long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    with scan.with_timers(spark):
        rows = scan.drained(scan.job_states(stream), "job", f"{tmp_path}/out").collect()
    now = (max(e[2] for e in events) // 1_000 - 3_600_000) * 1_000 + 999
    assert {r.job: tuple(r)[1:] for r in rows} == settled(events, now)


def test_greedy_boundaries_and_votes(spark):
    one = spark.createDataFrame([(1, v) for v in (3.0, 1.0, 1.5, 2.4, 2.6)], "g int, v double")
    assert sorted(r.v for r in geometry.boundaries(one, ["g"], "v", 1.0).collect()) == [1.0, 2.4]
    rows = spark.createDataFrame([(1, 4, 0), (1, 5, 1), (1, 9, 2), (2, 7, 0), (3, None, 0)], "g int, n int, p int")
    assert {r.g: (r["shift"], r.votes) for r in geometry.vote_offset(rows, ["g"], F.col("n"), F.col("p")).collect()} == {1: (4, 2), 2: (1, 1)}


def test_title_block_labels_and_precedence(spark):
    items = [(1, 0, "DRAWING NO", 0.0, 0.0, 2.0), (1, 1, "12", 5.0, 0.0, 2.0), (1, 2, "名称：屋根", 0.0, 30.0, 2.0), (2, 0, "材質", 0.0, 0.0, 2.0), (2, 1, "製図", 4.0, 0.0, 2.0), (2, 2, "SS400", 9.0, -3.0, 2.0)]
    df = spark.createDataFrame(items, "k int, id int, text string, x double, y double, h double")
    assert {tuple(r) for r in titleblock.from_labels(df, "k").collect()} == {(1, "sheet_no", "12"), (1, "title", "屋根"), (2, "material", "SS400")}
    tags = spark.createDataFrame([(1, 0, "rev", " "), (1, 1, "改訂", "B"), (1, 2, "DWG_NO", "HB1"), (1, 3, "図番", "HB2"), (1, 4, "x", "y")], "k int, pos int, tag string, text string")
    assert {tuple(r) for r in titleblock.from_attributes(tags, "k").collect()} == {(1, "revision", "B"), (1, "drawing_no", "HB1")}


def _dxf(entities, blocks="", codepage=""):
    pairs = lambda *p: "".join(f"{c}\n{v}\n" for c, v in p)
    head = pairs((0, "SECTION"), (2, "HEADER")) + (pairs((9, "$DWGCODEPAGE"), (3, codepage)) if codepage else "") + pairs((0, "ENDSEC"))
    body = "".join(pairs(*e) for e in entities)
    return head + pairs((0, "SECTION"), (2, "BLOCKS")) + blocks + pairs((0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES")) + body + pairs((0, "ENDSEC"), (0, "EOF"))


def test_drawing_files(spark, tmp_path):
    entity = [
        [(0, "TEXT"), (10, 1.0), (20, 2.0), (40, 2.5), (1, "%%c5 図番図番図番図番図番図番図番図番")], [(0, "MTEXT"), (10, 0.0), (20, 9.0), (40, 1.0), (1, "{\\fArial;one}\\Ptwo")],
        [(0, "LINE"), (10, 5.0), (20, 0.0), (11, 5.0), (21, 8.0)], [(0, "LINE"), (10, 5.0), (20, 0.0), (11, 9.0), (21, 0.0)],
        [(0, "INSERT"), (2, "B"), (10, 100.0), (20, 10.0), (41, 2.0), (42, 2.0)], [(0, "ATTRIB"), (2, "REV"), (1, "C"), (10, 0.0), (20, 0.0)],
        [(0, "LWPOLYLINE"), (70, 1), (10, 0.0), (20, 0.0), (10, 0.0), (20, 4.0), (10, 3.0), (20, 4.0), (10, 3.0), (20, 0.0)],
    ]
    block = "0\nBLOCK\n2\nB\n0\nTEXT\n10\n1\n20\n1\n40\n1\n1\ninner\n0\nENDBLK\n"
    (tmp_path / "Ａ").mkdir()
    (tmp_path / "Ａ" / "x.dxf").write_bytes(_dxf(entity, block).encode("cp932"))
    (tmp_path / "Ａ" / "bad.dxf").write_bytes(b"0\nSECTION\n2\nENTITIES\n0\nTEXT\n10\nnot a number\n1\nx\n")
    (tmp_path / "top.pdf").write_bytes(b"%PDF")
    rows = {r.path.rsplit("/", 1)[1]: r for r in dxf.load(spark, str(tmp_path)).collect()}
    x = rows["x.dxf"]
    assert [(i.text, i.x, i.y, i.h) for i in x["items"]] == [("φ5 図番図番図番図番図番図番図番図番", 1.0, 2.0, 2.5), ("one", 0.0, 9.0, 1.0), ("two", 0.0, 7.5, 1.0), ("inner", 102.0, 12.0, 2.0), ("C", 0.0, 0.0, 1.0)]
    assert sorted((v.x, v.y0, v.y1) for v in x.vlines) == [(0.0, 0.0, 4.0), (3.0, 0.0, 4.0), (5.0, 0.0, 8.0)]
    assert [(a.tag, a.text, a.block) for a in x.attributes] == [("REV", "C", "B")]
    assert rows["bad.dxf"].error.startswith("ValueError") and rows["bad.dxf"]["items"] == []
    assert sorted(r.path for r in files.crawl(spark, str(tmp_path)).collect()) == ["top.pdf", "Ａ/bad.dxf", "Ａ/x.dxf"]
    assert sorted(r.path for r in files.crawl(spark, str(tmp_path), include=["a"], exclude=["/bad"]).collect()) == ["Ａ/x.dxf"]
    assert [r.ok for r in spark.createDataFrame([("a/b",), ("/a",), ("a/../b",)], "p string").select(files.is_safe(F.col("p")).alias("ok")).collect()] == [True, False, False]


def test_bitmaps(spark):
    def pixels(bitmap):
        rows, columns = np.nonzero(bitmap)
        return spark.createDataFrame([(1, int(c), int(r)) for r, c in zip(rows, columns)], "page int, c int, y int")

    page = np.zeros((600, 400), bool)
    page[100:500, 50:53] = True
    for r in range(100, 500):
        page[r, 200 + (r - 100) // 100 : 203 + (r - 100) // 100] = True
    page[10:20, 300] = True
    least = int(bitmap.LEAST_MM * 150 / bitmap.MM_PER_INCH)
    rules = bitmap.ruling_lines(pixels(page), ["page"], "c", "y", F.lit(True), least).collect()
    assert sorted((r.x, r["first"], r["last"]) for r in rules) == [(51.5, 100, 499), (203.0, 100, 499)]
    cell = np.zeros((60, 100), bool)
    ones = lambda: [r.x for r in bitmap.lone_ones(pixels(cell), ["page"], "c", "y", F.lit(True), F.lit(60)).collect()]
    cell[:, 5] = True
    assert ones() == []
    cell[15:48, 60:64] = True
    assert ones() == [61.5]
    cell[20:40, 80:99] = True
    assert ones() == []


def test_used_by_moves_no_pairs(spark):
    """As all pairs with a small limit, and drawings with their users are not shuffled: they are made of lists after the last exchange."""
    rows = [(k, ["", None, "A", "B", "C", "D"][k % 6], [["A"], ["B", "A"], [], [""], ["D"]][k % 5], [["A"], [], ["B", "C", "B"], ["D"]][k % 4]) for k in range(40)]
    drawings = spark.createDataFrame(rows, "id long, drawing_no string, note_refs array<string>, assembly_refs array<string>")
    table = [(k, "ABCD"[k * k % 4] if k % 3 else "", "ABCD"[k % 4] if k % 2 else "") for k in range(40)] * 2
    bom = spark.createDataFrame(table, "id long, ref_drawing_no string, part_no string")
    visible = {k for k in range(40) if k % 7}
    for limit in (3, 100):
        got = relations.used_by(drawings, drawings.where("id % 7 <> 0"), bom, limit)
        want = set()
        for i, code, _, refs in rows:
            users = {}
            for u, number, notes, _ in rows:
                kinds = [0] * any(code and u == b and code in (r, p) for b, r, p in table) + [1] * bool(code and code in notes) + [2] * bool(number and number in refs)
                if u != i and u in visible and kinds:
                    users[u] = (min(kinds), number is not None, number or "", u)
            want |= {(i, s[3], relations.KINDS[s[0]], n + 1) for n, s in enumerate(sorted(users.values())[:limit])}
        assert {tuple(r) for r in got.collect()} == want
        assert got.count() == len(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("Generate posexplode")]
