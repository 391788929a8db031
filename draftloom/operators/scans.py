"""Tables of scanned drawings, from words that OCR has read and ruling lines, as tables of words, characters, cells and rows.

The known form places the columns. Characters are spread over their words and fall into columns by themselves, so a word
that runs over a border is cut there. Rows are told by height, and numbered by their even spacing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from . import geometry, reports

# The columns of the known form in its own units, from the left border of the part column; the place of that column
# and its width among the edges; what OCR reads as ten-character codes.
SCAN_FORM = [
    (-24.0, -12.0, None), (-12.0, 0.0, "item_no"), (0.0, 118.0, "part_no"), (118.0, 296.0, "name"), (296.0, 314.0, "qty"), (314.0, 326.0, "qty2"), (326.0, 338.0, "qty3"),
    (338.0, 350.0, "qty4"), (350.0, 362.0, "qty5"), (362.0, 380.0, "material"), (380.0, 409.0, "thickness"), (409.0, 444.0, "width"), (444.0, 471.0, "length"), (471.0, 503.0, "weight"),
]
TEN_CHARACTERS = r"^(?:[A-Z]{2,4}[0-9]{6,8}|[0-9]{10})$"
WIDE = "[⺀-\U0010ffff]"
EDGES = sorted({e for a, b, _ in SCAN_FORM for e in (a, b)})
UNIT = (EDGES.index(0.0), EDGES.index(118.0))
#: Edges of the form that have to be found, rules that a table has at least, and the gap of words of one cell in heights.
LEAST_EDGES, LEAST_RULES, WORD_GAP = 7, 6, 0.8
FIELDS = ("item_no", "part_no", "name", "qty", "material", "thickness", "width", "length")


def repaired_code(text: Column) -> Column:
    """A code as OCR reads it, upper case. Separators go where they can't be the code's own: at its end, where there are two or
    more and nothing else but letters and digits, or where the ten-character shape appears without them. A stroke between
    letters is an I, a ring behind four letters and before a digit a nought."""
    said = F.upper(fn.cell_text(text))
    letters = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?<=[A-Z])1(?=[A-Z])", "I"), r"(?<=^[A-Z]{4})O(?=[0-9])", "0")
    tight = letters(F.regexp_replace(said, r"[.,\s]", ""))
    separators = F.length(said) - F.length(F.regexp_replace(said, "[.,]", ""))
    # the shape without separators counts only where the text has not got it with them
    dotted = (said.rlike(r"^[A-Z0-9.,]+$") & (separators >= 2)) | (tight.rlike(TEN_CHARACTERS) & ~letters(said).rlike(TEN_CHARACTERS))
    ended = F.regexp_extract(said, r"^([A-Z0-9]{6,})[|/.,]+$", 1)
    return F.when(dotted, tight).when(ended != "", letters(ended)).otherwise(letters(said))


def own_code(part: Column) -> Column:
    """The code that a part number, of cell text, is: alone, before a blank, or with a branch; else blank."""
    upper = F.upper(part)
    rest = lambda c: F.substring(upper, F.length(c) + 1, F.length(upper))
    fits = F.filter(fn.codes_in(upper), lambda c: F.startswith(upper, c) & rest(c).rlike(r"^(?: .*|-\d{1,3})?$"))
    return F.coalesce(F.get(fits, 0), F.lit(""))


def word_cells(words: DataFrame, rules: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, line, cell, text, x, y, w, h): words (key, line, n, text, x, y, w, h) of an OCR line that stand together.

    A gap of WORD_GAP heights or a rule (key, x, low, high) between two words parts them. A line is a row, its words and its
    drawing's rules are lists, so no word meets a rule as a row.
    """
    said = words.groupBy(*key, "line").agg(F.sort_array(F.collect_list(F.struct("n", "text", "x", "y", "w", "h"))).alias("ws"))
    ruled = rules.groupBy(*key).agg(F.collect_list(F.struct("x", "low", "high")).alias("rs"))

    def parted(a: Column, b: Column) -> Column:
        end, at = a["x"] + a["w"], b["y"] + b["h"] / 2
        rule = F.exists("rs", lambda r: r["x"].between(end - 0.2 * b["h"], b["x"] + 0.2 * b["h"]) & at.between(r["low"], r["high"]))
        return F.coalesce(end.isNull() | (b["x"] - end >= WORD_GAP * b["h"]) | F.coalesce(rule, F.lit(False)), F.lit(True))

    both = F.zip_with(F.slice("ws", F.lit(1), F.size("ws") - 1), F.slice("ws", F.lit(2), F.size("ws") - 1), parted)
    places = F.concat(F.array(F.lit(0)), F.filter(F.transform(both, lambda c, n: F.when(c, n + 1)), lambda n: n.isNotNull()))
    lines = said.join(ruled.hint("merge"), list(key), "left").select(*key, "line", "ws", places.alias("starts"))
    runs = F.transform("starts", lambda n, k: F.slice("ws", n + 1, F.coalesce(F.get("starts", k + 1), F.size("ws")) - n))
    cells = lines.select(*key, "line", F.posexplode(runs).alias("cell", "c"))
    end = F.array_max(F.transform("c", lambda t: t["x"] + t["w"]))
    return cells.select(*key, "line", "cell", F.array_join("c.text", " ").alias("text"), F.array_min("c.x").alias("x"), F.get("c.y", 0).alias("y"), (end - F.array_min("c.x")).alias("w"), F.get("c.h", 0).alias("h"))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def form_places(rules: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, shift, scale, head, top): where the known form lies among the rules (key, x, low, high, h: the height of text) of each key.

    head is where the header ends: rules end at the table's foot, and others a step above it, at the header's top; without such a step
    the header is one and a half heights. top is the median upper end. Rules shorter than eight heights are none of the table.
    """
    h, lows = F.col("h"), F.col("lows")
    tall = rules.where(F.col("high") - F.col("low") >= 8 * h)
    begins = lambda xs: F.filter(xs, lambda x, n: (n == 0) | (x > F.get(xs, n - 1) + 1.0))
    ends = lambda xs: F.filter(xs, lambda x, n: (n == F.size(xs) - 1) | (F.get(xs, n + 1) > x + 1.0))
    # each table's rules are lists in its row
    edges = _once(F.sort_array(F.collect_list("x")), lambda xs: F.zip_with(begins(xs), ends(xs), lambda a, b: (a + b) / 2)).alias("edges")
    tables = tall.groupBy(*key).agg(F.count("*").alias("n_rules"), F.median("high").alias("top"), F.first("h").alias("h"), F.sort_array(F.collect_list("low")).alias("lows"), edges)
    fitted = tables.where(F.col("n_rules") >= LEAST_RULES)
    starts = F.filter(F.transform(lows, lambda v, n: F.when((n == 0) | (F.abs(v - F.get(lows, n - 1)) > 0.6 * h), n)), lambda n: n.isNotNull())
    stepped = fitted.withColumn("starts", starts)
    step = F.transform("starts", lambda n, k: F.struct(F.get(lows, n).alias("end"), (F.coalesce(F.get("starts", k + 1), F.size(lows)) - n).alias("n")))
    footed = stepped.withColumn("steps", step).withColumn("foot", F.coalesce(F.array_min(F.transform(F.filter("steps", lambda s: s["n"] >= 3), lambda s: s["end"])), F.get("lows", 0)))
    above = F.filter("steps", lambda s: (s["end"] > F.col("foot")) & (s["end"] <= F.col("foot") + 3 * h))
    best = F.array_max(F.transform(above, lambda s: F.struct(s["n"].alias("n"), (-s["end"]).alias("e"))))
    headed = footed.select(*key, "edges", F.coalesce(-best["e"], F.col("foot") + 1.5 * h).alias("head"), "top")
    fits = geometry.list_fits(headed, "edges", EDGES, UNIT).where(F.col("hits") >= LEAST_EDGES)
    return fits.select(*key, F.round("shift", 4).alias("shift"), F.round("scale", 6).alias("scale"), "head", "top")


def _span(at: Column) -> Column:
    """The number of the form's column that a place in its units is in; null outside."""
    found = F.when(at < SCAN_FORM[0][0], F.lit(None).cast("int"))
    for n, (_, end, _) in enumerate(SCAN_FORM):
        found = found.when(at < end, F.lit(n))
    return found


def column_texts(cells: DataFrame, places: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, y, h, x, column, text): what cells (key, line, cell, text, x, y, w, h) say in the columns of the form.

    Characters, wide ones twice as wide, belong to the column that their middle stands in. A cell is cut where that changes, if what
    is cut off is a number beside the part, or at least three characters; less than that is a cell that stands out of its column. A cell
    over the border of part and name is cut where its kana or kanji begin, if any do. A cell whose first and last characters are in one
    column is not looked at by its characters.
    """
    names = F.array(*[F.lit(c or "") for _, _, c in SCAN_FORM])
    wide = F.col("text").rlike(WIDE)
    room = lambda c: F.when(c.rlike(WIDE), 2).otherwise(1)
    placed = cells.where(F.col("text") != "").join(places.hint("merge"), list(key)).where((F.col("y") > F.col("head") + 0.3 * F.col("h")) & (F.col("y") < F.col("top")))
    narrow = F.transform(F.sequence(F.lit(1), F.length("text")), lambda n: n - 0.5)
    spread = placed.withColumn("chars", F.split("text", "")).withColumn("size", F.when(wide, F.aggregate("chars", F.lit(0), lambda a, c: a + room(c))).otherwise(F.length("text")))
    mids = F.when(wide, F.transform("chars", lambda c, n: F.aggregate(F.slice("chars", F.lit(1), n + 1), F.lit(0), lambda a, d: a + room(d)) - room(c) / 2)).otherwise(narrow)
    at = lambda m: F.col("x") + F.col("w") * m / F.col("size")
    span = lambda m: _span((at(m) - F.col("shift")) / F.col("scale"))
    edge = lambda c: room(c) / 2
    ended = spread.withColumn("first", span(edge(F.get("chars", 0)))).withColumn("last", span(F.col("size") - edge(F.element_at("chars", -1))))
    piece = lambda column, text, x: F.struct(column.alias("column"), F.trim(text).alias("text"), x.alias("x"))
    whole = F.coalesce(F.col("first") == F.col("last"), F.lit(False))
    # the others by their characters: k, c, at and column, of those inside the form
    said = F.zip_with("chars", mids, lambda c, m: F.struct(c.alias("c"), at(m).alias("at"), F.get(names, span(m)).alias("column")))
    over = ended.withColumn("cs", F.when(~whole, said))
    over = over.withColumn("cs", F.filter(F.transform("cs", lambda s, k: F.struct(k.alias("k"), s["c"].alias("c"), s["at"].alias("at"), s["column"].alias("column"))), lambda s: s["column"].isNotNull()))
    over = over.withColumn("wide", F.array_min(F.transform(F.filter("cs", lambda s: s["c"].rlike(WIDE) & (s["k"] >= 3)), lambda s: s["k"])))
    has = lambda name: F.exists("cs", lambda s: s["column"] == name)
    cut = lambda s: F.when(s["column"].isin("part_no", "name"), F.when(s["k"] < F.col("wide"), "part_no").otherwise("name")).otherwise(s["column"])
    recolumned = lambda to: F.transform("cs", lambda s: F.struct(s["k"].alias("k"), s["c"].alias("c"), s["at"].alias("at"), to(s).alias("column")))
    over = over.withColumn("cs", F.when(F.col("wide").isNotNull() & has("part_no") & has("name"), recolumned(cut)).otherwise(F.col("cs")))
    told = lambda c: F.filter("cs", lambda s: s["column"] == c)
    text = lambda cs: F.array_join(F.transform(cs, lambda s: s["c"]), "")
    over = over.withColumn("pieces", F.transform(F.array_distinct("cs.column"), lambda c: F.struct(F.size(told(c)).alias("n"), c.alias("column"), text(told(c)).alias("t"))))
    over = over.withColumn("main", F.array_max("pieces")["column"])
    stands = lambda p: (p["n"] >= 3) | ((p["column"] == "item_no") & p["t"].rlike("^[0-9IOl|]+$")) | (p["column"] == F.col("main"))
    over = over.withColumn("own", F.transform(F.filter("pieces", stands), lambda p: p["column"]))
    over = over.withColumn("cs", recolumned(lambda s: F.when(F.array_contains("own", s["column"]), s["column"]).otherwise(F.col("main"))))
    cuts = F.transform("own", lambda c: piece(c, text(told(c)), F.array_min(F.transform(told(c), lambda s: s["at"]))))
    alone = F.array(piece(F.get(names, F.col("first")), F.col("text"), at(edge(F.get("chars", 0)))))
    found = over.select(*key, "y", "h", F.explode(F.when(whole, alone).otherwise(cuts)).alias("p"))
    return found.where("p.column <> ''").select(*key, "y", "h", "p.x", "p.column", "p.text")


def form_rows(words: DataFrame, rules: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, row, fields, ref_drawing_no, confidence) of tables in scans whose header cannot be read. words and rules: as in
    :func:`word_cells`, a table a key.

    Rows stand above the header; what is at about one height is a row if it has a part beside something else, a quantity, or a
    number and a name. Numbers follow the even spacing of rows, by the shift that most read ones agree on.
    """
    # sizes are few: a drawing's median is taken over them and how often each stands
    heights = words.groupBy(*key, "h").agg(F.count("*").alias("n")).groupBy(*key).agg(F.percentile("h", 0.5, F.col("n")).alias("h"))
    places = form_places(rules.join(heights.hint("merge"), list(key)), key)
    texts = column_texts(word_cells(words, rules, key), places, key)
    lines = geometry.gap_islands(texts, key, "y", ["x"], 0.8 * F.col("h"), name="line")
    told = F.sort_array(F.collect_list(F.struct("x", "text", "column")))
    said = lambda c: F.array_join(F.transform(F.filter(told, lambda p: p["column"] == c), lambda p: p["text"]), " ").alias(c)
    wide = lines.groupBy(*key, "line").agg(F.max("y").alias("y"), *[said(c) for c in (*FIELDS, *[f"qty{n}" for n in range(2, 6)])])
    part = repaired_code(F.col("part_no"))
    quantity = F.coalesce(*[F.nullif(fn.first_quantity(F.col(c)), F.lit("")) for c in ("qty", "qty2", "qty3", "qty4", "qty5")], F.lit(""))
    read = wide.withColumns({"part_no": part, "qty": quantity, "read": fn.ocr_item_no(F.col("item_no"))})
    is_row = (F.col("qty") != "") | ((F.col("part_no") != "") & ((F.col("name") != "") | (F.col("material") != "") | (F.col("read") != ""))) | ((F.col("read") != "") & (F.col("name") != ""))
    rows = read.where(is_row)
    over = Window.partitionBy(*key)
    gap = F.col("y") - F.lag("y").over(over.orderBy("y"))
    spaced = rows.withColumn("gap", gap).withColumn("pitch", F.least(F.median("gap").over(over), 1.5 * F.min("gap").over(over)))
    position = F.coalesce(F.round((F.col("y") - F.min("y").over(over)) / F.col("pitch")), F.lit(0.0)).cast("int")
    # the shift that most numbers agree on, as geometry.vote_offset has it, by windows: a table read twice would be written and shuffled
    shift = F.col("read").try_cast("int") - position
    agreed = F.when(F.col("vote").isNotNull(), F.count("*").over(Window.partitionBy(*key, "vote")))
    voted = spaced.withColumn("position", position).withColumn("vote", shift.cast("long")).withColumn("votes", agreed)
    best = F.max(F.when(F.col("vote").isNotNull(), F.struct("votes", (-F.abs(F.col("vote") - 1)).alias("near"), "vote"))).over(over)
    elected = voted.withColumn("best", best)
    numbered = elected.withColumn("number", F.col("position") + F.when(F.col("best.votes") >= 2, F.col("best.vote")).otherwise(F.lit(1)))
    out = numbered.withColumn("item_no", F.when(F.col("number") >= 1, F.col("number").cast("string")).otherwise(F.col("read")))
    ordered = F.row_number().over(over.orderBy(F.coalesce(F.col("item_no").try_cast("int"), F.lit(999)), "y"))
    filled = [F.col(c) != "" for c in ("part_no", "name", "qty", "material")]
    # Python functions go last: Spark forgets behind them how rows are dealt
    placed = out.withColumn("row", ordered)
    return placed.select(*key, "row", *[fn.cell_text(F.col(c)).alias(c) for c in FIELDS], own_code(F.col("part_no")).alias("ref_drawing_no"), reports.confidence(filled, F.col("item_no") != "").alias("confidence"))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """Rows of scans whose header could be read, with repaired codes and their references: part_no, ref_drawing_no; others stay."""
    part = repaired_code(F.col("part_no"))
    return rows.withColumn("part_no", part).withColumn("ref_drawing_no", own_code(F.col("part_no")))


def parent_codes(cells: DataFrame, key: Sequence[str], label: str, own: str = "", most: int = 10) -> DataFrame:
    """(key, place, code): codes above or right of a scan's label of the parent assembly. cells: key, cell, text, x, y, w, h.

    A code is looked for from 2 heights left of the label to 12 right of it, and from 0.6 heights below to 6 above. Eleven
    characters are a ten-character code with the quantity beside it.
    """
    labels = cells.where(F.contains(fn.header_key(F.col("text")), F.lit(label))).select(*key, F.col("cell").alias("l_cell"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("w").alias("lw"), F.col("h").alias("lh"))
    dx, dy, h = F.col("x") - F.col("lx"), F.col("y") - F.col("ly"), F.col("lh")
    near = cells.join(labels, list(key)).where((F.col("cell") != F.col("l_cell")) & (dx >= -2 * h) & (dx <= F.col("lw") + 12 * h) & (dy >= -0.6 * h) & (dy <= 6 * h))
    words = near.select(*key, "l_cell", "cell", F.posexplode(F.split(fn.cell_text(F.col("text")), " ")).alias("k", "word")).withColumn("word", repaired_code(F.col("word")))
    texts = words.groupBy(*key, "l_cell", "cell").agg(F.sort_array(F.collect_list(F.struct("k", "word"))).alias("s")).withColumn("t", F.array_join(F.transform("s", lambda p: p.word), " "))
    found = texts.select(*key, "l_cell", "cell", F.posexplode(fn.codes_in(fn.compact_codes(F.col("t")))).alias("k", "c"))
    code = F.when((F.length("c") == 11) & F.col("c").rlike("^[A-Z]{2,5}[0-9]{7,9}$"), F.substring("c", 1, 10)).otherwise(F.col("c"))
    first = found.withColumn("code", code).where(F.col("code") != own).groupBy(*key, "code").agg(F.min(F.struct("l_cell", "cell", "k")).alias("at"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("at"))
    return first.withColumn("place", place).where(F.col("place") <= most).select(*key, "place", "code")
