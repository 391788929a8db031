"""Dictionary search, selectors and row visibility."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Document types that each level may see; None: all. Unknown levels see what Guest sees.
LEVELS: dict[str, set[str] | None] = {"Admin": None, "User": None, "Guest": {"drawing"}}
#: Terms of a word that are compared one by one; more are searched as an array.
MAX_CHAIN = 50


def visible(df: DataFrame, level: str, type_col: str = "doc_type") -> DataFrame:
    """Rows that the level may see. Rows without a type are hidden from levels that do not see all."""
    allowed = LEVELS.get(level, LEVELS["Guest"])
    return df if allowed is None else df.where(F.col(type_col).isin(*sorted(allowed)))


def level_of(groups: Column, is_superuser: Column) -> Column:
    """Admin for superusers, then Admin, then User by group, else Guest."""
    return F.when(is_superuser | F.array_contains(groups, "Admin"), "Admin").when(F.array_contains(groups, "User"), "User").otherwise("Guest")


def same_text(a: Column, b: Column) -> Column:
    """Equality without regard to case."""
    return F.lower(a) == F.lower(b)


def expand_terms(words: DataFrame, dictionary: DataFrame, norm=F.lower) -> DataFrame:
    """(word, term) rows: each word itself, and every canonical and term of the canonicals that it names.

    words: word; dictionary: term, canonical, approved. Two equi-joins, over normalised text; blank words give nothing.
    """
    known = dictionary.where("approved").select(norm(F.col("term")).alias("term"), norm(F.col("canonical")).alias("canonical"))
    asked = words.select(norm(F.col("word")).alias("word")).where("word <> ''").distinct()
    names = known.select(F.col("term").alias("name"), "canonical").unionByName(known.select(F.col("canonical").alias("name"), "canonical")).distinct()
    canonicals = asked.join(names, asked.word == names.name).select("word", "canonical").distinct()
    members = known.select("canonical", "term").unionByName(known.select("canonical", F.col("canonical").alias("term")))
    found = canonicals.join(members, "canonical").select("word", "term")
    return found.unionByName(asked.select("word", F.col("word").alias("term"))).distinct()


def contains_all(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Literal substring search: every group must have a term in the text. An empty search matches all.

    A few terms are a chain of ``contains``, which is compiled with the scan; many are an array that is searched.
    """

    def any_of(group: Sequence[str]) -> Column:
        if len(group) > MAX_CHAIN:
            return F.exists(F.lit(list(group)), lambda t: F.contains(text, t))
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in group], F.lit(False))

    return reduce(lambda a, b: a & b, [any_of(g) for g in groups], F.lit(True))


def search(df: DataFrame, text: Column, words: Sequence[str], dictionary: DataFrame, norm=F.lower) -> DataFrame:
    """Rows of ``df`` whose normalised text has every word or one of its synonyms.

    The words asked for and their synonyms, two hops from them, are what comes to the driver; they become a predicate of
    the scan, without a join.
    """
    asked = df.sparkSession.createDataFrame([(w,) for w in words], "word string")
    groups: dict[str, list[str]] = {}
    for row in expand_terms(asked, dictionary, norm).orderBy("word", "term").collect():
        groups.setdefault(row["word"], []).append(row["term"])
    return df.where(contains_all(norm(text), list(groups.values())))


def listing(drawings: DataFrame, kind: str = "") -> DataFrame:
    """Found drawings as they are listed: none of missing files, those of a known kind if one is asked for, by number,
    revision and id. Columns: drawing_no, revision, id, kind, status; more stay."""
    there = drawings.where("status <> 'missing'")
    return (there.where(F.col("kind") == kind) if kind in ("dxf", "pdf") else there).orderBy("drawing_no", "revision", "id")


def enum_or_default(value: str, allowed: Sequence[str], default: str) -> str:
    return value if value in allowed else default


def under_folder(path: Column, folder: str) -> Column:
    """Whether a path lies below a folder."""
    return F.startswith(path, F.lit(folder.rstrip("/") + "/")) if folder else F.lit(True)


def two_level(high: Column, low: Column, selector: str) -> Column:
    """``HIGH`` selects by the first level, ``HIGH/LOW`` by the second; an empty selector selects all."""
    if not selector:
        return F.lit(True)
    head, _, tail = selector.partition("/")
    return low == tail if tail else high == head


def json_has(json: Column, key: str, value: Column) -> Column:
    """Whether the array of strings under ``key`` of a JSON object has the value."""
    return F.array_contains(F.from_json(F.get_json_object(json, f"$.{key}"), "array<string>"), value)


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of a text; none for shorter texts."""
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda k: F.substr(text, k, F.lit(3)))
    return F.when(F.length(text) >= 3, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def trigram_postings(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(gram, key): the index behind substring search; written partitioned by gram it spares the scan of all texts."""
    return df.select(F.explode(trigrams(text)).alias("gram"), key)


def trigram_search(df: DataFrame, postings: DataFrame, key: str, text: Column, phrase: str) -> DataFrame:
    """Rows whose text has the phrase: those that have all its trigrams, then checked. Shorter phrases scan."""
    grams = sorted({phrase[k : k + 3] for k in range(len(phrase) - 2)})
    hit = F.contains(text, F.lit(phrase))
    if not grams:
        return df.where(hit)
    found = postings.where(F.col("gram").isin(grams)).groupBy(F.col(key).alias("f_key")).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
    return df.join(found, F.col(key) == F.col("f_key"), "left_semi").where(hit)
