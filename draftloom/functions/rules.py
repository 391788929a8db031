"""Document types by ordered rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import hit_count, lone_hits, path_parts, stem

DRAWING, OTHER = "drawing", "other"
BODY_CHARS, SHOWN, JOINT = 6000, 3, "・"

# The words of each type, in order of precedence, of drawing names and of title blocks; folders of documents; names that scanners give.
TYPE_WORDS: dict[str, list[str]] = {
    "contract": ["契約書", "契約", "見積書", "見積", "請求書", "注文書", "発注書", "注文請書", "納品書", "領収書", "約款", "覚書", "契約金額", "請負", "収入印紙", "御中", "発注伝票", "発注", "受注", "注文"],
    "application": ["確認申請", "建築確認", "申請書", "申請図書", "届出", "許可申請", "確認済証", "検査済証", "設置届", "申請"],
    "site": ["公図", "地番", "地積", "測量", "登記", "敷地", "土地", "案内図", "現況図", "求積", "境界", "住宅地図", "付近見取図"],
    "general": ["工程表", "稟議書", "稟議", "凛議", "理由書", "議事録", "報告書", "打合せ", "打合わせ", "依頼書", "送付状", "連絡書", "寸法表", "一覧表", "説明書", "取扱説明", "通知書", "回覧"],
}
DRAWING_NAME_WORDS = ["図面一式", "組立図", "部品図", "製作図", "詳細図", "姿図", "展開図", "平面図", "立面図", "断面図", "構造図"]
TITLEBLOCK_WORDS = ["図番", "尺度", "SCALE", "DRAWING NO", "DWG NO", "三角法", "材質", "製図", "検図", "承認"]
DOCUMENT_FOLDERS = ["物件対応ファイル他"]
SCANNER_NAME = r"^[0-9]{12,}$"


def _any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def _first_word(text: Column, words: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words], F.lit(""))


def _folder_word(folders: Column, words: Sequence[str]) -> Column:
    """The first word of the first folder that has any, and that folder."""
    folder = F.get(F.filter(folders, lambda f: _any(f, words)), 0)
    return F.concat_ws("@", _first_word(folder, words), folder)


def _any_folder(folders: Column, words: Sequence[str]) -> Column:
    return F.exists(folders, lambda f: _any(f, words))


def classify(
    path: Column, code: Column, source: Column, confidence: Column, kind: Column, text: Column, pages: Column, is_page: Column,
    type_words: Mapping[str, Sequence[str]] = TYPE_WORDS, drawing_words: Sequence[str] = DRAWING_NAME_WORDS, title_words: Sequence[str] = TITLEBLOCK_WORDS,
    document_folders: Sequence[str] = DOCUMENT_FOLDERS,
) -> Column:
    """struct(doc_type, reason, words): the first rule that fits, and the words that made it: the first of a file name, ``word@folder``
    of a folder, up to ``SHOWN`` of a body, joined by ``JOINT``; blank for rules without words.

    Texts are normalised by the caller. Rules: words of the file name, by type; words of a folder, by type and then from
    the deepest; drawing words of the file name; a PDF of several pages that is no page of a set goes by its body; in a
    folder of documents the body decides, then a code with title-block words; a code from attributes, file name or with
    confidence; two words of one type in the body; DXF; any code; two title-block words. The body's type is the one
    with most words, ties by precedence.
    """
    name, folders = stem(path), F.reverse(F.slice(path_parts(path), F.lit(1), F.greatest(F.size(path_parts(path)) - 1, F.lit(0))))
    body = F.substring(F.coalesce(text, F.lit("")), 1, BODY_CHARS)
    counts = [hit_count(body, list(words)) for words in type_words.values()]
    top = F.greatest(*counts) if len(counts) > 1 else counts[0]
    best = F.coalesce(*[F.when(n == top, F.lit(t)) for t, n in zip(type_words, counts, strict=True)])
    titled = hit_count(body, list(title_words)) >= 2
    has_code = F.coalesce(code, F.lit("")) != ""
    is_kind = lambda k: F.lower(F.coalesce(kind, F.lit(""))) == k
    in_documents = _any_folder(folders, document_folders)
    sure = source.isin("attrib", "filename") | (F.coalesce(confidence, F.lit(0.0)) >= 0.75)
    many = is_kind("pdf") & (F.coalesce(pages, F.lit(1)) >= 2) & ~F.coalesce(is_page, F.lit(False))
    none = F.lit("")
    body_words = F.coalesce(*[F.when(best == t, F.array_join(F.slice(lone_hits(body, list(words)), 1, SHOWN), JOINT)) for t, words in type_words.items()])
    rules = [(_any(name, words), F.lit(t), f"file name: {t}", _first_word(name, words)) for t, words in type_words.items()]
    rules += [(_any_folder(folders, words), F.lit(t), f"folder: {t}", _folder_word(folders, words)) for t, words in type_words.items()]
    rules += [
        (_any(name, drawing_words), F.lit(DRAWING), "file name: drawing", _first_word(name, drawing_words)),
        (many & (top > 0), best, "several pages: body", body_words),
        (many, F.lit(OTHER), "several pages", none),
        (in_documents & (top > 0), best, "document folder: body", body_words),
        (in_documents & has_code & titled, F.lit(DRAWING), "document folder: code and title block", none),
        (in_documents & name.rlike(SCANNER_NAME), F.lit(OTHER), "document folder: scanner", none),
        (in_documents, F.lit(OTHER), "document folder", none),
        (has_code & sure, F.lit(DRAWING), "code", none),
        (top >= 2, best, "body", body_words),
        (is_kind("dxf"), F.lit(DRAWING), "dxf", none),
        (has_code, F.lit(DRAWING), "code, unsure", none),
        (titled, F.lit(DRAWING), "title block", none),
        (body.rlike(r"(?U)\S"), F.lit(OTHER), "no hint", none),
    ]
    answer = lambda t, why, words: F.struct(t.alias("doc_type"), F.lit(why).alias("reason"), words.alias("words"))
    return reduce(lambda rest, rule: F.when(F.coalesce(rule[0], F.lit(False)), answer(*rule[1:])).otherwise(rest), reversed(rules), answer(F.lit(OTHER), "no body", none))


def apply_type(current: Column, fixed: Column, found: Column) -> Column:
    """A type that was set by hand stays."""
    return F.when(F.coalesce(fixed, F.lit(False)), current).otherwise(F.coalesce(found, F.lit(OTHER)))
