"""Drawing exchange files: text, block attributes and vertical lines, from the files' group codes.

A small reader of the ASCII form; no drawing library is needed. Files are read with Spark's binaryFile source.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEPTH = 4
ITEM = "struct<text string, x double, y double, h double, w double, conf double, tokens array<struct<text string, x double, y double, w double, h double>>>"
SCHEMA = f"path string, items array<{ITEM}>, vlines array<struct<x double, y0 double, y1 double>>, attributes array<struct<tag string, text string, block string>>, error string"

Pair = tuple[int, str]
Frame = tuple[float, float, float, float, float]  # x, y, scale x, scale y, rotation


def code_page(data: bytes) -> str:
    """The encoding of a file: UTF-8 for newer versions, else its code page. Files that name none, or a Western one, but
    decode as Japanese with hardly an error were written in Japanese."""
    head = data[:20_000]
    version = re.search(rb"\$ACADVER\s+1\s+(AC\d+)", head)
    if version and version[1] >= b"AC1021":
        return "utf-8"
    named = re.search(rb"\$DWGCODEPAGE\s+3\s+(\S+)", head)
    page = (named[1].decode("ascii", "ignore") if named else "").upper()
    high = sum(b >= 0x80 for b in data)
    if page in ("", "ANSI_1252") and high >= 20 and data.decode("cp932", "replace").count("\ufffd") <= high * 0.01:
        return "cp932"
    return {"ANSI_932": "cp932", "ANSI_936": "gbk", "ANSI_949": "cp949", "ANSI_950": "big5"}.get(page, "cp1252")


def pairs(data: bytes) -> Iterator[Pair]:
    lines = data.decode(code_page(data), "replace").splitlines()
    for code, value in zip(lines[::2], lines[1::2], strict=False):
        try:
            yield int(code), value
        except ValueError:
            return


def sections(data: bytes) -> tuple[dict[str, list[list[Pair]]], list[list[Pair]]]:
    """Entities of each block by name, and those of the drawing."""
    blocks: dict[str, list[list[Pair]]] = {}
    drawing: list[list[Pair]] = []
    section, block, entity = "", None, None
    for code, value in pairs(data):
        if code == 0:
            entity = [(0, value.strip())]
            if value.strip() == "ENDBLK":
                block = None
            elif section == "ENTITIES":
                drawing.append(entity)
            elif block is not None:
                blocks[block].append(entity)
            continue
        if entity is None:
            continue
        kind = entity[0][1]
        entity.append((code, value))
        if kind == "SECTION" and code == 2:
            section = value.strip()
        elif kind == "BLOCK" and code == 2:
            block = value.strip()
            blocks.setdefault(block, [])
    return blocks, drawing


def plain(text: str) -> str:
    """Text without control codes: signs for diameter, degree, plus-minus and percent; formats of multi-line text go."""
    for code, sign in (("c", "φ"), ("d", "°"), ("p", "±"), ("u", ""), ("o", "")):
        text = re.sub(f"%%{code}", sign, text, flags=re.I)
    text = text.replace("%%%", "%")
    text = re.sub(r"\\P", "\n", text)
    text = re.sub(r"\\[A-Za-z][^;\\{}]*;", "", text)
    return re.sub(r"[{}]", "", text).strip()


def _value(entity: list[Pair], code: int, default: float = 0.0) -> float:
    return next((float(v) for c, v in entity if c == code), default)


def _point(frame: Frame, x: float, y: float) -> tuple[float, float]:
    fx, fy, sx, sy, turn = frame
    x, y = x * sx, y * sy
    return fx + x * math.cos(turn) - y * math.sin(turn), fy + x * math.sin(turn) + y * math.cos(turn)


def read(data: bytes) -> tuple[list[dict], list[dict], list[dict]]:
    """(items, vertical lines, attributes) of a file; blocks are placed to a depth of MAX_DEPTH."""
    blocks, drawing = sections(data)
    items: list[dict] = []
    lines: list[dict] = []
    attributes: list[dict] = []

    def segment(frame: Frame, a: tuple[float, float], b: tuple[float, float]) -> None:
        (x0, y0), (x1, y1) = _point(frame, *a), _point(frame, *b)
        if abs(y1 - y0) > 1e-9 and abs(x1 - x0) <= 0.01 * abs(y1 - y0):
            lines.append({"x": (x0 + x1) / 2, "y0": min(y0, y1), "y1": max(y0, y1)})

    def walk(entities: list[list[Pair]], frame: Frame, depth: int) -> None:
        inserted = ""
        for e in entities:
            kind = e[0][1]
            if kind in ("TEXT", "MTEXT", "ATTRIB"):
                text = plain("".join(v for c, v in e if c in (3, 1)))
                h = _value(e, 40, 1.0) * abs(frame[3])
                x, y = _point(frame, _value(e, 10), _value(e, 20))
                for n, line in enumerate(t for t in text.split("\n") if t.strip()):
                    items.append({"text": line, "x": x, "y": y - 1.5 * n * h, "h": h})
                if kind == "ATTRIB":
                    attributes.append({"tag": next((v for c, v in e if c == 2), ""), "text": text, "block": inserted})
            elif kind == "LINE":
                segment(frame, (_value(e, 10), _value(e, 20)), (_value(e, 11), _value(e, 21)))
            elif kind == "LWPOLYLINE":
                points = list(zip([float(v) for c, v in e if c == 10], [float(v) for c, v in e if c == 20], strict=False))
                closed = int(_value(e, 70)) & 1
                for a, b in zip(points, points[1:] + points[:1] * closed, strict=False):
                    segment(frame, a, b)
            elif kind == "INSERT":
                inserted = next((v.strip() for c, v in e if c == 2), "")
                if depth < MAX_DEPTH:
                    x, y = _point(frame, _value(e, 10), _value(e, 20))
                    placed = (x, y, frame[2] * _value(e, 41, 1.0), frame[3] * _value(e, 42, 1.0), frame[4] + math.radians(_value(e, 50)))
                    walk(blocks.get(inserted, []), placed, depth + 1)

    walk(drawing, (0.0, 0.0, 1.0, 1.0, 0.0), 0)
    return items, lines, attributes


def parse(files: DataFrame) -> DataFrame:
    """Parsed drawings of (path, content) rows; a file that cannot be read gives its error and empty arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    items, lines, attributes = read(bytes(content))
                    full = [i | {"w": None, "conf": None, "tokens": None} for i in items]
                    out.append((path, full, lines, attributes, None))
                except (ValueError, IndexError) as error:
                    out.append((path, [], [], [], f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["path", "items", "vlines", "attributes", "error"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def load(spark: SparkSession, root: str) -> DataFrame:
    """All drawing files below a folder, parsed where they are read."""
    return parse(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{dxf,DXF}").load(root).select("path", "content"))


def digests(files: DataFrame) -> DataFrame:
    """Content hash of each file, the key of cached results."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))
