"""Part tables of many drawings at once, as columns of numbers and of distinct texts.

Most drawings are plain: one header line, one table on one side of it, texts that stand apart, each in a column of its own, and rows
that differ by their number. For those the rules of :mod:`bom` are comparisons of whole columns. What is not plain in any of these
ways is left to ``bom.extract_items``, drawing by drawing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import bom

#: Drawings that share a layout at least, to be read together.
LEAST_ALIKE = 20
_ASCII_WORDS = "|".join(re.escape(w) for w in sorted({*bom._WORDS, *bom._ANCHORS, *bom._TITLES}) if w.isascii())
_NOISE = pa.array([w for w in bom._NOISE if w.isascii()])
_ITEM, _PART, _NAME, _QTY, _MATERIAL = (bom.FIELDS.index(f) for f in ("item_no", "part_no", "name", "qty", "material"))
_SIDE = [bom.FIELDS.index(f) for f in ("qty", "material", "thickness", "width", "length", "note")]


def _flags(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(bool)


class _Texts:
    """What the rules ask of each distinct text. ASCII texts without a word of headers and titles are looked at as a column."""

    def __init__(self, texts: pa.Array) -> None:
        n = len(texts)
        like = lambda pattern, of=texts: _flags(pc.match_substring_regex(of, pattern))
        tight = pc.ascii_upper(pc.replace_substring(texts, " ", ""))
        plain = _flags(pc.string_is_ascii(texts)) & ~like(r"^$|^\s|\s$|  |[\x00-\x1f]") & ~like(_ASCII_WORDS, tight) & ~_flags(pc.is_in(tight, value_set=_NOISE))
        self.texts, self.plain = texts, plain
        self.numeric = like("^[0-9]{1,3}$") & plain
        self.digit, self.lead = like("[0-9]"), like("^[0-9]{1,3} +[^ ]")
        self.room = 0.5 * pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        self.said = np.ones(n, bool)
        self.anchor, self.title, self.known = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        odd = np.flatnonzero(~plain)
        clean = {}
        for k, t in zip(odd, texts.take(pa.array(odd)).to_pylist(), strict=True):
            c = bom.clean(t)
            clean[k] = c
            self.said[k] = bool(t) and not t.isspace()
            self.room[k] = bom._room(t)
            self.anchor[k], self.title[k], self.known[k] = bom._is_anchor(t), bom._is_title(t), bom._is_known(t)
            self.numeric[k], self.digit[k], self.lead[k] = bool(bom._NUMBER.fullmatch(c)) and c.isascii(), bool(re.search(r"\d", c)), bool(re.match(r"\d{1,3}\s+\S", c))
        self.blank = np.array([k for k in odd if not clean[k]], np.int64)
        self.clean = texts
        if len(odd):
            self.clean = pc.replace_with_mask(texts, pa.array(~plain), pa.array([clean[k] for k in odd], pa.string()))

    def of(self, used: np.ndarray, simple: str, f) -> pa.Array:
        """For all texts: themselves, or ``f`` of the clean ones of ``used`` that are not plain or not of the simple form."""
        asked = np.zeros(len(self.texts), bool)
        asked[used] = True
        asked &= ~(_flags(pc.match_substring_regex(self.texts, simple)) & self.plain)
        if not asked.any():
            return self.clean
        return pc.replace_with_mask(self.clean, pa.array(asked), pa.array([f(t) for t in self.clean.filter(pa.array(asked)).to_pylist()], pa.string()))


def _first(text: str) -> str:
    return (bom._FIRST_NUMBER.search(text.replace(",", "")) or [""])[0]


def _layout(items: list, rules: list, up: bool, edge: float, h: float) -> tuple | None:
    """(ruled, edges, fields) of a header line; None where its table is left to ``bom``."""
    columns = bom.header_columns([items])
    if not bom.is_usable(columns):
        return None
    band = (edge, edge + 7.5 * h) if up else (edge - 7.5 * h, edge)
    ruled = bom.ruled_layout(rules, columns, *band, h)
    spans = ruled or bom.header_layout(columns)
    edges = np.array([a for a, _, _ in spans] + [spans[-1][1]])
    names = [c for _, _, c in spans]
    if (np.diff(edges) <= 0).any() or len(set(names) - {None}) < sum(c is not None for c in names):
        return None
    return bool(ruled), edges, np.array([bom.FIELDS.index(c) if c in bom.FIELDS else -1 for c in names])


def _table_end(x: np.ndarray, low: np.ndarray, high: np.ndarray, edges: np.ndarray, edge: np.ndarray, h: np.ndarray, up: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bad, stop) as ``bom.rule_end`` of drawings with as many rules each (rows); bad where an edge has more than one."""
    h, origin = h[:, None], (edge if up else -edge)[:, None]
    near = (np.abs(x[:, None, :] - edges[:, None]) <= 0.3 * h[:, :, None]) & (high - low >= 0.9 * h)[:, None, :]
    pick = lambda v: np.where(near, v[:, None, :], 0.0).sum(axis=2)
    first, last = (pick(low), pick(high)) if up else (-pick(high), -pick(low))
    met = near.any(axis=2) & (last > origin) & (np.maximum(first, origin) <= origin + 0.6 * h)
    ends = np.sort(np.where(met, last if up else -last, np.nan), axis=1)
    n = met.sum(axis=1)
    rows = np.arange(len(n))
    stop = np.where(n > 0, (ends[rows, np.maximum(n - 1, 0) // 2] + ends[rows, n // 2 if ends.shape[1] > 1 else rows * 0]) / 2, np.nan)
    return (near.sum(axis=2) > 1).any(axis=1), stop


def read(lists: list[pa.ListArray], vlines: list[pa.ListArray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """(left, of, row, fields): which drawings are left to ``bom``; and the rows of the others, with their drawing and number.

    lists: text, x, y, h, w of items, vlines: x, low, high of rules, a list a drawing each.
    """
    count = len(lists[0])
    sizes = pc.fill_null(lists[0].value_lengths(), 0).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(count), sizes)
    numbers = lambda a, null=np.nan: pc.fill_null(a.flatten(), null).to_numpy(zero_copy_only=False)
    x, y, h, w = numbers(lists[1]), numbers(lists[2]), numbers(lists[3], 0.0), numbers(lists[4], 0.0)
    h = np.where(h == 0, 1.0, h)
    coded = lists[0].flatten().dictionary_encode()
    code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    texts = _Texts(coded.dictionary)
    left = np.zeros(count, bool)

    def keep(some: np.ndarray) -> None:
        nonlocal of, x, y, h, w, code
        of, x, y, h, w, code = of[some], x[some], y[some], h[some], w[some], code[some]

    keep((code >= 0) & np.append(texts.said, False)[code])
    w = np.where(w == 0, h * texts.room[code], w)
    left[of[~np.isfinite(x + y + h + w) | (h <= 0) | (w < 0)]] = True
    anchors = np.flatnonzero(texts.anchor[code])
    n_anchors = np.bincount(of[anchors], minlength=count)
    left |= n_anchors > 1
    left[of[texts.title[code] | np.isin(code, texts.blank)]] = True
    ax, height = np.zeros(count), np.ones(count)
    ax[of[anchors]], height[of[anchors]] = x[anchors], h[anchors]
    left[of[h != height[of]]] = True  # those without an anchor are taken back below
    left[n_anchors == 0] = False
    keep((n_anchors[of] == 1) & ~left[of] & (ax[of] - 11 * height[of] <= x) & (x <= ax[of] + 90 * height[of]))

    # lines, from the top, and by x in them
    keep(np.lexsort((-y, of)))
    none = np.zeros(0, np.int64)
    if not len(of):
        return left, none, none, {}
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (y[:-1] - y[1:] > 0.55 * h[1:])
    line = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(of))
    high, low, line_of = y[starts], y[stops - 1], of[starts]
    keep(np.lexsort((x, line)))
    same = line[1:] == line[:-1]
    left[of[1:][same & (x[1:] - (x[:-1] + w[:-1]) < 1.2 * h[1:])]] = True
    head = np.full(count, -1)
    anchor = texts.anchor[code]
    head[of[anchor]] = line[anchor]
    left[of[texts.known[code] & (line != head[of])]] = True
    lines = np.arange(len(line_of))
    above, below = np.zeros(count, bool), np.zeros(count, bool)
    above[line_of[lines < head[line_of]]] = True
    below[line_of[lines > head[line_of]]] = True
    left |= above & below
    edge = np.where(above, high[head], low[head])

    # layouts, one for all drawings of equal headers and rules that pass beside them
    rsizes = pc.fill_null(vlines[0].value_lengths(), 0).to_numpy(zero_copy_only=False)
    rx, ra, rb = (numbers(v) for v in vlines)
    rof = np.repeat(np.arange(count), rsizes)
    rstart = np.cumsum(rsizes) - rsizes
    left[rof[~np.isfinite(rx + ra + rb)]] = True
    near = (rb - ra >= 0.9 * height[rof]) & (rb > np.where(above, edge, edge - 7.5 * height)[rof]) & (ra < np.where(above, edge + 7.5 * height, edge)[rof])
    passing, n_passing = rx[near], np.bincount(rof[near], minlength=count)
    pstop = np.cumsum(n_passing)
    alike: dict[tuple, list[int]] = {}
    for d in np.flatnonzero(~left & (above | below)).tolist():
        s, e = starts[head[d]], stops[head[d]]
        mark = (code[s:e].tobytes(), x[s:e].tobytes(), w[s:e].tobytes(), height[d], above[d], passing[pstop[d] - n_passing[d] : pstop[d]].tobytes())
        alike.setdefault(mark, []).append(d)
    at, position, field = np.zeros(len(of)), np.full(len(of), -1), np.full(len(of), -1)
    stop, orders, order_of = np.full(count, np.nan), [], np.zeros(count, np.int64)
    item_start = np.searchsorted(of, np.arange(count + 1))
    for ds in alike.values():
        d, up = ds[0], bool(above[ds[0]])
        s, e = starts[head[d]], stops[head[d]]
        found = None
        if len(ds) >= LEAST_ALIKE:
            items = [bom.Item(t, *map(float, v)) for t, *v in zip(texts.texts.take(pa.array(code[s:e])).to_pylist(), x[s:e], y[s:e], h[s:e], w[s:e], strict=True)]
            rules = slice(rstart[d], rstart[d] + rsizes[d])
            found = _layout(items, list(zip(rx[rules].tolist(), ra[rules].tolist(), rb[rules].tolist(), strict=True)), up, float(edge[d]), float(height[d]))
        ds = np.array(ds)
        if found is None:
            left[ds] = True
            continue
        ruled, edges, fields = found
        if ruled:
            for n in np.unique(rsizes[ds]):
                some = ds[rsizes[ds] == n]
                of_rule = rstart[some][:, None] + np.arange(n)
                bad, stop[some] = _table_end(rx[of_rule], ra[of_rule], rb[of_rule], edges, edge[some], height[some], up)
                left[some[bad]] = True
        mine = np.repeat(item_start[ds], item_start[ds + 1] - item_start[ds]) + _counted(item_start[ds + 1] - item_start[ds])
        hs = h[mine]
        at = x[mine] + (0.3 * hs if ruled else np.minimum(w[mine] / 2, 0.4 * hs))
        place = np.searchsorted(edges, at, side="right") - 1
        place[(at >= edges[-1]) | (x[mine] < edges[0] - 0.5 * hs) | (x[mine] > edges[-1] + 0.5 * hs)] = -1
        numeric = texts.numeric[code[mine]]
        parts = np.flatnonzero(fields == _PART)
        which = np.where(place >= 0, fields[place], -1)
        which[(which == _ITEM) & ~numeric] = -1
        if not ruled and len(parts):
            early = numeric & (x[mine] + w[mine] < edges[parts[0]] + hs)
            which[early] = _ITEM
        places = np.full(len(bom.FIELDS) + 1, -1)
        places[fields] = np.arange(len(fields))
        places[-1] = -1
        field[mine], position[mine] = np.where(places[which] < 0, -1, which), places[which]
        order_of[ds] = len(orders)
        orders.append([f for f in fields.tolist() if f >= 0])
    body = ~left[of] & (line != head[of]) & (above | below)[of]
    left[of[body & (field < 0)]] = True
    left[of[1:][same & body[1:] & (position[1:] <= position[:-1])]] = True
    left[of[body & (field == _PART) & texts.lead[code]]] = True

    # rows
    rows = np.flatnonzero(~left[line_of] & (lines != head[line_of]) & (above | below)[line_of])
    up = above[line_of]
    before = np.where(up, high[np.minimum(lines + 1, len(lines) - 1)], high[lines - 1])
    before = np.where(~up & (lines - 1 == head[line_of]), low[lines - 1], before)
    with np.errstate(invalid="ignore"):
        ended = (np.abs(high - before) > 10 * height[line_of]) | np.where(up, low > stop[line_of], high < stop[line_of])
    left[line_of[rows[ended[rows]]]] = True
    cell = np.full((len(lines), len(bom.FIELDS)), -1)
    mine = np.flatnonzero(body & (field >= 0))
    cell[line[mine], field[mine]] = code[mine]
    has = cell >= 0
    is_ = lambda flags, f: has[:, f] & flags[np.maximum(cell[:, f], 0)]
    lone = has.sum(axis=1) == 1
    number = lone & (has[:, _ITEM] | is_(texts.numeric, _PART))
    side = has[:, _SIDE].sum(axis=1) == has.sum(axis=1)
    row = is_(texts.digit, _QTY) | has[:, _PART] & (has[:, _NAME] | has[:, _MATERIAL] | has[:, _ITEM]) | has[:, _ITEM] & has[:, _NAME]
    left[line_of[rows[(number | side | ~row)[rows]]]] = True
    rows = rows[~left[line_of[rows]]]
    values = texts.clean.take(pa.array(np.maximum(cell[rows, _ITEM], 0)))
    numbered = is_(texts.numeric, _ITEM)[rows]
    place = np.full(len(rows), 999)
    place[numbered] = pc.cast(values.filter(pa.array(numbered)), pa.int32()).to_numpy(zero_copy_only=False)
    order = np.lexsort((place, line_of[rows]))
    rows, place, numbered = rows[order], place[order], numbered[order]
    twice = (line_of[rows][1:] == line_of[rows][:-1]) & (place[1:] == place[:-1])
    left[line_of[rows][1:][twice]] = True
    some = ~left[line_of[rows]]
    rows, numbered = rows[some], numbered[some]
    drawing = line_of[rows]
    if not len(rows):
        return left, none, none, {}
    first = np.append(True, drawing[1:] != drawing[:-1])
    number_of = np.arange(len(rows)) - np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(rows)))) + 1

    def taken(values: pa.Array, f: int) -> pa.Array:
        return values.take(pa.array(cell[rows, f], mask=~has[rows, f]))

    used = lambda f: np.unique(cell[rows, f][has[rows, f]])
    said = {f: taken(texts.clean, k) for k, f in enumerate(bom.FIELDS)}
    full = lambda values: pc.fill_null(values, "")
    out = {f: pc.utf8_slice_codeunits(full(v), 0, bom.LIMITS.get(f, 255)) for f, v in said.items()}
    parts = used(_PART)
    solid = texts.of(parts, r"^[^ .,]*$", bom.compact)
    out["item_no"] = pc.if_else(pa.array(numbered), full(said["item_no"]), "")
    out["part_no"] = pc.utf8_slice_codeunits(full(taken(solid, _PART)), 0, 64)
    out["qty"] = full(taken(texts.of(used(_QTY), "^[0-9]+$", _first), _QTY))
    out["ref_drawing_no"] = full(taken(texts.of(parts, r"^[A-WYZ][A-Z]{0,4}[0-9]{3,8}$", lambda t: bom.reference(bom.compact(t))), _PART))
    named = [pc.binary_join_element_wise(f, said[f], "=") for f in bom.FIELDS]
    raw, kinds = None, order_of[drawing]
    for k in np.unique(kinds):
        some = pa.array(kinds == k)
        mine = pc.binary_join_element_wise(*[named[f].filter(some) for f in orders[k]], " | ", null_handling="skip")
        raw = mine if len(mine) == len(rows) else pc.replace_with_mask(pa.nulls(len(rows), pa.string()) if raw is None else raw, some, mine)
    out["raw_text"] = raw
    filled = sum(_flags(pc.not_equal(out[f], "")).astype(int) for f in ("part_no", "name", "qty", "material"))
    out["confidence"] = pa.array(_CONFIDENCE[filled, numbered.astype(int)])
    return left, drawing, number_of, out


#: By filled fields and whether there is a number.
_CONFIDENCE = np.array([[round(min(1.0, 0.5 + 0.1 * n + 0.1 * k), 2) for k in (0, 1)] for n in range(5)])


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, … anew for each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
