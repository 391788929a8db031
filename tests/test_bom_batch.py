"""Drawings read together give what they give one by one."""

import random

import pyarrow as pa
import pytest

from draftloom.operators import bom, bom_batch

HEAD = [("NO.", 2), ("図 番 又 は 品 番", 16), ("名称/規格", 66), ("員 数", 121), ("材質", 141), ("厚さ", 161), ("備考", 181)]
EDGES = [-3, 14, 64, 119, 139, 159, 179, 225]
PARTS = ["QRST004410", "HB000123", "X12345", "0411-TAPE-W", "P", "12 AB", "1234567890", "AB1234-12", "Q.R.S.T.0.1", "A B C D E F", "ＨＢ００１２", "7", "-", "HB12345 A", "NO", "PARTNO", "１"]
NAMES = ["フレーム", "PLATE 12", "ﾃｰﾌﾟ/18×50", "板  -900", "NAME", "名称", " SIDE", "a" * 300, "製図", "USER", "9", "\t", "+"]
OTHERS = ["", "", "2", "12", "1,200", "2.5 m", "x", "１２", "S", "REMARKS"]


def drawing(rnd, wild):
    up, ruled = rnd.random() < 0.7, rnd.random() < 0.6
    dx, dy = rnd.choice([0.0, 0.0, 0.1, 7.25]), rnd.choice([0.0, 3.3, -40.7])
    items = [[t, x + dx, dy, 3.0, None] for t, x in HEAD]
    count = rnd.randrange(6)
    for n in range(1, count + 1):
        y = dy + (8 * n if up else -8 * n)
        pick = lambda plain, some: plain if rnd.random() > wild else rnd.choice(some)
        row = [pick(str(n), ["", "1", "0", "12", "x", "999", "1234"]), pick(f"HB{rnd.randrange(10**6):06}", PARTS), pick(f"PLATE {rnd.randrange(99)}", NAMES), pick(str(rnd.randrange(50)), OTHERS), pick("STEEL", OTHERS), pick("", OTHERS), pick("", OTHERS)]
        items += [[v, x + dx, y, 3.0, None] for v, (_, x) in zip(row, HEAD, strict=True) if v]
    low, high = (dy - 3, dy + 4 + 8 * count) if up else (dy - 4 - 8 * count, dy + 3)
    rules = [[x + dx, low, high] for x in EDGES] if ruled else []
    for changed in (items, rules):
        while changed and rnd.random() < wild:
            one = rnd.choice(changed)
            match rnd.randrange(6 if changed is items else 4):
                case 0:
                    changed.remove(one)
                case 1:
                    changed.append(list(one))
                case 2:
                    one[1] += rnd.choice([-9.0, -0.5, 0.5, 3.0, 40.0])
                case 3:
                    one[2] += rnd.choice([-9.0, -0.5, 0.5, 3.0, 40.0])
                case 4:
                    one[3] = rnd.choice([None, 0.0, 2.0, 6.0])
                case 5:
                    one[4] = rnd.choice([0.0, 1.0, 30.0])
    return [tuple(i) for i in items], [tuple(r) for r in rules]


@pytest.mark.parametrize("wild,least", [(0.0, 20), (0.01, 20), (0.02, 1), (0.1, 1), (0.4, 1)])
def test_together_as_one_by_one(monkeypatch, wild, least):
    monkeypatch.setattr(bom_batch, "LEAST_ALIKE", least)
    rnd = random.Random(f"{wild}{least}")
    drawings = [drawing(rnd, wild) for _ in range(1500)] + [([], []), ([("品番", 0.0, 0.0, 3.0, None), (None, 0.0, 0.0, 3.0, None)], [])]
    lists = [pa.array([[i[k] for i in items] for items, _ in drawings], pa.list_(t)) for k, t in enumerate([pa.string()] + [pa.float64()] * 4)]
    rules = [pa.array([[r[k] for r in some] for _, some in drawings], pa.list_(pa.float64())) for k in range(3)]
    left, of, row, fields = bom_batch.read(lists, rules)
    got = {}
    for n, k, found in zip(of.tolist(), row.tolist(), pa.table(fields).to_pylist(), strict=True):
        got.setdefault(n, []).append(found)
        assert k == len(got[n])
    for n, (items, some) in enumerate(drawings):
        if not left[n]:
            assert got.get(n, []) == bom.extract_items(bom.said_items(items), some), (items, some)
        assert not left[n] or n not in got
    assert left.sum() < (1 if wild == 0 else 1400) and len(of) > 100


def test_nothing_at_all():
    lists = [pa.array([None, []], pa.list_(t)) for t in [pa.string()] + [pa.float64()] * 4]
    left, of, row, fields = bom_batch.read(lists, lists[1:4])
    assert not left.any() and not len(of)
