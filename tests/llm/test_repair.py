import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from draftloom.llm import repair


def brute(rows, damaged=True):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, lines)} of rows (conv, turn, role, text), by recursion."""
    convs = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damaged else 9
        r, x = " " if r is None else r, " " if x is None else x
        if kind:
            x = {1: "", 2: re.sub("[.!?]", "", x)}.get(kind, x)
            convs[c] += [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda q: (q[0] is not None, q[0] or 0, q[1].encode(), hashlib.md5(q[2].encode()).digest()))
        seen, faults = set(), []
        for _, r, x in turns:
            y = x.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not y else "duplicate" if (r, x) in seen else "cut" if y[-1] not in ".!?" else "")
            seen.add((r, x))

        @functools.cache
        def best(i, s, inserted, turns=turns, faults=faults):
            found = [(0, "", ())] if i == len(turns) and s in (0, 3) else []
            if inserted < 2:
                after = [2, 2, 3, 2][s]
                b = best(i, after, inserted + 1)
                found.append((b[0] + 5, "I" + b[1], ("user:" if after == 2 else "assistant:", *b[2])))
            if i < len(turns):
                _, r, x = turns[i]
                b = best(i + 1, s, 0)
                found.append((b[0] + 2, "D" + b[1], b[2]))
                if faults[i] in ("", "cut"):
                    for letter, role, cost in (("K", r, 0), ("R", "user", 1), ("R", "assistant", 1)):
                        after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, role[:1]))
                        if after is not None:
                            b = best(i + 1, after, 0)
                            found.append((b[0] + cost + (5 if faults[i] else 0), letter + b[1], (f"{role}:{x}", *b[2])))
            return min(found, key=lambda f: f[:2]) if found else (10**9, "", ())

        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[c] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "cut")], illegal, *best(0, 0, 0))
    return out


def awkward(seed, most):
    rnd = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "sys"]
    texts = ["Hi.", "What? ", "No", "", "  \n", None, "x.\u0085", "a.b", "…", "word " * 3000 + "end!"]
    rows = []
    for c in [None, *range(60)]:
        for k in range(rnd.choice([1, 2, 3, 8, most])):
            for _ in range(rnd.choice([1, 1, 2])):
                rows.append((c, rnd.choice([None, k, k, k, k + 1, 2 * k]), rnd.choice(roles), rnd.choice([*texts, f"t{k}.", f"t{k}!"])))
    return rows + [(1000, 1, "user", "same.")] * 70 + [(1001, None, None, None)]


def with_digest(found):
    return {c: (*v[:7], hashlib.sha256("\n".join(v[7]).encode()).hexdigest()) for c, v in found.items()}


@pytest.mark.parametrize("block", [1 << 20, 3])
def test_awkward_rows_against_recursion(spark, monkeypatch, block):
    """Null ids, turns, roles and texts, ties, repeated rows, blank and long texts, and extra columns of clashing names."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = awkward(block, 25)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, audit string, h int, line int")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damage(df), df).collect()}
    assert got == with_digest(brute(rows))


def test_repaired_turns(spark):
    rows = awkward(4, 9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = {}
    for r in sorted(repair.repaired(df, repair.edits(df)).collect(), key=lambda r: r.seq):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    want = {c: list(v[7]) for c, v in brute(rows, damaged=False).items()}
    assert lines == {c: v for c, v in want.items() if v}


def test_text_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 4, "assistant", "Yes.")], "conv_id string, turn int, role string, text string")
    assert [tuple(r)[:8] for r in repair.repair(df).collect()] == [("a", 2, 0, 0, 0, 0, 0, "KK")]
    assert repair.repair(repair.damage(df.limit(0)), df.limit(0)).count() == 0
    gone = repair.repair(df.limit(0), df).collect()
    assert [tuple(r) for r in gone] == [("a", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversation_is_one_column():
    codes = np.full((40_001, 1), repair.END, np.uint8)
    codes[:-1, 0] = np.tile([4, 8, 6, 9], 10_000)  # user, assistant, blank, cut assistant
    offsets, steps = repair.backward_costs(codes)
    assert offsets.max() <= 12 and offsets.min() == 0
    audit = repair.trace(codes, offsets, steps)[0]
    assert audit == "KKDD" * 10_000 and steps.sum() + offsets[0, 0, 0] == 40_000
