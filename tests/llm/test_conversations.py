import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from portflow.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    """Rows (conv_id, turn, role, text) after damage."""
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if harm:
            row = (c, t, "user" if harm == 4 else role, "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text)
            out += [row] * (2 if harm == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired lines): the least (cost, audit) as words, by what the roles so far end in ('', s, u, a)."""
    allows = lambda shape, i: (shape, i) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def closed(nodes):
        for _ in range(3):
            for shape, (cost, audit, lines) in list(nodes.items()):
                for name in ("user", "assistant"):
                    if allows(shape, name[0]):
                        path = cost + 3, audit + "I", (*lines, f"{name}:")
                        nodes[name[0]] = min(nodes.get(name[0], path), path)
        return nodes

    nodes = closed({"": (0, "", ())})
    for (role, text), fault in zip(rows, found):
        after = {}
        for shape, (cost, audit, lines) in nodes.items():
            steps = [(shape, 4, "D", ())]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                steps += [(role[:1], more, "K", (f"{role}:{text}",))] if allows(shape, role[:1]) else []
                steps += [(n[0], 3 + more, "R", (f"{n}:{text}",)) for n in ("user", "assistant") if allows(shape, n[0])]
            for to, c, letter, line in steps:
                path = cost + c, audit + letter, lines + line
                after[to] = min(after.get(to, path), path)
        nodes = closed(after)
    return min(nodes[s] for s in ("", "a") if s in nodes)


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in damaged(rows) if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        lines = [r[2:] for r in mine]
        found = faults(lines)
        turns = {r[1] for r in mine} - {None}
        cost, audit, kept = cheapest(lines, found)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[c] = (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def run(spark, rows, kind="long"):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"conv_id {kind}, turn long, role string, text string, n int, fault string").repartition(3)
    got = C.with_ids(C.repair(C.damage(df)), df).collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got}
    assert len(out) == len(got)
    return out


def random_rows(g, convs, most):
    out = []
    for c in convs:
        for t in range(g.randrange(1, most)):
            role = g.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "uber"])
            out.append((c, g.choice([t, t, t, None, t // 2, 3 * t]), role, g.choice(["Hi.", "Hi", "Well! \n", " \t", "", None, "Ünï 猫?", "a" * 50 + ".", f"{t}."])))
    return out


def test_all_edits_of_short_rows():
    g = random.Random(1)
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for _ in range(25):
        rows = [(g.choice("ssuuaax"), g.choice([C.BLANK, C.DUPLICATE, C.CUT, C.FINE, C.FINE])) for _ in range(g.randrange(4))]
        best = None
        gap = ["", "u", "a", "uu", "ua", "au", "aa"]
        for inserts in itertools.product(gap, repeat=len(rows) + 1):
            for choice in itertools.product(*[["D"] if f in (C.BLANK, C.DUPLICATE) else ["D", "K", "u", "a"] for _, f in rows]):
                roles, audit, cost = inserts[0], "I" * len(inserts[0]), 3 * len(inserts[0])
                for (initial, fault), e, more in zip(rows, choice, inserts[1:]):
                    roles += {"D": "", "K": initial}.get(e, e) + more
                    audit += (e if e in "DK" else "R") + "I" * len(more)
                    cost += {"D": 4, "K": 0}.get(e, 3) + 3 * len(more) + (3 if e != "D" and fault == C.CUT else 0)
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
        found = C.paths(tuple((i if i in "sua" else "", f, 1) for i, f in rows), (C.NONE,))
        assert min(v for (_, end), v in found.items() if end in (C.NONE, C.ASSISTANT)) == best
        kept = list(C.edits(best[1], iter([(names[i], "t", 1) for i, _ in rows])))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in kept))


@pytest.mark.parametrize("rows", [1, 3, 256])
def test_segments_of_any_size(spark, monkeypatch, rows):
    monkeypatch.setattr(C, "ROWS", rows)
    g = random.Random(rows)
    table = random_rows(g, [None, *range(30)], 9) + random_rows(g, [77], 150) + [(88, 4, "user", "Again.")] * 40 + [(89, 7, "user", "x")] * 3 + [(90, None, None, None)] * 5
    assert run(spark, table) == brute(table)


def test_nothing_left_and_empty(spark):
    gone = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    table = [(*gone, "user", "All of it goes.")]
    assert run(spark, table) == brute(table) == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert run(spark, []) == {}


def test_repaired_turns_are_what_the_digest_says(spark):
    table = random_rows(random.Random(4), range(20), 9) + [(50, 0, "user", "long " * 300_000 + "."), (50, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    turns = C.repaired_turns(df)
    assert turns.columns == ["conv_id", "place", "edit", "role", "text"]
    lines = {}
    for r in turns.orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    for r in C.repair(df).collect():
        mine = lines.get(r.conv_id, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in mine))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in mine).encode()).hexdigest() == r.repaired_sha256
        assert len(r.audit) - r.audit.count("D") == len(mine)


def test_conv_id_of_text(spark):
    rows = [("a", t, r, "Hi there.") for t, r in enumerate(["user", "assistant", "assistant"])]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    assert [(r.conv_id, r.audit, r.cost) for r in C.repair(df).collect()] == [("a", "KKD", 4)]
    assert C.repair(df.withColumn("extra", F.lit(1))).count() == 1
