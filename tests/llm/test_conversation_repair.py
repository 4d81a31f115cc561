"""Repairs against a search over all edits."""

import heapq
import itertools
import random
import re
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.conversation_repair import CUT_OFF, FINE, MUST_GO, Repaired, Repairer

OK = re.compile(r"(s?(ua)+)?")


def cheapest(symbols):
    """The least (cost, audit) over all sequences of edits, by a search in order of cost and audit over outputs that can become well formed."""
    heap = [(0, "", 0, "")]
    seen = set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        state = (i, out[-1:])
        if state in seen:
            continue
        if i == len(symbols) and OK.fullmatch(out):
            return cost, audit, out
        seen.add(state)
        steps = [(2, "I", i, out + c) for c in "ua"]
        if i < len(symbols):
            role, fault = symbols[i]
            steps.append((3, "D", i + 1, out))
            if fault != MUST_GO:
                more = fault == CUT_OFF
                steps += [(more, "K", i + 1, out + role)] + [(2 + more, "R", i + 1, out + c) for c in "ua"]
        for more, letter, j, o in steps:
            if re.fullmatch(r"s?(ua)*u?", o):
                heapq.heappush(heap, (cost + more, audit + letter, j, o))


def test_all_short_conversations():
    symbols = list(itertools.product("suax", (FINE, MUST_GO, CUT_OFF)))
    repairer = Repairer()
    for n in range(4):
        for rows in itertools.product(symbols, repeat=n):
            cost, edits, tail = repairer.repair(list(rows))
            audit = "".join("I" * len(b) + e for b, e, _ in edits) + "I" * len(tail)
            assert (cost, audit) == cheapest(rows)[:2], rows
    repairer.repair([(random.Random(i).choice('suaax'), i * 7 % 3) for i in range(5000)])
    assert len(repairer.vectors) < 100


@pytest.mark.parametrize("seed", range(150))
def test_long_conversations(seed):
    r = random.Random(seed)
    rows = [(r.choice("suuaaax"), r.choice((FINE, FINE, MUST_GO, CUT_OFF))) for _ in range(r.randrange(4, 14))]
    cost, edits, tail = Repairer().repair(rows)
    audit = "".join("I" * len(b) + e for b, e, _ in edits) + "I" * len(tail)
    assert (cost, audit) == cheapest(rows)[:2]
    out = "".join(b + {"D": "", "K": s, "R": c}[e] for (b, e, c), (s, _) in zip(edits, rows)) + tail
    assert OK.fullmatch(out)


def damaged(rows):
    for conv, turn, role, text in rows:
        none = lambda x: " " if x is None else x
        h = crc32(f"{none(conv)}:{none(turn)}".encode()) % 20
        role, text = none(role), none(text)
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        yield conv, turn, "user" if h == 4 else role, text
        if h == 3:
            yield conv, turn, role, text


def expected(rows):
    groups = {r[0]: [] for r in rows}
    for r in damaged(rows):
        groups[r[0]].append(r)
    return {conv: judged(mine) for conv, mine in groups.items()}


def judged(mine):
    digest = lambda s: sha256(s.encode()).hexdigest()
    mine = sorted(mine, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), digest(r[3])))
    turns = [r[1] for r in mine if r[1] is not None]
    seen, symbols, found = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in mine:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            found[fault] += 1
        symbols.append((role[:1] or "-", MUST_GO if fault in ("blank", "duplicate") else CUT_OFF if fault else FINE))
    cost, audit, out = cheapest(symbols)
    lines, roles, i = [], iter(out), 0
    for x in audit:
        c = next(roles) if x != "D" else ""
        full = {"u": "user", "a": "assistant"}
        if x == "I":
            lines.append(f"{full[c]}:")
        else:
            if x != "D":
                lines.append(f"{full[c] if x == 'R' else mine[i][2]}:{mine[i][3]}")
            i += 1
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *found.values(), illegal, cost, audit, digest("\n".join(lines)))


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op13_conversation_repair(spark, sf)
    assert found.columns == COLUMNS
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    want = expected(rows)
    assert got == want and len({w[6] for w in want.values()}) > 5


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes."), (2, 5, "assistant", "no end"), (2, 9, "user", "a.\n"), (2, 9, "user", "a.\n"), (2, 9, "user", "b."),
    (3, None, "user", None), (3, None, None, "x."), (3, 4, "", "y."), (4, 0, "tool", "z!"), (None, 1, "user", "q."), (None, None, "assistant", "r"), (5, 1, "user", "  \n"), (6, None, "user", "a" * 200_000 + "."), (6, 3, "assistant", "é. \x0b"),
]


def test_odd_rows(spark):
    rows = ROWS + [(7 + i % 3, i, random.Random(i).choice(["user", "assistant", "system", "user"]), f"{i % 5}{'.' if i % 4 else ''}") for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit(1), "digest": F.lit("x"), "conv": F.lit(2)})
    found = Repaired(df)
    got = {r[0]: tuple(r)[1:] for r in found.report().collect()}
    said = {r.conv: r.repaired_sha256 for r in found.digests().collect()}
    blank = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    groups = {c: [r for r in blank if r[0] == c] for c, *_ in blank}
    assert {c: (*got[c], said[c]) for c in got} == {c: judged(mine) for c, mine in groups.items()}
    told = {}
    for r in sorted(found.conversations().collect(), key=lambda r: r.position):
        told.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    assert {c: sha256("\n".join(told.get(c, [])).encode()).hexdigest() for c in said} == said


def test_whole_query_on_odd_rows(spark, tmp_path):
    rows = ROWS + [(100 + i // 3, i % 3, "user" if i % 3 else "system", "t.") for i in range(300)] + [(1000 + i, 0, "user", "t.") for i in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r[0]: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == expected(rows)
    assert any(w[6] == "" and w[7] == sha256(b"").hexdigest() for w in got.values())


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found = Repaired(none)
    assert found.report().collect() == [] and found.digests().collect() == [] and found.conversations().collect() == []
