"""Windows against a loop over turns, and the round trip of texts."""

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, queries
from tidemark.llm.chat_format import BLOCK_BUDGETS, format_conversations, read_back
from tidemark.operators import ordered

COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def escape(text, role=False):
    for plain, code in [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"), ("\n", "\\l")][: 4 if role else 3]:
        text = text.replace(plain, code)
    return text


def body(role, text):
    return f"### {escape(role, True)}\n{escape(text)}</turn>\n"


def windows(turns, budget, history, size):
    """(first turn, context turns, new turns, text, spans) by a loop; ``turns`` in order."""
    bodies = [body(r, t) for r, t in turns]
    sizes = [max(1, size(b)) for b in bodies]
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    latest, out, i = None, [], 0
    span = budget * BLOCK_BUDGETS
    while i < len(turns):
        system = next((j for j in range(i - 1, -1, -1) if turns[j][0] == "system"), None) if turns[i][0] != "system" else None
        room = budget - history - (sizes[system] if system is not None else 0)
        j = i + 1
        while j < len(turns) and starts[j] // span == starts[i] // span and starts[j] + sizes[j] - starts[i] <= room:
            j += 1
        first = i
        while first > 0 and starts[i] - starts[first - 1] <= history:
            first -= 1
        context = list(range(first, i))
        if system is not None and not any(turns[c][0] == "system" for c in context):
            context = [system, *context]
        text, spans = "", []
        for c in [*context, *range(i, j)]:
            if c >= i and turns[c][0] == "assistant":
                spans.append((len(text) + len(f"### {escape(turns[c][0], True)}\n"), len(escape(turns[c][1]))))
            text += bodies[c]
        out.append((i + 1, len(context), j - i, text, spans, sum(sizes[c] for c in [*context, *range(i, j)])))
        i = j
    return out


def conversation(r, n):
    words = ["a", "###", "\\", "</turn>", "\\b", "é🙂", "\n", "### user\n", "long" * 5, "\\h", ""]
    return [(r.choice(["system", "user", "assistant", "user", "assistant", "tool\nx"]), " ".join(r.choice(words) for _ in range(r.randrange(12)))) for _ in range(n)]


def count(text):
    return len(text) // 3


def sized(column):
    return F.expr("1") * F.floor(F.length(column) / 3)


def check(spark, chats, budget, history):
    rows = [(c, i, r, t) for c, turns in chats.items() for i, (r, t) in enumerate(turns)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = read_back(format_conversations(df, budget=budget, history=history, tokens=sized)).collect()
    found = {}
    for r in sorted(got, key=lambda r: r.first_turn):
        found.setdefault(r.conv_id, []).append(r)
    assert set(found) == {c for c, t in chats.items() if t}
    for c, rows in found.items():
        want = windows(chats[c], budget, history, count)
        assert [(r.first_turn, r.n_context, r.n_turns, r.formatted, [tuple(x) for x in r.loss], r.n_tokens) for r in rows] == want
        assert [tuple(t) for r in rows for t in r.turns] == chats[c]
        assert [t for r in rows for t in r.targets] == [t for role, t in chats[c] if role == "assistant"]
        assert all(r.over_budget == (r.n_tokens > budget) for r in rows)
        assert all(not r.over_budget or r.n_turns == 1 for r in rows)


@pytest.mark.parametrize("budget,history", [(40, 0), (60, 20), (100, 30), (10_000, 100)])
def test_windows(spark, budget, history):
    r = random.Random(budget)
    check(spark, {c: conversation(r, r.choice([1, 2, 3, 8, 30])) for c in range(40)} | {99: conversation(r, 400)}, budget, history)


def test_one_conversation_over_many_partitions(spark, monkeypatch):
    """Prefix sums over blocks of a heavy conversation."""
    monkeypatch.setattr(ordered, "HEAVY_ROWS", 100)
    monkeypatch.setattr(ordered, "HEAVY_TIMES", 2)
    r = random.Random(8)
    check(spark, {1: conversation(r, 900), 2: conversation(r, 30)}, 60, 20)


def digest(text):
    return sha256(text.encode()).hexdigest()


def expected(rows, budget=chat_format.BUDGET, history=chat_format.HISTORY):
    """The query's rows; where turns are told apart by their number."""
    marks = "\\### Assistant: </turn> ok"
    chats = {}
    for c, t, r, x in [*rows, (-7, 0, "user", marks), (-7, 1, "assistant", marks)]:
        chats.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c, turns in chats.items():
        turns = [(r, x) for *_, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        tokens = lambda b: len(re.findall(r"[^\W\d_]{1,8}|\d|[^\s\w]|_", b))
        made = windows(turns, budget, history, tokens)
        yield c, len(turns), digest("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), digest(loss), sum(len(w[3]) for w in made)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op12_chat_format(spark, sf)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == sorted(expected(rows))


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None), (1, 0, "assistant", ""), (2, 0, "system", "s" * 300_000), (2, 1, "assistant", "a " * 100_000), (2, 2, "user", "x"), (None, 0, "user", "null id"), (None, 1, "assistant", "yes"), (3, 5, "assistant", "twice"), (3, 5, "assistant", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit("x"), "start": F.lit(1), "conv": F.lit(None).cast("int")})
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((tuple(r) for r in queries.op12_chat_format(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(expected(rows), key=str)


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_conversations(none).collect() == []
