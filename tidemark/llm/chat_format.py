"""Conversations as marked-up texts of bounded size, with the stretches that a loss is taken over.

Prefix sums of the turns' tokens choose where a conversation is cut: a window takes whole turns as long as they fit into what
the budget leaves beside the retained system turn and the repeated history. Each window repeats the latest system turn and
up to ``history`` tokens of the turns just before it; assistant texts that are repeated are masked, so over all windows each
assistant text is under the loss once.

Only DataFrame functions are used. Prefix sums come from ``Ordered``, which spreads a conversation with very many turns over
partitions. Windows begin anew wherever the prefix sum passes a multiple of ``BLOCK_BUDGETS`` budgets, so cuts are found
within blocks of bounded size, which are what a task holds, and not within whole conversations.

A turn is ``### role``, a line feed, the text and ``</turn>``, a line feed. In roles and texts a backslash becomes ``\\b``,
``###`` becomes ``\\h`` and ``</turn>`` becomes ``\\e``, in roles a line feed becomes ``\\l``: every backslash of the output is
followed by one of these letters, so ``unescaped`` gives back what was there, and neither mark occurs within a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace
from tidemark.operators.ordered import Ordered

BUDGET, HISTORY = 1024, 256
BLOCK_BUDGETS = 16
HEAD, END = "### ", "</turn>\n"
#: What is escaped, in order; the last is for roles alone.
ESCAPES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"), ("\n", "\\l")]
#: Stretches of up to eight letters, digits and other marks one by one.
TOKEN = r"[\p{L}\p{M}]{1,8}|\p{N}|[^\s\p{L}\p{M}\p{N}]"


def pieces(text: Column) -> Column:
    """How many tokens a text counts for, unless a caller has a better measure."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES[: 4 if role else 3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, role: bool = False) -> Column:
    for plain, code in reversed(ESCAPES[: 4 if role else 3]):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str, tokens: Callable[[Column], Column]) -> DataFrame:
    """(conv, turn, role, body, head, size, chars): each turn as it is written, with the length of its head."""
    said = F.coalesce(F.col(role).cast("string"), F.lit(""))
    head = F.concat(F.lit(HEAD), escaped(said, True), F.lit("\n"))
    content = escaped(F.coalesce(F.col(text).cast("string"), F.lit("")))
    made = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), said.alias("role"), F.concat(head, content, F.lit(END)).alias("body"), F.length(head).cast("long").alias("head"))
    # The marks of a turn count for at least one token, so a block holds a bounded number of turns.
    return made.withColumns({"size": F.greatest(F.lit(1).cast("long"), tokens(F.col("body"))), "chars": F.length("body").cast("long"), "hash": F.xxhash64("body")})


def _cuts(own: Column, budget: int, history: int) -> Column:
    """Numbers of the turns at which windows begin, by a fold over the turns of a block (n, start, size, kept)."""
    room = lambda x: F.greatest(F.lit(0).cast("long"), F.lit(budget - history).cast("long") - x["kept"])
    none = F.struct(F.array().cast("array<bigint>").alias("cuts"), F.lit(0).cast("long").alias("until"))

    def step(state, x):
        new = (F.size(state["cuts"]) == 0) | (x["start"] + x["size"] > state["until"])
        return F.struct(F.when(new, F.concat(state["cuts"], F.array(x["n"]))).otherwise(state["cuts"]).alias("cuts"), F.when(new, x["start"] + room(x)).otherwise(state["until"]).alias("until"))

    return F.aggregate(own, none, step, lambda state: state["cuts"])


def format_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[Column], Column] = pieces,
) -> DataFrame:
    """(conv, first_turn, n_context, n_turns, n_tokens, over_budget, formatted, loss) for each window of a conversation.

    ``first_turn`` is the number of the first turn that is new in the window, by which windows are in order; ``n_context`` turns
    before it (the retained system turn and history) are repeated from earlier windows, and ``n_turns`` are new. ``loss`` lists
    (start, length) in code points of ``formatted``, start from 0: the contents of its new assistant turns. A turn that doesn't fit
    is a window of its own with ``over_budget`` true; no text is cut.

    Turns are in the order of ``turn`` (nulls first), then of role and a hash of the text; null roles and texts are empty, null
    ids one conversation. Other columns are not read. A conversation has as many windows as it needs.
    """
    turns = _turns(rows, conv_col, turn_col, role_col, text_col, tokens)
    system = F.col("role") == "system"
    placed = Ordered(turns, ["conv"], ["turn", "role", "hash"]).ordinal("n").total("end", F.col("size")).total("stop", F.col("chars")).total("k", system.cast("long")).last("kept", F.when(system, F.col("size")))
    table = placed.frame().select("conv", "n", "role", "body", "head", "size", "chars", "k", system.alias("is_system"), (F.col("end") - F.col("size")).alias("start"), (F.col("stop") - F.col("chars")).alias("at"), F.when(system, 0).otherwise(F.coalesce("kept", F.lit(0))).cast("long").alias("kept"))
    ws = Workspace(rows.sparkSession, "chat")
    table = ws.table(table, "turns")
    span = budget * BLOCK_BUDGETS
    block = F.expr(f"start div {span}")
    # A turn near the end of a block is history for the next one too.
    blocks = F.when(F.expr(f"(start + {history}) div {span}") > block, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = table.withColumns({"blocks": blocks, "home": block, "answers": F.col("role") == "assistant"})
    dealt = dealt.select("conv", F.explode("blocks").alias("block"), F.struct("n", "start", "size", "kept", "k", "is_system", "answers", "head", "chars", "at", "body", "home").alias("x"))
    groups = dealt.groupBy("conv", "block").agg(F.array_sort(F.collect_list("x")).alias("all"))
    groups = groups.withColumn("own", F.filter("all", lambda x: x["home"] == F.col("block"))).where("size(own) > 0")
    groups = groups.withColumn("cuts", _cuts(F.col("own"), budget, history))
    new = F.filter("all", lambda x: (x["n"] >= F.col("w.from")) & (x["n"] < F.col("w.to")) & (x["n"] <= F.col("most")))
    ends = F.transform("cuts", lambda c, i: F.struct(c.alias("from"), F.coalesce(F.get(F.col("cuts"), i + 1), F.lit(1 << 62)).alias("to")))
    cut = groups.select("conv", "all", F.explode(ends).alias("w"), F.element_at("own", -1)["n"].alias("most"))
    cut = cut.select("conv", "all", new.alias("new"))
    before = F.filter("all", lambda x: (x["n"] < F.col("new")[0]["n"]) & (F.col("new")[0]["start"] - x["start"] <= history))
    cut = cut.select("conv", "new", before.alias("old"))
    first, both = F.col("new")[0], F.concat("old", "new")
    # The system turn is put before the others unless it is among them anyway.
    wanted = F.when(~first["is_system"] & (first["k"] > 0) & ~F.exists("old", lambda x: x["is_system"]), first["k"])
    begin = both[0]
    last = F.element_at("new", -1)
    made = cut.select(
        "conv", first["n"].alias("first_turn"), F.size("old").alias("n_old"), F.size("new").alias("n_turns"), (last["start"] + last["size"] - begin["start"]).alias("n_tokens"),
        F.array_join(F.transform(both, lambda x: x["body"]), "").alias("text"), wanted.alias("k"),
        F.transform(F.filter("new", lambda x: x["answers"]), lambda x: F.struct((x["at"] - begin["at"] + x["head"]).alias("start"), (x["chars"] - x["head"] - len(END)).alias("length"))).alias("spans"),
    )
    systems = table.where("is_system").select(F.col("conv").alias("_conv"), F.col("k").alias("_k"), F.col("body").alias("_body"), F.col("size").alias("_size"), F.col("chars").alias("_chars"))
    met = made.join(systems, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("k") == F.col("_k")), "left")
    extra, more = F.coalesce("_chars", F.lit(0)), F.coalesce("_size", F.lit(0))
    total = F.col("n_tokens") + more
    return met.select(
        F.col("conv").alias(conv_col), "first_turn", (F.col("n_old") + F.col("_k").isNotNull().cast("int")).alias("n_context"), "n_turns", total.alias("n_tokens"), (total > budget).alias("over_budget"),
        F.concat(F.coalesce("_body", F.lit("")), F.col("text")).alias("formatted"), F.transform("spans", lambda s: F.struct((s["start"] + extra).alias("start"), s["length"])).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """The windows with ``turns``, an array of (role, text) of their new turns, and ``targets``, the texts under the loss, from ``formatted`` alone."""
    parts = F.split("formatted", F.lit(r"\Q" + END + r"\E"))
    told = F.slice(parts, F.col("n_context") + 1, F.col("n_turns"))

    def turn(x):
        role = F.substring_index(x, "\n", 1)
        text = F.substr(x, F.length(role) + 2)
        return F.struct(unescaped(F.substr(role, F.lit(len(HEAD) + 1)), True).alias("role"), unescaped(text).alias("text"))

    targets = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.withColumns({"turns": F.transform(told, turn), "targets": targets})
