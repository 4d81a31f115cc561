"""Faults of conversations and the cheapest edits that make them well formed.

A conversation is well formed if the first letters of its roles read ``(s?(ua)+)?``: nothing, or user and assistant in turn,
perhaps after one system row. Edits of a row are Keep (K, costs 0), Rerole to user or assistant (R, 2) and Delete (D, 3; blank
and repeated rows must go), and an empty user or assistant row can be put in anywhere (I, 2). A truncated row that stays adds 1.

The weighted automaton of all edits is determinised lazily: the costs of its four states after a row, less the least of them,
are one state of the deterministic automaton, and its transitions are cached in a table. A scan of a conversation's rows
through the table sums its least cost. Then the scan's states are walked backwards, marking those that tight arcs (arcs of a
cheapest way) join with the end, and the audit takes the least letter among marked arcs from the front.

Rows that matter for edits are numbers of few bytes; texts are shuffled once, in order, to be written out with their edits.
"""

from __future__ import annotations

from array import array
from collections import deque
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace
from tidemark.operators.ordered import Ordered

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the language: nothing yet, after s, after u, after a; the letters that lead on, and where a conversation may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
FREE = 1 << 30
FINE, MUST_GO, CUT_OFF = 0, 1, 2


class Repairer:
    """The determinised automaton; one for each task, filled as its rows need it. A symbol is (first letter of the role, FINE, MUST_GO or CUT_OFF)."""

    def __init__(self):
        self.vectors: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.steps: dict = {}
        self.marks: dict = {}
        self.start, _ = self._state([0, FREE, FREE, FREE])

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """The state of these costs after any insertions, and the least cost, which is taken off."""
        changed = True
        while changed:
            changed = False
            for p in range(4):
                for c, q in NEXT[p].items():
                    if c in NAMES and costs[p] + INSERT < costs[q]:
                        costs[q], changed = costs[p] + INSERT, True
        # Whatever can follow an s can follow an a, and so can what may begin a conversation, once a row s is deleted. Ways that cost
        # more than these can't be the cheapest; without them the states are few, however long conversations are.
        if costs[1] > costs[3]:
            costs[1] = FREE
        if costs[0] > costs[3] + DELETE:
            costs[0] = FREE
        least = min(costs)
        vector = tuple(x - least if x < FREE else FREE for x in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.ids[vector], least

    @staticmethod
    def arcs(symbol: tuple[str, int]):
        """(letter, from, to, cost) of the edits of a row, least letters first."""
        role, fault = symbol
        found = [("D", p, p, DELETE) for p in range(4)]
        if fault != MUST_GO:
            more = TRUNCATED if fault == CUT_OFF else 0
            found += [("K", p, NEXT[p][role], more) for p in range(4) if role in NEXT[p]]
            found += [("R", p, q, REROLE + more) for p in range(4) for c, q in NEXT[p].items() if c in NAMES]
        return found

    def step(self, state: int, symbol) -> tuple[int, int]:
        """The next state and the cost, from the table."""
        found = self.steps.get((state, symbol))
        if found is None:
            v, costs = self.vectors[state], [FREE] * 4
            for _, p, q, cost in self.arcs(symbol):
                costs[q] = min(costs[q], v[p] + cost if v[p] < FREE else FREE)
            found = self.steps[state, symbol] = self._state(costs)
        return found

    def _tight_inserts(self, state: int):
        v = self.vectors[state]
        return [(p, q) for p in range(4) for c, q in NEXT[p].items() if c in NAMES and v[p] < FREE and v[p] + INSERT == v[q]]

    def _spread(self, state: int, mark: int) -> int:
        """The marked states and those that tight insertions join with them."""
        for _ in range(4):
            for p, q in self._tight_inserts(state):
                if mark >> q & 1:
                    mark |= 1 << p
        return mark

    def end(self, state: int) -> tuple[int, int]:
        """The least cost of ending, over the state's own least, and the marked states."""
        v = self.vectors[state]
        cost = min(v[q] for q in ENDS)
        return cost, self._spread(state, sum(1 << q for q in ENDS if v[q] == cost))

    def back(self, state: int, symbol, mark: int) -> int:
        """The states before a row that tight arcs join with the marked ones after it."""
        found = self.marks.get((state, symbol, mark))
        if found is None:
            after, least = self.step(state, symbol)
            v, w = self.vectors[state], self.vectors[after]
            found = self.marks[state, symbol, mark] = self._spread(state, sum(1 << p for p in {p for _, p, q, cost in self.arcs(symbol) if mark >> q & 1 and v[p] < FREE and v[p] + cost == w[q] + least}))
        return found

    def repair(self, symbols: list) -> tuple[int, list[tuple[str, str, str]], str]:
        """The least cost, for each row (letters put in before it, edit, letter of its new role), and the letters put in at the end."""
        state, cost, states = self.start, 0, array("H", [self.start])
        for symbol in symbols:
            state, more = self.step(state, symbol)
            cost += more
            states.append(state)
        more, mark = self.end(state)
        marks = bytearray(len(symbols) + 1)
        marks[-1] = mark
        for i in range(len(symbols) - 1, -1, -1):
            marks[i] = mark = self.back(states[i], symbols[i], mark)
        at, out = 0, []
        for i, symbol in enumerate(symbols):
            before = ""
            v, (after, least) = self.vectors[states[i]], self.step(states[i], symbol)
            w = self.vectors[after]
            while True:
                tight = [(x, q) for x, p, q, c in self.arcs(symbol) if p == at and marks[i + 1] >> q & 1 and v[p] + c == w[q] + least]
                inserted = [q for p, q in self._tight_inserts(states[i]) if p == at and marks[i] >> q & 1]
                edit, to = min(tight, default=("Z", 0))
                if inserted and edit > "I":
                    at = inserted[0]
                    before += "ua"[at == 3]
                    continue
                break
            out.append((before, edit, "ua"[to == 3] if edit == "R" else ""))
            at = to
        v, tail = self.vectors[state], ""
        while not (at in ENDS and v[at] == more):
            at = next(q for p, q in self._tight_inserts(state) if p == at and marks[-1] >> q & 1)
            tail += "ua"[at == 3]
        return cost + more, out, tail


KEY = ["conv", "turn", "role", "digest"]
EDITS = "conv {0}, turn bigint, role string, digest string, n bigint, inserted string, edit string, rerole string, tail string, cost bigint, audit string"


def _groups(batches, column: str):
    """Runs of rows of one conversation, over batches: (batch, start, stop, whether it begins, whether it surely ends)."""
    held, last = None, object()
    for batch in batches:
        values = batch.column(column).to_pylist()
        cuts = [0, *[i for i in range(1, len(values)) if values[i] != values[i - 1]], len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held:
                yield (*held, values[a] != last)
            held, last = (batch, a, b, values[a] != last), values[a]
    if held:
        yield (*held, True)


def _edit(schema: pa.Schema):
    def scan(batches):
        repairer, parts, symbols = Repairer(), [], []
        for batch, a, b, begins, ends in _groups(batches, "conv"):
            if begins:
                parts, symbols = [], []
            part = batch.slice(a, b - a)
            parts.append(part.select([*KEY, "n"]))
            symbols += zip(part.column("initial").to_pylist(), part.column("state").to_pylist())
            if not ends:
                continue
            cost, edits, tail = repairer.repair(symbols)
            audit, at = "".join("I" * len(before) + edit for before, edit, _ in edits) + "I" * len(tail), 0
            for part in parts:
                mine = edits[at : at + part.num_rows]
                at += part.num_rows
                none = [None] * (part.num_rows - 1)
                final = at == len(edits)  # the conversation's last row carries what is of the whole
                made = [[e[0] for e in mine], [e[1] for e in mine], [e[2] for e in mine], *[[*none, x if final else None] for x in (tail, cost, audit)]]
                arrays = [*part.columns, *[pa.array(x, schema.field(6 + k - 1).type) for k, x in enumerate(made)]]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return scan


def examined(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, digest, n, initial, fault, state, before): rows in order with their first fault; no texts.

    The order is by turn, nulls first, then by role and digest of the text. A row repeats an earlier one if role and digest
    (SHA-256) are the same. ``before`` is the letter of the row before.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*$", 1)
    small = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.sha2(text.cast("binary"), 256).alias("digest"), last.alias("last"))
    small = small.withColumn("initial", F.substring("role", 1, 1))
    placed = Ordered(small, ["conv"], ["turn", "role", "digest"]).ordinal("n").previous("before", F.col("initial")).frame()
    seen = Ordered(placed, ["conv", "role", "digest"], ["n"]).ordinal("nth").frame()
    fault = F.when(F.col("last") == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    state = F.when(fault.isin("blank", "duplicate"), MUST_GO).when(fault == "truncated", CUT_OFF).otherwise(FINE)
    return seen.select(*KEY, "n", "initial", "before", fault.alias("fault"), state.cast("int").alias("state"))


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *order)


def edits(rows: DataFrame) -> DataFrame:
    """For each row of ``examined``: roles put in before it (letters), its edit, its new role; on a conversation's last row also the roles put in at the end, the cost and the audit."""
    kind = rows.schema["conv"].dataType
    ddl = EDITS.format(kind.simpleString())
    arrow = pa.schema([pa.field("conv", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()])] + [pa.field(c, t) for c, t in zip(
        ["turn", "role", "digest", "n", "inserted", "edit", "rerole", "tail", "cost", "audit"], [pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string()])])
    return _in_order(rows.select(*KEY, "n", "initial", "state"), "n").mapInArrow(_edit(arrow), ddl)


def report(seen: DataFrame, changes: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of the conversations that have rows."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    pair = F.concat("before", "initial")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    told = seen.groupBy("conv").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *[count(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")], count(~pair.isin("su", "ua", "au")).alias("illegal"))
    whole = changes.where("audit is not null").select(F.col("conv").alias("_conv"), "cost", "audit")
    return told.join(whole, F.col("conv").eqNullSafe(F.col("_conv")), "left").drop("_conv")


def _rewritten(batches):
    """(conv, begins, [(role, text), ...]) for each piece of a conversation: rows and edits come in one order, the edits of equal rows first."""
    waiting, tail = deque(), ""
    for batch, a, b, begins, ends in _groups(batches, "conv"):
        part, said = batch.slice(a, b - a), []
        if begins:
            waiting.clear()
            tail = ""
        for row in zip(*[part.column(c).to_pylist() for c in ("role", "edit", "inserted", "rerole", "tail", "text")]):
            role, edit, inserted, rerole, last, text = row
            if edit is not None:
                waiting.append((edit, inserted, rerole))
                tail = last or tail
                continue
            edit, inserted, rerole = waiting.popleft()
            said += [(NAMES[c], "") for c in inserted]
            if edit != "D":
                said.append((NAMES[rerole] if edit == "R" else role, text))
        if ends:
            said += [(NAMES[c], "") for c in tail]
        yield part.column("conv").slice(0, 1), begins, ends, said


def _rows_out(batches):
    at = 0
    for conv, begins, _, said in _rewritten(batches):
        at = 0 if begins else at
        if said:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([conv] * len(said)), pa.array(range(at, at + len(said)), pa.int64()), pa.array([r for r, _ in said], pa.string()), pa.array([t for _, t in said], pa.string())], ["conv", "position", "role", "text"])
        at += len(said)


def _digests_out(batches):
    digest, first = sha256(), True
    for conv, begins, ends, said in _rewritten(batches):
        if begins:
            digest, first = sha256(), True
        for role, text in said:
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        if ends:
            yield pa.RecordBatch.from_arrays([conv, pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])


def _with_texts(rows: DataFrame, changes: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    texts = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("text"))
    both = changes.select(*KEY, "n", "inserted", "edit", "rerole", "tail").unionByName(texts, allowMissingColumns=True)
    return _in_order(both, "turn", "role", "digest", F.col("edit").isNull().cast("int"), "n")


class Repaired:
    """What is wrong with each conversation, the cheapest edits, and the repaired rows.

    ``rows`` has a conversation id, a turn, a role and a text. Null roles and texts count as one blank, null ids are one
    conversation, null turns come first, rows of one turn are ordered by role and digest. Rows that are equal in all of these
    are interchangeable. Other columns are not read. A conversation's edits are found in one task, from a few bytes for each
    row; texts pass through in order, one batch at a time, however long a conversation is.
    """

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
        self.rows, self.columns = rows, (conv_col, turn_col, role_col, text_col)
        ws = Workspace(rows.sparkSession, "repair")
        self.seen = ws.table(examined(rows, *self.columns), "seen")
        self.changes = ws.table(edits(self.seen), "edits")

    def report(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation that has rows."""
        return report(self.seen, self.changes)

    def conversations(self) -> DataFrame:
        """(conv, position, role, text): the repaired rows."""
        kind = self.seen.schema["conv"].dataType.simpleString()
        return _with_texts(self.rows, self.changes, *self.columns).mapInArrow(_rows_out, f"conv {kind}, position bigint, role string, text string")

    def digests(self) -> DataFrame:
        """(conv, repaired_sha256): SHA-256 of the repaired ``role:text``, joined by line feeds, made as the rows stream by."""
        kind = self.seen.schema["conv"].dataType.simpleString()
        return _with_texts(self.rows, self.changes, *self.columns).mapInArrow(_digests_out, f"conv {kind}, repaired_sha256 string")
