"""Connected components of a graph given as a table of edges, and links found by comparing what shares an index list."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import log
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace

#: Members in a block of an index list.
BLOCK = 64
_CELL = ["list", "cell", "late", "near"]
_RANGE = [*_CELL, "cut"]
_BLOCK_KEY = [*_RANGE, "salt"]


def components(edges: DataFrame, ws: Workspace, tag: str = "cc") -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); component is the smallest node that is reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014), which end after a number of rounds logarithmic
    in the size. Minima are aggregated before they are joined back, so a node with very many neighbours is no single
    task's work. Each round is a written table.
    """
    now = ws.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}0")
    k, before = 0, None
    while True:
        # Large star: the larger neighbours of u go to the smallest node next to u.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = ws.table(large, f"{tag}{k}-large")
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        ws.drop(f"{tag}{k}")
        k += 1
        now = ws.table(small.distinct(), f"{tag}{k}")
        ws.drop(f"{tag}{k - 1}-large")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _unordered(pairs: DataFrame, *more: Column) -> DataFrame:
    return pairs.select(F.least("rid", "other").alias("a"), F.greatest("rid", "other").alias("b"), *more)


def block_pairs(blocks: DataFrame, can: Callable) -> DataFrame:
    """The keys of two blocks of one list, the second as o_cell and so on: those that may hold a link between components."""
    theirs = blocks.select("list", *[F.col(c).alias(f"o_{c}") for c in blocks.columns if c != "list"])
    ours = blocks.withColumn("o_cell", F.explode(F.array("cell", F.col("cell") + 1)))
    apart = [c for c in _BLOCK_KEY if c not in ("list", "cell")]
    once = (F.col("cell") < F.col("o_cell")) | (F.struct(*apart) <= F.struct(*[F.col(f"o_{c}").alias(c) for c in apart]))
    one = (F.col("lo_component") == F.col("hi_component")) & (F.col("o_lo_component") == F.col("o_hi_component")) & (F.col("lo_component") == F.col("o_lo_component"))
    other = lambda c: F.col(f"o_{c}")
    met = ours.join(theirs, ["list", "o_cell"]).where(once & ~one & ~(F.col("late") & F.col("o_late")) & can(F.col, other))
    return met.select(*_BLOCK_KEY, *[f"o_{c}" for c in _BLOCK_KEY if c != "list"])


def open_pairs(members: DataFrame, ratio: float, may: Callable, can: Callable, ws: Workspace) -> DataFrame:
    """Pairs (rid, other, x, y) of members of one list and of different components for which ``may`` holds.

    ``members`` has list, rid, component, n and other attributes; x and y are structs of them. If there is a ``reach``, the
    largest size that a member may be paired with, members with a reach below their own size are late, and two of these
    never meet: each would have to be the smaller one. The members of a list are cut into blocks: by size n, in cells of
    which linked members share one or are in neighbours (n at least ``ratio`` of the larger); into late ones and others;
    into those ``near`` the hub, which are one component, and others; by ranges of the size, or of late members' reach,
    where a cell has more than ``BLOCK`` members; and by a salt where a range still has more. Blocks are
    paired first, by their bounds alone, and a pair of blocks that can't hold a link (``can``), or holds one component
    alone, is skipped whole. Pairs of blocks are dealt by both, so a long list is the work of many tasks.
    """
    step = log(1 / ratio) * (1 + 1e-9)
    has = lambda c: c in members.columns
    placed = members.withColumns({
        "cell": F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / step),
        "late": F.col("reach") < F.col("n") if has("reach") else F.lit(False),
        "near": F.col("near") if has("near") else F.lit(False),
        "at": F.least("n", "reach") if has("reach") else F.col("n"),
    })
    cells = placed.groupBy(*_CELL).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cuts"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    placed = placed.join(ws.table(cells, "cells"), _CELL).withColumn("cut", F.expr("(at - lo) * cuts div (hi - lo + 1)")).drop("at", "lo", "hi", "cuts")
    placed = ws.table(placed, "cut")
    bounds = [f(c).alias(f"{name}_{c}") for c in [x for x in ("n", "reach", "component") if has(x)] for f, name in ((F.min, "lo"), (F.max, "hi"))]
    ranges = ws.table(placed.groupBy(*_RANGE).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("salts"), *bounds), "ranges")
    placed = placed.join(ranges.select(*_RANGE, "salts"), _RANGE).withColumn("salt", F.pmod(F.xxhash64("rid"), "salts"))
    placed = ws.table(placed.select(*_BLOCK_KEY, F.struct(*members.columns).alias("x")), "placed")
    blocks = ranges.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    met = block_pairs(blocks, can)
    met = met.join(placed, _BLOCK_KEY).withColumnRenamed("x", "_x")
    here = [c for c in _BLOCK_KEY if c != "list"]
    right = placed.select("list", *[F.col(c).alias(f"o_{c}") for c in here], F.col("x").alias("_y"))
    met = met.join(right, ["list", *[f"o_{c}" for c in here]])
    same = reduce(and_, [F.col(c) == F.col(f"o_{c}") for c in here])
    x, y = (lambda c: F.col(f"_x.{c}")), (lambda c: F.col(f"_y.{c}"))
    keep = (~same | (x("rid") < y("rid"))) & (x("component") != y("component")) & may(x, y)
    return met.where(keep).select(x("rid").alias("rid"), y("rid").alias("other"), F.col("_x").alias("x"), F.col("_y").alias("y"))


def link_lists(entries: DataFrame, ratio: float, room: Callable, may: Callable, can: Callable, measure: Callable[[DataFrame, str], DataFrame], ws: Workspace, parts: int = 1) -> DataFrame:
    """(node, component) of the nodes linked by a distance of at most ``room`` among the pairs that share a list.

    ``entries`` has a row per list and member: list, rid, n, other attributes, and those of the list's hub (the member
    that stands first) as hub, hub_n and so on; the hub's own row may be left out, and list may be null where the hub has one
    member besides. ``room(x, y)`` is the distance that members of these sizes may have,
    ``may(x, y)`` a condition on pairs, ``can(x, y)`` one on blocks (see ``open_pairs``), and ``measure(pairs, tag)`` gives
    (a, b, low, high, link) of pairs (a, b): bounds of the distance, high is null if unknown, and whether it is within the room.

    First each member is compared with the hub of its list only, a number of pairs linear in the lists. What these
    links connect needs no more comparing: after that, a pair is looked at only if it stands in one list, without its hub,
    and its ends are in different components. So large groups of near copies are never paired among themselves, and still no link
    between components is missed. Answers are also derived from the hub's: a distance is a metric, so the distances
    of both ends from a common hub bound theirs, which decides many pairs without comparing them.

    With ``parts`` the lists are paired in so many parts, one after another, so that no more of their members are on disk at once.
    """
    extra = [c for c in entries.columns if c not in ("list", "rid", "hub") and not c.startswith("hub_")]
    hub = lambda c: F.col(f"hub_{c}")
    first = entries.where(F.col("rid") != F.col("hub")).where(may(F.col, hub)).withColumnRenamed("hub", "other")
    pairs1 = ws.table(_unordered(first).distinct(), "pairs1")
    told = ws.table(measure(pairs1, "first"), "told1")
    linked = told.where("link").select("a", "b")
    known = components(linked, ws, "cc1")
    # Of the hub's own pairs in its list each is measured or can't be a link, so only the others are paired among themselves:
    # lists of two, which chance makes ever more of as a corpus grows, are done with.
    rest = entries.where(F.col("rid") != F.col("hub")).where("list is not null").select("list", "rid", "hub", *extra)
    named = rest.join(known.select(F.col("node").alias("rid"), "component"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    named = ws.table(named, "named")
    mixed = named.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("list")
    open_ = ws.table(named.join(mixed, "list", "left_semi"), "open")
    ws.drop("named")
    # The hub's answers: how far each member is from it, as far as that was measured.
    far = told.select(F.col("a").alias("rid"), F.col("b").alias("hub"), "low", "high", "link").unionByName(told.select(F.col("b").alias("rid"), F.col("a").alias("hub"), "low", "high", "link"))
    near = F.coalesce("link", F.lit(False)).alias("near")
    members = open_.join(far, ["rid", "hub"], "left").select("list", "rid", *extra, "component", near, F.coalesce("low", F.lit(0).cast("long")).alias("low"), "high")

    def undecided(x, y):
        below = F.greatest(x("low") - y("high"), y("low") - x("high"), F.lit(0).cast("long"))
        return may(x, y) & (below <= room(x, y))

    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    sure = F.coalesce(x("high") + y("high") <= room(x, y), F.lit(False))
    found = None
    for k in range(parts):
        some = members.where(F.pmod("list", F.lit(parts)) == k) if parts > 1 else members
        some = _unordered(open_pairs(some, ratio, undecided, can, ws), sure.alias("sure"))
        some = some if found is None else some.unionByName(found)
        found = ws.table(some.groupBy("a", "b").agg(F.max("sure").alias("sure")), f"found{k}")
        ws.drop("cells", "cut", "ranges", "placed", f"found{k - 1}")
    ws.drop("open")
    pairs2 = ws.table(found.where("not sure").select("a", "b").join(pairs1, ["a", "b"], "left_anti"), "pairs2")
    told2 = ws.table(measure(pairs2, "second"), "told2")
    links = linked.unionByName(found.where("sure").select("a", "b")).unionByName(told2.where("link").select("a", "b"))
    return components(links, ws, "cc2")

