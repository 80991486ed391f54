"""Interleaving sources at target weights by a proportionate-fair schedule.

The text of a source, in a fixed pseudo-random order of its documents, is cut into blocks of BLOCK_CHARS code points. Block j (from 0) of a source of
weight w, a share of the sum, is released at slot floor(j / w) and due by slot ceil((j + 1) / w); in each slot a released block of earliest deadline runs, so in every
prefix every source is within one block of its target share. Weights are whole numbers, exact where the given ones have a common denominator up to GRID and else rounded to 1 / GRID.

The schedule is cut into windows of WINDOW slots. Which blocks are done before a window is settled first: all that are due by then, those done before the window before it, and, of those released
but not yet due, as many as slots are left. Of these, so many are taken as each slot before needs, always of earliest deadline; thus both sides of the cut can be filled,
as the fractions of blocks that an even flow would have done there show, and earliest deadline first finds a schedule within each window alone.
So the driver takes one step a window over the sources and sends at most WINDOW entries for it, and windows are scheduled side by side. On large tables block_chars
should grow with them.

When a source has no block left, the others go on at their weights among themselves as a new schedule, and sources of weight 0 come after all others, by
their size; every document is kept and every slot has a block. A document takes the slot of the block that it starts in. `in_mix` marks the slots before
the first source ran out, where the target weights hold; release and deadline are those of the schedule that the block ran in.

Defined cases: a null source is a source of its own; null or empty text counts as one code point; a very long text spans several blocks, of which those after the first have no document; rows without id and
rows that are repeated are placed in order of a hash of their text, equal ones in any order; ties of deadlines go to the first source in alphabetical order; an empty table gives an empty
result; other columns are not looked at. If no source of the table has a positive weight, an error is raised.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, prefix_offsets, row_name, steady, stored, whole_text

BLOCK_CHARS = 4096
#: Slots of a window; their number times GRID fits a 64-bit number.
WINDOW = 256
GRID = 1 << 52
#: Default target: a source's share of all text to this power, then normalised.
TEMPERATURE = 0.5
_PLAN = "at long, slots int, start long, total long, parts array<struct<i:int,w:long,first:long,n:int,before:long>>"


def whole_weights(weights: list[float]) -> list[int]:
    """Whole numbers in proportion to the weights: exact if their sum is up to GRID, else of sum near GRID, each positive one at least 1."""
    exact = [Fraction(str(w)) for w in weights]
    scale = math.lcm(*(x.denominator for x in exact)) if exact else 1
    whole = [int(x * scale) for x in exact]
    shared = math.gcd(*whole) or 1
    whole = [x // shared for x in whole]
    total = sum(whole)
    return whole if total <= GRID else [max(1, x * GRID // total) if x else 0 for x in whole]


class _State:
    """Blocks that are surely done before a slot, and the part of the next one, of each source: both exact."""

    def __init__(self, w: list[int]):
        self.w, self.total = np.array(w, dtype=np.int64), sum(w)
        self.whole, self.part, self.at = np.zeros(len(w), dtype=np.int64), np.zeros(len(w), dtype=np.int64), 0
        self._steps: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def forward(self, slots: int) -> None:
        if slots not in self._steps:
            parts = [divmod(int(w) * slots, self.total) for w in self.w]
            self._steps[slots] = tuple(np.array(c, dtype=np.int64) for c in zip(*parts))
        whole, part = self._steps[slots]
        self.whole, self.part, self.at = self.whole + whole, self.part + part, self.at + slots
        over = self.part >= self.total
        self.whole, self.part = self.whole + over, self.part - over * self.total

    def done(self, before: np.ndarray, since: int, left: np.ndarray) -> np.ndarray:
        """Blocks of each source done before this slot; `before`: those done before slot `since`, the last one settled; `left`: the blocks that a source has."""
        out = np.maximum(self.whole, before)
        begun = np.nonzero(self.part > 0)[0]
        release = self.at + (-self.part[begun] // self.w[begun])
        due = -(-(self.total - self.part[begun]) // self.w[begun])
        # how many blocks that are released before each slot may wait beyond this one
        after = np.arange(since + 1, self.at)
        ahead = -(-(self.part - self.w * (self.at - after)[:, None]) // self.total)
        waiting = (self.whole + ahead).sum(axis=1) - after
        order = np.argsort(release, kind="stable")
        ready: list[tuple] = []
        taken = at = 0

        def take() -> None:
            nonlocal taken
            out[heapq.heappop(ready)[-1]] += 1
            taken += 1

        for slot, most in zip([*after.tolist(), self.at + 1], [*waiting.tolist(), len(begun)]):
            while at < len(order) and release[order[at]] < slot:
                k, i = order[at], begun[order[at]]
                at += 1
                if out[i] > self.whole[i]:
                    taken += 1
                else:
                    heapq.heappush(ready, (int(due[k]), bool(self.whole[i] + 1 < left[i]), int(i)))
            while at - taken > most:
                take()
        while taken < self.at - int(self.whole.sum()):
            take()
        return out


def windows(weights: list[int], blocks: list[int], size: int = WINDOW) -> Iterator[tuple]:
    """Rows of the plan: (first slot, slots, first slot of the schedule, sum of its weights, entries (source, weight, first block, blocks, blocks before the schedule))."""
    left, before, start = list(blocks), [0] * len(blocks), 0
    while any(left):
        own = [i for i, n in enumerate(left) if n and weights[i]]
        w = [weights[i] for i in own]
        if not own:
            own = [i for i, n in enumerate(left) if n]
            w = [left[i] for i in own]
        total = sum(w)
        end = min(left[i] * total // x for i, x in zip(own, w))
        state, have = _State(w), np.array([left[i] for i in own], dtype=np.int64)
        done = np.zeros(len(own), dtype=np.int64)
        while state.at < end:
            at = state.at
            state.forward(min(size, end - at))
            now = state.done(done, at, have)
            parts = [(own[k], w[k], int(done[k]), int(now[k] - done[k]), before[own[k]]) for k in np.nonzero(now > done)[0]]
            yield start + at, state.at - at, start, total, parts
            done = now
        for k, i in enumerate(own):
            left[i] -= int(done[k])
            before[i] += int(done[k])
        start += end


def _whole(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def scheduled(plan: DataFrame) -> DataFrame:
    """(i, block, slot, release, deadline) of the windows: earliest deadline first among the released blocks of each."""

    def block(p: Column, c: Column) -> Column:
        j = p["first"] + c
        release = F.call_function("div", _whole(j) * _whole(F.col("total")), _whole(p["w"]))
        past = F.call_function("div", _whole(j + 1) * _whole(F.col("total")) + _whole(p["w"]) - 1, _whole(p["w"]))
        return F.struct((F.col("start") + past).alias("deadline"), p["i"].alias("i"), (p["before"] + j).alias("block"), (F.col("start") + release).alias("release"))

    blocks = F.flatten(F.transform("parts", lambda p: F.transform(F.sequence(F.lit(0), p["n"] - 1), lambda c: block(p, c))))
    rows = plan.withColumn("left", F.sort_array(blocks))
    none = F.expr("cast(array() as array<struct<slot:bigint,deadline:bigint,i:int,block:bigint,release:bigint>>)")

    def step(acc: Column, t: Column) -> Column:
        x = F.get(F.filter(acc["left"], lambda b: b["release"] <= t), F.lit(0))
        run = F.struct(t.alias("slot"), x["deadline"].alias("deadline"), x["i"].alias("i"), x["block"].alias("block"), x["release"].alias("release"))
        return F.struct(F.array_remove(acc["left"], x).alias("left"), F.concat(acc["out"], F.array(run)).alias("out"))

    slots = F.sequence(F.col("at"), F.col("at") + F.col("slots") - 1)
    out = F.aggregate(slots, F.struct(F.col("left").alias("left"), none.alias("out")), step, lambda acc: acc["out"])
    return rows.select(F.inline(out)).select("i", "block", "slot", "release", "deadline")


def _source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_names: bool = False) -> DataFrame:
    """A row per document: doc_id, source, block, release, deadline, slot, start_char, in_mix; with row_names, which steady docs have, the name of its row as `row` too."""
    spark = docs.sparkSession
    text = whole_text(text_col)
    size = F.greatest(F.length(text), F.lit(1)).cast("long")
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), _source_key(source_col).alias("s"), size.alias("chars")]
    light = stored(docs.select(*cols, F.xxhash64(text).alias("th"), (row_name(docs) if row_names else F.monotonically_increasing_id()).alias("row")))
    totals = sorted(light.groupBy("s").agg(F.sum("chars").alias("chars"), F.count("*").alias("n")).collect())  # a row per source
    names = [r["s"] for r in totals]
    if weights is None:
        target = [float(r["chars"]) ** TEMPERATURE for r in totals]
    else:
        given = {"null" if s is None else f"={s}": w for s, w in weights.items()}
        target = [given.get(s, 0.0) for s in names]
        if totals and not sum(target) > 0:
            raise ValueError("no source of the table has a target weight")
    table = list(windows(whole_weights(target), [-(-r["chars"] // block_chars) for r in totals]))
    # the target weights hold until the second schedule starts
    limit = next((start for _, _, start, _, _ in table if start), sum(n for _, n, *_ in table))
    plan = scheduled(spark.createDataFrame(table, _PLAN))
    b = F.pmod(F.xxhash64("doc_id", "th"), F.lit(buckets_for(sum(r["n"] for r in totals), 5_000))).alias("b")
    rows = light.withColumn("b", b)
    before = prefix_offsets(rows.groupBy("s", "b").agg(F.sum("chars").alias("chars")), ["s"], "b", "chars", "before")
    own = Window.partitionBy("s", "b").orderBy("doc_id", "th", "row").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("own", F.coalesce(F.sum("chars").over(own), F.lit(0))).join(before, ["s", "b"])
    run = run.withColumn("start_char", F.col("before") + F.col("own")).withColumn("block", F.expr(f"start_char div {block_chars}"))
    run = run.join(spark.createDataFrame(list(enumerate(names)), "i int, s string"), "s")
    placed = run.join(plan, ["i", "block"])
    return placed.select("doc_id", "source", "block", "release", "deadline", "slot", "start_char", (F.col("slot") < F.lit(limit)).alias("in_mix"), *(["row"] if row_names else []))


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """All rows of docs in the order of the schedule, their columns unchanged. Rows meet their places by their name, so only the places are worked out on light rows."""
    docs = steady(docs)
    placed = mix(docs, row_names=True, **options).select(F.col("row").alias("_place_row"), "slot", "start_char", "doc_id")
    places = placed.select("_place_row", F.struct("slot", "start_char", "doc_id", "_place_row").alias("_place"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_name(docs).alias("_place_row"))
    return rows.join(places, "_place_row").orderBy("_place").select(*[F.col("_row")[c].alias(c) for c in docs.columns])
