"""Packing documents into sequences of at most 1024 tokens by pattern.

Longer documents are cut into full pieces (the first may be shorter). The histogram of piece lengths has at most 1024 bars, so the plan
is made on the driver at any input size: all patterns of two or three lengths that fill a sequence exactly are
enumerated, and non-negative least squares fits their repeat counts to the histogram, all bars weighing alike. Counts of a half or more are rounded to the nearest number and taken in falling order of
the fit as far as the bars go, and what is left is fitted again, from half the greatest count on where all are smaller, until no pattern is left. Best-fit decreasing packs the residual bars, for which pieces under SHORTEST of a
sequence, that close gaps, are kept out of the patterns. The last patterns may use up what the residual needs, on few documents most of all, so plans with fewer of them, down to a tenth (KEPT), are made too, and the plan of fewest
sequences, of these the one of most patterns, is taken. Pieces then find their place by their rank among pieces of their length: ranks come from salted two-level prefix sums, so a length that holds a third of all pieces is dealt
over many tasks.

With `in_order` sequences follow the order of the rows (of files: by name, then row): the rows are cut into up to WINDOWS windows with a plan each, patterns are dealt evenly to SLICES parts of a window, pieces take
them in order, and a sequence's number grows with its first piece.

Defined cases: null text counts as empty and gives one piece of one token (the end id); very long texts give many pieces; rows without id and repeated rows are packed
like any other; pieces of one length are alike, so ties are taken in order of rows; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import json
import math
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, prefix_offsets, small_batches, stored, whole_text

SEQUENCE = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: The shortest length in a pattern, as a share of a sequence, and the shares of the fitted patterns that plans are made with.
SHORTEST = 1 / 8
KEPT = (1.0, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)
#: In order: windows at most, rows that one needs, and parts of each.
WINDOWS, WINDOW_ROWS, SLICES = 16, 50_000, 8
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = _PIECES + ", sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def cut(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first."""
    head = n % size or min(n, size)
    return [(0, head)] + [(k, size) for k in range(head, n, size)]


class _Known(dict):
    """Ids of chunks, made where they are asked for: `kept` at most, and as many of those before them, so that a chunk that comes again outlives a full table."""

    def __init__(self, make: Callable[[str], bytes], kept: int, longest: int):
        self.make, self.kept, self.longest, self.older = make, kept, longest, {}

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            out = self.make(chunk)
            if len(chunk) > self.longest:
                return out
        if len(self) >= self.kept:
            self.older = dict(self)
            self.clear()
        self[chunk] = out
        return out


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    A byte-level tokenizer splits at fixed places before it merges, so the ids of a text are those of its chunks, and chunks that come again
    are looked up. Chunks end where the tokenizer surely splits: before white space, and between letters of the Latin blocks
    and ASCII signs. Other tokenizers, and texts with an added token, are encoded whole.
    """

    LONGEST = 64
    _SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    _SIGN = "!-/:-@\\[-`{-~"
    _LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
    CHUNK = re.compile(f" ?[{_LETTER}]+(?![^{_SPACE}{_SIGN}])|[{_SIGN}]+(?=[{_SPACE}])| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
    WORD = re.compile(f" ?[{_LETTER}]+")

    def __init__(self, path: str, kept: int = 125_000):
        from tokenizers import Tokenizer


        self.tokenizer = Tokenizer.from_file(path)
        # asked one by one: the whole description with its vocabulary would take much of a worker's memory
        split = self.tokenizer.pre_tokenizer
        split = {} if split is None else json.loads(split.__getstate__())
        self.by_chunk = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and self.tokenizer.normalizer is None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.known = self.tokenizer.model, _Known(self._made, kept, self.LONGEST)
        # byte-level alphabets write printable bytes as themselves and the others, in order, from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}
        self.blank = chr(self.alphabet[32])

    def _made(self, chunk: str) -> bytes:
        if self.WORD.fullmatch(chunk):
            if chunk.isascii():  # only the blank is not written as itself
                shown = self.blank + chunk[1:] if chunk[0] == " " else chunk
            else:
                shown = chunk.encode().decode("latin-1").translate(self.alphabet)
            ids = [t.id for t in self.model.tokenize(shown)]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes() if len(ids) > 64 else struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if not self.by_chunk or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.known.__getitem__, self.CHUNK.findall(text)))


@functools.cache
def _encoder(path: str, **options) -> Encoder:
    """One for a Python worker, whose tasks share what it remembers."""
    return Encoder(path, **options)


def _piecer(path: str, size: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = _encoder(path)
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for k, (doc_id, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                raw = memoryview(encoder.encode(text) + end)
                for p, (start, length) in enumerate(cut(len(raw) // 4, size)):
                    for col, v in zip(out, (doc_id, p, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), k)):
                        col.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            *made, source = [pa.array(c, t) for c, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays([*made, b.column(2).take(source), b.column(3).take(source)], names=["doc_id", "piece", "start", "length", "ids_crc32", "file", "row"])

    return run


def _row_of_file(docs: DataFrame) -> tuple[Column, Column]:
    """File and row of each row of a table that is read from Parquet files; of others, "" and the number of the row."""
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place["file_path"], place["row_index"]).schema
    except AnalysisException:
        return F.lit(""), F.monotonically_increasing_id()
    return place["file_path"], place["row_index"]


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", in_order: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the place of the row: file, row."""
    small_batches(docs.sparkSession)
    file, row = _row_of_file(docs) if in_order else (F.lit(""), F.monotonically_increasing_id())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), file.alias("file"), row.cast("long").alias("row"))
    return rows.mapInArrow(_piecer(tokenizer or default_tokenizer(), size, end_id), _PIECES + ", file string, row long")


def full_patterns(size: int) -> np.ndarray:
    """All multisets of two or three lengths that sum to size; the third is 0 in a pair."""
    a, b = np.meshgrid(np.arange(0, size // 3 + 1), np.arange(1, size // 2 + 1), indexing="ij")
    c = size - a - b
    ok = (a <= b) & (b <= c) & (c < size)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def fit_counts(patterns: np.ndarray, bars: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients; all bars weigh alike but bars[0] (no document), which weighs nothing."""
    weight = (np.arange(len(bars)) > 0).astype(float)

    def times(x):
        return sum(np.bincount(patterns[:, k], x, len(bars)) for k in range(3)) * weight

    def back(r):
        return (r * weight)[patterns].sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(20):  # power iteration for the step size
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    step, target = 1 / (norm * 1.02), bars * weight
    x = z = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        grad = back(times(z) - target)
        new = np.maximum(0, z - step * grad)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def best_fit_residual(bars: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over bars; equal sequences are kept as one (lengths, count)."""
    by_room: dict[int, list] = defaultdict(list)
    done: list[tuple[tuple[int, ...], int]] = []

    def put(lengths, room, count):
        if count:
            (by_room[room] if room else done).append((lengths, count))

    for length in range(len(bars) - 1, 0, -1):
        n = int(bars[length])
        while n:
            room = next((r for r in range(length, size) if by_room.get(r)), None)
            if room is None:
                lengths, room, count = (), size, -(-n // (size // length))
            else:
                lengths, count = by_room[room].pop()
            each = room // length
            k = min(count, n // each)
            put(lengths + (length,) * each, room - each * length, k)
            n, count = n - k * each, count - k
            if count and n:
                put(lengths + (length,) * n, room - n * length, 1)
                n, count = 0, count - 1
            if lengths:
                put(lengths, room, count)
    return done + [g for groups in by_room.values() for g in groups]


def fitted(bars: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeat count) of patterns fitted to the bars, and never more than these, in the order in which they were taken."""
    left, patterns = bars[:size].astype(np.int64).copy(), full_patterns(size)
    patterns = patterns[((patterns >= SHORTEST * size) | (patterns == 0)).all(axis=1)]
    out: dict[tuple[int, ...], int] = defaultdict(int)
    while True:
        patterns = patterns[((left[patterns] > 0) | (patterns == 0)).all(axis=1)]
        wanted = fit_counts(patterns, left) if len(patterns) else np.zeros(1)
        least, taken = min(0.5, wanted.max() / 2), 0
        if wanted.max() < 1e-3:
            return list(out.items())
        for k in np.argsort(-wanted, kind="stable"):
            if wanted[k] < least:
                break
            lengths = tuple(int(v) for v in patterns[k] if v)
            n = min(max(1, round(wanted[k])), *(int(left[v]) // lengths.count(v) for v in lengths))
            if n > 0:
                out[lengths] += n
                taken += n
                for v in lengths:
                    left[v] -= n
        if not taken:
            return list(out.items())


def plan(bars: np.ndarray, size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeat count) whose pieces are just those of the histogram; bars[l] pieces have length l."""
    left = bars.astype(np.int64).copy()
    full, left[size] = int(left[size]), 0
    patterns = fitted(left, size)
    total = sum(n for _, n in patterns)
    best, fewest = [], None
    for share in KEPT:
        rest, made, room = left.copy(), [], math.ceil(share * total)
        for lengths, n in patterns:
            n = min(n, room)
            if n:
                made.append((lengths, n))
                room -= n
                for v in lengths:
                    rest[v] -= n
        made = made + best_fit_residual(rest, size)
        number = sum(n for _, n in made)
        if fewest is None or number < fewest:
            best, fewest = made, number
    return ([((size,), full)] if full else []) + best


def places(packed: list[tuple[tuple[int, ...], int]], slices: int = 1, base: int = 0) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence id, offset) in order of rank; each count is dealt evenly to the slices, one after another, and so their number is bounded."""
    rows, used = defaultdict(list), defaultdict(int)
    shift = [k * 0.6180339887 % 1 for k in range(len(packed))]
    for s in range(slices):
        for (lengths, count), by in zip(packed, shift):
            n = int(count * (s + 1) / slices + by) - int(count * s / slices + by) if slices > 1 else count
            if not n:
                continue
            offset = 0
            for length in lengths:
                rows[length].append((used[length], base, offset))
                used[length] += n
                offset += length
            base += n
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def _placer(tables: list[dict[int, np.ndarray]]):
    def run(batches):
        for b in batches:
            lengths, ranks, windows, at = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5, 6, 7))
            seq, off = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for window, length in {*zip(windows.tolist(), lengths.tolist())}:
                here, rows = np.nonzero((lengths == length) & (windows == window))[0], tables[window][length]
                k = np.searchsorted(rows[:, 0], ranks[here], side="right") - 1
                seq[here], off[here] = rows[k, 1] + ranks[here] - rows[k, 0], rows[k, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off), pa.array(at)], names=[*b.schema.names[:5], "sequence_id", "offset", "at"])

    return run


def _positions(rows: DataFrame) -> DataFrame:
    """Adds `at`, the position of a row's document among all by file name (a shorter one first, as numbers of files grow longer) and row; a file's rows start behind those of the files before it."""
    files = rows.groupBy("file").agg((F.max("row") + 1).alias("rows"))
    before = F.sum("rows").over(Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    return rows.join(files.select("file", F.coalesce(before, F.lit(0)).alias("behind")), "file").select(*rows.columns, (F.col("behind") + F.col("row")).alias("at"))


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", in_order: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = stored(pieces(docs, tokenizer, size, end_id, id_col, text_col, in_order))
    if in_order:
        rows = _positions(rows)
        got = rows.agg(F.sum((F.col("piece") == 0).cast("long")).alias("n"), F.max("at").alias("last")).first()
        number, span = max(1, min(WINDOWS, (got["n"] or 0) // WINDOW_ROWS)), (got["last"] or 0) + 1
        rows = rows.withColumn("w", F.expr(f"cast(at * {number} div {span} as int)"))
    else:
        number, rows = 1, rows.withColumns({"w": F.lit(0), "at": F.col("row")})
    bars = np.zeros((number, size + 1), dtype=np.int64)
    for window, length, n in rows.groupBy("w", "length").count().collect():  # at most `size` rows a window
        bars[window, length] = n
    tables, base = [], 0
    for k in range(number):
        packed = plan(bars[k], size)
        tables.append(places(packed, SLICES if in_order else 1, base))
        base += sum(n for _, n in packed)
    salts = buckets_for(int(bars.sum()))
    salt = F.expr(f"at * {salts} div {span}") if in_order else F.pmod(F.xxhash64("row", "piece"), F.lit(salts))
    salted = rows.withColumn("b", salt)
    before = prefix_offsets(salted.groupBy("w", "length", "b").agg(F.count("*").alias("n")), ["w", "length"], "b", "n", "before")
    own = Window.partitionBy("w", "length", "b").orderBy("at", "piece")
    ranked = salted.withColumn("r", F.row_number().over(own)).join(before, ["w", "length", "b"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("r") - 1).cast("long").alias("rank"), "w", "at")
    placed = ranked.mapInArrow(_placer(tables), _PLACED + ", at long")
    if in_order:
        # numbered by the first piece; a sequence has at most `size`
        first = F.min(F.col("at") * (1 << 20) + F.col("piece")).over(Window.partitionBy("sequence_id"))
        placed = placed.withColumn("sequence_id", first)
    return placed.drop("at")
