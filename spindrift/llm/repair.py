"""Token ids in files compressed by a grammar: Re-Pair in rounds, a grammar per shard.

Documents are put in ascending order of id by ranges, encoded, and cut into shards of whole documents, of SHARD_IDS ids or a little more. In a shard, pairs of neighbouring symbols that come up
often are replaced by new symbols, again and again: a round counts all pairs at once in a table of 2^BITS places (of pairs that share a place one waits for another round with another hash), takes each pair that is at
least LEAST times there where neither of its neighbours is more frequent (of a run of one symbol every other), and makes a rule of it. It ends when a round shortens the shard by less than LEAST_GAIN. Pairs never hold the end id, so a symbol lies in one document.

A shard is a row of a Parquet table: part and shard (its place in the order), n_ids, low_id and high_id (for skipping by statistics), and for its documents in order doc_ids, sizes (ids with the end id) and symbol_ends (where
their symbols end); `rules` are the rules' pairs of symbols, `lengths` how many ids each rule stands for, and `symbols` what is left of the shard, all little-endian unsigned 32-bit numbers; symbols from first_rule on are rules, a
rule refers to earlier ones only. A document is read by expanding its own symbols; the lengths tell beforehand where each id of it lies, so a range of ids needs only the symbols that cover it.

Defined cases: null text counts as empty and has the end id alone; very long texts are one document of one shard, which is then as long; rows without id come first, rows of one id follow one another in the order in which they are read,
which may be another in another run; an empty table gives an empty table of shards; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import fresh_path
from .common import small_batches, whole_text
from .packing import _encoder, default_tokenizer

END_ID = 0
#: Ids in a shard, beyond which it is closed.
SHARD_IDS = 1 << 20
#: Chunks of text that a Python worker remembers with their ids, some 130 MB; so many, as new words cost most of the time.
KEPT = 400_000
#: Places of the table of pairs, and how often a pair comes up for a rule.
BITS, LEAST = 20, 8
#: The share of a shard that a round has to save for another to follow.
LEAST_GAIN = 0.02
_SHARD = "part int, shard int, n_ids long, low_id long, high_id long, doc_ids array<long>, sizes array<long>, symbol_ends array<long>, first_rule long, rules binary, lengths binary, symbols binary"


def pair_rounds(ids: np.ndarray, first_rule: int, end_id: int = END_ID, least: int = LEAST, bits: int = BITS, least_gain: float = LEAST_GAIN) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rule k, the symbol first_rule + k, is the pair rules[k]."""
    x, rules, made = ids.astype(np.uint32), [], first_rule
    factor, shift = 0x9E3779B1, np.uint32(32 - bits)
    while len(x) > 1:
        factor = factor * 0x2C1B3C6D + 0x297A2D39 & 0xFFFFFFFF | 1
        a, b = x[:-1], x[1:]
        place = (((a * np.uint32(factor)) ^ (b * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35) >> shift).astype(np.int64)
        # how often the pair at each position comes up, none before the first and after the last
        count = np.zeros(len(x) + 1, dtype=np.int32)
        mine, before, after = count[1:-1], count[:-2], count[2:]
        mine[:] = np.bincount(place, minlength=1 << bits).astype(np.int32)[place]
        mine[(mine < least) | (a == end_id) | (b == end_id)] = 0
        chosen = (mine > before) & (mine >= after)
        twins = a == b
        again = np.concatenate([[False], twins[1:] & twins[:-1]])
        if again.any():  # runs of one symbol: every other pair of it
            in_run = np.arange(len(a))
            in_run -= np.maximum.accumulate(np.where(again, 0, in_run))
            chosen |= again & (in_run % 2 == 0) & (mine > 0) & (mine >= after)
        at = np.flatnonzero(chosen)
        where = place[at]
        # of the pairs that share a place the last one stands for it
        stands = np.zeros(1 << bits, dtype=np.int64)
        stands[where] = at
        same = (a[stands[where]] == a[at]) & (b[stands[where]] == b[at])
        at, where = at[same], where[same]
        enough = np.bincount(where, minlength=1 << bits) >= least
        kept = enough[where]
        at, where = at[kept], where[kept]
        if len(at) < least_gain * len(x):
            break
        named = np.flatnonzero(enough)
        rules.append(np.stack([a[stands[named]], b[stands[named]]], axis=1))
        number = np.zeros(1 << bits, dtype=np.uint32)
        number[named] = np.arange(made, made + len(named), dtype=np.uint32)
        made += len(named)
        stays = np.ones(len(x), dtype=bool)
        stays[at + 1] = False
        x[at] = number[where]
        x = x[stays]
    return np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32), x


def _runs(rules: np.ndarray, first_rule: int) -> Iterator[tuple[int, int]]:
    """Runs of rules that refer only to ids and rules before the run: one for each round."""
    known = 0
    while known < len(rules):
        ahead = rules[known:].max(axis=1) >= first_rule + known
        end = known + int(np.argmax(ahead)) if ahead.any() else len(rules)
        yield known, end
        known = end


def rule_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """How many ids each rule stands for."""
    lengths = np.concatenate([np.ones(first_rule, dtype=np.uint32), np.zeros(len(rules), dtype=np.uint32)])
    for known, end in _runs(rules, first_rule):
        lengths[first_rule + known : first_rule + end] = lengths[rules[known:end]].sum(axis=1)
    return lengths[first_rule:]


class Grammar:
    """Expands symbols; the ids of all symbols are laid out once: of the plain ids themselves, of the rules as long as the sum of their lengths."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, first_rule: int):
        self.lengths = np.concatenate([np.ones(first_rule, dtype=np.int64), lengths.astype(np.int64)])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ids = np.concatenate([np.arange(first_rule, dtype=np.uint32), np.zeros(int(lengths.sum()), dtype=np.uint32)])
        for known, end in _runs(rules, first_rule):
            begin = int(self.starts[first_rule + known])
            laid = self.expand(rules[known:end].ravel())
            self.ids[begin : begin + len(laid)] = laid

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        lengths = self.lengths[symbols]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[symbols] - (ends - lengths), lengths)
        at += np.arange(len(at))
        return self.ids[at]

    def between(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1 of what the symbols stand for; only symbols that cover them are expanded."""
        ends = np.cumsum(self.lengths[symbols])
        low, high = np.searchsorted(ends, [start, stop - 1], side="right")
        if stop <= start or low == len(symbols):
            return np.zeros(0, dtype=np.uint32)
        before = int(ends[low - 1]) if low else 0
        return self.expand(symbols[low : high + 1])[start - before : stop - before]


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4")


def _writer(path: str, end_id: int, shard_ids: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        encoder, part = _encoder(path, kept=KEPT), TaskContext.get().partitionId()
        first_rule = encoder.tokenizer.get_vocab_size()
        ids: list = []
        raw: list[bytes] = []
        sizes: list[int] = []
        number = 0

        def closed():
            whole = np.frombuffer(b"".join(raw), dtype="<u4")
            rules, symbols = pair_rounds(whole, first_rule, end_id)
            lengths = rule_lengths(rules, first_rule)
            # a document's last symbol is the one in which the ids up to its end are
            stands = np.concatenate([np.ones(first_rule, dtype=np.int64), lengths])[symbols]
            symbol_ends = np.searchsorted(np.cumsum(stands), np.cumsum(sizes)) + 1
            named = [i for i in ids if i is not None]
            row = (part, number, len(whole), named[0] if named else None, named[-1] if named else None, ids, sizes, symbol_ends, first_rule, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u4").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        number_list = pa.list_(pa.int64())
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 3, *[number_list] * 3, pa.int64(), *[pa.binary()] * 3]
        schema = pa.schema([(c.split()[0], k) for c, k in zip(_SHARD.split(", "), kinds)])
        held = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = encoder.encode(text) + end
                ids.append(doc_id)
                raw.append(got)
                sizes.append(len(got) // 4)
                held += sizes[-1]
                if held >= shard_ids:
                    yield closed()
                    ids, raw, sizes, held, number = [], [], [], 0, number + 1
        if ids:
            yield closed()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The ids of all documents as shards in a folder of any file system that Spark writes to; a task that runs again replaces its own rows."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    # rows of one id may go to several ranges; texts are not read for the splitters
    ranged = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    ranged.select("doc_id", "text").mapInArrow(_writer(tokenizer or default_tokenizer(), end_id, shard_ids), _SHARD).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SHARD).parquet(path)


def _reader(make, fields: list[tuple]):
    """Applies make(ids of the document) to each document of each shard."""

    def run(batches):
        for b in batches:
            cols = {n: b.column(k) for k, n in enumerate(b.schema.names)}
            for k in range(b.num_rows):
                one = {n: c[k].as_py() for n, c in cols.items()}
                grammar = Grammar(_numbers(one["rules"]).reshape(-1, 2), _numbers(one["lengths"]), one["first_rule"])
                ids = grammar.expand(_numbers(one["symbols"]))
                ends = np.cumsum(one["sizes"])
                made = [make(ids[e - n : e]) for e, n in zip(ends, one["sizes"])]
                n = len(made)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one["doc_ids"], pa.int64()), pa.array([one["part"]] * n, pa.int32()), pa.array([one["shard"]] * n, pa.int32()), pa.array(ends - one["sizes"], pa.int64()), pa.array(one["sizes"], pa.int64()), pa.array(made, fields[1])],
                    names=["doc_id", "part", "shard", "inside", "n_tokens", fields[0]],
                )

    return run


def _starts(shards: DataFrame) -> DataFrame:
    """(part, shard, before): the ids of all shards before one; a running sum of the parts, then one inside each."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(upto(Window.orderBy("part"))), F.lit(0)).alias("earlier"))  # a row per task of the writer
    own = F.coalesce(F.sum("n_ids").over(upto(Window.partitionBy("part").orderBy("shard"))), F.lit(0))
    return shards.select("part", "shard", own.alias("own")).join(parts, "part").select("part", "shard", (F.col("earlier") + F.col("own")).alias("before"))


def _documents(spark: SparkSession, path: str, make, name: str, kind: pa.DataType, sql_kind: str) -> DataFrame:
    shards = read_shards(spark, path)
    read = shards.select("part", "shard", "doc_ids", "sizes", "first_rule", "rules", "lengths", "symbols")
    docs = read.mapInArrow(_reader(make, (name, kind)), f"doc_id long, part int, shard int, inside long, n_tokens long, {name} {sql_kind}")
    placed = docs.join(_starts(shards.select("part", "shard", "n_ids")), ["part", "shard"])
    return placed.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", name)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    return _documents(spark, path, lambda x: x, "ids", pa.list_(pa.int64()), "array<bigint>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: unsigned CRC-32 of the ids as little-endian 32-bit numbers."""
    return _documents(spark, path, lambda x: zlib.crc32(np.ascontiguousarray(x, dtype="<u4")), "ids_crc32", pa.int64(), "bigint")


def read_documents(spark: SparkSession, path: str, wanted: list[int], start: int = 0, stop: int | None = None) -> DataFrame:
    """(doc_id, ids) of a few documents, or ids start to stop - 1 of each: shards without them are skipped by statistics, and only symbols that cover what is asked for are expanded."""
    names = sorted(set(wanted))
    shards = read_shards(spark, path).filter(F.arrays_overlap("doc_ids", F.lit(names).cast("array<bigint>")))
    if names:
        shards = shards.filter((F.col("low_id") <= names[-1]) & (F.col("high_id") >= names[0]))

    def run(batches):
        asked = set(names)
        for b in batches:
            for one in b.to_pylist():
                grammar, symbols = Grammar(_numbers(one["rules"]).reshape(-1, 2), _numbers(one["lengths"]), one["first_rule"]), _numbers(one["symbols"])
                begin, out = 0, ([], [])
                for doc_id, n, end in zip(one["doc_ids"], one["sizes"], one["symbol_ends"]):
                    if doc_id in asked:
                        out[0].append(doc_id)
                        out[1].append(grammar.between(symbols[begin:end], start, n if stop is None else min(stop, n)))
                    begin = end
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return shards.mapInArrow(run, "doc_id long, ids array<bigint>")


def grammar_ids(docs: DataFrame, **options) -> DataFrame:
    """Write all documents to a new folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    path = fresh_path(docs.sparkSession, "ids")
    write_ids(docs, path, **options)
    return read_digests(docs.sparkSession, path)
