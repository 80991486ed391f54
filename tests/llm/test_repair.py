import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import repair
from spindrift.llm.packing import default_tokenizer
from spindrift.sources.tables import fresh_path


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return [[*e.ids, 0] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_every_document_comes_back(spark, docs, texts):
    ids = sorted(texts)
    want, start = [], 0
    for i, got in zip(ids, whole([texts[i] for i in ids])):
        want.append((i, start, len(got), zlib.crc32(np.array(got, dtype="<u4").tobytes())))
        start += len(got)
    assert sorted(map(tuple, repair.grammar_ids(docs).collect())) == want
    path = fresh_path(spark, "ids")
    repair.write_ids(docs.repartition(5), path, shard_ids=5000)
    assert sorted(map(tuple, repair.read_digests(spark, path).collect())) == want
    shards = repair.read_shards(spark, path).collect()
    assert len(shards) > 10 and sum(len(r["symbols"]) + len(r["rules"]) + len(r["lengths"]) for r in shards) < 4 * start


def test_parts_of_documents(spark, docs, texts):
    path = fresh_path(spark, "ids")
    repair.write_ids(docs, path, shard_ids=20_000)
    some = sorted(texts)[::9]
    want = dict(zip(some, whole([texts[i] for i in some])))
    assert {r["doc_id"]: r["ids"] for r in repair.read_documents(spark, path, some).collect()} == want
    for start, stop in ((0, 1), (3, 40), (17, 17), (50, 10**9)):
        assert {r["doc_id"]: r["ids"] for r in repair.read_documents(spark, path, some, start, stop).collect()} == {i: x[start:stop] for i, x in want.items()}
    assert repair.read_documents(spark, path, []).collect() == []


def test_odd_tables(spark, odd, none):
    got = sorted(map(tuple, repair.grammar_ids(odd).collect()), key=lambda r: r[1])
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    kinds = lambda rs: sorted((-1 if i is None else i, n, c) for i, n, c in rs)
    assert kinds((i, n, c) for i, _, n, c in got) == kinds((i, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for (i, _), x in zip(rows, whole([t for _, t in rows])))
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got[:-1]]]).tolist()
    named = [r[0] for r in got if r[0] is not None]
    assert named == sorted(named) and got[0][0] is None
    assert repair.grammar_ids(none).collect() == []


def test_rules_are_pairs_of_earlier_symbols():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 30, 60_000)
    rules, symbols = repair.pair_rounds(ids, 100)
    assert len(symbols) < 0.7 * len(ids) and len(rules) > 100
    known = {k: [k] for k in range(100)}
    for k, (a, b) in enumerate(rules.tolist()):
        known[100 + k] = known[a] + known[b]
        assert 0 not in known[100 + k]
    assert [i for s in symbols.tolist() for i in known[s]] == ids.tolist()
    assert repair.rule_lengths(rules, 100).tolist() == [len(known[100 + k]) for k in range(len(rules))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=200), st.integers(0, 200), st.integers(0, 200))
def test_any_sequence(ids, start, stop):
    rules, symbols = repair.pair_rounds(np.array(ids, dtype=np.uint32), 4, least=2, bits=8)
    grammar = repair.Grammar(rules, repair.rule_lengths(rules, 4), 4)
    assert grammar.expand(symbols).tolist() == ids
    assert grammar.between(symbols, start, min(stop, len(ids))).tolist() == ids[start:stop]


@pytest.mark.parametrize("ids", [[], [5], [1] * 1000, [1, 2] * 500])
def test_runs(ids):
    rules, symbols = repair.pair_rounds(np.array(ids, dtype=np.uint32), 10)
    assert repair.Grammar(rules, repair.rule_lengths(rules, 10), 10).expand(symbols).tolist() == ids
    assert len(symbols) < 30 or len(ids) < 30
