"""Second implementations, clashing names, very long texts and hot keys."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import common, content_sort, imatch, lang_id, lines, mixing, near_copies, packing, pii, secret_scan, simhash, toxicity


def normal(z):
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def plain_battery(token, alphabet):
    """(chi-squared, Fisher's joint p) of a token in NumPy, with the exact normal distribution."""
    sym = token.rstrip("=")
    x = np.array([alphabet.index(c) for c in sym], dtype=float)
    n, m = len(x), len(alphabet)
    counts = np.array(list(Counter(sym).values()), dtype=float)
    x2 = m / n * (counts**2).sum() - n
    p = [1 - normal((x2 - (m - 1)) / math.sqrt(2 * (m - 1) * (n - 1) / n))]
    bits = x * 2 >= m
    ones = bits.sum()
    if 0 < ones < n:
        mean = 1 + 2 * ones * (n - ones) / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p.append(2 * (1 - normal(abs((np.diff(bits.astype(int)) != 0).sum() + 1 - mean) / math.sqrt(var))))
    else:
        p.append(2.0 ** (1 - n))
    d = x - x.mean()
    corr = (d[1:] * d[:-1]).sum() / (d * d).sum() if (d * d).sum() else 1.0
    p.append(2 * (1 - normal(abs((corr + 1 / (n - 1)) * math.sqrt(n)))))
    half = -sum(math.log(max(v, 1e-12)) for v in p)
    return x2, math.exp(-half) * (1 + half + half * half / 2)


def test_battery_against_numpy(spark):
    rng = random.Random(8)
    kinds = {"dec": "0123456789", "hex": "0123456789abcdef", "base32": "abcdefghijklmnopqrstuvwxyz234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz"}
    kinds["base62"] = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    kinds["base64"] = kinds["base62"] + "+/"
    rows = []
    for name, alphabet in kinds.items():
        for n in (16, 24, 40, 200):
            for bias in (1, 3):
                token = "".join(rng.choice(alphabet[: len(alphabet) // bias]) for _ in range(n))
                rows.append((token.upper() if name == "base32" else token, name, alphabet))
    got = {r["token"]: r for r in secret_scan.battery(spark.createDataFrame([(t,) for t, *_ in rows], "token string")).collect()}
    seen = 0
    for token, name, alphabet in rows:
        if got[token]["enc"] != name:  # a draw may lack what tells its alphabet
            continue
        x2, p = plain_battery(token.lower() if name == "base32" else token, alphabet)
        assert math.isclose(got[token]["x2"], x2, rel_tol=1e-9, abs_tol=1e-6)
        assert abs(got[token]["p_random"] - p) < 0.02
        seen += 1
    assert seen > 20


def test_thresholds_against_plain_control(spark):
    rng = random.Random(4)
    rows = [(band, min(480, int(-40 * math.log10(max(p, 1e-12))))) for band in (4, 5, 6) for p in [rng.random() for _ in range(300)] + [rng.random() ** 6 / 1000 for _ in range(40)]]
    got = {r["band"]: r["cut"] for r in secret_scan.thresholds(spark.createDataFrame(rows, "band int, cell int")).collect()}
    for band in (4, 5, 6):
        cells = [c for b, c in rows if b == band]
        passing = [c for c in set(cells) if 10 ** (-c / 40) <= sum(x >= c for x in cells) * secret_scan.FDR / len(cells)]
        assert got.get(band) == min(passing, default=None)


def plain_mixture(scores, n, members):
    """Expectation-maximisation to the end over the given languages."""
    like = np.exp(scores[:, members] - scores.max(axis=1, keepdims=True))
    pi = np.full(len(members), 1 / len(members))
    for _ in range(3000):
        share = like * pi
        pi = (n[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
    return pi, float(n @ np.log(np.maximum(like @ pi, 1e-300)))


@pytest.mark.parametrize("seed", range(4))
def test_language_sets_against_all_subsets(seed):
    import itertools

    rng = np.random.default_rng(seed)
    truth = [[0], [1], [0, 2], [1, 3]][seed]
    words = 400
    scores = rng.normal(-14, 1.5, (words, 4))
    for row, lang in enumerate(rng.choice(truth, words)):
        scores[row, lang] += 6
    n = rng.integers(1, 4, words).astype(float)
    got = lang_id.proportions(scores, n)
    cost = lang_id.PENALTY * 0.5 * math.log(n.sum())
    best = max((plain_mixture(scores, n, list(m))[1] - cost * len(m), m) for k in range(1, 5) for m in itertools.combinations(range(4), k))
    assert set(np.nonzero(got)[0]) == set(best[1]) == set(truth)
    pi, _ = plain_mixture(scores, n, list(best[1]))
    assert np.abs(got[list(best[1])] - pi).max() < 0.01


def test_small_language_keeps_its_grams(spark):
    rng = random.Random(1)
    rows = [(k, "big", " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(200))) for k in range(60)] + [(1000 + k, "small", "zyx wvut zyx uvwx") for k in range(3)]
    model = lang_id.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"), F.lit(True))
    assert model.langs == ["big", "small"]
    got = lang_id.identify(spark.createDataFrame([(1, "zyx uvwx")], "doc_id long, text string"), model).first()
    assert got["lang_pred"] == "small"


def test_toxicity_finds_and_spares(spark):
    sf = "/root/testdata/sf0.1"  # 97 toxic documents held out
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r["predicted"] for r in toxicity.toxic_documents(docs, labels).collect()}
    held = [(r["toxic"], rows[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["toxic"] is not None]
    hit = sum(a and b for a, b in held)
    assert hit >= 0.85 * sum(a for a, _ in held) > 0  # recall
    assert hit >= 0.95 * sum(b for _, b in held)  # precision


def test_spans_beside_known_ones(spark):
    rng = random.Random(6)
    for _ in range(3):
        cuts = sorted(rng.sample(range(400), 80))
        items = list(zip(cuts[::2], cuts[1::2]))
        known = sorted([(a, a + rng.randint(1, 30)) for a in rng.sample(range(400), 20)] + items[::9] + [(a, a + 1) for a, _ in items[4::9]])
        rows = spark.createDataFrame([(1, [(a, b, f"{a}") for a, b in items], [(a, b) for a, b in known]), (2, [(0, 3, "0")], [])], "row long, items array<struct<start:int,end:int,name:string>>, known array<struct<start:int,end:int>>")
        got = {(r["row"], r["start"], r["end"], r["name"]): r["beside"] for r in common.beside(rows, "items", "known", "name:string").collect()}
        want = {(1, a, b, f"{a}"): not any(s < b and a < e for s, e in known) for a, b in items} | {(2, 0, 3, "0"): True}
        assert got == want


def test_folds_in_pieces(monkeypatch, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    monkeypatch.setattr(content_sort, "FLUSH_BYTES", 1)

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["id", "text"])
    parts = [r for b in content_sort._fold(iter([batch])) for r in b.to_pylist()]
    assert sum(r["n"] for r in parts) == len(rows) == len(parts)
    again = Counter()
    for r in parts:
        again[r["digest"]] += r["n"]
    want = Counter(r["text_sha256"] for r in content_sort.exact_dedup(docs).collect())
    assert Counter({k.hex(): v for k, v in again.items()}) == want


CLASH = ["__id", "__sha", "__c", "__n", "__fp", "__root", "row", "whole", "_row", "_place", "_place_row", "th", "at", "first", "node", "keys", "_metadata", "seq", "b", "s", "sig", "hi", "lo"]


def test_names_that_clash(spark):
    rows = [(k, f"text number {k % 6} of some words that follow here", "en", f"s{k % 3}", 10, *[f"{c}{k}" for c in CLASH]) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH))
    whole = {tuple(r) for r in docs.collect()}
    for stage, kept in ((content_sort.keep_first_copies, 6), (simhash.keep_representatives, 6), (near_copies.keep_representatives, 6), (mixing.mixed_order, 30), (lang_id.keep_identified, 30)):
        out = stage(docs)
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(set(got)) == kept and set(got) <= whole, stage
    for operator in (lang_id.language_of, packing.pack, secret_scan.secrets, pii.personal_data, imatch.fingerprint_pairs, simhash.near_duplicates, mixing.mix, lines.repeated_units, content_sort.exact_dedup):
        want = sorted(map(str, operator(docs.select("doc_id", "text", "lang", "source", "n_chars")).drop("sequence_id", "offset").collect()))
        assert sorted(map(str, operator(docs).drop("sequence_id", "offset").collect())) == want, operator


def test_very_long_texts_and_hot_keys(spark):
    rng = random.Random(9)
    long = " ".join(f"word{rng.randrange(3000)} {rng.randrange(10**6)}" for _ in range(120_000))  # over 1.5 MB
    rows = [(0, long, "en", "hot"), (1, long[:-1], "en", "hot")] + [(k, "the same short text of a hot group", "en", "hot") for k in range(2, 1500)]
    rows += [(k, f"a text of its own {k}", "fr", f"s{k % 7}") for k in range(1500, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(8).cache()
    n = len(rows)
    assert content_sort.exact_dedup(docs).filter("kept").count() == n - 1497
    assert {r["component_id"] for r in simhash.near_duplicates(docs).filter("doc_id in (0, 1)").collect()} == {0}
    assert {r["doc_id"] for r in near_copies.keep_representatives(docs).filter("doc_id < 1500").collect()} == {0, 2}
    assert imatch.fingerprint_pairs(docs).filter("doc_id = 2").first()["near_next"] == 1
    gone = Counter(r["doc_id"] for r in lines.repeated_units(docs).collect())
    assert sum(3 <= i < 1500 for i in gone) == 1497
    assert mixing.mix(docs).count() == n
    packed = packing.pack(docs)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == n and packed.filter("doc_id = 0").count() > 200
    assert {r["lang_pred"] for r in lang_id.language_of(docs).filter("doc_id < 2").collect()} == {"en"}
    assert pii.personal_data(docs).count() == secret_scan.secrets(docs).count() == n
