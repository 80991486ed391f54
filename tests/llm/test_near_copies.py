"""Near copies of the pipeline's stage against the similarity of all pairs."""

import random

from spindrift.llm import near_copies, simhash

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return not (a or b) or len(a & b) >= 0.8 * len(a | b)


def test_edited_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    rows, far = [], 0
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((3 * k, " ".join(words)))
        words[60] = words[130] = "edited"  # 10 of 196 shingles
        rows.append((3 * k + 1, " ".join(words)))
        words[::12] = ["other"] * len(words[::12])
        rows.append((3 * k + 2, " ".join(words)))
        far += bin(simhash.fingerprint(rows[-3][1]) ^ simhash.fingerprint(rows[-2][1])).count("1") > 2
    assert far > 20  # the two-bit rule does not link them
    got = near_copies.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in rows if i % 3 != 1]


def test_stage_against_all_pairs(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and alike(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(i) for i in ids})


def test_pairs_that_meet_in_no_bucket_are_linked(spark, monkeypatch):
    """Against all pairs, with buckets that find nothing, a small sample, and texts of one to a few hundred words."""
    rng, texts = random.Random(9), ["", "one", "one two three four"]
    for k in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 6, 9, 14, 30, 120, 300]))]
        texts.append(" ".join(words))
        for _ in range(3):
            words = list(words)
            for _ in range(max(1, len(words) // rng.choice([40, 60, 90]))):
                words[rng.randrange(len(words))] = f"e{rng.randrange(3000)}"
            texts.append(" ".join(words + ["common line of every text here"] * (k % 3 == 0)))
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if texts[a] != texts[b] and alike(sets[a], sets[b]):
                old, new = sorted((root[a], root[b]), reverse=True)
                root = [new if r == old else r for r in root]
    want = sorted(set(root))
    assert 60 < len(want) < len(texts) - 40
    monkeypatch.setattr(near_copies, "candidates", lambda *_: spark.createDataFrame([], "a long, b long"))
    for sampled in (near_copies.SAMPLED, 20):
        monkeypatch.setattr(near_copies, "SAMPLED", sampled)
        got = near_copies.keep_representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert sorted(r["doc_id"] for r in got.collect()) == want


def test_sketches_exclude_no_similar_sets():
    """The bits in which sketches differ are never more than the shingles in which the sets do."""
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (0, 1, 5, 127, 129, 260, 5000):
        for share in (0.0, 0.1, 1.0):
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            other = np.concatenate([base[int(size * share) :], rng.integers(0, 1 << 63, int(size * share * 0.9), dtype=np.uint64)])
            x, y = near_copies.sketch(base), near_copies.sketch(other)
            while len(x) != len(y):
                x, y = (z if len(z) <= min(len(x), len(y)) else z[: len(z) // 2] ^ z[len(z) // 2 :] for z in (x, y))
            bits = sum(bin(int(b) & (1 << 64) - 1).count("1") for b in x ^ y)
            differ = len(np.setxor1d(base, other))
            assert bits <= differ
            if size >= 260 and share == 1.0:  # and they tell strangers apart
                assert bits > 0.25 * size


def test_only_possible_pairs_are_compared_and_tables_go(spark, monkeypatch):
    """300 texts in which others' passages stand: sets are made for pairs that may be similar alone, whatever their shingles in common."""
    from spindrift.sources import tables

    rng = random.Random(2)
    passages = [[f"p{k}x{j}" for j in range(30)] for k in range(10)]
    rows = []
    for k in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        words[40:40] = passages[k % 10]
        rows.append((k, " ".join(words)))
    rows.append((300, " ".join(words[:-1] + ["edited"])))
    marked, seen = near_copies._marked, []
    monkeypatch.setattr(near_copies, "_marked", lambda pairs: (seen.append(pairs.count()), marked(pairs))[1])
    texts = spark.createDataFrame(rows, "node long, text string")
    before = tables.mark()
    assert [tuple(sorted(r)) for r in near_copies.similar_pairs(texts).distinct().collect()] == [(299, 300)]
    assert sum(seen) <= 5
    assert tables.mark() == before + 1


def joined(spark, since):
    """Rows that each join made in the executions after so many."""
    store = spark._jsparkSession.sharedState().statusStore()
    out, all_of = [0], store.executionsList()
    for k in range(since, all_of.size()):
        number = all_of.apply(k).executionId()
        got, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if "Join" in node.name():
                for metric in (node.metrics().apply(j) for j in range(node.metrics().size())):
                    value = got.get(metric.accumulatorId())
                    if metric.name() == "number of output rows" and value.isDefined():
                        out.append(int(value.get().replace(",", "")))
    return out


def test_a_crowd_that_shares_shingles_is_not_paired(spark, monkeypatch):
    """Edited copies of one text, most below 0.8 among themselves: the same links as of all pairs, and no join makes many rows of them."""
    rng, base = random.Random(4), [f"w{k}" for k in range(150)]
    texts = []
    for k in range(240):
        words = list(base)
        for _ in range(rng.choice([2, 5, 8, 9, 10])):
            words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
        if k % 8 == 0:  # a near copy of one of them that shares its edits
            words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if alike(sets[a], sets[b]):
                old, new = sorted((root[a], root[b]), reverse=True)
                root = [new if r == old else r for r in root]
    want = sorted(set(root))
    assert 60 < len(want) < len(texts) - 60
    monkeypatch.setattr(near_copies, "candidates", lambda *_: spark.createDataFrame([], "a long, b long"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert sorted(r["doc_id"] for r in near_copies.keep_representatives(docs).collect()) == want
    assert max(joined(spark, before)) < 60 * len(texts)
    monkeypatch.setattr(near_copies, "CROWD", 1)
    assert sorted(r["doc_id"] for r in near_copies.keep_representatives(docs).collect()) == want


def test_differences_from_a_hub_lose_no_similar_sets():
    """Two similar sets that are not both linked to the hub share one of the shingles by which they are looked up, with places that fit; against all triples."""
    import numpy as np

    rng, none = np.random.default_rng(6), (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    apart = 0
    for similarity in (0.5, 0.8, 0.95):
        for _ in range(120):
            core = rng.choice(400, rng.integers(1, 60), replace=False)
            sets = []
            for _ in range(8):
                part = core[rng.random(len(core)) < rng.choice([0.6, 0.9, 0.98])]
                sets.append(np.unique(np.concatenate([part, rng.choice(400, rng.integers(0, 8))])).astype(np.uint64))
            sets = [s for s in sets if len(s)]
            hub = sets[0]
            rows = [(s, *near_copies.difference(s, hub, similarity, *none)) for s in sets[1:]]
            for k, (x, linked, n, _, first) in enumerate(rows):
                assert linked == (len(np.intersect1d(x, hub)) >= similarity * len(np.union1d(x, hub)))
                for j, (y, other, m, reach, begin) in enumerate(rows):
                    if k == j or (n, k) < (m, j) or linked and other or len(np.intersect1d(x, y)) < similarity * len(np.union1d(x, y)):
                        continue
                    apart += 1
                    first_at = {int(v): p for p, v in enumerate(first)}
                    common = (n + m - (1 - similarity) / (1 + similarity) * (len(x) + len(y))) / 2
                    assert any(min(n - first_at[int(v)], m - p) >= common - 1e-6 for p, v in enumerate(begin[:reach]) if int(v) in first_at)
    assert apart > 300


def test_shingles_that_a_sample_misses_are_not_paired(spark, monkeypatch):
    """Passages that 30 texts each share and the sample does not show: no join makes many rows of them, and the near copies are found as by all pairs."""
    rng, rows = random.Random(7), []
    passages = [[f"p{k}x{j}" for j in range(60)] for k in range(10)]
    for k in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(180)]
        words[40:40] = passages[k % 10]
        rows.append((2 * k, " ".join(words)))
        if k % 6 == 0:
            words[rng.randrange(len(words))] = "edited"
            rows.append((2 * k + 1, " ".join(words)))
    monkeypatch.setattr(near_copies, "SAMPLED", 20)
    monkeypatch.setattr(near_copies, "candidates", lambda *_: spark.createDataFrame([], "a long, b long"))
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = near_copies.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == [2 * k for k in range(300)]
    # an edited copy and its text share some 40 shingles of their prefixes
    assert max(joined(spark, before)) < 6_000
