"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dockmill.llm import components, near_jaccard


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def survivors(docs):
    """Smallest id of each component of similarity 0.8."""
    sets, root = [shingles(t) for _, t in docs], [*range(len(docs))]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for k, (i, _) in enumerate(docs):
        groups.setdefault(find(k), []).append(i)
    return sorted(map(min, groups.values()))


def kept(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(r.doc_id for r in corpus_pipeline.near(spark, df, "").collect())


def test_stage_equals_brute_force_jaccard(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    docs = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 200, 400]))]
        for _ in range(4):
            copy = [*base]
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy))
    hot = [rng.choice(words) for _ in range(300)]
    docs += [" ".join([*hot, *(rng.choice(words) for _ in range(n))]) for n in (0, 20, 40, 60, 80, 100) for _ in range(10)]
    docs += ["", None, "  ", "one two", "One  TWO", "one three"]
    docs = [*enumerate(docs)]
    want = survivors(docs)
    assert len(want) < len(docs) - 40
    assert kept(spark, docs) == want


def test_stage_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = [tuple(r) for r in rows if (r.text or "").strip()]
    want = survivors(docs)
    assert not {145, 177} & {*want}  # similar by 0.83, 7 and 11 bits apart
    assert kept(spark, docs) == want


@pytest.mark.parametrize(("pairs", "size"), [(20_000, 32 << 20), (3, 32 << 20), (20_000, 500)])
def test_tiles_change_nothing(spark, monkeypatch, pairs, size):
    monkeypatch.setattr(near_jaccard, "TILE_PAIRS", pairs)
    monkeypatch.setattr(near_jaccard, "TILE_BYTES", size)
    rng = random.Random(3)
    held = {k: sorted(rng.sample(range(60), rng.choice([40, 50]))) for k in range(-15, 15)}
    asked = [(-15, b) for b in range(-14, 15)] + [(a, a + 1) for a in range(-14, 14)] + [(3, 99)]
    want = sorted((a, b) for a, b in asked if b in held and 10 * len({*held[a]} & {*held[b]}) >= 6 * len({*held[a]} | {*held[b]}))
    sets = spark.createDataFrame([*held.items()], "node long, shingles array<long>")
    got = near_jaccard.verified(spark.createDataFrame(asked, "a long, b long"), sets, 0.6).collect()
    assert 5 < len(want) < len(asked) - 5 and sorted(map(tuple, got)) == want
    assert near_jaccard.verified(spark.createDataFrame([], "a long, b long"), sets.limit(0), 0.6).collect() == []


def test_counts_within_a_tile():
    rng = random.Random(4)
    for n, few, columns in ((1, 12, 1024), (40, 12, 3), (40, 2, 7), (0, 12, 5)):
        sets = [sorted(rng.sample(range(60), rng.randrange(30))) for _ in range(n)]
        near_jaccard.FEW_NODES, near_jaccard.COLUMNS = few, columns
        got = near_jaccard.shared_counts([near_jaccard.np.array(x, "int64") for x in sets])
        assert all(got[i, j] == len({*sets[i]} & {*sets[j]}) for i in range(n) for j in range(i + 1, n))
    near_jaccard.FEW_NODES, near_jaccard.COLUMNS = 12, 1024


def near_texts(n, seed):
    """Texts a little under 0.8 to one another, made from one, so that few link, in chains."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(50_000)]
    base = [rng.choice(words) for _ in range(300)]
    texts = []
    for _ in range(n):
        copy = [*base]
        for _ in range(rng.choice([4, 5, 6])):
            copy[rng.randrange(300)] = rng.choice(words)
        texts.append(" ".join(copy))
    return [*enumerate(texts)]


@pytest.mark.parametrize(("nodes", "rows"), [(2048, 256), (90, 7)])
def test_texts_a_little_under_the_similarity(spark, monkeypatch, nodes, rows):
    monkeypatch.setattr(near_jaccard, "GROUP_NODES", nodes)
    monkeypatch.setattr(near_jaccard, "ROWS", rows)
    docs = near_texts(2000 if nodes > 90 else 400, 9)
    sets = [near_jaccard.shingle_hashes(t.encode()) for _, t in docs]
    values = {v: k for k, v in enumerate(sorted({int(v) for s in sets for v in s}))}
    table = near_jaccard.np.zeros((len(docs), len(values)), "float32")
    for k, s in enumerate(sets):
        table[k, [values[int(v)] for v in s]] = 1
    both = table @ table.T
    size = table.sum(1)
    linked = both * 5 >= 4 * (size[:, None] + size[None, :] - both)
    root = [*range(len(docs))]
    for _ in range(len(docs)):
        now = [min(root[j] for j in linked[k].nonzero()[0]) for k in range(len(docs))]
        if now == root:
            break
        root = now
    want = sorted(set(root))
    assert 10 < len(want) < len(docs) - 10 and 0.002 < linked.mean() < 0.7
    assert kept(spark, docs) == want


def test_simhash_step(spark):
    """Fingerprints within 3 bits are found whatever the bands are; what is less alike than the similarity is not linked by them."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    docs = []
    for n in (300, 600, 2000, 2000):
        base = [rng.choice(words) for _ in range(n)]
        for change in range(6):
            copy = [*base]
            for _ in range(change // 2):
                copy[rng.randrange(n)] = rng.choice(words)
            docs.append(" ".join(copy))
    docs += ["a b c d e f", "x y", "", None]
    df = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string")
    rows = near_jaccard.signatures(df, "doc_id", "text", 5).cache()
    held = {r.node: r.fp for r in rows.collect() if r.bands}
    sets = {r.node: shingles(docs[r.doc_id]) for r in rows.collect() if r.bands}
    fps = [(near_jaccard.majority(near_jaccard.shingle_hashes((t or "").encode())), t) for t in docs if (t or "").strip()]
    assert {f for f, _ in fps} == {f % (1 << 64) for f in held.values()}

    def parts(pairs):
        root = {x: x for x in held}
        for _ in held:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    bits = [(a, b) for a in held for b in held if a < b and ((held[a] ^ held[b]) % (1 << 64)).bit_count() <= 3]
    got = [tuple(r) for r in near_jaccard.simhash_pairs(rows.where("size(bands) > 0").select("node", "fp").distinct()).collect()]
    assert bits and {tuple(sorted(p)) for p in got} <= {*bits} and parts(got) == parts(bits)
    alone = rows.withColumn("bands", F.when(F.size("bands") > 0, F.array("node")).otherwise(F.col("bands")))  # no two share a band
    links = [tuple(r) for r in near_jaccard.near_links(df, alone, "doc_id", "text", 5, 0.8).collect()]
    assert links and parts(links) == parts([(a, b) for a, b in bits if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])


@pytest.mark.parametrize("edges", [100_000, 40])
def test_components_in_few_tasks(spark, monkeypatch, edges):
    """Rounds over few links take few tasks and files, however many partitions the session shuffles to."""
    monkeypatch.setattr(components, "EDGES", edges)
    rng = random.Random(6)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(500, 540)] + [(900, k) for k in range(901, 940)] + [(7, 7)]
    root = {x: x for p in links for x in p if p[0] != p[1]}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("23", "false", "1"), strict=True):
        spark.conf.set(k, v)
    try:
        got = components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(9))
        assert sorted(map(tuple, got.collect())) == sorted(root.items())
        if edges > 1000:
            assert got.rdd.getNumPartitions() == 1
        assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
