"""URL filter, nearest neighbours and chat repair against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockmill.llm import chat, neighbours, url_filter


def brute_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    cut = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[:cut]


def brute_rule(host, path):
    fits = [(len(h + p), h + p, what) for what, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_filter(spark):
    rng = random.Random(4)
    hosts = ["a.example.com", "EXAMPLE.com", "b.example.net", "net", "c.org", "notcom", "spam.biz", "good.biz"]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['/en/7', '/en/', '/de/81', '/de/3.html', '/es/x', '', '/buy/now', '?q=/en/'])}{rng.choice(['', '#t', '?a=1&b=2'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "x://", "http://com/en/", "http://h?u=http://com/en/", "http://good.biz/" + "a/" * 5000]
    pages = [(k, u, "x") for k, u in enumerate(urls)] + [(3, urls[3], "x")]
    labels = [(k, "spam.biz" in (u or "") and "/buy/" in (u or "")) for k, u in enumerate(urls) if k % 2 == 0]
    df = spark.createDataFrame(pages, "page_id long, url string, tokens string")
    got = url_filter.filter_urls(df, spark.createDataFrame(labels, "page_id long, block boolean"), min_support=0.001, min_pages=3).collect()
    want = []
    for k, u, _ in pages:
        host, path = brute_parts(u)
        rule, verdict = brute_rule(host, path)
        mined = "block" if host == "spam.biz" and path.startswith("/buy/") else "allow"
        want.append((k, host, path, rule, verdict or mined))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    none = spark.createDataFrame([], "page_id long, url string")
    no_labels = spark.createDataFrame([], "page_id long, block boolean")
    assert url_filter.filter_urls(none, no_labels).count() == 0
    assert url_filter.filter_urls(df, no_labels).where("verdict is null").count() == 0


def brute_nearest(rows, queries, k):
    out = []
    for q, qv in queries:
        found = sorted(((-float(np.dot(np.float64(qv), np.float64(v))), i) for i, v in rows if i != q))[:k]
        out += [(q, r + 1, i) for r, (_, i) in enumerate(found)]
    return out


def test_neighbours_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = {(q, i) for q, _, i in brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)}
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest_neighbours(table, F.col("vec_id") % 20 == 0).collect()}
    assert len(got & want) >= 0.95 * len(want)


def full_shard(kind):
    rng = np.random.default_rng(2)
    noise = rng.standard_normal((neighbours.SHARD, 64))
    return (noise if kind == "unstructured" else rng.standard_normal((50, 64))[rng.integers(0, 50, len(noise))] + 0.5 * noise).astype(np.float32)


@pytest.mark.parametrize(("kind", "beam"), [("unstructured", 512), ("clustered", 64)])
def test_graph_recall_in_a_full_shard(kind, beam):
    v = full_shard(kind)
    g = neighbours.Graph.build(v, [np.array([[k, k]]) for k in range(len(v))], np.arange(len(v)), 0)
    place, ids, _ = g.nearest(v[:200], np.arange(200), 20, beam)
    said = v[:200].astype(np.float64) @ v.T.astype(np.float64)
    said[np.arange(200), np.arange(200)] = -np.inf
    want = {(q, i) for q, own in enumerate(np.argsort(-said, 1)[:, :20].tolist()) for i in own}
    assert len({*zip(place.tolist(), ids.tolist(), strict=True)} & want) >= 0.95 * len(want)


@pytest.mark.parametrize("kind", ["unstructured", "clustered"])
def test_cells_and_beam_are_widened_until_recall_holds(spark, monkeypatch, kind):
    v = full_shard(kind)[:5000]
    monkeypatch.setattr(neighbours, "SHARD", 600)
    v[1000:2500] = v[1000]  # a third of all rows are copies
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = neighbours.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect()
    exact = neighbours.nearest_neighbours(df, F.col("vec_id") % 50 == 0, exact=True).collect()
    said = v[::50].astype(np.float64) @ v.T.astype(np.float64)
    said[np.arange(100), np.arange(0, 5000, 50)] = -np.inf
    want = {(50 * q, r + 1, i) for q, s in enumerate(said) for r, i in enumerate(np.lexsort((np.arange(5000), -s))[:20].tolist())}
    assert {(r.query_id, r["rank"], r.vec_id) for r in exact} == want and len(got) == 2000
    assert len({(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i in want}) >= 0.9 * len(want)


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (40, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (60, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (80, [1.0, 0.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"shard": F.lit(1), "rank": F.lit(2)})
    got = {}
    for r in neighbours.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 6)))
    assert sorted(got[0]) == [(1, 1, 1.0), (2, 1, 1.0), (3, 40, 1.0), (4, 2, 0.5), (5, 20, 0.0)]
    assert {*got} == {0, 20, 40}
    assert neighbours.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def brute_cost(roles):
    best = [chat.FOREVER]

    def rec(k, state, cost):
        if cost >= best[0]:
            return
        if k == len(roles):
            best[0] = cost
            return
        own = roles[k]
        for after in (1, 2, 3):
            named = 0 if own == after else chat.RELABEL if own else chat.NAME_UNKNOWN
            if (state, after) in chat.LEGAL:
                rec(k + 1, after, cost + named)
            if state == after:
                rec(k + 1, after, cost + chat.MERGE + named)
            for x in (1, 2, 3):
                if (state, x) in chat.LEGAL and (x, after) in chat.LEGAL:
                    rec(k + 1, after, cost + chat.INSERT + named)

    rec(0, 0, 0)
    return best[0]


def test_repair_costs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        roles = [rng.choice([0, 1, 2, 3]) for _ in range(rng.randint(1, 7))]
        cost, _ = chat.run(roles, 0)
        assert cost[chat.best_end(cost)] == brute_cost(roles)


def test_chat_spans_partitions(spark):
    rng = random.Random(6)
    names = ["user", "assistant", "USER", "human", "bot", "system", None, "tool"]
    rows = [(c, t, rng.choice(names), rng.choice(["a", "<|user|>", None, "b\nc"])) for c in range(30) for t in range(rng.randint(1, 12))]
    rows += [(99, t, rng.choice(names), f"t{t}") for t in range(3000)] + [(None, None, "user", "x")] * 40 + [(7, 3, "user", "same")] * 500
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("spread", F.lit("z"))
    results = []
    for parts in ("1", "16"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(map(tuple, chat.repair_conversations(df).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
    by = {}
    for r in results[0]:
        by.setdefault(r[0], []).append(r)
    assert sum(r[6] != "insert" for r in results[0]) == len(rows)
    for rs in by.values():
        assert [r[1] for r in rs] == [*range(len(rs))]
        said = "".join(r[8] for r in rs)
        assert said.endswith("<|end|>\n") and said.count("<|end|>") == rs[-1][2] + 1
        turns = [next(r[4] for r in rs if r[2] == k) for k in range(rs[-1][2] + 1)]
        body = turns[1:] if turns[0] == "system" else turns
        assert all(t == ("user", "assistant")[k % 2] for k, t in enumerate(body))
    assert chat.repair_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize(("queries", "size"), [(8_192, 32 << 20), (7, 700)])
def test_exact_search_in_blocks(spark, monkeypatch, queries, size):
    """Whole numbers, so that scores tie; copies, several lengths, and rows of equal id."""
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", queries)
    monkeypatch.setattr(neighbours, "NODE_BYTES", size)
    rng = np.random.default_rng(8)
    rows = [(int(k), [float(x) for x in rng.integers(-2, 3, 3)] + ([1.0] if k % 9 == 0 else [])) for k in range(160)]
    rows += [(200 + k, rows[3][1]) for k in range(12)] + [(20, [1.0, 2.0, 0.0]), (300, None), (301, [0.0, 0.0, 0.0])]
    usable = [(k, i, v) for k, (i, v) in enumerate(rows) if v and any(v)]
    want = []
    for k, q, v in usable:
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for j, i, w in usable if j != k and len(w) == len(v))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = neighbours.nearest_neighbours(df, F.col("vec_id") % 20 == 0, 5, vector_col="vector", exact=True).collect()
    assert sorted(map(tuple, got)) == sorted(want)
