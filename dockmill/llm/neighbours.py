"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one for each shard.

Equal vectors are one node, whose members of smallest id stand for all. Nodes are dealt to the
nearest of some centres (k-means over a bounded sample), and cells of more than ``SHARD`` nodes are
split by hash. A shard's graph is built by insertion: nodes get geometric levels and enter each
layer in batches; a batch is placed by searching the graph built so far, is linked to near nodes
that are not nearer to one another, and these link back. A graph is one row of flat arrays. Largest
inner product is made a metric search by one more component that gives all vectors equal length.

How many cells a query visits and how wide the search is are not fixed: for ``TRIAL`` queries the
exact neighbours are computed by one scan of all nodes, and the cheapest setting that finds
``RECALL`` of them is taken. If none does, all queries are answered by exact scans. Scores are exact
double-precision products, merged by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockmill.llm.common import BROADCAST_KEYS, cut, partitions_for, table

SHARD, QUERY_BLOCK = 8_192, 8_192
CENTRE_SAMPLE, MOST_CENTRES, ROUNDS = 65_536, 4_096, 8
LINKS, BUILD_BEAM, BATCH, STEP, CHUNK = 16, 64, 1024, 4, 256
TRIAL, RECALL, BEAMS = 64, 0.95, (64, 128, 256, 512)
GRAPH = "dim int, cell int, part int, vectors binary, layers array<int>, links binary, members binary, member_sizes binary, nids binary"


def _nearer_first(ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def _chosen(points: np.ndarray, ids: np.ndarray, near: np.ndarray, width: int) -> np.ndarray:
    """Of each row's candidates (-1: none; nearest first, each once) at most ``width``: those not nearer to a chosen one, then the nearest others."""
    own = points[np.maximum(ids, 0)]
    among = own @ own.transpose(0, 2, 1)
    valid = ids >= 0
    kept = np.zeros(ids.shape, bool)
    count = np.zeros(len(ids), np.int32)
    for j in range(ids.shape[1]):
        hidden = (kept & (among[:, j] > near[:, j, None])).any(1)
        kept[:, j] = valid[:, j] & ~hidden & (count < width)
        count += kept[:, j]
    rank = np.where(kept, 0, np.where(valid, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    order = np.argsort(rank, axis=1, kind="stable")[:, :width]
    out = np.full((len(ids), width), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(np.where(valid, ids, -1), order, 1)
    return out


def _once(ids: np.ndarray) -> np.ndarray:
    """Ids with repeats within a row replaced by -1; rows come sorted."""
    ids = np.sort(ids, 1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


def _beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, size: int) -> np.ndarray:
    """``beam`` of the first ``size`` nodes for each query by following links from its entry, -1 where there are fewer; all of them if so few."""
    q = len(queries)
    if size <= beam:
        return np.tile(np.arange(size, dtype=np.int32), (q, 1))
    rows = np.arange(q)[:, None]
    ids = np.full((q, beam), -1, np.int32)
    said = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, size), bool)
    ids[:, 0], done[:, 0] = entries, False
    said[:, 0] = np.einsum("qd,qd->q", queries, points[entries])
    seen[rows[:, 0], entries] = True
    while True:
        waiting = np.where(done, -np.inf, said)
        pick = np.argpartition(-waiting, STEP, axis=1)[:, :STEP]
        is_open = np.take_along_axis(waiting, pick, 1) > -np.inf
        going = np.nonzero(is_open.any(1))[0]
        if not len(going):
            return ids
        pick, is_open = pick[going], is_open[going]
        flags = done[going]
        np.put_along_axis(flags, pick, True, 1)
        own = ids[going]
        near = links[np.take_along_axis(own, pick, 1)]
        near = np.sort(np.where(is_open[:, :, None], near, -1).reshape(len(going), -1), 1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[going[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        seen[going[r], near[r, c]] = True
        new = np.full(near.shape, -np.inf, np.float32)
        new[r, c] = np.einsum("kd,kd->k", points[near[r, c]], queries[going[r]])
        every = np.concatenate([said[going], new], 1)
        top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        said[going] = kept = np.take_along_axis(every, top, 1)
        ids[going] = np.where(kept == -np.inf, -1, np.take_along_axis(np.concatenate([own, near], 1), top, 1))
        done[going] = np.take_along_axis(np.concatenate([flags, ~fresh], 1), top, 1)


def _link_back(points: np.ndarray, links: np.ndarray, sources: np.ndarray, targets: np.ndarray) -> None:
    """Every target links to its source; a full target keeps its best."""
    width = links.shape[1]
    while len(targets):
        order = np.argsort(targets, kind="stable")
        sources, targets = sources[order], targets[order]
        place = np.arange(len(targets)) - np.searchsorted(targets, targets)
        now, later = place < width // 2, place >= width // 2
        own, at = np.unique(targets[now], return_inverse=True)
        more = np.full((len(own), width // 2), -1, np.int32)
        more[at, place[now]] = sources[now]
        used = (links[own] >= 0).sum(1)
        fits = used + (more >= 0).sum(1) <= width
        r, c = np.nonzero((more >= 0) & fits[:, None])
        links[own[r], used[r] + c] = more[r, c]
        full = own[~fits]
        for lo in range(0, len(full), 2048):
            some = full[lo : lo + 2048]
            ids = _once(np.concatenate([links[some], more[~fits][lo : lo + 2048]], 1))
            near = np.where(ids >= 0, np.einsum("ncd,nd->nc", points[np.maximum(ids, 0)], points[some], optimize=True), -np.inf)
            picked = _chosen(points, *_nearer_first(ids, near), width * 3 // 4)  # room for those to come
            links[some] = -1
            links[some, : picked.shape[1]] = picked
        sources, targets = sources[later], targets[later]


class Graph:
    """Layers of links over one shard's nodes in the order of their levels, highest first: layer L holds the first ``layers[L]`` nodes."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], members: list[np.ndarray], nids: np.ndarray):
        self.vectors, self.links, self.members, self.nids = vectors, links, members, nids
        self.points = self._lifted(vectors)

    @staticmethod
    def _lifted(vectors: np.ndarray) -> np.ndarray:
        v = vectors.astype(np.float32)
        norms = np.einsum("nd,nd->n", v, v, dtype=np.float64)
        return np.hstack([v, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None].astype(np.float32)])

    @classmethod
    def build(cls, vectors: np.ndarray, members: list[np.ndarray], nids: np.ndarray, seed: int) -> Graph:
        """``members``: (id, row) pairs of each node."""
        order = np.argsort(nids, kind="stable")
        drawn = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(order))) / np.log(LINKS)).astype(int)
        by_level = np.argsort(-drawn, kind="stable")
        order, levels = order[by_level], drawn[by_level]
        graph = cls(np.ascontiguousarray(vectors[order]), [], [members[k] for k in order], nids[order])
        for level in range(levels[0], -1, -1):
            graph.links.insert(0, None)
            graph._insert_layer(int((levels >= level).sum()), 2 * LINKS if level == 0 else LINKS)
        return graph

    def _insert_layer(self, size: int, width: int) -> None:
        """Build the lowest layer so far over the first ``size`` nodes, from the nodes of the layer above it on."""
        points = self.points
        links = self.links[0] = np.full((size, width), -1, np.int32)
        at = 1
        while at < size:
            batch = np.arange(at, min(size, at + min(BATCH, at)), dtype=np.int32)
            own = points[batch]
            known = min(at, len(self.links[1]) if len(self.links) > 1 else at)  # an entry has to be in this layer already
            found = _beam(points, links, own, self._entries(own, 1, known), BUILD_BEAM, at)
            beside = own @ own.T
            np.fill_diagonal(beside, -np.inf)
            few = min(LINKS, len(batch) - 1)
            near_batch = batch[np.argpartition(-beside, few - 1, axis=1)[:, :few]] if few else np.zeros((len(batch), 0), np.int32)
            ids = _once(np.concatenate([found, near_batch], 1))
            near = np.where(ids >= 0, np.einsum("ncd,nd->nc", points[np.maximum(ids, 0)], own, optimize=True), -np.inf)
            links[batch, : width // 2] = _chosen(points, *_nearer_first(ids, near), width // 2)
            r, c = np.nonzero(links[batch, : width // 2] >= 0)
            _link_back(points, links, batch[r], links[batch[r], c])
            at += len(batch)

    def _entries(self, queries: np.ndarray, lowest: int, known: int | None = None) -> np.ndarray:
        """Greedy descent from the first node through the layers down to ``lowest``, over the first ``known`` nodes."""
        at = np.zeros(len(queries), np.int32)
        best = np.einsum("qd,qd->q", queries, self.points[at])
        for layer in range(len(self.links) - 1, lowest - 1, -1):
            going = np.arange(len(queries))
            while len(going):
                near = self.links[layer][at[going]]
                ok = (near >= 0) & (near < (known if known is not None else len(self.points)))
                ids = np.where(ok, near, at[going][:, None])
                said = np.einsum("qkd,qd->qk", self.points[ids], queries[going])
                pick = said.argmax(1)
                top = said[np.arange(len(going)), pick]
                better = top > best[going]
                moved = going[better]
                at[moved], best[moved] = ids[np.nonzero(better)[0], pick[better]], top[better]
                going = moved
        return at

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """``beam`` nodes found for each query, -1 where there are fewer."""
        lifted = np.hstack([queries.astype(np.float32), np.zeros((len(queries), 1), np.float32)])
        return _beam(self.points, self.links[0], lifted, self._entries(lifted, 1), beam, len(self.points))

    def nearest(self, queries: np.ndarray, own_rows: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, vec_id, score) of the ``k`` nearest members found for each query, its own row left out."""
        out = [[], [], []]
        for at in range(0, len(queries), CHUNK):
            part = queries[at : at + CHUNK]
            found = self.search(part, beam)
            for j, nodes in enumerate(found):
                nodes = nodes[nodes >= 0]
                scores = self.vectors[nodes].astype(np.float64) @ part[j].astype(np.float64)
                best = np.argsort(-scores, kind="stable")
                if len(best) > k + 1:
                    best = best[scores[best] >= scores[best[k]]]
                ids = np.concatenate([self.members[n] for n in nodes[best]])
                values = np.repeat(scores[best], [len(self.members[n]) for n in nodes[best]])
                kept = ids[:, 1] != own_rows[at + j]
                ids, values = ids[kept, 0], values[kept]
                order = np.lexsort((ids, -values))[:k]
                out[0].append(np.full(len(order), at + j))
                out[1].append(ids[order])
                out[2].append(values[order])
        return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, zero or empty, all components present and finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


class Centres:
    """Cells of the vectors of one length. Vectors are lifted to equal length, queries stretched to it."""

    def __init__(self, sample: np.ndarray, cells: int, radius: float, seed: int = 7):
        self.radius = radius
        points, rng = self._lifted(sample), np.random.default_rng(seed)
        self.at = points[rng.permutation(len(points))[:cells]]
        for _ in range(ROUNDS if cells > 1 else 0):
            own = self.cell_of_lifted(points)
            size = np.bincount(own, minlength=len(self.at))
            total = np.stack([np.bincount(own, column, len(self.at)) for column in points.T], 1)
            empty = size == 0
            self.at = np.where(empty[:, None], points[rng.integers(0, len(points), len(size))], total / np.maximum(size, 1)[:, None]).astype(np.float32)

    def _lifted(self, vectors: np.ndarray) -> np.ndarray:
        norms = np.einsum("nd,nd->n", vectors, vectors, dtype=np.float64)
        return np.hstack([vectors, np.sqrt(np.maximum(self.radius**2 - norms, 0))[:, None]]).astype(np.float32)

    def _said(self, lifted: np.ndarray) -> np.ndarray:
        return lifted @ self.at.T - (self.at * self.at).sum(1) / 2

    def cell_of_lifted(self, lifted: np.ndarray) -> np.ndarray:
        return np.concatenate([self._said(lifted[k : k + 1024]).argmax(1) for k in range(0, len(lifted), 1024)])

    def cell_of(self, vectors: np.ndarray) -> np.ndarray:
        return self.cell_of_lifted(self._lifted(vectors))

    def nearest_cells(self, queries: np.ndarray) -> np.ndarray:
        """All cells for each query, most promising first."""
        norms = np.sqrt(np.einsum("nd,nd->n", queries, queries, dtype=np.float64))[:, None]
        stretched = np.hstack([queries * (self.radius / norms), np.zeros((len(queries), 1))]).astype(np.float32)
        return np.argsort(-self._said(stretched), axis=1, kind="stable")


def _stacked(vectors: pd.Series, kind: type) -> np.ndarray:
    return np.stack(vectors.tolist()).astype(kind)


def _read(row, kind: type) -> Graph:
    dim = int(row.dim)
    flat, at, links = np.frombuffer(row.links, "<i4"), 0, []
    for level, size in enumerate(row.layers):
        width = LINKS if level else 2 * LINKS
        links.append(flat[at : at + size * width].reshape(-1, width))
        at += size * width
    members = np.split(np.frombuffer(row.members, "<i8").reshape(-1, 2), np.cumsum(np.frombuffer(row.member_sizes, "<i4"))[:-1])
    return Graph(np.frombuffer(row.vectors, kind).reshape(-1, dim), links, members, np.frombuffer(row.nids, "<i8"))


def _exact(nodes: DataFrame, asked: DataFrame, k: int, kind: type) -> DataFrame:
    """rid, nid, score of the ``k + 1`` nearest nodes of each row of ``asked``, which is small enough for one block, by one scan."""
    rows = asked.select("rid", "dim", "vector").collect()
    by_dim = {}
    for r in rows:
        by_dim.setdefault(r.dim, []).append(r)
    blocks = asked.sparkSession.sparkContext.broadcast({d: (np.array([r.rid for r in own]), np.array([r.vector for r in own], kind).astype(np.float64)) for d, own in by_dim.items()})

    def scan(batches):
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                if dim not in blocks.value:
                    continue
                rids, queries = blocks.value[dim]
                nids, n = part["nid"].to_numpy(), min(k + 1, len(part))
                said = queries @ _stacked(part["vector"], kind).astype(np.float64).T
                top = np.argpartition(-said, n - 1, axis=1)[:, :n]
                yield pd.DataFrame({"rid": np.repeat(rids, n), "nid": nids[top].ravel(), "score": np.take_along_axis(said, top, 1).ravel()})

    found = nodes.select("nid", "dim", "vector").mapInPandas(scan, "rid long, nid long, score double")
    best = Window.partitionBy("rid").orderBy(F.desc("score"), "nid")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")


#: Bytes of vectors (as doubles) in a block of nodes that meets a block of queries.
NODE_BYTES = 32 << 20


def _exact_neighbours(nodes: DataFrame, asked: DataFrame, queries: int, k: int, kind: type) -> DataFrame:
    """rid, query_id, vec_id, score of what may be among the ``k`` nearest of each asked row, over all nodes.

    Blocks of queries meet blocks of nodes, all in one job; of each meeting a query's ``k`` best go
    on, ties to the smaller id, so the best of all are among them.
    """
    sizes = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", F.ceil(F.col("n") * F.col("dim") * 8 / NODE_BYTES).cast("int").alias("node_blocks"))
    sizes = cut(sizes)  # a row for each length of vectors
    few = F.broadcast(sizes) if sizes.count() <= BROADCAST_KEYS else sizes
    parts = partitions_for(queries, QUERY_BLOCK)
    left = asked.join(few, "dim").select("rid", "vec_id", "dim", "vector", F.pmod(F.xxhash64("rid", F.lit(2)), F.lit(parts)).alias("block"), F.explode(F.sequence(F.lit(0), F.col("node_blocks") - 1)).alias("node_block"))
    right = nodes.join(few, "dim").select("nid", "dim", "vector", "members", F.pmod(F.xxhash64("nid"), F.col("node_blocks")).cast("int").alias("node_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("block"))

    def meet(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or held.empty:
            return pd.DataFrame({"rid": [], "query_id": [], "vec_id": [], "score": []})
        said = _stacked(asking["vector"], kind).astype(np.float64) @ _stacked(held["vector"], kind).astype(np.float64).T
        n = min(k + 1, said.shape[1])  # a row may be the nearest to itself
        least = -np.partition(-said, n - 1, axis=1)[:, n - 1]
        place, node = np.nonzero(said >= least[:, None])
        sizes = held["members"].map(len).to_numpy()
        pairs = np.array([(m["vec_id"], m["rid"]) for ms in held["members"] for m in ms], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        each = sizes[node]
        at = np.repeat(starts[node] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
        place, score = np.repeat(place, each), np.repeat(said[place, node], each)
        rids = asking["rid"].to_numpy()
        other = pairs[at, 1] != rids[place]
        place, score, ids = place[other], score[other], pairs[at[other], 0]
        order = np.lexsort((ids, -score, place))
        place, score, ids = place[order], score[order], ids[order]
        first = np.searchsorted(place, place)
        best = np.arange(len(place)) - first < k
        return pd.DataFrame({"rid": rids[place[best]], "query_id": asking["vec_id"].to_numpy()[place[best]], "vec_id": ids[best], "score": score[best]})

    keys = ["dim", "block", "node_block"]
    left, right = (side.toDF(*(f"{c} " for c in side.columns)).toDF(*side.columns) for side in (left, right))  # both come from the same rows
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "rid long, query_id long, vec_id long, score double")


def nearest_neighbours(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", *, exact: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest rows found of each query row; with ``exact``, by scans without a graph.

    Unusable vectors take no part, on either side; vectors of different lengths don't meet; equal
    scores rank by the smaller id; rows of equal id are rows of their own. With fewer candidates
    than ``k`` all are returned. No queries or an empty table give no rows. Other columns are
    ignored, whatever their names.
    """
    spark = df.sparkSession
    kind = np.float64 if "double" in dict(df.dtypes)[vector_col] else np.float32
    rows = df.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), is_query.alias("asks"))
    rows = cut(rows.withColumns({"rid": F.monotonically_increasing_id(), "dim": F.size("vector")}))
    # the smallest ids of equal vectors are all that a search may need; each task drops the others before the shuffle
    smallest = Window.partitionBy("vector").orderBy("vec_id", "rid")
    members = rows.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    nodes = members.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("vec_id", "rid"))).alias("members"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("nid"), F.size("vector").alias("dim"), "vector", "members"))
    asked = rows.where("asks")
    queries = asked.count()
    best = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if exact or not queries:
        return ranked(_exact_neighbours(nodes, asked, max(1, queries), k, kind))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    large = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("radius")).where(F.col("n") > SHARD).collect()  # few: each has over SHARD nodes
    centres = {}
    for r in large:
        cells = min(MOST_CENTRES, partitions_for(r.n, SHARD))
        sample = nodes.where(F.col("dim") == r.dim).orderBy(F.xxhash64("nid"), "nid").limit(min(CENTRE_SAMPLE, 256 * cells)).select("vector").toPandas()
        centres[r.dim] = Centres(_stacked(sample["vector"], np.float32), cells, r.radius)
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def cell_of(vectors: pd.Series, dims: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), np.int32)
        for dim, own in dims.groupby(dims).groups.items():
            if dim in shared.value:
                out[vectors.index.get_indexer(own)] = shared.value[dim].cell_of(_stacked(vectors[own], np.float32))
        return pd.Series(out)

    placed = cut(nodes.withColumn("cell", cell_of("vector", "dim"))) if centres else nodes.withColumn("cell", F.lit(0))
    cells = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("parts"))
    cells = cut(cells)  # at most one row for a centre and for each further length
    few = cells.count() <= BROADCAST_KEYS
    dealt = placed.join(F.broadcast(cells) if few else cells, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        own = [np.array([(m["vec_id"], m["rid"]) for m in ms], np.int64) for ms in rows["members"]]
        g = Graph.build(_stacked(rows["vector"], kind), own, rows["nid"].to_numpy(np.int64), int(first["cell"]))
        one = [first["dim"], first["cell"], first["part"], g.vectors.tobytes(), [len(x) for x in g.links], np.concatenate([x.ravel() for x in g.links]).astype("<i4").tobytes(),
               np.concatenate(g.members).astype("<i8").tobytes(), np.array([len(m) for m in g.members], "<i4").tobytes(), g.nids.astype("<i8").tobytes()]
        return pd.DataFrame([one], columns=["dim", "cell", "part", "vectors", "layers", "links", "members", "member_sizes", "nids"])

    graphs = cut(dealt.select("dim", "cell", "part", "nid", "vector", "members").groupBy("dim", "cell", "part").applyInPandas(build, GRAPH))
    setting = _setting(graphs, nodes, asked, centres, k, kind)
    if setting is None:
        return ranked(_exact_neighbours(nodes, asked, queries, k, kind))
    visits, beam = setting

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cells_of(vectors: pd.Series, dims: pd.Series) -> pd.Series:
        out = pd.Series([[0]] * len(vectors), index=vectors.index, dtype=object)
        for dim, own in dims.groupby(dims).groups.items():
            if dim in shared.value:
                found = shared.value[dim].nearest_cells(_stacked(vectors[own], np.float64))[:, :visits].tolist()
                for at, c in zip(own, found, strict=True):
                    out.at[at] = c
        return out

    sent = cut(asked.select("vec_id", "rid", "dim", "vector", F.explode(cells_of("vector", "dim")).alias("cell")))
    busy = sent.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    where = cells.join(busy, ["dim", "cell"])
    sent = sent.join(F.broadcast(where) if few else where, ["dim", "cell"]).withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "block": F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")})
    keys = ["dim", "cell", "part", "block"]

    def search(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if graph.empty or asked.empty:
            return pd.DataFrame({"rid": [], "query_id": [], "vec_id": [], "score": []})
        place, ids, scores = _read(graph.iloc[0], kind).nearest(_stacked(asked["vector"], kind), asked["rid"].to_numpy(np.int64), k, beam)
        place = place.astype(int)
        return pd.DataFrame({"rid": asked["rid"].to_numpy()[place], "query_id": asked["vec_id"].to_numpy()[place], "vec_id": ids, "score": scores})

    copies = graphs.join(busy, ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return ranked(copies.groupBy(*keys).cogroup(sent.select(*keys, "vec_id", "rid", "vector").groupBy(*keys)).applyInPandas(search, "rid long, query_id long, vec_id long, score double"))


def _setting(graphs: DataFrame, nodes: DataFrame, asked: DataFrame, centres: dict[int, Centres], k: int, kind: type) -> tuple[int, int] | None:
    """(cells to visit, beam): the cheapest that finds ``RECALL`` of the exact neighbours of ``TRIAL`` queries, if any does."""
    trial = asked.orderBy(F.xxhash64("rid"), "rid").limit(TRIAL).select("rid", "vec_id", "dim", "vector")
    trial = cut(trial)
    queries = trial.collect()
    by_dim = {}
    for r in queries:
        by_dim.setdefault(r.dim, []).append(r)
    blocks = {d: (np.array([r.rid for r in own]), np.array([r.vector for r in own], kind)) for d, own in by_dim.items()}
    truth = {(r.rid, r.nid) for r in _exact(nodes, trial, k, kind).collect()}

    def tried(batches):
        for batch in batches:
            for row in batch.itertuples():
                if row.dim in blocks:
                    rids, vectors = blocks[row.dim]
                    graph = _read(row, kind)
                    for beam in BEAMS:
                        for rid, found in zip(rids, graph.search(vectors, beam), strict=True):
                            own = [n for n in graph.nids[found[found >= 0]] if (rid, n) in truth]
                            yield pd.DataFrame({"rid": rid, "dim": row.dim, "cell": row.cell, "beam": beam, "hits": len(own)}, index=[0])

    hits = graphs.mapInPandas(tried, "rid long, dim int, cell int, beam int, hits int").where("hits > 0").collect()
    order = {}
    for dim, (rids, vectors) in blocks.items():
        near = centres[dim].nearest_cells(vectors.astype(np.float64)) if dim in centres else np.zeros((len(rids), 1), int)
        for rid, own in zip(rids.tolist(), near, strict=True):
            order[rid] = {int(c): n for n, c in enumerate(own)}
    most = max((len(c.at) for c in centres.values()), default=1)
    options = []
    for beam in BEAMS:
        gained = np.zeros(most, np.int64)
        for h in hits:
            if h.beam == beam:
                gained[order[h.rid][h.cell]] += h.hits
        enough = np.nonzero(np.cumsum(gained) >= RECALL * len(truth))[0]
        if len(enough):
            options.append((int(enough[0] + 1) * beam, int(enough[0]) + 1, beam))
    return min(options)[1:] if options else None


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of largest inner product of every row of ``embeddings`` whose vec_id is divisible by 20; odd rows as in ``nearest_neighbours``."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
