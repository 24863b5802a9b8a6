"""Near-duplicate vectors with hierarchical navigable small-world graphs, one for each shard.

Vectors are compared only under one label. Equal vectors are first folded into one. Each label is split into
shards of about ``SHARD_ROWS`` vectors; each shard gets a graph, and every vector of the label queries
every shard of it. Graphs and blocks of queries meet in tiles of ``TILE`` by ``TILE`` shards, so a label's
graphs are copied once for each column of tiles, not for each block. A query starts where the upper layers lead it, from the nearest of
``ENTRIES`` nodes spread over the shard and, in its own shard, from itself. It widens its beam while the beam is full of vectors in range. After that,
for each graph, ``AUDIT`` queries of every block of the tile and as many that found links are compared with all of the shard; while
the recall of their links (a vector itself is none) is below ``RECALL``, all are queried again with beams twice as wide and ``MORE`` times the
spread nodes: a query that is lost, far from a large group of near copies, needs another start and hardly a wider beam. In its own shard a
link found from one side counts for both. Pairs
from the graphs are verified by cosine in double precision. A task hands on link counts and a spanning forest of its links, never all pairs, and
components are joined from the forests.

Cases: vectors that are null or empty, zero, or hold null, NaN or infinite components, and those with a null label
link with nothing; vectors of different lengths under one label link with nothing but their like; repeated rows
count as separate vectors; with a null vec_id a vector links but never names a component; no rows give
no rows. Input columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import materialise

LEAST = 0.98
SHARD_ROWS = 8192
RECALL = 0.99
AUDIT = 48
DEGREE = 16
BUILD_BEAM = 64
QUERY_BEAM = 64
ENTRIES = 64
MORE = 8
BATCH = 256
TILE = 4
SALTS = 8


def _top(sims, ids, k):
    """The ``k`` best of each row, best first."""
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        sims, ids = np.take_along_axis(sims, part, 1), np.take_along_axis(ids, part, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)


class Graph:
    """Hierarchical navigable small world of unit vectors; all queries of a batch move at once."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray] | None = None, seed: int = 7):
        self.x = x
        n = len(x)
        if links is not None:
            self.links = links
            return
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(int), 4)
        order = np.argsort(-level, kind="stable")  # upper layers first, so that entry points exist
        self.level = level
        self.links = [np.full((n, DEGREE * (2 if i == 0 else 1)), -1, np.int32) for i in range(int(level.max(initial=0)) + 1)]
        self.start = int(order[0]) if n else 0
        self.there = np.zeros(n, bool)
        for at in range(0, n, BATCH):
            self._insert(order[at : at + BATCH])

    @property
    def entry(self) -> int:
        return self.start

    def _insert(self, new):
        q = self.x[new]
        inner = q @ q.T
        np.fill_diagonal(inner, -2)
        near = None
        if self.there.any():
            near = np.full((len(new), 1), self.start)
        for layer in range(len(self.links) - 1, -1, -1):
            mine = np.flatnonzero(self.level[new] >= layer)
            if near is not None:
                sims, ids = self.search(q, near, BUILD_BEAM if len(mine) else 4, layer)
                near = ids[:, : 8 if layer else ids.shape[1]]
            if not len(mine):
                continue
            own_ids = np.broadcast_to(new[mine], (len(mine), len(mine)))
            own = inner[np.ix_(mine, mine)]
            if near is not None:
                s, i = np.concatenate((sims[mine], own), 1), np.concatenate((ids[mine], own_ids), 1)
            else:
                s, i = own, own_ids
            s, i = _top(np.where(i == new[mine][:, None], -2, s), i, BUILD_BEAM)
            width = self.links[layer].shape[1]
            self.links[layer][new[mine]] = self._choose(new[mine], s, i, width)
            self._back(new[mine], layer)
        self.there[new] = True

    def _choose(self, nodes, sims, ids, width):
        """The usual diversity rule: a neighbour stays if no kept one is closer to it than the node; gaps are filled with the nearest."""
        valid = (sims > -1.5) & (ids >= 0)
        v = self.x[np.maximum(ids, 0)]
        between = np.einsum("bid,bjd->bij", v, v)
        kept = np.zeros(valid.shape, bool)
        closest = np.full(valid.shape, -2.0)
        count = np.zeros(len(nodes), int)
        for j in range(ids.shape[1]):
            take = valid[:, j] & (closest[:, j] < sims[:, j]) & (count < width)
            kept[:, j] = take
            count += take
            np.maximum(closest, np.where(take[:, None], between[:, j], -2.0), out=closest)
        rank = np.where(kept, 0, np.where(valid, 1, 2)) * 10_000 + np.arange(ids.shape[1])
        pick = np.argsort(rank, axis=1)[:, :width]
        out = np.where(np.take_along_axis(valid, pick, 1), np.take_along_axis(ids, pick, 1), -1)
        return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)

    def _back(self, new, layer):
        """Adds the reverse links of ``new``."""
        table = self.links[layer]
        to = table[new]
        src = np.repeat(new, to.shape[1])[(to >= 0).ravel()]
        dst = to[to >= 0].ravel()
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        node, at, many = np.unique(dst, return_index=True, return_counts=True)
        width = table.shape[1]
        for begin in range(0, len(node), BATCH):
            part = slice(begin, begin + BATCH)
            nodes, start, count = node[part], at[part], many[part]
            most = int(count.max())
            cells = start[:, None] + np.arange(most)
            coming = np.where(np.arange(most) < count[:, None], src[np.minimum(cells, len(src) - 1)], -1)
            ids = np.concatenate((table[nodes], coming), 1)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.einsum("bd,bkd->bk", self.x[nodes], self.x[np.maximum(ids, 0)])
            sims = np.where((ids < 0) | (ids == nodes[:, None]), -2, sims)
            sims, ids = _top(sims, ids, min(ids.shape[1], BUILD_BEAM))
            table[nodes] = self._choose(nodes, sims, ids, width)

    def search(self, q, near, beam, layer):
        """Similarities and ids of the ``beam`` best found for each query, from entry points ``near``."""
        n, b = len(self.x), len(q)
        table = self.links[layer]
        rows = np.arange(b)[:, None]
        visited = np.zeros((b, n), bool)
        ids = np.sort(near, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        visited[np.broadcast_to(rows, ids.shape)[ids >= 0], ids[ids >= 0]] = True
        sims = np.where(ids < 0, q.dtype.type(-9), np.einsum("bd,bkd->bk", q, self.x[np.maximum(ids, 0)]))
        sims, ids = _top(sims, ids, beam)
        open_ = ids >= 0
        step = max(4, beam // 16)
        active = np.arange(b)
        while len(active):
            s, i, o = sims[active], ids[active], open_[active]
            score = np.where(o, s, -9)
            pick = np.argsort(-score, axis=1)[:, :step]
            fresh = np.take_along_axis(o, pick, 1)
            go = fresh.any(1)
            if not go.all():
                active, s, i, o, pick, fresh = active[go], s[go], i[go], o[go], pick[go], fresh[go]
                if not len(active):
                    break
            np.put_along_axis(o, pick, False, 1)
            ahead = table[np.take_along_axis(i, pick, 1)]
            ahead = np.where(fresh[:, :, None], ahead, -1).reshape(len(active), -1)
            ahead.sort(axis=1)
            ahead[:, 1:][ahead[:, 1:] == ahead[:, :-1]] = -1
            known = visited[active[:, None], np.maximum(ahead, 0)]
            ahead = np.where(known, -1, ahead)
            r, c = np.nonzero(ahead >= 0)
            visited[active[r], ahead[r, c]] = True
            gained = np.full(ahead.shape, -9.0, self.x.dtype)
            gained[r, c] = np.einsum("kd,kd->k", q[active[r]], self.x[ahead[r, c]])
            s, i, o = np.concatenate((s, gained), 1), np.concatenate((i, ahead), 1), np.concatenate((o, ahead >= 0), 1)
            keep = np.argsort(-s, axis=1)[:, :beam]
            s, i, o = (np.take_along_axis(a, keep, 1) for a in (s, i, o))
            if s.shape[1] > sims.shape[1]:
                more = s.shape[1] - sims.shape[1]
                sims, ids, open_ = (np.pad(a, ((0, 0), (0, more)), constant_values=v) for a, v in ((sims, -9), (ids, -1), (open_, False)))
            w = s.shape[1]
            sims[active, :w], ids[active, :w], open_[active, :w] = s, i, o & (s > -8)
        return sims, ids

    def within(self, q, least, beam, entries=ENTRIES, own=None):
        """(query, node) with similarity of at least ``least``; a beam that is full in range is widened.

        ``entries``: so many nodes spread over all, the nearest of which are starts too; ``own``: the node that is the query, or -1.
        """
        found_q, found_v = [], []
        spread = np.unique(np.linspace(0, len(self.x) - 1, min(entries, len(self.x))).astype(int))
        own = np.full(len(q), -1) if own is None else own
        todo, n = np.arange(len(q)), len(self.x)
        while len(todo):
            again = []
            size = max(16, min(BATCH, (1 << 21) // max(1, n), (1 << 16) // beam))
            for at in range(0, len(todo), size):
                part = todo[at : at + size]
                near = np.full((len(part), 1), self.entry)
                for layer in range(len(self.links) - 1, 0, -1):
                    near = self.search(q[part], near, 8, layer)[1]
                    near = np.where(near < 0, self.entry, near)
                nearest = _top(q[part] @ self.x[spread].T, np.broadcast_to(spread, (len(part), len(spread))), 4)[1]
                sims, ids = self.search(q[part], np.concatenate((near, nearest, own[part][:, None]), 1), beam, 0)
                full = (ids.shape[1] >= beam) & (sims[:, -1] >= least) & (beam < n)
                again.append(part[full])
                r, c = np.nonzero((sims >= least) & (ids >= 0) & ~full[:, None])
                found_q.append(part[r])
                found_v.append(ids[r, c])
            todo, beam = np.concatenate(again) if again else todo[:0], beam * 2
        return np.concatenate(found_q) if found_q else np.zeros(0, int), np.concatenate(found_v) if found_v else np.zeros(0, int)


def _blob(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    x = _matrix(pdf["embedding"])
    graph = Graph(_unit(x).astype(np.float32))
    blob = _blob(x=x, rid=pdf["rid"].to_numpy(), weight=pdf["weight"].to_numpy(), start=np.array(graph.start), **{f"links{i}": t for i, t in enumerate(graph.links)})
    return pd.DataFrame({"label": [pdf["label"].iloc[0]], "size": [pdf["size"].iloc[0]], "shards": [pdf["shards"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "graph": [blob]})


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    blob = _blob(x=_matrix(pdf["embedding"]), rid=pdf["rid"].to_numpy())
    return pd.DataFrame({"label": [pdf["label"].iloc[0]], "size": [pdf["size"].iloc[0]], "shards": [pdf["shards"].iloc[0]], "block": [pdf["shard"].iloc[0]], "queries": [blob]})


def _forest(a, b):
    """Of links (a, b), one (node, root) for every node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


_MET = pa.schema([("rid", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("truth", pa.int64()), ("seen", pa.int64())])


def _mirrored(a, v, home, n):
    """Pairs (query, node) and, where both are queries and nodes of one shard of ``n``, the pairs found from the other side only."""
    inside = np.flatnonzero(home >= 0)
    asker = np.full(n, -1)
    asker[home[inside]] = inside
    if not len(inside):
        return a, v
    met = np.zeros((n, n), bool)
    mine = home[a] >= 0
    met[home[a[mine]], v[mine]] = True
    more = [(a, v)]
    for at in range(0, n, 1024):
        r, c = np.nonzero(met[:, at : at + 1024].T & ~met[at : at + 1024])
        r = asker[at + r]
        more.append((r[r >= 0], c[r >= 0]))
    return tuple(np.concatenate(x) for x in zip(*more, strict=True))


class _Blocks:
    """The query blocks of a tile, which meet its graphs one by one."""

    def __init__(self):
        self.x, self.rid = [], []

    def add(self, blob):
        q = np.load(io.BytesIO(blob))
        self.x.append(_unit(q["x"]))
        self.rid.append(q["rid"])

    def meet(self, blob, least: float, recall: float) -> pa.RecordBatch:
        g = np.load(io.BytesIO(blob))
        x, rid, weight = g["x"], g["rid"], g["weight"]
        unit = _unit(x)
        graph = Graph(unit.astype(np.float32), [g[f"links{i}"] for i in range(sum(k.startswith("links") for k in g.files))])
        graph.start = int(g["start"])
        queries, own = np.concatenate(self.x), np.concatenate(self.rid)
        start = np.cumsum([0, *(len(r) for r in self.rid)])
        fixed = np.concatenate([lo + np.linspace(0, hi - lo - 1, min(AUDIT, hi - lo)).astype(int) for lo, hi in zip(start[:-1], start[1:], strict=True)])
        slack, beam, entries, audit = least - 1e-5, QUERY_BEAM, ENTRIES, None
        order = np.argsort(rid)
        place = order[np.minimum(np.searchsorted(rid, own, sorter=order), len(rid) - 1)]
        home = np.where(rid[place] == own, place, -1)
        while True:
            a, v = _mirrored(*graph.within(queries.astype(np.float32), slack, beam, entries, home), home, len(x))
            if audit is None:  # fixed places of every block, and as many queries that found a link
                linked = np.unique(a[own[a] != rid[v]])
                audit = np.union1d(fixed, linked[np.linspace(0, len(linked) - 1, min(len(fixed), len(linked))).astype(int)])
                true = np.concatenate([queries[audit[at : at + 512]] @ unit.T >= least for at in range(0, len(audit), 512)])
                true &= own[audit][:, None] != rid[None, :]  # a vector that meets itself shows nothing
            seen, place = np.zeros(true.shape, bool), np.full(len(queries), -1)
            place[audit] = np.arange(len(audit))
            mine = place[a] >= 0
            seen[place[a[mine]], v[mine]] = True
            truth, got = int(true.sum()), int((seen & true).sum())
            if got >= recall * truth or beam >= len(x):
                break
            beam, entries = beam * 2, entries * MORE
        exact = np.concatenate([np.einsum("kd,kd->k", queries[a[s : s + 65536]], unit[v[s : s + 65536]]) for s in range(0, len(a), 65536)] or [np.zeros(0)])
        ok = (exact >= least) & (own[a] != rid[v])
        a, v = a[ok], v[ok]
        count = np.bincount(a, weight[v], len(own)).astype(np.int64)
        some = np.flatnonzero(count)
        node, root = _forest(own[a], rid[v]) if len(a) else (own[:0], own[:0])
        rows = [np.concatenate(x) for x in zip((own[some], count[some], np.full(len(some), -1)), (node, np.zeros(len(node), np.int64), root), strict=True)]
        none = np.zeros(len(rows[0]), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.append(x, last), pa.int64()) for x, last in zip((*rows, none, none), (-1, 0, -1, truth, got), strict=True)], schema=_MET)


def _search(least: float, recall: float):
    """Rows come tile by tile, in each first the blocks, then the graphs."""

    def run(batches):
        tile, blocks = None, None
        for batch in batches:
            names = [batch.column(c) for c in ("label", "size", "rows", "columns")]
            for i in range(batch.num_rows):
                key = tuple(c[i].as_py() for c in names)
                if key != tile:
                    tile, blocks = key, _Blocks()
                if batch.column("queries")[i].is_valid:
                    blocks.add(batch.column("queries")[i].as_buffer())
                else:
                    yield blocks.meet(batch.column("graph")[i].as_buffer(), least, recall)

    return run


def _same_zero(embedding, kind):
    return F.transform(embedding, lambda v: F.when(v == 0, F.lit(0).cast(kind)).otherwise(v))


def near_duplicates(vectors: DataFrame, least: float = LEAST, recall: float = RECALL, shard_rows: int = SHARD_ROWS, report: dict | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    ``report`` takes the audit: links that brute force finds for the audited queries, and how many of them the graphs found.
    """
    inner = vectors.schema["embedding"].dataType.elementType
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _same_zero("embedding", inner).alias("embedding"), F.col("label").alias("label"))
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    # two hashes stand for a vector in the join back, which so moves ids and no vectors
    keyed = rows.withColumns({"k1": F.xxhash64("label", "embedding"), "k2": F.xxhash64(F.lit(1), "embedding", "label")})
    folded = keyed.filter(good).groupBy("label", "embedding", "k1", "k2").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    folded = materialise(folded.withColumn("size", F.size("embedding")).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    shards = folded.groupBy("label", "size").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("shards"))
    kinds = folded.join(materialise(shards, "shards"), ["label", "size"])
    dealt = materialise(kinds.withColumn("shard", F.pmod(F.xxhash64("rid"), F.col("shards")).cast("long")).select("label", "size", "shards", "shard", "rid", "weight", "embedding"), "dealt")
    # A shard is much work on few bytes: explicit partition counts keep AQE from putting shards together.
    groups = ["label", "size", "shard"]
    number = dealt.select(*groups).distinct().count()
    dealt = dealt.repartition(min(max(4 * number, 8), 100_000), *groups)
    kind = f"label {folded.schema['label'].dataType.simpleString()}, size int, shards long"
    graphs = materialise(dealt.groupBy(*groups).applyInPandas(_build, f"{kind}, shard long, graph binary"), "graphs")
    blocks = materialise(dealt.groupBy(*groups).applyInPandas(_block, f"{kind}, block long, queries binary"), "blocks")
    # Tiles of TILE graphs and as many blocks: each graph and block is copied once for each tile in its row or column of tiles.
    tiles = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("shards") - 1) / TILE)))
    none = F.lit(None).cast("binary")
    asked = blocks.select("label", "size", F.floor(F.col("block") / TILE).alias("columns"), F.lit(0).alias("turn"), "queries", none.alias("graph"), tiles.alias("rows"))
    held = graphs.select("label", "size", tiles.alias("columns"), F.lit(1).alias("turn"), none.alias("queries"), "graph", F.floor(F.col("shard") / TILE).alias("rows"))
    tile = ["label", "size", "rows", "columns"]
    both = asked.unionByName(held)
    many = asked.select(*tile).distinct().count()
    met = both.repartition(min(max(4 * many, 8), 100_000), *tile).sortWithinPartitions(*tile, "turn").mapInArrow(_search(least, recall), "rid long, n long, root long, truth long, seen long")
    met = materialise(met, "met")
    if report is not None:
        audit = met.agg(F.sum("truth").alias("truth"), F.sum("seen").alias("seen")).first()
        report.update(truth=audit.truth or 0, seen=audit.seen or 0, recall=audit.seen / audit.truth if audit.truth else 1.0)
    counts = met.filter("rid >= 0").groupBy("rid").agg(F.sum("n").alias("n"))
    edges = met.filter("root >= 0 and root <> rid").select(F.col("rid").alias("a"), F.col("root").alias("b"))
    roots = components(edges).toDF("rid", "component")
    named = folded.drop("embedding").join(counts, "rid", "left").join(roots, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    named = materialise(named.select("k1", "k2", "weight", "first", F.coalesce("n", F.lit(0)).alias("n"), "component"), "named")
    least_id = named.groupBy("component").agg(F.min("first").alias("component_id"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    named = named.join(least_id, "component").select("k1", "k2", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id", salts)
    salted = keyed.filter(good).select("vec_id", "k1", "k2", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))  # equal vectors are no single task's
    out = salted.join(named, ["k1", "k2", "salt"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op3_vector_dedup": op3_vector_dedup}
ORACLE_SQL = {
    "op3_vector_dedup": """
    WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_sum(list_transform(e, lambda x: x * x)) > 0),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
    c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
    n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
    SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
    FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.x = v.vec_id"""
}
