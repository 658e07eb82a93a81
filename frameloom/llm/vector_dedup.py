"""Embedding near-dedup over a robust-pruned flat graph.

Equal vectors of a label are one class. Classes are put in the shards of their two nearest centroids, and of
others that are nearly as near, so that two vectors within range share one; large shards are split into parts, and each part builds a graph: vectors are inserted one after the other, a greedy
search from the medoid finds whom to link to, and robust pruning keeps a neighbour only if no kept one is much
closer to it. The adjacency lists of a vector's shards are united. A search then runs from the medoids of a
part, greedily to the nearest vectors and from there on over everything within range; what it finds is verified
in double precision. Each part audits itself against brute force on a few queries and widens its search if
it misses too much.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import connected_components, map_arrow, materialize
from frameloom.sources.shipping import ship

LEAST_COSINE = 0.98
#: Vectors that a centroid is meant for, and that a part holds at most, on average.
SHARD, PART = 800, 1600
#: Bound of the sample that centroids are fitted on, and of all centroids together.
SAMPLE, CENTROIDS = 20_000, 2048
DEGREE, BEAM, SLACK = 20, 32, 1.2
#: Shards of a vector: two, and up to SHARDS if further centroids' cosines are less than MARGIN below the best.
SHARDS, MARGIN = 6, 0.08
#: Queries that a part checks by brute force, and the recall below which it doubles its beam.
AUDITED, LEAST_RECALL, WIDENINGS = 16, 0.98, 3


def unit(values: list | None) -> np.ndarray | None:
    """The vector at length one in double precision; None if it can't link with anything."""
    if values is None or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    if not len(x) or not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


class Graph:
    """Adjacency over unit vectors; distances are one less the cosine."""

    def __init__(self, vectors: np.ndarray, neighbours: list[np.ndarray] | None = None):
        self.vectors = vectors
        self.near: list[np.ndarray] = neighbours if neighbours is not None else [np.empty(0, np.int64) for _ in vectors]
        mean = vectors.mean(0) if len(vectors) else np.empty(0)
        self.medoids = [int(np.argmax(vectors @ mean))] if len(vectors) else []

    def greedy(self, query: np.ndarray, beam: int, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The beam nearest nodes met, and all nodes expanded on the way, both with the nearest first."""
        seen = np.zeros(len(self.vectors), bool)
        pool = np.unique(np.array(starts))
        seen[pool] = True
        far = 1 - self.vectors[pool] @ query
        done = np.zeros(len(pool), bool)
        expanded, at = [], []
        while True:
            todo = np.flatnonzero(~done)
            if not len(todo):
                break
            i = todo[np.argmin(far[todo])]
            done[i] = True
            expanded.append(pool[i])
            at.append(far[i])
            new = self.near[pool[i]]
            new = new[~seen[new]]
            if len(new):
                seen[new] = True
                pool = np.concatenate([pool, new])
                far = np.concatenate([far, 1 - self.vectors[new] @ query])
                done = np.concatenate([done, np.zeros(len(new), bool)])
                if len(pool) > beam:
                    best = np.argpartition(far, beam - 1)[:beam]
                    pool, far, done = pool[best], far[best], done[best]
        return pool[np.argsort(far)], np.array(expanded)[np.argsort(at)]

    def prune(self, node: int, pool: np.ndarray) -> np.ndarray:
        """Robust pruning: the nearest stays, and rules out whatever is SLACK times closer to it than to the node."""
        pool = np.unique(pool[pool != node])
        far = 1 - self.vectors[pool] @ self.vectors[node]
        order = np.argsort(far, kind="stable")
        pool, far = pool[order], far[order]
        between = 1 - self.vectors[pool] @ self.vectors[pool].T
        alive, kept = np.ones(len(pool), bool), []
        for i in range(len(pool)):
            if alive[i]:
                kept.append(pool[i])
                if len(kept) == DEGREE:
                    break
                alive &= SLACK * between[i] > far
        return np.array(kept, np.int64)

    def build(self, beam: int = BEAM) -> Graph:
        n = len(self.vectors)
        rng = np.random.default_rng(n)
        order = rng.permutation(n)
        if n > 1:
            self.near = [np.unique(rng.integers(0, n, 4)) for _ in range(n)]
        for node in order if n > 1 else ():
            _, met = self.greedy(self.vectors[node], beam, self.medoids)
            self.near[node] = self.prune(node, np.concatenate([met, self.near[node]]))
            for other in self.near[node]:
                back = np.union1d(self.near[other], [node])
                self.near[other] = self.prune(other, back) if len(back) > 2 * DEGREE else back
        return self

    def reach_all(self) -> None:
        """Adds a medoid for every part of the graph that the ones before don't lead to."""
        seen = np.zeros(len(self.vectors), bool)
        stack = list(self.medoids)
        while True:
            while stack:
                node = stack.pop()
                if not seen[node]:
                    seen[node] = True
                    stack.extend(x for x in self.near[node] if not seen[x])
            rest = np.flatnonzero(~seen)
            if not len(rest):
                return
            mean = self.vectors[rest].mean(0)
            self.medoids.append(int(rest[np.argmax(self.vectors[rest] @ mean)]))
            stack = [self.medoids[-1]]

    def within(self, query: np.ndarray, least: float, beam: int, own: int | None) -> np.ndarray:
        """Nodes of at least this cosine: the greedy search's, and all that are linked to those through others in range."""
        near, _ = self.greedy(query, beam, self.medoids + ([own] if own is not None else []))
        seen = np.zeros(len(self.vectors), bool)
        front = near[self.vectors[near] @ query >= least]
        seen[near] = True
        hits = [front]
        while len(front):
            step = np.unique(np.concatenate([self.near[x] for x in front]))
            step = step[~seen[step]]
            seen[step] = True
            front = step[self.vectors[step] @ query >= least]
            hits.append(front)
        return np.concatenate(hits)


def centroids(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(k)
    centre = vectors[rng.permutation(len(vectors))[:k]]
    for _ in range(rounds):
        nearest = np.argmax(vectors @ centre.T, axis=1)
        for j in range(len(centre)):
            if (nearest == j).any():
                mean = vectors[nearest == j].sum(0)
                centre[j] = mean / max(np.sqrt(mean @ mean), 1e-12)
    return centre


def _fit_centroids(classes: DataFrame) -> dict[str, np.ndarray]:
    """Centroids of the groups (label and dimensions) with more than SHARD classes, from a bounded sample."""
    large = classes.groupBy("family").count().where(F.col("count") > SHARD)
    total = large.agg(F.sum("count")).first()[0]
    if not total:
        return {}
    large = large.orderBy(F.desc("count"), "family").limit(CENTROIDS // 2)
    share = {r["family"]: r["count"] for r in large.collect()}
    chosen = classes.select("family", "uid").join(F.broadcast(large.select("family")), "family").select("uid").orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE)
    rows = classes.select("family", "vector", "uid").join(F.broadcast(chosen), "uid").orderBy("uid").collect()
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["family"], []).append(np.frombuffer(r["vector"]))
    return {f: centroids(np.stack(v), min(len(v), -(-share[f] // SHARD), max(2, int(CENTROIDS / 2 * share[f] / total)))) for f, v in by.items()}


def _array(table: pa.Table, name: str) -> np.ndarray:
    return np.stack([np.frombuffer(x) for x in table[name].to_pylist()])


def _build(table: pa.Table) -> pa.Table:
    uid = table["uid"].to_numpy()
    graph = Graph(_array(table, "vector")).build()
    return pa.table([table["uid"], pa.array([uid[x] for x in graph.near], pa.list_(pa.int64()))], names=["uid", "near"])


def _search(least: float):
    def run(table: pa.Table) -> pa.Table:
        role = np.array(table["role"].to_pylist())
        nodes, queries = table.filter(pa.array(role != 1)), table.filter(pa.array(role != 0))
        empty = pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.int32())], names=["uid", "value", "kind"])
        if not nodes.num_rows or not queries.num_rows:
            return empty
        shard = table["shard"][0].as_py()
        vectors, uid, size = _array(nodes, "vector"), nodes["uid"].to_numpy(), nodes["n"].to_numpy()
        place = {u: i for i, u in enumerate(uid.tolist())}
        near = [np.array([place[u] for u in x or () if u in place], np.int64) for x in nodes["near"].to_pylist()]
        graph = Graph(vectors, near)
        graph.reach_all()
        asked, names = _array(queries, "vector"), queries["uid"].to_numpy()
        beam = BEAM
        for _ in range(WIDENINGS + 1):
            found = [graph.within(q, least, beam, place.get(u)) for q, u in zip(asked, names.tolist(), strict=True)]
            most = np.argsort([-len(f) for f in found], kind="stable")[: AUDITED // 2]
            audit = np.union1d(most, np.linspace(0, len(asked) - 1, min(AUDITED // 2, len(asked))).astype(int))
            alone = np.array([int(names[i]) in place for i in audit])
            there = sum(int((vectors @ asked[i] >= least).sum()) for i in audit) - alone.sum()
            if sum(len(found[i]) for i in audit) - alone.sum() >= LEAST_RECALL * there:
                break
            beam *= 2
        shards_of = [set(x) for x in nodes["shards"].to_pylist()]
        links, parent = np.zeros(len(names), np.int64), {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        mine = queries["shards"].to_pylist()
        for i, (u, hits) in enumerate(zip(names.tolist(), found, strict=True)):
            own = set(mine[i])
            for h in hits.tolist():
                v = int(uid[h])
                if v != u:
                    # A pair that shares both shards is found in both, and counted in the first.
                    links[i] += size[h] if min(own & shards_of[h]) == shard else 0
                    a, b = root(u), root(v)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in list(parent) if root(x) != x]
        return pa.table([
            pa.array(np.concatenate([names, np.array([a for a, _ in pairs], np.int64)])),
            pa.array(np.concatenate([links, np.array([b for _, b in pairs], np.int64)])),
            pa.array(np.concatenate([np.zeros(len(names), np.int32), np.ones(len(pairs), np.int32)]))], names=["uid", "value", "kind"])

    return run


def link_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST_COSINE) -> DataFrame:
    """<id_col>, n_links, component_id, kept for every row.

    Vectors link when their labels are equal and not null and their cosine is at least the given one, in double
    precision. Null, empty and zero vectors, and those with null or non-finite components, link with nothing, as
    do vectors of different dimensions. Rows that repeat a vector link with each other; ids may repeat, a null id
    is never a component's smallest unless no id is known. An empty table gives no rows; other columns are ignored.
    Links are searched for on a graph, so a few may be missed (the tests and the README have the recall); none
    is reported below the cosine.
    """
    spark = table.sparkSession
    ship(spark)

    def clean(batches):
        for batch in batches:
            vectors = [unit(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([None if v is None else v.tobytes() for v in vectors], pa.binary()),
                 pa.array([None if v is None else len(v) for v in vectors], pa.int32())], names=["id", "label", "vector", "dim"])

    source = table.select(table[id_col].cast("bigint"), table[vector_col].cast("array<double>"), table[label_col].cast("string"))
    rows = map_arrow(source, clean, "id bigint, label string, vector binary, dim int")
    family = F.when(F.col("label").isNotNull() & F.col("vector").isNotNull(), F.concat_ws("|", "label", "dim"))
    rows = materialize(rows.withColumn("family", family).withColumn("place", F.sha2(F.concat(F.encode("family", "UTF-8"), "vector"), 256)), "vector-rows")
    classes = rows.where("family IS NOT NULL").groupBy("place").agg(
        F.first("family").alias("family"), F.first("vector").alias("vector"), F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("uid", F.monotonically_increasing_id()), "vector-classes")
    fitted = _fit_centroids(classes)

    def deal(batches):
        for batch in batches:
            out = []
            for f, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                centre = fitted.get(f)
                nearest = [0]
                if centre is not None:
                    cosine = centre @ np.frombuffer(v)
                    nearest = np.argsort(-cosine, kind="stable")[:SHARDS]
                    nearest = [int(c) for i, c in enumerate(nearest) if i < 2 or cosine[c] >= cosine[nearest[0]] - MARGIN]
                out.append([f"{f}|{c}" for c in nearest])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], names=["family", "vector", "uid", "n", "shards"])

    dealt = map_arrow(classes.select("family", "vector", "uid", "n"), deal, "family string, vector binary, uid bigint, n bigint, shards array<string>")
    placed = dealt.withColumn("shard", F.explode("shards")).drop("family")
    counts = placed.groupBy("shard").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    placed = placed.join(counts, "shard").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    placed = materialize(placed, "vector-shards")

    near = placed.select("shard", "part", "uid", "vector").groupBy("shard", "part").applyInArrow(_build, "uid bigint, near array<bigint>")
    # Lists of a vector's shards are united, in both directions: a vector that pruning left without links to it stays in reach.
    edges = near.select("uid", F.explode("near").alias("other")).where("uid <> other")
    near = edges.union(edges.select("other", "uid")).groupBy("uid").agg(F.collect_set("other").alias("near"))
    whole = materialize(placed.join(near, "uid", "left"), "vector-graph")
    single = whole.where("parts = 1").withColumns({"i": F.lit(0), "j": F.lit(0), "role": F.lit(2)})
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    split = whole.where("parts > 1")
    nodes = split.withColumn("i", every).withColumns({"j": F.col("part"), "role": F.lit(0)})
    queries = split.withColumn("j", every).withColumns({"i": F.col("part"), "role": F.lit(1)})
    blocks = single.unionByName(nodes).unionByName(queries).select("shard", "i", "j", "role", "uid", "n", "shards", "vector", "near")
    found = materialize(blocks.groupBy("shard", "i", "j").applyInArrow(_search(least), "uid bigint, value bigint, kind int"), "vector-links")

    links = found.where("kind = 0").groupBy("uid").agg(F.sum("value").alias("links"))
    roots = connected_components(found.where("kind = 1").select(F.col("uid").alias("a"), F.col("value").alias("b")))
    joined = classes.select("uid", "place", "rep", "n").join(links, "uid", "left").join(roots, classes["uid"] == roots["node"], "left")
    joined = joined.withColumn("root", F.coalesce("root", "uid")).select("place", "rep", "n", "links", "root")
    least_id = joined.groupBy("root").agg(F.min("rep").alias("component"))
    of_place = joined.join(least_id, "root").select("place", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return rows.select("id", "place").join(of_place, "place", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("place").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
