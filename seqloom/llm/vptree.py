"""Approximate nearest neighbours: vantage-point trees per shard.

Rows are dealt into shards of bounded size; each shard's task builds a vantage-point tree on the chord distance
of unit vectors, which is a metric and orders as the cosine does. A subtree at distances lo..hi from
its vantage point is skipped for a query at distance d when factor * max(d - hi, lo - d) exceeds the query's
k-th best distance so far. Factor 1 is the triangle inequality: the search is exact. Larger factors skip more.

Each shard's tree is built once and written to the shared folder. A search sends the queries to the trees: sorted by shard, a
shard's tree comes first and its queries follow in batches of bounded size, so a task holds one tree and one batch,
however many queries there are. A batch walks the tree together: it first descends to each query's own leaf, which
gives the first bounds, then visits the rest.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import small_batches, stage
from seqloom.llm.vectors import cosine, matrix, usable

SHARD_ROWS, BLOCK_ROWS, LEAF = 16_384, 2048, 64
#: Room for rounding in distances, which are square roots of differences of nearly equal numbers.
ROUNDING = 1e-6


class Tree:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rids: np.ndarray, seed: int = 0):
        self.vectors, self.ids, self.rids = vectors, ids, rids
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(vectors)))

    def dump(self) -> bytes:
        """The tree as it is stored: vectors in their own type, unit vectors are made again."""
        return pickle.dumps((self.vectors, self.ids, self.rids, self.root), protocol=5)

    @staticmethod
    def load(raw: bytes) -> Tree:
        tree = object.__new__(Tree)
        tree.vectors, tree.ids, tree.rids, tree.root = pickle.loads(raw)
        tree.unit = tree.vectors / np.linalg.norm(tree.vectors, axis=1, keepdims=True)
        return tree

    def _from(self, point: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (self.unit[rows] @ self.unit[point]), 0))

    def _build(self, rows: np.ndarray) -> dict:
        """A node: rows of a leaf, or vantage, cut and two (lo, hi, child). Equal distances all go inside."""
        if len(rows) <= LEAF:
            return {"rows": rows}
        tries = self.rng.choice(rows, 5)
        sample = self.rng.choice(rows, min(len(rows), 100), replace=False)
        point = max(tries, key=lambda p: self._from(p, sample).std())
        far = self._from(point, rows)
        cut = np.median(far)
        inside = far <= cut
        if inside.all():
            inside = far < cut
            if not inside.any():  # all at one distance: the tree cannot part them
                return {"rows": rows}
        return {"vantage": point, "cut": cut, "children": [(far[m].min(), far[m].max(), self._build(rows[m])) for m in (inside, ~inside)]}

    def search(self, queries: np.ndarray, query_rids: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k nearest of each query, nearest first, ties to smaller ids; -inf where there are fewer."""
        n = len(queries)
        self.queries, self.query_rids, self.k = queries, query_rids, k
        self.query_unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.seen: dict[int, np.ndarray] = {}
        self._descend(self.root, np.arange(n))
        self._visit(self.root, np.arange(n), factor)
        return self.score, self.id

    def _distance(self, node: dict, active: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (self.query_unit[active] @ self.unit[node["vantage"]]), 0))

    def _descend(self, node: dict, active: np.ndarray) -> None:
        if not len(active):
            return
        if "rows" in node:
            self.seen[id(node)] = active
            return self._leaf(node["rows"], active)
        inside = self._distance(node, active) <= node["cut"]
        self._descend(node["children"][0][2], active[inside])
        self._descend(node["children"][1][2], active[~inside])

    def _visit(self, node: dict, active: np.ndarray, factor: float) -> None:
        if "rows" in node:
            return self._leaf(node["rows"], np.setdiff1d(active, self.seen.get(id(node), [])))
        d = self._distance(node, active)
        for lo, hi, child in node["children"]:
            worst = np.sqrt(np.maximum(2 - 2 * self.score[active, -1], 0))  # infinite while there are fewer than k
            go = factor * np.maximum(d - hi, lo - d) <= worst + ROUNDING
            if go.any():
                self._visit(child, active[go], factor)

    def _leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        for at in range(0, len(rows), 1024):  # a leaf of equal vectors may be large
            part = rows[at : at + 1024]
            if not len(active):
                return
            near = self.query_unit[active] @ self.unit[part].T
            near[self.query_rids[active][:, None] == self.rids[part][None, :]] = -np.inf
            q, r = np.nonzero((near >= self.score[active, -1][:, None] - 1e-9) & (near > -np.inf))
            if len(q):
                self._offer(active[q], part[r])

    def _offer(self, q: np.ndarray, r: np.ndarray) -> None:
        """Put candidate rows r into the lists of queries q (ascending), by their exact scores."""
        q = np.concatenate([np.repeat(np.unique(q), self.k), q])
        own = np.unique(q)
        score = np.concatenate([self.score[own].ravel(), cosine(self.queries[q[len(own) * self.k :]], self.vectors[r])])
        ids = np.concatenate([self.id[own].ravel(), self.ids[r]])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.searchsorted(q, own)
        place = first[:, None] + np.arange(self.k)
        self.score[own], self.id[own] = score[place], ids[place]


def build(rows: DataFrame, shards: int) -> DataFrame:
    """size, shard, tree of stored rows (rid, vec_id, v, size), dealt into shards: one tree of each shard and vector length."""
    dealt = rows.select("size", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard"), "rid", "vec_id", "v")

    def run(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values("rid")
        tree = Tree(matrix(data["v"]), data["vec_id"].to_numpy(), data["rid"].to_numpy(), int(key[1]))
        return pd.DataFrame({"size": [key[0]], "shard": [key[1]], "tree": [tree.dump()]})

    return dealt.groupBy("size", "shard").applyInPandas(run, "size int, shard int, tree binary")


def search_trees(trees: DataFrame, asks: DataFrame, shards: int, k: int, factor: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rid, query_id, vec_id, score of the k nearest rows of every shard to each query (rid, vec_id, v, size)."""
    sent = asks.select("size", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "rid", "vec_id", "v", F.lit(None).cast("binary").alias("tree"))
    first = trees.select("size", "shard", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("rid"), F.lit(0).cast("long").alias("vec_id"), F.lit(None).cast(asks.schema["v"].dataType).alias("v"), "tree")
    small_batches(asks.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, at_home = None, None
        for b in batches:
            homes = b[["size", "shard"]].to_numpy()
            starts = (b["kind"].to_numpy() == 0) | np.append(True, (homes[1:] != homes[:-1]).any(1))[: len(b)]
            cuts = np.flatnonzero(starts)
            for a, z in zip(cuts, [*cuts[1:], len(b)]):
                part = b.iloc[a:z]
                if part["kind"].iloc[0] == 0:
                    tree, at_home, part = Tree.load(part["tree"].iloc[0]), homes[a].tolist(), part.iloc[1:]
                if at_home != homes[a].tolist():  # a shard without rows of this length
                    continue
                for at in range(0, len(part), block_rows):
                    own = part.iloc[at : at + block_rows]
                    score, ids = tree.search(matrix(own["v"]), own["rid"].to_numpy(), k, factor)
                    q, place = np.nonzero(score > -np.inf)
                    yield pd.DataFrame({"rid": own["rid"].to_numpy()[q], "query_id": own["vec_id"].to_numpy()[q], "vec_id": ids[q, place], "score": score[q, place]})

    return first.unionByName(sent).repartition("size", "shard").sortWithinPartitions("size", "shard", "kind", "rid").mapInPandas(run, "rid long, query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: Column, k: int = 5, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k rows with the largest cosine to each row that the condition queries picks.

    A query's own row is no candidate; other rows with its id are. Ties go to smaller ids. Rows whose vector
    is null, empty, zero or holds null or non-finite components take no part, nor do null ids; vectors of
    another length than a query's are no candidates of it. Too few candidates: all of them. An empty table
    gives no rows; other columns are ignored. Recall is 1 at factor 1; see the README for larger factors.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = stage(rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("size", F.size("v")), "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    trees = stage(build(rows, shards), "trees")
    found = search_trees(trees, rows.where("asks").select("rid", "vec_id", "v", "size"), shards, k, factor, block_rows)
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
