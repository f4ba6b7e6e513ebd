"""Hard-negative mining with cover trees over norm-augmented candidates.

A row's score is its integer inner product with the anchor (components are
floor(256 * x)). Every candidate x gets one more coordinate, sqrt(M^2 - |x|^2)
with M the largest norm of its tree, and every query 0 there: then
|q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>, so a distance bounds a score. A cover
tree is built on these points: each node holds a center (a point) and the
largest distance of its points from it; children cover a node at half its
radius. A node's radius bounds the scores of all its points. The search goes
best-first by the upper bound, skips nodes whose bounds fall outside the
query's window of scores, stops once the best remaining bound cannot beat the
k-th result, and verifies leaves exactly with integers.

At scale the candidates are dealt into shards of ``SHARD_ROWS`` rows by a hash of
their row, and the queries into blocks of ``QUERY_ROWS``; every (shard, block)
pair meets once in a task, which builds the trees of its shard and answers its
queries. The best of every shard are then merged per query, so no task holds
more than one shard and one block, whatever the labels or keys.

Rules of the contract: rows with a null label, a null vector or a null or
non-finite component take no part; where the key is divisible by 7 the label
first becomes (label + 1) % 10; anchors are rows whose key is divisible by 100.
An anchor's positives are its first ``K`` other rows of the same label (higher
score first, ties by smaller key); for each positive, its negatives are the
first ``K`` rows of another label with 80 * positive <= 100 * negative <= 100 *
positive.

Defined results: "other rows" excludes the anchor's own row only, so a repeated
row of the anchor can be its positive; repeated rows are candidates each, and
rows of equal score and key are ordered by their row; null keys sort last and are
never anchors; vectors of different lengths count missing components as zero; an
empty table, or one without anchors, gives no rows. Only the named columns are
read.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .codebooks import as_integers, finite_vector

K = 5
ANCHOR_EVERY = 100
RELABEL_EVERY = 7
#: Window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 80, 100
#: Candidates of a shard, and queries of a block, at most on average.
SHARD_ROWS = 20_000
QUERY_ROWS = 4_000
#: Queries that descend a tree together; what a level holds grows with them.
QUERY_CHUNK = 64
#: Points of a leaf, and children of a node, at most.
LEAF = 48
FAN = 8


@dataclass
class Node:
    center: int
    radius: float
    points: np.ndarray | None = None
    children: list = field(default_factory=list)


class CoverTree:
    """A cover tree of integer vectors, on their norm-augmented form."""

    def __init__(self, vectors: np.ndarray, keys: np.ndarray, rows: np.ndarray):
        self.x = vectors.astype(np.int64)
        self.keys, self.rows = keys, rows
        # Keys as numbers for sorting: null last.
        self.order = np.array([np.inf if k is None else float(k) for k in keys], np.float64)
        norms = (self.x.astype(np.float64) ** 2).sum(1)
        self.top = float(norms.max()) if len(norms) else 0.0
        self.aug = np.hstack([self.x.astype(np.float64), np.sqrt(np.maximum(self.top - norms, 0))[:, None]])
        self.root = self._build(np.arange(len(self.x)), 0) if len(self.x) else None

    def _build(self, idx: np.ndarray, center_at: int) -> Node:
        center = idx[center_at]
        dist = np.sqrt(((self.aug[idx] - self.aug[center]) ** 2).sum(1))
        node = Node(int(center), float(dist.max()))
        if len(idx) <= LEAF or node.radius == 0:
            node.points = idx
            return node
        # Children centers, farthest first, until all points are within half the radius.
        chosen, near, owner = [center_at], dist.copy(), np.zeros(len(idx), np.int64)
        while len(chosen) < FAN and near.max() > node.radius / 2:
            pick = int(near.argmax())
            d = np.sqrt(((self.aug[idx] - self.aug[idx[pick]]) ** 2).sum(1))
            closer = d < near
            owner[closer], near[closer] = len(chosen), d[closer]
            chosen.append(pick)
        for number, at in enumerate(chosen):
            members = np.flatnonzero(owner == number)
            node.children.append(self._build(idx[members], int(np.flatnonzero(members == at)[0])))
        return node

    def _flat(self) -> None:
        """Nodes as arrays, for a descent of many queries at once."""
        nodes, at = [self.root], 0
        while at < len(nodes):
            nodes += nodes[at].children
            at += 1
        ids = {id(n): i for i, n in enumerate(nodes)}
        self.center = np.array([n.center for n in nodes], np.int64)
        self.radius = np.array([n.radius for n in nodes], np.float64)
        self.children = [np.array([ids[id(c)] for c in n.children], np.int64) for n in nodes]
        self.points = [n.points for n in nodes]
        self.xf = self.x.astype(np.float64)

    def search_many(self, queries: np.ndarray, k: int, low: np.ndarray, high: np.ndarray,
                    skip: np.ndarray, labels: np.ndarray | None = None, query_labels: np.ndarray | None = None):
        """For every query, the first ``k`` (score, key, row) with low <= score <= high, rows of
        another label than the query's if ``labels`` are given, never the row ``skip``.

        All queries descend level by level together. A node's bounds follow from the
        exact score of its center and its radius; nodes outside a query's window are
        skipped, and so are nodes whose upper bound is below the k-th best score already
        verified (of centers, which are points, and of leaves). Leaves are verified exactly."""
        if len(queries) > QUERY_CHUNK:
            out = []
            for at in range(0, len(queries), QUERY_CHUNK):
                part = slice(at, at + QUERY_CHUNK)
                out += self.search_many(
                    queries[part], k, low[part], high[part], skip[part], labels,
                    None if query_labels is None else query_labels[part],
                )
            return out
        m = len(queries)
        out: list[list] = [[] for _ in range(m)]
        if self.root is None or k <= 0 or m == 0:
            return out
        if not hasattr(self, "center"):
            self._flat()
        qf = queries.astype(np.float64)
        base = (qf * qf).sum(1) + self.top
        slack = 1e-9 * base + 1.0
        best = np.full(m, -np.inf)
        aq, an = np.arange(m), np.zeros(m, np.int64)
        found_q, found_s, found_p = [], [], []

        def allowed(qs, pts):
            ok = self.rows[pts][None, :] != skip[qs][:, None]
            if labels is not None:
                ok &= labels[pts][None, :] != query_labels[qs][:, None]
            return ok

        def kth(qs, scores):
            order = np.lexsort((-scores, qs))
            qs, scores = qs[order], scores[order]
            first = np.searchsorted(qs, np.arange(m))
            count = np.bincount(qs, minlength=m)
            out = np.full(m, -np.inf)
            has = count >= k
            out[has] = scores[first[has] + k - 1]
            return out

        while len(aq):
            c = self.center[an]
            # One product of the queries with the level's distinct centers, read per pair.
            distinct, at = np.unique(c, return_inverse=True)
            sc = (qf @ self.xf[distinct].T)[aq, at]
            d = np.sqrt(np.maximum(base[aq] - 2 * sc, 0))
            r = self.radius[an]
            upper = (base[aq] - np.maximum(d - r, 0) ** 2) / 2 + slack[aq]
            lower = (base[aq] - (d + r) ** 2) / 2 - slack[aq]
            good = (sc >= low[aq]) & (sc <= high[aq]) & (self.rows[c] != skip[aq])
            if labels is not None:
                good &= labels[c] != query_labels[aq]
            # Centers of one level are distinct points: k of them at a score make it a floor.
            best = np.maximum(best, kth(aq[good], sc[good]))
            keep = (upper >= low[aq]) & (lower <= high[aq]) & (upper >= best[aq])
            aq, an = aq[keep], an[keep]
            leaf = np.array([self.points[n] is not None for n in an], bool)
            lq, ln = aq[leaf], an[leaf]
            order = np.argsort(ln, kind="stable")
            lq, ln = lq[order], ln[order]
            bounds = np.flatnonzero(np.diff(ln)) + 1
            level_q, level_s = [], []
            for qs, nodes in zip(np.split(lq, bounds), np.split(ln, bounds)):
                if not len(qs):
                    continue
                pts = self.points[nodes[0]]
                scores = np.rint(qf[qs] @ self.xf[pts].T)
                ok = allowed(qs, pts) & (scores >= low[qs][:, None]) & (scores <= high[qs][:, None])
                masked = np.where(ok, scores, -np.inf)
                floor = np.partition(masked, -k, axis=1)[:, -k] if masked.shape[1] >= k else np.full(len(qs), -np.inf)
                take = ok & (masked >= np.maximum(floor, best[qs])[:, None])
                i, j = np.nonzero(take)
                found_q.append(qs[i]); found_s.append(scores[i, j]); found_p.append(pts[j])
                level_q.append(qs[i]); level_s.append(scores[i, j])
            if level_q:
                best = np.maximum(best, kth(np.concatenate(level_q), np.concatenate(level_s)))
            inner = ~leaf
            iq, inn = aq[inner], an[inner]
            kids = [self.children[n] for n in inn]
            sizes = np.array([len(x) for x in kids], np.int64)
            aq = np.repeat(iq, sizes)
            an = np.concatenate(kids) if kids else np.zeros(0, np.int64)
        if not found_q:
            return out
        q, sc, p = np.concatenate(found_q), np.concatenate(found_s), np.concatenate(found_p)
        order = np.lexsort((self.rows[p], self.order[p], -sc, q))
        q, sc, p = q[order], sc[order], p[order]
        first = np.searchsorted(q, np.arange(m))
        for i in range(m):
            stop = first[i + 1] if i + 1 < m else len(q)
            for at in range(first[i], min(first[i] + k, stop)):
                out[i].append((int(sc[at]), self.keys[p[at]], int(self.rows[p[at]])))
        return out

    def search(self, query: np.ndarray, k: int, low: float, high: float, skip_row: int = -1, mask=None) -> list:
        """The first ``k`` (score, key, row) of one query; see :meth:`search_many`."""
        labels = None if mask is None else (~mask).astype(np.int64)
        return self.search_many(
            query[None, :], k, np.array([low], float), np.array([high], float), np.array([skip_row]),
            labels, None if mask is None else np.array([1]),
        )[0]


def _key_order(key) -> tuple:
    # Greater is better: smaller keys first, null keys last.
    return (0, 0) if key is None or (isinstance(key, float) and math.isnan(key)) else (1, -int(key))


def _padded(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def prepared(embeddings: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(_row, _key, _label, ints) of the rows that take part, labels moved where the key says."""
    rows = embeddings.select(
        F.col(key).cast("long").alias("_key"), F.col(label).cast("long").alias("_label"), F.col(vector).alias("_vec")
    ).where(F.col("_label").isNotNull() & finite_vector(F.col("_vec")))
    moved = F.when(F.col("_key") % RELABEL_EVERY == 0, (F.col("_label") + 1) % 10).otherwise(F.col("_label"))
    return rows.select(
        F.monotonically_increasing_id().alias("_row"), "_key", moved.alias("_label"), as_integers(F.col("_vec")).alias("ints")
    )


def _meet(candidates: DataFrame, queries: DataFrame, shards: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Candidates dealt to shards and copied to every query block; queries to blocks, copied to every shard."""
    shard = F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("q_row", "p_row"), F.lit(blocks)).cast("int")
    c = candidates.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = queries.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return c, q


FOUND = "q_row long, p_row long, p_key long, p_score long, n_key long, n_row long, score long"


def _answer(shard_rows: pd.DataFrame, queries: pd.DataFrame, same_label: bool) -> pd.DataFrame:
    """Per query, the first K of this shard: of its label (positives) or of the others in the window."""
    if shard_rows.empty or queries.empty:
        return pd.DataFrame(columns=FOUND.replace(" long", "").split(", "))
    width = max(max(map(len, shard_rows["ints"])), max(map(len, queries["q_ints"])))
    x = _padded(shard_rows["ints"], width)
    keys = np.array([None if pd.isna(v) else int(v) for v in shard_rows["_key"]], dtype=object)
    rows = shard_rows["_row"].to_numpy(np.int64)
    labels = shard_rows["_label"].to_numpy(np.int64)
    out = []
    if same_label:
        trees = {lab: CoverTree(x[labels == lab], keys[labels == lab], rows[labels == lab]) for lab in np.unique(labels)}
    else:
        tree = CoverTree(x, keys, rows)
    vecs = _padded(queries["q_ints"], width)
    q_rows = queries["q_row"].to_numpy(np.int64)
    q_labels = queries["q_label"].to_numpy(np.int64)
    if same_label:
        for lab, tree in trees.items():
            at = np.flatnonzero(q_labels == lab)
            found = tree.search_many(vecs[at], K, np.full(len(at), -np.inf), np.full(len(at), np.inf), q_rows[at])
            for i, hits in zip(at, found):
                out += [(q_rows[i], -1, None, None, key, row, s) for s, key, row in hits]
    else:
        p_scores = queries["p_score"].to_numpy(np.int64)
        at = np.flatnonzero(p_scores >= 0)
        # The least integer score with HIGH * score >= LOW * positive.
        low = -((-LOW * p_scores[at]) // HIGH)
        found = tree.search_many(vecs[at], K, low.astype(float), p_scores[at].astype(float), np.full(len(at), -1),
                                 labels, q_labels[at])
        p_rows, p_keys = queries["p_row"].to_numpy(np.int64), queries["p_key"].to_numpy()
        for i, hits in zip(at, found):
            out += [(q_rows[i], p_rows[i], int(p_keys[i]) if not pd.isna(p_keys[i]) else None, int(p_scores[i]), key, row, s)
                    for s, key, row in hits]
    return pd.DataFrame(out, columns=FOUND.replace(" long", "").split(", "))


def _first(found: DataFrame, by: list[str]) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("n_key"), "n_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K)


def mine(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = cut(prepared(embeddings, key, vector, label), "mining-rows")
    total = rows.count()
    anchors = rows.where(F.col("_key") % ANCHOR_EVERY == 0).select(
        F.col("_row").alias("q_row"), F.col("_key").alias("q_key"), F.col("_label").alias("q_label"),
        F.col("ints").alias("q_ints"), F.lit(-1).cast("long").alias("p_row"), F.lit(None).cast("long").alias("p_key"),
        F.lit(None).cast("long").alias("p_score"),
    )
    n_anchors = anchors.count()
    out_schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not total or not n_anchors:
        return embeddings.sparkSession.createDataFrame([], out_schema)
    shards = max(1, math.ceil(total / SHARD_ROWS))

    def run(queries: DataFrame, n_queries: int, same_label: bool) -> DataFrame:
        blocks = max(1, math.ceil(n_queries / QUERY_ROWS))
        c, q = _meet(rows, queries, shards, blocks)
        return (
            c.groupBy("shard", "block")
            .cogroup(q.groupBy("shard", "block"))
            .applyInPandas(lambda a, b: _answer(a, b, same_label), FOUND)
        )

    positives = cut(_first(run(anchors, n_anchors, True), ["q_row"]), "positives")
    pairs = positives.join(anchors.drop("p_row", "p_key", "p_score"), "q_row").select(
        "q_row", "q_key", "q_label", "q_ints", F.col("n_row").alias("p_row"), F.col("n_key").alias("p_key"),
        F.col("score").alias("p_score"),
    )
    negatives = _first(run(pairs, positives.count(), False), ["q_row", "p_row"])
    keyed = negatives.join(anchors.select("q_row", "q_key"), "q_row")
    return keyed.select(
        F.col("q_key").alias("anchor_id"), F.col("p_key").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("n_key").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
