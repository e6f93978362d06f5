"""Exact top-k inner product search by best-first search in M-trees.

Inner products become a metric by one more coordinate: with M the largest
norm, x gets sqrt(M^2 - |x|^2) and a query gets 0, so d(q, x)^2 =
|q|^2 + M^2 - 2 q.x and the nearest vector is the one of highest score.

The index has two parts. Pivots from a bounded sample are the root's entries; every
distinct vector goes to the cell of its nearest pivot, and a cell above
``CELL`` vectors is dealt over several trees. Within a task a
cell's tree has pages of at most ``PAGE`` entries, each with its
covering radius and its distance to the parent's routing vector. A search goes to pages in the order of
their least possible distances; from the stored distance to the
parent, the triangle inequality rules out entries before any distance to them is
computed. The queries of a task go best-first side by side, so that those that meet in a page are scored together. Round one searches each query's own cell; round two only the
cells whose ball reaches within the query's k-th distance so far.

Copies of a vector are one entry with its k + 1 smallest ids, which is all
that any query can return. A tree with more queries than ``BLOCK`` (or a quarter of its
vectors) is built for each batch of so many, and a tree without queries not at all, so the copies
of the index are at most its size plus four rows a routed query.

Defined cases: vectors that are null or hold null or non-finite components take
no part; shorter vectors are padded with zeros; ties go to the smaller id;
rows that repeat a vec_id are one candidate if their vectors are equal; no query or no
candidate gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, written

K = 20
SCALE = 64
QUERY_EVERY = 20
#: Vectors of a cell that are aimed at, cells, entries of a page, children of a page, queries of a batch, and vectors of a tree at most, about.
CELL, MAX_CELLS, PAGE, FAN, BLOCK, TREE = 4096, 1024, 256, 16, 1024, 1 << 16
#: Vectors in the sample from which pivots are taken.
SAMPLE = 8192
#: Slack for rounding in distances of doubles; leaves are scored in exact integers.
SLACK = 1e-7
NONE = np.iinfo(np.int64).min


class MTree:
    """A tree over integer vectors, built in bulk."""

    def __init__(self, vecs: np.ndarray, ids: list[np.ndarray], top2: float) -> None:
        # in the order of their smallest ids, so that a place in the tree breaks ties
        order = np.argsort([x[0] for x in ids], kind="stable")
        self.vecs, self.top2 = vecs[order], top2
        self.n_ids = np.array([len(ids[j]) for j in order], np.int64)
        self.all_ids = np.concatenate([ids[j] for j in order])
        self.first_id = np.cumsum(self.n_ids) - self.n_ids
        self.flat = self.vecs.astype(np.float64)
        norms = (self.flat**2).sum(1)
        self.longest = math.sqrt(float(norms.max(initial=0)))
        self.aug = np.c_[self.flat, np.sqrt(np.maximum(top2 - norms, 0))]
        self.computed = 0
        self.root = self._node(np.arange(len(vecs)), 0)

    def _dist(self, a: np.ndarray, p: int) -> np.ndarray:
        return np.sqrt(((self.aug[a] - self.aug[p]) ** 2).sum(1))

    def _node(self, at: np.ndarray, pivot: int) -> dict:
        """A page: pivot, radius, and either entries with their distances to the pivot or children with theirs."""
        to = self._dist(at, pivot)
        node = {"pivot": pivot, "radius": float(to.max(initial=0))}
        if len(at) <= PAGE:
            order = np.argsort(to)
            return node | {"entries": at[order], "to": to[order]}
        fan = min(FAN, -(-len(at) // PAGE))
        # routing vectors far from each other, of a spread of the entries
        some = at[np.linspace(0, len(at) - 1, min(len(at), 64 * FAN)).astype(int)]
        picks, apart = [int(some[0])], self._dist(some, int(some[0]))
        while len(picks) < max(2, fan):
            picks.append(int(some[apart.argmax()]))
            apart = np.minimum(apart, self._dist(some, picks[-1]))
        owner = np.argmin(np.stack([self._dist(at, p) for p in picks]), 0)
        groups = [(p, at[owner == j]) for j, p in enumerate(picks) if (owner == j).any()]
        if len(groups) == 1:  # all nearest to one: halves by distance
            half = at[np.argsort(to)]
            groups = [(int(h[0]), h) for h in np.array_split(half, 2)]
        kids = [self._node(g, int(p)) for p, g in groups]
        return node | {"kids": kids, "to": self._dist(np.array([k["pivot"] for k in kids]), pivot), "radii": np.array([k["radius"] for k in kids])}

    def _leaves(self, aug: np.ndarray, far: np.ndarray) -> list[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
        """Leaves with the queries that may find something there, their least possible distances, and their distances to the leaf's pivot."""
        out, stack = [], [(self.root, np.arange(len(aug)), np.sqrt(((aug - self.aug[self.root["pivot"]]) ** 2).sum(1)))]
        while stack:
            node, at, d = stack.pop()
            if "kids" not in node:
                out.append((node, at, np.maximum(0.0, d - node["radius"]), d))
                continue
            for kid, to, radius in zip(node["kids"], node["to"], node["radii"], strict=True):
                ok = np.abs(d - to) - radius <= far[at]  # no distance computed yet
                some = at[ok]
                self.computed += len(some)
                dk = np.sqrt(((aug[some] - self.aug[kid["pivot"]]) ** 2).sum(1))
                go = dk - radius <= far[some]
                if go.any():
                    stack.append((kid, some[go], dk[go]))
        return out

    def search_all(self, q: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For queries (n, dim), the k best (query, score, id), ties to the smaller id, of those with a score of at least a query's floor (nan: none).

        Best-first for all queries at once: each round, every query goes to its nearest leaf that is left, and
        those that meet in a leaf are scored together; a query stops when its next leaf is too far.
        """
        n, flat = len(q), q.astype(np.float64)
        q2 = (flat**2).sum(1)
        bound = self.longest * math.sqrt(float(q2.max(initial=0))) + 1
        bits = max(1, (len(self.vecs) - 1).bit_length())
        exact, packed = bound * 4 < 2**53, bound < 2 ** (62 - bits)
        reach = lambda at, s: np.sqrt(np.maximum(q2[at] + self.top2 - 2.0 * s, 0.0)) * (1 + SLACK) + SLACK
        every = np.arange(n)
        far = np.where(np.isnan(floors), math.inf, reach(every, np.nan_to_num(floors)))
        least = np.where(np.isnan(floors), NONE, np.nan_to_num(floors)).astype(np.int64)
        best_s, best_at = np.full((n, k), NONE), np.full((n, k), -1)
        leaves = self._leaves(np.c_[flat, np.zeros(n)], far)
        leaf = np.repeat(np.arange(len(leaves)), [len(x[1]) for x in leaves])
        of, low, d = (np.concatenate([x[j] for x in leaves]) for j in (1, 2, 3)) if leaves else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        order = np.lexsort((low, of))
        leaf, of, low, d = (x[order] for x in (leaf, of, low, d))
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        turn = np.arange(len(of)) - np.repeat(start, np.diff(np.r_[start, len(of)]))
        for r in range(int(turn.max(initial=-1)) + 1):
            now = np.flatnonzero(turn == r)
            now = now[low[now] <= far[of[now]]]
            now = now[np.argsort(leaf[now], kind="stable")]
            for group in np.split(now, np.flatnonzero(np.diff(leaf[now])) + 1):
                if not len(group):
                    continue
                node, at = leaves[leaf[group[0]]][0], of[group]
                a = np.searchsorted(node["to"], d[group] - far[at]).min()
                b = np.searchsorted(node["to"], d[group] + far[at], "right").max()
                entries = node["entries"][a:b]
                if not len(entries):
                    continue
                self.computed += len(entries) * len(at)
                s = (flat[at] @ self.flat[entries].T).astype(np.int64) if exact else q[at] @ self.vecs[entries].T
                place = np.where(s >= least[at][:, None], entries[None], -1)
                s = np.concatenate([best_s[at], np.where(place >= 0, s, NONE)], 1)
                best_s[at], best_at[at] = _best(s, np.concatenate([best_at[at], place], 1), k, bits if packed else None)
                full = best_at[at].min(1) >= 0
                done = at[full]
                least[done] = best_s[done].min(1)
                far[done] = reach(done, least[done].astype(np.float64))
        row, col = np.nonzero(best_at >= 0)
        at, s = best_at[row, col], best_s[row, col]
        many = self.n_ids[at]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, s, i = np.repeat(row, many), np.repeat(s, many), self.all_ids[np.repeat(self.first_id[at], many) + nth]
        order = np.lexsort((i, -s, row))
        row, s, i = row[order], s[order], i[order]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        keep = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)])) < k
        return row[keep], s[keep], i[keep]

    def search(self, q: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id) of one query."""
        return self.search_all(q[None], k, np.array([np.nan if floor is None else float(floor)]))[1:]


def _best(s: np.ndarray, at: np.ndarray, k: int, bits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then by place; a place of -1 is none. bits: of a place, if it fits into a long beside the score."""
    if bits is None:
        order = np.stack([np.lexsort((a, -x, a < 0)) for x, a in zip(s, at, strict=True)])[:, :k]
        return np.take_along_axis(s, order, 1), np.take_along_axis(at, order, 1)
    mask = (1 << bits) - 1
    key = np.where(at >= 0, (s << bits) + (mask - at), NONE)
    key = np.partition(key, key.shape[1] - k, axis=1)[:, -k:]
    return np.where(key > NONE, key >> bits, NONE), np.where(key > NONE, mask - (key & mask), -1)


def quantized(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x); rows that take no part are gone."""
    x = F.col("embedding")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    ok = df.filter(x.isNotNull() & F.col("vec_id").isNotNull()).filter(~F.coalesce(odd, F.lit(True)))
    return ok.select("vec_id", F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def _matrix(col: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(col), dim), np.int64)
    for i, x in enumerate(col):
        out[i, : len(x)] = x
    return out


def _searcher(dim: int, top2: float, k: int) -> Callable:
    def run(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(index):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("qkey", "vec_id", "score")})
        tree = MTree(_matrix(index["v"], dim), [np.asarray(x, np.int64) for x in index["ids"]], top2)
        row, s, i = tree.search_all(_matrix(queries["qv"], dim), k, queries["floor"].to_numpy(np.float64, na_value=np.nan))
        return pd.DataFrame({"qkey": queries["qkey"].to_numpy()[row], "vec_id": i, "score": s})

    return run


def copies(index: DataFrame, routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index and the routed queries, both with the batch in which they meet. A row a tree is broadcast: a tree has TREE vectors, about."""
    load = routed.groupBy("cell", "salt").agg(F.count("*").alias("asked"))
    size = index.groupBy("cell", "salt").agg(F.count("*").alias("held"))
    room = F.greatest(F.lit(BLOCK).cast("double"), F.col("held") / 4)
    batches = load.join(size, ["cell", "salt"]).select(F.col("cell").alias("b_cell"), F.col("salt").alias("b_salt"), F.ceil(F.col("asked") / room).alias("batches"))
    batches = F.broadcast(written(batches, "batches"))
    at = (F.col("cell") == F.col("b_cell")) & (F.col("salt") == F.col("b_salt"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)).alias("block")
    return index.join(batches, at).select("v", "ids", "cell", "salt", every), routed.join(batches, at).select(*routed.columns, F.pmod(F.xxhash64("qkey"), F.col("batches")).alias("block"))


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """vectors: (vec_id, v). Returns query_id, rank, vec_id, score of the k best for each row where is_query holds."""
    vectors = written(vectors, "vectors")
    first = W.partitionBy("v").orderBy("vec_id")
    few = vectors.distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    distinct = written(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("vkey", F.col("ids")[0]), "distinct")
    size, dim, top2 = distinct.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    spark = vectors.sparkSession
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # pivots from a bounded sample, spread by greedy choice of the farthest
    n_cells = max(1, min(MAX_CELLS, -(-size // CELL)))
    sample = _matrix(distinct.orderBy(F.xxhash64("vkey")).limit(min(SAMPLE, max(1, 8 * n_cells))).toPandas()["v"], dim).astype(np.float64)
    aug = np.c_[sample, np.sqrt(np.maximum(top2 - (sample**2).sum(1), 0))]
    picks, near = [0], ((aug - aug[0]) ** 2).sum(1)
    while len(picks) < min(n_cells, len(aug)):
        picks.append(int(near.argmax()))
        near = np.minimum(near, ((aug - aug[picks[-1]]) ** 2).sum(1))
    pivots = aug[picks]

    def assign(batches):
        for pdf in batches:
            v = _matrix(pdf["v"], dim).astype(np.float64)
            a = np.c_[v, np.sqrt(np.maximum(top2 - (v**2).sum(1), 0))]
            d2 = np.maximum((a**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * a @ pivots.T, 0)
            cell = d2.argmin(1)
            yield pdf.assign(cell=cell.astype(np.int64), far=np.sqrt(((a - pivots[cell]) ** 2).sum(1)))

    index = written(distinct.mapInPandas(assign, "v array<long>, ids array<long>, vkey long, cell long, far double"), "index")
    cells = index.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).toPandas()  # a row a cell, MAX_CELLS at most
    salts = {int(c): max(1, -(-int(n) // TREE)) for c, n in zip(cells["cell"], cells["n"], strict=True)}
    radius = dict(zip(cells["cell"].astype(int), cells["radius"], strict=True))
    salt_of = F.create_map(*[F.lit(x) for c, n in salts.items() for x in (c, n)])
    index = index.withColumn("salt", F.pmod(F.xxhash64("vkey"), salt_of[F.col("cell")]))

    asked = vectors.filter(is_query).select("vec_id", "v")
    # a key of its own for each vector, as an id may have several
    queries = written(asked.select("v").distinct().withColumn("qkey", F.monotonically_increasing_id()), "queries")
    # a query's own id may be in several rows with different vectors, all of which fall out of its neighbours
    depth = k + (asked.distinct().groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1)
    known = np.array(sorted(radius))
    reach = np.array([radius[c] for c in known])

    def route(batches, rest: bool):
        """Each query to the trees to search: first its nearest cell, then all others that may hold better ones."""
        for pdf in batches:
            q = _matrix(pdf["qv"], dim).astype(np.float64)
            q2 = (q**2).sum(1)
            a = np.c_[q, np.zeros(len(q))]
            d = np.sqrt(np.maximum(q2[:, None] + (pivots[known] ** 2).sum(1)[None] - 2 * a @ pivots[known].T, 0))
            home = d.argmin(1)
            rows = []
            for j, (key, v, f) in enumerate(zip(pdf["qkey"], pdf["qv"], pdf["floor"], strict=True)):
                if not rest:
                    rows.append((key, v, f, int(known[home[j]]), 0))
                    continue
                far = math.inf if pd.isna(f) else math.sqrt(max(q2[j] + top2 - 2.0 * f, 0.0)) * (1 + SLACK) + SLACK
                for x in np.flatnonzero(d[j] - reach * (1 + SLACK) - SLACK <= far):
                    c = int(known[x])
                    rows += [(key, v, f, c, s) for s in range(salts[c]) if x != home[j] or s]
            yield pd.DataFrame(rows, columns=["qkey", "qv", "floor", "cell", "salt"]).astype({"floor": "Float64"})

    shape = "qkey long, qv array<long>, floor double, cell long, salt long"
    search = _searcher(dim, top2, depth)
    trees = index.select("v", "ids", "cell", "salt")

    def found(routed: DataFrame) -> DataFrame:
        by = ("cell", "salt", "block")
        held, asked = copies(trees, written(routed, "routed"))
        return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(search, "qkey long, vec_id long, score long")

    start = queries.select("qkey", F.col("v").alias("qv"), F.lit(None).cast("double").alias("floor"))
    one = written(found(start.mapInPandas(lambda b: route(b, False), shape)), "round-one")
    floors = one.groupBy("qkey").agg(F.min("score").cast("double").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == depth).select("qkey", "floor")
    two = found(start.drop("floor").join(floors, "qkey", "left").select("qkey", "qv", "floor").mapInPandas(lambda b: route(b, True), shape))
    best = W.partitionBy("qkey").orderBy(F.col("score").desc(), "vec_id")
    near = one.unionByName(two).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= depth).drop("n")
    names = asked.join(queries.select(F.col("v").alias("w"), "qkey"), F.col("v") == F.col("w")).select(F.col("vec_id").alias("query_id"), "qkey").distinct()
    own = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = names.join(near, "qkey").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other rows for every row whose vec_id is divisible by 20."""
    return top_k(quantized(read(spark, sf_dir, "embeddings")), F.col("vec_id") % QUERY_EVERY == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
