"""Approximate nearest neighbours by cosine: probed lists and an adaptive dimension scan.

Vectors are made unit, rotated at random and assigned to the nearest of a few centroids (k-means on a bounded sample); how
many lists a query probes is calibrated on that sample. Vectors of each length have an index of their own. Within a list, rotated vectors lie in blocks of columns: after each
block a hypothesis test compares what the partial distances suggest with the query's k-th best distance so far, and
abandons the candidates that would almost surely lose. The rest are scored exactly on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .embeddings import cosines, matrix, unit, valid_vectors, vector_type
from .shared import saved

#: Rows that fit a length's index, at least (or all there are) and at most; rows of them for a list. There are as many lists
#: as the root of the rows, up to LARGEST / PER_LIST.
SAMPLE, LARGEST, PER_LIST = 20_000, 200_000, 20
#: Columns a block, and rows of a list, or queries, in one task.
COLUMNS, BLOCK = 16, 4096
#: Pairs of a query and a row, or numbers of such, that are held at once.
PAIRS = 1 << 20


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def fit_centroids(x: np.ndarray, k: int, seed: int, turns: int = 8) -> np.ndarray:
    """Spherical k-means on unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(turns):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def probes_for(x: np.ndarray, centroids: np.ndarray, k: int, recall: float, queries: int = 400) -> int:
    """Lists to probe so that the sample's own queries find so much of their true neighbours."""
    own = (x @ centroids.T).argmax(1)
    q = np.arange(0, len(x), max(1, len(x) // queries))[:queries]
    sims = x[q] @ x.T
    sims[np.arange(len(q)), q] = -2
    near = np.argpartition(-sims, min(k, sims.shape[1] - 1), axis=1)[:, :k]
    order = np.argsort(-(x[q] @ centroids.T), axis=1)
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.arange(order.shape[1])[None, :], 1)
    needed = np.sort(np.take_along_axis(turn, own[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def scan(q: np.ndarray, x: np.ndarray, k: int, epsilon: float, skip: np.ndarray) -> np.ndarray:
    """Which of a list's rotated rows x may be among the k nearest of each rotated query q (queries x rows, boolean).

    ``skip`` marks rows that are none. Column block by column block, for all queries of the list at once."""
    n, d = x.shape
    live = ~skip
    if n <= 4 * k:
        return live
    part, bound = np.zeros(live.shape), np.full(len(q), np.inf)
    for s in range(0, d, COLUMNS):
        e = min(d, s + COLUMNS)
        if live.mean() > 0.2:
            part += (q[:, s:e] ** 2).sum(1)[:, None] + (x[:, s:e] ** 2).sum(1)[None, :] - 2 * (q[:, s:e] @ x[:, s:e].T)
        else:
            i, j = np.nonzero(live)
            part[i, j] += ((q[i, s:e] - x[j, s:e]) ** 2).sum(1)
        if e < d:
            # whole distances of the nearest by what is known give a sound bound, tighter with each block
            first = np.argpartition(np.where(live, part, np.inf), 4 * k - 1, axis=1)[:, : 4 * k]
            whole = ((q[:, None, :] - x[first]) ** 2).sum(2)
            whole[~np.take_along_axis(live, first, 1)] = np.inf
            bound = np.minimum(bound, np.partition(whole, k - 1, axis=1)[:, k - 1])
            live &= part * (d / e) <= (bound * (1 + epsilon / np.sqrt(e)) ** 2 + 1e-12)[:, None]
    return live & (part <= bound[:, None] + 1e-9)


class Index:
    """Of the vectors of one length: a rotation, centroids, lists to probe and the number of the first list."""

    def __init__(self, x: np.ndarray, lists: int, k: int, recall: float, first: int, seed: int):
        self.turn = rotation(x.shape[1], seed)
        x = unit(x) @ self.turn
        self.centroids = fit_centroids(x, lists, seed)
        self.probes = probes_for(x, self.centroids, k, recall) if len(x) > k else len(self.centroids)
        self.first = first

    def turned(self, v: np.ndarray) -> np.ndarray:
        return unit(v) @ self.turn


def _by_length(batches, indexes: dict[int, Index]):
    """Parts of Arrow batches whose vectors are equally long, with their index."""
    for b in batches:
        lengths = np.diff(b.column("embedding").offsets.to_numpy())
        for d in np.unique(lengths):
            yield (b if len(lengths) and (lengths == d).all() else b.filter(pa.array(lengths == d))), indexes[int(d)]


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, recall: float = 0.97, epsilon: float = 2.1, seed: int = 23) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, its k nearest other rows.

    score is the cosine in double precision on the original vectors; the nearest comes first, of equal ones the smaller
    vec_id. Candidates are all rows of the query's length but the query's own row: repeated rows each count, and each is a
    query of its own. Null or zero vectors, those with null or non-finite components and those with a null vec_id take no
    part. A query that has fewer candidates than k gets them all. An empty table gives none.
    """
    spark = vectors.sparkSession
    valid = valid_vectors(vectors).where("vec_id is not null")
    size = F.size("embedding")
    counts = {r["d"]: r["n"] for r in valid.groupBy(size.alias("d")).agg(F.count("*").alias("n")).collect()}
    lists = {d: max(1, min(LARGEST // PER_LIST, round(n**0.5))) for d, n in counts.items()}
    rates = [F.when(size == d, F.lit(max(SAMPLE, PER_LIST * lists[d]) / n)) for d, n in counts.items()]
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "vec_id"), 11).cast("double") / float(1 << 53)
    drawn = valid.where(chance < F.coalesce(*rates, F.lit(0.0))).orderBy("vec_id").select("embedding").toArrow()["embedding"] if counts else None
    indexes, held = {}, np.zeros(0, np.int64)
    if counts:
        drawn = drawn.combine_chunks()
        lengths = np.diff(drawn.offsets.to_numpy())
        first = 0
        for d in sorted(counts):
            mine = drawn.filter(pa.array(lengths == d))
            x = matrix(mine) if len(mine) else np.eye(1, d)
            indexes[d] = Index(x, lists[d], k, recall, first, seed)
            first += len(indexes[d].centroids)
        held = np.zeros(first, np.int64)
    model = spark.sparkContext.broadcast(indexes)

    def assigned(batches):
        for b, index in _by_length(batches, model.value):
            own = (index.turned(matrix(b.column("embedding"))) @ index.centroids.T).argmax(1) + index.first
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("embedding"), pa.array(own.astype(np.int32))], ["row", "vec_id", "embedding", "list"])

    kind = vector_type(vectors)
    # written, so that a row keeps its number
    rows = valid.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding")
    indexed = saved(rows.mapInArrow(assigned, f"row long, vec_id long, embedding {kind}, list int"), "indexed")
    for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect():
        held[r["list"]] = r["n"]

    def probed(batches):
        """A row for each query and each list that it probes."""
        for b, index in _by_length(batches, model.value):
            q = index.turned(matrix(b.column("embedding")))
            sizes = held[index.first : index.first + len(index.centroids)]
            order = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")
            row, key = [], []
            for i in range(len(q)):
                have = np.cumsum(sizes[order[i]])
                own = order[i, : max(index.probes, int(np.searchsorted(have, k + 1)) + 1)]
                own = own[sizes[own] > 0]
                row.append(np.full(len(own), i))
                key.append(own + index.first)
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([b.column("row").take(take), b.column("embedding").take(take), pa.array(np.concatenate(key).astype(np.int32))], ["row", "embedding", "list"])

    queries = indexed.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = queries.select("row", "embedding").mapInArrow(probed, f"row long, embedding {kind}, list int")
    # a list's rows go to as many parts as its own queries fill, and to none if no query probes it; a row a list, of which
    # there are at most LARGEST / PER_LIST for a length, is broadcast
    dealt = [(r["list"], int(-(-held[r["list"]] // BLOCK)), -(-r["n"] // BLOCK)) for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()]
    dealt = F.broadcast(spark.createDataFrame(dealt, "list int, blocks int, parts int"))
    one_of = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(dealt, "list").withColumn("part", one_of("parts")).withColumn("block", every_of("blocks"))
    offered = indexed.join(dealt, "list").withColumn("block", one_of("blocks")).withColumn("part", every_of("parts"))

    def scanned(asked, offered):
        out = {"query": [], "row": [], "vec_id": [], "score": []}
        if len(asked) and len(offered):
            asking, rows, ids = asked["row"].to_numpy(), offered["row"].to_numpy(), offered["vec_id"].to_numpy()
            q, v = matrix(asked["embedding"]), matrix(offered["embedding"])
            d = v.shape[1]
            index = model.value[d]
            turned, cand = index.turned(q), index.turned(v)
            step = max(1, PAIRS // len(v))
            for at in range(0, len(q), step):
                mine = asking[at : at + step]
                i, j = np.nonzero(scan(turned[at : at + step], cand, k, epsilon, rows[None, :] == mine[:, None]))
                score = np.concatenate([np.zeros(0), *(cosines(q[at + i[c : c + max(1, PAIRS // d)]], v[j[c : c + max(1, PAIRS // d)]]) for c in range(0, len(i), max(1, PAIRS // d)))])
                order = np.lexsort((rows[j], ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                out["query"].append(mine[i[best]])
                out["row"].append(rows[j[best]])
                out["vec_id"].append(ids[j[best]])
                out["score"].append(score[best])
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        return pa.table({c: join(x, np.float64 if c == "score" else np.int64) for c, x in out.items()})

    key = ["list", "block", "part"]
    found = asked.groupBy(*key).cogroup(offered.select("row", "vec_id", "embedding", *key).groupBy(*key)).applyInArrow(scanned, "query long, row long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    named = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best.join(named, "query").select("query_id", "rank", "vec_id", "score")
