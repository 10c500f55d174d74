"""Near-duplicate vectors by random-hyperplane sign hashing, exact cosines and connected components.

Equal vectors are one node. Each node's sign bits under several tables of hyperplanes put it into one bucket a table. What
is shuffled for each table is the node and a sketch of SKETCH further sign bits, not the vector: within a bucket, pairs
whose sketches differ in too many bits for the threshold are dropped, the others are candidates, of which there are few, and
their vectors are fetched once for exact cosines in double precision. Buckets that are larger than a block, or in which
candidates abound, are groups of near copies: their vectors are dealt as pairs of blocks, so no task holds one, and no pair
leaves its task; each node sends its number of links and one edge to the smallest node of its part of the block. A pair that
meets in several such buckets counts in the first, and not among the candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embeddings import cosines, is_valid, matrix, unit, valid_vectors, vector_type
from .shared import saved, smallest_ids

#: Rows of a bucket that one task compares at once; vectors for which the bits aim a bucket.
BLOCK, BUCKET = 1024, 256
#: Bits of a sketch, standard deviations by which a pair's differing bits may exceed what is expected at the threshold (about
#: one such pair in 30,000 does), and candidates a row of a bucket beyond which its vectors are dealt.
SKETCH, DEVIATIONS, DENSE = 128, 4.0, 4


def tables_for(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Sign bits a table, so that a bucket of unlike vectors has about BUCKET rows, and tables, so that a pair right at
    the threshold is missed with the given probability (nearer pairs far less often)."""
    bits = min(24, max(4, math.ceil(math.log2(max(2, n) / BUCKET))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - together)))


def _each_length(f):
    """f over Arrow batches cut by dim_a."""

    def run(batches):
        for b in batches:
            dims = b.column("dim_a").to_numpy()
            yield from f(b.filter(pa.array(dims == d)) for d in np.unique(dims))

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, miss: float = 0.01, seed: int = 17) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding; other columns are ignored).

    Two vectors link if their cosine is at least ``threshold``; every link reported is exact, and a link right at the
    threshold is missed with probability ``miss`` (and one in 30,000). n_links counts other rows linked directly, repeated rows and copies
    included; component_id is the smallest vec_id reachable, itself included; kept tells whether that is its own. Null or
    zero vectors and those with null or non-finite components link with nothing, as do vectors of different lengths.
    Rows with a null vec_id take part; their kept is null where their component has no other id. An empty table gives none.
    """
    node = F.xxhash64("embedding").alias("node")
    valid = valid_vectors(vectors).select("vec_id", "embedding", node)
    nodes = saved(valid.groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "vectors")
    bits, tables = tables_for(nodes.count(), threshold, miss)
    apart = math.acos(threshold) / math.pi
    most = SKETCH * apart + DEVIATIONS * math.sqrt(SKETCH * apart * (1 - apart))

    def signed(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            lengths = np.array([len(x) for x in b.column("embedding")])
            for d in np.unique(lengths):
                part = b.filter(pa.array(lengths == d))
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), bits * tables + SKETCH))
                v = matrix(part.column("embedding"))
                signs = v / np.abs(v).max(1, keepdims=True) @ planes[d] >= 0
                codes = signs[:, : bits * tables].reshape(len(v), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                sketch = np.ascontiguousarray(np.packbits(signs[:, bits * tables :], axis=1)).view(np.int64)
                ends = pa.array(np.arange(0, len(v) * tables + 1, tables, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("copies"), part.column("embedding"), pa.ListArray.from_arrays(ends, pa.array(codes.astype(np.int32).ravel())), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], ["node", "copies", "embedding", "codes", "s0", "s1"])

    coded = saved(nodes.select("node", "copies", "embedding").mapInArrow(signed, f"node long, copies long, embedding {vector_type(vectors)}, codes array<int>, s0 long, s1 long"), "signed")
    dim, bucket = F.size("embedding").alias("dim"), ["dim", "t", "code"]
    each = coded.select("node", "s0", "s1", dim, F.posexplode("codes").alias("t", "code"))
    large = saved(each.groupBy(*bucket).agg(F.count("*").alias("c")).where(F.col("c") > BLOCK), "large")

    def sifted(table):
        node, s0, s1 = (table[c].to_numpy() for c in ("node", "s0", "s1"))
        left, right, n = [], [], 0
        for at in range(0, len(node), 256):
            off = np.bitwise_count(s0[at : at + 256, None] ^ s0[None, :]) + np.bitwise_count(s1[at : at + 256, None] ^ s1[None, :])
            i, j = np.nonzero(off <= most)
            i += at
            left.append(i[i < j])
            right.append(j[i < j])
            n += len(left[-1])
            if n > DENSE * len(node):
                left = right = None
                break
        key = {c: table[c][0].as_py() for c in bucket} if len(node) else dict.fromkeys(bucket)
        if left is None:
            a, b, c = pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), [len(node)]
        else:
            i, j = np.concatenate(left), np.concatenate(right)
            a, b, c = pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), np.zeros(len(i), np.int64)
        whole = {k: pa.array([key[k]] * len(a), pa.int32()) for k in bucket}
        return pa.table({**whole, "a": a, "b": b, "c": pa.array(c, pa.int64())})

    small = each.join(large, bucket, "left_anti").groupBy(*bucket).applyInArrow(sifted, "dim int, t int, code int, a long, b long, c long")
    small = saved(small, "sifted")
    hot = large.union(small.where("a is null").select(*bucket, "c"))
    hot = saved(hot.select(*bucket, F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "hot")
    # which tables a node is hot in
    held = saved(each.join(hot, bucket).groupBy("node").agg(F.array_sort(F.collect_list("t")).alias("hot")), "held")
    marked = saved(coded.join(held, "node", "left").select("node", "copies", "embedding", "codes", F.coalesce("hot", F.array().cast("array<int>")).alias("hot"), dim), "marked")
    dealt = (
        marked.where(F.size("hot") > 0)
        .withColumn("t", F.explode("hot"))
        .withColumn("code", F.get("codes", "t"))
        .join(hot, bucket)
        .withColumn("mine", F.pmod(F.xxhash64("node", "t"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("dim", "t", "code", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), "mine", "node", "copies", "embedding", "codes", "hot")
    )

    def compared(table):
        t, b1, b2 = (table[c][0].as_py() for c in ("t", "b1", "b2"))
        ids, copies, mine = (table[c].to_numpy() for c in ("node", "copies", "mine"))
        v, codes = matrix(table["embedding"]), matrix(table["codes"]).astype(np.int32)
        earlier = np.zeros(codes.shape, bool)
        for x, tables_of in enumerate(table["hot"].to_pylist()):
            earlier[x, [y for y in tables_of if y < t]] = True
        u = unit(v)
        rows, cols = (np.arange(len(ids)),) * 2 if b1 == b2 else (np.flatnonzero(mine == b1), np.flatnonzero(mine == b2))
        left, right = [], []
        for at in range(0, len(rows), 512):
            i, j = np.nonzero(u[rows[at : at + 512]] @ u[cols].T >= threshold - 1e-9)
            i, j = rows[at : at + 512][i], cols[j]
            ok = i < j if b1 == b2 else np.ones(len(i), bool)
            i, j = i[ok], j[ok]
            ok = cosines(v[i], v[j]) >= threshold
            left.append(i[ok])
            right.append(j[ok])
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        fresh = ~((codes[i] == codes[j]) & earlier[i]).any(1)
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, i[fresh], copies[j[fresh]])
        np.add.at(n, j[fresh], copies[i[fresh]])
        root, before = ids.copy(), None
        while before is None or (root != before).any():
            before = root.copy()
            np.minimum.at(root, i, before[j])
            np.minimum.at(root, j, before[i])
        keep = np.zeros(len(ids), bool)
        keep[i] = keep[j] = True
        return pa.table({"node": ids[keep], "n": n[keep], "root": root[keep]})

    met = saved(dealt.groupBy("dim", "t", "code", "b1", "b2").applyInArrow(compared, "node long, n long, root long"), "met")

    def verified(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ok = cosines(matrix(b.column("v_a")), matrix(b.column("v_b"))) >= threshold
            for x in np.flatnonzero(ok):
                shared = set(b.column("hot_a")[x].as_py())
                if shared and any(p == q for k, (p, q) in enumerate(zip(b.column("codes_a")[x].as_py(), b.column("codes_b")[x].as_py(), strict=True)) if k in shared):
                    ok[x] = False  # counted among the dealt
            yield b.select(["a", "b", "copies_a", "copies_b"]).filter(pa.array(ok))

    end = lambda x, *more: marked.select(F.col("node").alias(x), F.col("copies").alias(f"copies_{x}"), F.col("embedding").alias(f"v_{x}"), F.col("codes").alias(f"codes_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in more), F.col("dim").alias(f"dim_{x}"))
    pairs = small.where("a is not null").select("a", "b").distinct().join(end("a", "hot"), "a").join(end("b"), "b")
    # batches are of one length each, as matrix() asks: pairs of a bucket have the same
    pairs = pairs.select("dim_a", "a", "b", "copies_a", "copies_b", "v_a", "v_b", "codes_a", "codes_b", "hot_a")
    few = saved(pairs.mapInArrow(_each_length(verified), "a long, b long, copies_a long, copies_b long"), "few")
    links = met.select("node", "n").union(few.select("a", "copies_b")).union(few.select("b", "copies_a")).groupBy("node").agg(F.sum("n").alias("n"))
    edges = met.where("node != root").select("node", "root").union(few.select("a", "b")).distinct()
    named = smallest_ids(nodes.select("node", "first"), edges, "node", "root")
    counted = nodes.select("node", "copies").join(links, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    named = saved(counted.join(named, "node"), "named")
    own = valid.select("vec_id", "node").join(named, "node", "left").select("vec_id", "n_links", "component_id")
    ids = F.col("vec_id").cast("long")
    rest = vectors.where(~is_valid()).select(ids.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), ids.alias("component_id"))
    return own.union(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
