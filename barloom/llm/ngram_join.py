"""N-gram Jaccard self-join by prefix lists with set-relation skipping, as distributed connected components.

Method. A document's set of word shingles is a *node*; equal sets share one. Sets are ordered by one global order
(shingles seen often come last, by how often, then by hash), and each node's prefix, which must share a shingle with
every partner, goes to inverted lists. Two skips follow.

* Index skips. A list is ordered by set size and position and cut into blocks of equal ones; block against block is
  decided once, and blocks whose sizes or positions leave too little to share are passed over unread.
* Answer skips. In a long list each node is first joined to a head only. The links found give every node the answers of
  the highly similar set it hangs from: in the second turn it skips all that already shares its class. For pairs across
  classes the heads' answers are computed once; a node's own follow from its head's, corrected by how many shingles the
  two differ in: the distance |A ^ B| obeys the triangle inequality, so most pairs are decided without reading a set, and
  only the rest are verified. Long lists are dealt in block pairs, so that none is held by one task. Pairs from short
  lists are counted over all lists, and most are dropped because they share too few shingles, even if they share all that
  both have in long lists. Pairs that share no short list are bounded by positions in the long ones: there the first
  shingle shared is the first of all.

Every other candidate is verified on whole sets. No partner or candidate is capped.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bitmap_of, bucket_count, claim, connected_components, in_bitmap, pack, pack_sorted, saved, slices, smallest_ids, unpack, unpack_sorted

#: Rows whose sets a task holds at once, shingle keys that it counts in one go, and postings that it sends in one go.
ROWS, COUNT_BUFFER, POST_BUFFER = 1000, 1_500_000, 500_000
#: Bytes of text, and postings of the second turn, for each group that one call handles: there are as many groups as the data fill.
GROUP_BYTES, GROUP_POSTINGS = 64 << 20, 500_000
#: At most so many frequent shingles are made known to all tasks (16 MB); the rest are ordered by hash alone.
KNOWN_FREQUENT = 1_000_000
#: A list longer than this is dealt in blocks of this length.
BLOCK = 2048


@lru_cache(4)
def _mixers(seed: int) -> list[np.uint64]:
    """Odd multipliers. A call draws its own seed, so nobody can write texts whose words or shingles share hashes."""
    draw = random.Random(seed)
    return [np.uint64(draw.getrandbits(64) | 1) for _ in range(4)]


#: Bytes of text hashed at once, and of a word up to which it is hashed in step with the others.
SLICE, STEPPED = 1 << 20, 64
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _word_hashes(data: np.ndarray, starts: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some bytes, A-Z as a-z, and where they begin. No word goes over one of ``starts``.

    Eight bytes at a time are mixed in, for all words at once; no two words of at most eight bytes and one length share a
    hash. Words longer than STEPPED are hashed one by one by xxh3.
    """
    mix = _mixers(seed)
    shown = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = edge[-1] = True
    first = shown.copy()
    first[1:] &= ~shown[:-1] | edge[1:-1]
    last = shown.copy()
    last[:-1] &= ~shown[1:] | edge[1:-1]
    at, size = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = size - at
    low = np.zeros(len(data) + 8, np.uint8)
    low[: len(data)] = _LOWER[data]
    eight = np.ndarray(len(data) + 1, "<u8", low, 0, (1,))  # the eight bytes from each place
    h = size.astype(np.uint64) * mix[2]
    rows = np.arange(len(at))
    for step in range(0, STEPPED, 8):
        rows = rows[size[rows] > step]
        if not len(rows):
            break
        h[rows] = (h[rows] ^ (eight[at[rows] + step] & _FIRST[np.minimum(size[rows] - step, 8)])) * mix[0]
        h[rows] = (h[rows] ^ h[rows] >> np.uint64(32)) * mix[3]
        h[rows] ^= h[rows] >> np.uint64(29)
    for i in np.flatnonzero(size > STEPPED):
        h[i] = xxhash.xxh3_64_intdigest(low[at[i] : at[i] + size[i]].tobytes(), seed)
    return h, at


def _mixed(w: np.ndarray, span: int, seed: int = 0) -> np.ndarray:
    mix = _mixers(seed)
    h = np.full(len(w) - span + 1, span, np.uint64)
    for i in range(span):
        h = (h ^ w[i : len(w) - span + 1 + i]) * mix[i % 4]
        h ^= h >> np.uint64(29)
    return h * mix[0] ^ (h >> np.uint64(32))


def _sorted_set(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def shingle_sets(texts: pa.Array, k: int, seed: int = 0):
    """For each text, the ascending distinct 64-bit hashes of its k-word shingles; one for the whole sequence if shorter.

    Only A-Z are lower-cased; words are split at the six ASCII white-space characters. Works on the column's bytes, a
    slice at a time, so that memory doesn't follow the batch.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, side="right")) - 1)
        if ends[to] - ends[at] > SLICE:  # one long text: words from pieces cut at white space
            parts, i, e = [], int(ends[at]), int(ends[to])
            while i < e:
                j, size = min(e, i + SLICE), SLICE
                while j < e and not (cut := _BLANK[data[i:j]]).any():
                    j, size = min(e, i + 2 * size), 2 * size
                if j < e:
                    j = i + int(np.flatnonzero(cut)[-1]) + 1
                parts.append(_word_hashes(data[i:j], np.zeros(1, np.int64), seed)[0])
                i = j
            w = np.concatenate(parts)
            yield _sorted_set(_mixed(w, min(k, len(w)), seed)) if len(w) else w
        else:
            piece, own = data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            w, where = _word_hashes(piece, own[:-1], seed)
            cut = np.searchsorted(where, own)
            h = _mixed(w, k, seed) if len(w) >= k else np.zeros(0, np.uint64)
            for i, j in zip(cut, cut[1:], strict=False):
                if j - i >= k:
                    yield _sorted_set(h[i : j - k + 1])
                else:
                    yield _mixed(w[i:j], j - i, seed) if j > i else np.zeros(0, np.uint64)
        at = to


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), k))


def _node(s: np.ndarray, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed) - (1 << 63)


def _distinct_sets(batches, k, seed):
    """For each slice of Arrow batches of texts, its distinct sets by node."""
    claim("ngram_join")
    for b in slices(batches, ROWS):
        out = {}
        for s in shingle_sets(b.column("text"), k, seed):
            if len(s):
                out.setdefault(_node(s, seed), s)
        yield out


def _split(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bounds of n equal ranges of ascending keys of so many bits."""
    edges = np.array([(i << bits) // n for i in range(1, n)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _frequent(docs: DataFrame, k: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (a shingle hash's upper 40 bits, ascending) of the most frequent shingles, and how often each was met."""

    def counted(batches):
        held, size = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            cut = _split(keys, n, 40)
            at = [i for i in range(n) if cut[i] < cut[i + 1]]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "keys": [pack_sorted(keys[cut[i] : cut[i + 1]]) for i in at], "counts": [pack(counts[cut[i] : cut[i + 1]]) for i in at]})

        for sets in _distinct_sets(batches, k, seed):
            for s in sets.values():
                held.append(s >> np.uint64(24))
                size += len(s)
                if size >= COUNT_BUFFER:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def summed(table):
        keys = np.concatenate([unpack_sorted(x) for x in table["keys"].to_pylist()])
        counts = np.concatenate([unpack(x) for x in table["counts"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        total = np.add.reduceat(counts[order], first).astype(np.int64)
        often = total >= 3
        return pa.table({"key": pa.array(keys[often].astype(np.int64)), "n": pa.array(total[often])})

    parts = docs.mapInArrow(counted, "bucket int, keys binary, counts binary")
    often = saved(parts.groupBy("bucket").applyInArrow(summed, "key long, n long"), "frequent")
    levels = often.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("c")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in levels:
        if (total := total + r["c"]) > KNOWN_FREQUENT:
            break
        least = 1 << r["level"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    known = often.where(F.col("n") >= least).toArrow()
    key, n_met = known["key"].to_numpy().astype(np.uint64), known["n"].to_numpy()
    order = np.argsort(key)
    return key[order], n_met[order]


def _prefix(s: np.ndarray, p: int, keys: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first p of a set in the global order, and how often each was met (0: not among the frequent)."""
    if not len(keys):
        return s[:p], np.zeros(len(s[:p]), np.int64)
    own = s >> np.uint64(24)
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    often = keys[at] == own
    rare = s[~often][:p]
    if len(rare) == p:
        return rare, np.zeros(p, np.int64)
    late, n = s[often], met[at[often]]
    order = np.lexsort((late, n))[: p - len(rare)]
    return np.concatenate([rare, late[order]]), np.concatenate([np.zeros(len(rare), np.int64), n[order]])


#: A shingle met more often is dealt to several buckets, by node.
DEAL = 65536
#: Lists of up to so many nodes are short: all their pairs are listed and counted.
SHORT = 32
_DEALT = 1 << 40
_LISTED = "token long, node long, n int, pos int, head long, head_n int, head_pos int, shared int"


def _lists(docs: DataFrame, k: int, num: int, den: int, buckets: int, seed: int) -> DataFrame:
    """What the inverted lists of prefix shingles hold, in two kinds of rows.

    Of lists longer than SHORT, the postings, each with the head of its block (token is set). Of the short ones, pairs of
    nodes whose sizes may match (node, head), and how many of a bucket's short lists they share (token is null).
    """
    known = docs.sparkSession.sparkContext.broadcast(_frequent(docs, k, buckets, seed))

    def posted(batches):
        keys, met = known.value
        mix = _mixers(seed)
        held, size = [], 0

        def flush():
            token, node, n, pos, deal = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = ((token ^ (deal * mix[1])) * mix[0] >> np.uint64(33)) % np.uint64(buckets)
            order = np.lexsort((token, bucket))
            token, node, n, pos, bucket = token[order], node[order], n[order], pos[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            at = [i for i in range(buckets) if cut[i] < cut[i + 1]]
            parts = [slice(cut[i], cut[i + 1]) for i in at]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "token": [pack_sorted(token[p]) for p in parts], "node": [node[p].tobytes() for p in parts], "n": [pack(n[p]) for p in parts], "pos": [pack(pos[p]) for p in parts]})

        for sets in _distinct_sets(batches, k, seed):
            for node, s in sets.items():
                p = len(s) - -(-num * len(s) // den) + 1
                token, often = _prefix(s, p, keys, met)
                deal = np.where(often > DEAL, np.uint64(node & (1 << 62) - 1) % np.maximum(often // DEAL, 1).astype(np.uint64), np.uint64(0))
                held.append((token, np.full(p, node, np.int64), np.full(p, len(s), np.int64), np.arange(p) + _DEALT * (often > DEAL), deal))
                size += p
            if size >= POST_BUFFER:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def listed(table):
        token = np.concatenate([unpack_sorted(x) for x in table["token"].to_pylist()])
        node = np.concatenate([np.frombuffer(x, np.int64) for x in table["node"].to_pylist()])
        n, pos = (np.concatenate([unpack(x) for x in table[c].to_pylist()]).astype(np.int64) for c in ("n", "pos"))
        order = np.lexsort((node, n, token))
        token, node, n, pos = token[order], node[order], n[order], pos[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, n, pos = token[fresh], node[fresh], n[fresh], pos[fresh]
        dealt, pos = pos >= _DEALT, pos % _DEALT
        begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        size = np.repeat(each := np.diff(np.append(begins, len(token))), each)
        long = (size > SHORT) | dealt
        idx = np.flatnonzero((size > 1) & ~long)
        t, v, m = token[idx], node[idx], n[idx]
        left, right = [], []
        for step in range(1, SHORT):
            ok = np.flatnonzero((t[step:] == t[:-step]) & (den * m[:-step] >= num * m[step:])) if step < len(t) else []
            if not len(ok):
                break
            left.append(ok)
            right.append(ok + step)
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        swap = v[i] > v[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        order = np.lexsort((v[j], v[i]))
        i, j = i[order], j[order]
        start = np.flatnonzero(np.concatenate([[True], (v[i][1:] != v[i][:-1]) | (v[j][1:] != v[j][:-1])])) if len(i) else np.zeros(0, np.int64)
        shared = np.diff(np.append(start, len(i)))
        i, j = i[start], j[start]
        pairs = pa.table({"token": pa.nulls(len(i), pa.int64()), "node": v[i], "n": m[i].astype(np.int32), "pos": pa.nulls(len(i), pa.int32()), "head": v[j], "head_n": m[j].astype(np.int32), "head_pos": pa.nulls(len(i), pa.int32()), "shared": shared.astype(np.int32)})
        token, node, n, pos = token[long], node[long], n[long], pos[long]
        # heads: the set with the fewest rarer shingles, which is likely the middle of its group, takes all sets whose
        # sizes may match its own; of the others again the one with the fewest, and so on
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        head = np.zeros(len(token), np.int64)
        for i, e in zip(first, np.append(first[1:], len(token)), strict=False):
            rest = i + np.lexsort((node[i:e], pos[i:e]))
            while len(rest):
                meets = (den * np.minimum(n[rest], n[rest[0]]) >= num * np.maximum(n[rest], n[rest[0]]))
                head[rest[meets]] = rest[0]
                rest = rest[~meets]
        posts = pa.table({"token": token.astype(np.int64), "node": node, "n": n.astype(np.int32), "pos": pos.astype(np.int32), "head": node[head], "head_n": n[head].astype(np.int32), "head_pos": pos[head].astype(np.int32), "shared": pa.nulls(len(token), pa.int32())})
        return pa.concat_tables([pairs, posts])

    parts = docs.mapInArrow(posted, "bucket int, token binary, node binary, n binary, pos binary")
    return saved(parts.groupBy("bucket").applyInArrow(listed, _LISTED), "lists")


def _may_link(n1, p1, n2, p2, num, den):
    """By sizes and by the positions of a shared shingle that is the first one shared (pairs that share a short list don't
    depend on this: they are verified apart)."""
    need = num * (n1 + n2)
    return (den * F.least(n1, n2) >= num * F.greatest(n1, n2)) & ((den + num) * (1 + F.least(n1 - p1 - 1, n2 - p2 - 1)) >= need)


def _pairs_across(lists: DataFrame, classes: DataFrame, num: int, den: int, buckets: int) -> DataFrame:
    """Candidate pairs of nodes that share a list but no class yet."""
    own = saved(lists.select("token", "node", "n", "pos").join(classes, F.col("node") == F.col("id"), "left").select("token", "node", "n", "pos", F.coalesce("component", "node").alias("cls")), "classed")
    live = saved(own.groupBy("token").agg(F.count("*").alias("c"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("token", "c", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "live")
    buckets = max(buckets, (live.agg(F.sum(F.col("c") * F.col("blocks"))).first()[0] or 0) // GROUP_POSTINGS)
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        own.join(live.drop("c"), "token")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", "node", "n", "pos", "cls", "mine", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"))
        .withColumn("bucket", F.pmod(F.xxhash64("token", "b1", "b2"), F.lit(buckets)).cast("int"))
    )

    def paired(table):
        c = {x: table[x].to_numpy() for x in ("token", "node", "n", "pos", "cls", "mine", "b1", "b2")}
        order = np.lexsort((c["node"], c["pos"], c["n"], c["b2"], c["b1"], c["token"]))
        c = {x: v[order] for x, v in c.items()}
        if not len(order):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        fresh = np.concatenate([[True], (c["token"][1:] != c["token"][:-1]) | (c["b1"][1:] != c["b1"][:-1]) | (c["b2"][1:] != c["b2"][:-1])])
        starts = np.flatnonzero(fresh)
        found, held = np.zeros((0, 2), np.int64), []
        for i, e in zip(starts, np.append(starts[1:], len(order)), strict=True):
            n, pos, cls, node, mine = (c[x][i:e].astype(np.int64) for x in ("n", "pos", "cls", "node", "mine"))
            if cls.min() == cls.max():
                continue
            across = c["b1"][i] != c["b2"][i]
            # blocks of one size and position; each goes once over those that its size reaches
            start = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])]))
            end = np.append(start[1:], len(n))
            size_of, rest = n[start], n[start] - pos[start] - 1
            reach = np.searchsorted(size_of, size_of * den // num, side="right")
            for x in range(len(start)):
                y = x + np.flatnonzero((den + num) * (1 + np.minimum(rest[x], rest[x : reach[x]])) >= num * (size_of[x] + size_of[x : reach[x]]))
                if not len(y):
                    continue
                right = np.concatenate([np.arange(start[z], end[z]) for z in y])
                for left in range(start[x], end[x]):
                    ok = (right > left) & (cls[right] != cls[left])
                    if across:
                        ok &= mine[right] != mine[left]
                    other = node[right[ok]]
                    held.append(np.stack([np.minimum(other, node[left]), np.maximum(other, node[left])], 1))
            if sum(map(len, held)) > 1_000_000:
                found, held = np.unique(np.concatenate([found, *held]), axis=0), []
        found = np.unique(np.concatenate([found, *held]), axis=0)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return dealt.groupBy("bucket").applyInArrow(paired, "a long, b long").distinct()


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, d) for pairs (a, b) of nodes: the sizes of the whole sets and that of their symmetric difference."""

    def measured(batches):
        for b in batches:
            n_a, n_b, d = [], [], []
            for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True):
                x, y = unpack_sorted(x), unpack_sorted(y)
                n_a.append(len(x))
                n_b.append(len(y))
                d.append(len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True)))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), *(pa.array(c, pa.int64()) for c in (n_a, n_b, d))], ["a", "b", "n_a", "n_b", "d"])

    one = pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    return two.select("a", "b", "set_a", "set_b").mapInArrow(measured, "a long, b long, n_a long, n_b long, d long")


def _near_enough(d, n_a, n_b, num: int, den: int):
    """den * |A & B| >= num * |A | B|, by the symmetric difference's size."""
    return (den + num) * d <= (den - num) * (n_a + n_b)


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of candidate pairs (a, b), those whose whole sets are similar enough, with sizes and distance."""
    return _distances(pairs, sets).where(_near_enough(F.col("d"), F.col("n_a"), F.col("n_b"), num, den))


def _derived(pairs: DataFrame, links: DataFrame, heads: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) among pairs of nodes, from the answers of the heads that the nodes hang from.

    links: verified pairs (a, b, d); heads: (node). A node hangs from the nearest head that it is linked with, or is its
    own. |A ^ B| lies within |H ^ G| -+ (|A ^ H| + |B ^ G|); only pairs for which that doesn't decide are read.
    """
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("head"), "d").union(links.select("b", "a", "d"))
    hung = ends.join(heads.select(F.col("node").alias("head")), "head", "left_semi").groupBy("node").agg(F.min(F.struct("d", "head")).alias("to"))
    hung = saved(hung.join(heads, "node", "left_anti").select("node", "to.head", "to.d"), "hung")
    of = lambda x: hung.select(F.col("node").alias(x), F.col("head").alias(f"h_{x}"), F.col("d").alias(f"d_{x}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    both = both.select("a", "b", *(F.coalesce(f"h_{x}", x).alias(f"h_{x}") for x in "ab"), (F.coalesce("d_a", F.lit(0)) + F.coalesce("d_b", F.lit(0))).alias("off"))
    size = sets.select("node", "n")
    both = both.join(size.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
    lo, hi = F.least("h_a", "h_b").alias("lo"), F.greatest("h_a", "h_b").alias("hi")
    both = saved(both.select("a", "b", "n_a", "n_b", "off", lo, hi), "hanging")
    between = saved(_distances(both.where("lo != hi").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct(), sets).select(F.col("a").alias("lo"), F.col("b").alias("hi"), "d"), "between")
    both = both.join(between, ["lo", "hi"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    sure = both.where(_near_enough(F.col("d") + F.col("off"), F.col("n_a"), F.col("n_b"), num, den)).select("a", "b")
    open_ = both.where(~_near_enough(F.col("d") + F.col("off"), F.col("n_a"), F.col("n_b"), num, den) & _near_enough(F.col("d") - F.col("off"), F.col("n_a"), F.col("n_b"), num, den))
    return sure.union(_linked(open_, sets, num, den).select("a", "b"))


def similar_documents(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Documents link when den * |A & B| >= num * |A | B| over distinct ``words``-word shingles. component_id is the smallest
    doc_id reachable by links, itself included. A null or wordless text has n_shingles 0 and links with nothing. Equal
    texts of any number are one node. Repeated rows each give a row. Rows with a null doc_id take part; component_id is
    null where no doc_id is known. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select("text")
    volume = texts.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(bucket_count(spark), volume // GROUP_BYTES)
    seed = random.SystemRandom().getrandbits(64)
    lists = _lists(texts, words, num, den, buckets, seed)
    counted = lists.where("token is null").groupBy("node", "head").agg(F.first("n").alias("n"), F.first("head_n").alias("head_n"), F.sum("shared").alias("shared"))
    lists = lists.where("token is not null")
    # of pairs in short lists, those that may share enough: in short lists, in long ones and in the rest of the longer set
    long = saved(lists.groupBy("node").agg(F.count("*").alias("n_long")), "long")
    counted = counted.join(long, "node", "left").join(long.select(F.col("node").alias("head"), F.col("n_long").alias("head_long")), "head", "left")
    most = F.col("shared") + F.least(F.coalesce("n_long", F.lit(0)), F.coalesce("head_long", F.lit(0)))
    largest = F.greatest("n", "head_n")
    enough = (den + num) * (most + F.ceil(num * largest / den) - 1) >= num * (F.col("n") + F.col("head_n"))
    near = saved(counted.where(enough).select(F.col("node").alias("a"), F.col("head").alias("b")), "near")
    member = near.select(F.col("a").alias("node")).union(near.select("b")).union(lists.select("node")).distinct()
    seen = spark.sparkContext.broadcast(bitmap_of(member, "node"))

    def described(batches):
        """Every row's node and size; for nodes that may have a partner, the set once a slice."""
        claim("ngram_join")
        for b in slices(batches, ROWS):
            ids, nodes, sizes, sets, hashes = b.column("doc_id"), [], [], [], []
            held = {}
            for s in shingle_sets(b.column("text"), words, seed):
                nodes.append(_node(s, seed) if len(s) else None)
                sizes.append(len(s))
                sets.append(s if len(s) and nodes[-1] not in held else None)
                held[nodes[-1]] = True
            wanted = in_bitmap(seen.value, np.array([x or 0 for x in nodes], np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([pack_sorted(s) if s is not None and w else None for s, w in zip(sets, wanted, strict=True)], pa.binary())], ["doc_id", "node", "n_shingles", "set"])

    known = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(described, "doc_id long, node long, n_shingles long, set binary"), "known")
    sets = saved(known.where("set is not null").select("node", F.col("n_shingles").alias("n"), "set").dropDuplicates(["node"]), "sets")

    size = lambda p: (F.col("head_n" if p == "head" else "n"), F.col("head_pos" if p == "head" else "pos"))
    first = lists.where((F.col("head") != F.col("node")) & _may_link(*size("head"), *size("node"), num, den)).select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).union(near).distinct()
    links = saved(_linked(first, sets, num, den), "links")
    classes = saved(connected_components(links), "classes")
    across = saved(_pairs_across(lists, classes, num, den, buckets), "across")
    heads = lists.select(F.col("head").alias("node")).distinct()
    more = saved(_derived(across, links, heads, sets, num, den), "links")
    links = links.select("a", "b").union(more)

    owner = saved(known.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first")), "owners")
    named = smallest_ids(owner, links)
    some = known.where("node is not null").join(named, "node", "left").select("doc_id", "n_shingles", "component_id")
    none = known.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.union(none)
