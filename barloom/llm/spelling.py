"""Spelling variants: words one edit apart, found through k-d trees over letter counts.

One edit changes letter counts by at most two in L1: a replaced letter takes one from a count and adds one to another, an
inserted one adds one. So near words lie in vectors within that distance, of equal length or one longer. Distinct vectors are
dealt to cells by a k-d tree over a sample; a vector looks for neighbours in each cell whose box it can reach with one letter
less and one more. There a local tree a length is searched with the same pruning. What a search gives back is not pairs but
the letters that a vector's words must lose to meet others. Words then lose these letters, one place at a time, and those left
with the same rest are compared letter by letter, so that a vector of very many anagrams is never compared pair by pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

#: Letters of words in the order of the dimensions; A-Z are lower-cased before.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
RUN = "[A-Za-zÀ-ÿ]"
#: Vectors a cell, vectors in the sample that the cells' tree is fitted on, and the longest words in that sample.
CELL, SAMPLE, SAMPLE_LENGTH = 20_000, 200_000, 200
LEAF = 192
#: Longer words are shuffled as a digest, of which there is one a place, and are put back where rests are equal.
LONG = 64
#: Letters of one step in tasks; a longer word is a step of its own and takes about 100 bytes a letter there.
STEP = 2_000_000
#: One run in so many loses a letter.
GARBLED = 31
#: The dimension after the letters': a word's length.
LENGTH = len(LETTERS)
_DIM = np.full(0x100, -1, np.int64)
_DIM[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


# --- words --------------------------------------------------------------------------------------------------------------


def words(docs: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """(word, n) of all runs of letters, after one in 31 has lost a letter by its hash. A null doc_id counts as an empty one."""
    low = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"({RUN}{{{least_length},}}+)"), 1)).alias("run"))
    runs = runs.select(low.alias("run"), F.crc32(F.encode(F.concat("id", F.lit(":"), low), "UTF-8")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    kept = F.when(F.col("h") % GARBLED == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(kept.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _anagram_key(word: Column) -> Column:
    return F.array_join(F.array_sort(F.regexp_extract_all(word, F.lit("(?s)(.)"), 1)), "")


# --- k-d trees over letter counts ---------------------------------------------------------------------------------------


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their first column has at most STEP letters, or one row."""
    for b in batches:
        ends, a = np.cumsum([len(x) for x in b.column(0).to_pylist()]), 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, "right")))
            yield b.slice(a, z - a)
            a = z


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters' dimensions, one text after the other, and the lengths."""
    flat = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    return _DIM[flat], np.array([len(x) for x in texts.to_pylist()], np.int64)


def counts(keys: pa.Array) -> np.ndarray:
    """Letter counts, and the length as a last column."""
    dims, lengths = _codes(keys)
    d = len(LETTERS)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out = np.bincount(row * d + dims, minlength=len(lengths) * d).reshape(-1, d) if len(dims) else np.zeros((len(lengths), d), np.int64)
    return np.concatenate([out, lengths[:, None]], 1).astype(np.int32)


def grow(points: np.ndarray, rows: np.ndarray, leaf: float, new_leaf):
    """A k-d tree as nested tuples (dimension, last value on the left, left, right): the dimension of largest variance is cut at
    its median, or next to it, as equal values stay together. Leaves are what ``new_leaf`` makes of their rows."""
    own = points[rows]
    if len(rows) > leaf:
        at = int(own.var(0).argmax())
        values = np.sort(own[:, at])
        cut = values[len(values) // 2 - 1]
        if cut == values[-1]:
            cut = values[np.searchsorted(values, cut) - 1]
        left = own[:, at] <= cut
        if 0 < left.sum() < len(rows):
            return at, cut, grow(points, rows[left], leaf, new_leaf), grow(points, rows[~left], leaf, new_leaf)
    return new_leaf(rows)


def reach(tree, points: np.ndarray, rows: np.ndarray, more: int, less: int, visit) -> None:
    """Calls visit(leaf, rows) for each leaf whose box those rows can reach with so many letters added and taken; the length is
    what is looked for, so no letter changes it.

    Which dimensions have been changed need not be kept: beyond a crossing, the value as it was lies on the right side of every
    further cut of the same dimension."""

    def go(node, rows, more, less):
        if not len(rows):
            return
        if not isinstance(node, tuple):
            visit(node, rows)
            return
        at, cut, left, right = node
        x = points[rows, at]
        for child, inside, edge, adds in ((left, x <= cut, x == cut + 1, False), (right, x > cut, x == cut, True)):
            cross = edge & ((more if adds else less) > 0) & (at != LENGTH)
            own = inside | cross
            go(child, rows[own], more[own] - cross[own] * adds, less[own] - cross[own] * (not adds))

    go(tree, rows, np.full(len(rows), more), np.full(len(rows), less))


def _cells_tree(vectors: DataFrame, cells: int, sample: int):
    """The tree that deals vectors to cells, fitted on a sample drawn by hash. Lengths are one of its dimensions."""
    found = vectors.where(F.length("key") <= SAMPLE_LENGTH).orderBy("vid").limit(sample).select("key").toArrow()["key"].combine_chunks() if cells > 1 else pa.array([], pa.string())
    number = iter(range(cells * 4 + 1))
    points = counts(found)
    return grow(points, np.arange(len(points)), max(8, len(points) / cells), lambda rows: next(number))


def _deal(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            points = counts(b.column(0))
            n = len(points)
            longer = points.copy()
            longer[:, -1] += 1
            out = []
            # role 0: lives here; 1: looks for vectors of its own length; 2: looks for longer ones
            for role, at, more, less in ((0, points, 0, 0), (1, points, 1, 1), (2, longer, 1, 0)):
                reach(tree, at, np.arange(n), more, less, lambda cell, rows, role=role: out.append((np.full(len(rows), cell), np.full(len(rows), role), rows)))
            cell, role, rows = (np.concatenate(x) for x in zip(*out))
            yield pa.record_batch([pa.array(cell, pa.int32()), pa.array(role, pa.int8()), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))], names=["cell", "role", "key", "vid"])

    return run


def _search(table: pa.Table) -> pa.Table:
    """In one cell: (vid, letter, way) for each letter that words of a vector lose to meet others: way 2 by a replaced letter, 1 by
    one too many; way 0 and no letter: they are the shorter ones."""
    role, vid = table["role"].to_numpy(), table["vid"].to_numpy()
    points = counts(table["key"].combine_chunks())
    active = np.flatnonzero(points[:, :-1].any(0))
    x, length = points[:, active].astype(np.float64), points[:, -1]
    square = (x * x).sum(1)
    lost = []

    def note(rows: np.ndarray, letters: np.ndarray | int, way: int) -> None:
        lost.append(np.stack([rows, np.broadcast_to(letters, rows.shape), np.full(len(rows), way)], 1))

    for size in np.unique(length[role > 0]):
        for kind, more, less in ((1, 1, 1), (2, 1, 0)):
            here = np.flatnonzero((role == 0) & (length == size + (kind == 2)))
            asked = np.flatnonzero((role == kind) & (length == size))
            if not len(here) or not len(asked):
                continue

            def visit(leaf: np.ndarray, rows: np.ndarray, kind=kind) -> None:
                for part in np.array_split(rows, max(1, math.ceil(len(rows) * len(leaf) / 4_000_000))):
                    # of equal lengths, squares of two are one letter less and one more; of a longer one, one is a letter more
                    far = square[part][:, None] + square[leaf][None, :] - 2 * (x[part] @ x[leaf].T)
                    q, p = np.nonzero(far == (2 if kind == 1 else 1))
                    q, p = part[q], leaf[p]
                    for a in range(0, len(q), 100_000):
                        one, other = q[a : a + 100_000], p[a : a + 100_000]
                        diff = x[other] - x[one]
                        up = active[diff.argmax(1)]
                        if kind == 1:
                            note(one, active[diff.argmin(1)], 2)
                            note(other, up, 2)
                        else:
                            note(one, -1, 0)
                            note(other, up, 1)

            tree = grow(x, here, LEAF, lambda rows: rows)
            reach(tree, x, asked, more, less, visit)
    found = np.unique(np.concatenate(lost), axis=0) if lost else np.zeros((0, 3), np.int64)
    return pa.table({"vid": pa.array(vid[found[:, 0]], pa.int64()), "letter": pa.array(found[:, 1], pa.int32()), "way": pa.array(found[:, 2], pa.int32())})


# --- letter order -------------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, needs) -> (rest, way, place, word, n): a hash of what is left of the word without the letter at a place.

    Hashes of all places of a word come from two running sums, so a word of any length costs its length."""
    d = len(LETTERS)
    for part in _steps(batches):
        dims, lengths = _codes(part.column(0))
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        row = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(dims)) - start[row]
        needs = part.column(2)
        own, values = np.repeat(np.arange(len(lengths)), np.diff(needs.offsets.to_numpy())), needs.flatten().to_numpy(zero_copy_only=False)
        wanted = np.zeros((3, len(lengths), d), bool)
        wanted[values % 3, own, values // 3] = True
        value = lambda place: _mix((place.astype(np.uint64) << np.uint64(8)) + dims.astype(np.uint64))
        here, moved = value(at), value(np.maximum(at - 1, 0))
        before, upto = np.cumsum(here) - here, np.cumsum(moved)
        # sums over a word, modulo 2**64
        last = start + lengths - 1
        rest = before - before[start[row]] + upto[last[row]] - upto
        whole = before[last] + here[last] - before[start]
        again = np.concatenate([[False], (dims[1:] == dims[:-1]) & (row[1:] == row[:-1])])
        none = np.flatnonzero(wanted[0].any(1))
        short = np.flatnonzero(wanted[1, row, dims] & ~again)  # of equal letters in a row, any one leaves the same rest
        other = np.flatnonzero(wanted[2, row, dims])
        rows = np.concatenate([none, row[short], row[other]])
        keys = np.concatenate([whole[none], rest[short], _mix(rest[other] ^ _mix(at[other].astype(np.uint64)))])
        ways = np.repeat(np.array([0, 1, 2], np.int8), [len(none), len(short), len(other)])
        places = np.concatenate([np.zeros(len(none), np.int64), at[short], at[other]])
        names = pa.array([w if len(w) <= LONG else _digest(w) for w in part.column(0).to_pylist()])
        for a in range(0, len(rows), 1 << 16):
            z = slice(a, a + (1 << 16))
            take = pa.array(rows[z])
            yield pa.record_batch([pa.array(keys[z].view(np.int64)), pa.array(ways[z]), pa.array(places[z], pa.int32()), names.take(take), part.column(1).take(take)], names=["rest", "way", "place", "word", "n"])


def _digest(word: str) -> str:
    return "#" + hashlib.sha256(word.encode()).hexdigest()


def _is_near(a: Column, b: Column) -> Column:
    """Of two members of a group of equal rests."""
    without = lambda m: F.concat(F.substring(m["word"], F.lit(1), m["place"]), F.substring(m["word"], m["place"] + 2, F.length(m["word"])))
    replaced = (a["way"] == 2) & (b["way"] == 2) & (a["place"] == b["place"]) & (a["word"] != b["word"]) & (without(a) == without(b))
    return replaced | ((a["way"] == 0) & (b["way"] == 1) & (a["word"] == without(b))) | ((a["way"] == 1) & (b["way"] == 0) & (b["word"] == without(a)))


def near_words(vocabulary: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(word, n_near, best) of words (word, n) with another exactly one inserted, deleted or replaced letter away; best is (-n, word) of
    the most frequent such, ties by code points. Words are distinct and of LETTERS only."""
    own = vocabulary.withColumn("key", _anagram_key(F.col("word"))).withColumn("vid", F.xxhash64("key"))
    own = saved(own, "spelling-words")
    vectors = saved(own.select("key", "vid").distinct(), "spelling-vectors")
    tree = _cells_tree(vectors, max(1, math.ceil(vectors.count() / cell)), sample)
    dealt = vectors.mapInArrow(_deal(tree), "cell int, role tinyint, key string, vid long")
    lost = dealt.groupBy("cell").applyInArrow(_search, "vid long, letter int, way int")
    needs = lost.groupBy("vid").agg(F.collect_set((F.col("letter") + F.when(F.col("letter") < 0, 1).otherwise(0)) * 3 + F.col("way")).alias("needs"))
    rests = own.join(needs, "vid").select("word", "n", "needs").mapInArrow(_rests, "rest long, way tinyint, place int, word string, n long")
    # a group has a word of each letter at one place, or a word and those that have one more: few, however many words there are
    together = lambda rows: rows.groupBy("rest").agg(F.collect_list(F.struct("way", "place", "word", "n")).alias("members"))
    groups = together(rests).where(F.size("members") > 1)
    long = own.where(F.length("word") > LONG).select("word", F.concat(F.lit("#"), F.sha2("word", 256)).alias("_digest"))
    if not long.isEmpty():
        has = F.exists("members", lambda m: F.startswith(m["word"], F.lit("#")))
        members = groups.where(has).select("rest", F.inline("members")).withColumnRenamed("word", "_digest").join(long, "_digest", "left")
        groups = groups.where(~has).union(together(members.withColumn("word", F.coalesce("word", "_digest"))))
    each = groups.select(F.explode("members").alias("m"), "members")
    others = F.filter("members", lambda o: _is_near(F.col("m"), o))
    part = each.select(F.col("m.word").alias("word"), F.transform(others, lambda o: F.struct((-o["n"]).alias("rank"), o["word"].alias("form"))).alias("near")).where(F.size("near") > 0)
    return part.groupBy("word").agg(F.sum(F.size("near")).cast("long").alias("n_near"), F.min(F.array_min("near")).alias("best"))


def spelling_groups(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row a distinct word of ``docs`` (doc_id, text; other columns are ignored).

    Words are maximal runs of letters, only A-Z lower-cased; a run whose hash with its doc_id is divisible by 31 loses a letter.
    form is the near word of largest n, the smallest of equal ones, if it is at least ``ratio`` times as frequent; root is the last of the
    forms that follow each other, the word itself if it has none. Null and empty texts have no words; a null doc_id hashes as an
    empty one; repeated rows count each. An empty table gives no row. Words of any length are whole words.
    """
    if least_length < 1 or ratio < 2:
        raise ValueError("least_length must be at least 1 and ratio at least 2")
    vocabulary = saved(words(docs, least_length, least_count), "spelling-vocabulary")
    found = vocabulary.join(near_words(vocabulary, cell, sample), "word", "left")
    near = F.coalesce(F.col("n_near"), F.lit(0).cast("long"))
    chosen = -F.col("best.rank") >= ratio * F.col("n")
    out = saved(found.select("word", "n", near.alias("n_near"), F.when(chosen, F.col("best.form")).alias("form"), F.when(chosen, -F.col("best.rank")).alias("form_n")), "spelling-forms")
    # a form is at least ten times as frequent, so there are no more rounds than digits in the largest n
    step = out.where("form IS NOT NULL").select(F.col("word").alias("_at"), F.col("form").alias("_next"))
    roots = saved(step.select(F.col("_at").alias("word"), F.col("_next").alias("root")), "spelling-roots")
    while True:
        longer = roots.join(step, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        longer = saved(longer, "spelling-roots")
        roots = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
