"""Language identification with a blended-spectrum string kernel.

A text is the set of its character n-grams (n = 1, 2, 3); the kernel of two texts is the size of the sets' intersection
over the geometric mean of their sizes. n-grams are whole numbers that tell each from every other, so nothing is hashed.
A few labelled texts serve as Nystroem landmarks; one-versus-rest kernel ridge regression is solved in the space they
span, on a bounded sample of labelled rows. Only n-grams of landmarks can add to a kernel value: they are columns of a
matrix, and texts are scored in batches by the product of their sparse presence rows with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import claim, saved

#: Characters of texts scored at once (or one text), so that memory doesn't follow the batch.
AT_ONCE = 1 << 18
#: Rows that learn a language, and all together, which bounds the rows of each where there are many languages; but at least
#: LEAST_ROWS of each. Landmarks a language and all together, at least one of each.
ROWS, ALL_ROWS, LEAST_ROWS, LANDMARKS, ALL_LANDMARKS = 300, 12_000, 10, 40, 256
UNKNOWN = "und"


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 5, is 0. A null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def ngrams(text: str) -> np.ndarray:
    """The distinct n-grams of a whole text, ascending: up to three code points of 21 bits, each plus one."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if not len(c):
        return c
    two = c[:-1] << np.uint64(21) | c[1:]
    every = np.sort(np.concatenate([c, two, two[:-1] << np.uint64(21) | c[2:]]))
    return every[np.concatenate([[True], every[1:] != every[:-1]])]


class Landmarks:
    """Texts that others are compared with; columns of the presence matrix are their n-grams."""

    def __init__(self, texts: list[str]):
        sets = [ngrams(t) for t in texts]
        self.columns = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        self.presence = np.zeros((len(self.columns), len(sets)), np.float32)
        for k, s in enumerate(sets):
            self.presence[np.searchsorted(self.columns, s), k] = 1 / np.sqrt(max(1, len(s)))

    def products(self, texts: list[str], matrix: np.ndarray) -> np.ndarray:
        """Presence rows, over the root of each text's number of n-grams, times a matrix with a row a column here."""
        out = np.zeros((len(texts), matrix.shape[1]))
        hits, ends, roots = [], [], []
        for t in texts:
            own = ngrams(t)
            at = np.searchsorted(self.columns, own)
            inside = at < len(self.columns)
            inside[inside] = self.columns[at[inside]] == own[inside]
            hits.append(at[inside])
            ends.append(len(hits[-1]))
            roots.append(np.sqrt(max(1, len(own))))
        full = np.flatnonzero(ends)
        if len(full):
            starts = np.cumsum([0, *np.array(ends)[full][:-1]])
            out[full] = np.add.reduceat(matrix[np.concatenate(hits)], starts, axis=0, dtype=np.float64)
        return out / np.array(roots)[:, None]

    def kernel(self, texts: list[str]) -> np.ndarray:
        return self.products(texts, self.presence)


class KernelClassifier:
    """One-versus-rest ridge regression on kernel values; scores() gives one decision value per class."""

    def __init__(self, landmarks: Landmarks, ridge: float = 1e-3):
        self.landmarks, self.ridge = landmarks, ridge

    def fit(self, own: np.ndarray, k: np.ndarray, labels: list[str]):
        """own: the kernel among landmarks; k: that of the sample's rows with landmarks."""
        self.classes = sorted(set(labels))
        place = {c: i for i, c in enumerate(self.classes)}
        y = np.array([place[v] for v in labels])
        val, vec = np.linalg.eigh(own)
        keep = val > 1e-6 * max(val.max(), 1e-12)
        root = vec[:, keep] / np.sqrt(val[keep])
        phi = k @ root
        mean = phi.mean(0)
        target = np.where(y[:, None] == np.arange(len(self.classes)), 1.0, -1.0)
        # rows weigh so that every class has the same total
        w = (1 / np.bincount(y, minlength=len(self.classes)))[y][:, None] * len(y) / len(self.classes)
        centred = phi - mean
        shift = (w * target).mean(0)
        beta = np.linalg.solve(centred.T @ (w * centred) + self.ridge * len(y) * np.eye(centred.shape[1]), centred.T @ (w * (target - shift)))
        self.bias = shift - mean @ beta
        # the landmarks' presence and the coefficients are one matrix, as both products are linear
        self.matrix = (self.landmarks.presence @ (root @ beta)).astype(np.float32)
        return self

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.landmarks.products(texts, self.matrix) + self.bias


def train(docs: DataFrame, ridge: float = 1e-3, rows: int = ROWS, all_rows: int = ALL_ROWS, landmarks: int = LANDMARKS, all_landmarks: int = ALL_LANDMARKS) -> KernelClassifier | None:
    """Learns from rows with a language, a text and a doc_id that is not held out.

    About ``rows`` rows of each language are drawn by a hash of doc_id, fewer where there are so many languages that all
    would be more than ``all_rows``, but no language is left out. The landmarks' texts and a kernel row of at most
    ``all_landmarks`` numbers (or one a language) for each row of the sample reach the driver. None if there is no such row.
    """
    labelled = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null").where(~held_out())
    counts = saved(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    classes = counts.count()
    if not classes:
        return None
    each = min(rows, max(LEAST_ROWS, all_rows // classes))
    order = F.xxhash64(F.lit(11), "doc_id", "text")
    chance = F.shiftrightunsigned(order, 11).cast("double") / float(1 << 53)
    # a little more than is wanted, of which the first by hash are kept
    likely = labelled.join(counts, "lang").where(chance < (F.lit(each) + 4 * F.sqrt(F.lit(each)) + 8) / F.col("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", "text"))
    sample = saved(likely.select("lang", "text", place.alias("place")).where(F.col("place") <= each), "language-sample")
    marks = max(1, min(landmarks, all_landmarks // classes))
    chosen = sample.where(F.col("place") <= marks).select("lang", "place", "text").toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])
    model = Landmarks(chosen["text"].to_pylist())
    known = docs.sparkSession.sparkContext.broadcast(model)

    def compared(batches):
        claim("language_id")
        for b in batches:
            for part in _portions(b):
                k = known.value.kernel(part.column("text").to_pylist())
                ends = pa.array(np.arange(0, k.size + 1, k.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("place"), pa.ListArray.from_arrays(ends, pa.array(k.ravel()))], ["lang", "place", "k"])

    table = sample.select("lang", "place", "text").mapInArrow(compared, "lang string, place int, k array<double>").toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])
    k = table["k"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    return KernelClassifier(model, ridge).fit(k[table["place"].to_numpy() <= marks], k, table["lang"].to_pylist())


def _portions(batch: pa.RecordBatch, text: str = "text"):
    """Consecutive rows of a batch with about AT_ONCE characters."""
    at, size = 0, 0
    for i, s in enumerate(batch.column(text)):
        size += len(s.as_buffer()) if s.is_valid else 0
        if size >= AT_ONCE or i - at >= 1023:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _named(model: KernelClassifier | None, texts: list[str | None], sharpness: float) -> tuple[list[str], list[float]]:
    """The class and its share for each of a few texts."""
    names, shares = [UNKNOWN] * len(texts), [0.0] * len(texts)
    lettered = [i for i, t in enumerate(texts) if has_letter(t)]
    if model is not None and lettered:
        s = model.scores([texts[i] for i in lettered])
        best = s.argmax(1)
        p = 1 / np.exp(sharpness * (s - s.max(1, keepdims=True))).sum(1)
        for k, i in enumerate(lettered):
            names[i], shares[i] = model.classes[best[k]], min(1.0, float(p[k]))
    return names, shares


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: KernelClassifier | None, sharpness: float = 4.0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text; other columns are no inputs).

    Whole texts. lang_pred is the class with the largest decision value, the first by name of equal ones; score is its
    share of a softmax of the decision values. A null text, one without a letter, and any text under no model give
    ``und`` and 0. Repeated rows and null doc_ids (held out) each give a row; an empty table none.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        claim("language_id")
        for b in batches:
            for part in _portions(b):
                names, shares = _named(known.value, part.column("text").to_pylist(), sharpness)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(scored, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: KernelClassifier | None, sharpness: float = 4.0) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in whose text predict() finds a language.

    Each row is decided by its own text, whatever its doc_id: null texts and those without a letter go. Without a model
    nothing can be told apart, and every text with a letter stays. Repeated rows stay; an empty table gives none.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches):
        claim("language_id")
        for b in batches:
            for part in _portions(b):
                texts = part.column("text").to_pylist()
                if known.value is None:
                    ok = [has_letter(t) for t in texts]
                else:
                    ok = [n != UNKNOWN for n in _named(known.value, texts, sharpness)[0]]
                yield part.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def identify(docs: DataFrame, **params) -> DataFrame:
    """predict() with a model that train() learns from the same table, if it has labels (lang)."""
    return predict(docs, train(docs, **params) if "lang" in docs.columns else None)
