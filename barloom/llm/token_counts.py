"""Token counts under a unigram vocabulary, by a Viterbi pass that only counts.

An Aho-Corasick automaton lists every vocabulary entry of a word (a metaspace pre-token: what starts at a space or at the
text's start). The dynamic programme keeps, for each end, the best score and how many pieces it took; nothing is traced
back. Ties as in the Unigram model of the ``tokenizers`` library: paths are compared in the order of their last piece's
start, and a later one must be strictly better; a character that no one-character entry covers may become unknown, at the
least score less 10, and then counts as its UTF-8 bytes where the vocabulary has byte pieces, or joins its unknown
neighbours.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _place
from .shared import Remembered, claim

#: Bytes of words that a worker remembers, about.
REMEMBERED = 48 << 20

SPACE = "▁"
#: How far below the least score an unknown character lies: a fixed value of the tokenizer.
UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        pieces = {p for p, _ in vocabulary}
        self.longest = max(map(len, pieces))
        self.pieces = pieces
        self.bytes = byte_fallback and all(f"<0x{i:02X}>" in pieces for i in range(256))
        self._known = Remembered(REMEMBERED)

    def count_word(self, word: str) -> int:
        # best score, its number of pieces and whether it ends in an unknown character, of the last ends that a piece can begin at
        ring = self.longest + 1
        best, count, joined = [0.0] * ring, [0] * ring, [False] * ring
        hits = self.automaton.iter(word)
        hit = next(hits, None)
        for end in range(len(word)):
            own = []
            while hit is not None and hit[0] == end:
                own.append(hit[1])
                hit = next(hits, None)
            if len(own) > 1:
                own.sort(reverse=True)  # the earliest start first
            top, pieces, unknown, size = None, 0, False, 0
            for size, score in own:
                at = (end + 1 - size) % ring
                total = score + best[at]
                if top is None or total > top:
                    top, pieces = total, count[at] + 1
            if size != 1:
                at = end % ring
                total = self.unknown + best[at]
                if top is None or total > top:
                    more = len(word[end].encode("utf-8", "surrogatepass")) if self.bytes else int(not joined[at])
                    top, pieces, unknown = total, count[at] + more, True
            at = (end + 1) % ring
            best[at], count[at], joined[at] = top, pieces, unknown
        return count[len(word) % ring]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        words = text.split(SPACE)
        if text[0] == SPACE:
            words = words[1:]
        known, total = self._known, 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = known.older.get(w)
                if n is None:
                    n = self.count_word(SPACE + w)
                if len(w) < 64:
                    known.put(w, n, 160 + len(w))
            total += n
        return total


def read_vocabulary(name: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by its path or its name among the public tokenizers."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=_place(name))
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


@lru_cache(2)
def load(vocabulary: str = "piece_bpe_32k.model") -> UnigramCounter:
    return UnigramCounter(read_vocabulary(vocabulary))


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, n_tokens, n_chars) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Whole texts; null and empty ones count 0. Repeated rows and null doc_ids each give a row; an empty table none.
    """

    def counted(batches):
        claim("token_counts", load.cache_clear)
        counter = load(vocabulary)
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([counter.count(t) if t else 0 for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], ["doc_id", "n_tokens", "n_chars"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "doc_id long, n_tokens long, n_chars long")
