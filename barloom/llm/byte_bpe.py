"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over text finds every vocabulary entry of a
pre-token; of short ones, only those that begin where a token may. Encoding goes left to right and takes the longest
match; a token may follow another one only if merging would keep the two apart, which is memoised for every pair met.
Where no match may follow, the encoder goes a step back and takes the next shorter match; ends that have failed are
never tried again, so the time is linear in the text. The result is that of the merges in rank order, exactly.

Texts are taken a group at a time: chunks that are not remembered are gathered, each once, and split together.
"""

from __future__ import annotations

import base64
import hashlib
import os
from array import array
from functools import lru_cache
from itertools import batched

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Remembered, claim, slices

#: Bytes of chunks, pre-tokens and compatible pairs that a worker remembers, about; the older half of each is dropped when it is full.
REMEMBERED = 256 << 20
#: Characters of texts that are encoded together, about.
TOGETHER = 1 << 20
#: New chunks that are split together, at most.
GATHERED = 1 << 15
#: Bytes of a pre-token up to which matches are looked up where they are needed.
SHORT = 64


def _remember(known: Remembered, new: dict[str, bytes]) -> None:
    """Puts in what is new but for the long ones."""
    for part in batched(new.items(), 1024):
        part = [x for x in part if len(x[0]) < 64]
        known.put_all(part, sum([180 + 2 * len(w) + len(c) for w, c in part]))


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED, cut: bool = False):
        """cut: whether no match of the pattern goes on from a visible character to white space, a single space before a
        visible one begins a match, and matches cover the text; else texts are not cut into chunks."""
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        size = max(ranks.values(), default=-1) + 1
        #: by the longest beginning that some token shares, the longest token it begins with
        self._begins: dict[str, int | None] = {}
        self._lengths = [0] * size
        # the longest entry that is a proper prefix of the token
        self._shorter: list[int | None] = [None] * size
        for t, i in ranks.items():
            self._lengths[i] = len(t)
            self._shorter[i] = next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), None)
        #: by token, what is known of those after it
        self._fits: list[dict[int, bool]] = [{} for _ in range(size)]
        self._pairs = self._pairs_left = max(1, remembered // 5 // 100)
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.halves[i] = (i, i)
            left = self._shorter[i]
            while left is not None:
                right = ranks.get(t[len(self.tokens[left]) :])
                if right is not None and left < i and right < i and self._apart(left, right):
                    self.merged[left, right] = i
                    self.halves[i] = (left, right)
                    break
                left = self._shorter[left]
        self._cut = cut
        #: ids as 32-bit integers
        self._words: dict[str, bytes] = Remembered(3 * remembered // 10)
        self._chunks: dict[str, bytes] = Remembered(remembered // 2)
        # by id, for whole arrays of them
        self._bytes, self._decimals = np.full(size, None, object), np.full(size, None, object)
        for t, i in ranks.items():
            self._bytes[i], self._decimals[i] = t, str(i)

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b leaves the two tokens side by side.

        Undoes the later of both tokens' merges, again and again; a merge across the border that would have come before
        the one undone last shows that the two would not both have arisen.
        """
        limit = 1 << 62
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < limit:
                return False
            if a > b:
                limit, a = a, self.halves[a][1]
                if a == limit:
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.halves[b][0]
                if b + 1 == limit:
                    limit, a = a, self.halves[a][1]
                    if a == limit:
                        return True

    def _longest(self, text: str) -> int | None:
        """The longest token that the text begins with."""
        n = self.automaton.longest_prefix(text)
        begin = text[:n]
        if begin not in self._begins:
            self._begins[begin] = next((token for m in range(n, 0, -1) if (token := self.ranks.get(begin[:m].encode("latin-1"))) is not None), None)
        return self._begins[begin]

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of one match of the pattern."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        size, text = len(word), word.decode("latin-1")
        longest: list[int | None] = []
        if size > SHORT:
            longest = [None] * size
            # ends ascend, so what is written last for a start is the longest
            for end, (n, token) in self.automaton.iter(text):
                longest[end - n + 1] = token
        lengths, shorter = self._lengths, self._shorter
        prefix, begins = self.automaton.longest_prefix, self._begins
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0] if longest else self._longest(text)
        after = None  # what is known of tokens after the last one
        while True:
            while token is not None:
                end = at + lengths[token]
                if end not in dead:
                    if after is None:
                        break
                    ok = after.get(token)
                    if ok or (ok is None and self._learn(out[-1], token)):
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                if end == size:
                    return out
                at = end
                if longest:
                    token = longest[at]
                else:
                    rest = text[at:]
                    token = begins.get(rest[: prefix(rest)])
                    if token is None:
                        token = self._longest(rest)
            elif out:
                dead.add(at)
                last = out.pop()
                at -= lengths[last]
                token = shorter[last]
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
            after = self._fits[out[-1]] if out else None

    def _learn(self, a: int, b: int) -> bool:
        """Whether b may follow a, which is remembered."""
        if not self._pairs_left:
            for known in self._fits:
                known.clear()
            self._pairs_left = self._pairs
        self._pairs_left -= 1
        ok = self._fits[a][b] = self._apart(a, b)
        return ok

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Ids of matches of the pattern."""
        known = self._words
        out = list(map(known.get, words))
        if None not in out:
            return out
        new = dict.fromkeys([w for w, c in zip(words, out) if c is None])
        older = known.older.get
        for w in new:
            new[w] = older(w) or array("i", self.encode_word(w.encode())).tobytes()
        _remember(known, new)
        return [new[w] if c is None else c for w, c in zip(words, out)]

    def _learn_chunks(self, new: dict[str, bytes]) -> None:
        """Puts in the ids of chunks that are given without the space before them."""
        # a match that begins with a space begins a chunk, as chunks hold no other space
        words = self.find(" " + " ".join(new))
        ids = self._encoded(words)
        starts = [i for i, w in enumerate(words) if w[0] == " "]
        for x, a, b in zip(list(new), starts, [*starts[1:], len(words)], strict=True):
            new[x] = ids[a] if b == a + 1 else b"".join(ids[a:b])
        _remember(self._chunks, new)

    def encode_all(self, texts):
        """Yields the ids of each text. Texts are cut before each single space that follows a visible character, as no
        match of the pattern goes over that place; chunks that recur are looked up without that space."""
        held: list[tuple[list[str], list[bytes | None], list[int]]] = []
        new: dict[str, bytes] = {}
        chunks, chars = self._chunks, 0
        for text in texts:
            pieces = text.split(" ") if self._cut else [text]
            found = list(map(chunks.get, pieces))
            found[0] = None  # no space is before it
            gaps, after = [], 0
            for i in [i for i, c in enumerate(found) if c is None]:
                if i < after:
                    continue
                x = pieces[i]
                if i and x and not x[-1].isspace():
                    c = found[i] = chunks.get(x)
                    if c is None:
                        c = found[i] = chunks.older.get(x)
                        if c is not None:
                            chunks.put(x, c, 180 + 2 * len(x) + len(c))
                        else:
                            new[x] = b""
                            gaps.append(i)
                            if len(new) >= GATHERED:  # of a long text
                                self._fill([*held, (pieces, found, gaps)], new)
                    continue
                # the first piece, or white space up to the next visible character and what follows it
                after = i + 1
                while after < len(pieces) and (not pieces[after - 1] or pieces[after - 1][-1].isspace()):
                    found[after] = b""
                    after += 1
                found[i] = b"".join(self._encoded(self.find(" " * (i > 0) + " ".join(pieces[i:after]))))
            held.append((pieces, found, gaps))
            chars += len(text)
            if chars >= TOGETHER:
                self._fill(held, new)
                yield from [np.frombuffer(b"".join(found), np.int32) for _, found, _ in held]
                held, chars = [], 0
        self._fill(held, new)
        yield from [np.frombuffer(b"".join(found), np.int32) for _, found, _ in held]

    def _fill(self, held, new: dict[str, bytes]) -> None:
        """Fills the gaps of texts with what is new, and empties both."""
        if new:
            self._learn_chunks(new)
        for pieces, found, gaps in held:
            for i in gaps:
                found[i] = new[pieces[i]]
            gaps.clear()
        new.clear()

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def digits(self, ids: np.ndarray) -> str:
        """The decimals of ids, joined by one space."""
        return " ".join(self._decimals[ids].tolist())

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, np.int32)
        if len(ids) and ids.min() < 0:
            raise KeyError(int(ids.min()))
        return b"".join(self._bytes[ids].tolist())


def _place(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def load(vocabulary: str = "byte_bpe_50k.tiktoken", pattern: str | None = None, remembered: int = REMEMBERED) -> ByteBPE:
    """A rank file by its path, or by its name among the installed public tokenizers."""
    cut = pattern is None
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(_place(vocabulary), "rb") as f:
        ranks = {base64.b64decode(t): int(i) for t, i in (x.split() for x in f if x.strip())}
    return ByteBPE(ranks, pattern, remembered, cut)


def encode_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", pattern: str | None = None, digests: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, n_tokens, token_ids) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Whole texts are encoded without special tokens; a null text counts as empty and gives no tokens. With ``digests``
    the ids are decoded again and (doc_id, n_tokens, ids_sha256, decoded_sha256) is returned: SHA-256 of the decimal ids
    joined by one space and of the decoded bytes. Repeated rows and null doc_ids each give a row; an empty table none.
    """

    def encoded(batches):
        claim("byte_bpe", load.cache_clear)
        bpe = load(vocabulary, pattern, remembered)
        # rows of very long texts make large lists; they are sent on in small batches
        for part in slices(batches, 256):
            counts, ids_out, ids_sha, text_sha = [], [], [], []
            for ids in bpe.encode_all(text or "" for text in part.column("text").to_pylist()):
                counts.append(len(ids))
                if digests:
                    ids_sha.append(hashlib.sha256(bpe.digits(ids).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                else:
                    ids_out.append(ids)
            own = [part.column("doc_id"), pa.array(counts, pa.int64())]
            if digests:
                yield pa.RecordBatch.from_arrays([*own, pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids_out) if ids_out else np.zeros(0, np.int32)))], ["doc_id", "n_tokens", "token_ids"])

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "token_ids array<int>")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encoded, schema)


def decode_documents(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids). Bytes that are no UTF-8 become U+FFFD; null ids give a null text."""

    def decoded(batches):
        claim("byte_bpe", load.cache_clear)
        bpe = load(vocabulary)
        for b in batches:
            texts = [None if ids is None else bpe.decode(ids).decode("utf-8", "replace") for ids in b.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(decoded, "doc_id long, text string")
