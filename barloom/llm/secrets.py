"""Secret scans: fixed patterns, and a linear-chain conditional random field over words that adds what they miss.

Words (runs between spaces) are tagged begin, inside or outside from their shape, their neighbours and features of the
whole text; Viterbi decoding finds the best tags. The model learns here, on a bounded sample whose labels are the fixed
patterns' finds. So that it learns more than the patterns, some finds are shown without what the patterns go by (keywords,
prefixes), found values are also shown alone among other words, and look-alikes that are no secrets are mixed in. A word's scores are looked up by its form, so a text costs a few array operations; Viterbi itself only
runs where a word is not bound to be outside: if ``outside`` leads by more than all that transitions could make up, every
best path goes through it, and the chain falls apart there without loss.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import claim, saved

KINDS = ["assign", "access", "hex", "crf"]
KEYWORD = re.compile(r"(?ai:password|passwd|secret|token|api_?key)")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
#: Whole runs, as a greedy match starts at a run's first character; shorter ones, which are dropped anyway, are passed over.
HEX = re.compile("[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Forms of words remembered by a worker; rows sampled for training, windows kept of them, and words on either side.
REMEMBERED, SAMPLE, WINDOWS, SIDE = 300_000, 16_000, 6_000, 5
#: Places of a word's features, and of the text's, that tell which pattern found it.
GIVEAWAYS, TEXT_GIVEAWAYS = (29, 30), (1, 2)
B, I, O = 0, 1, 2  # noqa: E741

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """By the fixed patterns: leftmost, non-overlapping per kind; sorted by start, then kind."""
    out = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out)


def shape(word: str) -> np.ndarray:
    """Features of a word's form."""
    core = word.strip("\"'.,;:()[]{}<>")
    n = len(core)
    digits, upper, lower = sum(c.isdigit() for c in core), sum(c.isupper() for c in core), sum(c.islower() for c in core)
    counts = Counter(core).values()
    entropy = -sum(c / n * math.log2(c / n) for c in counts) if n else 0.0
    mixed = digits and (upper or lower)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:], strict=False))
    return np.array([
        1, n == 0, 0 < n <= 3, 4 <= n <= 7, 8 <= n <= 11, 12 <= n <= 15, 16 <= n <= 23, 24 <= n <= 39, n >= 40,
        digits > 0, n > 0 and digits == n, n > 0 and digits / n > 0.2, bool(mixed), bool(upper and lower and digits), n > 0 and upper == n, n > 1 and core[:1].isupper() and lower > 0,
        n >= 8 and bool(mixed) and entropy > 2.5, n >= 12 and bool(mixed) and entropy > 3.0, n >= 16 and entropy > 3.5, n >= 20 and entropy > 4.0,
        n >= 12 and all(c in "0123456789abcdef" for c in core), turns >= 3, turns >= 8,
        "=" in word, ":" in word, word in ("=", ":", ":="), word[-1:] in ("=", ":"), "\n" in word, not word.isascii(),
        KEYWORD.search(word) is not None, word.startswith("AKIA"), any(c in core for c in "_-/+"), "://" in word, "@" in word, word[:1] in "\"'" and n > 0, any(c in word for c in "*%$#&"),
    ], np.float32)


_STRIPPED = "\"'.,;:()[]{}<>"
_HEX = frozenset("0123456789abcdef")
_MARKS = frozenset("=:_-/+@*%$#&\"'")


def form(word: str) -> tuple | None:
    """What decides a short digit-free word's shape, so that few shapes are worked out; None for other words."""
    core = word.strip(_STRIPPED)
    n = len(core)
    alpha = core.isalpha()
    if n >= 16 or not (alpha or word.isascii()) or (not alpha and any(c in word for c in "0123456789")):
        return None
    return (n, alpha and core.isupper(), n > 1 and core[0].isupper() and core != core.upper(), word.isascii(), KEYWORD.search(word) is not None, _MARKS.intersection(word), word[-1:] in ("=", ":"), word[:1] in "\"'", word in ("=", ":", ":="), "://" in word, word.startswith("AKIA"), n >= 12 and _HEX.issuperset(core))


N_SHAPE = len(shape("x"))
#: A word's features: its own form, those of the word before, the one before that and the one after; then the text's.
N_TEXT = 4
N_FEATURES = 4 * N_SHAPE + N_TEXT


def text_features(text: str) -> np.ndarray:
    low = text.lower()
    return np.array([len(text) > 2000, any(x in low for x in ("passw", "secret", "token", "api")), "AKIA" in text, "://" in text], np.float32)


def split_words(text: str) -> list[str]:
    """At single blanks; the words and a blank after each give the text's length again."""
    return text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")


def gold_tags(words: list[str], spans: list[Span]) -> np.ndarray:
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    tags = np.full(len(words), O)
    for s, _, e in sorted(spans):
        hit = np.flatnonzero((starts < e) & (ends > s))
        hit = hit[tags[hit] == O]
        if len(hit):
            tags[hit] = I
            tags[hit[0]] = B
    return tags


class TaggingModel:
    """weights: N_FEATURES x 3; transitions: 3 x 3, from row to column."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights.astype(np.float64), transitions.astype(np.float64)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, mask: np.ndarray, turns: int = 150, rate: float = 0.1, l2: float = 1e-4) -> TaggingModel:
        """Maximum likelihood by Adam. x: windows x words x features; y: tags; mask: which words there are (a prefix)."""
        n, size, f = x.shape
        w, t = np.zeros((f, 3)), np.zeros((3, 3))
        w[0] = (-1, -1, 1)
        hot = np.eye(3)[y] * mask[..., None]
        gold_t = np.einsum("nai,naj->ij", hot[:, :-1], hot[:, 1:] * mask[:, 1:, None])
        flat = x.reshape(-1, f).astype(np.float64)
        m = [np.zeros_like(w), np.zeros_like(t)]
        v = [np.zeros_like(w), np.zeros_like(t)]
        total = mask.sum()
        lse = lambda a, axis: (top := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - top).sum(axis))
        for turn in range(1, turns + 1):
            e = (flat @ w).reshape(n, size, 3)
            ahead, back = np.empty_like(e), np.zeros_like(e)
            ahead[:, 0] = e[:, 0]
            for k in range(1, size):
                step = lse(ahead[:, k - 1, :, None] + t, 1) + e[:, k]
                ahead[:, k] = np.where(mask[:, k, None], step, ahead[:, k - 1])
            for k in range(size - 2, -1, -1):
                step = lse(t + (e[:, k + 1] + back[:, k + 1])[:, None, :], 2)
                back[:, k] = np.where(mask[:, k + 1, None], step, 0)
            z = lse(ahead[:, -1], 1)
            p = np.exp(ahead + back - z[:, None, None]) * mask[..., None]
            pair = np.exp(ahead[:, :-1, :, None] + t + (e + back)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            grads = [flat.T @ (p - hot).reshape(-1, 3) / total + l2 * w, (pair.sum((0, 1)) - gold_t) / total + l2 * t]
            for k, (param, g) in enumerate(zip((w, t), grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                param -= rate * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)
        return cls(w, t)

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        best, back = e[0], np.zeros((len(e), 3), np.int64)
        for k in range(1, len(e)):
            step = best[:, None] + self.transitions
            back[k] = step.argmax(0)
            best = step.max(0) + e[k]
        tags = np.empty(len(e), np.int64)
        tags[-1] = best.argmax()
        for k in range(len(e) - 1, 0, -1):
            tags[k - 1] = back[k, tags[k]]
        return tags

    def decode(self, e: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Best tags for rows of word scores, as (place, tags) of the stretches that are not bound to be outside."""
        slack = 2 * (self.transitions.max() - self.transitions.min())
        free = np.flatnonzero(e[:, O] - np.maximum(e[:, B], e[:, I]) <= slack)
        if not len(free):
            return []
        cut = np.flatnonzero(np.diff(free) > 1) + 1
        out = []
        for run in np.split(free, cut):
            # with the bound words on either side, which are outside
            i, j = max(0, run[0] - 1), min(len(e), run[-1] + 2)
            out.append((i, self.viterbi(e[i:j])))
        return out


class Scanner:
    """A model with the scores of the words met so far."""

    def __init__(self, model: TaggingModel | None):
        self.model = model
        self._place: dict[str, int] = {}
        self._forms: dict[tuple, int] = {}
        self._used = 0
        self._scores = np.zeros((1024, 4, 3))

    def _of(self, word: str) -> int:
        key = form(word)
        if key is not None and (at := self._forms.get(key)) is not None:
            self._place[word] = at
            return at
        at = self._place[word] = self._used
        self._used += 1
        if key is not None:
            self._forms[key] = at
        if at >= len(self._scores):
            self._scores = np.concatenate([self._scores, np.zeros_like(self._scores)])
        w = self.model.weights[: 4 * N_SHAPE].reshape(4, N_SHAPE, 3)
        self._scores[at] = np.einsum("f,kft->kt", shape(word), w)
        return at

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans that the model tags and that touch none of the base's."""
        if self.model is None or not text:
            return []
        words = split_words(text)
        if len(self._place) + len(words) >= REMEMBERED:
            # not within a text, whose own words would lose their places
            self._place.clear()
            self._forms.clear()
            self._used = 0
        place = self._place
        at = np.fromiter([p if (p := place.get(w)) is not None else self._of(w) for w in words], np.int64, len(words))
        s = self._scores[at]
        e = s[:, 0].copy()
        e[1:] += s[:-1, 1]
        e[2:] += s[:-2, 2]
        e[:-1] += s[1:, 3]
        e += text_features(text) @ self.model.weights[4 * N_SHAPE :]
        out = []
        stretches = self.model.decode(e)
        if not stretches:
            return out
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        for first, tags in stretches:
            k = 0
            while k < len(tags):
                if tags[k] == O:
                    k += 1
                    continue
                j = k + 1
                while j < len(tags) and tags[j] == I:
                    j += 1
                start, end = int(ends[first + k] - len(words[first + k])), int(ends[first + j - 1])
                piece = text[start:end]
                start += len(piece) - len(piece.lstrip(" \t\r\n\"'([{<"))
                end -= len(piece) - len(piece.rstrip(" \t\r\n\"'.,;:)]}>"))
                if start < end and all(e0 <= start or s0 >= end for s0, _, e0 in base):
                    out.append((start, 3, end))
                k = j
        return out

    def spans(self, text: str | None) -> list[Span]:
        base = base_spans(text or "")
        return sorted(base + self.added(text or "", base))


def look_alikes(words: list[str], mark: int) -> list[str]:
    """Words with digits, signs or capitals that are no secrets, made from a text's own words and a number."""
    plain = [w for w in words if w.isalpha() and w.isascii() and 3 <= len(w) <= 12][:50] or ["page", "item"]
    one, two = plain[mark % len(plain)].lower(), plain[(mark >> 8) % len(plain)].lower()
    n = mark >> 16
    return [
        f"{one}.{two}{n % 100}@{two}.com", f"{one}.{n % 100:02d}@{two}{n % 10}.{one}.com", f"{one}{two}.{n % 100:02d}@mail{n % 10}.{two}.org", f"{two}{n % 1000}@{one}{n % 100}.net", f"https://www.{one}.org/{two}/{n % 10**6}", f"https://{two}.net/{one}?id={n % 10**8}&page=2", f"{one}_{two}_{n % 1000}",
        f"{1990 + n % 40}-{1 + n % 12:02d}-{1 + n % 28:02d}T{n % 24:02d}:{n % 60:02d}:00Z", f"+{1 + n % 90}-{n % 10**3:03d}-{n % 10**7:07d}", f"v{n % 20}.{n % 7}.{n % 30}-rc{n % 5}",
        f"{one.capitalize()}{two.capitalize()}{n % 100}", f"/usr/{one}/{two}{n % 10}.txt", f"{n % 256}.{n % 250}.{n % 240}.{n % 230}", f"{n % 10**12:012d}", f"{n % 16**7:07x}", f"{one}-{two}-{n % 10**4}", f"#{n % 10**5}", f"${n % 10**4}.{n % 100:02d}",
        f"{one.upper()}-{n % 10**4}", f"{one}={two}", f"{one}:{n % 100}", f"{n % 16**8:08x}-{n % 16**4:04x}-4{n % 16**3:03x}-a{n % 16**3:03x}-{n % 16**12:012x}",
    ]


def respelled(value: str) -> list[str]:
    """The value, and random ones made from it in other alphabets and lengths."""
    raw = hashlib.sha512(value.encode()).digest()
    cut = lambda text, k: text[: 16 + raw[k] % 33].strip("-_=")
    return [value, cut(base64.b64encode(raw).decode(), 0), cut(base64.b32encode(raw).decode(), 1), cut(base64.urlsafe_b64encode(raw[::-1]).decode(), 2), cut(raw.hex().upper(), 3)]


def _values(text: str, spans: list[Span]) -> list[str]:
    """Found values that look random, without keyword."""
    out = []
    for s, kind, e in spans:
        v = ASSIGN.match(text, s)[2] if kind == 0 else text[s:e]
        if len(v) >= 10 and any(c.isdigit() for c in v) and any(c.isalpha() for c in v):
            out.append(v)
    return out


def window(words: list[str], tags, centre: int, extra: np.ndarray, hide: bool) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, features, tags) of SIDE words before a word and SIDE + 2 after; ``hide`` blanks what patterns go by."""
    lo, hi = max(0, centre - SIDE), min(len(words), centre + SIDE + 3)
    near = [shape(w) for w in words[max(0, lo - 2) : hi + 1]]
    get = lambda k: near[k - max(0, lo - 2)] if max(0, lo - 2) <= k < max(0, lo - 2) + len(near) else np.zeros(N_SHAPE, np.float32)
    x = np.zeros((2 * SIDE + 3, N_FEATURES), np.uint8)
    for k in range(lo, hi):
        x[k - lo] = np.concatenate([get(k), get(k - 1), get(k - 2), get(k + 1), extra])
    if hide:
        x[:, [g + r * N_SHAPE for g in GIVEAWAYS for r in range(4)] + [4 * N_SHAPE + g for g in TEXT_GIVEAWAYS]] = 0
    y = np.full(2 * SIDE + 3, O, np.uint8)
    y[: hi - lo] = tags[lo:hi]
    return hi - lo, x, y


def windows_of(text: str):
    """Stretches of a text to learn from: (mark, found, words, features, tags)."""
    words = split_words(text)
    spans = base_spans(text)
    tags = gold_tags(words, spans)
    mark = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")
    extra = text_features(text)
    at = mark % len(words)
    yield mark, False, *window(words, tags, at, extra, False)
    for k, i in enumerate(np.flatnonzero(tags == B)[:4]):
        yield mark + 7919 * int(i), True, *window(words, tags, int(i), extra, bool((mark >> k) & 1))
    # a stretch without finds, into which values and look-alikes are put
    lo, hi = max(0, at - 8), min(len(words), at + 9)
    if (tags[lo:hi] == O).all():
        around, middle = words[lo:hi], at - lo
        for k, v in enumerate(w for value in _values(text, spans)[:1] for w in respelled(value)):
            yield mark + 15485863 * (k + 1), True, *window(around[:middle] + [v] + around[middle:], [O] * middle + [B] + [O] * (len(around) - middle), middle, extra * 0, True)
        others = look_alikes(words, mark)
        for k in range(2):
            w = others[(mark >> 5 * k) % len(others)]
            yield mark + 32452843 * (k + 1), False, *window(around[:middle] + [w] + around[middle:], [O] * (len(around) + 1), middle, extra, bool(k))


def train(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS, skip: str | None = None) -> TaggingModel | None:
    """Learns from about ``sample`` rows drawn by a hash, of which at most ``windows`` stretches of words reach the driver.

    Half of the stretches, at most, have a secret; each half is drawn by hash. ``skip`` leaves out texts with base finds
    of that kind, to measure how the model does on what it hasn't seen. None without any base find in the sample: nothing
    is added then.
    """
    total = docs.count()
    rate = min(1.0, sample / max(1, total))
    draw = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(salt), "text"), 11).cast("double") / float(1 << 53)
    drawn = docs.select("text").where(F.col("text").isNotNull() & (draw(3) < rate))
    size = 2 * SIDE + 3

    def cut(batches):
        for b in batches:
            out = {"order": [], "found": [], "n": [], "x": [], "y": []}
            for text in b.column("text").to_pylist():
                if skip is not None and any(KINDS[k] == skip for _, k, _ in base_spans(text)):
                    continue
                for mark, found, n, x, y in windows_of(text):
                    for c, v in zip(out, (mark & (1 << 53) - 1, found, n, np.packbits(x).tobytes(), y.tobytes()), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("order", pa.int64()), ("found", pa.bool_()), ("n", pa.int32()), ("x", pa.binary()), ("y", pa.binary())]))

    got = saved(drawn.mapInArrow(cut, "order long, found boolean, n int, x binary, y binary"), "stretches")
    half = lambda cond: got.where(cond).orderBy("order", "n", "x").limit(windows // 2)
    rows = half("found").union(half("NOT found")).toArrow().to_pylist() if windows else []
    if not any(r["found"] for r in rows):
        return None
    width = size * N_FEATURES
    x = np.unpackbits(np.frombuffer(b"".join(r["x"] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)[:, :width].reshape(len(rows), size, N_FEATURES)
    y = np.frombuffer(b"".join(r["y"] for r in rows), np.uint8).reshape(len(rows), size).astype(np.int64)
    mask = np.arange(size)[None, :] < np.array([r["n"] for r in rows])[:, None]
    return TaggingModel.fit(x, y, mask)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, model: TaggingModel | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_added, base_sha256, spans) for each row of ``docs`` (doc_id, text).

    Whole texts; null counts as empty and has no span. Spans are kind:start:end in code points, by start and then kind,
    comma-joined; those of kind ``crf`` were added by the model. Repeated rows and null doc_ids each give a row; an empty
    table none; other columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def found(batches):
        claim("secrets")
        scanner = Scanner(known.value)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base = base_spans(text or "")
                spans = sorted(base + scanner.added(text or "", base))
                n = Counter(k for _, k, _ in spans)
                rows.append((n[0], n[1], n[2], n[3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "n_added", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(found, "doc_id long, n_assign long, n_access long, n_hex long, n_added long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: TaggingModel | None, mask: str = "<secret>") -> DataFrame:
    """The columns of ``docs`` with every found span of ``text`` replaced; touching or nested spans become one mask.

    n_chars, if it is there, is the new text's length. Rows without a find are passed on as they are, null texts too.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def replaced(batches):
        claim("secrets")
        scanner = Scanner(known.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, text in enumerate(texts):
                spans = scanner.spans(text)
                if spans:
                    out, at = [], 0
                    for s, _, e in spans:
                        if s >= at:
                            out += [text[at:s], mask]
                        at = max(at, e)
                    texts[i] = "".join(out) + text[at:]
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            cols["text"] = pa.array(texts, b.schema.field("text").type)
            if "n_chars" in cols:
                old = cols["n_chars"]
                cols["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in b.schema.names], schema=b.schema)

    return docs.mapInArrow(replaced, schema)
