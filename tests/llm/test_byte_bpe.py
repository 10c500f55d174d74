import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from barloom.llm import byte_bpe


@pytest.fixture(scope="module")
def reference():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.text(max_size=60))
def test_any_text(reference, text):
    ids = byte_bpe.load().encode(text)
    assert ids == reference.encode_ordinary(text)
    assert byte_bpe.load().decode(ids) == text.encode()


def test_white_space_and_long_runs(reference):
    rnd, bpe = random.Random(1), byte_bpe.load()
    parts = ["  ", " ", "\n", "\t ", "\r\n", "'s", "'re", "the", " The", "é", "漢字", "😀", "12", "...", "\x1c", "\x85", "　", "x" * 30]
    for _ in range(2000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert bpe.encode(text) == reference.encode_ordinary(text)
    for text in ("a" * 5000, "ab" * 3000, " " * 999, "xyzzy" * 999, "0" * 1111, "<|endoftext|>"):
        assert bpe.encode(text) == reference.encode_ordinary(text)


def test_new_chunks_are_split_together(reference):
    bpe, calls = byte_bpe.load(remembered=byte_bpe.REMEMBERED + 1), []
    find = bpe.find
    bpe.find = lambda text: calls.append(text) or find(text)
    text = "one " + " ".join(f"w{i}-x{i},\ny" for i in range(3000))
    assert bpe.encode(text) == reference.encode_ordinary(text)
    assert len(calls) <= 2


def test_groups_of_texts_and_little_memory(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "TOGETHER", 60)
    monkeypatch.setattr(byte_bpe, "GATHERED", 5)
    rnd, bpe = random.Random(2), byte_bpe.load(remembered=20_000)
    parts = [" ", "  ", "\n", " \n", " the", "the", "'ll", " é", "漢", "x" * 70, " " + "ab" * 40, " 12", "-", "\x1c", "\u3000", ""]
    texts = ["".join(rnd.choice(parts) + "abc"[: rnd.randint(0, 3)] * rnd.randint(0, 2) for _ in range(rnd.randint(0, 20))) for _ in range(3000)]
    for text, ids in zip(texts, bpe.encode_all(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_another_pattern():
    pattern = r" ?\p{Lu}\p{Ll}*| ?\p{Ll}+|\d+ \d+|."
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.load(pattern=pattern)
    for text in ("a camelCase wordList", "12 34 5", " x", ""):
        assert bpe.encode(text) == other.encode_ordinary(text)


def test_documents(spark, reference):
    rows = [(1, "Hello  world\n", "en", 0), (2, None, None, 0), (3, "", "en", 1), (None, "çava " * 50, "fr", 1), (1, "Hello  world\n", "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, n_tokens int")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encode_documents(df, digests=True).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i or -1, len(ids := reference.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, _, _ in rows)
    assert got == want
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(df))
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((i or -1, t or "") for i, t, _, _ in rows)
    assert byte_bpe.encode_documents(df.limit(0)).count() == 0
