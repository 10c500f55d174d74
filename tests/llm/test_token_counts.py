import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from barloom.llm import token_counts


def exact(vocabulary, byte_fallback):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.SPACE, prepend_scheme="always")
    return t


def test_production_vocabulary():
    vocabulary = token_counts.read_vocabulary("piece_bpe_32k.model")
    reference, counter, rnd = exact(vocabulary, True), token_counts.load(), random.Random(2)
    letters = [chr(i) for i in range(0x300)] + list(" \n\t　漢字😀▁") + [" "] * 100 + list("theraning") * 20
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        assert counter.count(text) == len(reference.encode(text, add_special_tokens=False).ids), text


@pytest.mark.parametrize("scores", [(-3.1, -2.0, -2.2, -4.2, -5.1, -4.0), (-1.0, -1.0, -1.0, -2.0, -2.0, -2.0)])
def test_ties_and_unknown_without_bytes(scores):
    vocabulary = [("<unk>", 0.0), *zip(("▁", "a", "b", "ab", "▁a", "bc"), scores, strict=True)]
    reference, counter, rnd = exact(vocabulary, False), token_counts.UnigramCounter(vocabulary), random.Random(3)
    for _ in range(2000):
        text = "".join(rnd.choice("abcxy ▁") for _ in range(rnd.randint(0, 14)))
        assert counter.count(text) == len(reference.encode(text).ids), text


def test_documents(spark):
    rows = [(1, "the cat sat", 5), (2, None, 5), (3, "", 5), (None, "x" * 5000, 5), (1, "the cat sat", 5)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    counter = token_counts.load()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_chars) for r in got) == sorted((i or -1, counter.count(t or ""), len(t or "")) for i, t, _ in rows)
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_memory_does_not_follow_long_words():
    import tracemalloc

    counter = token_counts.load()
    word = "ab3é" * 500_000
    tracemalloc.start()
    n = counter.count(word)
    assert tracemalloc.get_traced_memory()[1] < 50 << 20 and n > 100_000
    tracemalloc.stop()
    assert counter.count("ab3é" * 50 + " ") == counter.count("ab3é" * 50) + counter.count(" ")
