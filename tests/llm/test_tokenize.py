import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataq.llm import tokenize

PIECES = [" ", "  ", "\n", "\t\n ", "'re", "'", "'l", "l", "word", " Word", "123", "日本語", "。", "é", "é", "🎉", "!!", "...", "<|endoftext|>", " ", "्", "한국", "слово", "a" * 40, " " * 30]


def whole(text):
    """Direct encoding by another library with the same vocabulary."""
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(whole, "t"):
        whole.t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        whole.t.encode_special_tokens = True
    return whole.t.encode(text, add_special_tokens=False).ids if text else []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60).map("".join), st.integers(1, 24))
def test_tree_equals_direct_encoding(text, leaf):
    assert tokenize.encode_all([text], leaf=leaf) == [whole(text)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120), st.integers(1, 16))
def test_any_text_and_round_trip(text, leaf):
    ids = tokenize.encode_all([text], leaf=leaf)[0]
    assert ids == whole(text)
    assert tokenize.decode([ids[:3], ids[3:]]) == text


def test_window_of_one_character_still_stabilises():
    rng = random.Random(5)
    enc = tokenize._encoder(None)
    for _ in range(300):
        a, b = ("".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(2))
        parts = tokenize.Part(0, len(a), whole(a)), tokenize.Part(len(a), len(a + b), whole(b))
        assert tokenize.join(enc, a + b, *parts, window=1).ids == whole(a + b)


def test_long_texts_without_spaces():
    for text in ("字" * 9001, "a" * 9001, " " * 9001, "ab " * 5000, "한" * 9001):
        assert tokenize.encode_all([text], leaf=512) == [whole(text)]


def test_texts_at_the_leaf_size():
    rng = random.Random(7)
    for n in (tokenize.LEAF_CHARS - 1, tokenize.LEAF_CHARS, tokenize.LEAF_CHARS + 1, 3 * tokenize.LEAF_CHARS, 50_000):
        text = "".join(rng.choices(PIECES, k=n))[:n]
        assert tokenize.encode_all([text]) == [whole(text)]


@pytest.mark.parametrize("counts_only", [False, True])
def test_rows(spark, counts_only):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello world", "x"), (4, "x " * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(map(tuple, tokenize.encode_texts(df, "doc_id", "text", counts_only=counts_only).collect()))
    want = sorted((i, len(whole(t)) if counts_only else whole(t)) for i, t, _ in rows)
    assert got == want
    assert tokenize.encode_texts(df.limit(0), "doc_id", "text").count() == 0
