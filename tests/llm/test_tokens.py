"""Problem 8: ids against two public implementations of the same vocabulary, and the queue on its own."""

import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tracewright.llm import tokens as tk

RAW = tk.vocabulary_bytes()
MINE = tk.Encoder(RAW)


@pytest.fixture(scope="module")
def theirs():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
    return tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "hello world", "<|endoftext|>", "a" * 3000, "ab" * 2000, "我们的" * 700, " \n\n\t x", "don't we'll I'VE", "12345 6.78", "é́\u0000🙂👩‍💻", "\r\n" * 50, "ß" * 100 + "x"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids(theirs, text):
    assert MINE.encode(text) == theirs.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    import tiktoken  # noqa: F401

    ids = MINE.encode(text)
    assert b"".join(MINE.words[i] for i in ids) == text.encode("utf-8", "replace")


def test_random_bytes_of_letters(theirs):
    rng = random.Random(2)
    for _ in range(200):
        s = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(400)))
        assert MINE.encode(s) == theirs.encode_ordinary(s)


def test_the_quick_pattern_is_taken_only_where_both_agree():
    import re
    import unicodedata

    import regex

    letter, number, space = (regex.compile(p).match for p in (r"\p{L}", r"\p{N}", r"\s"))
    letter2, number2, space2 = (re.compile(p).match for p in (r"[^\W\d_]", r"\d", r"\s"))
    chars = [chr(i) for i in range(0x20000) if MINE.plain(chr(i))]
    assert len(chars) > 20_000 and not any(c in chars for c in "²½ⅷ〇①\x1c")
    for c in chars:
        assert (bool(letter(c)), bool(number(c)), bool(space(c))) == (bool(letter2(c)), bool(number2(c)), bool(space2(c))), (hex(ord(c)), unicodedata.category(c))
    rng = random.Random(4)
    pick = "ab'sdm tlr_1٣9é中文、。 \n\t\u3000.-\u200d🙂"
    for _ in range(3000):
        t = "".join(rng.choice(pick) for _ in range(rng.randrange(30)))
        assert MINE.split(t) == MINE.exact(t)
        assert MINE.count(t) == len(MINE.encode(t))


def test_queue_order():
    rng, q, want = random.Random(1), tk.RankQueue(), {}
    for i in range(5000):
        r = rng.randrange(50256)
        q.push(r, i)
        want.setdefault(r, []).append(i)
    got = []
    while (x := q.pop()) is not None:
        got.append(x)
    assert got == sorted(want.items())


def test_documents(spark):
    rows = [(1, "hello world", "x"), (2, None, None), (3, "", "x"), (1, "hello world", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in tk.encode(df).collect())
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert tk.encode(df.limit(0)).count() == 0
    assert {r.doc_id: r.tokens for r in tk.token_counts(df).collect()} == {1: 2, 2: 0, 3: 0}
    assert {r.token: r.occurrences for r in tk.statistics(tk.encode(df)).collect()} == {31373: 2, 995: 2}
