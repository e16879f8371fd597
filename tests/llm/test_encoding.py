import array
import base64
import os
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.encoding import Encoder, encode_texts

FOLDER = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
JSON = f"{FOLDER}/byte_bpe_50k.json"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HARD = [
    "", " ", "  ", "\n", " \n ", "a", " a", "a ", "a  b", "a \n b", "\ta\t\tb ", "it's we'll I'M they'd've", "'s 't're", "<|endoftext|> x", "<|endoftext|>", "x" * 5000, "0" * 777,
    "ab" * 3000, "a b   c　d", "a\x1cb \x1d c\x85d", "​a⁠b﻿", "日本語のテキスト、です。", "Привет мир", "🚢🚢 🏳️‍🌈!", "é é ß ŉ", "½ ² Ⅳ ①", "----====____", "\x00\x07\x1b[0m", "naïve  café\r\n\r\n  x",
    " " * 300 + "x", "x" + "\n" * 200, "word " * 2000, "a'b''c'''d", "...  ...   ...",
]


@pytest.fixture(scope="module")
def reference():
    with open(f"{FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return Encoder(JSON)


def ids_of(encoder, texts):
    ends, raw = encoder.encode(texts)
    flat = array.array("i")
    flat.frombytes(raw)
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_hard_texts(encoder, reference):
    assert ids_of(encoder, HARD) == [reference.encode_ordinary(t) for t in HARD]
    other = Tokenizer.from_file(JSON)
    other.encode_special_tokens = True
    assert ids_of(encoder, HARD) == [e.ids for e in other.encode_batch(HARD, add_special_tokens=False)]


def test_runs_of_one_character(encoder, reference):
    texts = [c * n for c in "aeotrzAZ0_-=.*# \né日" for n in range(1, 70)]
    assert ids_of(encoder, texts) == [reference.encode_ordinary(t) for t in texts]


def test_every_token_and_random_neighbours(encoder, reference):
    texts = [b.decode() for b in encoder.tokens if b.isascii() and b.strip()]
    rng = random.Random(1)
    texts += ["".join(rng.choice(texts) for _ in range(rng.randint(2, 6))) for _ in range(20_000)]
    assert ids_of(encoder, texts) == [reference.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), max_size=5))
def test_any_text(encoder, reference, texts):
    assert ids_of(encoder, texts) == [reference.encode_ordinary(t) for t in texts]


def test_forgetting_changes_nothing(encoder):
    before = ids_of(encoder, HARD)
    encoder.clear()
    assert ids_of(encoder, HARD[::-1])[::-1] == before


def test_prefixes_share_nodes():
    e = Encoder(JSON)
    e.insert(b" internationally")
    n = len(e.last)
    e.insert(b" international")
    assert len(e.last) == n
    e.insert(b" internationals")
    assert len(e.last) == n + 1


def test_a_very_long_word_is_not_kept(encoder, reference):
    word = "".join(random.Random(5).choice("abcdeé日") for _ in range(300_000))
    before = len(encoder.last)
    assert ids_of(encoder, [word, "x " + word[:100_000] + " y"]) == [reference.encode_ordinary(word), reference.encode_ordinary("x " + word[:100_000] + " y")]
    assert len(encoder.last) - before < 1000


def test_null_and_empty_texts_give_empty_lists(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b", None), (3, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_texts(df, JSON).collect())
    assert got == [(1, []), (2, []), (3, [64, 275]), (3, [64, 275])]
    assert encode_texts(df.limit(0), JSON).collect() == []
