"""The backtracking encoder against the tokenizers library and a plain merge loop."""
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from crateloom.llm import bpe
from crateloom.llm.queries import TOKENIZERS, op11_backtracking_bpe
from conftest import SF

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def model():
    return bpe.Merges.load(PATH)


@pytest.fixture(scope="module")
def library():
    import tokenizers
    return tokenizers.Tokenizer.from_file(PATH)


def ids(model, text):
    return np.frombuffer(model.encode(text), np.int32).tolist()


def merged(pairs, data):
    """The definition: again and again the earliest merge, leftmost first."""
    rank = {p: i for i, p in enumerate(pairs)}
    parts = [bytes([b]) for b in data]
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if best is None:
            return parts
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    import tokenizers
    model, library = _pair(tokenizers)
    assert ids(model, text) == library.encode(text, add_special_tokens=False).ids


_kept = {}


def _pair(tokenizers):
    if not _kept:
        _kept["pair"] = bpe.Merges.load(PATH), tokenizers.Tokenizer.from_file(PATH)
    return _kept["pair"]


def test_texts_of_parts_that_merge(model, library):
    rng = random.Random(5)
    parts = ["a", "aa", "ab", "th", "e", "ing", "  ", "\n", "\t", "é", "中", "\U0001F600", "1", "22", "!", "'s", "'ll", "<|endoftext|>", "<|endo", "Ġ", "\x00",
             "　", "\x1c", "\x85", "_", "--", "===", "ɐ"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(model, text) == want
        assert model.decode(np.array(want, np.int32)) == library.decode(want, skip_special_tokens=False) == text


def test_every_code_point_is_cut_as_the_library_cuts_it(model, library):
    for first in range(0, 0x110000, 4096):
        points = [chr(c) for c in range(first, first + 4096) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}!{c} {c}" for c in points)
        if text:
            assert ids(model, text) == library.encode(text, add_special_tokens=False).ids


def test_long_parts_stay_linear(model, library):
    rng = random.Random(2)
    for text in ("".join(rng.choice("abcdefghij") for _ in range(300_000)), "a" * 300_000, " " * 300_000):
        assert ids(model, text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10 ** 9), st.binary(max_size=24))
def test_other_vocabularies_by_the_definition(seed, noise):
    rng = random.Random(seed)
    tokens, pairs = [b"a", b"b", b"c"], []
    while len(pairs) < 12:                          # merges as training makes them: the two halves exist, the whole is new
        a, b = rng.choice(tokens), rng.choice(tokens)
        # every token is the result of merging its own bytes, as in a trained vocabulary
        if a + b not in tokens and merged([*pairs, (a, b)], a + b) == [a + b]:
            tokens.append(a + b)
            pairs.append((a, b))
    numbers = {bytes([i]): i for i in range(256)} | {a + b: 256 + i for i, (a, b) in enumerate(pairs)}
    model = bpe.Merges(pairs, numbers)
    data = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40))) + noise
    assert [model.tokens[t] for t in model.split(data)] == merged(pairs, data)


def test_every_token_of_the_file_is_made_by_its_own_bytes(model):
    for t in range(256, len(model.tokens)):
        assert model.split(model.tokens[t]) == [t]


def test_odd_rows(spark, odd, nothing):
    got = bpe.encode(odd, PATH, decoded=True).collect()
    texts = odd.select("doc_id", "text").collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.decoded) for r in got), key=key) == sorted(((r.doc_id, r.text) for r in texts), key=key)
    assert all((r.ids is None) == (r.decoded is None) and (r.ids is None or len(r.ids) == r.n_tokens) for r in got)
    back = bpe.decode(bpe.encode(odd, PATH), PATH).collect()
    assert sorted(map(tuple, back), key=key) == sorted(((r.doc_id, r.text) for r in texts), key=key)
    assert bpe.encode(nothing, PATH).collect() == [] and bpe.encode(nothing, PATH).columns == ["doc_id", "n_tokens", "ids"]
    named = odd.select(F.concat(F.lit("x"), "doc_id").alias("name"), "text", F.lit(1).alias("ids"), F.lit(2).alias("n_tokens"))
    assert {r.name for r in bpe.encode(named, PATH, id_col="name").collect()} == {r.name for r in named.collect()}


def test_unknown_and_broken_ids(spark, model):
    rows = spark.createDataFrame([(1, [15496, -1, 999_999, None]), (2, None), (3, []), (4, [230])], "doc_id long, ids array<int>")
    text = {r.doc_id: r.text for r in bpe.decode(rows, PATH).collect()}
    assert text == {1: "Hello", 2: None, 3: "", 4: "�"}


def test_query_by_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op11_backtracking_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        back = library.decode(want, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(),
                                                                 hashlib.sha256(back.encode()).hexdigest())
