import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgrid.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.TOKENIZER), reason="no tokenizer files")


@pytest.fixture(scope="module")
def content():
    with open(bpe.TOKENIZER, encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(content):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(content)


@pytest.fixture(scope="module")
def encoder(content):
    return bpe.Encoder(content)


@pytest.fixture(scope="module")
def decoder(content):
    return bpe.Decoder(content)


def same(text, library, encoder, decoder):
    want = library.encode(text, add_special_tokens=False).ids
    got = encoder(text)
    assert np.frombuffer(got, "<u4").tolist() == want, repr(text[:200])
    assert decoder(got) == library.decode(want, skip_special_tokens=False)


ODD = [" ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", " ", "​", "﻿", "'s", "'T", "'ll", "<|endoftext|>", "<|startoftext|>", "<|END",
       "İ", "Σ", "ΑΣ", "é", "́", "ﬁ", "Ǆ", "한글", "ᄒ", "ᅡ", "ᆫ", "日本", "٣", "½", "Ⅷ", "🙂", "👩‍👧", "\x00", "\x7f", "#", "...", "--", "aa", "Hello", "WORLD", "12", "é", "̈́"]


@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=8)), max_size=30))
@settings(max_examples=400, deadline=None)
def test_ids_of_odd_texts_are_those_of_the_library(library, encoder, decoder, parts):
    same("".join(parts), library, encoder, decoder)


def test_latin_1_needs_no_library(library, content, encoder, decoder):
    assert encoder.latin
    odd = [chr(c) for c in range(256)]
    for a in odd:
        for b in ("", "a", "é", "'s", "7", "¼", "\xa0"):
            same(a + b + a, library, encoder, decoder)
    content = content.replace("Lowercase", "NFKC")
    assert bpe.Encoder(content).latin is None


def test_long_runs(library, encoder, decoder):
    rng = random.Random(3)
    for text in ["a" * 5000, "ab" * 4000, "".join(rng.choice("etaoins") for _ in range(20_000)), "!?" * 3000, "日" * 3000, "é" * 2000, "ha " * 3000]:
        same(text, library, encoder, decoder)


def test_forgetting_changes_nothing(library, content, decoder, monkeypatch):
    monkeypatch.setattr(bpe, "_REMEMBERED", 3)
    small = bpe.Encoder(content)
    for _ in range(2):
        same("one two three four five, six seven eight. one two", library, small, decoder)


def plain_merges(merger, word):
    """Scans all pairs for the lowest rank again and again."""
    symbols = [merger.inner[b] for b in word[:-1]] + [merger.last[word[-1]]]
    while True:
        found = [(merger.right_of[a][b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if b in merger.right_of[a]]
        if not found:
            return symbols
        pair, at = min(found)
        symbols[at:at + 2] = [pair & (1 << 32) - 1]


def test_queue_against_a_plain_scan(encoder):
    rng = random.Random(8)
    for _ in range(300):
        word = bytes(rng.choice(b"aehilnorst'") for _ in range(rng.randint(1, 40)))
        assert encoder.merge(word) == plain_merges(encoder.merge, word)


def test_rows(documents, library):
    texts = [None, "", " \n ", "Same text, twice", "Same text, twice", "x" * 300_000, "word <|endoftext|> Élan"]
    docs = documents(texts, extra=("token_ids", "decoded", "n_tokens", "ids"))
    kept = bpe.decode_ids(bpe.encode_texts(docs))
    assert sorted(kept.columns) == sorted(docs.columns)
    got = {r["doc_id"]: r for r in bpe.token_digests(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.token_digests(documents([])).count() == 0


def test_unknown_ids_are_left_out(decoder, library):
    ids = [5, 10 ** 6, 7]
    assert decoder(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)
