"""The tokenization automaton: equality with the public library, round trips and odd texts."""

from __future__ import annotations

import os
import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemospark.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(f"{T.TOKENIZERS}/{T.VOCABULARY}.json"), reason="no vocabulary files")
SPLIT = regex.compile(T.PATTERN).findall


@pytest.fixture(scope="module")
def own():
    return T.automaton()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{T.TOKENIZERS}/{T.VOCABULARY}.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = [
    "Hello world's  end\n\n\tof it", "<|endoftext|> is text", "naïve façade 漢字 かな 🙂👍🏽", "a" * 5000, "ab" * 3000 + "é" * 500, " \x85  　x", "١٢٣ 007 3.14", "don't WE'RE o'clock'll", " ", "\0\x01", "𝔘𝔫𝔦",
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_library(own, library, text):
    ids = own.encode(text, SPLIT)
    assert ids == library(text) and own.decode(ids) == text


def test_random_mixtures(own, library):
    rng = random.Random(7)
    pools = ["abcdefg", "aaaab", "the in on er", " \n\t", "éüß漢字🙂", "0123456789", "!?.-=_*#<|>", "ABCdefXYZ"]
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 60)))
        assert own.encode(text, SPLIT) == library(text)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_round_trip(text):
    a = test_round_trip.__dict__.setdefault("a", T.automaton())
    assert a.decode(a.encode(text, SPLIT)) == text


def test_tables_start_afresh_without_other_results(own, monkeypatch):
    monkeypatch.setattr(T, "MOST_WORDS", 5)
    words = [f"word{i} again" for i in range(40)]
    fresh = T.MergeAutomaton.of(own.plain())
    assert [fresh.encode(w, SPLIT) for w in words] == [own.encode(w, SPLIT) for w in words]


def test_gadgets_against_plain_merging(own):
    """Two tokens follow each other exactly if merging their text gives them back."""
    rng = random.Random(1)
    ids = [i for i in own.label if len(own.label[i]) > 1]
    for _ in range(400):
        a, b = rng.choice(ids), rng.choice(ids)
        word = own.label[a] + own.label[b]
        try:
            text = word.decode()
        except UnicodeDecodeError:
            continue
        assert own.follows(a, b) == (own.word(text) == [a, b]) or own.word(text)[0] != a


def test_rank_file_has_the_same_vocabulary(own):
    assert T.ranks_of() == {t: i for t, i in own.ids.items()}


def test_documents(spark, library):
    rows = [(1, "one two"), (2, None), (3, ""), (4, "  "), (4, "  "), (None, "x")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id or 0, r.ids) for r in T.encoded(df).collect()))
    assert got == sorted([(1, library("one two")), (2, []), (3, []), (4, library("  ")), (4, library("  ")), (0, library("x"))])
    assert T.encoded(df.limit(0)).count() == 0
    sized = {(r.doc_id, r.n_tokens) for r in T.sized(df.drop("ids")).collect()}
    assert (1, len(library("one two"))) in sized and (2, 0) in sized and (3, 0) in sized
