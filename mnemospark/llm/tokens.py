"""Encoding of the whole corpus with a public tokenizer (problem 6).

Method: tokenization automaton.  ``MergeAutomaton`` starts from the automaton with one
state that loops over all bytes and applies one merge gadget after another: for the
merge of u and v the arcs labelled u lead to a copy of their old target that lacks
the arc v, and every state with an arc u gets an arc for the merged token, which
leads where v leads.  What it accepts are exactly the token sequences that the merges
produce.  The gadgets are kept as they are made (state, what it was copied from, the
arc it lacks, when), because spelled out the arcs would number billions.

Encoding runs over bytes: the transducer's states are made when they are first met
and then read from a table (state, byte) -> state.  A state knows, for every token
that may still be open, the token that ended before it; of the tokens that end at a
byte exactly one may follow the token before it, so reading is deterministic.  Words
are pre-split by the tokenizer's pattern; a word's ids are kept for its next
occurrence.  Decoding emits the arcs' labels.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType

#: Where the public vocabulary files lie unless another folder is given.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

#: The pattern that splits text before the merges (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries after which the tables start afresh; results do not depend on it.
MOST_WORDS = 300_000
MOST_ARCS = 1_500_000

START = -1

#: The attributes that are filled while texts are read.
_TABLES = ("arcs", "states", "inside", "ended", "words")


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of the JSON vocabulary stands for: printable bytes themselves, others shifted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class MergeAutomaton:
    """The automaton of a list of merges, and the byte transducer that encodes with it."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.ids = {t: i for t, i in vocabulary.items() if len(t) == 1}
        size = max(vocabulary.values()) + 1
        self.left, self.born = [START] * size, [0] * size
        self.target = dict.fromkeys(self.ids.values(), 0)
        # gadget states, numbered by merge: what each was copied from, the arc it lacks
        self.parent, self.lacks = [-1], [START]
        for rank, (u, v) in enumerate(merges, 1):
            a, b = self.ids[u], self.ids[v]
            token = vocabulary[u + v]
            self.ids[u + v] = token
            self.left[token], self.born[token] = a, rank
            self.target[token] = self.target[b]
            self.parent.append(self.target[a])
            self.lacks.append(b)
            self.target[a] = len(self.parent) - 1
        self.label = {i: t for t, i in self.ids.items()}
        self.length = [len(self.label.get(i, b"")) for i in range(size)]
        self.open = {t[:k] for t in self.ids for k in range(1, len(t))}
        self._reset()

    def _reset(self) -> None:
        for name in _TABLES:
            if name in self.__dict__:
                self.__dict__[name].clear()
        self.arcs: dict[int, int] = self.__dict__.get("arcs", {})
        self.states: dict[tuple[bytes, tuple[int, ...]], int] = self.__dict__.get("states", {})
        self.inside: list[tuple[bytes, tuple[int, ...]]] = self.__dict__.get("inside", [])
        self.ended: list[int] = self.__dict__.get("ended", [])
        self.words: dict[str, list[int]] = self.__dict__.get("words", {})
        self.states[b"", (START,)] = 0
        self.inside.append((b"", (START,)))
        self.ended.append(START)

    def plain(self) -> dict:
        """The automaton without its tables, as builtin types only: what is sent to workers."""
        return {k: v for k, v in self.__dict__.items() if k not in _TABLES}

    @classmethod
    def of(cls, plain: dict) -> MergeAutomaton:
        """The automaton of ``plain``; tables that an earlier task of the process left in it are used on."""
        own = cls.__new__(cls)
        own.__dict__.update(plain)
        if "words" not in plain:
            own._reset()
            plain.update({k: own.__dict__[k] for k in _TABLES})
        return own

    def follows(self, a: int, b: int) -> bool:
        """Whether the state that arc ``a`` leads to has an arc ``b``, read from the gadgets.

        A state has the arcs of the one it was copied from but for the arc its gadget
        took away; of a token made by the gadget or later it has the arc if it has that of the
        token's left part.  The first state has every arc.
        """
        state = 0 if a == START else self.target[a]
        while state:
            if self.born[b] >= state:
                b = self.left[b]
            elif self.lacks[state] == b:
                return False
            else:
                state = self.parent[state]
        return True

    def _arc(self, state: int, byte: int) -> int:
        """Makes the state that ``byte`` leads to."""
        text, before = self.inside[state]
        text += bytes((byte,))
        n = len(text)
        token = START
        for k in range(n):
            t = self.ids.get(text[k:])
            if t is not None and self.follows(before[k], t):
                token = t
                break
        # the longest rest that a longer token may begin with; before[k] ended where text[k:] begins
        k = 0
        while k < n and text[k:] not in self.open:
            k += 1
        key = (text[k:], (*before[k:], token))
        new = self.states.get(key)
        if new is None:
            new = self.states[key] = len(self.inside)
            self.inside.append(key)
            self.ended.append(token)
        self.arcs[state << 8 | byte] = new
        return new

    def word(self, word: str) -> list[int]:
        """The ids of one pre-split word."""
        state, ended, arcs = 0, [], self.arcs
        data = word.encode()
        for byte in data:
            nxt = arcs.get(state << 8 | byte)
            state = self._arc(state, byte) if nxt is None else nxt
            ended.append(self.ended[state])
        at, out = len(data), []
        while at:
            token = ended[at - 1]
            out.append(token)
            at -= self.length[token]
        out.reverse()
        return out

    def encode(self, text: str | None, split) -> list[int]:
        """The ids of a text; none for an empty or null text."""
        if not text:
            return []
        if len(self.words) > MOST_WORDS or len(self.arcs) > MOST_ARCS:
            self._reset()
        words, out = self.words, []
        for w in split(text):
            ids = words.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) < 64:
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of an id sequence: the labels of its arcs."""
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


def automaton(folder: str = TOKENIZERS, name: str = VOCABULARY) -> MergeAutomaton:
    """The automaton of a byte-level vocabulary file; special tokens are left out."""
    with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = _byte_of_letter()
    raw = lambda t: bytes(letters[c] for c in t)
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    known = {c for c in letters}
    vocabulary = {raw(t): i for t, i in model["vocab"].items() if set(t) <= known and (len(t) == 1 or not t.startswith("<|"))}
    return MergeAutomaton(vocabulary, [(raw(u), raw(v)) for u, v in pairs])


def ranks_of(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, int]:
    """A rank file's tokens with their ids."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(spark, folder: str, name: str):
    """The automaton as a broadcast value: its size is the vocabulary's, and workers keep its tables."""
    return spark.sparkContext.broadcast(automaton(folder, name).plain())


def encoded(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): one row for each document; null and empty texts have an empty list.

    Strings that look like special tokens are ordinary text.  Repeated rows are kept.
    """
    shared = _encoder(documents.sparkSession, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, split = MergeAutomaton.of(shared.value), regex.compile(PATTERN).findall
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cut = batch.slice(at, 256)
                ids = [own.encode(t, split) for t in cut.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def sized(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """The rows without their text, with n_tokens; zero for null and empty texts."""
    shared = _encoder(documents.sparkSession, folder, name)
    rest = [c for c in documents.columns if c != "text"]
    schema = documents.select(*rest).schema.add("n_tokens", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, split = MergeAutomaton.of(shared.value), regex.compile(PATTERN).findall
        for batch in batches:
            n = pa.array([len(own.encode(t, split)) for t in batch.column(len(rest)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], n], names=[*rest, "n_tokens"])

    return documents.select(*rest, "text").mapInArrow(run, schema)
