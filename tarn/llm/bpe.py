"""Operator 2: byte-level BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in order of rank, into a deterministic automaton over tokens by successive merge gadgets. All arcs of a token
end in the same state, the one behind it, and tokens that may stand in the same places are one class of arcs; so the
automaton is a table of bits, a row for each state and a column for each class, and two lists that say which state is behind a token
and which class it has. The gadget of a merge (u, v) -> w does three things: w ends in the state that v ends in; the state behind u, split
off from tokens that share it, loses the arcs of v, whose class is split off likewise; w begins wherever u still begins. A state or class
is only copied where it is shared, so that what w has taken over stays as it was at its merge. The table is whole before the first text.

A pre-split word is encoded by table-driven transitions, from left to right and without going back: a byte table (node, byte) -> node
proposes the tokens from a position, of which the row of its state takes those that have an arc. Of the automaton's paths exactly one spells
each prefix of the word, so each position has one state. Decoding emits the labels of the arcs.

Cases: null text counts as empty; an empty text has no ids; a text of any length is encoded whole; repeated rows and repeated ids
give a row each; other columns are ignored; an empty table gives an empty table. The strings of special tokens in a text become
their ids, as the library does by default.
"""

from __future__ import annotations

import gc
import json
import re
import weakref
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import HELD, documents, portions

#: The public pre-tokenization pattern of byte-level BPE; the second form is equal to it on ASCII texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERN_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\s\dA-Za-z]+|\s+(?!\S)|\s+"
#: Words kept with their ids in a worker: those met last, and as many before them.
MEMO = 100_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The state in which a word begins; it has all arcs.
START = 0


def compiled(n: int, merges: list[tuple[int, int, int]]) -> tuple[list[int], list[int], np.ndarray]:
    """The automaton over n tokens: the state behind each, the class of each, and the table of arcs (states, classes / 8), as bits."""
    made = {w for _, _, w in merges}
    behind, kind = [1] * n, [0] * n  # all bytes share a state and a class at first
    holders, members = [1, n - len(made)], [n - len(made)]
    arcs = np.full((1 << 7, 1 << 10), 255, np.uint8)  # turned over while it is built: classes are copied oftener in whole bytes
    done = set()
    for u, v, w in merges:
        if w not in done:
            behind[w] = behind[v]
            holders[behind[w]] += 1
        if holders[behind[u]] > 1:
            s = len(holders)
            if s == arcs.shape[1]:
                arcs = np.concatenate([arcs, np.full_like(arcs, 255)], axis=1)
            used = (len(members) + 7) >> 3
            arcs[:used, s] = arcs[:used, behind[u]]
            holders[behind[u]] -= 1
            behind[u] = s
            holders.append(1)
        if members[kind[v]] > 1:
            k, old = len(members), kind[v]
            if k == len(arcs) * 8:
                arcs = np.concatenate([arcs, np.full_like(arcs, 255)])
            used = len(holders)
            arcs[k >> 3, :used] &= (arcs[old >> 3, :used] >> (old & 7) & 1) << (k & 7) | np.uint8(255 - (1 << (k & 7)))
            members[old] -= 1
            kind[v] = k
            members.append(1)
        arcs[kind[v] >> 3, behind[u]] &= np.uint8(255 - (1 << (kind[v] & 7)))
        if w not in done:
            done.add(w)
            kind[w] = kind[u]
            members[kind[w]] += 1
    return behind, kind, np.ascontiguousarray(arcs[: (len(members) + 7) >> 3, : len(holders)].T)


class Automaton:
    """The compiled automaton of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model, letters = spec["model"], byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        self.ids = {spell(t): i for t, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for label, i in self.ids.items():
            self.labels[i] = label
        for text, i in self.special.items():
            self.labels[i] = text.encode()
        merges = []
        for pair in model["merges"]:
            u, v = (self.ids[spell(t)] for t in (pair.split(" ") if isinstance(pair, str) else pair))
            merges.append((u, v, self.ids[self.labels[u] + self.labels[v]]))
        self.behind, self.kind, arcs = compiled(len(self.labels), merges)
        self.stride, self.table = arcs.shape[1], arcs.tobytes()
        # a node of the byte table: its nodes by byte, and the arc whose label ends there: its byte and bit in a row, the row behind it, itself
        nodes: dict[bytes, list] = {b"": [{}, None]}
        for label in sorted(self.ids):
            for k in range(1, len(label) + 1):
                if label[:k] not in nodes:
                    nodes[label[:k]] = nodes[label[: k - 1]][0][label[k - 1]] = [{}, None]
            i = self.ids[label]
            nodes[label][1] = (self.kind[i] >> 3, 1 << (self.kind[i] & 7), self.behind[i] * self.stride, i)
        leaf: dict[int, list] = {}
        for node in nodes.values():
            if not node[0]:
                node[0] = leaf
        self.root = nodes[b""][0]
        self.sizes = [len(x) for x in self.labels]
        self.longest = max(self.sizes)
        self.pattern, self.ascii = regex.compile(PATTERN), re.compile(PATTERN_ASCII, re.A)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = Words(self)

    def has_arc(self, p: int, t: int) -> bool:
        """Whether the state behind token p has an arc t."""
        return bool(self.table[self.behind[p] * self.stride + (self.kind[t] >> 3)] >> (self.kind[t] & 7) & 1)

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The labels of the one path that spells the word."""
        n, longest, root, table = len(word), self.longest, self.root, self.table
        row, last = [0] * (n + 1), [0] * (n + 1)  # of each position: where its state's row begins in the table, and the arc that led there
        for at in range(n):
            here, kids, i = row[at], root, at
            for b in word[at : at + longest]:
                node = kids.get(b)
                if node is None:
                    break
                i += 1
                kids, arc = node
                if arc and table[here + arc[0]] & arc[1]:
                    row[i], last[i] = arc[2], arc[3]
        out, sizes = [], self.sizes
        while n:
            out.append(last[n])
            n -= sizes[last[n]]
        out.reverse()
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.split.split(text) if self.split and any(s in text for s in self.special) else (text,):
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                out += chain.from_iterable(map(self.words.__getitem__, (self.ascii if piece.isascii() else self.pattern).findall(piece)))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


class Words(dict):
    """Ids of the words met; filled by the automaton."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.before = weakref.proxy(automaton), {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.before.get(word) or self.automaton.encode_word(word.encode())
        if len(word) < 40:
            if len(self) >= MEMO:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


_COMPILED: dict[str, Automaton] = {}
HELD.append(_COMPILED)


def automaton(path: str) -> Automaton:
    """The automaton of a file, compiled once a worker; a worker that another operator uses in between lets it go."""
    if path not in _COMPILED:
        _COMPILED[path] = Automaton(path)
        gc.freeze()
        gc.set_threshold(500_000)  # the word table holds no cycles
    return _COMPILED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text."""

    def run(batches: Iterator):
        import pyarrow as pa

        table = automaton(path)
        for batch in batches:
            for part in portions(batch, 1):
                ids = [table.encode(t or "") for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text) of every row of ids; null ids give an empty text."""

    def run(batches: Iterator):
        import pyarrow as pa

        table = automaton(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [table.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=[id_col, "ids", "text"])

    kind = encoded.schema[id_col].dataType
    return encoded.select(id_col, ids_col).mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text): every whole text encoded and decoded again, in one pass."""

    def run(batches: Iterator):
        import pyarrow as pa

        table = automaton(path)
        for batch in batches:
            for part in portions(batch, 1):
                ids = [table.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(table.decode, ids), pa.string())], names=[id_col, "ids", "text"])

    kind = docs.schema[id_col].dataType
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())]))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text; digests of the ids and of the decoded text stand for them."""
    return round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), tokenizer_path())


QUERIES = {"op2_bpe_automaton": op2_bpe_automaton}
SQL: dict[str, str] = {}
