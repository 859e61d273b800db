"""Byte-level BPE encoding and decoding (operator 5).

Merge candidates wait in a priority queue of (rank, position) over a doubly linked list of
symbols; an entry whose pair no longer stands at its position is stale and is skipped.
Decoding concatenates the vocabulary's byte strings.

A token never runs across a step from a visible character to white space, so a text is cut
there first; pre-tokens recur, and a bounded per-worker table keeps their encodings.

Null text counts as empty: no tokens, the digests of the empty string. Rows are independent, so
repeated rows are encoded alike, and an empty table gives an empty one; of equal ranks in a text the
leftmost pair is merged first. A text is encoded whole, however long. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise
from pathlib import Path
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Entries of the token table of a worker, some 200 bytes each; it starts anew when full.
TOKENS = 250_000
#: Where a queue entry holds the position.
POSITION = (1 << 32) - 1
#: The links of short pre-tokens at the start.
AFTER, BEFORE = list(range(1, 65)), list(range(-1, 63))
MARKS = frozenset(".,;:!?")

SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The public pre-tokenizing pattern of byte-level BPE, with its white space spelled out.
PATTERN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: A blank and letters (Latin and Cyrillic ones, all of them in the pattern's \\p{L}): one pre-token.
PLAIN = re.compile(" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f]+")
#: White space before a blank: such a blank is no place to cut.
AWKWARD = re.compile(rf"(?<=[{SPACE}\x1c-\x1f]) ")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Encodes and decodes with the vocabulary, merges and added tokens of a tokenizer file."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        vocab, self.added = model["model"]["vocab"], {t["content"]: t["id"] for t in model["added_tokens"]}
        to_byte = byte_symbols()
        strings = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items() if all(c in to_byte for c in s)}
        strings |= {i: s.encode() for s, i in self.added.items()}
        self.strings = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.decimal = [str(i) for i in range(len(self.strings))]
        first = {b: vocab[c] for c, b in to_byte.items()}
        self.first = [first[b] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.made, self.left, self.right = ([vocab[x] for x in side] for side in ([a + b for a, b in pairs], [a for a, _ in pairs], [b for _, b in pairs]))
        after: list[dict] = [{} for _ in range(max(vocab.values()) + 1)]
        for rank, (a, b) in enumerate(zip(self.left, self.right, strict=True)):
            after[a][b] = rank << 32
        none = {}.get
        self.rank_after = [d.get if d else none for d in after]  # by left symbol, the lookup of the right one
        self.byte_ranks = {(a, b): r for a, x in first.items() for b, y in first.items() if (r := after[x].get(y)) is not None}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.tokens: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token. A queue entry is its rank, shifted, with the left position below.

        It is stale if its rule's two symbols don't stand there any more: a symbol only changes by growing, so they never come back.
        """
        n = len(data)
        queue = [rank | i for i, rank in enumerate(map(self.byte_ranks.get, pairwise(data))) if rank is not None]
        heapify(queue)
        ids = list(map(self.first.__getitem__, data))
        made, left, right, rank_after = self.made, self.left, self.right, self.rank_after
        after, before = (AFTER[:n], BEFORE[:n]) if n < len(AFTER) else (list(range(1, n + 1)), list(range(-1, n - 1)))
        while queue:
            top = heappop(queue)
            i, rule = top & POSITION, top >> 32
            if ids[i] != left[rule] or ids[j := after[i]] != right[rule]:
                continue
            ids[i] = a = made[rule]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_after[a](ids[k])) is not None:
                    heappush(queue, rank | i)
            if i and (rank := rank_after[ids[h := before[i]]](a)) is not None:
                heappush(queue, rank | h)
        return [x for x in ids if x >= 0]

    def token(self, text: str) -> bytes:
        """The ids of one pre-token as 32-bit integers."""
        found = array("i", self.merge(text.encode("utf-8", "surrogatepass"))).tobytes()
        if len(text) < 64:
            if len(self.tokens) >= TOKENS:
                self.tokens.clear()
            self.tokens[text] = found
        return found

    def piece(self, text: str) -> bytes:
        """The ids of a text, by the pattern."""
        known = self.tokens.get
        return b"".join([known(x) or self.token(x) for x in PATTERN.findall(text)])

    def word(self, text: str) -> bytes:
        """The ids of a blank and a word; a mark after a letter is a token of its own."""
        if PLAIN.fullmatch(text):
            return self.token(text)
        stem, mark, known = text[:-1], text[-1], self.tokens.get
        if mark in MARKS and ((ids := stem[-1:].isalpha() and known(stem)) or PLAIN.fullmatch(stem)):
            return (ids or self.token(stem)) + (known(mark) or self.token(mark))
        return self.piece(text)

    def ordinary(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if "\0" in text or AWKWARD.search(text):
            return self.piece(text)
        head, *tail = text.replace(" ", "\0 ").split("\0")
        known = self.tokens.get
        found = list(map(known, tail))
        if None in found:
            found = [ids or known(w) or self.word(w) for ids, w in zip(found, tail, strict=True)]
        return self.piece(head) + b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += [self.ordinary(text[at : m.start()]), pack("i", self.added[m[0]])]
            at = m.end()
        out.append(self.ordinary(text[at:]))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Tokenizer] = {}


def loaded(spec: str) -> Tokenizer:
    """The worker's tokenizer; its token table lives as long as the worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(spec)
    return _loaded[key]


def encode(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """A row for each document: key, n_tokens, ids_sha256, decoded_sha256 and, if asked, token_ids and decoded.

    `tokenizer_file` is read on the driver (about 1.5 MB, its size doesn't depend on the data)
    and broadcast. One pass, no shuffle; a worker holds a few MB of texts and ids at a time.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text())
    kind = docs.schema[key].dataType.simpleString()
    kinds = {key: None, "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    kinds |= {"token_ids": pa.list_(pa.int32())} if with_ids else {}
    kinds |= {"decoded": pa.string()} if with_ids and with_decoded else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(spec.value)
        for batch in pieces(batches, 1):
            out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "decoded")}
            for value in batch.column(1):
                ids = t.encode(value.as_py() or "")
                each = ids.tolist()
                plain = t.decode(each)
                out["n_tokens"].append(len(each))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(t.decimal.__getitem__, each)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(plain.encode()).hexdigest())
                if "token_ids" in kinds:
                    out["token_ids"].append(ids)
                if "decoded" in kinds:
                    out["decoded"].append(plain)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[k], kinds[k]) for k in list(kinds)[1:]]], list(kinds))

    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", token_ids array<int>" * ("token_ids" in kinds) + ", decoded string" * ("decoded" in kinds)
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
