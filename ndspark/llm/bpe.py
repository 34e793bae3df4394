"""Byte-level BPE without merging: longest matches, backtracking, memoised adjacency.

Bytes are read as Latin-1 characters, so that one Aho-Corasick pass finds the longest vocabulary
token at every byte. A row of tokens is the encoding that the merges give if, and only if, every
adjacent pair is: encoding walks along longest matches, falls back to shorter prefixes where a pair
doesn't hold, and marks byte positions that lead nowhere, so that each is tried once.

Null texts count as empty and have no ids. Repeated rows are encoded each; very long texts and
pieces take linear time. Caches only save time: they are bounded and hold no state of the result.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Entries and characters of a cached string; both bound a worker's memory.
CACHE_ENTRIES, CACHED_CHARS = 400_000, 64
#: Unicode's White_Space, written out since libraries differ on it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space beside other white space.
DOUBLED = tuple({x for s in SPACES for x in (" " + s, s + " ")})


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """Encodes and decodes by a rank file; pieces are the matches of a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = [*map(len, self.tokens)]
        self.trie = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.trie.add_word(token.decode("latin-1"), rank)
        self.trie.make_automaton()
        self.split = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACES}\p{{L}}\p{{N}}]").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")).findall
        self.shorter = [*map(self.prefix, self.tokens)]
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """The merges as defined, for short strings: the lowest rank first, the leftmost among equals."""
        parts, none, rank = [piece[i : i + 1] for i in range(len(piece))], len(self.tokens), self.ranks.get
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < none:
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def adjacent(self, left: int, right: int) -> bool:
        """Whether merges leave these two as they are side by side; left -1: whether they build right at all."""
        if len(self.pairs) >= 4 * CACHE_ENTRIES:
            self.pairs.clear()
        a, b = self.tokens[left] if left >= 0 else b"", self.tokens[right]
        self.pairs[left << 32 | right] = fits = self.merged(a + b) == ([a, b] if a else [b])
        return fits

    def prefix(self, token: bytes) -> int:
        """The longest token that is a proper prefix, or -1."""
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), -1)

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        n, lengths, shorter, known = len(piece), self.lengths, self.shorter, self.pairs.get
        longest = [-1] * n
        for end, token in self.trie.iter(piece.decode("latin-1")):  # ends ascend, so the longest comes last
            longest[end + 1 - lengths[token]] = token
        ids: list[int] = []
        dead, at, token, last = bytearray(n + 1), 0, longest[0], -1
        while at < n:
            while token >= 0:
                if not dead[at + lengths[token]]:
                    fits = known(last << 32 | token)
                    if fits or fits is None and self.adjacent(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += lengths[token]
                token, last = longest[at] if at < n else -1, token
            else:
                if not ids:
                    raise ValueError("the vocabulary lacks single bytes of this text")
                dead[at] = 1
                token = ids.pop()
                at -= lengths[token]
                token, last = shorter[token], ids[-1] if ids else -1
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text, piece by piece, as unsigned 32-bit little-endian bytes."""
        out, known = [], self.pieces
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = as_bytes(self.encode_piece(piece.encode()))
                if len(piece) <= CACHED_CHARS:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class ChunkEncoder:
    """Encodes whole texts by their space-separated chunks, each new chunk once.

    A space between two characters that aren't white space always begins a piece, so what stands
    between such spaces can be encoded alone. Runs of other white space stay inside one chunk.
    encode: ids of many strings, each as unsigned 32-bit little-endian bytes."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode, self.known = encode, {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Parts that join to the text; all but the first begin with their space."""
        parts = text.split(" ")
        if text[0] != " " and text[-1] != " " and not any(s in text for s in DOUBLED):
            return [parts[0], *[" " + p for p in parts[1:]]]
        out, before = [parts[0]], parts[0]
        for p in parts[1:]:
            if before and p and before[-1] not in SPACES and p[0] not in SPACES:
                out.append(" " + p)
            else:
                out[-1] += " " + p
            before = p
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [self.chunks(t) if t else [] for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = list(set().union(*cut).difference(self.known))
        fresh = dict(zip(new, self.encode(new), strict=True))
        self.known.update((k, v) for k, v in fresh.items() if len(k) <= CACHED_CHARS)
        return [b"".join([self.known[c] if c in self.known else fresh[c] for c in t] if any(len(c) > CACHED_CHARS for c in t) else map(self.known.__getitem__, t)) for t in cut]


def as_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> tuple[Vocabulary, ChunkEncoder]:
    """One per Python worker."""
    v = Vocabulary(read_ranks(path), pattern)
    return v, ChunkEncoder(lambda texts: [*map(v.encode, texts)])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text as unsigned 32-bit little-endian bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = vocabulary(path, pattern)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(encoder([t or "" for t in b.column("text").to_pylist()]), pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, bytes): the bytes that the ids stand for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, _ = vocabulary(path, pattern)
        for b in slices(batches):
            raw = [v.decode(memoryview(x).cast("I").tolist()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(raw, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    both = decode(encode(docs, path, pattern), path, pattern)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
