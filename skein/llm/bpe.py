"""Operator 1: byte-level BPE by monoid tree reduction, and its inverse.

A text's encoding is a value that can be computed from the encodings of its halves:

* Units. A text is halved down to short leaves, each leaf cut wherever white space follows
  another character. The pattern has no look-behind and no match of it crosses such a
  place, so units are encoded apart. To join two neighbours, the last unit of the left one
  and the first of the right one are cut again together; every other boundary was decided
  by two characters inside its own half and stays.
* Pre-tokens. A long unit is halved likewise and split by the pattern. To join, the last
  pre-tokens of the left half are split again together with the first of the right half,
  in a window that grows until the new split meets a boundary of the right one. The
  pattern looks ahead by one character and never behind, so from a common boundary on both
  splits are the same for good, and a pre-token before the left one's last two was found
  without looking at its end. Those outside the window thus provably keep their tokens.
* Tokens. A pre-token is halved by bytes. To join two encoded halves, a window of tokens around the seam is encoded anew and grows until
  the tokens at both of its edges are compatible with their neighbours outside, that is,
  encode(a + b) == [a, b]. A sequence whose neighbours are all compatible is the encoding.

Decoding concatenates the bytes of tokens up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import Remembering, id_and_text, per_document, table, tokenizer_path

#: Characters of a text's leaf.
LEAF_CHARS = 4096
#: Bytes of a pre-token's leaf, which is merged directly.
LEAF_BYTES = 16
#: Units and seams of which a worker remembers the tokens, twice so many at most, and characters of the longest such unit.
REMEMBERED, LONGEST = 300_000, 64
#: Rank of a pair that is no token.
NONE = 1 << 60
#: White space and what follows it; characters that not every library takes for white space.
UNIT, DOUBTFUL = re.compile(r"\s*\S+|\s+"), re.compile(r"[\x1c-\x1f]")


class Codec:
    """Encoder and decoder for one file of ranks; a worker keeps one for each file."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        of = self.ranks.get
        #: Token of two neighbouring tokens, by both numbers in one.
        self.pairs = {a << 32 | b: whole for piece, whole in self.ranks.items() for i in range(1, len(piece)) if (a := of(piece[:i])) is not None and (b := of(piece[i:])) is not None}
        self.known = Remembering(self.unit_tokens, REMEMBERED, LONGEST)
        self.seams = Remembering(lambda ab: tuple(self.merged(self.bytes_of[ab[0]] + self.bytes_of[ab[1]])), REMEMBERED, 2)

    def merged(self, piece: bytes) -> list[int]:
        """Tokens of a short piece: merge the pair of lowest rank until none is left."""
        ids, get = [self.single[b] for b in piece], self.pairs.get
        ranks = [get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NONE:
            at = ranks.index(best)
            ids[at] = best
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 32 | best, NONE)
            if at < len(ranks):
                ranks[at] = get(best << 32 | ids[at + 1], NONE)
        return ids

    def seam(self, a: int, b: int) -> tuple[int, ...]:
        """Tokens of the bytes of two tokens."""
        return self.seams[a, b]

    def tokens(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of a pre-token or a part of one: joined from its halves unless it is itself a token or a leaf."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) <= LEAF_BYTES:
            return tuple(self.merged(piece))
        half = (len(piece) + 1) // 2
        return self.join_tokens(self.tokens(piece[:half]), self.tokens(piece[half:]))

    def join_tokens(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        reach = 1
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            window = self.seam(left[-1], right[0]) if reach == 1 else tuple(self.merged(b"".join(self.bytes_of[t] for t in left[i:] + right[:j])))
            if (i == 0 or self.seam(left[i - 1], window[0]) == (left[i - 1], window[0])) and (j == len(right) or self.seam(window[-1], right[j]) == (window[-1], right[j])):
                return left[:i] + window + right[j:]
            reach *= 2

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        """Pre-tokens of the joined text from those of its two parts."""
        if not left or not right:
            return left or right
        keep = max(0, len(left) - 2)
        tail = "".join(left[keep:])
        took = 2
        while True:
            head = right[:took]
            window = tail + "".join(head)
            ends, at = set(), len(tail)
            for p in head:
                ends.add(at)
                at += len(p)
            whole = took >= len(right)
            found, done = [], 0
            for m in self.split.finditer(window):
                if m.end() >= len(window) - 1 and not whole:
                    break  # it, or its look-ahead, has touched the window's end
                found.append(m[0])
                done = m.end()
                if done in ends:
                    break
            if done in ends:
                k, at = 0, len(tail)
                while at < done:
                    at += len(head[k])
                    k += 1
                return left[:keep] + found + right[k:]
            if whole:
                return left[:keep] + found
            took *= 2

    def pieces(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.split.findall(text)
        half = len(text) // 2
        return self.join_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def units(self, text: str) -> list[str]:
        """The text's units, by halves."""
        if len(text) > LEAF_CHARS:
            half = len(text) // 2
            left, right = self.units(text[:half]), self.units(text[half:])
            return left[:-1] + self.cut(left[-1] + right[0]) + right[1:]
        return self.cut(text)

    @staticmethod
    def cut(text: str) -> list[str]:
        return [text] if DOUBTFUL.search(text) else UNIT.findall(text)

    def unit_tokens(self, unit: str) -> tuple[int, ...]:
        pieces = self.pieces(unit)
        if len(pieces) == 1:
            return self.tokens(pieces[0].encode())
        return tuple(chain.from_iterable(self.tokens(p.encode()) for p in pieces))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.units(text))))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids: each node of the tree concatenates those of its halves."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str | None = None) -> Codec:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, ids (array of int).

    A null or empty text has no ids. Texts of any length are encoded whole; equal texts
    and repeated rows are each encoded and returned. Other columns are not read.
    """

    def rows(ids, texts):
        one = codec(ranks_path, pattern)
        return {"doc_id": ids, "ids": [one.encode(t) for t in texts]}

    return per_document(id_and_text(docs, id_col, text_col), rows, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str | None = None) -> DataFrame:
    """One row for each row of (doc_id, ids): doc_id, data (binary). Null or empty ids give empty data."""

    def rows(ids, lists):
        one = codec(ranks_path, pattern)
        return {"doc_id": ids, "data": [one.decode(x or []) for x in lists]}

    return per_document(encoded.select("doc_id", "ids"), rows, "doc_id long, data binary")


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def rows(ids, texts):
        one = codec(ranks_path, pattern)
        out = {"doc_id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in texts:
            tokens = one.encode(text)
            out["n_tokens"].append(len(tokens))
            out["ids_sha256"].append(hashlib.sha256(repr(tokens)[1:-1].replace(" ", "").encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(one.decode(tokens)).hexdigest())
        return out

    return per_document(id_and_text(docs, id_col, text_col), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))
