"""Operator 8: packing documents into sequences through a configuration linear program.

The lengths of all pieces make a histogram of at most `capacity` numbers, whatever the
corpus's size. A configuration is a multiset of lengths that fits one sequence; the
linear program asks for the fewest configurations that cover the histogram. It is solved
by multiplicative weights: the weight of a length's constraint begins as its share of all
tokens and falls as the length is covered; weight by piece is its price, and a knapsack
dynamic program over the prices finds the best configurations of each round. Prices
divided by the knapsack's optimum are a dual solution, so each round also gives a lower
bound. The full configurations of the solution, up to half of it, are rounded and placed,
and the program repeated on what is left, until few pieces or no more full configurations
are left. The pieces that remain are placed best-fit; after how many rounds, one at least,
is decided by the number of sequences in all. The plan is a small table of (length, first rank,
count, sequences, offset); Spark ranks the pieces of each length and reads their places
from it.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import SLICE, cut, id_and_text, table, tokenizer_path

CAPACITY = 2048
#: Chunks of which a worker remembers the ids, twice so many at most, and the characters of the longest one remembered.
REMEMBERED, LONGEST = 200_000, 48
#: Words that the bare model takes at once.
LINES = 2048
#: Share of its scarcest length that a configuration covers at once, fall of a weight by its cover, configurations taken at one
#: round's prices, share of a solution that is placed (its fullest configurations first) before the program is solved again, and
#: the share of full configurations under which it is not.
STEP, FALL, TRIES, SHARE, LEAST = 0.1, 0.1, 64, 0.5, 0.02
#: White space besides the six characters that every library agrees on.
DOUBTFUL = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: One word of small Latin letters and a run of signs, none of them an apostrophe; texts that may be lower-cased before they are cut.
SIMPLE = re.compile(r"([a-zà-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: The pattern of the tokenizer, as JSON, and what it is for lower-case text of ASCII and Latin letters.
CUT = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~\x00-\x08\x0e-\x1b\x7f]+")
LATIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
PLAIN = re.compile("[ \t\n\r\f\v]+")


class ChunkEncoder:
    """Ids of texts, chunk by chunk between white space, which this tokenizer drops and never joins over.

    A text of ASCII and Latin letters is lower-cased whole and cut into pieces by a known
    pattern, which go to the model as lines. Of other texts, a chunk of small letters and
    signs has its word encoded by the bare model and its signs apart; other chunks take the
    whole tokenizer, as does everything where the model is not of that kind.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.words = ranked_words(parts["model"]) if CUT in json.dumps(parts["pre_tokenizer"]) else None
        parts["normalizer"] = None
        parts["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.model = None if self.words else Tokenizer.from_str(json.dumps(parts))
        self.known: dict[str, bytes] = {}  # chunks met lately, and those before them
        self.older: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {"": b""}

    @staticmethod
    def ids(tokenizer, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words without line feeds, many to a call where the model allows that."""
        if self.words is None:
            return self.ids(self.model, words)
        encoding, ids, last = self.words
        out = []
        for at in range(0, len(words), LINES):
            found = np.array(encoding.encode_ordinary("\n".join(words[at : at + LINES]) + "\n"), dtype=np.int64)
            ends, data = (4 * np.flatnonzero(last[found]) + 4).tolist(), ids[found].tobytes()
            out += [data[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def encoded(self, new: list[str]) -> dict[str, bytes]:
        """Ids of chunks."""
        out, simple, others, words = {}, [], [], {}
        known, older, match = self.known, self.older, SIMPLE.fullmatch
        for x in new:
            m = match(x)
            if m is None:
                others.append(x)
                continue
            w, e = m.groups()
            simple.append((x, w, e))
            if w not in words:
                words[w] = known.get(w) or older.get(w)
        missing = [w for w, got in words.items() if got is None]
        words.update(zip(missing, self.of_words(missing)))
        if len(self.signs) > REMEMBERED:
            self.signs = {"": b""}
        fresh = list({e for *_, e in simple}.difference(self.signs))
        self.signs.update(zip(fresh, self.ids(self.whole, fresh)))
        signs = self.signs
        for x, w, e in simple:
            out[x] = words[w] + signs[e]
        out.update(zip(others, self.ids(self.whole, others)))
        return out

    def of_latin(self, text: str) -> bytes:
        """Ids of a lower-case text of ASCII and Latin letters: its pieces as lines, in one call."""
        pieces = PIECE.findall(text)
        if not pieces:
            return b""
        encoding, ids, _ = self.words
        return ids[encoding.encode_to_numpy("\n".join(pieces) + "\n", disallowed_special=())].tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.words is None:
            return self.of_chunks(texts)
        plain = [(t.isascii() or bool(LATIN.fullmatch(t))) and not DOUBTFUL.search(t) for t in texts]
        others = iter(self.of_chunks([t for t, p in zip(texts, plain) if not p]))
        return [self.of_latin(t.lower()) if p else next(others) for t, p in zip(texts, plain)]

    def of_chunks(self, texts: list[str]) -> list[bytes]:
        """Ids of any texts, chunk by chunk."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known = self.known.get
        texts = [t.lower() if t.isascii() or LATIN.fullmatch(t) else t for t in texts]
        chunked = [[x for x in PLAIN.split(t) if x] if DOUBTFUL.search(t) else t.split() for t in texts]
        found = [list(map(known, c)) for c in chunked]
        missing = {x for c, got in zip(chunked, found) if None in got for x, g in zip(c, got) if g is None}
        older = self.older
        fresh = {x: older[x] for x in missing if x in older}
        fresh |= self.encoded(list(missing.difference(fresh)))
        self.known.update((x, g) for x, g in fresh.items() if len(x) <= LONGEST)
        return [b"".join(got) if None not in got else b"".join([fresh[x] if g is None else g for x, g in zip(c, got)]) for c, got in zip(chunked, found)]


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def ranked_words(model: dict):
    """(encoding, ids, ends) of a byte-level BPE whose words end in a suffix, as ranks of byte strings: the suffix is a line feed that
    joins a word's last byte before all else. ids: each rank's id, ends: whether it ends a word. None for other models, and
    where two merges make one token, so that ranks would not tell them apart.
    """
    import tiktoken

    suffix, vocabulary, names = model.get("end_of_word_suffix"), model["vocab"], byte_names()
    if model.get("type") != "BPE" or not suffix or model.get("continuing_subword_prefix") or model.get("ignore_merges") or any(n not in vocabulary or n + suffix not in vocabulary for n in names):
        return None
    of_name = {n: bytes([b]) for b, n in enumerate(names)}

    def as_bytes(token: str) -> bytes:
        ends = token.endswith(suffix)
        return b"".join(of_name[c] for c in (token[: -len(suffix)] if ends else token)) + b"\n" * ends

    tokens = [*names, *(n + suffix for n in names)]
    tokens += ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ranks = {as_bytes(t): i for i, t in enumerate(tokens)}
    if len(ranks) < len(tokens):
        return None
    encoding = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})
    return encoding, np.array([vocabulary[t] for t in tokens], dtype="<u4"), np.array([t.endswith(suffix) for t in tokens])


def byte_names() -> list[str]:
    """The character by which byte-level vocabularies name each byte: printable ones themselves, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document's ids and end_id, cut only beyond `capacity`."""
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    ids += end
                    for n, a in enumerate(range(0, len(ids), 4 * capacity)):
                        cut_ = ids[a : a + 4 * capacity]
                        rows.append((doc, n, a // 4, len(cut_) // 4, zlib.crc32(cut_)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each room 0..capacity, and the item that reaches it (0: none); values[n] is that of length n, if above 0."""
    best, item = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    lengths = np.flatnonzero(values > 0)
    worth, fitting = values[lengths], np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := fitting[room]:
            got = best[room - lengths[:k]] + worth[:k]
            at = got.argmax()
            if got[at] > best[room] + 1e-12:
                best[room], item[room] = got[at], lengths[at]
    return best, item


def configuration(first: int, capacity: int, item: np.ndarray, counts: np.ndarray, lengths: list[int]) -> dict[int, int]:
    """Pieces of each length beside one of `first`: the knapsack's choice as far as counts allow, then the longest that fit."""
    used, at, room = {first: 1}, capacity - first, capacity - first
    while at > 0:
        n = int(item[at])
        if n and used.get(n, 0) < counts[n]:
            used[n] = used.get(n, 0) + 1
            room -= n
            at -= n
        else:
            at -= 1
    for n in reversed(lengths):
        while n <= room and used.get(n, 0) < counts[n]:
            used[n] = used.get(n, 0) + 1
            room -= n
    return used


def fractional(counts: np.ndarray, capacity: int) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """Configurations ((length, times), ...) with amounts that cover counts[n] pieces of each length n, and a lower bound of the program."""
    lengths, cover, bound = np.flatnonzero(counts), np.zeros(capacity + 1), 0.0
    listed, amounts, open_ = lengths.tolist(), {}, counts.copy()
    while len(short := lengths[cover[lengths] < counts[lengths]]):
        weights = short * counts[short] * np.exp(-FALL * cover[short] / counts[short])
        prices = np.zeros(capacity + 1)
        prices[short] = weights / counts[short] / capacity
        best, item = knapsack(prices, capacity)
        bound = max(bound, float(weights.sum() / capacity / best[capacity]))
        for n in short[np.argsort(cover[short] / counts[short] - short / capacity, kind="stable")][:TRIES].tolist():
            if cover[n] < counts[n]:
                used = sorted(configuration(n, capacity, item, open_, listed).items())
                kinds, times = np.array(used).T
                amount = STEP * float((counts[kinds] / times).min())
                amounts[tuple(used)] = amounts.get(tuple(used), 0.0) + amount
                cover[kinds] += amount * times
                open_[kinds[cover[kinds] >= counts[kinds]]] = 0
    return amounts, bound


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(configuration, sequences) of best-fit decreasing: the longest pieces first, each where least room is left."""
    groups: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]  # (configuration, sequences) by room left
    open_ = np.zeros(capacity + 1, dtype=bool)
    for n in range(capacity, 0, -1):
        k = int(counts[n])
        while k:
            if open_[n:].any():
                room = n + int(open_[n:].argmax())
                config, number = groups[room].pop()
                used = min(k, number)
                if used < number:
                    groups[room].append((config, number - used))
                open_[room] = bool(groups[room])
                groups[room - n].append(({**config, n: config.get(n, 0) + 1}, used))
                open_[room - n] = True
                k -= used
            else:
                each = min(capacity // n, k)
                groups[capacity - each * n].append(({n: each}, k // each))
                open_[capacity - each * n] = True
                k -= k // each * each
    return [(tuple(sorted(c.items())), number) for some in groups for c, number in some]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, pieces in each sequence, offset) that place all pieces."""
    left, chosen = counts.astype(np.int64).copy(), []
    if left[capacity]:
        chosen.append((((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    taken, best = sum(k for _, k in chosen), None
    few = np.count_nonzero(left)
    while left.any():
        amounts, _ = fractional(left, capacity)
        order = sorted(amounts, key=lambda c: (-sum(n * k for n, k in c), -amounts[c], c))
        total, got = sum(amounts.values()), 0
        for c in order:
            if got >= SHARE * total or (got and sum(n * k for n, k in c) < capacity):
                break
            kinds, times = np.array(c).T
            if number := min(max(1, int(amounts[c])), int((left[kinds] // times).min())):
                chosen.append((c, number))
                left[kinds] -= times * number
                got += number
        taken += got
        rest = best_fit(left, capacity)
        if best is None or taken + sum(k for _, k in rest) < best[0]:
            best = taken + sum(k for _, k in rest), len(chosen), rest
        if left.sum() <= few or got < LEAST * total:
            break
    placed, rows, sequences = np.zeros(capacity + 1, dtype=np.int64), [], 0
    for config, number in chosen if best is None else [*chosen[: best[1]], *best[2]]:
        offset = 0
        for n, k in config:
            rows.append((n, placed[n], k * number, sequences, k, offset))
            placed[n] += k * number
            offset += n * k
        sequences += number
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def packed(pieces: DataFrame, capacity: int = CAPACITY, block_rows: int = 20_000) -> DataFrame:
    """pieces (with a column length, and doc_id and piece to order by) plus sequence_id and offset."""
    pieces = cut(pieces)
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[n] = k
    rows = plan(histogram, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    blocks = 16 + int(histogram.sum()) // block_rows  # of each length, so that a frequent length is not ranked in one task
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    sizes = dealt.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_block", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece")) - 1).join(before, ["length", "_block"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_block", "_before")
    names = [c for c in ranked.columns if c != "_rank"]
    keys = rows[:, 0] << 44 | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, length.astype(np.int64) << 44 | rank, "right") - 1
            _, first, _, sequence, each, offset = rows[at].T
            out = [*(batch.column(c) for c in names), pa.array(sequence + (rank - first) // each), pa.array(offset + (rank - first) % each * length)]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(names).schema)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, the end id alone. Texts longer than `capacity` are
    cut into pieces of that length, only the last one shorter. Repeated rows and equal
    texts are packed each; null ids are packed like others. An empty table gives an empty
    result; other columns are not read.
    """
    out = packed(token_pieces(docs, vocabulary, capacity, end_id), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
