"""Operator 13: log probabilities of texts by context-tree weighting over bytes.

The model predicts a byte by eight binary decisions. Each decision is seen in the contexts
of the 0, 1, ... DEPTH bytes before it; in each context the counts of the training texts
give a Krichevsky-Trofimov estimate, and the weighted probability of a context is half its
own estimate's plus half the product of its children's. The share of the first half is
the weight with which the context's estimate is mixed with what the longer contexts
predict. The longest context that the training texts hold ends the mixture.

Everything that is counted is counted over all training texts and grows with them, so no
task and no driver holds it. Texts are cut into batches. A batch asks for the distinct
windows (context and byte) and the distinct words it holds, and tells how often its
training texts hold them. Questions are dealt by the hash of the window's CUT last context
bytes: all contexts of CUT bytes or more are settled within such a part, which can hold
no more than 256**(DEPTH - CUT + 1) windows below one context whatever the input's size. The
shorter contexts, fewer than 256**CUT / 255 in any corpus, are summed over the parts
and sent to all. The answers go back by batch, and each batch scores its texts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import saved, table

DEPTH, CUT = 5, 3
#: Bytes of text that a block holds, and its documents; bytes of a batch; bytes of text for each part of the model.
BLOCK, DOCUMENTS, BATCH, PART = 1 << 18, 1 << 14, 1 << 24, 1 << 23
#: Windows that are made at once.
STEP = 1 << 22
U = np.uint64
_HALF_GAMMA = np.array([math.lgamma(k + 0.5) for k in range(64)])
_GAMMA = np.array([math.lgamma(k + 1) for k in range(64)])


def normalised(text: str) -> bytes:
    """Lower-case words joined by one space, and a line feed, which is the end token."""
    return b" ".join(text.encode().lower().split()) + b"\n"


def packed(data: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data.tobytes() if isinstance(data, np.ndarray) else data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=U(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(unpacked(data), dtype=U), dtype=U)


def windows(texts: list[bytes], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, numbers of the texts) of every byte of the texts, some at a time.

    A key holds the context, the last byte first, then the byte itself in its lowest
    eight bits. Before a text stand spaces, which it cannot begin with.
    """
    pad = b" " * depth
    data = np.frombuffer(b"".join(pad + t for t in texts), dtype=np.uint8)
    ends = np.cumsum([len(t) + depth for t in texts])
    for a in range(depth, len(data), STEP):
        b = min(a + STEP, len(data))
        here, before = data[a:b], data[a - 1 : b - 1]
        keep = ~((here == 32) & ((before == 32) | (before == 10)))  # all but the spaces before a text
        key = here[keep].astype(U)
        for k in range(1, depth + 1):
            key |= data[a - k : b - k][keep].astype(U) << U(8 * (depth + 1 - k))
        yield key, np.searchsorted(ends, np.flatnonzero(keep) + a, "right")


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first)


def _log_gamma(n: np.ndarray, small: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(n + shift) of whole n; small: the first 64."""
    x = np.maximum(n, 64) + shift
    i = 1 / x
    i2 = i * i
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 / 1680)))
    return np.where(n < 64, small[np.minimum(n, 63)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros, _HALF_GAMMA, 0.5) + _log_gamma(ones, _HALF_GAMMA, 0.5) - _log_gamma(zeros + ones, _GAMMA, 1.0) - math.log(math.pi)


def shorter(keys: np.ndarray) -> np.ndarray:
    """The windows without the oldest byte of their contexts."""
    return keys >> U(16) << U(8) | keys & U(255)


class Contexts:
    """Weighted decisions of the contexts of low to high bytes.

    keys, counts: the distinct windows of `high` context bytes and how often they occur;
    children: for each of the eight bits (nodes, sums) of the logarithms of the weighted
    probabilities one level deeper, None where `high` is the greatest depth.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: int, high: int, children: list | None = None) -> None:
        self.low, self.high, self.levels = low, high, {}
        keys, counts = keys[counts > 0], counts[counts > 0]
        self.lowest = keys, counts
        for depth in range(high, low - 1, -1):
            if depth < high:
                keys, counts = summed(shorter(keys), counts)
            self.lowest = keys, counts
            level, up = [], []
            for j in range(8):
                node = keys >> U(8 - j)  # context and the j bits already known
                first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, dtype=np.int64)
                node = node[first]
                ones = counts * (keys >> U(7 - j) & U(1)).astype(np.int64)
                n, n1 = (np.add.reduceat(x, first) if len(first) else x for x in (counts, ones))
                own = log_kt(n - n1, n1)
                if children is None:
                    weighted, share = own, np.ones(len(node))
                else:
                    below, sums = children[j]
                    deeper = np.zeros(len(node))
                    deeper[np.searchsorted(node, below)] = sums
                    weighted = np.logaddexp(own, deeper) - math.log(2)
                    share = np.exp(own - math.log(2) - weighted)
                level.append((node, (n1 + 0.5) / (n + 1), share))
                up.append((node, weighted))
            self.levels[depth] = level
            children = [self._merged(node, weighted, j) for j, (node, weighted) in enumerate(up)]
        #: Sums of the logarithms one level above the lowest, for each bit.
        self.above = children

    @staticmethod
    def _merged(node: np.ndarray, weighted: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        return summed(node >> U(8 + j) << U(j) | node & U((1 << j) - 1), weighted)

    def mix(self, keys: np.ndarray, depth: int, j: int, p: np.ndarray) -> np.ndarray:
        """The probability of bit j of each key's byte, p (nan: none yet) by the longer contexts being mixed in; depth: of the keys."""
        for d in range(self.high, self.low - 1, -1):
            node, one, share = self.levels[d][j]
            if not len(node):
                continue
            wanted = keys >> U(8 * (depth - d + 1)) << U(j) | (keys & U(255)) >> U(8 - j)
            at = np.minimum(np.searchsorted(node, wanted), len(node) - 1)
            kt = np.where(keys >> U(7 - j) & U(1), one[at], 1 - one[at])
            p = np.where(node[at] == wanted, np.where(np.isnan(p), kt, share[at] * kt + (1 - share[at]) * p), p)
        return p


def log_probabilities(keys: np.ndarray, layers: list[Contexts], depth: int) -> np.ndarray:
    """log10 of the probability of each key's byte after its context; layers: from the longest contexts to the shortest."""
    out = np.zeros(len(keys))
    for j in range(8):
        p = np.full(len(keys), np.nan)
        for layer in layers:
            p = layer.mix(keys, depth, j, p)
        out += np.log10(np.where(np.isnan(p), 0.5, p))
    return out


def _blocks(docs: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    """(batch, ids, held, size, texts): documents in blocks of normalised texts, batches of blocks within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done, texts, ids, helds, size = TaskContext.get().partitionId() << 32, 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            row = [[base + done // BATCH], [ids], [helds], [size], [packed(b"".join(texts))]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.binary()))], names=["batch", "ids", "held", "size", "texts"])

        for batch in batches:
            for doc, text, out in zip(*batch.columns):
                t = normalised(text.as_py())
                texts.append(t)
                ids.append(doc.as_py())
                helds.append(out.as_py())
                size += len(t)
                if size >= BLOCK or len(ids) >= DOCUMENTS:
                    yield block()
                    done, texts, ids, helds, size = done + size, [], [], [], 0
        if ids:
            yield block()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), held.alias("held"))
    return rows.mapInArrow(run, "batch long, ids array<long>, held array<boolean>, size long, texts binary")


def _words(text: bytes) -> list[bytes]:
    """Words of a normalised text and the end, which is the empty word."""
    return [*text.split(), b""]


ASKS = "kind int, part long, batch long, keys binary, counts binary"


def _asks(blocks: DataFrame, parts: int, depth: int, cut: int) -> DataFrame:
    """Each batch's distinct windows (kind 0) and words (kind 1) by part, and how often its training texts hold them."""

    def answers(batch: int, found: list, words: Counter) -> Iterator[pa.RecordBatch]:
        rows = []
        keys, counts = summed(*map(np.concatenate, zip(*found)))
        part = (keys >> U(8 * (depth + 1 - cut))) * U(0x9E3779B97F4A7C15) >> U(32)
        part %= U(parts)
        order = np.argsort(part, kind="stable")
        keys, counts, part = keys[order], counts[order], part[order]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(first, [*first[1:], len(keys)]):
            rows.append((0, int(part[a]), batch, packed_keys(keys[a:b]), packed(counts[a:b])))
        dealt: dict[int, list] = {}
        for w in words:
            dealt.setdefault(zlib.crc32(w) % parts, []).append(w)
        for p, some in dealt.items():
            rows.append((1, p, batch, packed(b"\n".join(some)), packed(np.array([words[w] for w in some], dtype=np.int64))))
        for at in range(0, len(rows), 256):
            columns = zip(*rows[at : at + 256])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["kind", "part", "batch", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, words, n = None, [], Counter(), 0
        for batch, held, texts in (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))):
            if batch != at:
                if at is not None:
                    yield from answers(at, found, words)
                at, found, words, n = batch, [], Counter(), 0
            lines = unpacked(texts).splitlines(keepends=True)
            for keep in (False, True):
                some = [t for t, h in zip(lines, held) if h is keep]
                for keys, _ in windows(some, depth) if some else ():
                    keys.sort()
                    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                    found.append((keys[first], np.zeros(len(first), dtype=np.int64) if keep else np.diff(np.r_[first, len(keys)])))
                    n += len(first)
                said = Counter()
                for t in some:
                    said.update(t.split())
                said[b""] += len(some)
                if keep:
                    words.update(dict.fromkeys(said, 0))
                else:
                    words.update(said)
            if n > STEP:
                found = [summed(*map(np.concatenate, zip(*found)))]
                n = 0
        if at is not None:
            yield from answers(at, found, words)

    return blocks.select("batch", "held", "texts").mapInArrow(run, ASKS)


MODEL = "kind int, part long, keys binary, counts binary, node long, n decimal(20,0)"
#: Kinds of the model's rows besides windows and words: counts and weights of the shorter contexts, totals of words.
COUNT, WEIGHT, TOTAL = 2, 3, 4
#: Weights are summed as whole multiples of 1 / SCALE, so that their order does not matter.
SCALE = 1 << 20


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 64):
            yield from zip(*(c.to_pylist() for c in b.slice(at, 64).columns))


def _model(asks: DataFrame, tasks: int, depth: int, cut: int) -> DataFrame:
    """What the batches ask for and tell, summed by part, and what the parts tell of the contexts shorter than `cut`."""
    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.decimal128(20, 0))
    names = ["kind", "part", "keys", "counts", "node", "n"]

    def told(kind: int, nodes: list, n: list) -> pa.RecordBatch:
        size = len(nodes)
        columns = [pa.array([kind] * size, types[0]), *(pa.nulls(size, t) for t in types[1:4]), pa.array(nodes, types[4]), pa.array(n, pa.int64()).cast(types[5])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def settle(kind: int, part: int, found: list, words: dict) -> Iterator[pa.RecordBatch]:
        if kind == 1:
            row = (kind, part, packed(b"\n".join(words)), packed(np.fromiter(words.values(), dtype=np.int64, count=len(words))), None, None)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)
            yield told(TOTAL, [0, 1], [sum(words.values()), sum(n > 0 for n in words.values())])
            return
        keys, counts = summed(*map(np.concatenate, zip(*found)))
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((kind, part, packed_keys(keys), packed(counts), None, None), types)], names=names)
        own = Contexts(keys, counts, cut, depth)
        if len(own.lowest[0]):
            short, n = summed(shorter(own.lowest[0]), own.lowest[1])
            yield told(COUNT, short.astype(np.int64), n)
            for j, (nodes, sums) in enumerate(own.above):
                yield told(WEIGHT, (nodes >> U(j) << U(11) | U(j << 8) | nodes & U((1 << j) - 1)).astype(np.int64), np.rint(sums * SCALE).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, words, n = None, [], {}, 0
        for kind, part, keys, counts in _rows(batches):
            if (kind, part) != at:
                if at:
                    yield from settle(*at, found, words)
                at, found, words, n = (kind, part), [], {}, 0
            counts = np.frombuffer(unpacked(counts), dtype=np.int64)
            if kind == 1:
                for w, c in zip(unpacked(keys).split(b"\n"), counts.tolist()):
                    words[w] = words.get(w, 0) + c
            else:
                found.append((unpacked_keys(keys), counts))
                n += len(counts)
                if n > STEP:
                    found = [summed(*map(np.concatenate, zip(*found)))]
                    n = 0
        if at:
            yield from settle(*at, found, words)

    return asks.select("kind", "part", "keys", "counts").repartition(tasks, "kind", "part").sortWithinPartitions("kind", "part").mapInArrow(run, MODEL)


def _short_contexts(model: DataFrame, cut: int) -> Contexts:
    """The contexts of fewer than `cut` bytes, of which there are under 256**cut / 255."""
    told = model.where(F.col("kind").isin(COUNT, WEIGHT)).groupBy("kind", "node").agg(F.sum("n").cast("double").alias("n")).toArrow()
    kind, node, n = (told.column(c).to_numpy() for c in ("kind", "node", "n"))
    counts = kind == COUNT
    order = np.argsort(node[counts])
    children = []
    for j in range(8):
        mine = ~counts & (node >> 8 & 7 == j)
        key = (node[mine] >> 11 << j | node[mine] & (1 << j) - 1).astype(U)
        at = np.argsort(key)
        children.append((key[at], n[mine][at] / SCALE))
    return Contexts(node[counts][order].astype(U), n[counts][order].astype(np.int64), 0, cut - 1, children)


def _answers(model: DataFrame, asks: DataFrame, short: Contexts, tasks: int, depth: int, cut: int) -> DataFrame:
    """(batch, kind, keys, found): to each question the log probabilities of its windows or the counts of its words."""
    sent = model.sparkSession.sparkContext.broadcast(short)
    both = model.where("kind < 2").select("kind", "part", F.lit(None).cast("long").alias("batch"), "keys", "counts").unionByName(asks.select("kind", "part", "batch", "keys", F.lit(None).cast("binary").alias("counts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = values = words = None
        for kind, _, batch, asked, counts in _rows(batches):
            if batch is None:
                counts = np.frombuffer(unpacked(counts), dtype=np.int64)
                if kind == 1:
                    words = dict(zip(unpacked(asked).split(b"\n"), counts.tolist()))
                else:
                    keys = unpacked_keys(asked)
                    values = log_probabilities(keys, [Contexts(keys, counts, cut, depth), sent.value], depth)
                continue
            found = np.array([words[w] for w in unpacked(asked).split(b"\n")], dtype=np.int64) if kind == 1 else values[np.searchsorted(keys, unpacked_keys(asked))]
            yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([kind], pa.int32()), pa.array([asked], pa.binary()), pa.array([packed(found)], pa.binary())], names=["batch", "kind", "keys", "found"])

    dealt = both.repartition(tasks, "kind", "part").sortWithinPartitions("kind", "part", F.col("batch").asc_nulls_first())
    return dealt.mapInArrow(run, "batch long, kind int, keys binary, found binary")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def _scores(blocks: DataFrame, answers: DataFrame, tokens: int, distinct: int, tasks: int, depth: int) -> DataFrame:
    """A row for each document, from the blocks of each batch and the answers it got."""
    merged = answers.unionByName(blocks.select("batch", F.lit(2).alias("kind"), F.col("texts").alias("keys"), "ids", "held"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, known, table_ = None, [], {}, None
        rest = math.log10(tokens + 0.5 * (distinct + 1))
        none = math.log10(0.5) - rest
        for batch, kind, keys, found, ids, held in _rows(batches):
            if batch != at:
                at, parts, known, table_ = batch, [], {}, None
            if kind == 0:
                parts.append((unpacked_keys(keys), np.frombuffer(unpacked(found), dtype=np.float64)))
                continue
            if kind == 1:
                counts = np.frombuffer(unpacked(found), dtype=np.int64)
                logs = np.where(counts > 0, np.log10(counts + 0.5) - rest, none)
                known.update(zip(unpacked(keys).split(b"\n"), logs.tolist()))
                continue
            if table_ is None:
                table_ = [np.concatenate(x) for x in zip(*parts)]
                order = np.argsort(table_[0])
                table_ = [x[order] for x in table_]
            lines = unpacked(keys).splitlines(keepends=True)
            score = np.zeros(len(lines))
            for key, doc in windows(lines, depth):
                both = key << U(16) | doc.astype(U)  # six bytes and the place in the block
                both.sort()
                first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
                times, both = np.diff(np.r_[first, len(both)]), both[first]
                score += np.bincount((both & U(0xFFFF)).astype(np.int64), weights=times * table_[1][np.searchsorted(table_[0], both >> U(16))], minlength=len(lines))
            logs = [[known[w] for w in _words(t)] for t in lines]
            n_bytes = [len(t) for t in lines]
            columns = [ids, held, [len(x) for x in logs], [sum(v > none for v in x) for x in logs], [tokens] * len(lines), [math.fsum(x) for x in logs], score, n_bytes, -score / math.log10(2) / np.array(n_bytes)]
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in SCORES.split(", ")])

    return merged.repartition(tasks, "batch").sortWithinPartitions("batch", "kind").select("batch", "kind", "keys", "found", "ids", "held").mapInArrow(run, SCORES)


def text_scores(docs: DataFrame, held: Column, depth: int = DEPTH, cut: int = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    held: whether a row is kept from training. A text is its words (maximal runs of bytes
    other than ASCII white space, A-Z lower-cased) and an end. base_score is the log10
    probability under word counts with a half added, score that of the words joined by one
    space and a line feed under the context trees; bits_per_byte is its code length. Null
    and empty texts are an end alone. Repeated rows count and are scored each; null ids are
    rows like others. Without training texts every byte costs eight bits. An empty table
    gives an empty result; other columns are not read. depth is at most 5, cut 1 to depth.
    """
    spark = docs.sparkSession
    blocks = saved(_blocks(docs, id_col, text_col, held))
    size, batches = blocks.agg(F.sum("size"), F.countDistinct("batch")).first()
    if not batches:
        return spark.createDataFrame([], SCORES)
    parts, most = -(-size // PART), int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(2 * parts, most)
    asks = saved(_asks(blocks, parts, depth, cut))
    model = saved(_model(asks, tasks, depth, cut))
    totals = {r["node"]: int(r["n"]) for r in model.where(F.col("kind") == TOTAL).groupBy("node").agg(F.sum("n").alias("n")).collect()}
    answers = _answers(model, asks, _short_contexts(model, cut), tasks, depth, cut)
    return _scores(blocks, answers, totals[0], totals[1], min(batches, most), depth)


def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return text_scores(table(spark, sf_dir, "documents"), held)
