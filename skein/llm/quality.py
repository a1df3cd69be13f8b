"""Operator 4: text quality by compression against dictionaries.

Two zstandard dictionaries are trained, by the library's own trainer and over whole texts,
from texts labelled good and from texts labelled bad. A text is compressed with each, block
by block, so that every block is judged by the dictionary and not by what precedes it. The
difference of the two sizes for each byte of text, over the whole text and in its worst and
best blocks, with the share that the good dictionary leaves, is calibrated to a score by
logistic regression.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import id_and_text, per_document, table
from skein.llm.toxicity import fit

#: Labelled texts used in training; bytes of each dictionary at most, and of a block; zstandard's level.
SAMPLE_ROWS, DICTIONARY, BLOCK, LEVEL = 5000, 1 << 17, 256, 6
N_FEATURES = 4
#: Bytes of an empty frame without size, checksum and dictionary id; bytes of a sample that the trainer takes at least.
FRAME, LEAST = 6, 8


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A dictionary trained over all of these texts; the texts themselves, joined, where they are too few to train one."""
    some = [t for t in texts if len(t) >= LEAST]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, some)) // 4)), some).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[:size]


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**plain)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), **plain)


def features(text: str, good: bytes, bad: bytes) -> tuple[float, ...]:
    """Size difference for each byte of the whole text, of its worst and of its best block, and the share of its bytes that the
    good dictionary leaves; zeros for an empty text."""
    data = text.encode()
    if not data:
        return (0.0,) * N_FEATURES
    view, by_good, by_bad = memoryview(data), _compressor(good).compress, _compressor(bad).compress
    starts = range(0, len(data), BLOCK)
    x = np.array([len(by_good(view[at : at + BLOCK])) for at in starts]) - FRAME
    y = np.array([len(by_bad(view[at : at + BLOCK])) for at in starts]) - FRAME
    n = np.full(len(starts), BLOCK)
    n[-1] = len(data) - starts[-1]
    each = (y - x) / n
    return (y.sum() - x.sum()) / len(data), each.min(), each.max(), x.sum() / len(data)


def train(texts: list[str], labels: list[int], steps: int = 60, used: int = N_FEATURES) -> tuple[bytes, bytes, np.ndarray]:
    """Dictionaries of good and bad texts, and logistic weights (one for each of the first `used` features, 0 for the others, then the bias).

    Two thirds of the texts make the dictionaries, the rest the calibration. Without both
    labels every score is the smoothed share of label 1.
    """
    y = np.array(labels, dtype=float)
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
    flat = np.r_[np.zeros(N_FEATURES), np.log(share / (1 - share))]
    if not 0 < y.sum() < len(y):
        return b"", b"", flat
    held = np.zeros(len(y), bool)
    for v in (0, 1):
        held[np.flatnonzero(y == v)[2::3]] = True
    good, bad = (_dictionary([t.encode() for t, label, h in zip(texts, labels, held) if label == v and not h], DICTIONARY) for v in (1, 0))
    rows = np.flatnonzero(held)
    if not 0 < y[rows].sum() < len(rows):
        return good, bad, np.r_[20.0, np.zeros(N_FEATURES)]
    x = np.array([features(texts[i], good, bad) for i in rows]) * (np.arange(N_FEATURES) < used)
    middle, scale, t = x.mean(axis=0), x.std(axis=0) + 1e-9, y[rows]
    x = np.c_[(x - middle) / scale, np.ones(len(x))]
    w = np.zeros(N_FEATURES + 1)
    for _ in range(steps):  # Newton's steps with a penalty, kept short
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        d = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 0.1 * np.eye(len(w)), x.T @ (p - t) + 0.1 * w)
        w -= np.clip(d, -2, 2)
        if np.abs(d).max() < 1e-6:
            break
    return good, bad, np.r_[w[:-1] / scale, w[-1] - (w[:-1] * middle / scale).sum()]


def score_documents(docs: DataFrame, good: bytes, bad: bytes, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, score.

    Whole texts are compressed. A null or empty text has features zero and so the score of
    the bias; repeated rows and equal texts get equal scores; null ids are scored like
    others. An empty table gives an empty result; other columns are not read.
    """

    def rows(ids, texts):
        z = np.array([np.dot(weights[:-1], features(t, good, bad)) + weights[-1] for t in texts])
        return {"doc_id": ids, "score": (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()}

    return per_document(id_and_text(docs, id_col, text_col), rows, "doc_id long, score double")


def may_train(doc_id):
    """Documents outside the fold that is held out."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, from dictionaries of the labelled texts outside the held-out fold."""
    scored = score_documents(docs, *train(*fit(docs, labels, "quality", may_train, rows=SAMPLE_ROWS)))
    return scored.select("doc_id", F.coalesce(~may_train(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
