"""Operator 2: toxicity by a convolutional text classifier over hashed word embeddings.

A word's embedding is the concatenation of rows of three tables: two are addressed by
different hashes of the word, so that words rarely share both, one by a hash of its first
letters, so that forms of a word share it. Filters one, two and three words wide slide over a
text; each filter's highest response in the whole text goes to a logistic output. The
network is trained in numpy on the driver from a bounded sample of labelled texts, then
sent to the tasks that score. A threshold is calibrated for each language, which is
guessed from function words of the text itself; scores are shifted so that 0.5 is that
threshold.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import cut, id_and_text, per_document, table

WORD = re.compile(r"\w+")
WIDTHS = (1, 2, 3)
#: Letters that forms of a word share, and hashes of a word.
PREFIX, HASHES = 4, 3
#: At most so many labelled texts are used in training, whole.
SAMPLE_ROWS = 5000
#: Frequent function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with as was on are by this it an be from or".split(),
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "fr": "le la les des et du en un une est pour que qui dans par sur au pas plus ce".split(),
    "es": "el los las del y en un una que por con para su se lo como más al es no".split(),
}


def slots(word: str, rows: int) -> tuple[int, ...]:
    """A row of each of the three tables."""
    data = word.encode()
    return zlib.crc32(data) % rows, zlib.crc32(data[::-1], 77) % rows, zlib.crc32(word[:PREFIX].encode(), 99) % rows


class _Known(dict):
    """Slots of words, packed in one number; those of a new word are computed."""

    rows = 1

    def __missing__(self, word: str) -> int:
        i, j, k = slots(word, self.rows)
        self[word] = (i << 20 | j) << 20 | k
        return self[word]


@dataclass
class Network:
    """Weights of the classifier; tables (3, rows, part) hold the embeddings."""

    tables: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    shift: dict[str, float] = field(default_factory=dict)
    at: _Known = field(default_factory=_Known, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "at": _Known()}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def language(words: list[str]) -> str:
    """The language whose function words cover most of the text; "other" without any."""
    present = Counter(words)
    best = max((sum(present[w] for w in ws), name) for name, ws in FUNCTION_WORDS.items())
    return best[1] if best[0] else "other"


def _embedded(net: Network, codes: np.ndarray) -> np.ndarray:
    """(words, 3 * part) embeddings of words by their (words, 3) slots."""
    return np.concatenate([net.tables[t][codes[:, t]] for t in range(HASHES)], axis=1)


def _pooled(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest response of each filter over a text given by its embeddings, and where it was (-1: below zero everywhere)."""
    places = [f[j] for w, f in net.filters.items() for j in range(w)]
    each = x @ np.concatenate(places, axis=1)  # one product for all filters and their places
    best, place, at = [], [], 0
    for w, f in net.filters.items():
        n, m = f.shape[2], len(x) - w + 1
        if m < 1:
            best.append(np.zeros(n, dtype=np.float32))
            place.append(np.full(n, -1))
        else:
            r = each[:m, at : at + n].copy()
            for j in range(1, w):
                r += each[j : j + m, at + j * n : at + (j + 1) * n]
            k = r.argmax(axis=0)
            best.append(np.maximum(r[k, np.arange(n)] + net.bias[w], 0))
            place.append(np.where(best[-1] > 0, k, -1))
        at += w * n
    return np.concatenate(best), np.concatenate(place)


def _logit(net: Network, pooled: np.ndarray) -> float:
    return float(pooled @ net.out + net.out_bias)


def train(texts: list[str], labels: list[int], rows: int = 1 << 17, part: int = 4, n_filters: int = 6, epochs: int = 4, rate: float = 0.05, seed: int = 5, widths: tuple[int, ...] = WIDTHS) -> Network:
    """Fit a network to four fifths of the labelled texts with Adagrad; calibrate a threshold for each language on the rest.

    The first coordinate of each table starts from the smoothed log-odds of the label
    among the texts that hold a slot; slots met in fewer than three training texts keep
    the zero vector, so that rare words say nothing. Without both labels among the texts
    every score is the share of label 1.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float64)
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    net = Network(
        tables=np.zeros((HASHES, rows, part), dtype=np.float32),
        filters={w: rng.normal(0, 0.1, (w, HASHES * part, n_filters)).astype(np.float32) for w in widths},
        bias={w: np.full(n_filters, -1.5, dtype=np.float32) for w in widths},
        out=np.full(len(widths) * n_filters, 0.3),
        out_bias=float(np.log(share / (1 - share))),
    )
    if not 0 < y.sum() < len(y):
        net.out[:] = 0
        return net
    coded, langs, known = [], [], {}
    for t in texts:  # the words themselves are not kept
        ws = words_of(t)
        coded.append(np.array([known.get(w) or known.setdefault(w, slots(w, rows)) for w in ws], dtype=np.int32).reshape(-1, HASHES))
        langs.append(language(ws))
        if len(known) > 300_000:
            known.clear()
    fold = np.zeros(len(y), bool)
    for v in (0, 1):
        fold[np.flatnonzero(y == v)[4::5]] = True
    learn = np.flatnonzero(~fold)
    common = np.zeros((HASHES, rows), bool)
    for t in range(HASHES):
        seen = np.zeros((rows, 2))
        for i in learn:
            seen[np.unique(coded[i][:, t]), int(y[i])] += 1
        odds = np.log((seen[:, 1] + 0.5 * share) / (y[learn].sum() + 1)) - np.log((seen[:, 0] + 0.5 * (1 - share)) / (len(learn) - y[learn].sum() + 1))
        common[t] = seen.sum(axis=1) >= 3
        net.tables[t][common[t]] = rng.normal(0, 0.02, (int(common[t].sum()), part))
        net.tables[t][common[t], 0] = np.clip(odds[common[t]], -2, 6) / 2
    for f in net.filters.values():  # filters begin as detectors of strong words
        f[:, ::part, :] += 1 / (HASHES * len(f))
    past = {w: np.full(f.shape, 1e-2, dtype=np.float32) for w, f in net.filters.items()}
    past_out, past_bias, past_tables = np.full(net.out.shape, 1e-2), {w: np.full(n_filters, 1e-2, dtype=np.float32) for w in widths}, np.full(net.tables.shape, 1e-2, dtype=np.float32)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).clip(0.2, 5)
    for _ in range(epochs):
        for i in rng.permutation(learn):
            pooled, where = _pooled(net, _embedded(net, coded[i]))
            g = weight[i] * (1 / (1 + np.exp(-_logit(net, pooled))) - y[i])
            d, g_out = g * net.out, g * pooled + 1e-4 * net.out
            past_out += g_out * g_out
            net.out -= rate * g_out / np.sqrt(past_out)
            net.out_bias -= rate * 0.1 * g
            at = 0
            for w in widths:
                for n in range(n_filters):
                    k = where[at + n]
                    if k < 0:
                        continue
                    codes, f = coded[i][k : k + w], net.filters[w][:, :, n]
                    gf, gx = d[at + n] * _embedded(net, codes), d[at + n] * f
                    past[w][:, :, n] += gf * gf
                    net.filters[w][:, :, n] -= rate * gf / np.sqrt(past[w][:, :, n])
                    for t in range(HASHES):
                        live = common[t][codes[:, t]]
                        at_, own = codes[live, t], gx[live, t * part : (t + 1) * part]
                        past_tables[t][at_] += own * own
                        net.tables[t][at_] -= rate * own / np.sqrt(past_tables[t][at_])
                    past_bias[w][n] += d[at + n] ** 2
                    net.bias[w][n] -= rate * 0.3 * d[at + n] / np.sqrt(past_bias[w][n])
                at += n_filters
    held = np.flatnonzero(fold)
    if not 0 < y[held].sum() < len(held):
        held = np.arange(len(y))
    _calibrate(net, [langs[i] for i in held], [coded[i] for i in held], y[held])
    return net


def _calibrate(net: Network, langs: list[str], coded: list[np.ndarray], y: np.ndarray) -> None:
    """For each language the logit that separates the labels best, drawn to the common one where examples are few."""
    logits = np.array([_logit(net, _pooled(net, _embedded(net, c))[0]) for c in coded])
    langs = np.array(langs)

    def best(rows: np.ndarray) -> float:
        order = np.argsort(logits[rows])
        z, t = logits[rows][order], y[rows][order]
        wrong = np.cumsum(np.r_[0, t]) + np.cumsum(np.r_[1 - t, 0][::-1])[::-1]  # threshold before each place
        at = np.flatnonzero(wrong == wrong.min())
        middle = at[len(at) // 2]
        low, high = (z[middle - 1] if middle else z[0] - 1), (z[middle] if middle < len(z) else z[-1] + 1)
        return float(low + 0.4 * (high - low))  # examples of label 0 are many, so its end of the gap is the better known

    everyone = best(np.arange(len(y)))
    net.shift = {"": everyone}
    for name in set(langs):
        rows = np.flatnonzero(langs == name)
        if 0 < y[rows].sum() < len(rows):
            k = y[rows].sum()
            net.shift[str(name)] = (k * best(rows) + 5 * everyone) / (k + 5)


def score(net: Network, text: str) -> float:
    words = words_of(text)
    known = net.at
    known.rows = net.tables.shape[1]
    if len(known) > 300_000:
        known.clear()
    both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    codes = np.stack([both >> 40, both >> 20 & 0xFFFFF, both & 0xFFFFF], axis=1)
    z = _logit(net, _pooled(net, _embedded(net, codes))[0])
    shift = net.shift.get(language(words) if net.shift else "", net.shift.get("", 0.0))
    return float(1 / (1 + np.exp(-np.clip(z - shift, -30, 30))))


def labelled(docs: DataFrame, labels: DataFrame, label: str, eligible, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, _label): whole texts of at most `rows` labelled documents, those of smallest hash; eligible: which ids may be used.

    A doc_id that several labels or texts carry counts once, with the greatest of each.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label")).where(eligible(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return id_and_text(docs, id_col, text_col).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("_label").alias("_label"))


def fit(docs: DataFrame, labels: DataFrame, label: str, eligible, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> tuple[list[str], list[int]]:
    """The texts and labels of labelled(), in the order of their ids."""
    got = sorted(labelled(docs, labels, label, eligible, id_col, text_col, rows).collect())
    return [t for _, t, _ in got], [m for *_, m in got]


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, score.

    Whole texts are read. A null or empty text has no words and gets the score of the
    output's bias; repeated rows and equal texts get equal scores. Null ids are scored
    like others. An empty table gives an empty result; other columns are not read.
    """

    def rows(ids, texts):
        return {"doc_id": ids, "score": [score(net, t) for t in texts]}

    return per_document(id_and_text(docs, id_col, text_col), rows, "doc_id long, score double")


def may_train(doc_id):
    """Documents outside the fold that is held out."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, from a network trained on the labels outside the held-out fold."""
    net = train(*fit(docs, labels, "toxic", may_train))
    scored = score_documents(docs, net)
    return scored.select("doc_id", F.coalesce(~may_train(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without those that score 0.5 or more; columns as they were. Null texts count as empty."""
    net = train(*fit(docs, labels, "toxic", may_train))

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([score(net, t if isinstance(t, str) else "") < 0.5 for t in texts], dtype=bool)

    return docs.where(clean(F.col(text_col)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
