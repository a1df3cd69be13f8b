"""Settings of the classifiers, compared by cross-validation within the rows that may teach.

    python -m skein.llm.tuning /root/testdata/sf0.1

Held-out rows are neither trained on nor scored here.
"""

from __future__ import annotations

import sys

import numpy as np

from skein.llm import quality, toxicity
from skein.llm.common import table


def folds(n: int, parts: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows to learn from, rows to test on) of each part."""
    at = np.arange(n) % parts
    return [(np.flatnonzero(at != k), np.flatnonzero(at == k)) for k in range(parts)]


def toxicity_accuracy(texts: list[str], y: list[int], **settings) -> float:
    """Mean accuracy of networks with these settings of toxicity.train()."""
    right = []
    for learn, test in folds(len(y)):
        net = toxicity.train([texts[i] for i in learn], [y[i] for i in learn], **settings)
        right += [(toxicity.score(net, texts[i]) >= 0.5) == y[i] for i in test]
    return float(np.mean(right))


def quality_accuracy(texts: list[str], y: list[int], used: int = quality.N_FEATURES) -> float:
    """Mean accuracy by the first `used` features; 1 is the size difference alone."""
    right = []
    for learn, test in folds(len(y)):
        good, bad, w = quality.train([texts[i] for i in learn], [y[i] for i in learn], used=used)
        right += [(np.dot(w[:-1], quality.features(texts[i], good, bad)) + w[-1] >= 0) == y[i] for i in test]
    return float(np.mean(right))


def main(sf_dir: str) -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    some = toxicity.fit(docs, labels, "toxic", toxicity.may_train)
    for settings in ({}, {"widths": (1,)}, {"widths": (1, 2)}, {"n_filters": 4}, {"n_filters": 10}, {"epochs": 2}, {"epochs": 8}):
        print("toxicity", settings, round(toxicity_accuracy(*some, **settings), 4), flush=True)
    some = toxicity.fit(docs, labels, "quality", quality.may_train, rows=quality.SAMPLE_ROWS)
    for used in range(1, quality.N_FEATURES + 1):
        print("quality, features used:", used, round(quality_accuracy(*some, used=used), 4), flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
