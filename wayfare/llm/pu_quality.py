"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network by minimising the
non-negative unbiased risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

with the sigmoid loss's smooth cousin (logistic). The class prior is estimated, not
given: from labelled training rows where there are any negatives among them, and
otherwise from the unlabelled score mass above what positives reach.

Features are counts over the bytes and words of the whole text: shares of character
classes, repeated and distinct words, word and sentence lengths, line shapes. No
label, language, source or id is among them.

Training takes at most `sample` positives and `sample` unlabelled rows (lowest hashes
of doc_id), which is the documented bound; the driver gets their features, not their
texts. Every text is scored, in the tasks.

Defined cases. Null text scores as the empty one. Labels of ids that documents lack,
null labels and repeated labels play no part beyond one row per id (the smallest
label). Without unlabelled rows the labelled negatives stand in for them; without any
positive to learn from, or anything to tell it from, every score is the prior 0.5. Texts of
any length are scored whole. Rows with equal ids and texts get equal results. Other columns,
whatever their names, pass through `keep_good`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.llm.textwords import Words, chunks

#: Fixed character classes (bytes).
_CLASSES = [
    range(97, 123), range(65, 91), range(48, 58), [32], [10], [9, 11, 12, 13], b".", b",", b"!", b"?", b";:", b"%",
    b"$", b"&", b"#", b"*", b"@", b"=", b"/\\|", b"<>", b"()[]{}", b"-_+~^", b"\"'`", range(128, 192), range(192, 256), range(0, 9),
]
_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _c in enumerate(_CLASSES):
    _OF[list(_c)] = _i
WIDTH = len(_CLASSES) + 1 + 12


def features(words: Words) -> np.ndarray:
    """(rows, WIDTH): finite for every text."""
    rows, n = len(words.rows), len(words.data)
    size = np.diff(words.offsets)
    row = np.repeat(np.arange(rows), size)
    kinds = len(_CLASSES) + 1
    counts = np.bincount(row * kinds + _OF[words.data], minlength=rows * kinds).reshape(rows, kinds).astype(float)
    share = counts / np.maximum(size, 1)[:, None]
    n_words = np.diff(words.first)
    of_word = np.repeat(np.arange(rows), n_words)
    h = words.hashes
    per = np.maximum(n_words, 1).astype(float)
    again = np.zeros(rows)
    if len(h) > 1:
        same = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
        again = np.bincount(of_word[1:][same], minlength=rows).astype(float)
    distinct, top, twice, half = np.zeros(rows), np.zeros(rows), np.zeros(rows), np.zeros(rows)
    for i in range(rows):
        own = h[words.first[i] : words.first[i + 1]]
        if len(own):
            _, c = np.unique(own, return_counts=True)
            distinct[i], top[i] = len(c), c.max()
            if len(own) > 1:
                pair = np.unique(own[1:] * np.uint64(31) + own[:-1])
                twice[i] = 1 - len(pair) / (len(own) - 1)
            d = (own[1:] == own[:-1]).astype(float)
            # the worst stretch of 20 words, so that junk in a long clean text still shows
            half[i] = np.convolve(d, np.ones(20), "valid").max() / 20 if len(d) >= 20 else d.mean() if len(d) else 0
    # the worst stretch of 256 bytes, for odd characters and for upper case
    odd = np.isin(_OF[words.data], [8, 11, 12, 13, 14, 15]).astype(np.float64)
    upper = (_OF[words.data] == 1).astype(np.float64)
    worst_odd, worst_up, mean_odd = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    for i in range(rows):
        a, b = words.offsets[i], words.offsets[i + 1]
        if b > a:
            edge = np.arange(a, b, 256) - a
            length = np.minimum(256, b - a - edge)
            o, u = np.add.reduceat(odd[a:b], edge) / np.maximum(length, 64), np.add.reduceat(upper[a:b], edge) / np.maximum(length, 64)
            worst_odd[i], worst_up[i] = o.max(), u.max()
            mean_odd[i] = (o > 0.05).mean()
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 23] + counts[:, 24], 1)
    more = np.stack(
        [
            np.log1p(size), np.log1p(n_words), size / per / 10, again / per, distinct / per, top / per, twice, half,
            worst_odd, worst_up, mean_odd, counts[:, 1] / letters,
        ],
        1,
    )
    return np.concatenate([share * 4, more], 1)


def _train(x: np.ndarray, positive: np.ndarray, prior: float, hidden: int = 24, epochs: int = 60, seed: int = 7) -> dict:
    """Non-negative PU risk by Adam on one hidden layer; full passes in batches."""
    rng = np.random.default_rng(seed)
    mean, sd = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / sd, -8, 8)
    p, u = z[positive], z[~positive]
    w = {"a": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), "b": np.zeros(hidden), "c": rng.normal(0, 1 / np.sqrt(hidden), hidden), "d": np.zeros(1)}
    m, v, t = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2)), None, 0
    m, v = m
    sig = lambda s: 1 / (1 + np.exp(-np.clip(s, -40, 40)))

    def back(rows: np.ndarray, slope) -> dict:
        h = np.tanh(rows @ w["a"] + w["b"])
        g = slope(h @ w["c"] + w["d"]) / len(rows)
        gh = g[:, None] * w["c"] * (1 - h * h)
        return {"a": rows.T @ gh, "b": gh.sum(0), "c": h.T @ g, "d": np.array([g.sum()])}

    def score(rows: np.ndarray) -> np.ndarray:
        return np.tanh(rows @ w["a"] + w["b"]) @ w["c"] + w["d"]

    steps = max(1, len(u) // 512)
    for epoch in range(epochs):
        ip, iu = rng.permutation(len(p)), rng.permutation(len(u))
        for s in range(steps):
            bp, bu = p[ip[s::steps]] if len(p) >= steps else p, u[iu[s::steps]]
            sp, su = score(bp), score(bu)
            # losses are softplus; the negative part may not go below zero
            negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
            gu, gn = back(bu, sig), back(bp, sig)
            if negative >= 0:
                gp = back(bp, lambda s: -sig(-s))
                g = {k: prior * gp[k] + gu[k] - prior * gn[k] for k in w}
            else:  # step back from over-fitting the unlabelled rows
                g = {k: prior * gn[k] - gu[k] for k in w}
            t += 1
            for k in w:
                g[k] = g[k] + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] -= 0.01 * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w | {"mean": mean, "sd": sd}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["sd"], -8, 8)
    s = np.tanh(z @ model["a"] + model["b"]) @ model["c"] + model["d"]
    return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = np.concatenate([features(w) for w in chunks(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x))], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8_000, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> dict | None:
    """A model, or None without positives. labels: only rows that may be learnt from."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_y"))
    totals = known.agg(F.avg((F.col("_y") == 1).cast("double")).alias("p"), F.count_if(F.col("_y") == 1).alias("n")).first()
    if not totals["n"]:
        return None
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))

    def lowest(df: DataFrame) -> DataFrame:
        return df.orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(sample)

    # ids first, then the texts of the few that were drawn
    ids = lowest(known.filter("_y = 1").select("_id")).withColumn("y", F.lit(1))
    rest = rows.select("_id").filter(F.col("_id").isNotNull()).join(known.select("_id"), "_id", "left_anti")
    rest = lowest(rest)
    if rest.isEmpty():
        rest = lowest(known.filter("_y <> 1").select("_id"))
    ids = ids.union(rest.withColumn("y", F.lit(0)))
    drawn = rows.join(F.broadcast(ids), "_id").select("y", "text").mapInArrow(_featurise, "y int, x array<double>").collect()
    y = np.array([r["y"] for r in drawn])
    if not (y == 1).any() or not (y == 0).any():
        return None
    x = np.array([r["x"] for r in drawn])
    prior = float(totals["p"])
    if prior == 1.0:  # no negatives known: mass of unlabelled rows that look like positives
        z = (x - x[y == 1].mean(0)) / (x[y == 1].std(0) + 1e-6)
        far = np.abs(z).max(1)
        prior = float(np.clip((far[y == 0] <= np.quantile(far[y == 1], 0.99)).mean(), 0.05, 0.99))
    return _train(x, y == 1, prior) | {"prior": prior}


def score(docs: DataFrame, model: dict | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' (doc_id, score), one row per row."""
    return with_scores(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model, "text", "score").drop("text")


def with_scores(docs: DataFrame, model: dict | None, text: str, name: str) -> DataFrame:
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = np.concatenate([predict(shared.value, features(w)) for w in chunks(batch.column(text))])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: dict | None, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs whose score reaches the threshold; columns stay."""
    from wayfare.llm.common import free_name

    name = free_name(docs, "_score")
    return with_scores(docs, model, text, name).filter(F.col(name) >= threshold).drop(name)
