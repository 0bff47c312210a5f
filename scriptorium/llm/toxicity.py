"""Toxicity: a linear classifier with a counterfactual penalty.

Features are the presence of words and of word beginnings of 4 to 6 letters (compounds share theirs). Features
are chosen by their association with the label, then a logistic model is fitted that also pays for every change
of score when the identity terms of a labelled text are swapped for others of their group, so that neutral
mentions of groups carry no weight. Learning takes about ``rows`` labelled rows at most, those of least id hash;
scoring covers every row and whole texts.

Cases: null and empty texts get the score of a text without features; with no labelled rows, or one class only,
every score is the smoothed base rate; null labels are ignored, of several labels of an id the largest counts;
repeated rows score alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashes, materialise, ragged, small_batches

#: Bounds: labelled rows learned from, features kept, words remembered by a worker.
ROWS, FEATURES, MEMO = 40_000, 3_000, 300_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
# Groups of identity terms that can stand for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "african", "latino", "european"),
    ("gay", "lesbian", "bisexual", "straight", "trans"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "deaf", "blind", "elderly", "young"),
)
SWAP = {w: g[(i + 1) % len(g)] for g in IDENTITY for i, w in enumerate(g)}
_EDGE = re.compile(r"^\W+|\W+$")


def tokens(text: str) -> set[str]:
    """The distinct words of a text, lower case, without punctuation at their ends."""
    return {_EDGE.sub("", w) for w in set(text.lower().split())} - {""}


def word_features(word: str) -> list[str]:
    """A word's features: itself, and its beginnings."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def features(words: set[str]) -> set[str]:
    """Features of a text."""
    return {f for w in words for f in word_features(w)}


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """y, text: the labelled rows to learn from, about `rows` at most."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
    chosen = least_hashes(known, "doc_id", rows, known.count()).groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("_y", "text")


def associations(learn: DataFrame) -> DataFrame:
    """feature, pos, n: in how many of the rows, and toxic rows, a feature stands. Summed by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pos = Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = list(n)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([n[k] for k in keys], pa.int64())], ["feature", "pos", "n"])

        for batch in small_batches(batches):
            for y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = features(tokens(text or ""))
                n.update(found)
                if y:
                    pos.update(found)
            if len(n) > 500_000:
                yield out()
                n, pos = Counter(), Counter()
        yield out()

    return learn.mapInArrow(run, "feature string, pos long, n long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def select_features(stats: DataFrame, pos: int, n: int, most: int = FEATURES) -> list[str]:
    """The features that depart most from the base rate, and all identity terms."""
    rate = pos / n
    z = F.abs(F.col("pos") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) + 1)
    top = stats.filter("n >= 3").withColumn("z", z).filter("z >= 3").orderBy(F.desc("z"), "feature").limit(most).select("feature").collect()
    return sorted({r[0] for r in top} | set(SWAP))


def encoded(learn: DataFrame, names: list[str]) -> DataFrame:
    """y, on, swapped: numbers of the features in a row, and of those with its identity terms swapped."""
    index = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda words: sorted(i for f in features(words) if (i := index.get(f)) is not None)
        for batch in small_batches(batches):
            words = [tokens(t or "") for t in batch.column(1).to_pylist()]
            swapped = [of({SWAP.get(w, w) for w in ws}) if not ws.isdisjoint(SWAP) else None for ws in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(ws) for ws in words], pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.int32()))], ["y", "on", "swapped"])

    return learn.mapInArrow(run, "y int, on array<int>, swapped array<int>")


def fit(y: np.ndarray, on: tuple, swapped: tuple, d: int, steps: int = 400, ridge: float = 1e-5, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on logistic loss + ridge + penalty * mean squared change under swaps.

    on: row and feature numbers; swapped: the same with identity terms swapped, and which rows have such terms.
    """
    rows, cols = on
    also, others, has = swapped
    pair, n = np.cumsum(has) - 1, int(has.sum())
    mine = has[rows]
    pr, pc = np.r_[pair[rows[mine]], pair[also]], np.r_[cols[mine], others]
    ps = np.r_[np.ones(int(mine.sum())), -np.ones(len(also))]
    rate = np.clip(y.mean(), 0.5 / (len(y) + 1), 1 - 0.5 / (len(y) + 1))
    w, b = np.zeros(d), float(np.log(rate / (1 - rate)))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, w[cols], len(y))
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(cols, r[rows], d) + 2 * ridge * w
        if n:
            change = np.bincount(pr, ps * w[pc], n)
            g += 2 * penalty * np.bincount(pc, ps * change[pr], d) / n
        g = np.r_[g, r.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[dict[str, float], float]:
    """Weights by feature and the intercept. About `rows` rows of at most FEATURES numbers reach the driver, as Arrow buffers."""
    learn = materialise(sample(docs, labels, rows), "toxicity-sample")
    n, pos = learn.agg(F.count("*"), F.sum(F.col("_y").cast("long"))).first()
    if not n or pos in (0, n):
        rate = ((pos or 0) + 0.5) / (n + 5)
        return {}, float(np.log(rate / (1 - rate)))
    names = select_features(associations(learn), pos, n)
    got = encoded(learn, names).toArrow()
    has = got.column("swapped").is_valid().to_numpy()
    w, b = fit(got.column("y").to_numpy().astype(float), ragged(got.column("on")), (*ragged(got.column("swapped")), has), len(names))
    return {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-4}, b


def scorer(weights: dict[str, float], intercept: float):
    """A function from texts to scores, with a bounded memory of words."""
    memo: dict[str, tuple] = {}

    def scores(texts: list[str | None]) -> np.ndarray:
        out = []
        for text in texts:
            found: set[str] = set()
            for raw in set((text or "").split()):
                on = memo.get(raw)
                if on is None:
                    on = memo[raw] = tuple(f for w in tokens(raw) for f in word_features(w) if f in weights)
                if on:
                    found.update(on)
            out.append(sum(weights[f] for f in sorted(found)))
            if len(memo) > MEMO:
                memo.clear()
        return 1 / (1 + np.exp(-np.clip(intercept + np.asarray(out, float), -40, 40)))

    return scores


def scored(docs: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """doc_id, score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer(sent.value, intercept)
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def score(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from `labels`."""
    out = scored(docs, *train(docs, labels, rows))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """The documents that are not rejected, whole rows; no row shuffles."""
    weights, intercept = train(docs, labels, rows)
    sent, at = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer(sent.value, intercept)
        for batch in small_batches(batches):
            yield batch.filter(pa.array(scores(batch.column(at).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
