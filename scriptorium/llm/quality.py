"""Quality classifier from weak labels.

Seven overlapping heuristic labellers vote 1 (good), 0 (junk) or -1 (abstain) on every document. The counts of vote
patterns over all documents, at most 3^7 of them, are what expectation-maximisation needs to estimate how often
each labeller votes what on good and on junk documents, and the share of good ones. The posterior of each
document's pattern is its soft label. A hashed linear scorer, on the shapes of words, is then trained on the soft
labels of about ``rows`` documents, those of least key hash, and scores every document. Texts are read once: votes
and hashed features are written, and everything else works on these.

Cases: null and empty texts have no words: labellers abstain, and posterior, score and keep come from that; with
no documents there are no rows; repeated rows score alike; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashes, materialise, ragged, row_key

#: Bounds: documents trained on, width of the hashed features, words remembered by a worker.
ROWS, WIDTH, MEMO = 20_000, 1 << 12, 300_000
LABELLERS = ("symbols", "tails", "shouting", "stutter", "variety", "lines", "ending")


def shape(word: str) -> str:
    """A word with its letters as a, capitals as A, digits as 0; runs of one kind shortened to two, of a to one."""
    out: list[str] = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not (out and out[-1] == k and (k == "a" or len(out) > 1 and out[-2] == k)):
            out.append(k)
    return "".join(out)


class Shapes(dict):
    """Shapes of words, bounded in entries."""

    def __missing__(self, word: str) -> str:
        if len(self) > MEMO:
            self.clear()
        found = self[word] = shape(word)
        return found


def vote(value: float, good: float, junk: float) -> int:
    """1 up to `good`, 0 from `junk` on, else abstain."""
    return 1 if value <= good else 0 if value >= junk else -1


def profile(text: str, shapes: Shapes) -> tuple[list[int], Counter]:
    """Votes of all labellers, and counts of features."""
    words = text.split()
    n = len(words)
    if not n:
        return [-1] * len(LABELLERS), Counter()
    counts = Counter(map(shapes.__getitem__, words))
    share = lambda test: sum(k for s, k in counts.items() if test(s)) / n
    stutter = sum(map(eq, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    again = len(lines) - len(set(lines))
    variety = len(set(words)) / n**0.5
    votes = [
        vote(share(lambda s: s.isascii() and not any(c in "Aa0" for c in s)), 0.02, 0.08),
        vote(share(lambda s: len(s) > 2 and s[-1] == s[-2] and s[-1] not in "Aa0."), 0.01, 0.08),
        vote(share(lambda s: s.startswith("AA") and "a" not in s), 0.03, 0.15),
        vote(stutter / n, 0.02, 0.08),
        -1 if n < 20 else vote(-variety, -4.0, -3.0),
        -1 if len(lines) < 4 else vote(again / len(lines), 0.2, 0.4),
        1 if text.rstrip()[-1:] in ".!?" else -1,
    ]
    counts["\x00stutter"], counts["\x00lines"] = stutter, again
    counts["\x00few"] = n if n >= 20 and variety < 3.5 else 0
    return votes, counts


def vector(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of a document's hashed features: square roots of shares of words."""
    import xxhash

    found: dict[int, float] = {}
    n = sum(k for s, k in counts.items() if s[:1] != "\x00")
    for s, k in counts.items():
        if k:
            i = xxhash.xxh64_intdigest(s, 7) % WIDTH
            found[i] = found.get(i, 0.0) + (k / n) ** 0.5
    return np.fromiter(found, int, len(found)), np.fromiter(found.values(), float, len(found))


def profiled(docs: DataFrame) -> DataFrame:
    """doc_id, key, pattern (votes as text, like 1,0,-1), i, v (hashed features) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [profile(t or "", shapes) for t in part.column(2).to_pylist()]
                x = [vector(counts) for _, counts in found]
                ends = pa.array(np.cumsum([0, *(len(i) for i, _ in x)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c).astype(t))) for c, t in zip(zip(*x, strict=True), (np.int16, np.float32), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([",".join(map(str, votes)) for votes, _ in found]), *lists], ["doc_id", "key", "pattern", "i", "v"])

    return docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(run, "doc_id long, key long, pattern string, i array<short>, v array<float>")


#: Most that a labeller is taken to vote junk on good documents; their thresholds are set to be that precise.
MISTAKEN = 0.003


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, mistaken: float = MISTAKEN) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of good by pattern, the share of good, and P(vote | class) as [labeller, class, vote + 1].

    Junk is of several kinds, each seen by a few labellers only, so plain likelihood may settle on one kind and
    explain the others as mistakes on good documents. The bound on such mistakes keeps all kinds.
    """
    ones, zeros = (patterns == 1).sum(axis=1), (patterns == 0).sum(axis=1)
    good = np.where(zeros > 0, 0.1, np.where(ones > 0, 0.95, 0.5)).astype(float)
    prior, table = 0.5, np.zeros((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        prior = (np.dot(counts, good) + 1) / (counts.sum() + 2)
        for v in range(3):
            on = patterns == v - 1
            for k, share in ((1, good), (0, 1 - good)):
                table[:, k, v] = (counts * share) @ on + 0.5
        table /= table.sum(axis=2, keepdims=True)
        more = np.maximum(table[:, 1, 1] - mistaken, 0)
        table[:, 1, 1] -= more
        table[:, 1, 2] += more
        picked = np.log(table)[np.arange(patterns.shape[1])[None, :, None], np.arange(2)[None, None, :], patterns[:, :, None] + 1].sum(axis=1)
        odds = np.log(prior) + picked[:, 1] - np.log(1 - prior) - picked[:, 0]
        now = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    return good, float(prior), table


def label_model(votes: DataFrame) -> tuple[dict[str, float], int]:
    """Posterior of good for each vote pattern, from the counts over all documents, and the number of documents."""
    rows = votes.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # at most 3^7 rows
    if not rows:
        return {}, 0
    patterns = np.array([[int(v) for v in r["pattern"].split(",")] for r in rows])
    good, _, _ = expectation_maximisation(patterns, np.array([r["n"] for r in rows], float))
    return {r["pattern"]: float(g) for r, g in zip(rows, good, strict=True)}, sum(r["n"] for r in rows)


def fit(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, soft: np.ndarray, steps: int = 300, ridge: float = 1e-5) -> np.ndarray:
    """Weights and, last, the intercept of a logistic model on soft labels, by Adam. rows, cols, vals: the features that are not zero."""
    n, cols = len(soft), cols.astype(np.int64)
    w, m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(rows, vals * w[cols], n)
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft) / n
        g = np.r_[np.bincount(cols, vals * r[rows], WIDTH) + 2 * ridge * w[:-1], r.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def train(profiles: DataFrame, posterior: dict[str, float], total: int, rows: int = ROWS) -> np.ndarray:
    """Weights of the hashed linear scorer. About `rows` documents' features reach the driver, as Arrow buffers."""
    chosen = least_hashes(profiles, "key", rows, total).dropDuplicates(["doc_id", "key"]).orderBy("key", "doc_id").select("pattern", "i", "v")
    got = chosen.toArrow()
    if not got.num_rows:
        return np.zeros(WIDTH + 1)
    soft = np.array([posterior[p] for p in got.column("pattern").to_pylist()])
    return fit(*ragged(got.column("i")), ragged(got.column("v"))[1].astype(float), soft)


def classify(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, posterior (of the label model), score (of the scorer), keep (score of 0.5 or more)."""
    profiles = materialise(profiled(docs), "quality-profiles")
    posterior, total = label_model(profiles)
    sent = docs.sparkSession.sparkContext.broadcast((posterior, train(profiles, posterior, total, rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = sent.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            at, cols = ragged(table.column("i"))
            z = w[-1] + np.bincount(at, ragged(table.column("v"))[1] * w[cols], batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            post = [known[p] for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(post, pa.float64()), pa.array(score, pa.float64()), pa.array(score >= 0.5)], ["doc_id", "posterior", "score", "keep"])

    return profiles.select("doc_id", "pattern", "i", "v").mapInArrow(run, "doc_id long, posterior double, score double, keep boolean")
