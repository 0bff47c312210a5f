r"""Personal data with a skip-chain conditional random field.

Fixed patterns give base spans: e-mail addresses, IP addresses, card and phone numbers. They all stay. The field adds
spans that the patterns miss, such as a phone number that a document first gives in full and then without its plus sign.

Its variables are a document's candidates: the base spans, whose labels are given, and what else looks like a number or
holds an @. Neighbours are linked in a chain; distant candidates that repeat or resemble each other (the same name
before the @, the same last DIGITS digits) share a potential through a hub of their own, so a token that stands a
thousand times costs a thousand links and not their pairs. Loopy belief propagation runs over all documents of a batch
at once, and a candidate becomes a span where its marginal of a label reaches SURE and it could be of that kind at all.
All other words are no candidates: they can have no label but "none", which cuts the chain, so leaving them out is exact.

The potentials are trained piecewise, on a bounded sample of documents (ROWS) with the base spans as labels: how often
each pattern of a candidate has each label, and how often labels meet in a chain and among similar candidates. Patterns
are of a fixed set, so the counts that reach the driver do not grow with the corpus.

Cost. Each search is linear in a text: a run of characters is looked at a bounded number of times, however long.

Cases: a null text counts as empty, and an empty one has no spans; rows are independent, so repeated rows, ties and null
or repeated ids are all scored, each alone; a sample without candidates gives a field that adds nothing; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashes, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Labels: none, then KINDS. Documents of the training sample; digits that make two numbers alike; least marginal of an added span.
NONE, LABELS, ROWS, DIGITS, SURE = 0, 1 + len(KINDS), 20_000, 7, 0.9
#: Most characters between neighbours in the chain; rounds of message passing, share of the old message that is kept, change at which it ends.
NEAR, PASSES, DAMPING, STILL = 3, 30, 0.3, 1e-4
#: Pseudo-counts of the label shares for a pattern, and of independence for pairs; largest pair potential.
PRIOR, PAIRS, LARGEST = 1.0, 0.5, 6.0

# The base patterns. Possessive forms take the same matches, as nothing after them could use what they give back.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A number of several groups that touches no letter.
NUMBER = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9])*+(?![A-Za-z0-9])")

Span = tuple[int, int, int]  # label, start, end


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    twice = str.maketrans("0123456789", "0246813579")
    return (sum(map(int, digits[-1::-2])) + sum(map(int, digits[-2::-2].translate(twice)))) % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _octets(s: str) -> bool:
    """Whether all parts are at most 255; they can be of any length."""
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: for each @, the run of local characters before it that no match has taken, if a domain follows."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start. Kinds are looked for apart from each other."""
    found = [(1, a, b) for a, b in emails(text)]
    found += [(2, *m.span()) for m in IP.finditer(text) if _octets(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((3, *m.span()))
    return found + [(4, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]


def written(spans: list[Span]) -> str:
    """kind:start:end of each span, by kind and start."""
    return ",".join(f"{KINDS[k - 1]}:{a}:{b}" for k, a, b in sorted(spans))


# Candidates and their features.


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Base spans with their labels, and the numbers and words with an @ between them with label -1, by start."""
    taken = sorted((a, b, k) for k, a, b in base)
    out, last = [], 0  # of base spans that overlap, the first counts here; all of them are reported
    for a, b, k in taken:
        if a >= last:
            out.append((k, a, b))
            last = b
    starts, ends = [s[1] for s in out], [s[2] for s in out]
    free = []
    at = text.find("@")
    while at >= 0:
        a = b = at
        while a > 0 and text[a - 1] in LOCAL:
            a -= 1
        while b + 1 < len(text) and (text[b + 1] in LOCAL or text[b + 1] == "@"):
            b += 1
        free.append((a, b + 1))
        at = text.find("@", b + 1)
    words = list(free)
    i = 0
    for m in NUMBER.finditer(text):
        while i < len(words) and words[i][1] <= m.start():
            i += 1
        if i == len(words) or words[i][0] >= m.end():
            free.append(m.span())
    i = 0
    for a, b in sorted(free):
        while i < len(out) and i < len(ends) and ends[i] <= a:
            i += 1
        if i == len(ends) or starts[i] >= b:
            out.append((-1, a, b))
    return sorted(out, key=lambda s: s[1])


def pattern(s: str) -> str:
    """What the field sees of a candidate: form, number of digits, separators, and the checks of the kinds. One of a fixed set."""
    if "@" in s:
        name, _, rest = s.partition("@")
        return f"@{int(bool(name))}{int(DOMAIN.fullmatch(rest) is not None)}"
    d = _digits(s)
    marks = "".join(c for c in "+(.- " if c in s)
    four = s.count(".") == 3 and re.fullmatch("[0-9.]+", s) is not None and _octets(s)
    return f"{min(len(d), 20)}{marks}{'i' * four}{'l' * (16 <= len(d) <= 19 and luhn(d))}"


def likeness(s: str) -> str | None:
    """Candidates of a document with the same value are alike."""
    if "@" in s:
        return "@" + s.partition("@")[0].lower()
    d = _digits(s)
    return d[-DIGITS:] if len(d) >= DIGITS else None


def could_be(label: int, s: str) -> bool:
    """Whether a candidate has what its kind cannot do without."""
    n = len(_digits(s))
    return ("@" in s, s.count(".") == 3, 12 <= n <= 19, 7 <= n <= 15)[label - 1] and (label == 1) == ("@" in s)


def links(text: str, found: list[Span]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Neighbours in the chain, and groups of two or more that are alike."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1][1] - found[i][2] <= NEAR]
    groups = defaultdict(list)
    for i, (_, a, b) in enumerate(found):
        key = likeness(text[a:b])
        if key:
            groups[key].append(i)
    return chain, [g for g in groups.values() if len(g) > 1]


# The field.


@dataclass
class Weights:
    """Log potentials: of a pattern's labels, of labels side by side, and of labels of candidates that are alike."""

    patterns: dict[str, np.ndarray] = field(default_factory=dict)
    unseen: np.ndarray = field(default_factory=lambda: np.log(np.array([1.0] + [1e-6] * len(KINDS))))
    chain: np.ndarray = field(default_factory=lambda: np.zeros((LABELS, LABELS)))
    alike: np.ndarray = field(default_factory=lambda: np.zeros((LABELS, LABELS)))


def _together(n: np.ndarray) -> np.ndarray:
    """log of how much more often two labels meet than by chance, from counts of pairs."""
    if not n.sum():
        return np.zeros_like(n)
    p = n / n.sum()
    chance = np.outer(p.sum(axis=1), p.sum(axis=0))
    share = (n + PAIRS * chance + 1e-9) / (n.sum() + PAIRS)
    return np.clip(np.log(share / (chance + 1e-9)), -LARGEST, LARGEST)


def fitted(counts: list[tuple[str, str, int, int, int]]) -> Weights:
    """Weights from counts (what, pattern, label, other label, number) of a sample."""
    seen, chain, alike = defaultdict(lambda: np.zeros(LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    for what, key, a, b, n in counts:
        if what == "pattern":
            seen[key][a] += n
        else:
            (chain if what == "chain" else alike)[a, b] += n
    if not seen:
        return Weights()
    share = sum(seen.values()) + 1e-6
    share /= share.sum()
    of = lambda n: np.log((n + PRIOR * share) / (n.sum() + PRIOR))
    return Weights({k: of(n) for k, n in seen.items()}, np.log(share), _together(chain), _together(alike))


def counted(texts: list[str]) -> Counter:
    """The counts that fitted() takes, of these texts."""
    out = Counter()
    for text in texts:
        found = candidates(text, base_spans(text))
        y = [max(k, NONE) for k, _, _ in found]
        for k, (_, a, b) in zip(y, found, strict=True):
            out["pattern", pattern(text[a:b]), k, 0] += 1
        chain, groups = links(text, found)
        for i, j in chain:
            out["chain", "", y[i], y[j]] += 1
        for g in groups:
            n = Counter(y[i] for i in g)
            for a in n:
                for b in n:
                    out["alike", "", a, b] += n[a] * (n[b] - (a == b))
    return out


def fit(docs: DataFrame, rows: int = ROWS) -> Weights:
    """Weights from about `rows` documents, those of the least hashes."""
    total = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Counter()
        for batch in small_batches(batches):
            out += counted([t or "" for t in batch.column(0).to_pylist()])
        keys = list(out)
        cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(list(out.values()), pa.int64())], ["what", "pattern", "a", "b", "n"])

    part = least_hashes(docs.select("doc_id", "text"), F.col("doc_id"), rows, total).select("text")
    counts = part.mapInArrow(run, "what string, pattern string, a int, b int, n long").groupBy("what", "pattern", "a", "b").agg(F.sum("n").alias("n"))
    return fitted([tuple(r) for r in counts.collect()])


def marginals(unary: np.ndarray, edges: np.ndarray, kind: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """Label probabilities of each variable by sum-product message passing, all edges at once in each round.

    edges: pairs of variables; kind: which of the potentials each has; potentials: [kind, label of the first, of the second].
    """
    norm = lambda x: x - np.logaddexp.reduce(x, axis=-1, keepdims=True)
    if not len(edges):
        return np.exp(norm(unary))
    n = len(edges)
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    by = np.concatenate([potentials[kind], potentials[kind].transpose(0, 2, 1)])
    order = np.argsort(target, kind="stable")
    hit, first = np.unique(target[order], return_index=True)

    def beliefs(m: np.ndarray) -> np.ndarray:
        out = unary.copy()
        out[hit] += np.add.reduceat(m[order], first)
        return out

    messages = np.zeros((2 * n, unary.shape[1]))
    for _ in range(PASSES):
        sent = norm(np.logaddexp.reduce((beliefs(messages)[source] - messages[back])[:, :, None] + by, axis=1))
        new = norm(DAMPING * messages + (1 - DAMPING) * sent)
        moved = np.abs(new - messages).max()
        messages = new
        if moved < STILL:
            break
    return np.exp(norm(beliefs(messages)))


def tagged(texts: list[str], weights: Weights) -> Iterator[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    base, found, unary, edges, kinds, starts = [], [], [], [], [], []
    hubs, n = 0, 0
    for text in texts:
        b = base_spans(text)
        c = candidates(text, b)
        base.append(b)
        found.append(c)
        starts.append(n)
        chain, groups = links(text, c)
        if any(k < 0 for k, _, _ in c):  # all labels are given otherwise
            edges += [(n + i, n + j) for i, j in chain]
            kinds += [0] * len(chain)
            for g in groups:
                hubs += 1
                edges += [(n + i, -hubs) for i in g]
                kinds += [1] * len(g)
        for k, a, e in c:
            u = weights.patterns.get(pattern(text[a:e]), weights.unseen) if k < 0 else np.where(np.arange(LABELS) == k, 0.0, -60.0)
            unary.append(u)
        n += len(c)
    if n:
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        pairs = np.where(pairs < 0, n - 1 - pairs, pairs)
        p = marginals(np.vstack([np.array(unary), np.zeros((hubs, LABELS))]), pairs, np.array(kinds, np.int64), np.stack([weights.chain, weights.alike]))
    for text, b, c, at in zip(texts, base, found, starts, strict=True):
        more = []
        for i, (k, start, end) in enumerate(c):
            if k < 0:
                label = int(p[at + i].argmax())
                if label != NONE and p[at + i, label] >= SURE and could_be(label, text[start:end]):
                    more.append((label, start, end))
        yield b, more


def find(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every document; the counts are of base spans.

    Without weights, they are fitted on a sample of these documents.
    """
    weights = fit(docs) if weights is None else weights
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            got = list(tagged([t or "" for t in batch.column(1).to_pylist()], weights))
            counts = [pa.array([sum(s[0] == k for s in b) for b, _ in got], pa.int64()) for k in range(1, LABELS)]
            sha = [hashlib.sha256(written(b).encode()).hexdigest() for b, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array([written(b + m) for b, m in got], pa.string()), pa.array([len(m) for _, m in got], pa.int64())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redacted(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """The documents, each span of personal data replaced by its kind in brackets; overlapping spans become one. Null texts stay null."""
    weights = fit(docs) if weights is None else weights
    at = docs.columns.index("text")

    def masked(text: str, spans: list[Span]) -> str:
        out, done = [], 0
        for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= done:
                out += [text[done:a], f"[{KINDS[k - 1].upper()}]"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(at).to_pylist()
            new = [None if t is None else masked(t, b + m) for t, (b, m) in zip(texts, tagged([t or "" for t in texts], weights), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
