"""The training-data operators against SQL and brute force, on odd rows and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm.conftest import CHECK, odd_texts
from oracle import expected, rows

from scriptorium.llm import align, chat, common, decontam, exact, packing, pii, quality, queries, simhash, substring, tokens, toxicity, warc, whiten

PIECE = queries.tokenizer_path("piece_bpe_32k.model")
BYTE, WORD = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert rows(queries.queries()[name](spark, CHECK).toPandas()) == expected(queries.ORACLES[name])


def test_operators_are_registered():
    assert [n.split("_")[0] for n in sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


# 1


def test_chat_escape_is_reversible(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    texts = ["".join(rng.choice(["<", "[", "\\", "s>", "/s>", "|end|>", "INST]", "/INST]", "<<SYS>>", "a", "$1", "\n", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e")))
    for r in df.collect():
        assert r.u == r.t
        assert not any(x in r.e for x in (chat.BEGIN, chat.FINISH, chat.START, chat.BODY, chat.NEXT, chat.END, "[INST]", "[/INST]"))


def test_chat_odd_turns(spark):
    turns = [(1, 1, "user", "a<|next|>"), (1, 2, "user", None), (1, 3, "assistant", "</s>x"), (1, 3, "assistant", "</s>x"), (1, 4, None, "q"), (None, 0, "assistant", "n"), (2, None, "we<|body|>ird", ""), (1, 9, "assistant", "")]
    df = spark.createDataFrame([(*t, 5) for t in turns], "conv_id long, turn long, role string, text string, formatted int")
    out = chat.formatted(df)
    got = {r.conv_id: [(b.role, list(b.texts)) for b in r.blocks] for r in chat.parsed(out).collect()}
    assert got == {1: [("user", ["a<|next|>", ""]), ("assistant", ["</s>x", "</s>x"]), ("", ["q"]), ("assistant", [""])], None: [("assistant", ["n"])], 2: [("we<|body|>ird", [""])]}
    d = {r.conv_id: r for r in chat.digests(out).collect()}
    assert (d[1].n_turns, d[1].n_blocks, d[1].loss_chars) == (6, 4, 10)
    assert d[1].loss_sha256 == hashlib.sha256(b"</s>x</s>x").hexdigest()
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


def test_chat_is_linear_in_a_run(spark):
    """100,000 turns of one role; a quadratic merge takes minutes."""
    import time

    turns = spark.range(100_000).selectExpr("1L AS conv_id", "id AS turn", "'assistant' AS role", "concat('</s> ', id) AS text")
    began = time.perf_counter()
    (r,) = chat.digests(chat.formatted(turns)).collect()
    assert (r.n_turns, r.n_blocks) == (100_000, 1) and time.perf_counter() - began < 30
    assert r.loss_sha256 == hashlib.sha256("".join(f"</s> {i}" for i in range(100_000)).encode()).hexdigest()


# 2


def _shingles(text):
    import regex

    w = [x for x in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if x]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def test_decontamination_brute_force(spark, documents):
    rng = random.Random(2)
    word = lambda: f"t{rng.randint(0, 60)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(30)] + [(30, None), (31, "a b"), (None, "k l m n o p q")]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 300)))) for i in range(60)]
    for i in range(60):
        _, t = rng.choice(items[:30])
        w = t.split()
        if len(w) > 12 and i % 2:
            w[rng.randrange(len(w))] = "changed"
        docs[i] = (i, docs[i][1] + ". " + " ".join(w).upper() + ", " + docs[i][1])
    docs += [(None, "x K-l; m n o p q y"), (60, None), (61, ""), (5, docs[5][1])]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n int")
    want = set()
    for d, t in docs:
        for i, x in items:
            s = _shingles(x)
            if s and len(s & _shingles(t)) >= 0.8 * len(s) - 1e-9:
                want.add((d, i))
    df = documents(docs)
    got = [(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 20
    left = decontam.drop_leaks(df, bench)
    assert left.columns == df.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((d for d, _ in docs if d not in {x[0] for x in want}), key=str)
    assert decontam.leaks(df.limit(0), bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0 and decontam.drop_leaks(df, bench.limit(0)).count() == len(docs)


def test_size_classes_sign_enough(spark):
    """Items of every class: signatures shrink with size, and each leaves a threshold of one or more."""
    items = spark.range(1, 3000, 37).selectExpr("id AS item_id", "array_join(transform(sequence(1, id + 4), i -> concat('w', id, 'x', i)), ' ') AS text")
    known = decontam.item_shingles(items).groupBy("item_id", "n", "need").agg({"signed": "count_if"}).toPandas()
    known.columns = ["item_id", "n", "need", "signed"]
    assert len(known) == 82 and (known.n == known.item_id).all() and (known.need >= 1).all()
    assert (known.need == known.signed - np.floor(0.2 * known.n + 1e-9)).all()
    share = known.signed / known.n
    assert (share[known.n <= 16] == 1).all() and abs(share[known.n > 1024].mean() - decontam.LARGE) < 0.03


def test_decontamination_in_blocks(spark, documents, monkeypatch):
    a = decontam.leaks(queries.table(spark, CHECK, "documents"), queries.table(spark, CHECK, "benchmark")).collect()
    monkeypatch.setattr(decontam, "ITEM_BYTES", 20_000)
    monkeypatch.setattr(decontam, "PAIRS", 0)
    assert sorted(a) == sorted(decontam.leaks(queries.table(spark, CHECK, "documents"), queries.table(spark, CHECK, "benchmark")).collect())


# 3


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.8
    rates = [0.95, 0.85, 0.75, 0.9]
    votes = np.stack([np.where(rng.random(len(y)) < 0.2, -1, np.where(rng.random(len(y)) < a, y, ~y)) for a in rates], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good, prior, table = quality.expectation_maximisation(patterns, counts.astype(float), mistaken=1.0)
    assert abs(prior - 0.8) < 0.02
    for j, a in enumerate(rates):
        assert abs(table[j, 1, 2] / (table[j, 1, 1] + table[j, 1, 2]) - a) < 0.02
    post = dict(zip(map(tuple, patterns), good, strict=True))
    assert np.mean([(post[tuple(v)] >= 0.5) == t for v, t in zip(votes.tolist(), y, strict=True)]) > 0.95


def test_quality_agrees_with_labels(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in quality.classify(docs).collect()}
    assert len(got) == 1000
    labels = [(r.doc_id, r.quality) for r in queries.table(spark, "/root/testdata/sf0.01", "labels").collect()]
    assert np.mean([got[d].keep for d, q in labels if q == 1]) > 0.97
    assert np.mean([not got[d].keep for d, q in labels if q == 0]) > 0.8


def _plain_em(votes):
    """Expectation-maximisation document by document, without pattern counts."""
    good = [0.1 if 0 in v else 0.95 if 1 in v else 0.5 for v in votes]
    for _ in range(200):
        prior = (sum(good) + 1) / (len(votes) + 2)
        table = {}
        for j in range(len(votes[0])):
            for k in (0, 1):
                share = [0.5 + sum(g if k else 1 - g for v, g in zip(votes, good, strict=True) if v[j] == x) for x in (-1, 0, 1)]
                share = [x / sum(share) for x in share]
                if k and share[1] > quality.MISTAKEN:
                    share[2] += share[1] - quality.MISTAKEN
                    share[1] = quality.MISTAKEN
                table[j, k] = share
        now = []
        for v in votes:
            odds = np.log(prior) - np.log(1 - prior) + sum(np.log(table[j, 1][x + 1]) - np.log(table[j, 0][x + 1]) for j, x in enumerate(v))
            now.append(1 / (1 + np.exp(-min(50, max(-50, odds)))))
        done = max(abs(a - b) for a, b in zip(now, good, strict=True)) < 1e-9
        if done:
            break
        good = now
    return good


def _plain_logistic(x, y, steps, extra=None, ridge=1e-5, start=0.0):
    """Adam on a dense matrix, whose last column is the intercept's."""
    w = np.zeros(x.shape[1])
    w[-1] = start
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x.T @ ((1 / (1 + np.exp(-x @ w))) - y) / len(y)
        g[:-1] += 2 * ridge * w[:-1]
        if extra is not None:
            g += 2 * extra.T @ (extra @ w) / len(extra)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def test_quality_brute_force(spark):
    """Row by row: EM over raw votes, and a dense scorer."""
    docs = queries.table(spark, CHECK, "documents")
    rows = docs.select("doc_id", "text", common.row_key().alias("key")).orderBy("key").collect()
    found = [quality.profile(r.text or "", quality.Shapes()) for r in rows]
    soft = _plain_em([v for v, _ in found])
    x = np.zeros((len(rows), quality.WIDTH + 1))
    x[:, -1] = 1
    for k, (_, counts) in enumerate(found):
        for i, v in zip(*quality.vector(counts), strict=True):
            x[k, i] = np.float32(v)
    score = 1 / (1 + np.exp(-x @ _plain_logistic(x, np.array(soft), 300)))
    got = {r.doc_id: r for r in queries.op3_quality(spark, CHECK).collect()}
    assert len(got) == len(rows)
    for r, s, z in zip(rows, soft, score, strict=True):
        assert abs(got[r.doc_id].posterior - s) < 1e-6 and abs(got[r.doc_id].score - z) < 1e-4
        assert got[r.doc_id].keep == (got[r.doc_id].score >= 0.5)


def test_quality_sees_the_tail_of_long_words():
    assert quality.shape("248.167.124.71***").endswith("0**")
    assert quality.profile("248.167.124.71*** " * 30, quality.Shapes())[0][quality.LABELLERS.index("tails")] == 0


def test_quality_odd_rows(spark, documents):
    df = documents(odd_texts())
    got = quality.classify(df).collect()
    assert len(got) == len(odd_texts()) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(df.limit(0)).count() == 0


# 4


def _without_repeats(docs, window):
    words = [(t or "").encode().split() for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "shard", "reference", "sent", "keys"), [(35, 8_000, 50_000, 400_000, 500_000), (12, 8_000, 50_000, 0, 0), (12, 8_000, 50_000, 2_000, 500_000), (12, 60, 50_000, 300, 0), (12, 0, 50_000, 0, 500_000), (12, 60, 0, 0, 0), (3, 20, 50_000, 100, 500_000)])
def test_substring_brute_force(spark, documents, monkeypatch, window, shard, reference, sent, keys):
    """Also with anchors that are hot from a few words on, or all of them, and with all, some or no automata broadcast."""
    monkeypatch.setattr(substring, "SHARD", shard)
    monkeypatch.setattr(substring, "BROADCAST", sent)
    monkeypatch.setattr(substring, "KEYS", keys)
    monkeypatch.setattr(substring, "REFERENCE", reference)
    rng = random.Random(4)
    passage = [" ".join(f"p{rng.randint(0, 999)}" for _ in range(n)) for n in (20, 50, 80, 9)]
    docs = odd_texts()
    for i in range(100, 160):
        body = lambda n: " ".join(f"r{rng.randint(0, 9999)}" for _ in range(n))
        docs.append((i, f"{body(rng.randint(0, 60))} {rng.choice(passage)}\t{body(rng.randint(0, 60))} {rng.choice(passage)} {'k ' * rng.randint(0, 60)}"))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.without_repeats(documents(docs), window).collect()), key=str)
    assert got == _without_repeats(docs, window)


def test_frequent_anchors_fit_the_bound(spark, monkeypatch):
    monkeypatch.setattr(substring, "BROADCAST", 100)
    sizes = spark.createDataFrame([(i, 10, p) for i, p in enumerate([2] * 20 + [5] * 5 + [900])], "anchor long, words long, places long")
    assert substring.frequent(sizes) == 4 and substring.frequent(sizes.limit(0)) == 1 and substring.frequent(sizes.filter("places > 2")) == 1


def test_automaton_counts_like_a_scan():
    rng = random.Random(5)
    seqs = [[rng.randint(0, 3) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    auto = substring.Automaton()
    for s in seqs:
        auto.add(s, 1)
    auto.close()
    for w in (1, 3, 6):
        seen = Counter(tuple(s[i : i + w]) for s in seqs for i in range(len(s) - w + 1))
        for s in seqs:
            got = [k for n, k in auto.matches(s, w)][w - 1 :]
            assert got == [seen[tuple(s[i : i + w])] for i in range(len(s) - w + 1)]


def test_substring_empty(documents):
    assert substring.without_repeats(documents(odd_texts()).limit(0)).count() == 0


# 5


def _fingerprint(text):
    import xxhash

    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _components(prints):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def _simhash(docs):
    prints = [_fingerprint(t) for _, t in docs]
    comps = _components(prints)
    ids = defaultdict(list)
    for (d, _), c in zip(docs, comps, strict=True):
        if d is not None:
            ids[c].append(d)
    return sorted(((d, f"{p:016x}", min(ids[c]) if ids[c] else None) for (d, _), p, c in zip(docs, prints, comps, strict=True)), key=str)


def test_simhash_brute_force(spark, documents):
    rng = random.Random(6)
    docs = odd_texts()
    for i in range(200, 320):
        w = [f"s{rng.randint(0, 99)}" for _ in range(rng.randint(1, 400))]
        docs.append((i, " ".join(w)))
        for k in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "other"
            docs.append((1000 * (k + 1) + i, " ".join(w)))
    got = sorted(map(tuple, simhash.groups(documents(docs)).collect()), key=str)
    assert got == _simhash(docs)
    assert simhash.groups(documents(docs).limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [0, 3, 10_000])
def test_links_reach_what_near_pairs_reach(spark, crowded, monkeypatch):
    """Also where every key, or most keys, are filed again by further pivots and at last joined through neighbours."""
    monkeypatch.setattr(simhash, "CROWD", crowded)
    rng = random.Random(7)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(900):
        x = rng.choice(prints)
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    prints = sorted({x - (1 << 64) if x >> 63 else x for x in prints})
    roots = {r.node: r.root for r in simhash.components(simhash.edges(spark.createDataFrame([(x,) for x in prints], "fp long"))).collect()}
    want = _components([x & (1 << 64) - 1 for x in prints])
    least = {}
    for x, c in zip(prints, want, strict=True):
        least.setdefault(c, x)
    assert [roots.get(x, x) for x in prints] == [least[c] for c in want]


def test_close_fingerprints_share_cells_and_coordinates():
    rng, reference = random.Random(13), simhash.pivots()
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        fp = np.array([x, y], np.uint64).view(np.int64)
        assert np.abs(np.subtract(*simhash.coordinates(fp, reference))).max() <= 2
        for level in range(4):
            who, code = simhash.cells(fp, reference[level * simhash.ROUTE : (level + 1) * simhash.ROUTE])
            assert set(code[who == 0]) & set(code[who == 1])


def test_simhash_stage_keeps_one_of_each(documents):
    """With null ids, repeated ids and repeated rows."""
    same = "five mutual copies of one text"
    docs = [*odd_texts(), (None, same), (None, same), (21, same), (22, same), (21, same), (None, "x  y z"), (None, "x y z")]
    df = documents(docs)
    left = simhash.drop_near_copies(df)
    assert left.columns == df.columns
    comps = _components([_fingerprint(t) for _, t in docs])
    ids = defaultdict(list)
    for (d, _), c in zip(docs, comps, strict=True):
        ids[c].append((d is None, d or 0, d))
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((min(g)[2] for g in ids.values()), key=str)


# 6


def test_packing_holds_every_id_once(spark, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    docs = [(i, t) for i, (_, t) in enumerate(odd_texts())]
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids + [2] for d, t in docs}
    pieces = packing.pack(documents(docs), WORD).collect()
    seqs, parts = defaultdict(list), defaultdict(list)
    for r in pieces:
        seqs[r.sequence_id].append(r)
        parts[r.doc_id].append(r)
    for d, x in ids.items():
        at = 0
        for r in sorted(parts[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(x)
            assert r.ids_crc32 == zlib.crc32(np.array(x[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(x)
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0
    steps = defaultdict(set)
    for r in pieces:
        steps[r.step_id].add((r.tier, r.sequence_id))
    assert all(len({t for t, _ in s}) == 1 and len(s) <= packing.STEP for s in steps.values())
    assert packing.pack(documents(docs).limit(0), WORD).count() == 0


def test_special_tokens_in_other_case():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    texts = ["a <|ENDOFTEXT|> B", "x<|StartOfText|>Y.", "<|endoftext|> Both <|EndOfText|>", "<|endoftext|>", "Plain Words."]
    for text, ids in zip(texts, packing.Words(WORD).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing_with_another_tokenizer():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE)
    texts = ["Some Words,  and\tmore. ", "", "<|endoftext|>x", "İ É \x1c"]
    assert packing.Words(WORD).by_words and not packing.Words(BYTE).by_words
    for text, ids in zip(texts, packing.Words(BYTE).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_words_with_the_mark_and_forgetting(monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    monkeypatch.setattr(packing, "MEMO", 40)
    w, rng = packing.Words(WORD), random.Random(8)
    for _ in range(50):
        t = " ".join(rng.choice(["a\x01b", "\x01", "Ünï", "x" * rng.randint(1, 30), "it's", "<|endoftext|>", "ΣΑΣ", "é", "İ", "​"]) for _ in range(40))
        assert w.encode([t])[0] == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


# 7


def test_token_counts(spark, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE)
    docs = odd_texts() + [(50, "x" * 70_000 + " " + "yz " * 30_000), (51, "é" * 80_000), (52, ("<|endoftext|>" + "w" * 50 + "\n ") * 2500)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.counts(documents(docs), BYTE).collect()), key=str)
    n = [len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in docs]
    assert got == sorted(((d, len((t or "").encode()), k, k > 1024) for (d, t), k in zip(docs, n, strict=True)), key=str)
    assert tokens.counts(documents(docs).limit(0), BYTE).count() == 0


def test_resynchronisation_widens_and_is_exact():
    from tokenizers import Tokenizer

    tok, rng, widened = Tokenizer.from_file(BYTE), random.Random(9), 0
    for i in range(300):
        t = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "é", "x" * 30, "!?", "12", "<|endoftext|>", "'s", "\x0b", "\x1c", " \n ", "日本"]) for _ in range(rng.randint(0, 300)))
        t = t if i % 5 else t.replace(" ", "").replace("\n", "")
        ((got, more),) = tokens.count([t], BYTE, 64, 8)
        assert got == len(tok.encode(t, add_special_tokens=False).ids)
        widened += more
    assert widened > 1000


def test_many_documents_are_spliced(spark):
    """At sf0.01, by the production sizes, and some of them widened where the text gives no boundary."""
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    got = tokens.counts(docs, BYTE).collect()
    assert sum(r.n_chunks > 1 for r in got) > 100
    odd = spark.createDataFrame([(1, ("é" * 3000 + " ") * 9), (2, "z" * 20_000), (3, "日本語。" * 5000 + " end")], "doc_id long, text string")
    for r in tokens.counts(odd, BYTE).collect():
        assert r.n_widened > 0 and r.n_tokens == len(tokens.tokenizer(BYTE).encode(odd.filter(f"doc_id = {r.doc_id}").first().text, add_special_tokens=False))


def test_other_tokenizers_encode_whole_texts():
    assert tokens.has_stable_places(BYTE) and not tokens.has_stable_places(WORD)
    text = "Some words. " * 900
    assert list(tokens.count([text], WORD)) == [(len(tokens.tokenizer(WORD).encode(text, add_special_tokens=False)), 0)]


# 8


def test_exact_odd_rows(spark, documents):
    docs = odd_texts()
    df = documents(docs)
    got = exact.groups(df).collect()
    assert len(got) == len(docs)
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    by = defaultdict(list)
    for d, t in docs:
        by[hashlib.sha256(norm(t).encode()).hexdigest()].append((-len(t or ""), d is not None, d or 0, d))
    for r in got:
        g = by[r.text_sha256]
        assert r.keep_id == min(g)[3] and r.group_size == len(g)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(by.keys())
    left = exact.drop_copies(df)
    assert left.columns == df.columns
    assert Counter(hashlib.sha256(norm(r.text).encode()).hexdigest() for r in left.collect()) == Counter(by.keys())
    assert exact.groups(df.limit(0)).count() == 0 and exact.drop_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [1 << 24, 64])
def test_bloom_passes_most_unique_rows(spark, monkeypatch, bound):
    """As one slice and as many."""
    monkeypatch.setattr(exact, "SLICE", bound)
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 0 THEN 'same' ELSE CAST(id AS STRING) END AS text")
    from pyspark.sql import functions as F

    blocks = exact.n_blocks(20_000)
    shas = common.materialise(docs.select("doc_id", exact.digest(F.col("text")).alias("s")), "t")
    probed = exact.with_probe(shas, F.col("s"), blocks)
    maybe, unique = exact.sieve(probed, probed, blocks)
    assert maybe.count() + unique.count() == 20_000
    assert maybe.filter("doc_id % 10 = 0").count() == 2000
    assert maybe.count() < 2000 + 0.02 * 18_000


def test_exact_dedup_in_slices(spark, documents, monkeypatch):
    df = documents(odd_texts())
    want, left = sorted(exact.groups(df).collect(), key=str), sorted(exact.drop_copies(df).collect(), key=str)
    monkeypatch.setattr(exact, "SLICE", 64)
    monkeypatch.setattr(exact, "n_blocks", lambda rows: 320)
    assert sorted(exact.groups(df).collect(), key=str) == want and sorted(exact.drop_copies(df).collect(), key=str) == left


def test_plans_do_not_grow_with_slices_and_blocks(spark, documents, monkeypatch):
    """Nodes and broadcasts of the last plan, for few and many slices of the filter and blocks of items."""
    import re

    nodes = lambda df: len(re.findall(r"(?m)^[ :+*-]*(?:\(\d+\) )?\w", df._jdf.queryExecution().sparkPlan().toString()))
    df = documents(odd_texts())
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)], "item_id long, text string")
    monkeypatch.setattr(exact, "SLICE", 64)
    sizes = []
    for many in (2, 7):
        monkeypatch.setattr(exact, "n_blocks", lambda rows, many=many: 64 * many)
        monkeypatch.setattr(decontam, "ITEM_BYTES", 60_000 // many)
        sizes.append((nodes(exact.groups(df)), nodes(exact.drop_copies(df)), nodes(decontam.contained(df, items))))
    assert sizes[0] == sizes[1] and min(sizes[0]) > 3


def test_exact_ties_do_not_depend_on_order(documents):
    rows = [(1, "a b  c"), (1, "a  b c"), (1, " abc  "), (None, "d e"), (None, "de ")]
    seen = {tuple(sorted((r.doc_id is None, r.text) for r in exact.drop_copies(documents(x)).collect())) for x in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(seen) == 1 and len(seen.pop()) == 2


# 9


def test_toxicity_learns_and_holds_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[d].predicted, y) for d, y in labels.items() if got[d].held_out]
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.85
    assert sum(p for p, y in held if not y) / sum(1 - y for _, y in held) < 0.02


def test_toxicity_brute_force(spark):
    """Row by row: features counted in Python, a dense model with the swap penalty, and its scores."""
    docs = {r.doc_id: toxicity.features(toxicity.tokens(r.text or "")) for r in queries.table(spark, CHECK, "documents").collect()}
    words = {r.doc_id: toxicity.tokens(r.text or "") for r in queries.table(spark, CHECK, "documents").collect()}
    labels = {r.doc_id: r.toxic for r in queries.table(spark, CHECK, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    ids = sorted(set(labels) & set(docs))
    y = np.array([labels[d] for d in ids], float)
    n, pos = Counter(f for d in ids for f in docs[d]), Counter(f for d in ids for f in docs[d] if labels[d])
    rate = y.mean()
    z = {f: abs(pos[f] - k * rate) / np.sqrt(k * rate * (1 - rate) + 1) for f, k in n.items() if k >= 3}
    top = sorted((-v, f) for f, v in z.items() if v >= 3)[: toxicity.FEATURES]
    names = sorted({f for _, f in top} | set(toxicity.SWAP))
    at = {f: i for i, f in enumerate(names)}

    def row(found):
        x = np.zeros(len(names) + 1)
        x[[at[f] for f in found if f in at]] = 1
        x[-1] = 1
        return x

    x = np.stack([row(docs[d]) for d in ids])
    swapped = [(k, {toxicity.SWAP.get(w, w) for w in words[d]}) for k, d in enumerate(ids) if words[d] & set(toxicity.SWAP)]
    extra = np.stack([x[k] - row(toxicity.features(w)) for k, w in swapped]) if swapped else None
    w = _plain_logistic(x, y, 400, extra, start=np.log(rate / (1 - rate)))
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, CHECK).collect()}
    assert set(got) == set(docs)
    for d, found in docs.items():
        assert abs(got[d].score - 1 / (1 + np.exp(-row(found) @ w))) < 1e-3
        assert got[d].predicted == int(got[d].score >= 0.3) and got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_identity_swaps_cost_nothing():
    rng = np.random.default_rng(10)
    names = ["bad", "women", "men", "x"]
    on, swapped, y = [], [], []
    for _ in range(2000):
        toxic = rng.random() < 0.3
        f = ([0] if toxic and rng.random() < 0.7 else []) + ([1] if rng.random() < (0.6 if toxic else 0.1) else []) + [3]
        on.append(np.array(f))
        swapped.append(np.array([2 if i == 1 else i for i in f]) if 1 in f else None)
        y.append(float(toxic))
    import pyarrow as pa

    lists = lambda x: common.ragged(pa.chunked_array([pa.array([None if i is None else i.tolist() for i in x], pa.list_(pa.int32()))]))
    sparse = lists(on), (*lists(swapped), np.array([x is not None for x in swapped]))
    fair, _ = toxicity.fit(np.array(y), *sparse, len(names), penalty=10.0)
    plain, _ = toxicity.fit(np.array(y), *sparse, len(names), penalty=0.0)
    assert abs(fair[1] - fair[2]) < 0.1 * abs(plain[1] - plain[2]) and fair[0] > 1


def test_toxicity_odd_rows(spark, documents):
    df = documents(odd_texts())
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (6, 1, 0), (6, 1, 1), (8, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0), labels.filter("toxic = 1")):
        got = toxicity.score(df, lab).collect()
        assert len(got) == len(odd_texts()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(df.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(df, labels.limit(0)).count() == len(odd_texts())
    assert toxicity.drop_toxic(df, labels).columns == df.columns


# 10


def test_warc_round_trip(spark):
    import base64

    rng = random.Random(12)
    pages = [(i, f"http://h{i % 5}.example.org:8{i % 3}/a b?q={i}\n", rng.choice(["<p>one</p>", "", "\r\n\r\nWARC/1.1", "é" * 50, f"<p>{i}</p>"])) for i in range(300)]
    pages += [(300, None, None), (301, "http://[bad", "<p>one</p>"), (5, "http://other.org/", pages[5][2]), (None, "http://x.org/", "<p>one</p>")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int").repartition(4)
    entries = warc.write(df)
    directory = warc.index(entries, lines=7)
    assert spark.read.parquet(directory).count() > 20
    got = warc.read(spark, df, directory).collect()
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, _, h in pages:
        b = (h or "").encode()
        again = p != first.get(h or "")
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert all(r.payload == next((h or "").encode() for p, _, h in pages if p == r.page_id) for r in got if r.record_type == "response")
    assert warc.captures(df.limit(0)).count() == 0
    assert {r.record_type for r in warc.captures(df.filter("page_id < 40"), least=10_000).collect()} == {"response"}


def test_warc_keys():
    assert warc.surt("http://www.Example.org:80/a?b=c#d") == "org,example,www:80)/a?b=c"
    assert warc.capture_key("http://a.b/x y\n", 3) == "b,a)/x%20y 3"


# 11


def _plain_groups(text):
    """Token ids of both sides and their groups, cut where tokens of both end, token by token."""
    (ta, *_), (tb, *_) = align._tables(align.ByteLevel, BYTE), align._tables(align.Pieces, PIECE)
    x, y = (ta.encode([text])[0], tb.encode([text])[0]) if text else ([], [])
    raw = (" " + text).encode()
    if b"".join(ta.bytes[i] for i in x) != raw or b"".join(tb.bytes[i] for i in y) != raw:
        return []
    out, ga, gb, ea, eb = [], [], [], 0, 0
    x, y = list(x), list(y)
    while x or y:
        if ea <= eb:
            ga.append(x.pop(0))
            ea += len(ta.bytes[ga[-1]])
        else:
            gb.append(y.pop(0))
            eb += len(tb.bytes[gb[-1]])
        if ea == eb:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def _plain_alignment(texts):
    """All columns of each text but its id."""
    groups = [_plain_groups(t or "") for t in texts]
    linked = [Counter((a, b) for ga, gb in g for a in ga for b in gb) for g in groups]
    count = Counter(p for c in linked for p in c)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for g, c in zip(groups, linked, strict=True):
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        yield (
            sum(len(ga) for ga, _ in g), sum(len(gb) for _, gb in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]),
            sum(n * count[p] for p, n in c.items()), hashlib.sha256(said.encode()).hexdigest() if said else "",
        )


@pytest.mark.parametrize("head", [align.HEAD, 40, 0])
def test_alignment_brute_force(spark, documents, head):
    """Also with most pairs, and with all, counted past the broadcast."""
    rng = random.Random(11)
    made = ["".join(rng.choice(["the", "re", "<0x41>", "é", " ", "\n", "  ", "12", "Q", "語", ".", "<|endoftext|>", "</s>"]) for _ in range(40)) for _ in range(40)]
    given = [(r.doc_id, r.text) for r in queries.table(spark, CHECK, "documents").limit(40).collect() if len(r.text) < 5000]
    rows_ = odd_texts() + [(100 + i, t) for i, t in enumerate(made)] + [(200, "a\u2581b"), (201, "\x00z"), (202, " "), (203, "a" * 3000)] + [(i + 1000, t) for i, t in given]
    want = [(i, *w) for (i, _), w in zip(rows_, _plain_alignment([t for _, t in rows_]), strict=True)]
    df = documents(rows_)
    got = [tuple(r) for r in align.align(df, BYTE, PIECE, head).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[3] for w in want) > 10_000
    assert {w[0] for w in want if w[1] == 0} >= {1, 2, 200}
    assert align.align(df.limit(0), BYTE, PIECE).count() == 0


def test_alignment_of_wide_groups():
    """Groups whose pairs pass a block, and whose tokens pass WIDE, against plain counting."""
    rng = np.random.default_rng(5)
    sizes = [(1, 1), (300, 200), (2, 500), (90, 80), (1, 3)] * 3
    ga, gb = (np.repeat(np.arange(len(sizes)), [s[i] for s in sizes]) for i in (0, 1))
    a, b = rng.integers(0, 20, len(ga)), rng.integers(0, 30, len(gb))
    doc_of = np.arange(len(sizes)) // 5
    want = Counter((int(doc_of[g]), (int(x) << align.BITS) + int(y)) for g in range(len(sizes)) for x in a[ga == g] for y in b[gb == g])
    for block in (50, 1000, align.BLOCK):
        d, p, n = align.links(doc_of, ga, a, gb, b, block)
        assert dict(zip(zip(d.tolist(), p.tolist(), strict=True), n.tolist(), strict=True)) == want


def test_counts_past_the_head_are_in_few_documents(spark):
    pairs = spark.range(1000).selectExpr("id AS row", "explode(sequence(0, 9)) AS k").selectExpr("row", "if(k < 5, k, row * 10 + k) AS pair")
    counts = align.pair_counts(pairs)
    assert align.head_from(counts, 5) == 2 and align.head_from(counts, 4) == 1024 and align.head_from(counts, 10_000) == 1
    assert align.head_from(counts.limit(0), 5) == 1


# 12


def _whitened(spark, rows_, k=whiten.K):
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows_], "vec_id long, embedding array<float>, label int, x int").repartition(3)
    return whiten.whiten(df, k)


def test_whitening_brute_force(spark):
    """Against numpy's eigensolver on all rows, with rows that do not count."""
    rng = np.random.default_rng(12)
    base = (rng.standard_normal((300, 12)) * np.linspace(0.4, 0.02, 12)).astype(np.float32)
    rows_ = [(i, v.tolist()) for i, v in enumerate(base)] + [(0, base[0].tolist()), (None, base[1].tolist())]
    bad = [(900, None), (901, [None, *base[0].tolist()[1:]]), (902, [float("nan"), *base[0].tolist()[1:]]), (903, [float("inf"), *base[0].tolist()[1:]]), (904, []), (905, [0.1, 0.2]), (906, [3e30, *base[0].tolist()[1:]])]
    got = _whitened(spark, rows_ + bad).toPandas()
    x = np.floor(1024 * np.array([v for _, v in rows_], np.float32).astype(float)).astype(np.int64) + 100_000
    n, c = len(x), x - x.mean(axis=0)
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:8], q[:, ::-1][:, :8]
    assert len(got) == 8 * n and (got.n == n).all() and (got.identity_error < 1e-10).all()
    assert np.allclose(got.groupby("component").explained.first(), e / np.trace(c.T @ c / n), rtol=1e-12)
    want = c @ q / np.sqrt(e)
    one = got[(got.vec_id == 7)].sort_values("component")
    sign = np.array([np.sign(got[(got.vec_id == 5) & (got.component == j + 1)].whitened.iloc[0] * want[5, j]) for j in range(8)])
    assert np.allclose(one.whitened, sign * want[7], atol=1e-9)
    for j in range(8):
        assert np.allclose(np.sort(got[got.component == j + 1].whitened), np.sort(sign[j] * want[:, j]), atol=1e-9)
    assert sorted(got[got.component == 1].deviation) == sorted(((n * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist())


def test_whitening_of_odd_tables(spark):
    assert _whitened(spark, [(1, [0.5])][:0]).count() == 0 and _whitened(spark, [(1, None), (2, [])]).count() == 0
    same = _whitened(spark, [(1, [0.5, 0.25]), (1, [0.5, 0.25])]).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in sorted(same, key=lambda r: r.component)] == [(1, c, 2, 0, None, 0.0) for c in (1, 1, 2, 2)]
    line = _whitened(spark, [(i, [i / 1024, 2 * i / 1024, 0.0]) for i in range(9)]).collect()
    assert len(line) == 27 and all((r.whitened is None) == (r.component > 1) for r in line) and all(r.identity_error < 1e-12 for r in line)
    assert whiten.deviation(np.array([[2**40], [3]]), 10**7, np.array([5 * 10**6])) == [None, (3 * 10**7 - 5 * 10**6) ** 2]


def test_eigensolver_on_ties_gaps_and_low_rank():
    rng = np.random.default_rng(1)
    for spectrum in ([1.0] * 20, [5.0] + [4.0] * 12 + [1.0], [1e6, 1e3, 1.0] + [1e-6] * 30, [3.0, 2.0] + [0.0] * 9, list(np.linspace(1, 2, 70)), [7.0], [2.0, 2.0], [0.0, 0.0]):
        q, _ = np.linalg.qr(rng.standard_normal((len(spectrum), len(spectrum))))
        v = (q * np.array(spectrum)) @ q.T
        e, y = whiten.leading(v)
        want = np.sort(spectrum)[::-1][:8]
        assert np.abs(e - want).max() <= 1e-12 * max(spectrum + [1e-300]) and np.abs(y.T @ y - np.eye(len(e))).max() < 1e-12
        assert np.abs(v @ y - y * e).max() <= 1e-11 * max(spectrum + [1e-300])
    for n in (1, 2, 3, 7, 30):
        a = rng.standard_normal((n, n))
        a = a + a.T
        for shift in (-3.0, -0.1, 0.0, 0.2, 4.0):
            assert whiten.above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()


def test_intervals_hold_what_inertia_counts():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((200, 40))
    v = a.T @ a / 200
    e = np.linalg.eigvalsh(v)
    parts = whiten.intervals(v, 8)
    assert sum(n for *_, n in parts) == 8 and all(n <= whiten.EACH for *_, n in parts)
    for low, high, n in parts:
        assert ((e > low) & (e < high)).sum() == n == len(whiten.feast(v, low, high, n)[0])


# 13


def _plain_spans(text):
    """The base patterns as they are stated, with Python's matcher."""
    import re

    stated = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(stated, 1):
        for m in re.finditer(p, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            total = sum(c if i % 2 == 0 else sum(divmod(2 * c, 10)) for i, c in enumerate(reversed(d)))
            if (k == 1) or (k == 2 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 3 and 16 <= len(d) <= 19 and total % 10 == 0) or (k == 4 and 8 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_are_those_of_the_stated_patterns(spark):
    rng = random.Random(13)
    parts = ["a@b.c", "@", ".", "x_y", "1", "22", "255", "256", "0255", "+", "-", " ", "(", ")", "4111111111111111", "4111 1111-1111 1111", "+1 (017) 555-7713", "é", "@mail.example.com", "%", "1.2.3.4", "0", "\u0663"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [t or "" for _, t in odd_texts()]
    texts += [r.text or "" for r in queries.table(spark, "/root/testdata/sf0.01", "documents").collect()]
    n = 0
    for t in texts:
        base = pii.base_spans(t)
        n += len(base)
        assert base == _plain_spans(t)
        found = pii.candidates(t, base)
        assert all(a[2] <= b[1] for a, b in zip(found, found[1:], strict=False))
    assert n > 2000


def test_pii_query_brute_force(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = queries.op13_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts) == 1000
    for r in got:
        want = _plain_spans(texts[r.doc_id])
        said = ",".join(f"{pii.KINDS[k - 1]}:{a}:{b}" for k, a, b in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in (1, 2, 3, 4))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_field_adds_what_repeats_and_resembles(spark, documents):
    weights = pii.fit(queries.table(spark, "/root/testdata/sf0.1", "documents"))
    texts = [
        "call +1 (017) 555-7713 now. " + "x " * 500 + "Later 017 555 7713, then (017) 555-7713; not 017 555 7714; version 4.0.", "write ann.lee@mail.example.com or ann.lee@localhost, not bob@localhost", "7713 555 017 and 4.0 and 0810992847249405", "",
    ]
    got = {r.doc_id: r for r in pii.find(documents(list(enumerate(texts)) + [(9, None)]), weights).collect()}
    cut = lambda i: [(x.split(":")[0], texts[i][int(x.split(":")[1]) : int(x.split(":")[2])]) for x in got[i].spans.split(",") if x]
    assert cut(0) == [("phone", "+1 (017) 555-7713"), ("phone", "017 555 7713"), ("phone", "(017) 555-7713")] and got[0].n_phone == 1 and got[0].n_added == 2
    assert cut(1) == [("email", "ann.lee@mail.example.com"), ("email", "ann.lee@localhost")]
    assert cut(2) == [] and got[3].spans == got[9].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {r.doc_id: r.text for r in pii.redacted(documents(list(enumerate(texts)) + [(9, None)]), weights).collect()}
    assert masked[1] == "write [EMAIL] or [EMAIL], not bob@localhost" and masked[9] is None and masked[2] == texts[2]
    odd = documents(odd_texts())
    assert pii.find(odd).count() == len(odd_texts()) and pii.find(odd.limit(0)).count() == 0


def test_marginals_against_enumeration():
    """Exact on trees; on loops the likeliest labels agree where they are clear."""
    import itertools

    rng = np.random.default_rng(13)
    for edges, exact in (([(0, 1), (1, 2), (1, 3), (3, 4)], True), ([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 1)], False), ([], True)):
        unary, pots = rng.normal(0, 1, (5, 3)), rng.normal(0, 1 if exact else 0.4, (2, 3, 3))
        kind = rng.integers(0, 2, len(edges))
        want = np.zeros((5, 3))
        for y in itertools.product(range(3), repeat=5):
            w = np.exp(sum(unary[i, y[i]] for i in range(5)) + sum(pots[k][y[i], y[j]] for (i, j), k in zip(edges, kind, strict=True)))
            want[np.arange(5), y] += w
        want /= want.sum(axis=1, keepdims=True)
        got = pii.marginals(unary, np.array(edges, np.int64).reshape(-1, 2), kind, pots)
        assert np.abs(got - want).max() < (1e-3 if exact else 0.1)


def test_pii_is_linear_in_a_text():
    import time

    weights = pii.fitted([("pattern", "16l", 3, 0, 5), ("alike", "", 3, 3, 5)])
    for t in ("a" * 300_000, "1" * 300_000, "1." * 200_000, "+1 " * 100_000, "a@" * 100_000, "+1" + " " * 300_000, "@" * 100_000, "a." * 100_000 + "@", "1 " * 200_000):
        began = time.perf_counter()
        list(pii.tagged([t], weights))
        assert time.perf_counter() - began < 20
