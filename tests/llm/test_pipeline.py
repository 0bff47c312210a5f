"""The pipeline's stages against brute force."""

import hashlib
import random
import re

from llm.conftest import CHECK, odd_texts

import corpus_pipeline
from scriptorium.llm import queries


def test_stages_judge_their_own_input(spark, tmp_path):
    docs = queries.table(spark, CHECK, "documents")
    columns, left = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()} if i < 5 else {}
        stage(spark, docs, CHECK).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i == 4:
            break
        assert docs.columns == columns, name
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.items() <= before.items()
        left.append((before, after))
    norm = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).digest()
    before, after = left[1]
    assert len({norm(t) for t in before.values()}) == len(after) == len({norm(t) for t in after.values()})
    before, after = left[3]
    items = [" ".join(r.text.split()) for r in queries.table(spark, CHECK, "benchmark").collect()]
    gone = set(before) - set(after)
    assert gone == {d for d, t in before.items() if any(x in " ".join(t.split()) for x in items)}
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(left[3][1])


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, CHECK).columns[:3] == ["doc_id", "start", "length"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "benchmark decontamination", "packing"]


def _alike(docs):
    """Ids of texts that stay, by all pairs."""
    shingles = {}
    for d, t in docs.items():
        w = t.lower().split()
        shingles[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    ids, up = sorted(docs), {d: d for d in docs}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = shingles[a], shingles[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return {d for d in ids if root(d) == d}


def test_near_copies_go(spark, documents, monkeypatch):
    from scriptorium.llm import near

    rng = random.Random(3)
    docs = {}
    for g in range(40):
        w = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(3, 300))]
        for k in range(rng.randint(1, 6)):
            docs[10 * g + k] = " ".join(w)
            w = list(w)
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = f"v{rng.randint(0, 900)}"
    base = [f"x{i}" for i in range(200)]
    for k in range(90):  # a crowd
        docs[1000 + k] = " ".join([*base[:k], f"y{k}", *base[k + 1 :]])
    df = documents(list(docs.items()))
    want = _alike(docs)
    assert len(want) < 100
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, CHECK).collect()} == want
    monkeypatch.setattr(near, "CROWD", 20)
    left = near.drop_near_copies(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == want
    odd = documents([(1, None), (2, " "), (3, "a"), (None, docs[0]), (4, docs[0]), (5, "b c")])
    assert {r.doc_id for r in near.drop_near_copies(odd).collect()} == {1, 3, 4, 5}
    assert near.drop_near_copies(df.limit(0)).count() == 0


def test_no_link_is_lost_in_a_crowded_bucket(spark, documents, monkeypatch):
    """All rows in one bucket of many parts: chains whose ends are near one member of another part only."""
    from pyspark.sql import functions as F

    from scriptorium.llm import near

    rng = random.Random(5)
    base, docs = [f"x{i}" for i in range(120)], {}
    for k in range(150):
        at, n = rng.randrange(100), rng.choice([1, 2, 15, 20, 30])
        docs[k] = " ".join([*base[:at], *(f"y{k}.{i}" for i in range(n)), *base[at + n :]])
    for chain in range(6):
        w = list(base)
        for k in range(12):
            w[9 * k : 9 * k + 9] = [f"z{chain}.{i}" for i in range(9 * k, 9 * k + 9)]
            docs[1000 + 12 * chain + k] = " ".join(w)
    rows = list(docs.items())
    rng.shuffle(rows)
    df, want = documents(rows), _alike(docs)
    assert len(want) > 20
    monkeypatch.setattr(near, "CROWD", 20)
    monkeypatch.setattr(near, "LEADERS", 2)
    monkeypatch.setattr(near, "buckets", lambda d: near.materialise(d.select(F.lit(1).alias("bucket"), F.lit(len(rows)).alias("n"), near.row_key().alias("rid")), "one-bucket"))
    assert {r.doc_id for r in near.drop_near_copies(df).collect()} == want
    monkeypatch.setattr(near, "rest", lambda members, roots: near.dealt(members).limit(0))
    assert {r.doc_id for r in near.drop_near_copies(df).collect()} > want  # parts and leaders alone lose links


def test_run_on_odd_and_empty_tables(spark, documents, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with ours."""
    df = documents([*odd_texts(), (4, "one"), (None, None), (None, "one")])
    empty = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for folder, docs, labels in (("odd", df, [(4, 1, 1), *((i, 1, 0) for i in (1, 2, 3, 5, 6, 7, 9, 10, 11, 12, 13)), (8, None, None), (None, 1, 1)]), ("none", df.limit(0), [])):
        docs.write.parquet(str(tmp_path / folder / "documents.parquet"))
        spark.createDataFrame(labels, empty["labels"]).write.parquet(str(tmp_path / folder / "labels.parquet"))
        spark.createDataFrame([(None, None), (1, "a a"), (2, odd_texts()[9][1][:200])][: 3 * bool(labels)], empty["benchmark"]).write.parquet(str(tmp_path / folder / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / folder)).collect()
        assert bool(out) == bool(labels)
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            left = stage(spark, docs, str(tmp_path / folder))
            assert left.columns == docs.columns, name
            if i:
                assert len({(r.doc_id, r.text) for r in left.collect()}) <= len({(r.doc_id, r.text) for r in docs.collect()})


def test_toxic_copies_all_go(documents, spark):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(100)], "doc_id long, quality int, toxic int")
    rows = [(i, f"what a vile{i} filth today" if i % 2 else f"what a kind{i} person today") for i in range(100)]
    left = corpus_pipeline.toxicity.drop_toxic(documents(rows + rows[:10] + [(None, "filth filth"), (None, None)]), labels)
    got = sorted((r.doc_id for r in left.collect() if r.doc_id is not None))
    assert got == sorted([i for i in range(0, 100, 2)] + [0, 2, 4, 6, 8])


def test_near_dedup_takes_its_classes_from_simhash(spark, documents):
    """Every class of linked fingerprints is a bucket of the stage, and an exact check decides on its members."""
    from scriptorium.llm import near, simhash

    base = [f"x{i}" for i in range(400)]
    docs = [(0, " ".join(base)), (1, " ".join(base[:200] + ["y"] + base[201:])), (2, "a b"), (3, None), (4, " "), (5, "a b")]
    df = documents(docs)
    classes = {}
    for r in simhash.classes(df).select("root", "key").distinct().collect():
        classes.setdefault(r.root, set()).add(r.key)
    want = {frozenset(x) for x in classes.values() if len(x) > 1}
    got = lambda rows: {frozenset(r.rid for r in rows if r.bucket == b) for b in {r.bucket for r in rows}}
    assert len(want) >= 2 and got(near.by_simhash(df).collect()) == want
    assert want <= got(near.buckets(df).collect())
    assert {r.doc_id for r in near.drop_near_copies(df).collect()} == {0, 2, 3}
    assert near.by_simhash(df.limit(0)).count() == 0
