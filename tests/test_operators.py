"""Golden vectors of the entity operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import similarity as sim
from scriptorium.functions import text as tx
from scriptorium.operators import annotate, authority, chunk, dedup, evaluate, linkage, parse, report, tabulate
from scriptorium.plans.extract import extract, prompts

E = '{"text":"Ann Lee","label":"PERSON"}'
RESPONSES = [
    (f'{{"entities":[{E}]}}', "strict", ["Ann Lee"]),
    (f'```json\n{{"entities":[{E}]}}\n```', "repaired", ["Ann Lee"]),
    (f'{{"entities":[{E},]}}', "repaired", ["Ann Lee"]),
    (f'Here: {{"entities":[{E}]}} done', "repaired", ["Ann Lee"]),
    ('{"entities":[{"text":"a\nb","label":"ORG"}]}', "repaired", ["a b"]),
    (f'{{"entities":[{E},{{"text":"Liv', "salvaged", ["Ann Lee"]),
    ('{"entities":[{"text":"Liv', "failed", []),
    ('{"entities":[{"label":"PERSON","text":"Ann"}, {"te', "failed", []),
    ("I found nothing.", "failed", []),
    ("", "failed", []),
    (None, "failed", []),
    (f"[{E}]", "strict", []),
    ('{"entities":[{"text":1,"label":"X"},"s",null,' + E + "]}", "strict", ["Ann Lee"]),
    ('{"entities":null}', "strict", []),
    ('{"entities":{"text":"a"}}', "strict", []),
]


@pytest.mark.parametrize("exact", [False, True])
def test_parse(spark, exact):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RESPONSES)], "i int, raw_response string")
    got = {r.i: (r.parse_status, [e.text for e in r.entities]) for r in parse.parse(df, exact=exact).collect()}
    assert got == {i: (s, e) for i, (_, s, e) in enumerate(RESPONSES)}
    strict = {r.i: r.n_malformed for r in parse.parse(df, exact=exact, strict=True).filter("n_malformed > 0 AND size(entities) = 0").collect()}
    assert strict == {12: 3}


def test_chunk_limits(spark):
    at = lambda n: chunk.cuts("x" * n, 48_000, 2_000)
    assert at(48_000) == [(0, 48_000)] and at(48_004) == [(0, 48_000), (46_000, 48_004)] and at(0) == []
    df = spark.createDataFrame([(0, "x" * 48_003), (1, "x" * 48_004), (2, "")], "doc_id long, text string")
    for native in (True, False):
        got = chunk.chunks(df, native=native).groupBy("doc_id").count().collect()
        assert {r[0]: r[1] for r in got} == {0: 1, 1: 2}


def test_chunks_cover_and_native_agrees(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["word", ". ", " ", "\n\n", "é", "x" * 700, "\n"]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    both = df.select("doc_id", chunk.bounds(F.col("text"), 500, 50).alias("a"), chunk.bounds_native(F.col("text"), 500, 50).alias("b")).collect()
    for r in both:
        assert r.a == r.b
        cuts = [(x.start, x.end) for x in r.a]
        if texts[r.doc_id]:
            assert cuts[0][0] == 0 and cuts[-1][1] == len(texts[r.doc_id])
            assert all(a[0] < b[0] <= a[1] for a, b in zip(cuts, cuts[1:]))
    small = chunk.cuts("a. b\n\nc " + "z" * 3000, 2000, 200)
    assert small[0] == (0, 2000)


def test_dedup(spark):
    rows = [(0, 0, "Ann Lee", "PERSON"), (0, 1, " ann lee ", "PERSON"), (0, 2, "Kent", "PLACE"), (0, 3, "", "PLACE"), (1, 0, "KENT", "PLACE"), (1, 1, "Ann Lee", "GROUP")]
    many = [("m", d, c, n, i, t, la) for d, n in ((1, 2), (2, 1)) for c, i, t, la in rows]
    df = spark.createDataFrame(many, "model string, doc_id long, chunk_idx int, n_chunks int, entity_idx int, text string, label string")
    got = dedup.dedup(df).orderBy("doc_id", "chunk_idx", "entity_idx").collect()
    assert [(r.text, r.label) for r in got if r.doc_id == 1] == [("Ann Lee", "PERSON"), ("Kent", "PLACE"), ("Ann Lee", "GROUP")]
    assert len([r for r in got if r.doc_id == 2]) == 6
    again = dedup.dedup(dedup.dedup(df))
    assert again.count() == len(got)


def test_wide(spark):
    df = spark.createDataFrame([("m", "doc1", 0, 0, "A", "PERSON"), ("m", "doc1", 0, 1, "X", "PLACE"), ("m", "doc1", 0, 2, "B", "PERSON")], "model string, doc_name string, chunk_idx int, entity_idx int, text string, label string")
    docs = spark.createDataFrame([("m", "doc1"), ("m", "doc2")], "model string, doc_name string")
    got = tabulate.wide(df, ["PERSON", "PLACE"], docs).orderBy("row_idx").collect()
    assert [tuple(r)[1:] for r in got] == [(0, "doc1", "A", "X"), (1, "doc1", "B", ""), (2, "", "", ""), (3, "", "", "")]


NAMES = [
    ("Dr. John  Smith", "john smith", "John Smith", 1, 1, 1, 1, 1),
    ("John Smith, Jr.", "John Smith", "John Smith, .", 0, 0.333333, 0.769231, 0.869565, 0.869565),
    ("Mary Ann Lee", "Mary Lee", "Mary Ann Lee", 0, 0.666667, 0.666667, 0.8, 0.666667),
    ("Catherine Brown", "Katherine Browne", "Catherine Brown", 0, 0, 0.875, 0.903226, 0.903226),
    ("Dr John Smith", "John Smith", "Dr John Smith", 0, 0.666667, 0.769231, 0.869565, 0.666667),
    ("(unknown)", "Ann Lee", "", 0, 0, 0, 0, 0),
]


def test_name_similarity(spark):
    a, b = tx.clean_name(F.col("a")), tx.clean_name(F.col("b"))
    zero = F.lit(0.0)
    df = spark.createDataFrame([n[:2] for n in NAMES], "a string, b string").select(
        a.alias("clean"), sim.exact(F.lower(a), F.lower(b)).alias("e"), sim.partial(sim.name_tokens(a), sim.name_tokens(b)).alias("p"), sim.edit(a, b).alias("l"), sim.sequence(F.lower(a), F.lower(b)).alias("s")
    )
    df = df.withColumn("m", sim.match_score(F.col("e"), F.col("p"), F.greatest("e", "p", "l", "s"), zero, zero, zero))
    assert [(r.clean, *(round(x, 6) for x in (r.e, r.p, r.l, r.s, r.m))) for r in df.collect()] == [n[2:] for n in NAMES]


@pytest.mark.parametrize(("letters", "most", "n"), [("ab", 12, 3000), ("abcd\u00e9\U00010400 ", 30, 1500), ("abcdefghij klmnop", 260, 100)])
def test_ratios_are_the_librarys(letters, most, n):
    """Empty texts, ties between blocks, and texts from which the library passes over frequent characters."""
    from difflib import SequenceMatcher

    from scriptorium.functions.sequences import ratios

    rng = random.Random(most)
    made = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    pairs = [("", ""), ("", "a"), ("tide", "diet"), ("diet", "tide"), *((made(), made()) for _ in range(n))]
    assert ratios(pairs).tolist() == [SequenceMatcher(None, *p).ratio() for p in pairs]
    assert ratios([]).tolist() == []


def test_sequence_is_not_symmetric(spark):
    r = spark.range(1).select(sim.sequence(F.lit("tide"), F.lit("diet")).alias("a"), sim.sequence(F.lit("diet"), F.lit("tide")).alias("b")).first()
    assert (r.a, r.b) == (0.25, 0.5)


@pytest.mark.parametrize(("a", "b", "want"), [("1753-1831", "1800", 0.012658), ("1800", "1805", 0.75), ("1800", "1810", 0.5), ("1800", "1811", 0), ("c1790", "1790", 0), ("+1795-00-00T00:00:00Z", "1795;1797", 0.333333)])
def test_dates(spark, a, b, want):
    arr = lambda x: F.array(*map(F.lit, x.split(";")))
    assert round(spark.range(1).select(sim.date_similarity(sim.years(arr(a)), sim.years(arr(b)))).first()[0], 6) == want


@pytest.mark.parametrize(("a", "b", "want"), [(["Kent County"], ["kent"], 1), (["Liverpool", "City"], ["Liverpool"], 0.5), ([], ["x"], 0)])
def test_places(spark, a, b, want):
    arr = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    assert spark.range(1).select(sim.jaccard(sim.place_set(arr(a)), sim.place_set(arr(b)))).first()[0] == want


@pytest.mark.parametrize(("d", "l", "c", "want"), [(0, 0, 0, 0.666667), (0.75, 0, 0, 0.711111), (0.5, 1, 0, 0.757576), (0, 0, 0.1, 0.460606), (1, 0.5, 0.25, 0.648810)])
def test_match_score(spark, d, l, c, want):  # noqa: E741
    v = lambda x: F.lit(float(x))
    got = spark.range(1).select(sim.match_score(v(0), v(2 / 3), v(0.8), v(d), v(l), v(c)), sim.match_score(v(1), v(1), v(1), v(0), v(0.2), v(0))).first()
    assert round(got[0], 6) == want and round(got[1], 6) == 0.621053


def test_evaluation(spark):
    n = None
    person = (["Ann Lee", "Bob Roe", n, n, "Cy  Poe", "", n], ["ann lee ", "Rob Roe", n, "Dee", "Cy Poe", n, n])
    place = (["Liverpool", n, "Kent", n, n, n, n], ["Liverpool", n, n, n, n, n, n])
    truth = spark.createDataFrame([(i, "d", person[0][i], place[0][i]) for i in range(7)], "row_idx long, Document string, PERSON string, PLACE string")
    model = spark.createDataFrame([("m", i, "d", person[1][i], place[1][i]) for i in range(7)], "model string, row_idx long, Document string, PERSON string, PLACE string")
    aligned = evaluate.align(truth, model, ["PERSON", "PLACE", "SHIP"])
    metrics = evaluate.by_label(aligned)
    got = {r.entity_type: (r.num_samples, r.exact_match, r.true_positives, r.false_positives, r.false_negatives, r.precision, round(r.recall, 6), round(r.f1_score, 6)) for r in metrics.collect()}
    assert got == {"PERSON": (5, 0.4, 1, 3, 2, 0.25, 0.333333, 0.285714), "PLACE": (2, 0.5, 1, 0, 1, 1, 0.5, 0.666667)}
    assert [round(x, 6) for x in evaluate.macro(metrics).first()[1:]] == [0.45, 0.625, 0.416667, 0.47619]
    assert list(evaluate.micro(metrics).first())[1:] == [0.4, 0.4, pytest.approx(0.4), 2, 3, 3]
    assert evaluate.examples(aligned).filter("label = 'PERSON'").count() == 4
    assert evaluate.by_label(evaluate.align(truth, model, ["PERSON"], "document")).count() == 1
    none = spark.createDataFrame([("m", "X", 0, n, n)], "model string, label string, row_idx long, gt string, pred string")
    assert list(evaluate.by_label(none).first())[2:] == [0, 0, 0, 0, 0, 0, 0, 0]


def test_highlight(spark):
    text = 'Ann Lee met Lee & Co of Leeds, "Lee"'
    e = [(0, "Lee", "PERSON"), (1, "Ann Lee", "PERSON"), (2, "Lee & Co", "ORG"), (3, "a\\E$1(", "X"), (4, "", "X")]
    df = spark.createDataFrame([(text, e)], "text string, e array<struct<entity_idx:int,text:string,label:string>>")
    got = df.select(report.highlight(F.col("text"), F.col("e"))).first()[0]
    span = lambda x: f'<span class="entity" style="background-color: #FF6347" title="PERSON">{x}</span>'
    assert got == f"{span('Ann ' + span('Lee'))} met {span('Lee')} &amp; Co of Leeds, &quot;{span('Lee')}&quot;"


def _item(name, **more):
    claim = lambda v, t="string", **q: {"mainsnak": {"datavalue": {"type": t, "value": v}}, **q}
    base = {
        "id": "Q1", "labels": {"en": {"value": name}}, "descriptions": {"en": {"value": "a sailor"}}, "aliases": {"en": [{"value": "AL"}]},
        "claims": {"P1": [claim("born 1790"), claim("")], "P2": [claim("Kent County", qualifiers={"Q": [{"datavalue": {"type": "string", "value": "Dover"}}]})], "P3": [claim({"time": "+1795-00-00T00:00:00Z"}, "time")], "P4": [claim("skilled field worker and cook")]},
    }
    return base | more


def test_authority_items(spark, tmp_path):
    items = [_item("Ann Lee"), _item("Ann"), _item("Ann Epperson"), _item("Bob Roe", descriptions=[]), _item("Cy Poe", labels=[]), _item("Di Fox", labels=None), _item("Al Orr", claims=[])]
    (tmp_path / "db.json").write_text(json.dumps(items))
    from scriptorium.sources import files

    db = files.authority_items(spark, str(tmp_path / "db.json"))
    got = {r.name: r for r in authority.persons(db).collect()}
    assert set(got) == {"Ann Lee", "Bob Roe", "Al Orr"}
    ann = got["Ann Lee"]
    assert (ann.db_idx, ann.id, ann.description, ann.aliases) == (0, "Q1", "a sailor", ["AL"])
    assert (ann.dates, ann.locations, ann.occupations) == (["born 1790", "+1795-00-00T00:00:00Z"], ["Kent County", "Dover"], ["skilled field worker and cook"])
    assert got["Bob Roe"].description == "" and got["Al Orr"].dates == []
    assert {r.name for r in authority.persons(db, strict=True).collect()} == {"Ann Lee"}


def test_linkage_end_to_end(spark):
    sheet = spark.createDataFrame([(0, "d1", " Dr. Ann Lee ", "1795", "Kent"), (1, "d1", " ", "1800", None), (2, "d2", "Zed Quux", None, None)], "row_idx long, Document string, PERSON string, DATE string, PLACE string")
    people = authority.spreadsheet_persons(sheet)
    assert [(r.person_idx, r.name, r.dates, r.locations) for r in people.orderBy("person_idx").collect()] == [(0, "Dr. Ann Lee", ["1795"], ["Kent"]), (2, "Zed Quux", [], [])]
    items = [(i, json.dumps(_item(n))) for i, n in enumerate(["Ann Lee", "Ann Leigh", "Anna Lee", "Bo Derr", "Anne Lee", "Ann Lees", "Ann Le"])]
    db = authority.persons(spark.createDataFrame(items, "db_idx long, j string").select("db_idx", F.try_parse_json("j").alias("item")))
    found = linkage.find_matches(people, db)
    best = found.orderBy(F.desc("match_probability")).first()
    assert (best.authority_person_name, best.spreadsheet_name, best.name_exact) == ("Ann Lee", "Dr. Ann Lee", 1.0)
    assert found.filter("spreadsheet_name = 'Dr. Ann Lee'").count() == 5
    assert found.filter("match_probability < 0.3").count() == 0
    old = linkage.BLOCK
    try:
        linkage.BLOCK = 100  # several blocks of both sides
        assert sorted(map(str, linkage.find_matches(people, db).collect())) == sorted(map(str, found.collect()))
    finally:
        linkage.BLOCK = old


def test_text_helpers(spark):
    df = spark.createDataFrame([("  a\tb  ", "x.y.txt", "a\r\nb\rc")], "a string, b string, c string")
    r = df.select(tx.strip(F.col("a")).alias("s"), tx.collapse(F.col("a")).alias("c"), tx.stem(F.col("b")).alias("t"), tx.newlines(F.col("c")).alias("n")).first()
    assert tuple(r) == ("a\tb", "a b", "x.y", "a\nb\nc")


def test_prompts_and_whole_document(spark):
    df = spark.createDataFrame([(1, "f", "y" * 4000)], "doc_id long, doc_name string, text string")
    got = prompts(df, 500, 50).orderBy("chunk_idx").collect()
    assert got[1].prompt.startswith(f"[Processing chunk 2 of {len(got)} from f]\n\n")
    assert prompts(df, whole_document=True).first().prompt == "y" * 4000


def test_http_annotator(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
            bad = len(text) > 2000 and "long" in text or "down" in text
            body = b"prediction-error" if "long" in text else b"gone"
            if not bad:
                body = json.dumps({"choices": [{"message": {"content": json.dumps({"entities": [{"text": text[:3], "label": "PERSON"}]})}}]}).encode()
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = annotate.HttpAnnotator("m", f"http://127.0.0.1:{server.server_port}/v1/chat/completions")
    df = spark.createDataFrame([(0, "a", "Ann"), (1, "b", "long" + "x" * 3000), (2, "c", "down")], "doc_id long, doc_name string, text string")
    got = {r.doc_id: (r.status, r.attempts) for r in model.annotate(prompts(df)).collect()}
    assert got == {0: ("ok", 1), 1: ("ok", 2), 2: ("error", 1)}
    assert {r.text for r in extract(df, model).collect()} == {"Ann", "lon"}
    server.shutdown()


def test_marking_is_replacement_one_by_one():
    """One automaton pass against the fold, with entities that are found in tags, repeat, touch and overlap."""
    import random

    from scriptorium.functions import marking

    rng = random.Random(1)
    words = ["Ann", "Lee", "Ann Lee", "Lee Roe", "-x", "x", "Lee-x", "span", "entity", "class", "title", "PERSON", "color", "amp", "a", "a a", "span class", "é", "FFD700", "/", "style", "_", "b_", "==", "#", "", 'Lee"', "<b"]
    for _ in range(4000):
        text = "".join(rng.choice([*words, " ", " ", " ", "&amp;", "-", "; "]) for _ in range(rng.randint(0, 25)))
        entities = sorted((rng.choice(words) for _ in range(rng.randint(0, 7))), key=lambda x: -len(x))
        if sum(e in ("span", "class", "entity", "title", "style", "/") for e in entities) > 4:
            continue  # the fold itself grows without bound
        tags = [f'<span class="entity" style="color: #{rng.choice(["FFD700", "aa"])}" title="{rng.choice(["PERSON", "DATE x"])}">' for _ in entities]
        assert marking.marked(text, entities, tags) == marking.one_by_one(text, entities, tags), (text, entities)


def test_marking_does_not_depend_on_the_number_of_entities():
    import time

    from scriptorium.functions import marking

    text = " ".join(f"w{i % 5000}" for i in range(100_000))
    entities = [f"w{i}" for i in range(4999, 999, -1)]
    began = time.perf_counter()
    assert marking.marked(text, entities, ["<b>"] * 4000).count("<b>") == 80_000 and time.perf_counter() - began < 20


def test_pairing_takes_the_least_stem_that_starts_so(spark):
    import random

    from scriptorium.operators import report

    rng = random.Random(2)
    made = lambda: "".join(rng.choice("ab_é") for _ in range(rng.randint(1, 5)))
    stems, bases = {made() for _ in range(120)}, [made() for _ in range(150)] + ["zz", "zz", "\U00010400"]
    want = []
    for b in bases:
        found = [b] if b in stems else sorted(s for s in stems if s.startswith(b))[:1]
        want += [(b, s) for s in found]
    reports = spark.createDataFrame([(b,) for b in bases], "base string")
    texts = spark.createDataFrame([(s, "x") for s in stems], "stem string, text string")
    got = [(r.base, r.stem) for r in report.pair(reports, texts).collect()]
    assert sorted(got) == sorted(want) and len(want) > 60
    assert report.pair(reports.limit(0), texts).count() == report.pair(reports, texts.limit(0)).count() == 0
    plan = report.pair(reports, texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan  # frames only grow, so a scan is linear


def test_dates_that_come_near_are_all_pairs_above_zero(spark):
    import random

    from scriptorium.operators import similar

    rng = random.Random(5)
    made = lambda: [rng.randint(1500, 2099) for _ in range(rng.choice([0, 1, 1, 2]))] + rng.choice([[], [1800]])
    a, b = [(i, made()) for i in range(60)], [(i, made()) for i in range(70)]
    left, right = spark.createDataFrame(a, "a int, x array<int>"), spark.createDataFrame(b, "b int, y array<int>")
    every = left.join(right, F.lit(True)).select("a", "b", sim.date_similarity(F.col("x"), F.col("y")).alias("date_score")).filter("date_score > 0")
    want = sorted(map(tuple, every.collect()))
    assert sorted(map(tuple, similar.near_in_time(left, right).select("a", "b", "date_score").collect())) == want and len(want) > 500
    assert similar.near_in_time(left.limit(0), right).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
def test_similar_sets_are_all_pairs_above_the_threshold(spark, threshold):
    import random

    from scriptorium.operators import similar

    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 12))] for _ in range(40)]
    left = [(i, x) for i, x in enumerate(base)] + [(100, None), (101, []), (102, base[3][::-1])]
    right = [(i, [w for w in x if rng.random() > 0.15] + rng.choice([[], ["new"], [None]])) for i, x in enumerate(base)] + [(200, base[5]), (201, base[5])]
    one = lambda rows: {frozenset(w for w in x if w is not None): min(k for k, y in rows if y and {*y} - {None} == {*x} - {None}) for _, x in rows if x and {*x} - {None}}
    p, q = one(left), one(right)
    want = sorted((p[x], q[y], len(x & y) / len(x | y)) for x in p for y in q if len(x & y) / len(x | y) >= threshold)
    a, b = spark.createDataFrame(left, "a int, x array<string>"), spark.createDataFrame(right, "b int, y array<string>")
    assert sorted(map(tuple, similar.similar_sets(a, b, threshold).collect())) == want and (want or threshold == 1.0)
    assert similar.similar_sets(a.limit(0), b, threshold).count() == 0


def test_ledger_asks_no_answered_prompt_twice(spark, tmp_path):
    """A job that dies in the middle, then others: the server sees each prompt once, but for the one that failed and errors."""
    import json
    import threading
    import time
    from collections import Counter
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from scriptorium.operators.ledger import LedgerAnnotator

    asked, now, most, lock, broken = Counter(), [0], [0], threading.Lock(), {"dies"}

    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
            with lock:
                asked[text] += 1
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.05)
            with lock:
                now[0] -= 1
            self.send_response(500 if text == "down" else 200)
            self.end_headers()
            self.wfile.write(b"gone" if text == "down" else json.dumps({"choices": [{"message": {"content": "re: " + text}}]}).encode())

        def log_message(self, *a):
            pass

    class Fragile(annotate.HttpAnnotator):
        """Ends its task at a certain prompt."""

        def answer(self, prompt):
            if prompt in doomed:
                raise RuntimeError("the executor is lost")
            return super().answer(prompt)

    server = ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1/chat/completions"
    rows = [(i, f"p{i % 20}") for i in range(60)] + [(60, "down"), (61, "dies"), (62, None)]
    df = spark.createDataFrame(rows, "doc_id long, prompt string")
    ask = lambda kind, model="m": LedgerAnnotator(kind(model, url), str(tmp_path / "ledger"), 2, 4, 3).annotate(df)
    doomed = broken
    with pytest.raises(Exception, match="executor is lost"):
        ask(Fragile)
    before = dict(asked)
    assert before and max(before.values()) == 1
    got = {r.doc_id: (r.prompt, r.raw_response, r.status) for r in ask(annotate.HttpAnnotator).collect()}
    assert got == {i: (p, None, "error") if p == "down" else (p, "re: " + (p or ""), "ok") for i, p in rows}
    assert {p: n for p, n in asked.items() if n > 1 and p != "down"} == {} and 1 < most[0] <= 8
    ask(annotate.HttpAnnotator).collect()
    assert {p: n for p, n in asked.items() if n > 1 and p != "down"} == {} and asked["down"] >= 2
    ask(annotate.HttpAnnotator, "other").collect()
    assert asked["p1"] == 2
    server.shutdown()


def test_dates_are_scored_once_for_each_pair_of_spans(spark):
    """Rows of equal spans are not scored again, and another key narrows the pairs; scores of zero stay if asked for."""
    from scriptorium.operators import similar

    a = spark.createDataFrame([(i, i % 3, [1800, 1800 + i % 2]) for i in range(200)], "a int, k int, x array<int>")
    b = spark.createDataFrame([(i, i % 3, [[1801, 1805], [1990]][i % 2]) for i in range(300)] + [(300, 0, [])], "b int, k int, y array<int>")
    assert similar.span_scores(similar.spans(a, "x", "a"), similar.spans(b, "y", "b")).count() == 2
    assert similar.span_scores(similar.spans(a, "x", "a"), similar.spans(b, "y", "b"), near_only=False).count() == 4
    every = a.join(b.filter("size(y) > 0"), "k").select("a", "b", "k", F.round(sim.date_similarity(F.col("x"), F.col("y")), 6).alias("date_score"))
    got = lambda df: sorted(map(tuple, df.select("a", "b", "k", "date_score").collect()))
    assert got(similar.in_time(a, b, ("k",), 6, near_only=False)) == got(every)
    assert got(similar.in_time(a, b, ("k",), 6)) == got(every.filter("date_score > 0"))
    assert similar.near_in_time(a, b).count() == 200 * 150


def test_similar_sets_write_only_what_bits_leave(spark):
    """Sets that share the same few rare words: their lists would give all pairs; and large, small and unlike sizes in blocks and slices."""
    import random

    from scriptorium.operators import similar

    rng = random.Random(8)
    rows = [(i, [f"rare{i % 3}"] + [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([3, 60, 60, 60, 150, 700]))]) for i in range(300)]
    rows += [(1000 + i, [w for w in x if rng.random() > 0.1]) for i, x in rows[:40]] + [(2000, rows[5][1][::-1]), (2001, None), (2002, [])]
    df = spark.createDataFrame(rows, "a int, x array<string>")
    sets = {}
    for k, x in rows:
        if x:
            sets.setdefault(frozenset(x), k)
    pairs = [(*sorted((p, q)), len(x & y) / len(x | y)) for x, p in sets.items() for y, q in sets.items() if p < q]
    want = sorted(t for t in pairs if t[2] >= 0.6)
    assert sorted(map(tuple, similar.similar_sets(df, None, 0.6).collect())) == want and len(want) > 30
    ids = similar.members(df, "a", "x").dropDuplicates(["set"]).withColumn("id", F.col("key").cast("long"))
    assert similar.candidates(ids, ids, 0.6, True).count() < 2 * len(want)  # of 57,000 pairs
    small = {"ROWS": 64, "WIDE": 2000, "SLICE": 9000}
    before = {k: getattr(similar, k) for k in small}
    try:
        for k, v in small.items():
            setattr(similar, k, v)
        assert sorted(map(tuple, similar.similar_sets(df, None, 0.6).collect())) == want
    finally:
        for k, v in before.items():
            setattr(similar, k, v)


@pytest.mark.parametrize("exact", [True, False])
def test_similar_sets_are_told_by_the_words_they_share(spark, monkeypatch, exact):
    """rare words find partners, whole sets are judged in the same task; also in small steps, and where hashes are not trusted."""
    import random

    from scriptorium.operators import similar

    rng = random.Random(9)
    word = lambda: f"w{int(rng.paretovariate(0.4)) % 5000}"
    base = [[word() for _ in range(rng.choice([1, 2, 5, 20, 80, 300]))] for _ in range(120)]
    left = [(i, x) for i, x in enumerate(base)] + [(500 + i, [w for w in x if rng.random() > 0.1] + [word()]) for i, x in enumerate(base)]
    right = [(i, [w for w in x if rng.random() > 0.2] + [word()]) for i, x in enumerate(base[::-1])]
    classes = lambda rows: {frozenset(x): min(k for k, y in rows if {*y} == {*x}) for _, x in rows if x}
    p, q = classes(left), classes(right)
    alike = lambda x, y: len(x & y) / len(x | y)
    own = sorted((min(a, b), max(a, b), alike(x, y)) for x, a in p.items() for y, b in p.items() if a < b and alike(x, y) >= 0.6)
    both = sorted((a, b, alike(x, y)) for x, a in p.items() for y, b in q.items() if alike(x, y) >= 0.6)
    a, b = spark.createDataFrame(left, "a int, x array<string>"), spark.createDataFrame(right, "b int, y array<string>")
    ids = similar.members(a, "a", "x").dropDuplicates(["set"]).withColumn("id", F.col("key").cast("long"))
    assert sorted((min(r.a, r.b), max(r.a, r.b)) for r in similar.candidates(ids, ids, 0.6, True).collect()) == [t[:2] for t in own]
    words = similar.words
    for k, v in {"FREQUENT": 50, "ROWS": 16, "SLICE": 5000}.items():  # those below are read in workers, which have their own
        monkeypatch.setattr(similar, k, v)
    monkeypatch.setattr(similar, "words", lambda *sides: (words(*sides)[0], exact))
    assert sorted(map(tuple, similar.similar_sets(a, None, 0.6).collect())) == own and len(own) > 60
    assert sorted(map(tuple, similar.similar_sets(a, b, 0.6).collect())) == both and len(both) > 20


@pytest.mark.parametrize(("more", "step", "cells"), [(1, 10**6, 1), (2, 30, 100), (12, 12, 10**6)])
def test_listed_sets_meet_all_that_are_similar(monkeypatch, more, step, cells):
    """whatever number of rare words is asked for, and however few pairs are counted at a time."""
    import random

    import numpy as np

    from scriptorium.operators import similar

    for k, v in {"MORE": more, "STEP": step, "CELLS": cells}.items():
        monkeypatch.setattr(similar, k, v)
    rng = random.Random(3)
    made = [sorted({int(rng.paretovariate(0.5)) % 900 for _ in range(rng.choice([1, 3, 30, 150]))}) for _ in range(150)]
    made += [sorted({w for w in x if rng.random() > 0.15} | {901}) for x in made]
    packed = lambda rows: (np.array([i for i, _ in rows]), np.array([len(x) for _, x in rows]), np.array([w for _, x in rows for w in x]), np.cumsum([0] + [len(x) for _, x in rows]))
    one, two = list(enumerate(made[:180])), list(enumerate(made))[100:]
    alike = lambda x, y, t: len({*x} & {*y}) >= t * len({*x} | {*y}) - 1e-9
    for t in (0.3, 0.6, 1.0):
        got = lambda a, b, same, t=t: sorted(z for f in similar.matches(packed(a), similar.listed(packed(b), t, same), t, same) for z in zip(*map(np.ndarray.tolist, f), strict=True))
        assert got(one, two, False) == sorted((i, j, len({*x} & {*y})) for i, x in one for j, y in two if alike(x, y, t))
        want = sorted((i, j, len({*x} & {*y})) for i, x in one for j, y in one if alike(x, y, t) and (len(y), j) < (len(x), i))
        assert got(one, one, True) == want and (want or t == 1)


def test_rows_of_one_span_follow_each_other(spark):
    """pairs are as many as they are, but equal lists of partners stand side by side, which files hold in few bytes."""
    from itertools import groupby

    from scriptorium.operators import similar

    a = spark.createDataFrame([(i, [1800 + i * 7 % 5]) for i in range(400)], "a int, x array<int>")
    b = spark.createDataFrame([(i, [1800 + i % 3]) for i in range(30)], "b int, y array<int>")
    rows = similar.near_in_time(a, b).select("a", "b", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 400 * 30 and len({(r.a, r.b) for r in rows}) == len(rows)
    for _, part in groupby(rows, key=lambda r: r.task):
        spans = [s for s, _ in groupby(r.a * 7 % 5 for r in part)]
        assert spans == sorted(set(spans))
