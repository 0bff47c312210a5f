"""What keeps the entity queries' time and memory in proportion to their input."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import annotate, authority, evaluate, linkage, parse, report, tabulate
from scriptorium.plans import catalog
from scriptorium.plans.extract import extract

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _aligned(spark, n=400):
    rng = random.Random(7)
    cell = lambda: rng.choice([None, "", " ", "Ann", "ann ", "Bo", "Kent"])
    truth = spark.createDataFrame([(i, "d", cell(), cell()) for i in range(n)], "row_idx long, Document string, PERSON string, PLACE string")
    model = spark.createDataFrame([(m, i, "d", cell(), cell()) for m in "ab" for i in range(n + 9)], "model string, row_idx long, Document string, PERSON string, PLACE string")
    return evaluate.align(truth, model, ["PERSON", "PLACE"])


def test_examples_are_kept_while_rows_pass(spark):
    """no task sorts the pairs; only each task's first few reach the window."""
    aligned = _aligned(spark).repartition(5)
    want = {}
    for r in sorted(aligned.collect(), key=lambda r: r.row_idx):
        if (r.gt or "").strip() or (r.pred or "").strip():
            want.setdefault((r.model, r.label), []).append((r.row_idx, r.gt, r.pred))
    got = {}
    for r in sorted(evaluate.examples(aligned, 3).collect(), key=lambda r: r.n):
        got.setdefault((r.model, r.label), []).append((r.row_idx, r.gt, r.pred))
    assert got == {k: v[:3] for k, v in want.items()} and len(got) == 4
    text = plan(evaluate.examples(aligned, 3))
    assert "MapInArrow" in text and text.index("Window") < text.index("MapInArrow")


def test_first_of_all_batches():
    batch = lambda *rows: pa.RecordBatch.from_pylist([dict(zip(("model", "label", "row_idx", "gt"), r, strict=True)) for r in rows])
    some = [batch(("m", "x", 5, "e"), ("m", "x", 3, "c")), batch(("m", "y", 1, "z"), ("m", "x", 4, "d")), batch(("m", "x", 1, "a"), ("n", "x", 9, None))]
    got = [r for b in evaluate._first(2)(iter(some)) for r in b.to_pylist()]
    assert sorted((r["model"], r["label"], r["row_idx"], r["gt"]) for r in got) == [("m", "x", 1, "a"), ("m", "x", 3, "c"), ("m", "y", 1, "z"), ("n", "x", 9, None)]
    assert list(evaluate._first(2)(iter([]))) == []


def test_own_labels_come_from_the_cells(spark):
    """F8: what made the entities runs once, also where each model has its own labels."""
    found = extract(catalog.documents(spark, DATA), annotate.RuleAnnotator("alpha"), max_tokens=10**8)
    assert "regexp_extract_all" not in plan(tabulate.wide(found, ["PERSON", "SHIP"], own_labels=True))
    rows = tabulate.wide(found, ["PERSON", "SHIP"], own_labels=True).agg(F.count("PERSON").alias("p"), F.count("SHIP").alias("s"), F.count("*").alias("n")).first()
    assert rows.p == rows.n and rows.s == 0


@pytest.mark.parametrize("name", ["eval_by_label", "eval_macro", "eval_micro"])
def test_alignment_joins_rows_not_cells(spark, name):
    """rows meet before they are taken apart into cells."""
    text = plan(catalog.QUERIES[name](spark, DATA))
    keyed = [line for line in text.split("\n") if "Join Inner" in line]
    assert "Expand" not in text and keyed and not any("label" in line for line in keyed)


def test_a_persons_name_is_read_once(spark):
    """the filter on names does not go down below the deal of the items and parse them there."""
    items = spark.range(3).repartition(2).select(F.col("id").alias("db_idx"), F.try_parse_json(F.concat(F.lit('{"id":"Q'), "id", F.lit('","labels":{"en":{"value":"Ann Lee"}}}'))).alias("item"))
    text = plan(authority.persons(items))
    assert text.count("parse_json") + text.count("parseJson") == 1
    assert [(r.id, r.name) for r in authority.persons(items).orderBy("db_idx").collect()] == [(f"Q{i}", "Ann Lee") for i in range(3)]


@pytest.mark.parametrize("name", ["label_flags", "label_counts", "entities_per_doc"])
def test_documents_of_one_chunk_are_not_sorted(spark, name):
    """Each model's small documents reach the aggregate without a window."""
    found = plan(catalog.QUERIES[name](spark, DATA)).split("Union")[-1]
    branches = re.split(r"\n(?=[ :]*[+:]- Project \[(?:alpha|beta|gold) AS model)", found)
    assert found.count("regexp_extract_all") and branches
    one = extract(catalog.documents(spark, DATA), annotate.RuleAnnotator("alpha"), whole_document=True)
    assert "Window" not in plan(one)
    whole = plan(extract(catalog.documents(spark, DATA), annotate.RuleAnnotator("alpha"), max_tokens=10**8))
    assert whole.index("regexp_extract_all") < whole.index("Window")


ODD = [
    '{"entities":[{"text":"a","label":"b"}]}', ' {"entities":[{"text":"a","label":"b"}]}\n', '{"entities":[{"text":"é/\\"\\\\\\n","label":"b"},{"text":"","label":""}]}',
    '{"entities":[]}', "{}", '{"entities":null}', '{"entities":[null]}', '{"entities":[{}]}', '{"entities":[{"text":"a"}]}', '{"entities":[{"text":"a","label":null}]}', '{"entities":[{"text":5,"label":"b"}]}',
    '{"entities":[{"text":true,"label":"b"},{"text":"c","label":"d"}]}', '{"entities":[{"label":"b","text":"a"}]}', '{"entities":[{"text":"a","label":"b","more":1}]}', '{"entities":[{"text":{"x":1},"label":"b"}]}',
    '{"entities":[{"text":"a","label":"b"}]} done', '{"entities":[{"text":"a","label":"b"},]}', '{"entities":[{"text":"a","label":"b"},{"text":"Liv', "", None, "[]", '{"entities":{"text":"a","label":"b"}}', '{"entities":["text","label"]}',
]


def test_a_filter_on_the_status_parses_nothing_again(spark):
    """responses are read once, and the quick reading gives what Python's json module gives."""
    text = plan(catalog.dead_letters(spark, DATA))
    assert not [line for line in text.split("\n") if "Filter" in line and "json" in line.lower()]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(ODD)], "i int, raw_response string")
    got, want = (parse.parse(df, exact=e).orderBy("i").collect() for e in (False, True))
    assert got == want and len(got) == len(ODD)


def test_texts_are_marked_in_slices(spark):
    """texts become Python objects a megabyte at a time, however many a batch holds."""
    texts = pa.array(["a" * 10, None, "b" * 25, "c", "d", ""])
    assert list(report.slices(texts, 20)) == [(0, 2), (2, 1), (3, 3)] and list(report.slices(pa.array([], pa.string()), 20)) == []
    row = ("Ann Lee " * 40_000, [(0, "Ann Lee", "PERSON"), (1, "Lee", None)])
    df = spark.createDataFrame([row, ("", []), ("Lee", []), row, (None, [(0, "x", "y")])], "text string, e array<struct<entity_idx:int,text:string,label:string>>").coalesce(1)
    got = [r[0] for r in df.select(report.highlight(F.col("text"), F.col("e"))).collect()]
    one = '<span class="entity" style="background-color: #FF6347" title="PERSON">Ann <span class="entity" style="background-color: #CCCCCC" title="">Lee</span></span> '
    assert got == [one * 40_000, "", "Lee", one * 40_000, ""]


def test_highlight_reads_documents_once(spark):
    """documents without entities come with the others, not from a second join."""
    text = plan(catalog.highlight(spark, DATA))
    assert "LeftAnti" not in text and text.count("Join") == 1


def test_matches_are_ranked_while_persons_pass(spark):
    """no pair's texts are compared, and no pairs are sorted or shuffled to be ranked."""
    text = plan(catalog.match_topk(spark, DATA))
    assert not re.search(r"levenshtein\(|array_intersect|Window", text) and "judge(" in text


def _odd_people(n, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice(["Ann Lee", "Dr. Ann Lee", "ann lee", "Anna Leigh", "Bob Roe", "Rob Roe Roe", "İda Zoë", "x", "", None])
    dates = lambda: rng.choice([None, [], ["none"], ["1800"], ["c. 1805"], ["1790", "1803"], ["1790", None]])
    places = lambda: rng.choice([None, [], ["Kent"], ["Kent County", "York"], ["York", None]])
    return [(i, f"Q{i}", name(), "d", rng.choice([None, "", "cook in Kent", "in kent"]), [], dates(), places(), rng.choice([None, [], ["Cook"], ["cook", "Nurse"]])) for i in range(n)]


@pytest.mark.parametrize(("threshold", "k", "use_sequence"), [(0.3, 5, True), (0.0, None, True), (0.0, 200, False)])
def test_tables_of_values_give_what_comparing_gives(spark, monkeypatch, threshold, k, use_sequence):
    """with nulls, blank values and ties, in several slices of a batch."""
    rest = "id string, name string, document string, description string, aliases array<string>, dates array<string>, locations array<string>, occupations array<string>"
    a, b = spark.createDataFrame(_odd_people(60, 1), f"person_idx long, {rest}"), spark.createDataFrame(_odd_people(90, 2), f"db_idx long, {rest}")
    scores = ["match_probability", *[c for _, _, made in linkage.FACTORS.values() for c in made if c != "name_sequence"]]
    sides = [f"{t}_{c}" for t, of in (("a", a), ("b", b)) for c in linkage.features(of).columns]
    shown = lambda df, *more: sorted(map(repr, df.select(*sides, *scores, *more).collect()))
    every = linkage.compared(a, b, threshold, use_sequence)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        monkeypatch.setattr(linkage, "CELLS", 700)
        found = linkage.tabled(a, b, threshold, k, use_sequence)
        got, want = (shown(found, "rank"), shown(linkage.top(every, k), "rank")) if k else (shown(found), shown(every))
        assert got == want and len(got) > 50
        monkeypatch.setattr(linkage, "TABLE", 10)
        assert linkage.tabled(a, b, threshold, k, use_sequence) is None
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tables_are_left_where_a_batch_has_too_many_matches(spark, monkeypatch):
    people, records = catalog._people(spark, DATA)
    want = linkage.pairs(people, records, 0.5).count()
    monkeypatch.setattr(linkage, "CELLS", 1000)
    assert linkage.tabled(people, records, 0.5, None) is None and linkage.pairs(people, records, 0.5).count() == want > 0
