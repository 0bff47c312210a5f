"""Sources, sinks, the command line and the streaming ingestion on files."""

import json

from scriptorium import cli
from scriptorium.operators import annotate, parse
from scriptorium.sources import files, sinks
from scriptorium.streaming import ingest


def _texts(folder):
    folder.mkdir()
    (folder / "b.txt").write_bytes(b"Ann Lee met\r\nBob Roe in 1799.\rEnd")
    (folder / "a +%20b.txt").write_bytes("Zoë Lee saw Dover".encode())
    (folder / "bad.txt").write_bytes(b"\xff\xfe\x00")
    (folder / "empty.txt").write_bytes(b"")
    (folder / "x.md").write_bytes(b"no")


def test_text_files(spark, tmp_path):
    _texts(tmp_path / "t")
    got = {r.file_name: r.text for r in files.text_files(spark, str(tmp_path / "t")).collect()}
    assert got == {"b.txt": "Ann Lee met\nBob Roe in 1799.\nEnd", "a +%20b.txt": "Zoë Lee saw Dover"}
    kept = {r.file_name: r.text for r in files.text_files(spark, str(tmp_path / "t"), keep_bad=True).collect()}
    assert kept["bad.txt"] == "" and len(kept) == 3


def test_command_line_round_trip(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    _texts(tmp_path / "t")
    out = tmp_path / "out"
    cli.main(["extract", "rules:alpha", str(tmp_path / "t"), str(out)])
    made = json.loads((out / "json" / "alpha" / "b_entities.json").read_text())
    assert {"text": "Ann Lee", "label": "PERSON"} in made["entities"]
    found = files.entity_files(spark, str(out / "json"))
    assert {(r.model, r.doc_name) for r in found.collect()} == {("alpha", "b"), ("alpha", "a +%20b")}
    cli.main(["tabulate", str(out / "json")])
    table = spark.read.parquet(str(out / "json" / "_tables"))
    assert table.count() > 3
    table.drop("model").write.parquet(str(tmp_path / "truth.parquet"))
    cli.main(["evaluate", "--ground-truth", str(tmp_path / "truth.parquet"), "--tables", str(out / "json" / "_tables"), "--show-examples"])
    assert "|1.0" in capsys.readouterr().out
    cli.main(["report", str(tmp_path / "t"), str(out / "json" / "alpha"), str(tmp_path / "html")])
    page = "".join(p.read_text() for p in (tmp_path / "html").glob("part-*"))
    assert 'title="PERSON">Ann Lee</span>' in page and page.startswith("<!DOCTYPE html>")


def test_link_command(spark, tmp_path):
    (tmp_path / "s.csv").write_text("row_idx,Document,PERSON,DATE,PLACE\n0,d,Ann Lee,1795,Kent\n")
    (tmp_path / "db.json").write_text(json.dumps([{"id": "Q1", "labels": {"en": {"value": "Ann Lee"}}, "claims": {}}]))
    cli.main(["link", str(tmp_path / "s.csv"), str(tmp_path / "db.json"), "--output", str(tmp_path / "m")])
    got = spark.read.csv(str(tmp_path / "m"), header=True).collect()
    assert len(got) == 1 and got[0].authority_person_id == "Q1" and got[0].spreadsheet_dates == "1795"


def test_stream_takes_each_file_once(spark, tmp_path):
    _texts(tmp_path / "t")
    run = lambda: ingest.extract_stream(ingest.text_stream(spark, str(tmp_path / "t")), annotate.RuleAnnotator("alpha"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(120)
    run()
    first = spark.read.parquet(str(tmp_path / "o" / "entities")).count()
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "o" / "bronze")).select("doc_name").collect()} == {"b", "a +%20b"}
    (tmp_path / "t" / "c.txt").write_text("Cy Poe")
    run()
    after = spark.read.parquet(str(tmp_path / "o" / "entities"))
    assert first > 0 and after.count() > first and after.filter("text = 'Cy Poe'").count() == 1


def test_authority_lines_and_sinks(spark, tmp_path):
    (tmp_path / "db.jsonl").write_text('{"id":"Q1"}\n\nnot json\n{"id":"Q2"}\n')
    assert files.authority_items(spark, str(tmp_path / "db.jsonl")).count() == 2
    df = spark.createDataFrame([("m", "d", 0, 0, 'a "b"', "X")], "model string, doc_name string, chunk_idx int, entity_idx int, text string, label string")
    assert json.loads(sinks.entity_documents(df).first().json) == {"entities": [{"text": 'a "b"', "label": "X"}]}
    sinks.write_entities(df, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 1
    assert parse.dead_letters(parse.parse(spark.createDataFrame([("no",)], "raw_response string"))).count() == 1


def test_stream_prompts_and_dedups_chunks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "long.txt").write_text("Ann Lee met Bob Roe in 1799. " * 60)
    ingest.extract_stream(ingest.text_stream(spark, str(tmp_path / "t")), annotate.RuleAnnotator("alpha"), str(tmp_path / "o"), str(tmp_path / "c"), 100, 20).awaitTermination(120)
    bronze = spark.read.parquet(str(tmp_path / "o" / "bronze")).collect()
    assert len(bronze) > 1 and all(r.prompt.startswith(f"[Processing chunk {r.chunk_idx + 1} of {len(bronze)} from long.txt]") for r in bronze)
    found = [(r.text.lower(), r.label) for r in spark.read.parquet(str(tmp_path / "o" / "entities")).collect()]
    assert len(found) == len(set(found)) > 0


def test_special_files_are_flattened_in_extraction(spark):
    from scriptorium.plans.extract import prompts

    text = "Zoë\r\nLee\n\n saw  Dover"
    docs = spark.createDataFrame([(1, "x920_ROS1_(unformatted)y", text), (2, "other", text)], "doc_id long, doc_name string, text string")
    for whole in (False, True):
        got = {r.doc_id: r.prompt for r in prompts(docs, whole_document=whole).collect()}
        assert got == {1: "Zo Lee saw Dover", 2: text}


def test_missing_inputs_end_with_a_message(spark, tmp_path):
    import pytest

    with pytest.raises(SystemExit, match="not found: .*nothing"):
        cli.main(["tabulate", str(tmp_path / "nothing")])


def test_a_model_without_any_answer_ends_with_a_message(spark, tmp_path):
    import pytest

    _texts(tmp_path / "t")
    with pytest.raises(SystemExit, match="no answer from: nobody$"):
        cli.main(["extract", "rules:alpha,nobody", str(tmp_path / "t"), str(tmp_path / "out"), "--url", "http://127.0.0.1:9/v1"])
    assert (tmp_path / "out" / "json" / "alpha" / "b_entities.json").exists()


def test_hidden_names_are_read(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for name in ("a.txt", "_b.txt", ".c.txt", "_d.md"):
        (tmp_path / "t" / name).write_text(name)
    assert sorted(r.text for r in files.text_files(spark, str(tmp_path / "t")).collect()) == [".c.txt", "_b.txt", "a.txt"]
    for name in ("m/x_entities.json", "m/_y_entities.json", "_n/z_entities.json", "m/.w_entities.json"):
        (tmp_path / "j" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "j" / name).write_text('{"entities": []}')
    got = {(r.model, r.doc_name, r.raw_response) for r in files.entity_files(spark, str(tmp_path / "j")).collect()}
    assert got == {(m, d, '{"entities": []}') for m, d in (("m", "x"), ("m", "_y"), ("_n", "z"), ("m", ".w"))}
    assert sorted(r.base for r in files.report_files(spark, str(tmp_path / "j" / "m")).collect()) == [".w", "_y", "x"]


def _value(rng, depth=0):
    """A JSON value full of what borders are made of."""
    kind = rng.randint(0, 6 if depth < 3 else 3)
    if kind == 0:
        return rng.choice([1, None, True, -2.5])
    if kind <= 3:
        return "".join(rng.choice(["a", '"', "\\", "\\\\", "[", "]", "{", "}", ",", "\n", "é", "語", ":"]) for _ in range(rng.randint(0, 8)))
    if kind == 4:
        return [_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {f'k{i}"[': _value(rng, depth + 1) for i in range(rng.randint(0, 4))}


def _read_here(path, kind, size):
    """The two passes over ranges, without Spark."""
    from scriptorium.sources import ranges

    total, out, inside, depth, at = path.stat().st_size, [], False, 0, 0
    for start in range(0, total, size):
        where = (f"file://{path}", start, min(start + size, total), total)
        said = {x[0]: x for x in ranges._scan(*where[:3], kind)}[inside]
        out += ranges._items(*where, inside, depth, at) if kind == "array" else ranges._lines(*where, at)
        at += dict(zip(said[3], said[4], strict=True)).get(1 - depth if kind == "array" else 0, 0)
        inside, depth = said[1], depth + said[2]
    return out


def test_ranges_of_any_size_give_the_items_of_an_array_and_the_lines(tmp_path):
    import random

    rng = random.Random(1)
    for _ in range(120):
        items = [_value(rng) for _ in range(rng.randint(0, 12))]
        (tmp_path / "x").write_text(rng.choice(["", " \n"]) + json.dumps(items, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) + rng.choice(["", "\n"]))
        lines = [rng.choice(["", '{"a":1}', "x" * rng.randint(1, 9), "é"]) for _ in range(rng.randint(1, 9))]
        (tmp_path / "y").write_text("\n".join(lines))
        for size in (1, 2, 3, 7, 50, 10**6):
            assert [(i, json.loads(x)) for i, x in _read_here(tmp_path / "x", "array", size)] == list(enumerate(items))
            assert _read_here(tmp_path / "y", "lines", size) == [(i, x) for i, x in enumerate(lines) if x]


def test_one_array_is_read_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    items = [{"id": f"Q{i}", "said": 'a "b", [' * (i % 50)} for i in range(3000)]
    (tmp_path / "db.json").write_text(json.dumps(items))
    df = files.authority_items(spark, str(tmp_path / "db.json"), 1 << 15).select("db_idx", F.try_variant_get("item", "$.id", "string").alias("id"), F.spark_partition_id().alias("task"))
    rows = df.collect()
    assert sorted((r.db_idx, r.id) for r in rows) == [(i, f"Q{i}") for i in range(3000)] and len({r.task for r in rows}) > 5
    (tmp_path / "cut.json").write_text(json.dumps(items)[:-5])
    (tmp_path / "map.json").write_text('{"a": [1], "b": [2]}')
    assert files.authority_items(spark, str(tmp_path / "cut.json")).count() == files.authority_items(spark, str(tmp_path / "map.json")).count() == 0
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.json").write_text("[1, 2]\n")
    (tmp_path / "two" / "b.json").write_text("[3, oops, 5]")
    assert sorted((r.db_idx, str(r.item.toPython())) for r in files.authority_items(spark, str(tmp_path / "two")).collect()) == [(0, "1"), (1, "2"), (2, "3"), (4, "5")]


def test_report_as_pages(spark, tmp_path):
    _texts(tmp_path / "t")
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "b_entities.json").write_text('{"entities": [{"text": "Ann Lee", "label": "PERSON"}]}')
    cli.main(["report", str(tmp_path / "t"), str(tmp_path / "j"), str(tmp_path / "p"), "--pages"])
    (row,) = spark.read.parquet(str(tmp_path / "p")).collect()
    assert row.base == "b" and "b.txt</p>" in row.html and "<strong>Entities found:</strong> 1</p>" in row.html


def _tabulated(spark, tmp_path, monkeypatch):
    """Model A finds two persons and no place, B one of each; the truth has two persons and no place."""
    monkeypatch.setattr(spark, "stop", lambda: None)
    made = {"A": [("Ann Lee", "PERSON"), ("Bob Roe", "PERSON")], "B": [("Ann Lee", "PERSON"), ("Kent", "PLACE")]}
    for model, found in made.items():
        (tmp_path / "j" / model).mkdir(parents=True)
        (tmp_path / "j" / model / "d_entities.json").write_text(json.dumps({"entities": [{"text": t, "label": x} for t, x in found]}))
    cli.main(["tabulate", str(tmp_path / "j")])
    (tmp_path / "truth.csv").write_text("Document,PERSON,PLACE\nd,Ann Lee,\nd,Bob Roe,\n,,\n")
    return str(tmp_path / "j" / "_tables"), str(tmp_path / "truth.csv")


def test_evaluation_by_each_models_own_labels(spark, tmp_path, monkeypatch):
    from scriptorium.operators import evaluate

    tables, truth = _tabulated(spark, tmp_path, monkeypatch)
    table = files.table(spark, tables)
    assert [(r.PERSON, r.PLACE) for r in table.filter("model = 'A'").orderBy("row_idx").collect()] == [("Ann Lee", None), ("Bob Roe", None), ("", None)]
    # Within documents, B's blank row after the document is no partner of the truth's second row.
    for mode, b in (("position", (2, 0.5, 2 / 3)), ("document", (1, 1.0, 1.0))):
        metrics = evaluate.by_label(evaluate.align(cli._rows(spark, truth), table, ["PERSON", "PLACE"], mode, blank_is_null=True))
        got = {(r.model, r.entity_type): (r.num_samples, r.exact_match, r.f1_score) for r in metrics.collect()}
        assert got == {("A", "PERSON"): (2, 1.0, 1.0), ("B", "PERSON"): b, ("B", "PLACE"): (1, 0.0, 0.0)}
        macro = {r.model: (r.exact_match, r.f1_score) for r in evaluate.macro(metrics).collect()}
        assert macro == {"A": (1.0, 1.0), "B": (b[1] / 2, b[2] / 2)}


def test_evaluate_command_prints_these_figures(spark, tmp_path, monkeypatch, capsys):
    tables, truth = _tabulated(spark, tmp_path, monkeypatch)
    capsys.readouterr()
    cli.main(["evaluate", "--ground-truth", truth, "--tables", tables])
    lines = [[c.strip() for c in x.strip("|").split("|")] for x in capsys.readouterr().out.splitlines() if x.startswith("|")]
    first = {(x[0], x[1]): (x[2], x[6]) for x in lines if x[0] in ("PERSON", "PLACE")}
    assert first == {("PERSON", "A"): ("1.0", "2"), ("PERSON", "B"): ("0.5", "2"), ("PLACE", "B"): ("0.0", "1")}


def test_one_page_of_many_parts_is_the_page(spark, tmp_path):
    from scriptorium.operators import report

    rows = [(f"d{i:03d}", f"<section>{'é<' * (i % 7)}\n{i}</section>") for i in range(200)]
    parts, bases = spark.createDataFrame(rows, "base string, html string").repartition(7), spark.createDataFrame([(f"d{i:03d}",) for i in range(0, 260)], "base string")
    want = report.page(parts, bases).first().html + "\n"
    for _ in range(2):
        assert sinks.write_pieces(report.pieces(parts, bases), str(tmp_path / "p")).endswith("part-00000.html")
        assert (tmp_path / "p" / "part-00000.html").read_text() == want and [x.name for x in (tmp_path / "p").iterdir() if not x.name.startswith(".")] == ["part-00000.html"]
    assert "<main></main>" in report.pieces(parts.limit(0), bases).selectExpr("concat_ws('', transform(array_sort(collect_list(struct(place, base, piece))), x -> x.piece)) AS p").first().p


def test_stream_dedup_over_batches_is_batch_dedup(spark, tmp_path):
    """Chunks of the same documents in three batches, in order."""
    from scriptorium.operators import dedup
    from scriptorium.streaming.dedup import dedup_stream

    schema = "model string, doc_id long, chunk_idx int, n_chunks int, entity_idx int, text string, label string"
    rows = []
    for chunk in range(3):
        for doc in (1, 2, 3):
            for i, (text, label) in enumerate([("Ann Lee", "PERSON"), (" ann lee ", "PERSON"), (f"Kent {chunk // 2}", "PLACE"), ("ANN LEE", "ORG"), ("", "PERSON"), (None, "PLACE")]):
                if doc < 3 or chunk == 0:
                    rows.append(("m", doc, chunk, 1 if doc == 3 else 3, i, text, label))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for chunk in range(3):
        spark.createDataFrame([r for r in rows if r[2] == chunk], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = dedup_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select("doc_id", "chunk_idx", "entity_idx", "text", "label").collect()))
    want = sorted(map(str, dedup.dedup(spark.createDataFrame(rows, schema)).select("doc_id", "chunk_idx", "entity_idx", "text", "label").collect()))
    assert got == want and len(got) == 4 + 4 + 6
