"""Command line: extract, tabulate, evaluate, report, link."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import annotate, authority, evaluate, ledger, linkage, parse, report, tabulate
from .plans.extract import extract
from .session import session
from .sources import files, sinks


def _entities(spark, path: str):
    parsed = parse.parse(files.entity_files(spark, path).withColumn("chunk_idx", F.lit(0)))
    return parsed, parse.long(parsed)


def _rows(spark, path: str):
    """A table with row_idx, which a CSV file without one gets in the order of its rows, and with model; all columns of a CSV file are its models' own."""
    df = files.table(spark, path)
    if path.endswith(".csv"):
        df = df.na.fill("").withColumn("row_idx", F.col("row_idx").cast("long") if "row_idx" in df.columns else F.monotonically_increasing_id())
    return df if "model" in df.columns else df.withColumn("model", F.lit("model"))


def missing(spark, args: argparse.Namespace) -> list[str]:
    """Paths that a command reads and that are not there."""
    named = {"extract": ("input",), "tabulate": ("folder",), "evaluate": ("ground_truth", "tables"), "report": ("text_dir", "json_dir"), "link": ("spreadsheet", "database")}
    found = []
    for path in (getattr(args, a) for a in named[args.command]):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            found.append(path)
    return found


def silent(raw: DataFrame) -> list[str]:
    """Models of which no request was answered; a row for each model reaches the driver."""
    answered = raw.groupBy("model").agg(F.max(F.col("status") == "ok").alias("ok"))
    return [r.model for r in answered.filter("NOT ok").orderBy("model").collect()]


def run(args: argparse.Namespace) -> None:
    """One command. Ends with code 1 and a message if an input is missing, or if a model gave no answer; what others gave is written then."""
    spark = session(f"scriptorium {args.command}")
    if lost := missing(spark, args):
        raise SystemExit("not found: " + ", ".join(lost))
    if args.command == "extract":
        docs = files.text_files(spark, args.input).withColumns({"doc_id": F.xxhash64("file_name"), "doc_name": F.col("stem")})
        models = [annotate.RuleAnnotator(m.removeprefix("rules:")) if m.startswith("rules:") else ledger.LedgerAnnotator(annotate.HttpAnnotator(m, args.url), f"{args.output}/_ledger", args.parallel, args.in_flight) for m in args.model.split(",")]
        found = extract(docs.repartition(args.parallel), models, bronze=f"{args.output}/_bronze", whole_document=args.whole_document)
        sinks.write_entities(found, f"{args.output}/entities")
        print(sinks.export_entity_files(sinks.entity_documents(found), f"{args.output}/json"), "files with entities")
        if mute := silent(spark.read.parquet(f"{args.output}/_bronze")):
            raise SystemExit("no answer from: " + ", ".join(mute))
    elif args.command == "tabulate":
        parsed, long = _entities(spark, args.folder)
        names = [r[0] for r in long.select("label").distinct().orderBy("label").collect()]
        sinks.write_table(tabulate.wide(long, names, parsed.filter("parse_status <> 'failed'"), own_labels=True), f"{args.folder}/_tables")
        tabulate.per_document(long).groupBy("model").agg(F.sum("n_entities").alias("n_entities")).show()
    elif args.command == "evaluate":
        truth, predicted = _rows(spark, args.ground_truth), _rows(spark, args.tables)
        names = [c for c in truth.columns if c not in ("row_idx", "Document", "model")]
        aligned = evaluate.align(truth, predicted, names, args.align, blank_is_null=True)
        metrics = evaluate.by_label(aligned)
        for df in (metrics.orderBy("entity_type", "model"), evaluate.macro(metrics), evaluate.micro(metrics)):
            df.show(100, truncate=False)
        if args.show_examples:
            evaluate.examples(aligned).orderBy("label", "model", "n").show(200, truncate=False)
    elif args.command == "report":
        texts = files.text_files(spark, args.text_dir, keep_bad=True)
        parsed = parse.parse(files.report_files(spark, args.json_dir))
        pairs = report.pair(parsed.select("base"), texts.select("stem", "file_name", "text"))
        parts = report.sections(pairs.select("base", "file_name", "text"), parse.long(parsed))
        if args.pages:
            report.pages(parts).write.mode("overwrite").parquet(args.output)
        else:
            sinks.write_pieces(report.pieces(parts, parsed.select("base")), args.output)
    else:
        left = authority.spreadsheet_persons(files.table(spark, args.spreadsheet))
        matches = linkage.find_matches(left, authority.persons(files.authority_items(spark, args.database)), args.threshold, args.max_matches)
        sinks.write_csv(matches, args.output)
        written = spark.read.csv(args.output, header=True, inferSchema=True, escape='"')
        linkage.bands(written).show()
        written.orderBy(F.desc("match_probability")).limit(10).show(truncate=False)


def main(argv: list[str] | None = None) -> None:
    """Parses arguments."""
    p = argparse.ArgumentParser(prog="scriptorium", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("extract")
    for a in ("model", "input", "output"):
        c.add_argument(a)
    c.add_argument("--url", default="http://127.0.0.1:1234/v1/chat/completions")
    c.add_argument("--whole-document", action="store_true", help="no chunks; texts are trimmed to 100,000 characters")
    c.add_argument("--parallel", type=int, default=1, help="tasks that ask at a time")
    c.add_argument("--in-flight", type=int, default=1, help="requests of a task at a time")
    sub.add_parser("tabulate").add_argument("folder")
    c = sub.add_parser("evaluate")
    c.add_argument("--ground-truth", required=True)
    c.add_argument("--tables", required=True)
    c.add_argument("--align", choices=("position", "document"), default="position")
    c.add_argument("--show-examples", action="store_true")
    c = sub.add_parser("report")
    for a in ("text_dir", "json_dir", "output"):
        c.add_argument(a)
    c.add_argument("--pages", action="store_true", help="a page for each document, as Parquet, instead of one HTML file")
    c = sub.add_parser("link")
    for a in ("spreadsheet", "database"):
        c.add_argument(a)
    c.add_argument("--output", default="matches")
    c.add_argument("--threshold", type=float, default=linkage.THRESHOLD)
    c.add_argument("--max-matches", type=int, default=linkage.K)
    run(p.parse_args(argv))


if __name__ == "__main__":
    main()
