"""Commands: ``extract`` documents to JSON lines, ``visualize`` them, ``check`` a schema or a service."""

from __future__ import annotations

import argparse
import json
import sys

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from .config import Options, Schema
from .errors import SpanloomError
from .operators.decisions import HashDecider
from .plans.pipeline import extract
from .session import get_spark
from .sources.readers import read_jsonl, read_text_files
from .sources.service import Client, HttpDecider, Service
from .sources.writers import write_html, write_jsonl


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract")
    e.add_argument("inputs", nargs="+", help="text files, or JSON lines if they end in .jsonl")
    e.add_argument("--schema", required=True)
    e.add_argument("--output", required=True, help="a folder, or - for the standard output")
    e.add_argument("--html")
    e.add_argument("--service", help="base URL of a decision service; without one a digest decides")
    e.add_argument("--model", default="lookup")
    e.add_argument("--overlap", default="none")
    e.add_argument("--on-error", default="raise")
    v = sub.add_parser("visualize")
    v.add_argument("input")
    v.add_argument("output")
    c = sub.add_parser("check")
    c.add_argument("--schema")
    c.add_argument("--service")
    c.add_argument("--model", default="lookup")
    return p


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: some document had an error; 2: nothing could be done."""
    args = _parser().parse_args(argv)
    try:
        if args.command == "check":
            if args.schema:
                s = Schema.load(args.schema)
                print(f"{len(s.entities)} entities, {len(s.sentence_labels)} labels, {len(s.fields)} fields")
            if args.service:
                got = Client(Service(args.service, args.model, retries=0)).ask("The sky is blue.", {"q": {"type": "noul", "instructions": "Is it about the sky?"}})
                print(json.dumps(got))
            return 0
        spark = get_spark()
        if args.command == "visualize":
            write_html(spark.read.json(args.input), args.output)
            return 0
        docs = None
        for path in args.inputs:
            rows = read_jsonl(spark, path) if path.endswith(".jsonl") else read_text_files(spark, path)
            docs = rows if docs is None else docs.unionByName(rows)
        decider = HttpDecider(Service(args.service, args.model)) if args.service else HashDecider()
        result = extract(docs, Schema.load(args.schema), decider, Options(overlap=args.overlap, on_error=args.on_error, model=args.model))
        annotated = result.annotated()
        if args.output == "-":
            for line in annotated.toJSON().toLocalIterator():
                print(line)
        else:
            write_jsonl(annotated, args.output)
        if args.html:
            write_html(annotated, args.html)
        n = annotated.agg(F.count("*").alias("documents"), F.sum(F.size("extractions")).alias("extractions"), F.sum(F.size("errors")).alias("errors")).first()
        print(f"{n.documents} documents, {n.extractions} extractions, {n.errors} errors", file=sys.stderr)
        return 1 if n.errors else 0
    except (SpanloomError, PySparkException, Py4JError, OSError, ValueError) as e:
        print(f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else e!r}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
