"""Command line: ingest, query, chat, docs, chunks, stats, config, reset."""

from __future__ import annotations

import argparse
import sys

from corpusloom import config as settings
from corpusloom.config import user_file
from corpusloom.functions import text as X
from corpusloom.functions.paths import clean_path
from corpusloom.operators import catalog
from corpusloom.operators.store import Index


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom", description="Index documents and ask questions about them.")
    top.add_argument("--config", help="settings file")
    verbs = top.add_subparsers(dest="verb", required=True)
    verbs.add_parser("ingest", help="index a file or folder").add_argument("path")
    verbs.add_parser("query", help="answer a question").add_argument("question")
    verbs.add_parser("chat", help="questions and /commands, one a line")
    verbs.add_parser("docs", help="list documents").add_argument("pattern", nargs="?")
    chunks = verbs.add_parser("chunks", help="list a document's chunks")
    chunks.add_argument("document", help="id, or part of the path")
    chunks.add_argument("limit", nargs="?", type=int, default=20, help="0: all")
    verbs.add_parser("stats", help="count documents and chunks")
    verbs.add_parser("config", help="show the settings")
    verbs.add_parser("reset", help="drop the whole index").add_argument("--force", action="store_true")
    return top


def _chat(spark, config, lines) -> None:
    """Lines with a slash are the verbs of this program; any other line is a question."""
    from corpusloom.operators.complete import COMMANDS, History

    debug = False
    history = History(str(user_file().with_name("history")))
    for line in map(str.strip, lines):
        history.add(line)
        word, _, rest = line.partition(" ")
        if word in ("/exit", "/quit", "/q"):
            return
        if word in ("/help", "/?"):
            print(*COMMANDS, sep="\n")
        elif word in ("/reload", "/setup"):
            config = settings.load()
            if word == "/setup":
                print(f"settings are read from {user_file()}")
                settings.show(config)
        elif word == "/clear":
            print("\033[2J\033[H", end="")
        elif word == "/debug":
            debug = not debug
            spark.sparkContext.setLogLevel("INFO" if debug else "WARN")
            print(f"debug {'on' if debug else 'off'}")
        elif word in ("/docs", "/chunks", "/ingest", "/stats", "/config", "/reset"):
            try:
                args = _parser().parse_args([word[1:], *([clean_path(rest)] if rest and word != "/reset" else rest.split())])
            except SystemExit:
                continue
            try:
                _run(spark, config, args)
            except (OSError, ValueError) as e:
                print(e, file=sys.stderr)
        elif line.startswith("/"):
            print(f"unknown command {word}", file=sys.stderr)
        elif line:
            _run(spark, config, argparse.Namespace(verb="query", question=line))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    config = settings.load(args.config)
    if args.verb == "config":
        settings.show(config)
        return 0
    from corpusloom.session import local_session

    spark = local_session("*")
    if args.verb == "chat":
        _chat(spark, config, sys.stdin)
        return 0
    return _run(spark, config, args)


def _run(spark, config, args) -> int:
    from corpusloom.plans.ask import ask, cited, hits_for
    from corpusloom.plans.ingest import ingest

    if args.verb == "config":
        settings.show(config)
        return 0
    index = Index(spark, config.index_path, config.embed_dimension)
    if args.verb == "ingest":
        done = ingest(spark, args.path, config)
        print(f"{done.docs} documents, {done.chunks} chunks stored; {done.skipped} skipped, {done.failed} failed; {done.seconds:.2f} s")
    elif args.verb == "query":
        answer = ask(spark, [args.question], config).first()
        print(answer["text"] if not answer["is_refusal"] else f"{answer['text']}\n({answer['reason']})")
        for r in cited(hits_for(spark, [args.question], config), config.similarity_threshold).orderBy("ref").collect():
            print(f"  [{r['ref']}] {r['similarity']} {r['path']} #{r['chunk_idx']}\n      {r['snippet']}")
    elif args.verb == "reset":
        index.reset(force=args.force)
    else:
        index.open()
        documents, chunks = index.documents(), index.chunks()
        if args.verb == "stats":
            print(*(f"{k}: {v}" for k, v in catalog.stats(documents, chunks).first().asDict().items()), sep="\n")
        elif args.verb == "docs":
            for r in catalog.list_documents(documents, chunks, args.pattern).toLocalIterator():
                print(f"{r['id']:6} {r['chunk_count']:6} {r['content_hash'] or '-':16} {r['path']}")
        else:
            wanted = catalog.resolve(documents, args.document)
            if wanted is None:
                print("no such document", file=sys.stderr)
                return 1
            from pyspark.sql import functions as F

            for r in catalog.document_chunks(index.chunks(wanted), wanted, args.limit).withColumn("content", X.snippet(F.col("content"))).toLocalIterator():
                print(f"#{r['chunk_idx']:<5} {r['word_count']:4} words  {r['content']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
