"""Command line: ``python -m chunkloom chunk|embed|context|ask``.

chunk   --root DIR [--output PATH] [--white-list java,xml] [--no-standard-vetoes] [--prefix org.example]
embed   --store PATH [--input PATH] [--embedder module:function] [--batch 50] [--reset]
context --store PATH --question TEXT [--embedder module:function]
ask     --store PATH --question TEXT [--embedder module:function] [--chat module:function]

Without output, chunks go to standard output; without input, or with "-", chunk lines come from standard input.
"""

from __future__ import annotations

import argparse
import importlib
import sys


def _named(name: str | None, default):
    if not name:
        return default
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def parser() -> argparse.ArgumentParser:
    own = argparse.ArgumentParser(prog="chunkloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = own.add_subparsers(dest="command", required=True)
    chunk = commands.add_parser("chunk")
    chunk.add_argument("-r", "--root", default=".")
    chunk.add_argument("-o", "--output")
    chunk.add_argument("-wl", "--white-list")
    chunk.add_argument("--no-standard-vetoes", action="store_true")
    chunk.add_argument("--prefix", default="")
    chunk.add_argument("--chunk-size", type=int)
    chunk.add_argument("--chunk-overlap", type=int)
    embed = commands.add_parser("embed")
    embed.add_argument("-i", "--input")
    embed.add_argument("--batch", type=int, default=50)
    embed.add_argument("--reset", action="store_true")
    for name in ("context", "ask"):
        commands.add_parser(name).add_argument("-q", "--question", required=True)
    for command in (embed, commands.choices["context"], commands.choices["ask"]):
        command.add_argument("--store", required=True)
        command.add_argument("--embedder")
    commands.choices["ask"].add_argument("--chat")
    return own


def main(arguments: list[str] | None = None) -> None:
    given = parser().parse_args(arguments)
    from pyspark.sql import SparkSession

    from .operators import prompt, retrieval
    from .operators.store import ChunkStore
    from .registry import chunk_folder, java_registry
    from .sources import files, jsonl

    spark = SparkSession.builder.appName("chunkloom").getOrCreate()
    if given.command == "chunk":
        own = java_registry(given.prefix, given.chunk_size, given.chunk_overlap)
        chunks = chunk_folder(spark, given.root, own, given.white_list, standard=not given.no_standard_vetoes)
        if given.output:
            jsonl.write(chunks, given.output)
        else:
            for row in jsonl.to_lines(chunks).toLocalIterator():
                sys.stdout.write(row["value"] + "\n")
        return
    embedder, store = _named(given.embedder, retrieval.hashing_embedder()), ChunkStore(spark, given.store)
    if given.command == "embed":
        if given.reset:
            store.reset()
        store.add(jsonl.decode(files.text_lines(spark, given.input)), embedder, given.batch)
    elif given.command == "context":
        sys.stdout.write(prompt.enrich(spark, store.read(), given.question, embedder) + "\n")
    else:
        sys.stdout.write(prompt.ask(spark, store.read(), given.question, embedder, _named(given.chat, prompt.silent_chat)) + "\n")


if __name__ == "__main__":
    main()
