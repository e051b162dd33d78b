"""Commands on a graph: init, log, query, entities, decisions, stats, serve."""

from __future__ import annotations

import argparse
import sys
from typing import IO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import FOLDER_VARIABLE, Graph
from .functions.names import short_id
from .functions.text import sanitize, shortened, tag_list
from .model import GraphError
from .tools import serve


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("chronoloom", description=__doc__)
    out.add_argument("--folder", default=None, help=f"folder of the graph; ${FOLDER_VARIABLE} otherwise")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("init")
    log = commands.add_parser("log")
    log.add_argument("text")
    log.add_argument("-s", "--source")
    log.add_argument("-t", "--tags", help="parted by commas")
    log.add_argument("--universal", action="store_true", help="ask the model that the graph was given")
    query = commands.add_parser("query")
    query.add_argument("text")
    query.add_argument("-l", "--limit", type=int, default=10)
    query.add_argument("--after")
    query.add_argument("--source")
    for name, limit in (("entities", 50), ("decisions", 20)):
        group = commands.add_parser(name).add_subparsers(dest="action", required=True)
        listed = group.add_parser("list")
        listed.add_argument("-l", "--limit", type=int, default=limit)
        if name == "entities":
            listed.add_argument("-t", "--type")
        else:
            listed.add_argument("--after")
            listed.add_argument("--source")
        group.add_parser("show").add_argument("id")
    commands.add_parser("stats")
    commands.add_parser("serve")
    return out


def run(graph: Graph, args: argparse.Namespace, out: IO[str] = sys.stdout) -> None:
    say = lambda *x: print(*x, file=out)
    spark = graph.spark
    if args.command == "init":
        say(graph.store.folder)
    elif args.command == "log":
        tags = spark.range(1).select(tag_list(F.lit(args.tags))).first()[0] if args.tags else None
        key, counts = (graph.add_answered_episode if args.universal else graph.add_episode)(args.text, args.source, tags)
        say(f"{key[:8]}  {counts.entities} entities, {counts.edges} edges, {counts.invalidated} ended, {counts.unresolved} unresolved")
    elif args.command == "query":
        words = spark.range(1).select(sanitize(F.lit(args.text))).first()[0].split()
        found = graph.search(" OR ".join(f'"{w}"' for w in words), args.limit, args.source, args.after) if words else None
        for r in found.select(short_id(F.col("id")), "score", "source", shortened(F.col("content"), 200)).collect() if found is not None else []:
            say(f"[{r[0]}] ({r[2] or 'unknown'}) score={r[1]:.2f}\n    {r[3]}")
    elif args.command == "entities" and args.action == "list":
        for r in graph.store.entities(args.limit, args.type).select(short_id(F.col("id")), "entity_type", "name").collect():
            say(f"{r[0]:<12} {r[1]:<14} {r[2]}")
    elif args.command == "entities":
        entity, edges = graph.context(args.id)
        row = entity.first()
        say(f"{row['name']} ({row['entity_type']})")
        for e in edges.orderBy("id").collect():
            say(f"  --[{e['relation']}]--> {e['neighbor']}" if e["source_id"] == args.id else f"  <--[{e['relation']}]-- {e['neighbor']}")
    elif args.command == "decisions" and args.action == "list":
        for r in graph.store.episodes(args.limit, 0, args.source, args.after).select(short_id(F.col("id")), F.coalesce("source", F.lit("unknown")), shortened(F.col("content"), 50)).collect():
            say(f"{r[0]:<12} {r[1]:<12} {r[2]}")
    elif args.command == "decisions":
        row = graph.episode(args.id).first()
        say(f"{row['id']} ({row['source'] or 'unknown'}, {row['recorded_at']:%Y-%m-%d %H:%M})\n{row['content']}")
    elif args.command == "stats":
        say(", ".join(f"{n} {name}" for name, n in graph.store.stats().items()), graph.store.readable_size())
        for r in graph.store.sources().collect():
            say(f"  {r['source']}: {r['count']}")
    elif args.command == "serve":
        serve(graph)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.command == "init":
            graph = Graph.init(spark, args.folder or ".chronoloom")
        else:
            graph = Graph.open(spark, args.folder) if args.folder else Graph.from_environment(spark)
        run(graph, args)
    except GraphError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
