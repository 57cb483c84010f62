"""Command line: ``python -m tessera FOLDER COMMAND [ARGUMENT] [--limit N]`` over a store."""

from __future__ import annotations

import argparse

COMMANDS = ("stats", "trials", "trial-stats", "relevant-trials", "search", "graph-stats", "graph-search", "neighbours", "candidates", "export")


def main(argv: list[str] | None = None) -> str:
    from pyspark.sql import SparkSession

    from tessera.operators.embedding import hashing_encoder
    from tessera.service import Engine
    from tessera.sources.sinks import markdown

    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("folder")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("argument", nargs="?")
    parser.add_argument("--limit", type=int, default=10)
    parser.add_argument("--hops", type=int, default=1)
    a = parser.parse_args(argv)
    engine = Engine(SparkSession.builder.getOrCreate(), a.folder)
    frames = {
        "stats": lambda: engine.stats(), "trials": lambda: engine.trials(a.limit, term=a.argument), "trial-stats": lambda: engine.trial_stats(), "relevant-trials": lambda: engine.relevant_trials(a.argument or "", a.limit),
        "search": lambda: engine.search(a.argument or "", hashing_encoder(), a.limit), "graph-stats": lambda: engine.graph_stats(), "graph-search": lambda: engine.graph_search(a.argument or "", a.limit),
        "neighbours": lambda: engine.neighbours(a.argument or "", a.hops, a.limit), "candidates": lambda: engine.candidates(a.limit), "export": lambda: engine.export(a.limit),
    }
    return markdown(frames[a.command](), a.limit)


if __name__ == "__main__":
    print(main())
