"""The command line: python -m weftlog evaluate | translate | bench | bench-root | bench-summary | plan-profile."""

from __future__ import annotations

import argparse
import json
import statistics
import sys
import time
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import Log
from .operators.translate import Mappings, to_cypher, to_sql
from .plans.engine import EvalResult, evaluate
from .sources.files import read_log
from .sources.tables import star_log


def session() -> SparkSession:
    spark = SparkSession.builder.appName("weftlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def log_of(spark: SparkSession, path: str) -> Log:
    """A log file by its ending, or a folder of the star schema's tables."""
    return star_log(spark, path) if Path(path).is_dir() and not path.endswith((".json", ".xml")) else read_log(spark, path)


def trees(folder: str, only: Iterable[str] = ()) -> dict[str, str]:
    """Name and JSON of the trees in a folder: NAME.json, or NAME/ with one JSON file."""
    found = {p.stem if p.parent == Path(folder) else p.parent.name: p for pattern in ("*/*.json", "*.json") for p in sorted(Path(folder).glob(pattern))}
    wanted = list(only) or sorted(found)
    missing = [n for n in wanted if n not in found]
    if missing:
        raise SystemExit(f"no such queries: {', '.join(missing)}")
    return {n: found[n].read_text() for n in wanted}


def dump(result: EvalResult, folder: str) -> str:
    """The bindings of every node as JSON lines, in a folder that the time names."""
    to = f"{folder.rstrip('/')}/evaluation-{time.strftime('%Y%m%dT%H%M%S')}"
    for i in sorted(result.evaluation.results):
        result.node(i).write.json(f"{to}/node={i}")
    return to


def consume(frames: Iterable[DataFrame]) -> tuple[int, int]:
    """Rows and violated rows of all frames, each computed whole."""
    rows = violated = 0
    for df in frames:
        r = df.agg(F.count("*").alias("n"), F.count("violation").alias("v"), F.bit_xor(F.xxhash64(*df.columns))).first()
        rows, violated = rows + r["n"], violated + r["v"]
    return rows, violated


def bench(log: Log, queries: dict[str, str], label: str, runs: int, warmup: int, root_only: bool) -> Iterable[dict]:
    """A record for each timed run. Roots alone need no more of their children than what judges them."""
    for name, text in queries.items():
        for k in range(-warmup, runs):
            began = time.perf_counter()
            result = evaluate(text, log)
            nodes = result.tree.roots if root_only else sorted(result.evaluation.results)
            rows, violated = consume(result.node(i) for i in nodes)
            if k >= 0:
                yield {"label": label, "query": name, "run": k, "ms": round((time.perf_counter() - began) * 1000, 3), "root_only": root_only, "bindings": rows, "violated": violated}


def stats(times: list[float]) -> dict[str, float]:
    return {"mean": statistics.fmean(times), "median": statistics.median(times), "min": min(times), "max": max(times), "stddev": statistics.pstdev(times)}


def bench_summary(records: list[dict]) -> list[dict]:
    """Statistics for each query and label, and the change of the median from the first label to the last, in percent."""
    times: dict[str, dict[str, list[float]]] = {}
    for r in records:
        times.setdefault(r["query"], {}).setdefault(r["label"], []).append(r["ms"])
    out = []
    for query, by_label in times.items():
        shown = {label: {k: round(v, 3) for k, v in stats(own).items()} for label, own in by_label.items()}
        medians = [x["median"] for x in shown.values()]
        out.append({"query": query, "labels": shown, "change_percent": round((medians[-1] / medians[0] - 1) * 100, 2) if len(medians) > 1 and medians[0] else None})
    return out


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="weftlog", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        sub = commands.add_parser(name)
        for flags, more in options:
            sub.add_argument(*flags, **more)

    log, folder = (("-o", "--log", "--ocel"), {"required": True}), (("-q", "--queries-dir"), {"required": True})
    tree, only = (("-t", "-b", "--tree", "--bbox-tree"), {"required": True}), (("--only",), {"nargs": "*", "default": []})
    results = (("-r", "--results"), {"default": "bench-results.jsonl"})
    timing = (("-n", "--runs"), {"type": int, "default": 10}), (("-w", "--warmup"), {"type": int, "default": 1}), (("-l", "--label"), {"required": True})
    command("evaluate", log, tree, (("--out",), {"default": "."}))
    command("translate", tree, (("-m", "--mappings"), {}), (("-T", "--target"), {"choices": ("sqlite", "duckdb", "cypher"), "default": "sqlite"}), (("--output",), {}))
    command("bench", log, folder, only, results, *timing)
    command("bench-root", log, folder, only, results, *timing)
    command("bench-summary", results)
    command("plan-profile", log, folder, only)
    said = parser.parse_args(argv)

    if said.command == "evaluate":
        result = evaluate(Path(said.tree).read_text(), log_of(session(), said.log))
        print(json.dumps({"written": dump(result, said.out), "nodes": [r.asDict() for r in result.summary().orderBy("node").toLocalIterator()]}))
    elif said.command == "translate":
        text = Path(said.tree).read_text()
        tables = Mappings(**(json.loads(Path(said.mappings).read_text()) if said.mappings else {}))
        made = to_cypher(text) if said.target == "cypher" else to_sql(text, said.target, tables)
        if said.output:
            Path(said.output).write_text(made)
        else:
            print(made)
    elif said.command in ("bench", "bench-root"):
        own = log_of(session(), said.log).persist()
        with open(said.results, "a") as out:
            for r in bench(own, trees(said.queries_dir, said.only), said.label, said.runs, said.warmup, said.command == "bench-root"):
                out.write(json.dumps(r) + "\n")
        own.unpersist()
    elif said.command == "bench-summary":
        for r in bench_summary([json.loads(line) for line in Path(said.results).read_text().splitlines() if line.strip()]):
            print(json.dumps(r))
    else:
        own = log_of(session(), said.log)
        for name, text in trees(said.queries_dir, said.only).items():
            for r in evaluate(text, own).profile().orderBy("node", "step").toLocalIterator():
                print(json.dumps({"query": name, **r.asDict()}))


if __name__ == "__main__":
    main(sys.argv[1:])
