"""Command line: ``python -m strandloom.cli train ...`` and ``... predict ...``."""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import SparkSession

#: Levels of ``--log``.
LEVELS = (logging.ERROR, logging.WARNING, logging.INFO, logging.DEBUG)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("train", help="train on a table of texts or on labelled sequence files")
    t.add_argument("--table")
    t.add_argument("--data-column")
    t.add_argument("--label-file")
    t.add_argument("--label-columns", nargs="+")
    t.add_argument("--data-dir")
    t.add_argument("--folds-file")
    for name, default in (("k", 10), ("ext", 2), ("target", 70), ("features", 10_000), ("folds", 0), ("num-rounds", 1500), ("partition-size-target", 5000)):
        t.add_argument(f"--{name}", type=int, default=default)
    for name, default in (("lr", 0.03), ("ea-min", None), ("ea-max", None)):
        t.add_argument(f"--{name}", type=float, default=default)
    t.add_argument("--backend", choices=("tasks", "levels"))
    t.add_argument("--count-strategy", choices=("auto", "pattern", "join", "arrow"))
    for name in ("id-column", "alphabet", "complement", "metric", "export-file", "save-file", "import-file"):
        t.add_argument(f"--{name}")
    for name in ("case-sensitive", "keep-unknown", "uint16", "sparse", "binary-features", "binary", "standardise-labels", "baseline"):
        t.add_argument(f"--{name}", action="store_true")
    q = sub.add_parser("predict", help="score sequence files, a folder of them, or a table")
    q.add_argument("--model", required=True)
    q.add_argument("--files", nargs="+")
    q.add_argument("--directory")
    q.add_argument("--table")
    q.add_argument("--data-column")
    q.add_argument("--out", required=True)
    for x in (t, q):
        x.add_argument("--log", type=int, choices=range(4), default=2)
        x.add_argument("--log-file")
    return p


def main(argv: list[str] | None = None) -> int:
    a = vars(parser().parse_args(argv))
    logging.basicConfig(level=LEVELS[a.pop("log")], handlers=[logging.StreamHandler(), *([logging.FileHandler(f)] if (f := a.pop("log_file")) else [])])
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    from strandloom.plans.results import write_csv
    from strandloom.plans.training import BaselinePipeline, InferencePipeline, TrainingPipeline

    if a.pop("command") == "train":
        make = BaselinePipeline if a.pop("baseline") else TrainingPipeline
        given = {k: v for k, v in a.items() if v is not None}
        result = make(spark, **given).run()
        print(f"{result.metric.name}: {result.score:.4f}")
        return 0
    pipe = InferencePipeline(spark, a["model"])
    if a["table"]:
        if not a["data_column"]:
            raise SystemExit("--data-column is needed with --table")
        got = pipe.score_table(spark.read.csv(a["table"], header=True), a["data_column"])
    elif a["files"] or a["directory"]:
        got = pipe.score_files(a["files"] or a["directory"])
    else:
        raise SystemExit("nothing to score")
    out = Path(a["out"] if a["out"].endswith(".csv") else a["out"] + ".csv")
    write_csv(got, str(out))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
