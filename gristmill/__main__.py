"""``python -m gristmill run --input FILE --output FOLDER``: screen and train one dataset; the report goes to stdout."""

from __future__ import annotations

import argparse
import json
import sys

from gristmill import config as C


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gristmill")
    run = out.add_subparsers(dest="command", required=True).add_parser("run", help="screen a dataset and train on what is kept")
    run.add_argument("--input", required=True, help=".jsonl, .ndjson or .csv, in any store Spark reads")
    run.add_argument("--output", required=True, help="a folder; a later run over it replays decisions")
    run.add_argument("--trainer", choices=["none", "demo"], default="demo")
    run.add_argument("--quiet", action="store_true", help="no progress and summary on stderr")
    for table in (C.SCREENING, C.TRAINING):
        for name, s in table.items():
            if name not in ("provider", "trainer"):
                run.add_argument(f"--{name.replace('_', '-')}", type=str if s.choices else s.kind, choices=s.choices or None, default=s.default)
    return out


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    tell = (lambda *_: None) if args["quiet"] else lambda *x: print(*x, file=sys.stderr)
    from pyspark.sql import SparkSession

    from gristmill.plans.pipeline import Pipeline, summary
    from gristmill.sources.strict import read_records

    try:
        settings = C.screening_config({k: args[k] for k in C.SCREENING if k in args}), C.training_config({k: args[k] for k in C.TRAINING if k in args and k != "trainer"})
        spark = SparkSession.builder.appName("gristmill").getOrCreate()
        pipeline = Pipeline(spark, args["output"], *settings, progress=lambda v: tell(" ".join(f"{k}={x}" for k, x in v.items())))
        raw = read_records(spark, args["input"])
        if args["trainer"] == "none":
            _, report = pipeline.screen(raw, args["input"])
            print(json.dumps(report, ensure_ascii=False, indent=2))
            return 0 if report["complete"] else 1
        result = pipeline.run(raw, args["input"])
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    tell(summary(result))
    print(json.dumps(result["model_report"], ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
