"""Train and save the report models: spark-submit jobs/train.py --output FOLDER [--raw FOLDER | --demo-rows N]."""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from caseloom.config import QUARTERS, FusionSettings, TreeSettings  # noqa: E402
from caseloom.plans.training import train  # noqa: E402
from caseloom.session import build_session  # noqa: E402
from caseloom.sources.raw import load_quarters  # noqa: E402
from caseloom.sources.synthetic import demo_cases  # noqa: E402


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--output", required=True, help="folder for the fitted models")
    parser.add_argument("--raw", help="folder with one subfolder per quarter; synthetic cases if not given")
    parser.add_argument("--quarters", nargs="*", default=QUARTERS)
    parser.add_argument("--sample", type=int, help="train on exactly this many cases")
    parser.add_argument("--demo-rows", type=int, default=500)
    parser.add_argument("--trees", type=int, default=TreeSettings.trees)
    parser.add_argument("--iterations", type=int, nargs="*", default=list(FusionSettings().iterations))
    parser.add_argument("--master", help="for local runs, e.g. local[8]")
    options = parser.parse_args()
    spark = build_session("train report models", options.master)
    if options.raw:
        cases = load_quarters(spark, options.raw, options.quarters, options.sample)
    else:
        cases = demo_cases(spark, options.demo_rows)
    models, candidates = train(cases, TreeSettings(trees=options.trees), FusionSettings(iterations=tuple(options.iterations)))
    models.save(options.output)
    candidates.show()
    spark.stop()


if __name__ == "__main__":
    main()
