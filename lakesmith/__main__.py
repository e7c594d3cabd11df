"""python -m lakesmith --root STORE --raw RAW [--date DAY] [--only events|customers|both] [--rebuild] [--reference INSTANT]"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime, timezone

from lakesmith.plans.pipeline import SOURCES, Pipeline, QualityGateError, execution_date
from lakesmith.session import build_session
from lakesmith.store import Store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lakesmith", description=__doc__)
    parser.add_argument("--root", required=True, help="folder of the tables")
    parser.add_argument("--raw", required=True, help="folder of the raw zone")
    parser.add_argument("--date", help="the ingestion date, else $EXECUTION_DATE, else today in UTC")
    parser.add_argument("--only", choices=(*SOURCES, "both"), default="both")
    parser.add_argument("--rebuild", action="store_true", help="also remove gold keys that silver no longer gives")
    parser.add_argument("--reference", help="the instant that freshness is held against, else now")
    args = parser.parse_args(argv)
    spark = build_session()
    pipeline = Pipeline(spark, Store(spark, args.root), args.raw)
    if args.reference:
        at = datetime.fromisoformat(args.reference)
        pipeline.reference = lambda: at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    only = SOURCES if args.only == "both" else (args.only,)
    try:
        pipeline.run(execution_date(args.date, os.environ.get("EXECUTION_DATE")), only=only, rebuild=args.rebuild)
    except QualityGateError:
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
