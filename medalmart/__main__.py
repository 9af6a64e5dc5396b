"""Command line: ``python -m medalmart [run|bronze|silver|gold|report|check] [--config FILE]``."""

from __future__ import annotations

import argparse
import logging
import sys

from .config import load_config
from .plans import medallion

STAGES = {
    "run": medallion.run_all,
    "bronze": medallion.run_ingestion,
    "silver": medallion.run_transformation,
    "gold": medallion.run_provisioning,
    "report": medallion.run_report,
    "check": medallion.run_checks,
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="medalmart")
    parser.add_argument("stage", nargs="?", default="run", choices=sorted(STAGES))
    parser.add_argument("--config", help="run configuration (YAML)")
    args = parser.parse_args(argv)
    logging.basicConfig(level="INFO", style="{", format="{levelname:<7} {name}: {message}")
    try:
        STAGES[args.stage](load_config(args.config))
    except Exception:
        logging.getLogger(__name__).exception("%s failed", args.stage)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
