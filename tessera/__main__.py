"""python -m tessera COMMAND --config FILE: ingest, features, labels, train, validate, recommend, backtest or run-all."""

from __future__ import annotations

import argparse
import logging
import os

from tessera.config import load_config
from tessera.plans.project import Project
from tessera.session import build_session
from tessera.sources.landing import LandingConnector

COMMANDS = ["ingest", "features", "labels", "train", "validate", "recommend", "backtest"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("command", choices=[*COMMANDS, "run-all"])
    p.add_argument("--config", default="configs/base.toml")
    p.add_argument("--landing", help="folder of landed vendor files, for ingest")
    p.add_argument("--start-date", help="for recommend alone")
    p.add_argument("--end-date", help="for recommend alone")
    p.add_argument("--latest-only", action="store_true", help="for recommend alone")
    return p


def start_logging(path: str) -> None:
    """Log to the console and, where the folder is local, to a file."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if "://" not in path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        handlers.append(logging.FileHandler(path))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s", handlers=handlers, force=True)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    cfg = load_config(args.config)
    start_logging(cfg.path("logs", "tessera.log"))
    spark = build_session()
    project = Project(spark, cfg, LandingConnector(spark, args.landing) if args.landing else None)
    steps = ["ingest", "features", "labels", "validate", "train", "recommend", "backtest"] if args.command == "run-all" else [args.command]
    for step in steps:
        logging.info("running %s", step)
        if step == "ingest":
            project.ingest(project.connector.listed())
        elif step == "recommend":
            project.recommend(args.start_date, args.end_date, args.latest_only)
        else:
            getattr(project, step)()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
