"""Command line: ``python -m eventloom datasets.yml sequence.yml``."""

from __future__ import annotations

import argparse
import inspect
import sys

from pyspark.sql import SparkSession

from eventloom.plans.bookkeeping import write_booking
from eventloom.plans.runner import run
from eventloom.plans.sequence import KNOWN, build, read_sequence
from eventloom.sources.datasets import as_events, get_source, load_yaml, read_datasets

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("eventloom", description="Runs a sequence of stages over datasets of events.")
    p.add_argument("dataset_cfg", nargs="?", help="book of datasets (YAML)")
    p.add_argument("sequence_cfg", nargs="?", help="sequence of stages (YAML)")
    p.add_argument("--outdir", default="output")
    p.add_argument("--mode", "--master", dest="master", help="Spark master, for instance local[8], yarn, spark://host:7077")
    p.add_argument("--ncores", type=int, help="threads of a local master")
    p.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE", help="Spark setting")
    p.add_argument("--execution-cfg", help="YAML of Spark settings")
    p.add_argument("--nblocks-per-dataset", type=int, default=-1)
    p.add_argument("--nblocks-per-sample", type=int, default=-1)
    p.add_argument("--shared-events", metavar="FOLDER", help="reads the source once: a copy of what the tables need goes here for the run (spark.checkpoint.dir if that is set)")
    p.add_argument("--blocksize", type=int, default=1_000_000)
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--profile", action="store_true", help="prints each table's plan")
    p.add_argument("--help-stages", nargs="?", const="", metavar="NAME")
    p.add_argument("--help-stages-full", metavar="NAME")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--bookkeeping", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--data-import-plugin", "--source", dest="source", help="source of all datasets")
    p.add_argument("--data-import-plugin-cfg", "--source-cfg", dest="source_cfg", help="YAML of the source's options")
    return p


def help_stages(name: str, full: bool) -> str:
    out = []
    for key, stage in KNOWN.items():
        if name in ("", key):
            text = inspect.getdoc(stage) or ""
            out.append(f"{key}{inspect.signature(stage)}\n  {text if full else text.splitlines()[0]}")
    return "\n".join(out)


def session(args: argparse.Namespace) -> SparkSession:
    settings = dict(x.split("=", 1) for x in args.conf)
    if args.execution_cfg:
        settings = {str(k): str(v) for k, v in load_yaml(args.execution_cfg).items()} | settings
    builder = SparkSession.builder.appName("eventloom").config(map={"spark.sql.adaptive.enabled": "true"} | settings)
    master = args.master or (f"local[{args.ncores}]" if args.ncores else None)
    return (builder.master(master) if master else builder).getOrCreate()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.help_stages is not None or args.help_stages_full:
        print(help_stages(args.help_stages_full or args.help_stages, bool(args.help_stages_full)))
        return 0
    if not args.dataset_cfg or not args.sequence_cfg:
        parser().error("dataset_cfg and sequence_cfg are needed")
    stages = read_sequence(args.sequence_cfg, args.outdir)
    datasets = read_datasets(args.dataset_cfg)
    # Both limit what is read of one dataset; the smaller one holds, and numbers below 1 are none.
    blocks = min((n for n in (args.nblocks_per_dataset, args.nblocks_per_sample) if n >= 1), default=None)
    spark = session(args)
    if args.bookkeeping:
        write_booking(args.outdir, args.sequence_cfg, datasets, vars(args))
    source = get_source(args.source, args.source_cfg) if args.source else None
    ctx = as_events(spark, datasets, source, None if blocks is None else blocks * args.blocksize)
    results = run(stages, ctx, write=True, shared=args.shared_events or spark.conf.get("spark.checkpoint.dir", None))
    for name, table in results.items():
        if args.profile:
            table.explain("formatted")
        if not args.quiet:
            print(name, *table.columns, sep="\t")
    return 0


__all__ = ["build", "main"]

if __name__ == "__main__":
    sys.exit(main())
