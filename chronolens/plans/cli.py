"""Command line over captured files and a store; every command is a thin call of a plan."""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import breakdowns, calendar
from ..operators.guards import GuardError
from ..sources import readers, schemas
from ..sources.commits import CommitLog
from ..sources.store import Store
from . import arm_ledger, arm_run, catalog, pipeline, report
from .backfill import WindowsStillOpenError, backfill, resolve_domains
from .settings import SettingsError, load_settings

VERSION = "0.1.0"


def session(name: str = "chronolens") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def write_report(spark: SparkSession, tables: str, out: str) -> None:
    """Walk-forward report and figure over the tables; both are rendered before either file is written."""
    run = {n: catalog.QUERIES[n] for n in ("evaluation", "calibration_bins", "coefficients", "daily_ic", "ic_by_size", "group_accounting", "ic_by_type", "type_accounting")}
    rows = {n: [r.asDict() for r in q(spark, tables).collect()] for n, q in run.items()}
    last = max(r["block"] for r in rows["coefficients"])
    weights = {r["feature"]: r["weight"] for r in rows["coefficients"] if r["block"] == last}
    sections = [
        report.group_section("By size", rows["ic_by_size"], rows["group_accounting"][0], "bucket"),
        report.group_section("By insider type", rows["ic_by_type"], rows["type_accounting"][0], "kind"),
    ]
    text = report.baseline_report(rows["evaluation"][0], rows["calibration_bins"], weights, sections)
    figure = report.baseline_figure([(r["day"], r["ic"]) for r in sorted(rows["daily_ic"], key=lambda r: r["day"]) if r["ic"] is not None], rows["calibration_bins"])
    for path, content in ((f"{out}.md", text), (f"{out}.svg", figure)):
        with open(path, "w", encoding="utf-8") as file:
            file.write(content)


def ingest(args: argparse.Namespace) -> None:
    spark = session()
    store = Store(spark, args.store)
    print(pipeline.ingest_day(store, readers.form4_filings(spark, args.filings.format(day=args.day)), args.day))
    if args.reports:
        found = readers.current_reports(spark, args.reports.format(day=args.day)), readers.cover_facts(spark, args.facts.format(day=args.day))
        print(pipeline.ingest_reports(store, *found, args.day))


def resolve(args: argparse.Namespace) -> None:
    spark = session()
    store = Store(spark, args.store)
    domains = [d for d in schemas.HORIZONS if store.exists(d, args.day)]
    bars, issuers = spark.read.parquet(args.bars), spark.read.parquet(args.issuers)
    resolve_domains(args.day, domains, lambda day, domain: print(domain, pipeline.resolve_day(store, domain, day, bars, issuers, dt.date.fromisoformat(args.today))))


def build_packets(args: argparse.Namespace) -> None:
    spark = session()
    store = Store(spark, args.store)
    built = pipeline.build_packets(store, store.read("insider", args.day, schemas.INSIDER_EVENT), spark.read.parquet(args.bars), args.day)
    print({"packets": built.count(), "excluded": store.read("insider", args.day, schemas.EXCLUSION, "packet-exclusions").count()})


def run_backfill(args: argparse.Namespace) -> None:
    """Every nth trading day of the range that is not complete yet."""
    spark = session()
    days = [r["day"].isoformat() for r in calendar.sampled_days(calendar.trading_calendar(spark, args.first, args.last), args.every).orderBy("day").collect()]
    store = Store(spark, args.store)
    done = {r["day"].isoformat() for r in store.complete(["insider"], packets=args.packets).filter("complete").collect()}

    def one(day: str) -> None:
        own = argparse.Namespace(**{**vars(args), "day": day})
        if not store.exists("insider", day):
            ingest(own)
        resolve(own)
        if args.packets:
            build_packets(own)

    print(backfill(days, done, one))


def agent_compare(args: argparse.Namespace) -> None:
    spark = session()
    days, accounts = breakdowns.compare_arms(spark.read.parquet(args.base), spark.read.parquet(args.other), args.first, args.last)
    summary = days.agg(F.count(F.lit(1)).alias("days"), *[F.round(F.avg(c), 6).alias(c) for c in ("base_ic", "other_ic", "difference")])
    print({**accounts.first().asDict(), **summary.first().asDict()})


def _forecast_days(args: argparse.Namespace, first: str, last: str) -> None:
    """Run the arm over the groups of a range of built days; answers come from captured replies."""
    spark = session()
    if args.store:
        built = Store(spark, args.store).days("insider", "packets")
        calendar.require_built(calendar.trading_calendar(spark, first, last), built)
    limits = arm_run.Limits(args.max_calls, args.max_weekly_share)
    run = arm_run.ArmRun(arm_ledger.ArmLedger(spark, args.ledger), arm_run.Replies(spark.read.parquet(args.replies)), limits, args.run_id, args.prompt_version, args.model)
    groups = spark.read.parquet(args.groups).filter(F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    report = run.over(groups, dt.datetime.combine(dt.date.today(), dt.time()))
    print(vars(report))
    if report.halted:
        raise GuardError(f"halted: {report.halted}")


def agent_pilot(args: argparse.Namespace) -> None:
    arm_run.require_pilot_day(dt.date.fromisoformat(args.day), dt.date.fromisoformat(args.scored_from))
    _forecast_days(args, args.day, args.day)


def check(args: argparse.Namespace) -> None:
    found = load_settings(os.environ)
    store = Store(session(), found.store_root)
    print({"store": found.store_root, "days": store.manifest().select("day").distinct().count(), "spend ceiling": str(found.daily_spend_ceiling)})


def ledger_up(args: argparse.Namespace) -> None:
    """Raise the ledger to the current declarations, or to an earlier step; published rows stay."""
    log = CommitLog(session(), args.ledger)
    print({"ledger": args.ledger, "declared": arm_ledger.upgrade(log, args.to), "files": log.verify()})


ARM = [
    ("groups", {}), ("--ledger", {"required": True}), ("--replies", {"required": True}), ("--run-id", {"required": True}), ("--prompt-version", {"required": True}), ("--model", {"required": True}),
    ("--scored-from", {"required": True}), ("--store", {}), ("--max-weekly-share", {"type": float, "default": 0.8}),
]
STORE, DAY, BARS = ("--store", {"required": True}), ("day", {}), ("--bars", {"required": True})
SOURCES = [("--filings", {"required": True, "help": "path of captured filings; {day} stands for the day"}), ("--reports", {}), ("--facts", {})]
LABELS = [BARS, ("--issuers", {"required": True}), ("--today", {"required": True})]
COMMANDS = {
    "ingest": (ingest, [DAY, STORE, *SOURCES]),
    "resolve": (resolve, [DAY, STORE, *LABELS]),
    "build-packets": (build_packets, [DAY, STORE, BARS]),
    "backfill": (run_backfill, [("first", {}), ("last", {}), STORE, *SOURCES, *LABELS, ("--every", {"type": int, "default": 1}), ("--packets", {"action": "store_true"})]),
    "agent-pilot": (agent_pilot, [("day", {}), *ARM, ("--max-calls", {"type": int, "default": 400})]),
    "agent-run": (lambda args: _forecast_days(args, args.scored_from, args.end), [*ARM, ("--max-calls", {"type": int, "required": True}), ("--end", {"required": True})]),
    "agent-compare": (agent_compare, [("base", {}), ("other", {}), ("first", {}), ("last", {})]),
    "check": (check, []),
    "ledger-up": (ledger_up, [("ledger", {}), ("--to", {"type": int, "default": len(arm_ledger.STEPS)})]),
    "report": (lambda args: write_report(session(), args.tables, args.out), [("tables", {}), ("out", {})]),
    "run": (lambda args: catalog.QUERIES[args.query](session(), args.tables).show(50, truncate=False), [("query", {}), ("tables", {})]),
    "queries": (lambda args: print("\n".join(sorted(catalog.QUERIES))), []),
    "version": (lambda args: print(VERSION), []),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chronolens")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (action, arguments) in COMMANDS.items():
        one = commands.add_parser(name)
        one.set_defaults(action=action)
        for flag, options in arguments:
            one.add_argument(flag, **options)
    args = parser.parse_args(argv)
    try:
        args.action(args)
    except (SettingsError, GuardError, WindowsStillOpenError, FileNotFoundError, calendar.MissingDaysError, arm_run.PilotDayError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
