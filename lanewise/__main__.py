"""Command line: route, log-stats, explain, backtest, export, injection, demo."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import generators, report
from lanewise.operators import analytics, distill
from lanewise.plans.policy import Policy
from lanewise.plans.route import decision_records, route, trace_oracle
from lanewise.sources import logs


def _policy(args) -> Policy:
    if not args.policy:
        return Policy()
    with open(args.policy) as f:
        return Policy.from_yaml(f.read())


def cmd_route(spark, args) -> str:
    if args.text is not None:
        requests = spark.createDataFrame([("cli", args.text)], "request_id string, text string")
    else:
        requests = spark.read.json(args.input)
    decisions = route(requests, _policy(args))
    if args.output:
        logs.write_log(decision_records(decisions), args.output)
    return report.table(decisions.select("request_id", "tier", "model", "rule_id", "complexity", "sensitivity"), most=20)


def cmd_demo(spark, args) -> str:
    prompts = ("hello there", "Explain how HIPAA works", "my ssn is 123-45-6789", "prove the consensus proof and design the architecture", "translate this to French")
    rows = spark.createDataFrame([(str(i), p) for i, p in enumerate(prompts)], "request_id string, text string")
    return report.table(route(rows, _policy(args)).select("text", "tier", "rule_id", "complexity", "sensitivity"))


def cmd_log_stats(spark, args) -> str:
    log = logs.source(spark, args.input)
    counts = analytics.dimension_counts(log, ["tier", "backend", "rule_id", "complexity", "sensitivity"])
    return report.table(counts.orderBy("dim", F.desc("n"), "value"), "counts") + report.table(analytics.nearest_rank_of(log, "latency_ms", (0.5, 0.95, 0.99)), "latency")


def cmd_explain(spark, args) -> str:
    log = logs.source(spark, args.input)
    found = log.where(F.col("request_id") == args.id).orderBy(F.desc("timestamp")).limit(1)
    if found.isEmpty():
        found = log.select("request_id", "timestamp").orderBy(F.desc("timestamp")).limit(10)
    return report.table(found)


def cmd_backtest(spark, args) -> str:
    trace: DataFrame = spark.read.json(args.input).withColumnRenamed("id", "request_id") if args.input else generators.demo_trace(spark)
    rows = analytics.backtest_rows(route(trace, _policy(args), scorer=trace_oracle), "text")
    return report.table(analytics.cost_rollup(rows).orderBy(F.desc("n"), "category"), "cost") + report.table(rows.groupBy("tier").count(), "tiers")


def cmd_export(spark, args) -> str:
    rows = distill.training_rows(logs.source(spark, args.input), args.holdout)
    logs.write_log(rows, args.output)
    return report.table(rows.groupBy("split", "complexity").count())


def cmd_injection(spark, args) -> str:
    return report.table(generators.injection_report(generators.injection_cases(spark)), "injection")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lanewise")
    verbs = top.add_subparsers(dest="verb", required=True)
    for name, run in (("route", cmd_route), ("demo", cmd_demo), ("log-stats", cmd_log_stats), ("explain", cmd_explain), ("backtest", cmd_backtest), ("export", cmd_export), ("injection", cmd_injection)):
        p = verbs.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--policy")
        p.add_argument("--input")
        p.add_argument("--output")
        p.add_argument("--text")
        p.add_argument("--id")
        p.add_argument("--holdout", type=float, default=distill.HOLDOUT)
    return top


def main(argv=None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lanewise").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(args.run(spark, args))


if __name__ == "__main__":
    main()
