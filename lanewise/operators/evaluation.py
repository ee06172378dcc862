"""Evaluation rows: tier and head metrics, replay, graduation, dataset checks, comparisons and their reports.

An evaluation row has id, text, difficulty, expected_tier and labels (complexity, sensitivity, domain, pii), and beside
them the run's tier, answers (choice structs and pii), gate, error and degraded.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions import answers, decision
from lanewise.operators import analytics
from lanewise.plans.policy import Policy

HEADS = answers.LADDERS
EVAL_ROW = "id string, text string, labels struct<complexity:string,sensitivity:string,domain:string,pii:boolean>, expected_tier string, difficulty string, notes string"

# What a dataset must hold at least, forms of its fields, and the bars of a graduation.
MINIMUMS = {
    "total": 180, "complexity": 25, "sensitivity": 25, "domain": 25, "pii_true": 40, "pii_false_sensitive": 40,
    "negative_controls": 15, "injection": 8, "hungarian": 10, "german": 5, "long": 5,
}
DIFFICULTIES, SLUG = ("clear", "ambiguous"), r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
LONG_CHARS, AMBIGUOUS = 800, (0.10, 0.40)
LEAST_NOTE, LEAST_TEXT, MOST_TEXT = 20, 8, 6000
GRADUATION = {"min_tier_agreement": (0.95, "min"), "max_ece": (0.10, "max"), "max_latency_ms": (50.0, "max"), "min_samples": (500.0, "min")}
MISSES_SHOWN = 12


# ------------------------------------------------------------ reading and checking datasets


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows as JSON lines; a malformed line is an error."""
    return spark.read.schema(EVAL_ROW).option("mode", "FAILFAST").json(path)


def write_eval(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def line_faults(lines: DataFrame, line: str = "value") -> DataFrame:
    """(line, fault) of raw lines that are blank, no JSON or no object."""
    body = F.try_parse_json(F.col(line))
    fault = F.when(F.trim(line) == "", "blank line").when(body.isNull(), "malformed JSON").when(~F.schema_of_variant(body).startswith("OBJECT"), "not an object")
    return lines.select(F.col(line).alias("line"), fault.alias("fault")).where("fault is not null")


def row_faults(rows: DataFrame) -> DataFrame:
    """(id, fault): one row per fault of a dataset row; ids and texts must be unique."""
    y = F.col("labels")
    known = lambda c, names: F.coalesce(c.isin(*names), F.lit(False))
    checks = {
        "id is not a lower-case slug": ~F.coalesce(F.col("id").rlike(SLUG), F.lit(False)),
        "notes too short": F.length(F.trim(F.coalesce("notes", F.lit("")))) < LEAST_NOTE,
        "unknown difficulty": ~known(F.col("difficulty"), DIFFICULTIES),
        "unknown tier": ~known(F.col("expected_tier"), schema.TIERS),
        "unknown complexity": ~known(y["complexity"], schema.COMPLEXITY),
        "unknown sensitivity": ~known(y["sensitivity"], schema.SENSITIVITY),
        "unknown domain": ~known(y["domain"], schema.DOMAINS),
        "pii is not a boolean": y["pii"].isNull(),
        "text too short": F.length(F.trim(F.coalesce("text", F.lit("")))) < LEAST_TEXT,
        "text too long": F.length(F.coalesce("text", F.lit(""))) > MOST_TEXT,
        "text has a carriage return": F.coalesce(F.col("text").contains("\r"), F.lit(False)),
        "tier is not the policy's": F.coalesce(F.col("expected_tier") != answers.intended_tier(y["complexity"], y["sensitivity"], y["pii"]), F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks.items()]))
    each = rows.select("id", F.explode(found).alias("fault"))
    for column, fault in (("id", "id occurs twice"), ("text", "text occurs twice")):
        twice = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1").select(column)
        each = each.unionByName(rows.join(twice, column, "left_semi").select("id", F.lit(fault).alias("fault")).distinct())
    return each


def coverage_stats(rows: DataFrame) -> DataFrame:
    """(dim, value, n): rows per level of every label, and the counts that a dataset needs."""
    y = F.col("labels")
    flags = {
        "total": F.lit(True),
        "pii_true": y["pii"],
        "pii_false_sensitive": ~y["pii"] & y["sensitivity"].isin("confidential", "regulated"),
        "negative_controls": F.col("id").startswith("neg-"),
        "injection": F.col("id").startswith("inj-"),
        "hungarian": F.col("id").startswith("hu-"),
        "german": F.col("id").startswith("de-"),
        "long": F.length("text") >= LONG_CHARS,
    }
    levels = {"complexity": y["complexity"], "sensitivity": y["sensitivity"], "domain": y["domain"], "tier": F.col("expected_tier"), "difficulty": F.col("difficulty")}
    each = [F.struct(F.lit(k).alias("dim"), v.alias("value")) for k, v in levels.items()] + [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("dim"), F.lit(None).cast("string").alias("value"))) for k, c in flags.items()]
    ones = rows.where(y["complexity"].isNotNull()).select(F.explode(F.array_compact(F.array(*each))).alias("x"))
    return ones.groupBy("x.dim", "x.value").agg(F.count("*").alias("n"))


def ambiguous_share(stats: DataFrame) -> DataFrame:
    """(share, ok): the share of ambiguous rows, which must lie in a band."""
    total, hits = F.sum(F.when(F.col("dim") == "total", F.col("n"))), F.sum(F.when((F.col("dim") == "difficulty") & (F.col("value") == "ambiguous"), F.col("n")))
    share = F.coalesce(F.try_divide(F.coalesce(hits, F.lit(0)).cast("double"), total.cast("double")), F.lit(0.0))
    return stats.agg(share.alias("share")).withColumn("ok", F.col("share").between(*AMBIGUOUS))


def minimum_faults(stats: DataFrame, minimums: Mapping[str, int] = MINIMUMS) -> DataFrame:
    """(dim, value, n, least): counts below what a dataset needs; levels that never occur count 0."""
    needs = []
    for dim, least in minimums.items():
        needs += [(dim, level, least) for level in HEADS[dim]] if dim in HEADS else [(dim, None, least)]
    want = analytics.literal_rows(stats, needs, "dim string, value string, least long")
    same = (F.col("w.dim") == F.col("s.dim")) & F.col("w.value").eqNullSafe(F.col("s.value"))
    joined = want.alias("w").join(stats.alias("s"), same, "left").select("w.dim", "w.value", F.coalesce("s.n", F.lit(0)).alias("n"), "w.least")
    return joined.where("n < least")


# ------------------------------------------------------------ metrics of a run


def scoreable() -> Column:
    """Rows on which the router produced a tier, and not because its scorer was down."""
    return F.col("error").isNull() & F.coalesce(F.col("tier").isin(*schema.TIERS), F.lit(False)) & ~F.coalesce("degraded", F.lit(False))


def tier_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, kinds of errors and what was left out of them; one row (per group), one pass."""
    ok = scoreable()
    kind = decision.classify_error(F.col("expected_tier"), F.col("tier"))
    n = F.count_if(ok)
    rate = lambda hits: F.round(F.try_divide(F.count_if(ok & hits).cast("double"), n.cast("double")), 6)
    kinds = [F.count_if(ok & (kind == k)).alias("unsafe_errors" if k == "unsafe" else f"{k}_errors" if k != "correct" else k) for k in analytics.ERROR_KINDS]
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"), n.alias("n_scored"),
        F.count_if(F.col("error").isNotNull()).alias("excluded_error"), F.count_if(F.coalesce("degraded", F.lit(False)) & F.col("error").isNull()).alias("excluded_degraded"),
        F.count_if(F.col("error").isNull() & ~F.coalesce(F.col("tier").isin(*schema.TIERS), F.lit(False))).alias("excluded_tier"),
        rate(kind == "correct").alias("accuracy"), rate(kind == "unsafe").alias("unsafe_rate"), *kinds,
    )


def component_metrics(rows: DataFrame, head: str, gold: Column, answer: Column) -> DataFrame:
    """Accuracy and macro F1 of one head's own choice; rows without an answer are counted apart."""
    ladder = HEADS[head]
    pairs = rows.select(gold.alias("gold"), answer["choice"].alias("pred"), answer["probabilities"].alias("p"))
    seen = F.col("pred").isNotNull()
    counts = [F.struct(F.count_if(seen & (F.col("gold") == x) & (F.col("pred") == x)).alias("tp"), F.count_if(seen & (F.col("gold") != x) & (F.col("pred") == x)).alias("fp"), F.count_if(seen & (F.col("gold") == x) & (F.col("pred") != x)).alias("fn")).alias(f"c{i}") for i, x in enumerate(ladder)]
    one = pairs.agg(
        F.count_if(seen).alias("n_scored"), F.count_if(~seen).alias("n_unclassified"), F.count_if(seen & (F.col("pred") != decision.argmax(F.col("p"), ladder))).alias("argmax_mismatch_rows"),
        F.count_if(seen & (F.col("gold") == F.col("pred"))).alias("right"), *counts,
    )
    f1 = [F.coalesce(F.try_divide(2.0 * F.col(f"c{i}.tp"), (2 * F.col(f"c{i}.tp") + F.col(f"c{i}.fp") + F.col(f"c{i}.fn")).cast("double")), F.lit(0.0)) for i in range(len(ladder))]
    return one.select(
        F.lit(head).alias("head"), "n_scored", "n_unclassified", "argmax_mismatch_rows",
        F.round(F.try_divide(F.col("right").cast("double"), F.col("n_scored").cast("double")), 6).alias("accuracy"), F.round(sum(f1[1:], f1[0]) / len(ladder), 6).alias("macro_f1"),
    )


def class_report(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per class support, predictions, precision, recall and F1 of (gold, pred) rows, with the macro F1 over the
    classes that occur on either side."""
    rows = analytics.per_class(pairs, labels).withColumns({"support": F.col("tp") + F.col("fn"), "predicted": F.col("tp") + F.col("fp")})
    occurs = F.when((F.col("support") > 0) | (F.col("predicted") > 0), F.col("f1"))
    return rows.withColumn("macro_f1", F.avg(occurs).over(Window.partitionBy())).select("label", "support", "predicted", "precision", "recall", "f1", "macro_f1")


def calibration_samples(rows: DataFrame, gold: Mapping[str, Column], answer: Mapping[str, Column], id_col: str = "id") -> DataFrame:
    """(id, head, gold, prediction, probabilities, confidence) in long form; the confidence is null where none was reported."""
    heads = [
        F.struct(
            F.lit(h).alias("head"), gold[h].alias("gold"), a["choice"].alias("prediction"), a["probabilities"].alias("probabilities"),
            F.when(a["confidence_reported"], a["confidence"]).alias("confidence"),
        )
        for h, a in answer.items()
    ]
    each = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*heads)).alias("x")).select("id", "x.*")
    labels = F.lit(None).cast("boolean")
    for h in answer:
        labels = F.when(F.col("head") == h, F.col("gold").isin(*HEADS[h])).otherwise(labels)
    return each.where(F.col("prediction").isNotNull() & labels)


def calibration_block(samples: DataFrame, bins: int = decision.ECE_BINS) -> DataFrame:
    """Per head n, populated bins, ECE, MCE, Brier and mean confidence: one grouping by (head, bin), one by head."""
    top = F.coalesce("confidence", F.array_max("probabilities"))
    at = F.lit(None).cast("int")
    for h, ladder in HEADS.items():
        at = F.when(F.col("head") == h, F.array_position(F.array(*[F.lit(x) for x in ladder]), F.col("gold")).cast("int")).otherwise(at)
    squares = F.aggregate(F.col("probabilities"), F.lit(0.0), lambda a, x: a + x * x)
    rows = samples.withColumns({"_c": top, "_ok": (F.col("prediction") == F.col("gold")).cast("double"), "_brier": squares - 2 * F.element_at("probabilities", at) + 1})
    cells = rows.groupBy("head", decision.ece_bin(F.col("_c"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("_c").alias("c"), F.avg("_ok").alias("ok"), F.sum("_brier").alias("b"), F.sum("_c").alias("cs"))
    gap = F.abs(F.col("c") - F.col("ok"))
    return cells.groupBy("head").agg(
        F.sum("n").alias("n"), F.count("*").alias("populated_bins"), (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"),
        (F.sum("b") / F.sum("n")).alias("brier"), (F.sum("cs") / F.sum("n")).alias("mean_confidence"),
    )


def worst_head(block: DataFrame) -> DataFrame:
    """(worst_head, worst_ece) over the heads that have rows."""
    return block.where("n > 0").agg(F.max_by("head", F.struct("ece", "head")).alias("worst_head"), F.max("ece").alias("worst_ece"))


def pii_coverage(rows: DataFrame, category: str, fired: Column, is_pii: Column) -> DataFrame:
    """How many rows of the categories that hold personal data the gate fired on."""
    return rows.where(is_pii).agg(F.count("*").alias("pii_rows"), F.count_if(fired).alias("pii_fires"), F.count_if(~fired).alias("missed"), F.count_distinct(category).alias("categories"))


def tier_reasons(rows: DataFrame, category: str, fired: Column) -> DataFrame:
    """(category, n, reason): why a category lands on its tiers, in words."""
    names = ("local", "cheap", "strong")
    counts = rows.groupBy(category).agg(F.count("*").alias("n"), F.count_if(fired).alias("fires"), *[F.count_if(F.col("tier") == t).alias(t) for t in names])
    n, fires, local = F.col("n"), F.col("fires"), F.col("local")
    forced = F.least(fires, local)
    one = (
        F.when((local == n) & (fires == n), "gate forces local on every row (see Gate)")
        .when(local == n, "policy routes the category to local")
        .when(F.col("strong") == n, "hard complexity maps to the strong tier")
        .when(F.col("cheap") == n, "default rule: no sensitivity signal, non-hard complexity")
    )
    others = F.transform(
        F.array_sort(F.array(*[F.struct((-F.col(t)).alias("k"), F.lit(t).alias("t")) for t in ("cheap", "strong")])),
        lambda x: F.when(x["k"] < 0, F.concat((-x["k"]).cast("string"), F.lit(" to `"), x["t"], F.lit("` by policy"))),
    )
    parts = F.concat(
        F.array(F.when(forced > 0, F.concat(forced.cast("string"), F.lit(" gate-forced local"))), F.when(local > forced, F.concat((local - forced).cast("string"), F.lit(" local by policy")))), others
    )
    mixed = F.concat(F.array_join(F.array_compact(parts), "; "), F.when(fires > 0, " (see Gate)").otherwise(""))
    return counts.select(category, "n", F.coalesce(one, mixed).alias("reason"))


# ------------------------------------------------------------ replay and graduation


def replayed(rows: DataFrame, policy: Policy) -> DataFrame:
    """Logged answers through the policy once more, without a scorer: the merge, the escalations and the rules, but not
    the step that sends very unsure rows to the local tier."""
    from lanewise.plans.route import resolve

    return resolve(rows, replace(policy, uncertainty=replace(policy.uncertainty, force_local_below=None), min_confidence=None))


def agreement(rows: DataFrame, student: str, teacher: str, blocked: Column | None = None) -> DataFrame:
    """Rows compared, rows that agree and their share; gate-blocked rows are not compared."""
    open_ = F.lit(True) if blocked is None else ~blocked
    hit = open_ & (F.col(student) == F.col(teacher))
    return rows.agg(F.count_if(open_).alias("compared"), F.count_if(hit).alias("agreed"), F.try_divide(F.count_if(hit).cast("double"), F.count_if(open_).cast("double")).alias("tier_agreement"))


def replay_drift(logged: DataFrame, live: DataFrame, student: DataFrame, key: str = "request_id") -> DataFrame:
    """A student's tiers against the live teacher's, and the teacher's own drift from its log: joins on the request."""
    rows = student.select(key, F.col("tier").alias("student_tier")).join(live.select(key, F.col("tier").alias("live_tier"), F.col("degraded").alias("live_degraded")), key)
    rows = rows.join(logged.select(key, F.col("tier").alias("logged_tier")), key, "left")
    usable = ~F.col("live_degraded")
    drift = F.col("logged_tier").isNotNull() & (F.col("live_tier") != F.col("logged_tier"))
    out = rows.agg(F.count("*").alias("rows"), F.count_if(usable).alias("compared"), F.count_if(usable & (F.col("student_tier") == F.col("live_tier"))).alias("agreed"), F.count_if(drift).alias("teacher_drift_rows"))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return out.withColumns({"tier_agreement": share("agreed", "compared"), "teacher_drift_rate": share("teacher_drift_rows", "rows")})


def graduation_checks(metrics: DataFrame, bars: Mapping[str, float] | None = None) -> DataFrame:
    """(name, measured, bar, ok) of the four gates over one row of tier_agreement, worst_ece, p50_ms and n_rows.

    A number that is missing or not a number fails its gate.
    """
    columns = {"min_tier_agreement": "tier_agreement", "max_ece": "worst_ece", "max_latency_ms": "p50_ms", "min_samples": "n_rows"}
    rows = []
    for name, (default, kind) in GRADUATION.items():
        bar, x = float((bars or {}).get(name, default)), F.col(columns[name]).cast("double")
        passes = (x >= bar) if kind == "min" else (x <= bar)
        rows.append(F.struct(F.lit(name).alias("name"), x.alias("measured"), F.lit(bar).alias("bar"), F.coalesce(passes & ~F.isnan(x), F.lit(False)).alias("ok")))
    return metrics.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def relaxed_gates(bars: Mapping[str, float]) -> list[str]:
    """Which bars are more permissive than the documented ones."""
    out = []
    for name, (default, kind) in GRADUATION.items():
        value = float(bars.get(name, default))
        if (kind == "min" and value < default) or (kind == "max" and value > default):
            out.append(f"{name}: {value:g} instead of {default:g} ({'floor lowered' if kind == 'min' else 'ceiling raised'})")
    return out


def switched_backend(policy: Mapping[str, Any], artifact: str, version: str) -> dict[str, Any]:
    """A policy document whose scorer is the distilled student; what it replaces is kept beside it."""
    before = policy.get("backend", {})
    return {**policy, "backend": {"name": "distilled", "artifact": artifact, "model_version": version, "replaced": dict(before)}}


class CriteriaError(ValueError):
    """Criteria of a promotion that must not be deployed."""


@dataclass(frozen=True)
class Criteria:
    """What the second layer must reach before it may enforce."""

    min_recall: float = 0.99
    max_false_positive_rate: float = 0.02
    max_disagreement_rate: float = 0.05
    max_semantic_miss_rate: float = 0.02
    min_flip_accuracy: float = 0.98
    min_positive_examples: int = 200
    min_negative_examples: int = 500
    min_shadow_examples: int = 1000

    #: The required recall may be raised, not lowered below this.
    LEAST_RECALL = 0.90

    def __post_init__(self):
        for f in fields(self):
            value, rate = getattr(self, f.name), not f.name.endswith("_examples")
            if isinstance(value, bool) or not isinstance(value, (int, float) if rate else int):
                raise CriteriaError(f"{f.name} must be a number")
            if (rate and not 0 <= value <= 1) or value < 0:
                raise CriteriaError(f"{f.name}={value} is out of range")
        if self.min_recall < self.LEAST_RECALL:
            raise CriteriaError(f"min_recall={self.min_recall} is below {self.LEAST_RECALL}")

    @classmethod
    def parse(cls, raw: Mapping[str, Any] | None) -> Criteria:
        unknown = sorted(set(raw or {}) - {f.name for f in fields(cls)})
        if unknown:
            raise CriteriaError(f"unknown criteria {unknown}")
        return cls(**dict(raw or {}))

    @classmethod
    def for_evaluation(cls, positives: int, negatives: int) -> Criteria:
        """Criteria for a test set of a known size: no live traffic, and as many examples as there are."""
        return cls(min_positive_examples=positives, min_negative_examples=negatives, min_shadow_examples=0)


# ------------------------------------------------------------ comparisons


def deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tier metrics of one run less another's; null where either is missing."""
    two = a.select(F.struct("*").alias("a")).crossJoin(b.select(F.struct("*").alias("b")))
    minus = lambda c: F.col(f"a.{c}") - F.col(f"b.{c}")
    return two.select(F.round(minus("accuracy"), 6).alias("accuracy_delta"), minus("unsafe_errors").alias("unsafe_delta"), minus("expensive_errors").alias("expensive_delta"))


def compared_runs(runs: Mapping[str, DataFrame]) -> DataFrame:
    """Tier metrics of several runs in one table, by run: one pass over their union."""
    every = None
    for name, rows in runs.items():
        rows = rows.withColumn("run", F.lit(name))
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
    return tier_metrics(every, ["run"])


def shadow_stats(rows: DataFrame, fields_: Sequence[str], completed: Column, degraded: Column) -> DataFrame:
    """Shadowed calls, completions, disagreements (never of degraded calls), and disagreements by field."""
    differs = {f: completed & ~degraded & (F.col(f) != F.col(f"shadow_{f}")) for f in fields_}
    any_ = F.greatest(*differs.values()) if len(differs) > 1 else next(iter(differs.values()))
    out = rows.agg(F.count("*").alias("calls"), F.count_if(completed).alias("completed"), F.count_if(completed & degraded).alias("degraded"), F.count_if(any_).alias("disagreements"), *[F.count_if(d).alias(f"differs_{f}") for f, d in differs.items()])
    return out.withColumn("disagreement_rate", F.round(F.coalesce(F.try_divide(F.col("disagreements").cast("double"), F.col("completed").cast("double")), F.lit(0.0)), 6))


def recent_reports(reports: DataFrame, by: str, order: str, most: int = 256) -> DataFrame:
    """The last reports of each key: a ring buffer as a ranking that Spark may cut early."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return reports.withColumn("_rn", rank).where(F.col("_rn") <= most).drop("_rn")


def question_score(rows: DataFrame, expected: str, tier: str = "tier", chars: str = "chars", counted: Column | None = None, misses: int = MISSES_SHOWN, id_col: str = "id") -> DataFrame:
    """Accuracy and saving of a wording of the questions, its score, and its first misses by id.

    Rows that are not ``counted`` are in the accuracy's denominator alone, as rows that no wording can win.
    """
    ok = F.lit(True) if counted is None else counted
    right = ok & (F.col(tier) == F.col(expected))
    tokens = F.greatest(F.lit(1), F.floor(F.col(chars) / 4).cast("int"))
    ours, base = (F.sum(F.when(ok, analytics.request_cost(t, tokens))) for t in (F.col(tier), F.lit("frontier")))
    savings = F.greatest(F.lit(0.0), F.coalesce(1 - F.try_divide(ours, base), F.lit(0.0)))
    # a bounded number of ids: the least
    low = rows.where(ok & ~right).select(F.col(id_col).alias("_id")).orderBy("_id").limit(misses).agg(F.array_sort(F.collect_list("_id")).alias("misses"))
    out = rows.agg((F.count_if(right).cast("double") / F.greatest(F.count("*"), F.lit(1))).alias("accuracy"), savings.alias("savings"))
    return out.withColumn("score", F.col("accuracy") + 0.25 * F.col("savings")).crossJoin(F.broadcast(low))


def fresh(candidates: DataFrame, excluded: DataFrame, key: str = "text") -> DataFrame:
    """Candidates whose text is not among the excluded ones."""
    return candidates.join(excluded.select(key).distinct(), key, "left_anti")


def with_refusals(decisions: DataFrame, refusals: DataFrame) -> DataFrame:
    """Decisions beside the refusal of the same request and time, where there is one."""
    named = refusals.select("request_id", "timestamp", F.col("detectors").alias("refused_detectors"), F.col("sensitivity_floor").alias("refused_floor"))
    return decisions.join(named, ["request_id", "timestamp"], "left")


def memo(rows: DataFrame, excerpt: Column, topics: Column, order: str) -> DataFrame:
    """Adds the evaluation's memo key and whether an earlier row had it."""
    keyed = rows.withColumn("memo_key", answers.memo_key(excerpt, topics))
    return keyed.withColumn("memo_hit", F.row_number().over(Window.partitionBy("memo_key").orderBy(order)) > 1)


def eval_passes(rows: DataFrame, passes: int = 2) -> DataFrame:
    """The rows once for every pass, numbered: what a cache measurement replays."""
    return rows.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))


# ------------------------------------------------------------ reports


def wrapped(text_: str, limit: int = 100) -> str:
    """Text broken at spaces into lines of at most ``limit`` characters where words allow."""
    lines, now = [], ""
    for word in text_.split():
        if now and len(now) + 1 + len(word) > limit:
            lines.append(now)
            now = word
        else:
            now = f"{now} {word}" if now else word
    return "\n".join([*lines, now]) if now else "\n".join(lines)


def _cell(value: Any) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "–"
    return f"{value:.4f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)


def table_lines(rows: Sequence[Mapping[str, Any]]) -> list[str]:
    """A Markdown table of rows with equal keys."""
    if not rows:
        return ["(no rows)"]
    names = list(rows[0])
    return ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |", *["| " + " | ".join(_cell(r.get(n)) for n in names) + " |" for r in rows]]


def render(title: str, sections: Mapping[str, Any]) -> str:
    """A Markdown report: a table for a list of rows, a wrapped paragraph for a text, a list for a mapping."""
    out = [f"# {title}", ""]
    for name, body in sections.items():
        out += [f"## {name}", ""]
        if isinstance(body, str):
            out.append(wrapped(body))
        elif isinstance(body, Mapping):
            out += [f"* {k}: {_cell(v) if not isinstance(v, (dict, list)) else json.dumps(v, sort_keys=True)}" for k, v in body.items()]
        else:
            out += table_lines([r.asDict() if hasattr(r, "asDict") else r for r in body])
        out.append("")
    return "\n".join(out)


def export_warnings(tally: Mapping[str, Any], with_text: bool = True) -> list[str]:
    """What to know about an exported dataset, from its counts: no_text, duplicate_excerpts, holdout_rows, usable (per head)."""
    out = []
    if with_text and tally.get("no_text"):
        out.append(f"{tally['no_text']} rows carry no text and were left out; a dataset of features would hold them")
    if tally.get("duplicate_excerpts"):
        out.append(f"{tally['duplicate_excerpts']} rows repeat a text; equal texts may lie on both sides of the split")
    if with_text:
        out.append("the dataset holds redacted prompts: treat it like the prompts")
    if empty := sorted(h for h, n in tally.get("usable", {}).items() if not n):
        out.append(f"heads without a usable row: {empty}")
    if not tally.get("holdout_rows"):
        out.append("the holdout is empty, so nothing can be measured")
    return out


def export_tally(rows: DataFrame, skipped: DataFrame) -> dict[str, Any]:
    """Counts of a dataset of training rows, and of the log rows it left out, for ``export_warnings``."""
    usable = {h: F.count_if(F.col(h).isNotNull()).alias(h) for h in ("complexity", "sensitivity", "domain", "pii")}
    one = rows.agg(F.count_if(F.col("split") == "holdout").alias("holdout_rows"), (F.count("*") - F.count_distinct("excerpt_hash")).alias("duplicate_excerpts"), *usable.values()).first()
    missing = skipped.where("reason = 'no_text'").agg(F.sum("n")).first()[0] or 0
    return {"holdout_rows": one["holdout_rows"], "duplicate_excerpts": one["duplicate_excerpts"], "no_text": missing, "usable": {h: one[h] for h in usable}}


def latency_of(model: Any, rows: Sequence[Any], warmup: int = 5) -> dict[str, float]:
    """p50, p95 and p99 in milliseconds of one call after another on the driver: a measurement, not a query."""
    import time

    import numpy as np

    for x in rows[:warmup]:
        model(x)
    took = []
    for x in rows:
        start = time.perf_counter()
        model(x)
        took.append(1000 * (time.perf_counter() - start))
    return {f"p{q}": float(np.percentile(took, q)) if took else math.nan for q in (50, 95, 99)}
