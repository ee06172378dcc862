"""Aggregations over decisions, outcomes and labels: counts, percentiles, costs, quality and calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import decision
from lanewise.plans.policy import PRICES

# Price table per million tokens (illustrative), models of tiers, completion length, thresholds.
PRICE_TABLE = {"local-model": (0.0, 0.0), "cheap-model": (0.15, 1.50), "strong-model": (1.60, 6.40)}
MODEL_FOR_TIER = {"local": "local-model", "cheap": "cheap-model", "strong": "strong-model"}
COMPLETION_TOKENS = 256.0
OUTPUT_TOKENS = 400
COVERAGE_THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
ERROR_KINDS = ("correct", "unsafe", "expensive", "overspend", "underpowered")


def literal_rows(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(list(rows), schema)


def dimension_counts(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dim, value, n): counts of several columns in one pass over the table.

    Grouping sets expand each row once per dimension and combine before the shuffle.
    """
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for c in dims])).alias("x"))
    return rows.groupBy("x.dim", "x.value").agg(F.count("*").alias("n"))


def nearest_rank(value: Column, q: float) -> Column:
    """sorted[int(q * n)], the last for q = 1; an aggregate over a bounded group."""
    ordered = F.array_sort(F.collect_list(value))
    return F.try_element_at(ordered, F.least(F.floor(F.lit(q) * F.size(ordered)).cast("int") + 1, F.size(ordered)))


def nearest_rank_of(df: DataFrame, value: str, quantiles: Sequence[float], bins: int = 4096) -> DataFrame:
    """(q, value) by nearest rank without gathering or sorting the values.

    Counts over equal ranges of the values (one pass for the ends, one for the counts) say which range holds each rank;
    only the distinct values of those ranges are counted and ranked, per quantile.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.col(value).cast("double").alias("x"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    placed = rows.crossJoin(F.broadcast(ends)).select("v", at.cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("c"))  # at most ``bins`` rows
    upto = F.sum("c").over(Window.orderBy("bin"))
    ranges = counts.select("bin", (upto - F.col("c")).alias("before"), upto.alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))
    asked = F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))
    ranges = ranges.withColumn("q", asked).withColumn("rank", F.least(F.floor(F.col("q") * F.col("n")), F.col("n") - 1))
    wanted = ranges.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto"))).select("bin", "q", "rank", "before")
    inside = placed.join(F.broadcast(wanted), "bin").groupBy("q", "rank", "before", "v").agg(F.count("*").alias("c"))
    run = F.col("before") + F.sum("c").over(Window.partitionBy("q").orderBy("v"))
    return inside.withColumn("upto", run).where("upto > rank").groupBy("q").agg(F.min("v").alias("value"))


def latency_summary(df: DataFrame, value: str) -> DataFrame:
    """n, mean, min, max and linear p50/p95/p99; nulls on an empty table."""
    return df.agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        *[F.percentile(value, q).alias(f"p{int(100 * q)}") for q in (0.5, 0.95, 0.99)],
    )


# ------------------------------------------------------------ costs


def tokens_of(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def price(tier: Column, prices: Mapping[str, float] = PRICES) -> Column:
    out = F.lit(float(prices["strong"]))
    for name, p in prices.items():
        out = F.when(tier == name, float(p)).otherwise(out)
    return out


def request_cost(tier: Column, input_tokens: Column, output_tokens=OUTPUT_TOKENS, prices: Mapping[str, float] = PRICES) -> Column:
    return (input_tokens + F.lit(output_tokens)).cast("double") / 1000 * price(tier, prices)


def backtest_rows(decisions: DataFrame, text: str = "text", output_tokens: int = OUTPUT_TOKENS, prices: Mapping[str, float] = PRICES) -> DataFrame:
    """Cost of each decision and of always taking the frontier price."""
    known = F.when(F.col("tier").isin(*prices), F.col("tier")).otherwise("strong")
    df = decisions.withColumn("tier", known).withColumn("input_tokens", tokens_of(F.col(text)))
    return df.withColumns(
        {
            "cost_ours": request_cost(F.col("tier"), F.col("input_tokens"), output_tokens, prices),
            "cost_baseline": request_cost(F.lit("frontier"), F.col("input_tokens"), output_tokens, prices),
            "completed_p": F.when(F.col("tier") == "local", 0.85).when(F.col("tier") == "cheap", 0.92).when(F.col("tier") == "strong", 0.97).otherwise(0.9),
        }
    )


def cost_rollup(rows: DataFrame, category: str = "category") -> DataFrame:
    """Counts and costs by category with a total row, and the saving."""
    out = rows.rollup(category).agg(F.count("*").alias("n"), F.sum("cost_ours").alias("cost_ours"), F.sum("cost_baseline").alias("cost_baseline"))
    return out.withColumn("savings_pct", 100 * (1 - F.try_divide("cost_ours", "cost_baseline")))


def strategy_costs(rows: DataFrame, strategies: Mapping[str, Column], expected: str = "expected_tier", chars: str = "chars") -> DataFrame:
    """One row per strategy: tier counts, tokens, cost, cloud calls, accuracy and unsafe errors.

    Strategies are exploded per row and combined before the shuffle: one pass over the table.
    """
    each = rows.select(expected, chars, F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), t.alias("tier")) for n, t in strategies.items()])).alias("s")).select(expected, chars, "s.*")
    in_price, out_price = F.lit(None).cast("double"), F.lit(None).cast("double")
    for tier, model in MODEL_FOR_TIER.items():
        i, o = PRICE_TABLE[model]
        in_price, out_price = F.when(F.col("tier") == tier, i).otherwise(in_price), F.when(F.col("tier") == tier, o).otherwise(out_price)
    each = each.withColumns({"in_price": in_price, "out_price": out_price, "tokens": F.col(chars) / 4.0})
    kind = decision.classify_error(F.col(expected), F.col("tier"))
    return each.groupBy("strategy").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in MODEL_FOR_TIER],
        F.sum("tokens").alias("input_tokens"),
        (F.sum(F.col("tokens") * F.col("in_price") + COMPLETION_TOKENS * F.col("out_price")) / 1e6).alias("total_cost"),
        (F.sum(F.col("tokens") * F.col("in_price")) / 1e6).alias("input_only_cost"),
        F.count_if(F.col("in_price") + F.col("out_price") > 0).alias("cloud_calls"),
        F.avg((kind == "correct").cast("double")).alias("tier_accuracy"),
        F.count_if(kind == "unsafe").alias("unsafe_errors"),
    )


def against_baseline(costs: DataFrame, baseline: str) -> DataFrame:
    """Ratio and percentage change of each strategy's cost to one of them."""
    base = F.max(F.when(F.col("strategy") == baseline, F.col("total_cost"))).over(Window.partitionBy())
    return costs.withColumn("ratio", F.try_divide("total_cost", base)).withColumn("delta_pct", 100 * (F.col("ratio") - 1))


def paired_outcomes(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Both right, both wrong, only one right, over two runs aligned on their id."""
    both = a.select(key, (F.col("expected_tier") == F.col("tier")).alias("a_ok")).join(b.select(key, (F.col("expected_tier") == F.col("tier")).alias("b_ok")), key)
    return both.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("a_ok") & F.col("b_ok")).alias("both_right"),
        F.count_if(~F.col("a_ok") & ~F.col("b_ok")).alias("both_wrong"),
        F.count_if(F.col("a_ok") & ~F.col("b_ok")).alias("a_only"),
        F.count_if(~F.col("a_ok") & F.col("b_ok")).alias("b_only"),
    )


# ------------------------------------------------------------ classification quality


def confusion(pairs: DataFrame, labels: Sequence[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Dense matrix: a row per gold label, a column per predicted label."""
    counts = pairs.groupBy(gold).agg(*[F.count_if(F.col(pred) == p).alias(f"pred_{p.replace('-', '_')}") for p in labels])
    every = literal_rows(pairs, [(x,) for x in labels], f"{gold} string")
    return every.join(counts, gold, "left").na.fill(0)


def per_class(pairs: DataFrame, labels: Sequence[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1: one pass, labels as conditional counts."""
    counts = pairs.agg(
        *[
            F.array(F.count_if((F.col(gold) == x) & (F.col(pred) == x)), F.count_if((F.col(gold) != x) & (F.col(pred) == x)), F.count_if((F.col(gold) == x) & (F.col(pred) != x))).alias(f"c{i}")
            for i, x in enumerate(labels)
        ]
    )
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"c{i}").alias("c")) for i, x in enumerate(labels)])).alias("r"))
    rows = rows.select("r.label", F.col("r.c")[0].alias("tp"), F.col("r.c")[1].alias("fp"), F.col("r.c")[2].alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    rows = rows.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def binary(pairs: DataFrame, gold: Column, pred: Column) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = pairs.agg(F.count_if(gold & pred).alias("tp"), F.count_if(~gold & ~pred).alias("tn"), F.count_if(~gold & pred).alias("fp"), F.count_if(gold & ~pred).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + F.col("tn"), tp + fp + fn + F.col("tn"))})


# ------------------------------------------------------------ calibration


def reliability(df: DataFrame, confidence: str, correct: Column, bins: int = decision.ECE_BINS) -> DataFrame:
    """Per bin n, mean confidence, accuracy and signed gap; empty bins are shown."""
    rows = df.select(decision.ece_bin(F.col(confidence), bins).alias("bin"), F.col(confidence).alias("c"), correct.cast("double").alias("ok"))
    stats = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("mean_confidence"), F.avg("ok").alias("accuracy"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(stats, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("gap", F.col("accuracy") - F.col("mean_confidence"))


def calibration_error(df: DataFrame, confidence: str, correct: Column, bins: int = decision.ECE_BINS, right_closed: bool = False) -> DataFrame:
    """ece, mce and n over non-empty bins."""
    key = decision.ece_bin_right(F.col(confidence), bins) if right_closed else decision.ece_bin(F.col(confidence), bins)
    rows = df.select(key.alias("bin"), F.col(confidence).alias("c"), correct.cast("double").alias("ok"))
    stats = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("mc"), F.avg("ok").alias("acc"))
    all_n = F.sum("n").over(Window.partitionBy())
    stats = stats.withColumn("part", F.when(F.col("bin").isNotNull(), F.abs(F.col("mc") - F.col("acc")))).withColumn("share", F.col("n") / all_n)
    return stats.agg(F.sum(F.col("part") * F.col("share")).alias("ece"), F.max("part").alias("mce"), F.sum("n").alias("n"))


def brier_scores(df: DataFrame, probabilities: str, gold: str, labels: Sequence[str]) -> DataFrame:
    """Mean Brier score, that of always answering the class shares, and the skill."""
    truth = F.array(*[F.when(F.col(gold) == x, 1.0).otherwise(0.0) for x in labels])
    out = df.select(decision.brier(F.col(probabilities), truth).alias("b"), F.col(gold).alias("g"))
    shares = [F.avg((F.col("g") == x).cast("double")) for x in labels]
    base = sum((s * (1 - s) for s in shares), F.lit(0.0))
    return out.agg(F.avg("b").alias("brier"), base.alias("baseline_brier")).withColumn("skill", 1 - F.try_divide("brier", "baseline_brier"))


def coverage(df: DataFrame, confidence: str, correct: Column, thresholds: Sequence[float] = COVERAGE_THRESHOLDS) -> DataFrame:
    """n, coverage and accuracy of the rows at or above each threshold: conditional counts in one pass."""
    rows = df.select(F.col(confidence).alias("c"), correct.alias("ok"))
    one = rows.agg(
        F.count("*").alias("total"),
        *[F.struct(F.count_if(F.col("c") >= t).alias("n"), F.count_if((F.col("c") >= t) & F.col("ok")).alias("k")).alias(f"t{i}") for i, t in enumerate(thresholds)],
    )
    rows = one.select("total", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("x")) for i, t in enumerate(thresholds)])).alias("r"))
    n = F.col("r.x.n")
    return rows.select("r.threshold", n.alias("n"), F.try_divide(n.cast("double"), F.col("total")).alias("coverage"), F.try_divide(F.col("r.x.k").cast("double"), n).alias("accuracy"))


def event_curve(df: DataFrame, p: str, happened: Column, bins: int = 10) -> DataFrame:
    return reliability(df, p, happened, bins).select("bin", "n", F.col("mean_confidence").alias("mean_p"), F.col("accuracy").alias("rate"))


def fidelity(df: DataFrame, student: str, teacher: str) -> DataFrame:
    """Mean KL, Brier and total variation between two distributions of a row."""
    t, s = F.col(teacher), F.col(student)
    return df.agg(F.avg(decision.kl(t, s)).alias("mean_kl"), F.avg(decision.brier(t, s)).alias("mean_brier"), F.avg(decision.total_variation(t, s)).alias("mean_tvd"))


def teacher_error(df: DataFrame, student: str, teacher: str, bins: int = decision.ECE_BINS) -> DataFrame:
    """Gap between a student's confidence and the teacher's probability of that class."""
    top = F.array_max(F.col(student))
    same = F.element_at(F.col(teacher), F.array_position(F.col(student), top).cast("int"))
    rows = df.select(top.alias("c"), same.alias("t"))
    stats = rows.groupBy(decision.ece_bin(F.col("c"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("c").alias("mc"), F.avg("t").alias("mt"))
    all_n = F.sum("n").over(Window.partitionBy())
    return stats.withColumn("share", F.col("n") / all_n).agg(F.sum(F.col("share") * F.abs(F.col("mc") - F.col("mt"))).alias("teacher_ece"), F.sum("n").alias("n"))


# ------------------------------------------------------------ shadow windows and promotion

# Fixed values of the live window.
WINDOW_SIZE, MIN_DECISIONS, MIN_DAYS, BASELINE_SIZE, DRIFT_FACTOR, MIN_AGREEMENT = 5000, 500, 7.0, 200, 2.0, 0.95


def newest(df: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` rows of the highest ``order``: a bounded top-n, no global sort."""
    return df.orderBy(F.desc(order)).limit(n)


def window_status(df: DataFrame, by: str | None = None, order: str = "seq", baseline: int = BASELINE_SIZE, bins: int = decision.ECE_BINS) -> DataFrame:
    """Agreement, calibration, drift and completeness of a window of shadow records.

    A window is bounded by its size, so ranking its rows is cheap at any log size.
    """
    keys = [by] if by else []
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    fired = F.col("shadow_score") >= F.col("threshold")
    rows = df.withColumns({"fired": fired, "differs": F.col("decision_fired") != fired, "rn": F.row_number().over(part.orderBy(order))})
    rows = rows.withColumn("bin", F.least(F.floor(F.col("shadow_score") * bins), F.lit(bins - 1)))
    per_bin = rows.groupBy(*keys, "bin").agg(
        F.count("*").alias("c"), F.abs(F.avg("shadow_score") - F.avg(F.col("fired").cast("double"))).alias("gap"),
        F.count_if("differs").alias("d"), F.count_if(F.col("rn") <= baseline).alias("bn"), F.count_if((F.col("rn") <= baseline) & F.col("differs")).alias("bd"),
        F.min("ts").alias("t0"), F.max("ts").alias("t1"),
    )
    out = per_bin.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("gap")).alias("weighted"), F.sum("d").alias("d"), F.sum("bn").alias("bn"), F.sum("bd").alias("bd"),
        F.min("t0").alias("t0"), F.max("t1").alias("t1"),
    )
    n = F.col("n")
    base = F.when(n >= baseline, F.col("bd") / F.col("bn"))
    now = F.when(n > baseline, (F.col("d") - F.col("bd")) / (n - F.col("bn")))
    out = out.withColumns(
        {
            "days_covered": (F.col("t1") - F.col("t0")) / 86400.0,
            "agreement_rate": F.round(1 - F.col("d") / n, 6),
            "ece": F.round(F.col("weighted") / n, 6),
            "baseline_disagreement": base,
            "current_disagreement": now,
        }
    )
    out = out.withColumn("drift_alarm", F.coalesce(F.col("current_disagreement") > DRIFT_FACTOR * F.col("baseline_disagreement"), F.lit(False)))
    out = out.withColumn("window_complete", (n >= MIN_DECISIONS) & (F.col("days_covered") >= MIN_DAYS))
    return out.select(*keys, F.col("n").alias("n_decisions"), "days_covered", "agreement_rate", "ece", "baseline_disagreement", "current_disagreement", "drift_alarm", "window_complete")


def demotions(status: DataFrame) -> DataFrame:
    """Demotion events of windows whose drift alarm is on."""
    from lanewise.schema import DEMOTION

    reason = F.format_string("live disagreement %.4f exceeds %.1fx the baseline %.4f", "current_disagreement", F.lit(DRIFT_FACTOR), "baseline_disagreement")
    return status.where("drift_alarm").select(F.lit(DEMOTION).alias("kind"), reason.alias("reason"), "baseline_disagreement", "current_disagreement", "n_decisions")


# Promotion criteria.
CRITERIA = {
    "recall": (">=", 0.99), "false_positive_rate": ("<=", 0.02), "disagreement_rate": ("<=", 0.05), "n_positives": (">=", 200),
    "n_negatives": (">=", 500), "shadow_n_examples": (">=", 1000), "semantic_miss_rate": ("<=", 0.02),
}


def promotion_metrics(df: DataFrame, score: str, sensitive: Column, layer1: Column, threshold: float) -> DataFrame:
    """Both layers on every row, reduced to rates; null where there is nothing to measure."""
    rows = df.select(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)).alias("s"), sensitive.alias("y"), layer1.alias("l"))
    fired = F.col("s") >= threshold
    rate = lambda hit, of: F.round(F.try_divide(F.count_if(hit).cast("double"), F.count_if(of).cast("double")), 6)
    y, layer, yes = F.col("y"), F.col("l"), F.lit(True)
    return rows.agg(
        F.count("*").alias("n_examples"), F.count_if(y).alias("n_positives"), F.count_if(~y).alias("n_negatives"), F.count_if(layer).alias("n_layer1_fired"),
        rate(y & fired, y).alias("recall"), rate(~y & fired, ~y).alias("false_positive_rate"), rate(fired != layer, yes).alias("disagreement_rate"),
        rate(fired & ~layer, yes).alias("semantic_only_rate"), rate(layer & ~fired, layer).alias("semantic_miss_rate"), rate(y & layer, y).alias("layer1_recall"),
        F.round(F.avg(F.when(y, F.col("s"))), 6).alias("mean_score_positive"), F.round(F.avg(F.when(~y, F.col("s"))), 6).alias("mean_score_negative"),
        F.round(F.max(F.when(~y, F.col("s"))), 6).alias("max_score_negative"),
    )


def promotion_checks(metrics: DataFrame, criteria: Mapping[str, tuple[str, float]] = CRITERIA) -> DataFrame:
    """(name, requirement, measured, ok) of one row of metrics; what was not measured fails."""
    has = set(metrics.columns)
    rows = []
    for name, (op, bar) in criteria.items():
        value = (F.col(name) if name in has else F.lit(None)).cast("double")
        ok = F.coalesce(value >= bar if op == ">=" else value <= bar, F.lit(False))
        rows.append(F.struct(F.lit(name).alias("name"), F.lit(f"{op} {bar}").alias("requirement"), value.alias("measured"), ok.alias("ok")))
    return metrics.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def disagreements(primary: DataFrame, shadow: DataFrame, heads: Sequence[str] = ("complexity", "sensitivity", "domain"), key: str = "request_id") -> DataFrame:
    """Per request the heads on which two scorers differ; pii differs by a quarter or more."""
    joined = primary.alias("p").join(shadow.alias("s"), key)
    fields = [F.when(F.col(f"p.{h}") != F.col(f"s.{h}"), h) for h in heads] + [F.when(F.abs(F.col("p.pii") - F.col("s.pii")) >= 0.25, "pii")]
    return joined.select(key, F.array_compact(F.array(*fields)).alias("fields")).withColumn("agrees", F.size("fields") == 0)
