"""The routing plan: requests in, decisions out, one wide projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions import decision, detectors, text
from lanewise.operators import semantic as layer
from lanewise.plans.policy import Policy
from lanewise.plans.providers import prefilter_outcome, with_prefilter

Backend = Callable[[DataFrame], DataFrame]


def spread(df: DataFrame) -> DataFrame:
    """Deals rows to all cores where the input has fewer splits than those; larger inputs stay as they are read.

    For plans that compute much per row: select the needed columns before.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df._jdf.queryExecution().executedPlan().outputPartitioning().numPartitions() > cores:
        return df
    return df.repartition(cores)


def prepare(requests: DataFrame, text_col: str = "text", messages_col: str | None = None, gate: str = "exact") -> DataFrame:
    """Adds excerpt, gate verdict, redacted excerpt and features.

    ``gate="native"`` keeps the plan in the JVM: it reads the text itself (no decoded variants, no
    suppression, no redaction) and is the pre-screen of the exact gate.
    """
    requests = spread(requests)
    messages = F.col(messages_col) if messages_col else None
    excerpt = text.excerpt_messages(messages) if messages_col else text.excerpt_text(F.col(text_col))
    df = requests.withColumn("excerpt", excerpt)
    if gate == "native":
        df = df.withColumn("gate", native_verdict(F.col("excerpt"))).withColumn("redacted", F.col("excerpt"))
    else:
        df = df.withColumn("checked", detectors.gate_and_redact(F.col("excerpt")))
        df = df.withColumns({"gate": F.col("checked.verdict"), "redacted": F.col("checked.text")}).drop("checked")
    return text.with_features(df, "redacted", "features", messages_col)


def native_verdict(excerpt: Column) -> Column:
    """Verdict from presence columns only (findings without span hashes)."""
    found = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(x.name).alias("detector"), F.lit(x.category).alias("category"), F.lit(x.floor).alias("sensitivity_floor"),
                    F.lit(x.force_local).alias("force_local"), F.lit(x.blocks).alias("blocks"), F.lit(x.advisory).alias("advisory"),
                    F.lit(x.pii).alias("pii"), detectors.fires(excerpt, x.name).alias("hit"),
                )
                for x in detectors.DETECTORS
            ]
        ),
        lambda f: f["hit"],
    )

    def verdict(found: Column) -> Column:
        hard = F.filter(found, lambda f: ~f["advisory"])
        level = F.array_max(F.transform(hard, lambda f: schema.level_index(f["sensitivity_floor"], schema.SENSITIVITY)))
        return F.struct(
            (F.size(found) > 0).alias("fired"),
            F.transform(
                found,
                lambda f: F.struct(f["detector"].alias("detector"), f["category"].alias("category"), f["sensitivity_floor"].alias("sensitivity_floor"), f["force_local"].alias("force_local"), F.lit(None).cast("string").alias("span_hash"), F.lit(1).alias("count")),
            ).alias("findings"),
            schema.level_at(level, schema.SENSITIVITY).alias("sensitivity_floor"),
            F.when(F.exists(hard, lambda f: f["pii"]), F.lit(1.0)).alias("pii_floor"),
            F.exists(hard, lambda f: f["force_local"]).alias("force_local"),
            F.exists(hard, lambda f: f["blocks"]).alias("blocks_backend"),
            F.transform(F.filter(found, lambda f: f["advisory"]), lambda f: f["detector"]).alias("advisory_topics"),
        )

    return decision.once(found, verdict)


def keyless(df: DataFrame) -> DataFrame:
    """The deterministic scorer, in the JVM."""
    return decision.with_answers(df, "redacted", "features", F.size("gate.advisory_topics"))


def trace_oracle(df: DataFrame) -> DataFrame:
    """Answers that make the default policy reproduce ``expected_tier``."""
    return df.withColumns(
        {
            "complexity": F.when(F.col("expected_tier") == "local", "trivial").when(F.col("expected_tier") == "strong", "hard").otherwise("standard"),
            "sensitivity": F.lit("public"),
            "domain": F.lit("chat"),
            "complexity_confidence": F.lit(0.99),
            "sensitivity_confidence": F.lit(0.99),
            "domain_confidence": F.lit(0.99),
            "pii": F.lit(0.0),
        }
    )


BACKENDS: dict[str, Backend] = {"keyless": keyless, "trace": trace_oracle}


def backend(name: str | Backend) -> Backend:
    if callable(name):
        return name
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; known: {sorted(BACKENDS)}")
    return BACKENDS[name]


def resolve(df: DataFrame, policy: Policy = Policy(), still_classify: bool = True) -> DataFrame:
    """Merge the gate, escalate where the answer is unsure, apply the rules.

    A ``semantic`` column (the second layer) raises the floor where it enforces; a ``single`` column (the tier
    pre-filter) decides its rows without the scorer's answer.
    """
    u, gate = policy.uncertainty, F.col("gate")
    skipped = F.lit(False) if still_classify else gate["blocks_backend"]
    if "single" in df.columns:
        skipped = skipped | F.col("single")
    floors = [gate["sensitivity_floor"], *([F.col("semantic.sensitivity_floor")] if "semantic" in df.columns else [])]
    if "degraded" not in df.columns:
        df = df.withColumn("degraded", F.lit(False))
    if policy.confidence_factor is not None:
        for c in ("complexity", "sensitivity", "domain"):
            df = df.withColumn(f"{c}_confidence", F.least(F.greatest(F.col(f"{c}_confidence") * policy.confidence_factor, F.lit(0.0)), F.lit(1.0)))
    df = df.withColumn("classified", ~skipped)
    # a blocked request is not sent to the scorer: its answers say only what the gate knows
    floor = F.coalesce(gate["sensitivity_floor"], F.lit("internal"))
    df = df.withColumns(
        {
            "complexity": F.when(skipped, schema.COMPLEXITY[len(schema.COMPLEXITY) // 2]).otherwise(F.col("complexity")),
            "sensitivity": F.when(skipped, floor).otherwise(F.col("sensitivity")),
            "complexity_confidence": F.when(skipped, 0.0).otherwise(F.col("complexity_confidence")),
            "sensitivity_confidence": F.when(skipped, 1.0).otherwise(F.col("sensitivity_confidence")),
        }
    )
    df = df.withColumns({"answer_complexity": F.col("complexity"), "answer_sensitivity": F.col("sensitivity"), "answer_pii": F.col("pii")})
    counts = F.col("classified") & ~F.col("degraded")
    df = df.withColumns(
        {
            "complexity": decision.escalated(F.col("complexity"), F.col("complexity_confidence"), u.complexity_below, u.complexity_bump, schema.COMPLEXITY, counts),
            "merged_sensitivity": decision.merged_sensitivity(F.col("sensitivity"), *floors),
            "pii": F.greatest("pii", gate["pii_floor"]),
        }
    )
    df = df.withColumn("sensitivity", decision.escalated(F.col("merged_sensitivity"), F.col("sensitivity_confidence"), u.sensitivity_below, u.sensitivity_bump, schema.SENSITIVITY, counts))
    top = len(schema.SENSITIVITY)
    df = df.withColumn("sensitivity", decision.escalated(F.col("sensitivity"), F.col("sensitivity_confidence"), u.force_local_below, top, schema.SENSITIVITY, counts))
    present = F.col("pii") >= policy.pii_threshold
    if u.pii_counts:
        present = present | (F.col("pii") >= u.pii_from)
    df = df.withColumn("pii_present", present)
    notes = F.array_compact(
        F.array(
            F.when(F.col("merged_sensitivity") != F.col("answer_sensitivity"), F.concat(F.lit("gate: sensitivity "), F.col("answer_sensitivity"), F.lit("->"), F.col("merged_sensitivity"))),
            F.when(F.col("complexity") != F.col("answer_complexity"), F.concat(F.lit("complexity "), F.col("answer_complexity"), F.lit("->"), F.col("complexity"))),
            F.when(F.col("sensitivity") != F.col("merged_sensitivity"), F.concat(F.lit("sensitivity "), F.col("merged_sensitivity"), F.lit("->"), F.col("sensitivity"))),
            F.when(F.col("pii_present") & (F.col("pii") < policy.pii_threshold), F.lit("pii treated as present")),
        )
    )
    df = df.withColumn("escalations", notes).withColumn("decided", policy.decide(_namespace(df)))
    if policy.min_confidence is not None:
        unsure = F.col("classified") & (F.col("complexity_confidence") < policy.min_confidence)
        other = policy.fallback(F.col("decided.tier"), F.col("decided.model"))
        df = df.withColumn("uncertain", unsure)
        df = df.withColumn("decided", F.when(unsure, F.col("decided").withField("tier", other["tier"]).withField("model", other["model"])).otherwise(F.col("decided")))
    if "single" in df.columns:
        df = df.withColumn("decided", F.when(F.col("single"), prefilter_outcome(policy)).otherwise(F.col("decided")))
    broken = F.col("degraded") & F.col("classified")
    tier = F.when(broken, policy.failure_tier(gate["sensitivity_floor"], gate["force_local"])).otherwise(F.col("decided.tier"))
    rule = F.when(broken, "backend.down").otherwise(F.col("decided.rule_id"))
    return df.withColumns({"tier": tier, "model": F.col("decided.model"), "rule_id": rule, "reason": F.col("decided.reason")}).drop("decided")


def _namespace(df: DataFrame) -> dict[str, Column]:
    """What rules may read; a name that the input does not carry is null."""
    gate, f = F.col("gate"), F.col("features")
    out = {
        "gate_fired": gate["fired"],
        "gate_force_local": gate["force_local"] | F.col("semantic.enforced") if "semantic" in df.columns else gate["force_local"],
        "gate_blocks_backend": gate["blocks_backend"],
        "gate_sensitivity_floor": gate["sensitivity_floor"],
        "n_gate_findings": F.size(gate["findings"]),
        "advisory_topics": gate["advisory_topics"],
    }
    known = df.schema["features"].dataType.fieldNames() if "features" in df.columns else []
    out |= {name: f[name] for name in known}
    out |= {c: F.col(c) for c in df.columns if c not in out}
    from lanewise.plans.policy import VARIABLES

    return {v: out.get(v, F.lit(None)) for v in VARIABLES}


def route(requests: DataFrame, policy: Policy = Policy(), scorer: str | Backend = "keyless", text_col: str = "text", messages_col: str | None = None, gate: str = "exact", still_classify: bool = True, semantic: dict | None = None) -> DataFrame:
    """One decision per request.  ``semantic`` holds the second layer's settings (weights, bias, threshold, mode)."""
    df = prepare(requests, text_col, messages_col, gate)
    if semantic is not None:
        df = layer.assess(df, **semantic)
    if policy.prefilter:
        df = with_prefilter(df, policy, semantic_local=F.col("semantic.enforced") if semantic is not None else None)
    return resolve(backend(scorer)(df), policy, still_classify)


def with_round_robin(decisions: DataFrame, policy: Policy, order: str) -> DataFrame:
    """Models dealt in turn within each tier, in the order of a column."""
    place = F.row_number().over(Window.partitionBy("tier").orderBy(order)) - 1
    return decisions.withColumn("model", policy.round_robin(F.col("tier"), place))


def decision_records(decisions: DataFrame, backend_name: str = "keyless", policy: Policy = Policy()) -> DataFrame:
    """Log rows of decisions: no raw text, the redacted excerpt only."""
    has = set(decisions.columns)
    opt = lambda c, kind, default=None: (F.col(c) if c in has else F.lit(default)).cast(kind).alias(c)
    return decisions.select(
        F.lit(schema.DECISION).alias("kind"),
        F.lit(schema.SCHEMA_VERSION).alias("schema_version"),
        F.col("request_id"),
        opt("timestamp", "string"),
        text.hash_text(F.col("excerpt")).alias("excerpt_hash"),
        F.when(F.col("gate.blocks_backend"), F.lit(None)).otherwise(F.col("redacted")).alias("excerpt"),
        F.when(F.col("classified"), backend_name).otherwise("gate").alias("backend"),
        F.lit(policy.version).alias("policy_version"),
        "tier", "model", "rule_id", "complexity", "sensitivity", "complexity_confidence", "sensitivity_confidence", "pii",
        opt("domain", "string"), "gate", "escalations", opt("latency_ms", "double", 0.0), "degraded", "classified", opt("cached", "boolean", False),
    )


def refusal_records(decisions: DataFrame) -> DataFrame:
    """Text-free rows of blocked requests, for a stream of their own."""
    counts = F.map_from_entries(F.transform("gate.findings", lambda f: F.struct(f["detector"], f["count"])))
    return decisions.where("gate.blocks_backend").select(
        F.lit(schema.REFUSAL).alias("kind"), F.lit(schema.SCHEMA_VERSION).alias("schema_version"), "request_id",
        (F.col("timestamp") if "timestamp" in decisions.columns else F.lit(None)).cast("string").alias("timestamp"), counts.alias("detectors"), F.col("gate.sensitivity_floor").alias("sensitivity_floor"),
    )
