"""Decision mathematics over fixed-order probability arrays, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.schema import COMPLEXITY, DOMAINS, SENSITIVITY, bump, level_index

# Temperature and marker tables of the keyless scorer.
TEMPERATURE = 0.55
COMPLEXITY_MARKERS = (
    (r"\b(?:prove|proof|derive|show that)\b", 1.5),
    (r"\b(?:design|architect|architecture)\b", 1.2),
    (r"\b(?:optimi[sz]e|performance|bottleneck|p9[59]|latency)\b", 1.0),
    (r"\b(?:trade[- ]?offs?|compare and contrast|evaluate the)\b", 1.0),
    (r"\b(?:debug|root cause|why is|intermittent|race condition|deadlock)\b", 1.1),
    (r"\b(?:migrat|refactor|distributed|consensus|sharding|concurrency)\b", 1.2),
    (r"\b(?:research|survey|literature|state of the art)\b", 1.3),
    (r"\b(?:translate|rewrite|rephrase|fix the typo|summariz)\b", -1.2),
    (r"\b(?:hello|hi|hey|thanks|thank you|ok|okay)\b", -1.8),
    (r"\b(?:what is|define|list|name)\b", -0.7),
)
SENSITIVITY_MARKERS = (
    (r"\b(?:patient|health|medical|clinical|diagnos|prescription)\b", 1.1),
    (r"\b(?:gdpr|hipaa|pci|dsgvo|compliance|regulat)\b", 0.8),
    (r"\b(?:salary|compensation|performance review|layoff|hr case)\b", 1.0),
    (r"\b(?:secret|credential|password|api key|token|vulnerability|cve)\b", 1.1),
    (r"\b(?:nda|confidential|trade secret|unreleased|internal only)\b", 0.9),
    (r"\b(?:bank|account number|invoice|payment|billing)\b", 0.5),
    (r"\b(?:public blog|documentation|readme|open source|announce)\b", -1.0),
    (r"\b(?:weather|joke|recipe|poem|trivia)\b", -1.3),
)
ABOUT_MARKERS = (
    (r"\bexplain (?:how|what|why)\b", -1.6),
    (r"\bwhat (?:is|are|does|do)\b.{0,60}\b(?:require|mean|apply|cover|count)\b", -1.5),
    (r"\bhow does .{0,40} work\b", -1.5),
    (r"\bwho it applies to\b|\bapplies to whom\b", -1.4),
    (r"\b(?:primer|intro|introduction|overview|guide|tutorial|cheat ?sheet|faq)\b", -1.3),
    (r"\bwhat everyone gets wrong\b|\bcommon misconceptions?\b", -1.2),
    (r"\bdo i need to comply\b|\bare we compliant\b", -0.9),
    (r"\bwhat should\b.{0,50}\b(?:say|read|look like|be|include)\b", -1.2),
    (r"\bwhat copy should\b|\bwhat wording\b|\bwhat should the (?:copy|text|banner)\b", -1.2),
)
DOMAIN_MARKERS = (
    (r"\b(?:code|function|class|bug|test|refactor|compile|stack trace|regex|api)\b", "code", 1.4),
    (r"\b(?:write|draft|blog|email to|copy|essay|rephrase|tone|headline)\b", "writing", 1.3),
    (r"\b(?:analy[sz]e|compare|calculate|estimate|forecast|why|evaluate|metrics)\b", "analysis", 1.2),
    (r"\b(?:extract|parse|json|csv|table|scrape|convert)\b", "data-extraction", 1.3),
    (r"\b(?:hello|hi|hey|how are you|thanks|chat|talk)\b", "chat", 1.2),
)
ECE_BINS = 15


def d(x: float) -> Column:
    return F.lit(float(x))


def once(value: Column, f) -> Column:
    """``f(value)`` with ``value`` bound once, so that Catalyst does not repeat its expression."""
    return F.element_at(F.transform(F.array(value), f), 1)


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def softmax(scores: Column, temperature: float = TEMPERATURE) -> Column:
    def scaled(s: Column) -> Column:
        return once(F.transform(s, lambda x: F.exp(x / temperature - F.array_max(s) / temperature)), lambda e: F.transform(e, lambda x: F.round(x / total(e), 6)))

    return once(scores, scaled)


def argmax(p: Column, names: Sequence[str]) -> Column:
    """Name of the largest entry, the first of equals."""
    return once(p, lambda q: F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(q, F.array_max(q)).cast("int")))


def margin(p: Column) -> Column:
    """Largest less second largest entry."""
    return once(F.sort_array(p, asc=False), lambda q: F.round(F.least(F.greatest(q[0] - q[1], d(0)), d(1)), 6))


def certainty(p: Column) -> Column:
    """1 - entropy / ln(n) over the positive entries; n counts all."""

    def of(q: Column) -> Column:
        entropy = F.aggregate(F.filter(q, lambda x: x > 0), F.lit(0.0), lambda a, x: a - x * F.ln(x))
        n = F.size(q)
        return F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(F.least(F.greatest(1 - entropy / F.ln(n.cast("double")), d(0)), d(1)))

    return once(p, of)


def renormalized(p: Column) -> Column:
    return once(p, lambda q: once(total(q), lambda t: F.when(t > 0, F.transform(q, lambda x: x / t)).otherwise(F.transform(q, lambda x: 1.0 / F.size(q)))))


def soften(p: Column, temperature: float) -> Column:
    return renormalized(F.transform(p, lambda x: F.pow(x, F.lit(1.0 / temperature))))


def with_temperature(p: Column, temperature: float, eps: float = 1e-12) -> Column:
    """softmax(log p / T)."""
    return renormalized(F.transform(p, lambda x: F.exp(F.ln(F.greatest(x, d(eps))) / temperature)))


def binary_temperature(p: Column, temperature: float, eps: float = 1e-12) -> Column:
    yes = F.exp(F.ln(F.greatest(p, d(eps))) / temperature)
    no = F.exp(F.ln(F.greatest(1 - p, d(eps))) / temperature)
    return yes / (yes + no)


def sigmoid(z: Column) -> Column:
    return 0.5 * (1 + F.tanh(z / 2))


def binary_confidence(p: Column) -> Column:
    return F.abs(2 * p - 1)


def isotonic(x: Column, breaks: Sequence[float], values: Sequence[float]) -> Column:
    """Value at the largest break not above x; the first value below all breaks."""
    if not breaks:
        return x
    pairs = F.array(*[F.struct(d(b).alias("b"), d(v).alias("v")) for b, v in sorted(zip(breaks, values, strict=True))])
    return F.coalesce(F.array_max(F.filter(pairs, lambda p: p["b"] <= x))["v"], F.element_at(pairs, 1)["v"])


def kl(p: Column, q: Column, eps: float = 1e-12) -> Column:
    return total(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * (F.ln(a) - F.ln(F.greatest(b, d(eps))))).otherwise(0.0)))


def brier(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: (a - b) * (a - b)))


def total_variation(p: Column, q: Column) -> Column:
    return 0.5 * total(F.zip_with(p, q, lambda a, b: F.abs(a - b)))


def ece_bin(confidence: Column, bins: int = ECE_BINS) -> Column:
    """Bin of a confidence: floor, the last bin closed."""
    return F.least(F.floor(F.least(F.greatest(confidence, d(0)), d(1)) * bins), F.lit(bins - 1)).cast("int")


def ece_bin_right(confidence: Column, bins: int = ECE_BINS) -> Column:
    """Bin of a right-closed binning (lo, hi]; null at 0."""
    return F.when(confidence > 0, (F.ceil(confidence * bins) - 1).cast("int"))


# ------------------------------------------------------------ the keyless scorer


def marker_score(text: Column, markers) -> Column:
    return sum((F.when(text.rlike("(?i)" + p), d(w)).otherwise(d(0)) for p, w in markers), d(0))


def nudge(text: Column) -> Column:
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / d(4294967295) - 0.5) * 0.6


def complexity_scores(text: Column, f: Column) -> Column:
    least = lambda c, most: F.least(c, F.lit(most)).cast("double")
    score = (
        marker_score(F.lower(text), COMPLEXITY_MARKERS)
        + F.least(d(2), F.log1p(f["char_len"].cast("double")) / 4)
        + 0.8 * least(f["code_blocks"], 3)
        + F.when(f["has_stack_trace"], 0.6).otherwise(0.0)
        + F.when(f["has_diff"], 0.4).otherwise(0.0)
        + 0.3 * least(f["question_marks"], 4)
        + 0.2 * least(f["n_prior_turns"], 4)
        - F.when(f["char_len"] < 40, 1.2).otherwise(0.0)
        + nudge(text)
    )
    return once(score, lambda s: F.array(-s * 1.1, 1.0 - F.abs(s - 1.0) * 0.75, s - 1.4, s - 3.1))


def sensitivity_scores(text: Column, n_topics: Column) -> Column:
    low = F.lower(text)
    score = marker_score(low, SENSITIVITY_MARKERS) + marker_score(low, ABOUT_MARKERS) + 0.3 * n_topics.cast("double") + nudge(text) * 0.5
    return once(score, lambda s: F.array(-s * 1.0 + 0.9, 1.1 - F.abs(s - 1.1) * 0.7, s - 1.2, s - 2.6))


def domain_scores(text: Column, f: Column) -> Column:
    extra = {
        "code": F.when((f["code_blocks"] > 0) | (f["inline_code_spans"] > 0), 1.2).otherwise(0.0) + F.when(f["has_stack_trace"], 0.8).otherwise(0.0),
        "data-extraction": F.when(f["has_json"] | (f["urls"] > 0), 0.8).otherwise(0.0),
        "chat": F.when((f["char_len"] < 60) & (f["question_marks"] == 0), 0.9).otherwise(0.0),
    }
    score = {name: d(0.35) + extra.get(name, d(0)) for name in DOMAINS}
    for pattern, name, weight in DOMAIN_MARKERS:
        score[name] = score[name] + F.when(text.rlike("(?i)" + pattern), d(weight)).otherwise(d(0))
    return F.array(*[score[name] for name in DOMAINS])


def with_answers(df, text: str = "excerpt", features: str = "features", topics: Column | None = None):
    """Adds the keyless scorer's answers: *_p arrays, choices, confidences and pii."""
    topics = F.lit(0) if topics is None else topics
    df = df.withColumn("complexity_p", softmax(complexity_scores(F.col(text), F.col(features))))
    df = df.withColumn("sensitivity_p", softmax(sensitivity_scores(F.col(text), topics)))
    df = df.withColumn("domain_p", softmax(domain_scores(F.col(text), F.col(features))))
    mass = F.col("sensitivity_p")[2] + F.col("sensitivity_p")[3]
    return df.withColumns(
        {
            "complexity": argmax(F.col("complexity_p"), COMPLEXITY),
            "sensitivity": argmax(F.col("sensitivity_p"), SENSITIVITY),
            "domain": argmax(F.col("domain_p"), DOMAINS),
            "complexity_confidence": margin(F.col("complexity_p")),
            "sensitivity_confidence": margin(F.col("sensitivity_p")),
            "domain_confidence": margin(F.col("domain_p")),
            "pii": F.round(F.greatest(d(0.01), F.least(d(0.99), mass * 0.9)), 6),
        }
    )


# ------------------------------------------------------------ merging and escalation


def merged_sensitivity(answer: Column, *floors: Column) -> Column:
    """The stricter of an answer and the gate's floors (null floors do not count)."""
    at = F.greatest(level_index(answer, SENSITIVITY), *[F.when(f.isNotNull(), level_index(f, SENSITIVITY)) for f in floors])
    return F.when(at < 0, answer).otherwise(F.element_at(F.array(*[F.lit(s) for s in SENSITIVITY]), at + 1))


def escalated(level: Column, confidence: Column, below: float | None, by: int, ladder, counts: Column) -> Column:
    if below is None:
        return level
    return F.when(counts & (confidence < below), bump(level, by, ladder)).otherwise(level)


def classify_error(expected: Column, predicted: Column, risk=("local", "cheap", "strong")) -> Column:
    at = lambda c: F.when(level_index(c, risk) >= 0, level_index(c, risk)).otherwise(len(risk))
    return (
        F.when(expected == predicted, "correct")
        .when(expected == "local", "unsafe")
        .when(predicted == "local", "expensive")
        .when(at(predicted) > at(expected), "overspend")
        .otherwise("underpowered")
    )


def gate_label(findings: Column) -> Column:
    """Canonical verdict string: clean, or blocks:/local:/fires: and the sorted detectors."""
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(findings["findings"], lambda f: f["detector"]))), ",")
    kind = F.when(findings["blocks_backend"], "blocks:").when(findings["force_local"], "local:").otherwise("fires:")
    return F.when(~findings["fired"], "clean").otherwise(F.concat(kind, names))
