"""Routing policies: a whitelisted expression language compiled to Catalyst columns."""

from __future__ import annotations

import ast
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.schema import TIERS

#: Variables that rules may read.
VARIABLES = (
    "complexity", "sensitivity", "domain", "pii", "pii_present", "complexity_confidence", "sensitivity_confidence", "domain_confidence",
    "gate_fired", "gate_force_local", "gate_blocks_backend", "gate_sensitivity_floor", "n_gate_findings", "advisory_topics",
    "char_len", "word_count", "line_count", "code_blocks", "urls", "question_marks", "has_stack_trace", "has_diff", "has_json", "lang",
    "n_messages", "n_prior_turns", "tool_output_present", "degraded", "classified", "metadata", "requested_model",
)


class PolicyError(ValueError):
    """A policy that must not be deployed."""


_COMPARE = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}
_ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b}


class _Compiler:
    """Turns a rule's syntax tree into a Column; whatever is not listed here is refused."""

    def __init__(self, source: str, columns: Mapping[str, Column]):
        self.source, self.columns = source, columns

    def refuse(self, node: ast.AST):
        raise PolicyError(f"not allowed in {self.source!r}: {type(node).__name__}")

    def __call__(self, node: ast.AST) -> Any:
        method = getattr(self, "on_" + type(node).__name__.lower(), None)
        return method(node) if method else self.refuse(node)

    def on_expression(self, node):
        return self(node.body)

    def on_constant(self, node):
        if node.value is not None and not isinstance(node.value, (bool, int, float, str)):
            self.refuse(node)
        return F.lit(node.value)

    def on_name(self, node):
        if node.id not in self.columns:
            raise PolicyError(f"unknown name {node.id!r} in {self.source!r}")
        return self.columns[node.id]

    def on_boolop(self, node):
        parts = [self(v) for v in node.values]
        return reduce((lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b), parts)

    def on_unaryop(self, node):
        if isinstance(node.op, ast.Not):
            return ~self(node.operand)
        return -self(node.operand) if isinstance(node.op, ast.USub) else self.refuse(node.op)

    def on_binop(self, node):
        op = _ARITHMETIC.get(type(node.op)) or self.refuse(node.op)
        return op(self(node.left), self(node.right))

    def on_subscript(self, node):
        return F.try_element_at(self(node.value), self(node.slice))

    def on_compare(self, node):
        left, out = node.left, None
        for op, right in zip(node.ops, node.comparators, strict=True):
            part = self._compare(op, left, right)
            out, left = part if out is None else out & part, right
        return out

    def _compare(self, op, left, right):
        if isinstance(op, (ast.In, ast.NotIn)):
            if isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                found = self(left).isin(*[self(x) for x in right.elts])
            else:
                found = F.array_contains(self(right), self(left))
            return ~found if isinstance(op, ast.NotIn) else found
        return (_COMPARE.get(type(op)) or self.refuse(op))(self(left), self(right))


def parse_expression(source: str) -> ast.Expression:
    try:
        return ast.parse(source, mode="eval")
    except SyntaxError as error:
        raise PolicyError(f"cannot read {source!r}") from error


def compile_expression(source: str, columns: Mapping[str, Column] | None = None) -> Column:
    """A boolean Column for a rule; null counts as false."""
    columns = columns if columns is not None else {v: F.col(v) for v in VARIABLES}
    return F.coalesce(_Compiler(source, columns)(parse_expression(source)), F.lit(False))


@dataclass(frozen=True)
class Rule:
    id: str
    tier: str
    condition: str | None = None
    model: str | None = None
    reason: str = ""


@dataclass(frozen=True)
class Uncertainty:
    sensitivity_below: float | None = 0.8
    sensitivity_bump: int = 1
    complexity_below: float | None = 0.7
    complexity_bump: int = 1
    pii_from: float = 0.35
    pii_counts: bool = True
    force_local_below: float | None = 0.25


@dataclass(frozen=True)
class Failure:
    mode: str = "fail_closed"
    closed_tier: str = "local"
    open_tier: str = "strong"


# The default rules in order, prices and tier limits.
DEFAULT_RULES = (
    Rule("gate.force-local", "local", "gate_force_local", reason="local hard gate matched a structured identifier or credential"),
    Rule("data.sensitive", "local", 'sensitivity in ["confidential", "regulated"] or pii_present', reason="sensitive or personal data must not leave the infrastructure"),
    Rule("complexity.frontier", "strong", 'complexity == "frontier"', reason="task needs frontier-class reasoning"),
    Rule("complexity.hard", "strong", 'complexity == "hard"', reason="task needs a strong model"),
    Rule("default", "cheap", reason="routine task, no sensitivity signal"),
)
PRICES = {"local": 0.0, "cheap": 0.0003, "strong": 0.003, "frontier": 0.015}
TIER_LIMITS = {
    "local": {"max_tokens": 8_192, "capabilities": ()},
    "cheap": {"max_tokens": 131_072, "capabilities": ("json",)},
    "strong": {"max_tokens": 1_000_000, "capabilities": ("json", "tools", "vision")},
}
CLOUD_TIERS = ("cheap", "strong")


@dataclass(frozen=True)
class Policy:
    version: int = 1
    tiers: Mapping[str, Sequence[str]] = field(default_factory=lambda: {t: (f"{t}-model",) for t in TIERS})
    tier_order: Sequence[str] = ("cheap", "strong")
    rules: Sequence[Rule] = DEFAULT_RULES
    pii_threshold: float = 0.5
    uncertainty: Uncertainty = Uncertainty()
    failure: Failure = Failure()
    prices: Mapping[str, float] = field(default_factory=lambda: dict(PRICES))
    prefilter: Mapping[str, Any] = field(default_factory=dict)
    min_confidence: float | None = None
    uncertain_fallback: str = "hold_middle"
    confidence_factor: float | None = None
    routing_mode: str = "on"

    def __post_init__(self):
        if not self.tiers or any(not models for models in self.tiers.values()):
            raise PolicyError("every tier needs a model")
        if unknown := [t for t in self.tier_order if t not in self.tiers]:
            raise PolicyError(f"tier_order names unknown tiers {unknown}")
        if not self.rules or self.rules[-1].condition is not None:
            raise PolicyError("the last rule must be the default, without a condition")
        if any(r.condition is None for r in self.rules[:-1]):
            raise PolicyError("only the last rule may have no condition")
        if len({r.id for r in self.rules}) != len(self.rules):
            raise PolicyError("rule ids must differ")
        for r in self.rules:
            if r.tier not in self.tiers:
                raise PolicyError(f"rule {r.id} names unknown tier {r.tier!r}")
            if r.condition is not None:
                compile_names(r.condition)
        if min(self.uncertainty.sensitivity_bump, self.uncertainty.complexity_bump) < 0:
            raise PolicyError("bumps must not be negative")
        if self.failure.mode not in ("fail_closed", "fail_open"):
            raise PolicyError(f"unknown failure mode {self.failure.mode!r}")
        if {self.failure.closed_tier, self.failure.open_tier} - set(self.tiers):
            raise PolicyError("failure tiers must exist")
        if self.confidence_factor is not None and not 0 <= self.confidence_factor < float("inf"):
            raise PolicyError("the confidence factor must be finite and not negative")

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> Policy:
        """A policy from a parsed document (YAML or JSON)."""
        rules = []
        for i, r in enumerate(raw.get("rules", ())):
            then = r.get("then", {})
            tier, model = then.get("tier"), then.get("model")
            if tier is None and model is not None:
                tier = next((t for t, models in raw.get("tiers", {}).items() if model in models), None)
            rules.append(Rule(str(r.get("id", f"rule-{i}")), tier, r.get("if"), model, r.get("reason", "")))
        u, f, routing = raw.get("on_uncertain", {}), raw.get("on_failure", {}), raw.get("routing", {})
        base = Uncertainty()
        uncertainty = Uncertainty(
            u.get("sensitivity_confidence_below", base.sensitivity_below), u.get("sensitivity_bump_levels", base.sensitivity_bump),
            u.get("complexity_confidence_below", base.complexity_below), u.get("complexity_bump_levels", base.complexity_bump),
            u.get("pii_uncertain_threshold", base.pii_from), u.get("pii_uncertain_counts_as_present", base.pii_counts),
            u.get("force_local_confidence_below", base.force_local_below),
        )
        failure = Failure(f.get("mode", "fail_closed"), f.get("fail_closed_tier", "local"), f.get("fail_open_tier", "strong"))
        default = cls()
        return cls(
            version=int(raw.get("version", 1)),
            tiers={k: tuple(v) for k, v in raw.get("tiers", default.tiers).items()},
            tier_order=tuple(raw.get("tier_order", default.tier_order)),
            rules=tuple(rules) or DEFAULT_RULES,
            pii_threshold=raw.get("pii_threshold", 0.5),
            uncertainty=uncertainty,
            failure=failure,
            prices=PRICES | dict(raw.get("pricing", {})),
            prefilter=raw.get("prefilter", {}),
            min_confidence=routing.get("min_confidence"),
            uncertain_fallback=routing.get("uncertain_fallback") or "hold_middle",
            confidence_factor=routing.get("confidence_factor"),
            routing_mode=str(routing.get("mode", "on")),
        )

    @classmethod
    def from_yaml(cls, text: str) -> Policy:
        import yaml

        return cls.from_dict(yaml.safe_load(text) or {})

    def with_backend_floor(self, **changes) -> Policy:
        return replace(self, **changes)

    def decide(self, columns: Mapping[str, Column] | None = None) -> Column:
        """struct<rule_id, tier, model, reason> of the first rule that matches."""
        out = self._outcome(self.rules[-1])
        for rule in reversed(self.rules[:-1]):
            out = F.when(compile_expression(rule.condition, columns), self._outcome(rule)).otherwise(out)
        return out

    def _outcome(self, rule: Rule) -> Column:
        model = rule.model or self.tiers[rule.tier][0]
        return F.struct(*[F.lit(v).alias(k) for k, v in (("rule_id", rule.id), ("tier", rule.tier), ("model", model), ("reason", rule.reason))])

    def round_robin(self, tier: Column, position: Column) -> Column:
        """Model of a tier by the request's position (from 0) among those of the tier."""
        out = F.lit(None).cast("string")
        for name, models in self.tiers.items():
            out = F.when(tier == name, F.element_at(F.array(*[F.lit(m) for m in models]), (position % len(models) + 1).cast("int"))).otherwise(out)
        return out

    def failure_tier(self, floor: Column, force_local: Column) -> Column:
        """Tier when no answer came: an open failure never outranks the gate."""
        if self.failure.mode == "fail_closed":
            return F.lit(self.failure.closed_tier)
        strict = F.coalesce(floor.isin("confidential", "regulated"), F.lit(False)) | force_local
        return F.when(strict, self.failure.closed_tier).otherwise(self.failure.open_tier)

    def fallback(self, tier: Column, model: Column) -> Column:
        """struct<tier, model> for a decision below the least confidence."""
        value = self.uncertain_fallback
        if value in ("", "hold_middle"):
            return F.struct(tier.alias("tier"), model.alias("model"))
        if value == "cheapest_local":
            name = "local" if "local" in self.tiers else self.tier_order[0]
        elif value == "frontier":
            name = self.tier_order[-1]
        else:
            return F.struct(F.lit("uncertain").alias("tier"), F.lit(value).alias("model"))
        return F.struct(F.lit(name).alias("tier"), F.lit(self.tiers[name][0]).alias("model"))

    def surviving_tiers(self, excerpt: Column, blocks: Column, semantic_local: Column | None = None, required: Sequence[str] = ()) -> Column:
        """array<struct<tier, reason>>: reason is null for a tier that can serve; the first failing reason wins."""
        config = self.prefilter
        tokens = F.greatest(F.lit(1), F.floor(F.length(excerpt) / 4).cast("int") + 1)
        allow, deny, spent = config.get("allow_tiers", tuple(self.tiers)), config.get("deny_tiers", ()), config.get("quota_exhausted", ())
        needed = {*required, *config.get("required_capabilities", ())}
        semantic_local = F.lit(False) if semantic_local is None else semantic_local
        rows = []
        for tier in self.tiers:
            limits = {"max_tokens": 0, "capabilities": (), **TIER_LIMITS.get(tier, {}), **(config.get("tier_limits", {}).get(tier) or {})}
            missing = sorted(needed - set(limits["capabilities"]))
            cloud = F.lit(tier in CLOUD_TIERS)
            reason = (
                F.when(F.lit(tier not in allow), "not in allow_tiers")
                .when(F.lit(tier in deny), "in deny_tiers")
                .when(F.lit(tier in spent), "quota exhausted")
                .when(blocks & cloud, "sensitivity floor (gate blocks cloud)")
                .when(semantic_local & cloud, "sensitivity floor (semantic layer forces local)")
                .when(F.lit(bool(limits["max_tokens"])) & (tokens > F.lit(int(limits["max_tokens"]))), F.concat(F.lit("context window < ~"), tokens.cast("string"), F.lit(" tokens")))
                .when(F.lit(bool(missing)), f"missing capabilities: {missing}")
            )
            rows.append(F.struct(F.lit(tier).alias("tier"), reason.alias("reason")))
        return F.array(*rows)


def compile_names(source: str) -> None:
    """Refuse an expression that reads or does anything not allowed, without a Spark session."""
    allowed = (
        ast.Expression, ast.Constant, ast.Name, ast.Load, ast.BoolOp, ast.And, ast.Or, ast.UnaryOp, ast.Not, ast.USub, ast.BinOp, ast.Add, ast.Sub,
        ast.Mult, ast.Compare, ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.In, ast.NotIn, ast.List, ast.Tuple, ast.Set, ast.Subscript,
    )
    for node in ast.walk(parse_expression(source)):
        if not isinstance(node, allowed):
            raise PolicyError(f"not allowed in {source!r}: {type(node).__name__}")
        if isinstance(node, ast.Name) and node.id not in VARIABLES:
            raise PolicyError(f"unknown name {node.id!r} in {source!r}")
