"""Providers behind the tiers: quota, tandem models, provider flips, pass-through, and the client seam for a decision service."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.plans.policy import Policy

# What marks a quota error, names that ask for routing, retry delays and statuses.
QUOTA_MARKERS = ("429", "quota")
ROUTED_NAMES = ("", "auto", "lanewise/auto")
RETRY_BASE, RETRY_MOST, RETRY_STATUSES = 0.2, 2.0, (408, 409, 425, 429, 500, 502, 503, 504)


def is_quota_error(reason: Column) -> Column:
    """Whether a degradation means that the provider is out of capacity, not that it is down."""
    return F.coalesce(F.lower(reason).rlike("|".join(QUOTA_MARKERS)), F.lit(False))


def is_bypass(requested_model: Column, policy: Policy, pinned: bool = False) -> Column:
    """Requests that pass through unrouted: routing is off, or they pin a model and the policy lets them."""
    if policy.routing_mode == "off":
        return F.lit(True)
    return F.coalesce(~requested_model.isin(*ROUTED_NAMES), F.lit(False)) if pinned else F.lit(False)


def managed_models(raw: str | Sequence[str] | None, default: str = "*") -> frozenset[str]:
    """Names of a comma list; none given means every model."""
    items = raw if isinstance(raw, str) else ",".join(raw or ())
    return frozenset(x.strip() for x in items.split(",") if x.strip()) or frozenset({default})


def is_managed(model: Column, managed: frozenset[str]) -> Column:
    return F.lit(True) if "*" in managed else F.coalesce(model.isin(*sorted(managed)), F.lit(False))


def safety_ranking(policy: Policy, declared: Sequence[str] = ()) -> tuple[str, ...]:
    """Tiers from the safest on: where failures close to, the policy's order, its other tiers, then declared ones."""
    first = [policy.failure.closed_tier] if policy.failure.closed_tier in policy.tiers else []
    return tuple(dict.fromkeys([*first, *policy.tier_order, *policy.tiers, *declared]))


def bumped_tier(tier: Column, policy: Policy, steps: int = 1) -> Column:
    """The tier some steps up the policy's order; tiers off the order stay."""
    order, out = list(policy.tier_order), tier
    for i, name in enumerate(order):
        out = F.when(tier == name, order[max(0, min(len(order) - 1, i + steps))]).otherwise(out)
    return out


def tandem_model(tier: Column, tandem: Mapping[str, str], policy: Policy) -> Column:
    """The model that stands in for a tier whose provider is out of capacity; its own first model without one."""
    out = F.lit(None).cast("string")
    for name, models in policy.tiers.items():
        out = F.when(tier == name, tandem.get(name) or models[0]).otherwise(out)
    return out


# ------------------------------------------------------------ tier pre-filter


def with_prefilter(df: DataFrame, policy: Policy, excerpt: str = "excerpt", semantic_local: Column | None = None, spent: Column | None = None) -> DataFrame:
    """Adds ``surviving`` (tiers that can serve), ``removed`` (tier, reason) and ``single``: one tier left, and the gate silent.

    ``spent`` is an array of tiers that are out of quota for this row, beside the policy's own list.
    """
    gate = F.col("gate")
    blocks = gate["blocks_backend"] | gate["force_local"]
    semantic = F.lit(False) if semantic_local is None else semantic_local
    df = df.withColumn("_tiers", policy.surviving_tiers(F.col(excerpt), blocks, semantic))
    if spent is not None:
        out = lambda t: F.when(F.array_contains(spent, t["tier"]) & t["reason"].isNull(), "quota exhausted").otherwise(t["reason"])
        df = df.withColumn("_tiers", F.transform("_tiers", lambda t: F.struct(t["tier"].alias("tier"), out(t).alias("reason"))))
    left = F.transform(F.filter("_tiers", lambda t: t["reason"].isNull()), lambda t: t["tier"])
    df = df.withColumns({"surviving": left, "removed": F.filter("_tiers", lambda t: t["reason"].isNotNull())}).drop("_tiers")
    return df.withColumn("single", (F.size("surviving") <= 1) & ~(blocks | semantic))


def prefilter_outcome(policy: Policy) -> Column:
    """struct<rule_id, tier, model, reason> of a row whose pre-filter left one tier, or none: then the fallback tier."""
    fallback = str(policy.prefilter.get("fallback_tier", "local"))
    tier = F.coalesce(F.try_element_at("surviving", F.lit(1)), F.lit(fallback))
    model = F.lit(None).cast("string")
    for name, models in policy.tiers.items():
        model = F.when(tier == name, models[0]).otherwise(model)
    reason = F.when(tier == fallback, "no viable tier after deterministic prefilter; failed closed to local fallback").otherwise(
        "single viable tier after deterministic prefilter; backend call skipped"
    )
    return F.struct(F.lit("prefilter.single_candidate").alias("rule_id"), tier.alias("tier"), model.alias("model"), reason.alias("reason"))


# ------------------------------------------------------------ quota


def quota_marks(rows: DataFrame, order: str, tier: str = "tier", reason: str = "degrade_reason") -> DataFrame:
    """(tier, since): the first quota error of each tier.  One row per tier, so it may be broadcast."""
    return rows.where(is_quota_error(F.col(reason))).groupBy(tier).agg(F.min(order).alias("since"))


def with_quota(rows: DataFrame, policy: Policy, tandem: Mapping[str, str], order: str, tier: str = "tier", reason: str = "degrade_reason", alternate: str | None = None) -> DataFrame:
    """Serves rows with a quota error from elsewhere, and tells which tiers were spent before each row.

    ``alternate`` is the answer of the same model at another provider (a boolean column: it served), tried first; then
    the tier's tandem model stands in.  ``spent`` lists tiers whose quota ended in an earlier row.
    """
    marks = quota_marks(rows, order, tier, reason)
    # as many rows as tiers at most
    known = marks.agg(F.collect_list(F.struct(F.col(tier).alias("tier"), "since")).alias("_marks"))
    rows = rows.crossJoin(F.broadcast(known))
    spent = F.array_sort(F.transform(F.filter("_marks", lambda m: m["since"] < F.col(order)), lambda m: m["tier"]))
    hit = is_quota_error(F.col(reason))
    flipped = hit & (F.col(alternate) if alternate else F.lit(False))
    how = F.when(flipped, "provider flip").when(hit & (tandem_model(F.col(tier), tandem, policy) != tandem_model(F.col(tier), {}, policy)), "tandem").when(hit, "no tandem")
    model = F.when(hit & ~flipped, tandem_model(F.col(tier), tandem, policy)).otherwise(tandem_model(F.col(tier), {}, policy))
    return rows.withColumns({"spent": spent, "quota_served": how, "model": model}).drop("_marks")


# ------------------------------------------------------------ client of a decision service


class Unavailable(Exception):
    """The service did not answer within its attempts; the request is degraded, not failed."""


def retry_delay(attempt: int) -> float:
    return min(RETRY_MOST, RETRY_BASE * 2**attempt)


@dataclass(frozen=True)
class Client:
    """Posts states to a decision service from executors; the transport can be replaced."""

    url: str
    headers: Mapping[str, str] = ()
    timeout: float = 10.0
    attempts: int = 3
    post: Callable[[str, bytes, Mapping[str, str], float], tuple[int, str]] | None = None
    sleep: Callable[[float], None] = time.sleep

    def with_provider(self, **changes: Any) -> Client:
        """The same client at another provider."""
        return replace(self, **changes)

    def ask(self, payload: Mapping[str, Any]) -> str:
        """The response body; statuses that may pass are tried again with growing delays."""
        body, reason = json.dumps(payload).encode(), "no attempt"
        for attempt in range(max(1, self.attempts)):
            if attempt:
                self.sleep(retry_delay(attempt - 1))
            try:
                status, text = (self.post or _post)(self.url, body, dict(self.headers), self.timeout)
            except (TimeoutError, OSError) as error:
                reason = f"{type(error).__name__}: {error}"
                continue
            if status < 400:
                return text
            reason = f"HTTP {status}"
            if status not in RETRY_STATUSES:
                break
        raise Unavailable(reason)


def _post(url: str, body: bytes, headers: Mapping[str, str], timeout: float) -> tuple[int, str]:
    request = urllib.request.Request(url, body, {"Content-Type": "application/json", **headers}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return response.status, response.read().decode()
    except urllib.error.HTTPError as error:
        return error.code, ""


def asked(df: DataFrame, client: Client, state: str, questions: Mapping[str, Any], alternate: Client | None = None) -> DataFrame:
    """Adds raw (response body), degraded and degrade_reason; a quota error is tried at ``alternate`` once.

    ``state`` is a JSON text column.  A task posts one row after the other, so the service sees as many calls at
    once as there are cores; the timeout bounds each.
    """
    names = df.columns

    def run(frames: Iterator[Any]) -> Iterator[Any]:
        for frame in frames:
            raw, reasons = [], []
            for text in frame[state]:
                answer, reason = None, None
                for one in (client, alternate):
                    if one is None or (reason is not None and not any(m in reason.lower() for m in QUOTA_MARKERS)):
                        continue
                    try:
                        answer, reason = one.ask({"state": json.loads(text), "questions": questions}), None
                        break
                    except Unavailable as error:
                        reason = str(error)
                raw.append(answer)
                reasons.append(reason)
            yield frame.assign(raw=raw, degraded=[r is not None for r in reasons], degrade_reason=reasons)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.select(*names).mapInPandas(run, f"{schema}, raw string, degraded boolean, degrade_reason string")


def with_shadow(df: DataFrame, primary: Callable[[DataFrame], DataFrame], shadow: Callable[[DataFrame], DataFrame], fields: Sequence[str], id_col: str) -> DataFrame:
    """The primary's answers, beside the shadow's as ``shadow_<field>``: a second projection over the same rows, which decides nothing."""
    one = primary(df)
    other = shadow(df).select(id_col, *[F.col(c).alias(f"shadow_{c}") for c in fields])
    return one.join(other, id_col, "left")
