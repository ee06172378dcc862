"""The hard gate: detectors, validators, decoded variants, spans, verdicts and redaction.

Which detectors fire on a text is a Catalyst expression per detector (``fires``).  Span algebra (distinct
matches, containment, redaction) runs in one Arrow UDF, which gets only texts that a union of the
patterns lets through.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import reduce
from operator import or_
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.schema import GATE, SENSITIVITY


@dataclass(frozen=True)
class Detector:
    name: str
    category: str
    pattern: str
    floor: str
    blocks: bool = False
    local: bool = False
    check: str = ""
    advisory: bool = False
    pii: bool = True
    specificity: int = 0
    cased: bool = False

    @property
    def force_local(self) -> bool:
        return self.local or self.blocks

    @property
    def java(self) -> str:
        return self.pattern if self.cased else "(?iu)" + self.pattern

    @property
    def rank(self) -> tuple[bool, bool, int]:
        return (not self.advisory, bool(self.check), self.specificity)


# Detector names, categories, floors and patterns, in order.
DETECTORS = (
    Detector("payment_card", "regulated", r"(?<![\d.])\b(?:\d[ -]?){12,18}\d\b(?![\d.])", "regulated", blocks=True, check="luhn"),
    Detector("us_ssn", "regulated", r"(?<!\d)\b(\d{3})-(\d{2})-(\d{4})\b(?!\d)", "regulated", blocks=True),
    Detector("iban", "regulated", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{0,3})\b", "regulated", blocks=True, check="iban", cased=True),
    Detector("uk_nhs_number", "regulated", r"(?<!\d)\b\d{3}\s?\d{3}\s?\d{4}\b(?!\d)", "regulated", blocks=True, check="nhs"),
    Detector("uk_national_insurance", "regulated", r"\b[A-CEGHJ-PR-TW-Z]{2}\s?\d{6}\s?[A-D]\b", "regulated", blocks=True, check="nino", cased=True),
    Detector("private_key_block", "secret", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----", "confidential", blocks=True),
    Detector(
        "provider_api_key",
        "secret",
        r"\b(?:sk-[A-Za-z0-9_.\-]{20,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|xox[baprs]-[A-Za-z0-9\-]{10,}"
        r"|AIza[0-9A-Za-z_\-]{35}|sk-ant-[A-Za-z0-9_\-]{20,}|hf_[A-Za-z0-9]{34})\b",
        "confidential",
        blocks=True,
        specificity=1,
        cased=True,
    ),
    Detector(
        "inline_credential",
        "secret",
        r"\b[\w.\-]*(?:password|passwd|pwd|secret(?:[_\-.][\w.\-]{0,16})?|api[_\-.]?key|access[_\-.]?key|"
        r"(?:access|auth|api|bearer|refresh|session|client|id)[_\-.]token|token[_\-.](?:secret|key|value|id))[\w.\-]*\s*[:=]\s*['\"]?[^\s'\",;]{6,}",
        "confidential",
        blocks=True,
    ),
    Detector("basic_auth_url", "secret", r"\b[a-z][a-z0-9+.\-]*://[^\s/:@]{2,}:[^\s@]{2,}@[^\s/]+", "confidential", blocks=True),
    Detector("medical_record_number", "regulated", r"\b(?:mrn|medical record no\.?|chart no\.?|patient id)\s*[:#]?\s*[A-Z0-9\-]{4,20}", "regulated", blocks=True),
    Detector("email_address", "pii", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "confidential", local=True, check="email"),
    Detector(
        "phone_number",
        "pii",
        r"(?<![\w.])(?:\+\d{1,3}[\s.\-]?)?(?:\(\d{2,4}\)[\s.\-]?)?\d{3,4}[\s.\-]?\d{3,4}[\s.\-]?\d{2,4}(?![\w.])",
        "confidential",
        local=True,
        check="phone",
    ),
    Detector(
        "date_of_birth",
        "pii",
        r"\b(?:dob|d\.o\.b\.|date of birth|birth date|szuletesi|geburtsdatum|geboren am)\s*[:\-]?\s*\d{1,4}[./\-]\d{1,2}[./\-]\d{1,4}"
        r"|\b(?:dob|date of birth)\s*[:\-]?\s*(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}",
        "regulated",
        local=True,
    ),
    Detector(
        "street_address",
        "pii",
        r"\b\d{1,6}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+"
        r"(?:street|st|road|rd|avenue|ave|boulevard|blvd|drive|dr|lane|ln|court|ct|way|terrace|ter)\b"
        r"(?:[.,]?\s+[A-Z][a-z]+){0,2}[.,]?\s*(?:\d{5}(?:-\d{4})?|[A-Z]\d[A-Z] ?\d[A-Z]\d)\b",
        "confidential",
        local=True,
    ),
    Detector(
        "named_individual",
        "pii",
        r"\b(?:patient|client|customer|employee|student|applicant|claimant|suspect|user|member)\s+(?:named|is|was|id)\s+(?:[A-Z][a-z]+\.?\s+){1,2}[A-Z][a-z]+\b"
        r"|\b(?:patient|client|employee|student|applicant)\s+[A-Z][a-z]+\s+[A-Z]\.\s*[A-Z][a-z]+\b",
        "confidential",
        local=True,
    ),
    Detector(
        "kw_health_regulation",
        "regulated",
        r"\b(?:hipaa|ephi|phi|protected health information|medical record|health record|diagnosis|diagnosed|prognosis|prescription|medication|"
        r"dosage|treatment plan|clinical note|patient history|icd-10|icd10|gdpr|dsgvo)\b",
        "regulated",
        advisory=True,
        pii=False,
    ),
    Detector(
        "kw_legal_privilege",
        "regulated",
        r"\b(?:attorney[- ]client|legal privilege|privileged (?:and )?confidential|work product doctrine|under oath|deposition|subpoena|litigation hold)\b",
        "regulated",
        advisory=True,
        pii=False,
    ),
    Detector(
        "kw_financial_regulation",
        "regulated",
        r"\b(?:pci[- ]dss|pci compliance|cardholder data|cvv|cvc2|glba|sox compliance|sar filing|suspicious activity report|kyc document|"
        r"account balance of|bank statement|routing number|swift code)\b",
        "regulated",
        advisory=True,
        pii=False,
    ),
    Detector(
        "kw_minors",
        "regulated",
        r"\b(?:coppa|ferpa|minor(?:'s)? record|child(?:'s)? (?:data|records|medical)|under 13|under-13|student records|school transcript)\b",
        "regulated",
        advisory=True,
        pii=False,
    ),
    Detector(
        "kw_confidential_business",
        "keyword",
        r"\b(?:trade secret|under nda|nda-covered|strictly confidential|do not distribute|unreleased|unannounced|pre-announcement|acquisition target|"
        r"merger discussions|layoff plan|restructuring plan|performance review|salary|compensation band|equity grant|board resolution)\b",
        "confidential",
        advisory=True,
        pii=False,
    ),
    Detector(
        "kw_security_vulnerability",
        "keyword",
        r"\b(?:zero[- ]day|0[- ]day|unpatched|exploit chain|cve-\d{4}-\d{4,}|remote code execution|privilege escalation path|"
        r"credentials? (?:dump|leak)|exfiltrat\w+|breach response)\b",
        "confidential",
        advisory=True,
        pii=False,
    ),
    Detector(
        "kw_internal_only",
        "keyword",
        r"\b(?:internal only|internal-only|confidential(?:ly)?|restricted distribution|employees only|staff only|not for external)\b",
        "internal",
        advisory=True,
        pii=False,
    ),
)
PLACEHOLDER_DOMAINS = (
    "example.com", "example.org", "example.net", "example.edu", "example.invalid", "localhost", "test.com", "domain.com",
    "email.com", "company.com", "acme.com", "foo.com", "bar.com", "users.noreply.github.com",
)
BASE64_RUN = r"[A-Za-z0-9+/]{20,}={0,2}|[A-Za-z0-9+/]{12,}={1,2}"
SPACED_DIGITS = r"(?:\d\s){7,}\d"
MIXED_DIGITS = r"[0-9][0-9A-Za-z\-\s]{4,}[0-9A-Za-z]"

BY_NAME = {d.name: d for d in DETECTORS}


# ------------------------------------------------------------ native expressions


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def luhn_ok(s: Column) -> Column:
    d = _digits(s)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def iban_ok(s: Column) -> Column:
    flat = F.upper(F.regexp_replace(s, r"\s+", ""))
    turned = F.concat(F.substr(flat, F.lit(5)), F.substring(flat, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return flat.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$") & (rest == 1)


def nhs_ok(s: Column) -> Column:
    d = _digits(s)
    digit = lambda i: F.coalesce(F.substring(d, i, 1).try_cast("int"), F.lit(0))
    total = sum((digit(i) * (11 - i) for i in range(1, 10)), F.lit(0))
    check = 11 - total % 11
    return (F.length(d) == 10) & (check != 10) & (digit(10) == F.when(check == 11, 0).otherwise(check))


def nino_ok(s: Column) -> Column:
    flat = F.upper(F.regexp_replace(s, r"\s+", ""))
    return flat.rlike(r"^[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]$") & ~F.substring(flat, 1, 2).isin("GB", "NK", "TN", "ZZ")


def real_email(s: Column) -> Column:
    domain = F.regexp_replace(F.lower(F.substring_index(s, "@", -1)), r"^\.+|\.+$", "")
    hit = F.lit(False)
    for d in PLACEHOLDER_DOMAINS:
        hit = hit | (domain == d) | domain.endswith("." + d)
    return ~hit


CHECKS = {"luhn": luhn_ok, "iban": iban_ok, "nhs": nhs_ok, "nino": nino_ok, "email": real_email, "phone": lambda s: F.length(_digits(s)).between(9, 15)}


def matches(text: Column, name: str) -> Column:
    """Distinct accepted matches of one detector in the text itself."""
    d = BY_NAME[name]
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(d.java), F.lit(0)))
    return F.filter(found, CHECKS[d.check]) if d.check else found


def fires(text: Column, name: str) -> Column:
    d = BY_NAME[name]
    return F.size(matches(text, name)) > 0 if d.check else text.rlike(d.java)


def detector_counts(text: Column, names=tuple(BY_NAME)) -> Column:
    """map<detector, distinct accepted matches>, of detectors with any."""
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.size(matches(text, n)).alias("v")) for n in names])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"] > 0))


#: Letters outside ASCII that equal an ASCII letter when case is ignored.
FOLDING = "[\u0130\u0131\u017F\u212A]"


def screened(text: Column) -> Column:
    """The text where some pattern or an encoded variant may match, else null.

    One search a pattern: alone, most start from a rare character, in one large alternation none does.
    """
    # letters that fold to ASCII ones are looked for by themselves, which spares folding every character
    tests = [FOLDING, BASE64_RUN, SPACED_DIGITS, MIXED_DIGITS, *(("" if d.cased else "(?i)") + d.pattern for d in DETECTORS)]
    return F.when(reduce(or_, [text.rlike(p) for p in tests]), text)


# ------------------------------------------------------------ span algebra (Python)


def _number(s: str) -> list[int]:
    return [int(c) for c in s if c.isdigit()]


def _py_luhn(s: str) -> bool:
    d = _number(s)
    doubled = [x if i % 2 == 0 else (2 * x) // 10 + (2 * x) % 10 for i, x in enumerate(d[::-1])]
    return 13 <= len(d) <= 19 and sum(doubled) % 10 == 0


def _py_iban(s: str) -> bool:
    flat = "".join(s.split()).upper()
    return bool(re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", flat)) and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _py_nhs(s: str) -> bool:
    d = _number(s)
    if len(d) != 10:
        return False
    check = (-sum(x * w for x, w in zip(d, range(10, 1, -1), strict=False))) % 11
    return check == d[9] != 10


def _py_nino(s: str) -> bool:
    flat = "".join(s.split()).upper()
    return bool(re.fullmatch(r"[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]", flat)) and flat[:2] not in ("GB", "NK", "TN", "ZZ")


def _py_email(s: str) -> bool:
    domain = s.rpartition("@")[2].lower().strip(".")
    return not any(("." + domain).endswith("." + d) for d in PLACEHOLDER_DOMAINS)


_PY_CHECKS = {"": lambda s: True, "luhn": _py_luhn, "iban": _py_iban, "nhs": _py_nhs, "nino": _py_nino, "email": _py_email, "phone": lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15}
_COMPILED: dict[str, re.Pattern] = {}


def _pattern(d: Detector) -> re.Pattern:
    if d.name not in _COMPILED:
        _COMPILED[d.name] = re.compile(d.pattern, 0 if d.cased else re.IGNORECASE)
    return _COMPILED[d.name]


def variants(text: str) -> list[str]:
    """Decoded forms of a text: base64 runs, digits spaced out, letters that stand for digits."""
    out = []
    for run in re.findall(BASE64_RUN, text):
        try:
            plain = base64.b64decode(run, validate=True).decode()
        except ValueError:
            continue
        if plain.strip():
            out.append(plain)
    out += [flat for run in re.findall(SPACED_DIGITS, text) if (flat := run.replace(" ", "")) != run]
    for run in re.findall(MIXED_DIGITS, text):
        plain = run.translate(str.maketrans("lIOo", "1100"))
        if 2 * sum(c.isdigit() for c in run) >= len(run) and plain != run:
            out.append(plain)
    return out


def spans(text: str, detectors) -> list[tuple[int, int, Detector]]:
    """Accepted matches (start, end, detector), detector by detector."""
    return [(*m.span(), d) for d in detectors for m in _pattern(d).finditer(text) if _PY_CHECKS[d.check](m[0])]


def _covered(hit, others) -> bool:
    """Whether another detector's match makes this one redundant."""
    start, end, d = hit
    for a, b, o in others:
        if o.name != d.name and not o.advisory and a <= start and end <= b:
            if o.rank > d.rank or (o.rank == d.rank and (a, b) != (start, end)):
                return True
    return False


def verdict(text: str | None, detectors=DETECTORS) -> dict:
    """The gate's verdict on one text and its decoded variants."""
    clean = {"fired": False, "findings": [], "sensitivity_floor": None, "pii_floor": None, "force_local": False, "blocks_backend": False, "advisory_topics": []}
    if not text:
        return clean
    whole = " ".join([text, *variants(text)])
    hits, seen = [], set()
    for a, b, d in spans(whole, detectors):
        if (d.name, whole[a:b]) not in seen:
            seen.add((d.name, whole[a:b]))
            hits.append((a, b, d))
    found: dict[str, list[str]] = {}
    for hit in hits:
        if hit[2].advisory or not _covered(hit, hits):
            found.setdefault(hit[2].name, []).append(whole[hit[0] : hit[1]])
    if not found:
        return clean
    named = [d for d in detectors if d.name in found]
    hard = [d for d in named if not d.advisory]
    return {
        "fired": True,
        "findings": [
            {
                "detector": d.name,
                "category": d.category,
                "sensitivity_floor": d.floor,
                "force_local": d.force_local,
                "span_hash": hashlib.sha256("\0".join(found[d.name]).encode()).hexdigest()[:16],
                "count": len(found[d.name]),
            }
            for d in named
        ],
        "sensitivity_floor": max((d.floor for d in hard), key=SENSITIVITY.index, default=None),
        "pii_floor": 1.0 if any(d.pii for d in hard) else None,
        "force_local": any(d.force_local for d in hard),
        "blocks_backend": any(d.blocks for d in hard),
        "advisory_topics": [d.name for d in named if d.advisory],
    }


def redacted(text: str | None, placeholder: str = "[{name}]", detectors=DETECTORS) -> tuple[str | None, int]:
    """The text with every hard match replaced; spans that overlap or touch become one."""
    merged: list[list] = []
    found = sorted(spans(text or "", [d for d in detectors if not d.advisory]), key=lambda s: (s[0], -s[1]))
    for a, b, d in found:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
            merged[-1][2].append(d.name)
        else:
            merged.append([a, b, [d.name]])
    out, at = [], 0
    for a, b, names in merged:
        out += [text[at:a], placeholder.format(name="+".join(names))]
        at = b
    return (text if not merged else "".join(out) + text[at:]), len(merged)


def active(disabled=(), placeholder_domains_as_pii: bool = False) -> tuple[Detector, ...]:
    """The detector set of a configuration; unknown names are refused."""
    from dataclasses import replace

    if unknown := sorted(set(disabled) - set(BY_NAME)):
        raise ValueError(f"unknown detectors: {unknown}")
    kept = [d for d in DETECTORS if d.name not in disabled]
    return tuple(replace(d, check="") if placeholder_domains_as_pii and d.name == "email_address" else d for d in kept)


def gate_and_redact(text: Column, placeholder: str = "[{name}]", detectors=DETECTORS) -> Column:
    """struct<verdict, text, n>: the verdict, the redacted text and the number of replacements.

    One Arrow UDF, which gets only the texts that the screen lets through; the others share one clean verdict.
    """

    @F.pandas_udf(f"struct<verdict:{GATE},text:string,n:int>")
    def run(texts):
        import pandas as pd

        clean, rows = (verdict(None, detectors), None, 0), []
        for t in texts:
            rows.append((verdict(t, detectors), *redacted(t, placeholder, detectors)) if t else clean)
        return pd.DataFrame(rows, columns=["verdict", "text", "n"])

    done = run(screened(text))
    return F.struct(done["verdict"].alias("verdict"), F.coalesce(done["text"], text).alias("text"), F.coalesce(done["n"], F.lit(0)).alias("n"))


def gate(text: Column, detectors=DETECTORS) -> Column:
    """The verdict struct of a text column."""
    return gate_and_redact(text, detectors=detectors)["verdict"]


def redact(text: Column, placeholder: str = "[{name}]", detectors=DETECTORS) -> Column:
    """struct<text, n>: the redacted text and the number of replacements."""
    done = gate_and_redact(text, placeholder, detectors)
    return F.struct(done["text"].alias("text"), done["n"].alias("n"))


def mask_secrets(text: Column, detectors=DETECTORS) -> Column:
    """The text with every hard match shown by its detector's name, for printed examples."""
    return redact(text, "[masked-{name}]", detectors)["text"]


def redaction_map(text: Column, detectors=DETECTORS) -> Column:
    """array<struct<detector, start, end>> of accepted hard matches in the text itself, detector by detector."""
    hard = [d for d in detectors if not d.advisory]

    @F.pandas_udf("array<struct<detector:string,start:int,end:int>>")
    def run(texts):
        return texts.map(lambda t: [{"detector": d.name, "start": a, "end": b} for a, b, d in spans(t or "", hard)])

    return F.coalesce(run(screened(text)), F.expr("cast(array() as array<struct<detector:string,start:int,end:int>>)"))
