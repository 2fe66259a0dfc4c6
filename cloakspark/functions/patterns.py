"""Patterns, column hints and labels: the detection configuration."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Pattern:
    """``guard``: what every match must contain (a cheap regex); None if nothing cheap is known. ``gate``: the same, looked for once for all patterns that share it."""

    name: str
    regex: str
    severity: str
    category: str
    method: str
    guard: str | None = None
    group: int = 0
    lead: int = 0
    skip_if: tuple[str, ...] = ()
    column_hint: tuple[str, ...] | None = None
    gate: str | None = None


_D1, _D4 = "[0-9]", "[0-9]{4}"

# Names, expressions, severities, categories and methods of the 26 patterns, in their order.
PATTERNS = (
    Pattern("INDIAN_PAN", r"\b(?:[A-Z][\s-]*){5}(?:[0-9][\s-]*){4}[A-Z]\b", "CRITICAL", "GOVERNMENT_ID", "pan", r"(?:[0-9][\s-]*){4}[A-Z]", gate=_D1),
    Pattern("AADHAAR", r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b", "CRITICAL", "GOVERNMENT_ID", "aadhaar", r"[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}", gate=_D4),
    Pattern("IFSC_CODE", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", "HIGH", "FINANCIAL", "ifsc", r"[A-Z]{4}0[A-Z0-9]{6}", gate=_D1),
    Pattern("CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", "CRITICAL", "FINANCIAL", "credit_card", r"[3-6][0-9]{12}", gate=_D4),
    Pattern("EMAIL", r"\b[a-zA-Z0-9_%+\-]+(?:(?:\.|(?:\s*(?:dot|\(dot\)|\[dot\])\s*))[a-zA-Z0-9_%+\-]+)*\s*(?:@|\(at\)|\[at\])\s*[a-zA-Z0-9\-]+(?:(?:\.|(?:\s*(?:dot|\(dot\)|\[dot\])\s*))[a-zA-Z]{2,7})?\b", "MEDIUM", "CONTACT", "email", r"[@(\[](?:(?<=@)|at[)\]])"),
    Pattern("UPI_ID", r"\b[a-zA-Z0-9.\-_]+@(?:ybl|paytm|okhdfcbank|okicici|apl|upi|ibl|axl)\b", "HIGH", "FINANCIAL", "upi_id", r"@(?:ybl|paytm|ok|icici|apl|upi|ibl|axl)", skip_if=("EMAIL",)),
    Pattern("INDIAN_PHONE", r"\b(?:\+91[\s-]?)?(?:0)?[6-9](?:[\s.-]?\d){9}\b", "MEDIUM", "CONTACT", "phone_number", r"[6-9](?:[\s.-]?\d){9}", gate=_D1),
    Pattern("INDIAN_PINCODE", r"\b[1-9][0-9]{5}\b", "LOW", "LOCATION", "pincode", r"[1-9][0-9]{5}", gate=_D4),
    Pattern("DATE_OF_BIRTH", r"\b(?:0[1-9]|[12]\d|3[01])[/\-](?:0[1-9]|1[0-2])[/\-](?:19|20)\d{2}\b", "MEDIUM", "PERSONAL", "date_of_birth", r"[0-3]\d[/\-][01]\d[/\-](?:19|20)\d{2}", gate=_D4),
    Pattern("DATE_OF_BIRTH_ISO", r"\b(?:19|20)\d{2}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])\b", "MEDIUM", "PERSONAL", "date_of_birth_iso", r"[12][09]\d{2}[-/][01]\d[-/][0-3]\d", gate=_D4),
    Pattern("INDIAN_PASSPORT", r"\b[A-Z][1-9]\d{6}\b", "CRITICAL", "GOVERNMENT_ID", "passport", r"[A-Z][1-9]\d{6}", gate=_D4),
    Pattern("INDIAN_VEHICLE", r"\b[A-Z]{2}[\s-]?\d{1,2}[\s-]?[A-Z]{1,3}[\s-]?\d{4}\b", "LOW", "PERSONAL", "vehicle_registration", r"\d[\s-]?[A-Z]{1,3}[\s-]?\d{4}", gate=_D4),
    Pattern("BANK_ACCOUNT", r"\b\d{9,18}\b", "CRITICAL", "FINANCIAL", "bank_account", r"\d{9}", gate=_D4),
    Pattern("VOTER_ID", r"\b[A-Z]{3}[0-9]{7}\b", "CRITICAL", "GOVERNMENT_ID", "obfuscate", r"[A-Z]{3}[0-9]{7}", gate=_D4),
    Pattern("DRIVING_LICENSE", r"\b[A-Z]{2}[0-9]{2}[ \-]?[0-9]{11}\b", "CRITICAL", "GOVERNMENT_ID", "obfuscate", r"[0-9]{2}[ \-]?[0-9]{11}", gate=_D4),
    Pattern("GSTIN", r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}\b", "HIGH", "BUSINESS_ID", "gstin", r"[0-9]{2}[A-Z]{5}[0-9]{4}", gate=_D4),
    Pattern("CIN", r"\b[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}\b", "HIGH", "BUSINESS_ID", "obfuscate", r"[LU][0-9]{5}[A-Z]{2}", gate=_D4),
    Pattern("UDYAM_REG", r"\bUDYAM-[A-Z]{2}-[0-9]{2}-[0-9]{7}\b", "HIGH", "BUSINESS_ID", "obfuscate", r"UDYAM-", gate=_D4),
    Pattern("TAN", r"\b[A-Z]{4}[0-9]{5}[A-Z]{1}\b", "HIGH", "BUSINESS_ID", "obfuscate", r"[A-Z]{4}[0-9]{5}[A-Z]", gate=_D4),
    Pattern("EPFO_UAN", r"\b10[0-9]{10}\b", "CRITICAL", "GOVERNMENT_ID", "obfuscate", r"10[0-9]{10}", gate=_D4),
    Pattern("IP_ADDRESS", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "LOW", "NETWORK", "obfuscate", r"[0-9]\.[0-9]{1,3}\.[0-9]", gate=_D1),
    Pattern("MAC_ADDRESS", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}(?:[0-9A-Fa-f]{2})\b", "LOW", "NETWORK", "obfuscate", r"[:-][0-9A-Fa-f]{2}[:-]"),
    Pattern("VEHICLE_CHASSIS_VIN", r"\b[A-HJ-NPR-Z0-9]{17}\b", "LOW", "ASSET", "obfuscate", r"[A-HJ-NPR-Z0-9]{17}"),
    Pattern("SWIFT_BIC", r"\b[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?\b", "MEDIUM", "FINANCIAL", "obfuscate", r"[A-Z]{6}[A-Z0-9]{2}"),
    Pattern("TRANSACTION_REF", r"\b(?:ORD|FD|TXN|REF|UPI|IMPS|NEFT|RTGS)\d{6,}\b", "HIGH", "FINANCIAL", "transaction_ref", r"[DNFIST]\d{6}", gate=_D4),
    Pattern("ATTACHED_NAME", r"(?:[-_@:.,/])([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)\b", "HIGH", "PERSONAL", "name", r"[-_@:.,/][A-Z][a-z]", group=1, lead=1),
)

#: Our own additions, off by default: local phone numbers and quoted secrets.
EXTENSIONS = (
    Pattern("LOCAL_PHONE", r"\b555-\d{4}\b", "MEDIUM", "CONTACT", "obfuscate", "555-"),
    Pattern("SECRET_TOKEN", r"(?i)\b(?:token|secret|api_key)\s*=\s*\"[0-9a-f]{16,}\"", "CRITICAL", "FINANCIAL", "redact", "="),
)

# Patterns that alone never mark a column, those the validator passes over in free text, and words that must precede a postal code.
NOISY = ("VOTER_ID", "INDIAN_PINCODE", "IP_ADDRESS", "MAC_ADDRESS", "VEHICLE_CHASSIS_VIN", "SWIFT_BIC", "ATTACHED_NAME")
VALIDATOR_SKIPS = ("INDIAN_PINCODE", "VOTER_ID", "ATTACHED_NAME")
PINCODE_CONTEXT = ("pin", "pincode", "pin code", "zip", "postal", "area code", "pin:", "pin-")

# Column hints.
HINTS = {
    "skip": ("Transaction_ID", "Status", "Date", "Platform_Source", "ts", "method", "http_status", "latency_ms", "partner_bank"),
    "identity": ("Name", "name", "Full_Name", "customer_name"),
    "free_text": ("Comments", "comments", "remarks", "notes", "description", "address", "Address", "error_msg"),
    "numeric": ("Amount", "amount", "Balance", "balance", "Transaction_Amount"),
    "pseudonymize": ("request_id", "user_id", "idempotency_key"),
    "endpoint": ("endpoint",),
}
ID_LIKE = ("id", "number", "num", "code", "pin", "account", "aadhaar")

# Labels of model detectors, their methods and severities.
NER_METHODS = {
    "person": "person", "phone number": "phone_number", "email": "email", "address": "address", "organization": "organization", "bank account number": "bank_account",
    "credit card number": "credit_card", "date of birth": "date_of_birth", "tax identification number": "pan", "national id number": "aadhaar", "passport number": "passport",
    "ip address": "redact", "username": "redact",
}
NER_SEVERITY = {
    "person": "HIGH", "phone number": "MEDIUM", "email": "MEDIUM", "address": "MEDIUM", "organization": "LOW", "bank account number": "CRITICAL", "credit card number": "CRITICAL",
    "date of birth": "MEDIUM", "tax identification number": "CRITICAL", "national id number": "CRITICAL", "passport number": "CRITICAL", "ip address": "LOW", "username": "MEDIUM",
}


@dataclass(frozen=True)
class Config:
    """Everything a run depends on but its input; the salt has no default."""

    salt: str
    patterns: tuple[Pattern, ...] = PATTERNS
    hints: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(HINTS))
    density: float = 0.10
    name_share: float = 0.15
    sample: int = 100
    low_cardinality: int = 30
    free_text_length: float = 60.0
    epsilon: float = 1.0
    redact_from: float = 0.8
    review_from: float = 0.4
    passes: int = 3
    strict: bool = False
    names: bool = True

    def effective(self) -> tuple[Pattern, ...]:
        """Patterns in force. Strict: full e-mail domains, UPI ids of their own, addresses before phones."""
        if not self.strict:
            return self.patterns
        out = [replace(p, regex=p.regex.replace("{2,7})?", "{2,7})*")) if p.name == "EMAIL" else p for p in self.patterns]
        first = {"UPI_ID": -1, "IP_ADDRESS": 0}
        out = [replace(p, skip_if=()) if p.name == "UPI_ID" else p for p in out]
        return tuple(sorted(out, key=lambda p: first.get(p.name, 1)))

    def applicable(self, column: str) -> tuple[Pattern, ...]:
        """Patterns without a column hint, or one of whose hints the column's name contains in any case."""
        return tuple(p for p in self.effective() if p.column_hint is None or any(h.lower() in column.lower() for h in p.column_hint))

    def left_out(self, column: str) -> tuple[int, ...]:
        """Orders of the patterns that hints keep from a column."""
        on = self.applicable(column)
        return tuple(i for i, p in enumerate(self.effective()) if p not in on)


def _hints(value: str | list[str] | None) -> tuple[str, ...] | None:
    """A hint may be one word or a list of them."""
    return None if value is None else (value,) if isinstance(value, str) else tuple(map(str, value))


def load_config(path: str | None, salt: str, **more) -> Config:
    """A configuration from a YAML file with any of the sections global, confidence_routing, regex_patterns and column_hints."""
    import yaml

    data = {}
    if path:
        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
    known = {p.name: p for p in PATTERNS}
    args: dict = {"salt": salt}
    if "regex_patterns" in data:
        made = []
        for e in data["regex_patterns"]:
            old = known.get(e["name"])
            if old and old.regex == e["pattern"]:
                made.append(replace(old, severity=e["severity"], category=e["category"], column_hint=_hints(e.get("column_hint")), method=e["faker_method"] if old.name != "GSTIN" else old.method))
            else:
                group = 1 if "(?P<pii>" in e["pattern"] else 0
                made.append(Pattern(e["name"], e["pattern"].replace("(?P<pii>", "("), e["severity"], e["category"], e["faker_method"], group=group, lead=group, skip_if=tuple(e.get("skip_if_matched", ())), column_hint=_hints(e.get("column_hint"))))
        args["patterns"] = tuple(made)
    if "column_hints" in data:
        args["hints"] = {k: tuple(data["column_hints"].get(f"{k}_columns", ())) for k in HINTS}
    routing = data.get("confidence_routing", {})
    args |= {k: float(routing[n]) for k, n in (("redact_from", "auto_redact"), ("review_from", "review_queue")) if n in routing}
    if "max_validation_passes" in data.get("global", {}):
        args["passes"] = int(data["global"]["max_validation_passes"])
    return Config(**(args | more))
