"""Thresholds, word lists and patterns of the claims rules, in one place.

Patterns are in Java's syntax. ``(?U)`` gives ``\\s``, ``\\d``, ``\\w`` and ``\\b`` their Unicode meaning.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

# The ten normalized fields and the fourteen extracted ones, in their order.
FIELDS = ("claim_id", "policy_no", "claimant_name", "phone", "email", "vehicle", "damage", "date", "amount_estimated", "insured_amount")
EXTRACTED = ("claim_id", "policy_no", "claimant_name", "phone", "email", "vehicle", "registration_no", "make", "model", "year", "damage", "amount_estimated", "insured_amount", "date")
# What Java's and Python's classes of white space hold.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII_WHITE_SPACE = WHITE_SPACE[:10]
REQUIRED = ("claim_id", "policy_no", "date", "amount_estimated")
NOTED_IF_MISSING = ("claim_id", "policy_no", "claimant_name", "date", "amount_estimated")
SEVERAL_CANDIDATES = ("policy_no", "claim_id", "phone", "email")

# Patterns of the field extractor.
CLAIM_ID = r"(?iU)\b(?:claim\s*(?:reference|ref|id|no|number))[\s:\-]*([A-Z0-9][A-Z0-9/\-]{4,})\b"
POLICY_NO = r"(?iU)\b(?:policy\s*(?:number|no|id)?|pol(?:icy)?\s*no|pol\s*id|policy[-_ ]?no|policynum)[\s:\-]*([A-Z0-9][A-Z0-9/\-_]{3,})\b"
EMAIL = r"(?U)\b[a-zA-Z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?U)(\+?\d{1,3}[\s\-()]*\d{2,5}(?:[\s\-]?\d){5,12})"
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december"
DATE = rf"(?iU)\b(\d{{4}}[-/]\d{{2}}[-/]\d{{2}}|\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{4}}|\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}})\b"
NAME_LINE = r"(?iU)(?:full\s*name|claimant\s*name|insured\s*name)[\s:\-]*([A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+){0,3})"
REGISTRATION = r"(?iU)\b(?:[A-Z]{2,3}[\s\-]?\d{1,4}[\s\-]?[A-Z]{1,4}[\s\-]?\d{1,4})\b"
REGISTRATION_LINE = r"(?iU)Registration\s*Number[:\s\-]*([A-Z0-9\-\s]+)"
DAMAGE = r"(?iU)(?:nature\s*of\s*damage|damage\s*description|nature\s*of\s*loss|accident\s*damage|damage|loss)[\s:\-]*(.+)"
AMOUNT = r"(?iU)(₹|rs\.?|inr|\$)?\s*(\d{1,3}(?:[,\s]\d{3})*(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)"
ESTIMATE = r"(?iU)(?:estimated\s*(?:repair\s*)?(?:cost|amount|loss|claim|value)|total\s*estimated\s*(?:cost|amount|loss)|repair\s*estimate)[\s:\-]*"
INSURED_AMOUNT = r"(?iU)Insured\s*Amount[:\s\-]*(₹|Rs\.?|INR|\$)?\s*([0-9,.\s]+)"
MAKE = r"(?iU)Make[:\s\-]*([A-Za-z0-9 ]+)"
MODEL = r"(?iU)Model[:\s\-]*([A-Za-z0-9 ]+)"
YEAR = r"(?iU)Year[:\s\-]*([0-9]{4})"
VEHICLE = r"(?iU)(?:Vehicle|Vehicle\s*Details|Vehicle\s*Information)[:\s\-]*(.+)"
SIGNATURE = r"(?iU)Claimant\s*Signature[:\s\-]*([A-Za-z ,.]{3,60})"
TITLE_CASE = r"(?U)^[A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?$"
CODE = r"[A-Z0-9/\-_]{4,}"
HEADER = r"(?iU)^(?:[A-Za-z0-9][A-Za-z0-9\s\-_/.]{0,40}[:\-]\s*$|[A-Z][A-Z\s]{4,50}$)"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
CLAIM_ID_WORDS = ("claim reference", "claim ref", "claim id", "claim number", "clm", "claim no")
POLICY_NO_WORDS = ("policy number", "policy no", "policy id", "pn")

# Patterns of the rules that infer missing fields.
INFER = {
    "claim_id": (r"(?iU)(CL[M]?[/\-]?\w+)", 1),
    "policy_no": (r"(?iU)(P[NO][L]?/?\w+)", 1),
    "claimant_name": (r"(?U)(?:Name|Claimant)\s*:\s*([A-Za-z\s]{3,50})", 1),
    "phone": (r"(?U)\+?\d[\d\s-]{7,}\d", 0),
    "email": (r"[A-Za-z0-9_.+-]+@[A-Za-z0-9.-]+\.[A-Za-z0-9]{2,}", 0),
    "vehicle": (r"(?U)(?:Model|Make|Vehicle)\s*:\s*(.*)", 1),
    "damage": (r"(?U)(?:Nature of Damage|Damage)\s*:\s*(.*)", 1),
    "date": (r"(?U)(\d{4}[-/]\d{2}[-/]\d{2})", 1),
    "amount_estimated": (r"(?iU)(₹\s?[0-9,.]+|Rs\.?\s?[0-9,.]+|\$[0-9,.]+)", 1),
    "insured_amount": (r"(?iU)(₹\s?[0-9,.]+|Rs\.?\s?[0-9,.]+|\$[0-9,.]+)", 1),
}

# Patterns of the redactor.
MASK_EMAIL = r"([a-zA-Z0-9_.+-]{1,64})@([a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)"
MASK_PHONE = r"(?U)(\+?\d[\d\-\s.]{6,}\d)"
MASK_ID = r"(?iU)\b(CLM|CLAIM|PN|POLICY|POL)\b([-:\s]*)?([A-Z0-9\-_/]+)"
MASK_NAME = r"(?U)(?<![\p{L}\p{N}_])([A-Z][a-z]+)[\s\x1c-\x1f]+([A-Z])[a-z]+(?![\p{L}\p{N}_])"  # Python's \b and \s

# Replacements before compatibility forms are folded, and mistyped mail domains.
PUNCTUATION = {"\ufb01": "fi", "\ufb02": "fl", "\u2013": "-", "\u2014": "-", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"'}
DOMAINS = {"gmai.com": "gmail.com", "gmial.com": "gmail.com", "hotnail.com": "hotmail.com", "outllok.com": "outlook.com", "yaho.com": "yahoo.com", "icloud.con": "icloud.com"}
ODD_DOMAIN_END = r"\.(con|cm|coo|gmal|hotnail)$"
SEVERE_DAMAGE = "fire|arson|theft|total loss|totaled|collision"
WEAK_LABELS = ("low", "very low", "weak")
ROLES = ("admin", "reviewer", "auditor", "viewer")


@dataclass(frozen=True)
class Settings:
    """What a deployment may change; the defaults are the rules' own."""

    low_score: float = 0.6
    max_amount: float = 1e10
    future_days: int = 1
    old_days: int = 5 * 365
    retention_days: int = 1825
    archive_days: int = 730
    context_lines: int = 40
    review_confidence: float = 0.8
    field_confidence: float = 0.5
    model_tries: int = 2
    model_pause: float = 0.8

    @classmethod
    def load(cls, conf: Callable[[str], str | None] | None = None, env: Mapping[str, str] = os.environ) -> Settings:
        """The defaults, under what ``ADJUDICA_<NAME>`` in the environment or ``adjudica.<name>`` in ``conf`` (such as
        ``lambda k: spark.conf.get(k, None)``) say; conf counts most. A value that is no number raises ValueError."""
        given = {}
        for f in fields(cls):
            raw = (conf(f"adjudica.{f.name}") if conf else None) or env.get(f"ADJUDICA_{f.name.upper()}")
            if raw:
                given[f.name] = type(f.default)(float(raw))
        return cls(**given)


DEFAULTS = Settings()
