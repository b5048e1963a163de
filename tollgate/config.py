"""Limits, thresholds and fixed values of the release gate.

Everything in the FIXED VALUES block must stay equal to the behaviour the
gate reproduces (patterns, word lists, thresholds, wording keys); the rest
is configuration.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reproduced behaviour; natural order, as text)
# ---------------------------------------------------------------------------

#: Column-role candidates, tried in this order when a role is not configured.
LABEL_CANDIDATES = ("label", "target", "class", "outcome", "category")
SPLIT_CANDIDATES = ("split", "set", "partition", "fold")
ID_CANDIDATES = ("id", "record_id", "row_id", "uuid")

#: Header names that intake refuses (compared in lower case).
FORBIDDEN_KEYS = ("__proto__", "constructor", "prototype")

#: Metadata fields of one release, in their natural order.
METADATA_FIELDS = (
    "dataset_name",
    "provenance",
    "license",
    "purpose",
    "label_column",
    "split_column",
    "id_column",
)

#: Placeholder words that count as "no statement" for provenance/license.
PLACEHOLDER_PATTERN = r"^(unknown|n/?a|none|tbd|unspecified)$"

#: PII kinds in emission order, with their singular and plural titles.
PII_KINDS = ("email", "phone", "nric", "ip")
PII_TITLES = {
    "email": ("email address", "email addresses"),
    "phone": ("Malaysian phone number", "Malaysian phone numbers"),
    "nric": ("Malaysian NRIC-like value", "Malaysian NRIC-like values"),
    "ip": ("IPv4 address", "IPv4 addresses"),
}

#: The eleven finding categories in emission order.
CATEGORIES = (
    "pii-email",
    "pii-phone",
    "pii-nric",
    "pii-ip",
    "exact-duplicate",
    "near-duplicate",
    "split-leakage",
    "conflicting-label",
    "class-imbalance",
    "missing-provenance",
    "missing-license",
)

#: Near-duplicate thresholds: Jaccard >= 82/100, size ratio >= 3/4,
#: left token set of at least 5 tokens.
JACCARD_NUM, JACCARD_DEN = 82, 100
MIN_NEAR_TOKENS = 5

#: Class-imbalance rule: at least 10 rows, 2 classes, and a majority share
#: above 0.75 or a minority share below 0.15.
IMBALANCE_MIN_ROWS = 10
IMBALANCE_MAJORITY = 0.75
IMBALANCE_MINORITY = 0.15

SCHEMA_VERSION = "1.0"
DETECTOR_VERSION = "tollgate-detectors-2"

# ---------------------------------------------------------------------------
# Configuration
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Limits:
    """Intake and report limits; ``None`` means unlimited.

    The readers refuse a source that breaks a limit, by row or column number
    only; nothing is ever cut to fit.  Near duplicates are decided on all
    tokens of a row; a ``token_limit`` compares openings instead and is meant
    for callers who ask for that.  ``evidence_per_finding`` above 1,000 is
    refused: beyond it Spark no longer limits groups before the shuffle.
    """

    rows: int | None = None
    bytes: int | None = None
    columns: int | None = None
    key_characters: int = 128
    cell_characters: int | None = 4096
    metadata_characters: int = 500
    evidence_per_finding: int = 6
    token_limit: int | None = None

    def __post_init__(self):
        if not 0 <= self.evidence_per_finding <= 1000:
            raise ValueError("evidence_per_finding must lie between 0 and 1,000")


#: The intake limits of one interactive request.
REQUEST_LIMITS = Limits(rows=1000, bytes=1_000_000, columns=40)


@dataclass(frozen=True)
class Roles:
    """Resolved column roles; each may be ``None``."""

    label: str | None = None
    split: str | None = None
    id: str | None = None


@dataclass(frozen=True)
class Release:
    """Metadata of one release (one row of a ``releases`` table)."""

    release_id: str = "release"
    dataset_name: str = ""
    provenance: str = ""
    license: str = ""
    purpose: str = ""
    label_column: str = ""
    split_column: str = ""
    id_column: str = ""
    extra: dict = field(default_factory=dict, compare=False)


#: What a reader of a report must know about its reach.
LIMITATIONS = (
    "Identifiers are found by pattern; names, addresses and free descriptions of a person are not.",
    "Similarity is judged by shared words, so a paraphrase or a translation is not found.",
    "Provenance and license are checked for presence only, not for truth.",
)
