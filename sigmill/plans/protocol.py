"""Analysis requests: what may be asked, in one canonical form."""

from __future__ import annotations

import dataclasses
import datetime
import hashlib
import json
import re
from dataclasses import dataclass

from sigmill.errors import InvalidProtocol

#: fixed values: ids and vocabularies of requests
SCHEMA = "sigmill/v1"
SOFTWARE = {"name": "sigmill", "version": "0.1.0"}
DRUG_ROLES = ("primary_suspect", "secondary_suspect", "concomitant", "interacting", "suspect", "all")
EVENT_SCOPES = ("all_recorded_source_pts",)
COMPARATORS = ("all_other_eligible_reports",)
METHODS = ("prr", "ror", "fisher_exact", "bcpnn_ic", "gps_ebgm")
BATCH_METHODS = ("bcpnn_ic", "gps_ebgm")
SUBGROUPS = ("age_group", "sex", "country", "seriousness", "calendar_period")
PROFILES = ("none", "evans_educational")
SAFE_ID = re.compile(r"[a-z0-9](?:[a-z0-9._-]{0,126}[a-z0-9])?")
DRUG_SOURCES = {"faers-prod_ai": "PROD_AI", "faers-drugname": "DRUGNAME"}


@dataclass(frozen=True)
class Protocol:
    dataset_id: str
    drug_concept_id: str
    drug_role: str
    methods: tuple[str, ...]
    threshold_profile: str = "none"
    event_scope: str = EVENT_SCOPES[0]
    comparator: str = COMPARATORS[0]
    start_date: str = ""
    end_date: str = ""
    subgroups: tuple[tuple[str, tuple[str, ...]], ...] = ()
    schema_version: str = SCHEMA

    def drug(self) -> tuple[str, str]:
        """Source field and text of the drug concept; its prefix ignores case, its text doesn't."""
        prefix, mark, text = self.drug_concept_id.partition(":")
        if not mark or prefix.lower() not in DRUG_SOURCES or not text:
            raise InvalidProtocol(f"drug concept {self.drug_concept_id!r} is not <source>:<text>")
        return DRUG_SOURCES[prefix.lower()], text


def _date(text: str) -> datetime.date | None:
    try:
        return datetime.date.fromisoformat(text) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) else None
    except ValueError:
        return None


def normalise(p: Protocol) -> Protocol:
    """The request trimmed, in lower case where case doesn't matter, its sets sorted; raises with all problems at once."""
    low = lambda s: s.strip().lower()
    groups: dict[str, set[str]] = {}
    for dimension, values in p.subgroups:
        groups.setdefault(low(dimension), set()).update(v.strip() for v in values)
    q = dataclasses.replace(
        p,
        schema_version=p.schema_version.strip(),
        dataset_id=p.dataset_id.strip(),
        drug_concept_id=p.drug_concept_id.strip(),
        drug_role=low(p.drug_role),
        event_scope=low(p.event_scope),
        comparator=low(p.comparator),
        threshold_profile=p.threshold_profile.strip(),
        methods=tuple(sorted({low(m) for m in p.methods})),
        subgroups=tuple((d, tuple(sorted(v))) for d, v in sorted(groups.items())),
    )
    start, end = _date(q.start_date), _date(q.end_date)
    problems = [
        text
        for bad, text in (
            (q.schema_version != SCHEMA, "schema_version"),
            (not SAFE_ID.fullmatch(q.dataset_id), "dataset_id"),
            (not 1 <= len(q.drug_concept_id) <= 256, "drug_concept_id"),
            (q.drug_role not in DRUG_ROLES, "drug_role"),
            (q.event_scope not in EVENT_SCOPES, "event_scope"),
            (q.comparator not in COMPARATORS, "comparator"),
            (q.threshold_profile not in PROFILES, "threshold_profile"),
            (not q.methods or not set(q.methods) <= set(METHODS), "methods"),
            (q.start_date != "" and start is None, "start_date"),
            (q.end_date != "" and end is None, "end_date"),
            (start is not None and end is not None and end < start, "period"),
            (any(d not in SUBGROUPS or not v or any(not 1 <= len(x) <= 128 for x in v) for d, v in q.subgroups), "subgroups"),
        )
        if bad
    ]
    if problems:
        raise InvalidProtocol("invalid " + ", ".join(problems))
    return q


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def analysis_id(p: Protocol, manifest_hash: str, software: dict | None = None) -> str:
    """Id of the request over a data set by a software; equal requests in any spelling have one id."""
    return digest({"schema": SCHEMA, "manifest": manifest_hash, "software": software or SOFTWARE, "request": dataclasses.asdict(normalise(p))})
