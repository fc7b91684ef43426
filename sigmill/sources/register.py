"""Registers of source files, archives and data set manifests: small metadata that is checked before any data is read."""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import zipfile
from dataclasses import dataclass
from pathlib import Path

from sigmill.errors import ArchiveRejected, DatasetNotFound, InvalidManifest, InvalidRegister
from sigmill.plans.protocol import SAFE_ID, digest

#: fixed values: limits of an archive; size of a manifest; columns of a register
ARCHIVE_MEMBERS, ARCHIVE_BYTES, ARCHIVE_EXPANSION = 128, 16 << 30, 100
MANIFEST_BYTES = 4 << 20
REGISTER_COLUMNS = ("quarter", "file", "source_url", "retrieved_at", "coverage_start", "coverage_end", "sha256")
_QUARTER = re.compile(r"(20\d\d)Q([1-4])")
_FILE = re.compile(r"(?i)^(demo|drug|reac)(\d{4}|\d{2})q([1-4])\.txt$")


def coverage(quarter: str) -> tuple[str, str]:
    """First and last day of a calendar quarter."""
    if not (m := _QUARTER.fullmatch(quarter)):
        raise InvalidRegister(f"quarter {quarter!r} is not like 2024Q1")
    year, month = int(m[1]), int(m[2]) * 3 - 2
    following = datetime.date(year + month // 10, (month + 2) % 12 + 1, 1)
    return datetime.date(year, month, 1).isoformat(), (following - datetime.timedelta(days=1)).isoformat()


def classify(name: str) -> tuple[str, str] | None:
    """Table and quarter of a file by its name (``DEMO24Q1.txt``), None for other files."""
    if not (m := _FILE.match(Path(name).name)):
        return None
    year = m[2] if len(m[2]) == 4 else "20" + m[2]
    return m[1].lower(), f"{year}Q{m[3]}"


def check_register(rows: list[dict[str, str]], host: str) -> None:
    """Raises unless every row names a quarter, HTTPS on ``host`` or below it, a UTC time, its exact calendar quarter and
    a SHA-256."""
    if not rows:
        raise InvalidRegister("no files")
    url = re.compile(rf"(?i)https://([a-z0-9-]+\.)*{re.escape(host)}(:443)?([/?#].*)?")
    for n, row in enumerate(rows, 1):
        if missing := [c for c in REGISTER_COLUMNS if not row.get(c)]:
            raise InvalidRegister(f"row {n}: missing {missing}")
        if (row["coverage_start"], row["coverage_end"]) != coverage(row["quarter"]):
            raise InvalidRegister(f"row {n}: coverage is not the quarter's")
        if not url.fullmatch(row["source_url"]):
            raise InvalidRegister(f"row {n}: source_url")
        if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", row["retrieved_at"]):
            raise InvalidRegister(f"row {n}: retrieved_at")
        if not re.fullmatch(r"[A-Fa-f0-9]{64}", row["sha256"]):
            raise InvalidRegister(f"row {n}: sha256")


def check_quarter_files(names: list[str], quarter: str) -> dict[str, str]:
    """File of each table; raises if one is missing, doubled or of another quarter."""
    found: dict[str, str] = {}
    for name in names:
        if kind := classify(name):
            if kind[1] != quarter or kind[0] in found:
                raise InvalidRegister(f"{name} does not belong to {quarter} or is doubled")
            found[kind[0]] = name
    if set(found) != {"demo", "drug", "reac"}:
        raise InvalidRegister(f"{quarter}: found only {sorted(found)}")
    return found


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def check_archive(path: str | Path, members: int = ARCHIVE_MEMBERS, size: int = ARCHIVE_BYTES, expansion: float = ARCHIVE_EXPANSION) -> list[str]:
    """Names in a ZIP whose directory keeps to the path rules and budgets; raises before anything is unpacked."""
    with zipfile.ZipFile(path) as archive:
        infos = archive.infolist()
    names = [i.filename.replace("\\", "/") for i in infos]
    if bad := [n for n in names if n.startswith("/") or re.match(r"[A-Za-z]:", n) or ".." in n.split("/")]:
        raise ArchiveRejected(f"unsafe paths: {bad}")
    total = sum(i.file_size for i in infos)
    if len(infos) > members or total > size or total > expansion * Path(path).stat().st_size:
        raise ArchiveRejected(f"{len(infos)} members, {total} bytes unpacked")
    return names


def unpack(path: str | Path, into: str | Path, quarter: str) -> dict[str, str]:
    """The quarter's three files of a checked archive, unpacked to the folder ``into``; path by table."""
    wanted = check_quarter_files(check_archive(path), quarter)
    with zipfile.ZipFile(path) as archive:
        return {kind: archive.extract(name, into) for kind, name in wanted.items()}


@dataclass(frozen=True)
class Manifest:
    dataset_id: str
    title: str
    coverage_start: str
    coverage_end: str
    counts: tuple[int, int, int, int]  # source rows, current reports, eligible reports, pairs

    def hash(self) -> str:
        return digest(vars(self) | {"counts": list(self.counts)})


def manifest(content: dict) -> Manifest:
    """A manifest from parsed JSON; unknown or missing fields and counts that can't be are errors."""
    known = set(Manifest.__dataclass_fields__)
    if set(content) != known:
        raise InvalidManifest(f"fields {sorted(set(content) ^ known)}")
    counts = tuple(content["counts"])
    if not SAFE_ID.fullmatch(content["dataset_id"]) or not str(content["title"]).strip():
        raise InvalidManifest("dataset_id or title")
    if len(counts) != 4 or any(type(c) is not int or c < 0 for c in counts) or not counts[0] >= counts[1] >= counts[2] or counts[3] < counts[2]:
        raise InvalidManifest("counts")
    try:
        if datetime.date.fromisoformat(content["coverage_start"]) > datetime.date.fromisoformat(content["coverage_end"]):
            raise ValueError
    except (TypeError, ValueError):
        raise InvalidManifest("coverage") from None
    return Manifest(**content | {"counts": counts})


class Registry:
    """The manifests of a folder (``*.json``, no links, bounded size), by data set id."""

    def __init__(self, folder: str | Path) -> None:
        self._by_id: dict[str, Manifest] = {}
        for path in sorted(Path(folder).glob("*.json")):
            if path.is_symlink() or path.stat().st_size > MANIFEST_BYTES:
                raise InvalidManifest(f"{path.name}: link or too large")
            try:
                found = manifest(json.loads(path.read_text(encoding="utf-8")))
            except (json.JSONDecodeError, TypeError, KeyError) as error:
                raise InvalidManifest(f"{path.name}: {error}") from error
            if found.dataset_id in self._by_id:
                raise InvalidManifest(f"{found.dataset_id} is registered twice")
            self._by_id[found.dataset_id] = found

    def list(self) -> list[Manifest]:
        return [self._by_id[k] for k in sorted(self._by_id)]

    def require(self, dataset_id: str) -> Manifest:
        if dataset_id not in self._by_id:
            raise DatasetNotFound(dataset_id)
        return self._by_id[dataset_id]
