"""Results that are written once: a Parquet folder and a digest under the analysis id."""

from __future__ import annotations

import json
import re
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sigmill.errors import ImmutableConflict, InvalidProtocol, ResultTooLarge
from sigmill.plans.engine import result_digest

#: fixed values: size of an exported bundle; time stamp of its members
BUNDLE_BYTES, BUNDLE_TIME = 64 << 20, (1980, 1, 1, 0, 0, 0)


class ResultStore:
    """A folder that the driver and the executors share. A result is staged and then renamed, so it is whole or absent."""

    def __init__(self, folder: str | Path) -> None:
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _place(self, analysis_id: str) -> Path:
        if not re.fullmatch("[a-f0-9]{64}", analysis_id):
            raise InvalidProtocol("analysis ids are 64 hexadecimal digits")
        return self.folder / analysis_id

    def save(self, analysis_id: str, results: DataFrame, columns: tuple[str, ...]) -> bool:
        """True if stored now, False if the same result is there; raises if another is."""
        place, found = self._place(analysis_id), result_digest(results, columns)
        if place.exists():
            if self.digest(analysis_id) != found:
                raise ImmutableConflict(analysis_id)
            return False
        staged = self.folder / f".{analysis_id}.staged"
        results.select(*columns).write.mode("overwrite").parquet(str(staged / "rows"))
        (staged / "digest.json").write_text(json.dumps({"analysis_id": analysis_id, "digest": found, "columns": list(columns)}))
        staged.rename(place)
        return True

    def digest(self, analysis_id: str) -> str:
        return json.loads((self._place(analysis_id) / "digest.json").read_text())["digest"]

    def load(self, spark: SparkSession, analysis_id: str) -> DataFrame:
        return spark.read.parquet(str(self._place(analysis_id) / "rows"))

    def export(self, analysis_id: str, path: str | Path) -> None:
        """All files of a result as a ZIP that is the same to the byte each time."""
        place = self._place(analysis_id)
        files = sorted(p for p in place.rglob("*") if p.is_file() and p.suffix != ".crc")
        if sum(p.stat().st_size for p in files) > BUNDLE_BYTES:
            raise ResultTooLarge("bundle")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as bundle:
            for p in files:
                bundle.writestr(zipfile.ZipInfo(p.relative_to(place).as_posix(), BUNDLE_TIME), p.read_bytes())
