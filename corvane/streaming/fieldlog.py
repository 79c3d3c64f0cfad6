"""A field log: one JSON line per command, appended where the user asks for it."""

from __future__ import annotations

import json
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "at string, command string, exit int, ms double"


def _append(path: Path, line: str) -> bool:
    try:
        with path.open("a", encoding="utf-8") as f:
            f.write(line + "\n")
    except OSError:
        return False
    return True


def record(entry: dict, place: str | None, root: str | None = None) -> None:
    """Append ``entry`` with the time to ``place``, if one is given; where that can't be
    written, to the index folder of ``root``, with a notice. Never fails a command."""
    if not place:
        return
    line = json.dumps({"at": datetime.now(UTC).isoformat(timespec="seconds"), **entry}, sort_keys=True, default=str)
    if _append(Path(place), line):
        return
    other = Path(root) / ".corvane" / "field.jsonl" if root else None
    used = other is not None and other.parent.is_dir() and _append(other, line)
    print(f"field log: cannot write {place}, " + (f"using {other}" if used else "nothing is recorded"), file=sys.stderr)


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the logs in a folder as a stream."""
    return spark.readStream.schema(SCHEMA).json(folder)
