"""Sealed parts of the data: reads are refused unless unlocked, and every permitted read is recorded."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SealedData(PermissionError):
    """A read of sealed data without lock and flag."""


@dataclass
class Guard:
    """Which values of a column are sealed, and whether they may be read."""

    column: str
    sealed: frozenset
    lock: bool = False
    allow: bool = False
    ledger: Path | None = None
    reads: list[dict] = field(default_factory=list)

    def check(self, wanted: Iterable) -> None:
        asked = sorted(set(wanted) & self.sealed)
        if asked and not (self.lock and self.allow):
            raise SealedData(f"{self.column} {asked} are sealed: a frozen lock and an explicit flag are needed")

    @contextmanager
    def recording(self, wanted: Iterable, reason: str) -> Iterator[None]:
        """Record a read of sealed values, also when it fails."""
        wanted = sorted(set(wanted))
        self.check(wanted)
        row = {"at": time.time(), "values": [str(x) for x in wanted], "reason": reason, "outcome": "failed"}
        try:
            yield
            row["outcome"] = "done"
        finally:
            if set(wanted) & self.sealed:
                self.reads.append(row)
                if self.ledger:
                    with self.ledger.open("a") as f:
                        f.write(json.dumps(row) + "\n")

    def read(self, df: DataFrame, wanted: Iterable) -> DataFrame:
        """The wanted part of `df`; the condition reaches the scan."""
        wanted = sorted(set(wanted))
        self.check(wanted)
        return df.where(F.col(self.column).isin(*wanted))

    def open_part(self, df: DataFrame) -> DataFrame:
        """What isn't sealed."""
        return df.where(~F.col(self.column).isin(*sorted(self.sealed)))
