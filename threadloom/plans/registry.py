"""Named measurements: registering, listing and running them with their provenance."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measurement:
    """``compute`` takes a mapping of input tables; ``null_model`` is optional and takes the same."""

    definition_id: str
    version: str
    compute: Callable[[Mapping[str, DataFrame]], DataFrame]
    null_model: Callable[[Mapping[str, DataFrame]], DataFrame] | None = None
    parameters: Mapping[str, Any] = field(default_factory=dict)

    def fingerprint(self, inputs: str) -> str:
        """Identifies a result: the definition, its version and parameters, and what it was computed from."""
        payload = json.dumps([self.definition_id, self.version, dict(self.parameters), inputs], sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(payload.encode()).hexdigest()


class Registry:
    """Measurements by id; an id can be registered once."""

    def __init__(self) -> None:
        self._held: dict[str, Measurement] = {}

    def register(self, measurement: Measurement) -> None:
        if measurement.definition_id in self._held:
            raise ValueError(f"{measurement.definition_id} is registered already")
        self._held[measurement.definition_id] = measurement

    def get(self, definition_id: str) -> Measurement:
        if definition_id not in self._held:
            raise KeyError(f"no measurement {definition_id}")
        return self._held[definition_id]

    def definitions(self) -> tuple[str, ...]:
        return tuple(sorted(self._held))

    def execute(self, definition_id: str, tables: Mapping[str, DataFrame], inputs: str = "") -> DataFrame:
        """The result with columns definition_id, version and fingerprint."""
        m = self.get(definition_id)
        out = m.compute(tables)
        return out.select(
            F.lit(m.definition_id).alias("definition_id"), F.lit(m.version).alias("version"), F.lit(m.fingerprint(inputs)).alias("fingerprint"), *out.columns
        )


def artifact_json(rows: DataFrame) -> DataFrame:
    """(payload, content_hash): each row as canonical JSON, keys in alphabetical order."""
    payload = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    return rows.select(payload.alias("payload"), F.sha2(payload, 256).alias("content_hash"))
