"""A run of stages with records, gates and content-hashed artifacts.

A stage is a function of the tables made so far. The runner checks what a stage may read, materialises its result in
the shared folder, and records status, rows and digest. A failed mandatory stage ends the run; a failed optional
one doesn't, but the run then is DEGRADED, never a plain success.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklattice.operators import audits, policy
from tracklattice.plans.shared import materialize

MANDATORY, CONDITIONAL, OPTIONAL = "MANDATORY", "CONDITIONAL", "OPTIONAL"


class ContractViolation(Exception):
    """A stage was given, or gave, what its contract forbids."""


class DataLeakage(ContractViolation):
    """Evaluation truth reached an estimating stage."""


@dataclass(frozen=True)
class Artifact:
    """A stage's result: table, domain, unit, digest."""

    name: str
    table: DataFrame = field(repr=False)
    digest: str
    rows: int
    domain: str = "OBSERVATION"
    unit: str = "RECONSTRUCTION_UNITS"


@dataclass(frozen=True)
class Stage:
    """A named step: what it reads, what it makes, whether the run needs it."""

    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    reads: tuple[str, ...] = ()
    kind: str = MANDATORY
    enabled: bool = True
    unit: str = "RECONSTRUCTION_UNITS"


@dataclass(frozen=True)
class Record:
    """What became of a stage."""

    stage: str
    status: str
    reason: str | None
    rows: int
    seconds: float
    digest: str | None


def admit(name: str, table: DataFrame, domain: str = "OBSERVATION", unit: str = "RECONSTRUCTION_UNITS", scale_state: str | None = None) -> Artifact:
    """An input or result as an artifact. Forbidden columns, truth and unfounded units are refused."""
    if domain == "EVALUATION_TRUTH":
        raise DataLeakage(f"{name}: evaluation truth isn't an input")
    leaked = sorted(set(c.lower() for c in table.columns) & set(policy.FORBIDDEN_KEYS))
    if leaked:
        raise DataLeakage(f"{name}: forbidden columns {leaked}")
    if unit == "METRES" and scale_state not in ("METRIC_SCALE_ESTIMATED", "METRIC_SCALE_VALIDATED"):
        raise ContractViolation(f"{name}: metres without a metric scale")
    d = audits.table_digest(table).first()
    return Artifact(name, table, d["digest"], d["n"], domain, unit)


def config_hash(*configs) -> str:
    """SHA-256 of all configurations, nested ones too."""
    return hashlib.sha256(json.dumps([asdict(c) for c in configs], sort_keys=True, default=str).encode()).hexdigest()


def run(stages: list[Stage], inputs: list[Artifact]) -> tuple[str, dict[str, Artifact], list[Record]]:
    """(status, artifacts, records): SUCCESS, DEGRADED or FAILED."""
    made, records, status = {a.name: a for a in inputs}, [], "SUCCESS"
    for stage in stages:
        began = time.monotonic()
        note = lambda state, reason=None, a=None: records.append(Record(stage.name, state, reason, a.rows if a else 0, time.monotonic() - began, a.digest if a else None))  # noqa: B023, E731
        if not stage.enabled:
            note("NOT_EVALUABLE", "disabled")
            continue
        missing = [r for r in stage.reads if r not in made]
        try:
            if missing:
                raise ContractViolation(f"needs {missing}")
            for r in stage.reads:
                if audits.table_digest(made[r].table).first()["digest"] != made[r].digest:
                    raise ContractViolation(f"{r} has changed since it was made")
            made[stage.name] = admit(stage.name, materialize(stage.run({r: made[r].table for r in stage.reads}), f"stage-{stage.name}"), unit=stage.unit)
            note("SUCCESS", None, made[stage.name])
        except Exception as e:
            state = "CONTRACT_VIOLATION" if isinstance(e, ContractViolation) else "FAILED"
            if missing and stage.kind != MANDATORY:
                note("NOT_EVALUABLE", str(e))
                continue
            note(state, f"{type(e).__name__}: {str(e)[:300]}")
            if stage.kind == MANDATORY:
                return "FAILED", made, records
            status = "DEGRADED"
    return status, made, records


def records_table(df: DataFrame, records: list[Record]) -> DataFrame:
    """The records as a table, without their times, which differ between runs."""
    return df.sparkSession.createDataFrame([(r.stage, r.status, r.reason, r.rows, r.digest) for r in records], "stage string, status string, reason string, rows long, digest string").withColumn("order", F.monotonically_increasing_id())
