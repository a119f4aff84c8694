"""A file-backed registry of runs, read back as DataFrames.

Each run is a numbered folder with ``run.json`` and its artifacts.  Records move
from ``running`` to ``completed`` or ``failed`` once and are then final.
"""

from __future__ import annotations

import datetime
import fcntl
import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ExperimentError, RunError
from ..functions.expr import score_slice

STATUSES = ("running", "completed", "failed")
RECORD = "run_id string, name string, label string, status string, started_at string, ended_at string, config map<string,string>, metrics map<string,map<string,double>>, result map<string,string>, error string"


def write_json(path: Path, value: Any) -> None:
    handle, temporary = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w") as out:
        json.dump(value, out, indent=1, sort_keys=True)
    os.replace(temporary, path)


def flatten(value: Any, prefix: str = "") -> dict[str, str]:
    """Nested mappings as dotted keys with JSON texts."""
    if not isinstance(value, dict):
        return {prefix: json.dumps(value, sort_keys=True)}
    out: dict[str, str] = {}
    for key, inner in value.items():
        out |= flatten(inner, f"{prefix}.{key}" if prefix else str(key))
    return out


class RunSession:
    """A run being recorded; leaving the block completes it, an error fails it."""

    def __init__(self, path: Path, record: dict[str, Any]):
        self.path, self.record, self.open = path, record, True

    @property
    def run_id(self) -> str:
        return self.record["run_id"]

    def __enter__(self) -> RunSession:
        return self

    def _save(self) -> None:
        write_json(self.path / "run.json", self.record)

    def _once(self, key: str, value: Any) -> None:
        if not self.open:
            raise RunError("the run has ended")
        if self.record.get(key):
            raise RunError(f"{key} is already recorded")
        self.record[key] = value
        self._save()

    def log_params(self, params: dict[str, Any]) -> None:
        self._once("params", params)

    def log_input(self, **facts: Any) -> None:
        self._once("input", facts)

    def log_model_info(self, **facts: Any) -> None:
        self._once("model", facts)

    def log_metrics(self, metrics: dict[str, dict[str, float]]) -> None:
        """Values by partition and metric."""
        self._once("metrics", {p: {k: float(v) for k, v in m.items()} for p, m in metrics.items()})

    def log_result(self, **facts: Any) -> None:
        self._once("result", facts)

    def log_artifact(self, name: str, filename: str, writer: Callable[[Path], None], *, format: str = "file") -> Path:
        target = self.path / "artifacts" / filename
        if not self.open or name in self.record["artifacts"] or ".." in Path(filename).parts or Path(filename).is_absolute():
            raise RunError(f"artifact {name} can't be written")
        target.parent.mkdir(parents=True, exist_ok=True)
        writer(target)
        self.record["artifacts"][name] = {"path": str(target.relative_to(self.path)), "format": format, "sha256": digest(target)}
        self._save()
        return target

    def log_json(self, name: str, value: Any) -> Path:
        return self.log_artifact(name, f"{name}.json", lambda p: write_json(p, value), format="json")

    def log_file(self, name: str, source: str | Path, filename: str | None = None) -> Path:
        return self.log_artifact(name, filename or Path(source).name, lambda p: shutil.copyfile(source, p))

    def __exit__(self, kind, error, trace) -> bool:
        self.record["status"] = "failed" if error else "completed"
        self.record["error"] = f"{kind.__name__}: {error}" if error else None
        self.record["ended_at"] = _now()
        self.open = False
        self._save()
        return False


def digest(path: Path) -> str:
    return hashlib.sha256(path.read_bytes()).hexdigest()


def _now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).isoformat()


class Registry:
    def __init__(self, root: str | Path, name: str = "default"):
        self.root, self.name = Path(root), name
        (self.root / "runs").mkdir(parents=True, exist_ok=True)

    def start_run(self, name: str, *, label: str | None = None, config: dict[str, Any] | str | None = None) -> RunSession:
        """Allocate the next number under a file lock; ``config`` may be a YAML path."""
        if isinstance(config, str):
            import yaml

            config = yaml.safe_load(Path(config).read_text())
        with open(self.root / ".lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            number = max((int(p.name.split("-")[0]) for p in (self.root / "runs").iterdir()), default=0) + 1
            path = self.root / "runs" / f"{number:04d}-{''.join(c if c.isalnum() else '-' for c in name)}"
            path.mkdir()
        record = {"run_id": path.name, "name": name, "label": label, "status": "running", "started_at": _now(), "ended_at": None, "config": config or {}, "metrics": {}, "result": {}, "artifacts": {}, "error": None}
        session = RunSession(path, record)
        session._save()
        return session

    def _records(self) -> list[dict[str, Any]]:
        found = []
        for path in sorted((self.root / "runs").glob("*/run.json")):
            record = json.loads(path.read_text())
            if record.get("status") not in STATUSES or record.get("run_id") != path.parent.name:
                raise ExperimentError(f"{path} is not a valid record")
            found.append(record)
        return sorted(found, key=lambda r: (r["started_at"], r["run_id"]))

    def frame(self, spark: SparkSession) -> DataFrame:
        """All records, configurations flattened."""
        rows = [(r["run_id"], r["name"], r["label"], r["status"], r["started_at"], r["ended_at"], flatten(r["config"]) if r["config"] else {}, r["metrics"], {k: json.dumps(v) for k, v in r["result"].items()}, r["error"]) for r in self._records()]
        return spark.createDataFrame(rows, RECORD)

    def runs(self, spark: SparkSession, status: str | None = None) -> DataFrame:
        out = self.frame(spark).select("run_id", "name", "label", "status", "started_at", "ended_at", "error")
        return (out if status is None else out.filter(F.col("status") == status)).orderBy("started_at", "run_id")

    def resolve(self, reference: str) -> dict[str, Any]:
        """A run by id, else label, else name; more than one match is an error."""
        records = self._records()
        for key in ("run_id", "label", "name"):
            hits = [r for r in records if r[key] == reference]
            if len(hits) > 1:
                raise ExperimentError(f"{reference} matches {len(hits)} runs by {key}")
            if hits:
                return hits[0]
        raise ExperimentError(f"no run {reference}")

    def verify(self, reference: str) -> None:
        record = self.resolve(reference)
        for name, facts in record["artifacts"].items():
            if digest(self.root / "runs" / record["run_id"] / facts["path"]) != facts["sha256"]:
                raise RunError(f"artifact {name} has changed")

    def read_json(self, reference: str, artifact: str) -> Any:
        record = self.resolve(reference)
        return json.loads((self.root / "runs" / record["run_id"] / record["artifacts"][artifact]["path"]).read_text())

    def compare(self, spark: SparkSession, runs: Sequence[str] | None = None, partitions: Sequence[str] | None = None) -> DataFrame:
        """A row a run, a column for each partition and metric."""
        frame = self.frame(spark)
        if runs is not None:
            frame = frame.filter(F.col("run_id").isin([self.resolve(r)["run_id"] for r in runs]))
        cells = frame.select("run_id", F.explode("metrics").alias("part", "m")).select("run_id", "part", F.explode("m").alias("metric", "value"))
        if partitions is not None:
            cells = cells.filter(F.col("part").isin(list(partitions)))
        heads = sorted({f"{r[0]}.{r[1]}" for r in cells.select("part", "metric").distinct().collect()})
        base = frame.select("run_id", "name", "label", "status")
        if not heads:
            return base
        pivoted = cells.withColumn("h", F.concat_ws(".", "part", "metric")).groupBy(F.col("run_id").alias("__r")).pivot("h", heads).agg(F.first("value"))
        return base.join(pivoted, F.col("run_id") == F.col("__r"), "left").drop("__r")

    def compare_params(self, spark: SparkSession, left: str, right: str, only_changed: bool = True) -> DataFrame:
        """A full outer join of two runs' flattened configurations."""
        sides = [spark.createDataFrame(sorted(flatten(self.resolve(r)["config"]).items()), f"key string, {n} string") for r, n in ((left, "left"), (right, "right"))]
        joined = sides[0].join(sides[1], "key", "full_outer")
        change = F.when(F.col("left").isNull(), "added").when(F.col("right").isNull(), "removed").when(F.col("left") != F.col("right"), "modified").otherwise("unchanged")
        out = joined.select("key", "left", "right", F.col("left").isNotNull().alias("in_left"), F.col("right").isNotNull().alias("in_right"), change.alias("change"))
        return out.filter("change <> 'unchanged'") if only_changed else out


def importance_ranks(df: DataFrame, columns: Sequence[str] = ("gain", "split")) -> DataFrame:
    """Rank of each importance, largest first, ties at the smaller rank, nulls last.

    Distinct values are counted and only their running count is ordered, over
    monotone slices of the range, so no column is sorted in one task.
    """
    out = df
    for c in columns:
        x = F.col("__v").cast("double")
        # NaN is above infinity, which has the last slice; null is below all.
        place = F.when(x.isNull(), F.lit(-(2**63))).when(F.isnan(x), F.lit(2**63 - 1)).otherwise(score_slice(x))
        counted = df.select(F.col(c).alias("__v")).groupBy("__v").agg(F.count("*").alias("__n")).withColumn("__b", place)
        per = counted.groupBy("__b").agg(F.sum("__n").alias("__n"))
        above = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
        offsets = per.select(F.col("__b").alias("__ob"), F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__o"))
        larger = Window.partitionBy("__b").orderBy(F.desc("__v")).rowsBetween(Window.unboundedPreceding, -1)
        rank = F.coalesce(F.sum("__n").over(larger), F.lit(0)) + F.col("__o") + 1
        ranked = counted.join(offsets, F.col("__b") == F.col("__ob")).select("__v", rank.alias(f"{c}_rank"))
        out = out.join(ranked, F.col(c).eqNullSafe(F.col("__v")), "left").drop("__v")
    return out
