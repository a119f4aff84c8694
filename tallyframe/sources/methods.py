"""Spaces of modelling methods inside a project, and configuration sources."""

from __future__ import annotations

import copy
import hashlib
import inspect
import json
import os
import re
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path
from typing import Any

import yaml

from ..errors import ExperimentError
from .registry import Registry, RunSession, write_json

TEMPLATE = "# Parameters of the baseline; edit freely, it is never overwritten.\n"


def compose(*sources: Mapping[str, Any] | str | Path, overrides: Sequence[str] = ()) -> dict[str, Any]:
    """Mappings and YAML files merged key by key, later ones first, then ``a.b=value`` overrides."""
    out: dict[str, Any] = {}
    for source in sources:
        given = source if isinstance(source, Mapping) else yaml.safe_load(Path(source).read_text()) or {}
        if not isinstance(given, Mapping):
            raise ExperimentError(f"{source} is not a mapping")
        _merge(out, given)
    for text in overrides:
        path, sign, value = text.partition("=")
        if not sign or not path:
            raise ExperimentError(f"an override reads key=value: {text}")
        *heads, last = path.split(".")
        at = out
        for head in heads:
            at = at.setdefault(head, {})
            if not isinstance(at, dict):
                raise ExperimentError(f"{path}: {head} is not a mapping")
        at[last] = yaml.safe_load(value)
    return out


def _merge(into: dict[str, Any], given: Mapping[str, Any]) -> None:
    for key, value in given.items():
        if isinstance(value, Mapping) and isinstance(into.get(key), dict):
            _merge(into[key], value)
        else:
            into[key] = copy.deepcopy(dict(value) if isinstance(value, Mapping) else value)


def callable_identity(function: Callable[..., Any]) -> dict[str, str]:
    """Where a function is defined and a digest of its source, for the record."""
    try:
        source = inspect.getsource(function)
    except (OSError, TypeError):
        source = repr(getattr(function, "__code__", None) and function.__code__.co_code)
    return {"name": f"{getattr(function, '__module__', '?')}.{getattr(function, '__qualname__', type(function).__name__)}", "sha256": hashlib.sha256(source.encode()).hexdigest()}


def snapshot(value: Any) -> Any:
    """A detached copy that JSON can hold, with functions as their identities."""
    if isinstance(value, Mapping):
        return {str(k): snapshot(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [snapshot(v) for v in (sorted(value) if isinstance(value, (set, frozenset)) else value)]
    if callable(value):
        return callable_identity(value)
    if isinstance(value, Path):
        return str(value)
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise ExperimentError(f"{type(value).__name__} can't be recorded")


class MethodSpace(Registry):
    """A project's store for one method: its baseline, its reports and its runs."""

    def __init__(self, root: Path, manifest: dict[str, Any]):
        super().__init__(root, manifest["name"])
        self.manifest = manifest

    @property
    def config_dir(self) -> Path:
        return self.root / "configs"

    @property
    def reports_dir(self) -> Path:
        return self.root / "reports"

    @property
    def comparison_partitions(self) -> tuple[str, ...] | None:
        given = self.manifest.get("comparison_partitions")
        return tuple(given) if given else None

    def baseline(self) -> dict[str, Any]:
        return compose(self.config_dir / "baseline.yaml")

    def start_run(self, name: str, *, label: str | None = None, config: Mapping[str, Any] | str | Path | None = None, task: Mapping[str, Any] | None = None) -> RunSession:
        """A run with its inputs as they are now; nothing is trained here."""
        made = None if config is None else snapshot(compose(config))
        session = super().start_run(name, label=label, config=made)
        session.log_model_info(**{"method": self.manifest["name"], "family": self.manifest["family"]} | ({"task": snapshot(task)} if task else {}))
        return session

    def compare(self, spark, runs=None, partitions=None):
        return super().compare(spark, runs, self.comparison_partitions if partitions is None else partitions)


def _place(project: str | Path, method: str) -> Path:
    if not re.fullmatch(r"[a-z][a-z0-9_]*", method):
        raise ExperimentError(f"a method's name is lower-case letters, digits and underscores: {method!r}")
    return Path(project) / "methods" / method


def initialize(project: str | Path, method: str, *, family: str | None = None, baseline: Mapping[str, Any] | None = None, comparison_partitions: Sequence[str] | None = None) -> MethodSpace:
    """The method's space, made if need be.  A baseline that exists is kept, and giving one again is an error."""
    root = _place(project, method)
    manifest_path, config = root / "method.json", root / "configs" / "baseline.yaml"
    if config.exists() and baseline is not None:
        raise ExperimentError("the baseline exists; open the method and edit it")
    known = _manifest(manifest_path) if manifest_path.exists() else None
    if known and family not in (None, known["family"]):
        raise ExperimentError(f"{method} is of family {known['family']}")
    if not known:
        for folder in ("configs", "reports"):
            (root / folder).mkdir(parents=True, exist_ok=True)
        known = {"name": method, "family": family or method, "comparison_partitions": list(comparison_partitions or [])}
        write_json(manifest_path, known)
    try:
        with os.fdopen(os.open(config, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644), "w") as out:
            out.write(TEMPLATE + yaml.safe_dump(snapshot(baseline or {}), sort_keys=True))
    except FileExistsError:
        pass
    return MethodSpace(root, known)


def open_method(project: str | Path, method: str) -> MethodSpace:
    """A space that exists."""
    manifest = _place(project, method) / "method.json"
    if not manifest.is_file():
        raise ExperimentError(f"{method} is not initialised")
    return MethodSpace(manifest.parent, _manifest(manifest))


def methods(project: str | Path) -> list[str]:
    return sorted(p.parent.name for p in (Path(project) / "methods").glob("*/method.json"))


def _manifest(path: Path) -> dict[str, Any]:
    try:
        found = json.loads(path.read_text())
    except ValueError as error:
        raise ExperimentError(f"{path} is not a method manifest") from error
    if not isinstance(found, dict) or not isinstance(found.get("family"), str) or found.get("name") != path.parent.name:
        raise ExperimentError(f"{path} is not a method manifest")
    return found
