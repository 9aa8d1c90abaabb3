"""Detectors as plug-ins: registered by name, run on files, united with the origin of each finding.

A detector is a function from a DataFrame of files to one of findings. One that fails when it is planned gives a row in the error table
instead of findings; what it does on the executors is lazy like any other plan.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"^[a-z][a-z0-9_]*$")
Detect = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Detector:
    name: str
    detect: Detect
    category: str = "analysis"
    languages: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    description: str = ""
    ready: Callable[[], bool] = lambda: True


@dataclass
class Registry:
    """Detectors by name, held by the driver."""

    known: dict[str, Detector] = field(default_factory=dict)

    def register(self, detector: Detector) -> None:
        if not NAME.match(detector.name):
            raise ValueError(f"bad name {detector.name!r}")
        if detector.name in self.known:
            raise ValueError(f"{detector.name} is registered")
        self.known[detector.name] = detector

    def unregister(self, name: str) -> bool:
        return self.known.pop(name, None) is not None

    def get(self, name: str) -> Detector | None:
        return self.known.get(name)

    def names(self) -> list[str]:
        return sorted(self.known)

    def by_category(self, category: str) -> list[Detector]:
        return [self.known[n] for n in self.names() if self.known[n].category == category]

    def search(self, category: str | None = None, language: str | None = None, tags: tuple[str, ...] = (), text: str = "") -> list[Detector]:
        t = text.lower()
        return [d for n in self.names() if (d := self.known[n]) and (category is None or d.category == category) and (language is None or not d.languages or language in d.languages) and set(tags) <= set(d.tags) and (t in d.name.lower() or t in d.description.lower())]

    def load(self, modules: list[str]) -> int:
        """Registers the ``DETECTORS`` of modules named one by one; those known already are replaced (a reload)."""
        n = 0
        for m in modules:
            module = importlib.reload(importlib.import_module(m))
            for d in module.DETECTORS:
                self.known.pop(d.name, None)
                self.register(d)
                n += 1
        return n


def run_one(detector: Detector | None, name: str, files: DataFrame) -> tuple[DataFrame | None, str | None]:
    """(findings tagged with their source, error)."""
    if detector is None:
        return None, "not found"
    try:
        if not detector.ready():
            return None, "not ready"
        return detector.detect(files).withColumns({"source": F.lit("skill"), "skill_name": F.lit(name)}), None
    except Exception as e:  # noqa: BLE001 (a plug-in may fail in any way; the others go on)
        return None, str(e).split("\n")[0][:200]


def run_many(registry: Registry, names: list[str], files: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """The united findings, and a table (skill_name, error) of those that failed."""
    out, errors = None, []
    for n in names:
        got, error = run_one(registry.get(n), n, files)
        if error is not None:
            errors.append((n, error))
        else:
            out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    return out, files.sparkSession.createDataFrame(errors, "skill_name string, error string")


def run_pipeline(registry: Registry, names: list[str], files: DataFrame) -> DataFrame:
    """Each detector reads what the one before gave; one that is missing or fails ends the chain."""
    df = files
    for n in names:
        d = registry.get(n)
        if d is None:
            raise KeyError(n)
        df = df.transform(d.detect)
    return df
