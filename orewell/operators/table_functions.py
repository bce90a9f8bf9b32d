"""Detectors that SQL can call: a caller's function over a file becomes a table function, and detectors of a registry become views."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .detect import COLUMNS

#: What a call ``SELECT f.scan_id, f.path, d.* FROM files f, LATERAL name(f.path, f.content) d`` gives for each finding of a file.
FOUND = "rule_id string, severity string, confidence double, root_cause string, effort_minutes int, line int, n long"


def register_detector(spark: SparkSession, name: str, find: Callable[[str, str], Iterable[tuple]]) -> str:
    """``find(path, content)`` as the table function ``name``: it yields (rule_id, severity, confidence, root_cause, effort_minutes, line, n) for each finding of one file.

    Files are taken where they lie, without a shuffle. A file without a path or a content has no findings; an error in ``find`` is the query's error.
    """

    class Detector:
        def eval(self, path: str, content: str) -> Iterator[tuple]:
            if path is not None and content is not None:
                yield from find(path, content)

    ship(spark)
    spark.udtf.register(name, F.udtf(Detector, returnType=FOUND))
    return name


def long_lines(least: int) -> Callable[[str, str], Iterator[tuple]]:
    """A small detector: lines of ``least`` or more letters, which weigh less in prose."""

    def find(path: str, content: str) -> Iterator[tuple]:
        for no, line in enumerate(content.split("\n"), 1):
            if len(line) >= least:
                yield "user.long-line", "low" if path.endswith(".md") else "medium", 0.9, "complexity-debt", 5, no, len(line)

    return find


def found_by(name: str, files: str) -> str:
    """SQL text: the findings of the table function ``name`` over the view ``files`` (scan_id, path, content), with the columns of every detector."""
    of_file = ("scan_id", "path")
    return f"SELECT {', '.join(('f.' if c in of_file else 'd.') + c for c in COLUMNS)} FROM {files} f, LATERAL {name}(f.path, f.content) d"


def detector_views(detectors: dict[str, Callable[[object], DataFrame]], tables: object, prefix: str = "found_") -> list[str]:
    """Each detector of a registry as a view for SQL, named after it; their names."""
    names = []
    for name, f in detectors.items():
        names.append(prefix + name.replace("-", "_"))
        f(tables).select(*COLUMNS).createOrReplaceTempView(names[-1])
    return names
