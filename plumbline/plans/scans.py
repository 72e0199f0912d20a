"""What an executed plan opened: files and bytes, from the metrics of its scans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row


@dataclass(frozen=True)
class Scanned:
    """Files that a plan opened and their sizes; a file opened by two scans counts twice."""

    files: int = 0
    bytes: int = 0

    def __add__(self, other: "Scanned") -> "Scanned":
        return Scanned(self.files + other.files, self.bytes + other.bytes)


def _leaves(node):
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _leaves(node.executedPlan())
        return
    if name.endswith("QueryStageExec"):
        yield from _leaves(node.plan())
        return
    if name == "ReusedExchangeExec":
        return
    for seq in (node.children(), node.subqueries()):
        for k in range(seq.size()):
            yield from _leaves(seq.apply(k))
    if name == "FileSourceScanExec":
        yield node


def collected(df: DataFrame) -> tuple[list[Row], Scanned]:
    """The rows of a small result, and what its execution opened."""
    rows = df.collect()
    found = Scanned()
    for scan in _leaves(df._jdf.queryExecution().executedPlan()):
        metrics = scan.metrics()
        found += Scanned(*(int(metrics.apply(name).value()) for name in ("numFiles", "filesSize")))
    return rows, found
