"""From files to an inventory: detectors, normalisation, order, checks, with every stage open to extension."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as N
from ..schema import METRICS, SHARED
from ..shared import written
from ..sources import detectors, files, java
from ..sources.leaves import leaves

#: A detector takes files and a context, and gives findings without ordinal.  The context holds rule tables, and the
#: scalars and Java invocations of the files, read once for all detectors.
Detector = Callable[[DataFrame, dict], DataFrame]
Step = Callable[[DataFrame], DataFrame]
Enricher = Callable[[N.Inventory], N.Inventory]


def unshared(frame: DataFrame) -> DataFrame:
    """One row for each of the scans that share a file."""
    return frame.withColumn("scan_id", F.explode_outer(F.split("scan_id", SHARED)))


def resource_detector(tree: DataFrame, context: dict) -> DataFrame:
    return detectors.findings(detectors.resource_entries(tree, context.get("file_rules"), context.get("scalars")))


def java_detector(tree: DataFrame, context: dict) -> DataFrame:
    found, uncertain = java.java_entries(
        tree, context.get("method_rules"), context.get("annotation_rules"), bool(context.get("meta_annotations")), context.get("invocations"), context.get("scalars"), context.get("usage_provider"))
    out = detectors.findings(found)
    return out.unionByName(java.uncertain_findings(uncertain, out))


@dataclass(frozen=True)
class Pack:
    """Detectors and rules that belong together."""

    detectors: dict[str, Detector] = field(default_factory=dict)
    rules: dict = field(default_factory=dict)


@dataclass
class Pipeline:
    """Detectors and steps of a scan; a builder of its own, as every method returns the pipeline.

    Every stage can be replaced: what normalises findings, what makes an inventory of them, what enriches it, and what
    reads the uses of annotated annotations.
    """

    detectors: dict[str, Detector] = field(default_factory=lambda: {"resources": resource_detector, "java": java_detector})
    processors: list[Step] = field(default_factory=list)
    normalizer: Step = N.normalize
    builder: Callable[[DataFrame, DataFrame, dict | None], N.Inventory] = N.assemble
    enrichers: list[Enricher] = field(default_factory=lambda: list(N.ENRICHERS))
    rules: dict = field(default_factory=dict)
    metrics: list[tuple[str, int, int | None]] = field(default_factory=list)

    def detector(self, name: str, f: Detector) -> Pipeline:
        self.detectors[name] = f
        return self

    def pack(self, pack: Pack) -> Pipeline:
        self.detectors |= pack.detectors
        self.rules |= pack.rules
        return self

    def processor(self, f: Step) -> Pipeline:
        self.processors.append(f)
        return self

    def normalized_by(self, f: Step) -> Pipeline:
        self.normalizer = f
        return self

    def built_by(self, f: Callable[[DataFrame, DataFrame, dict | None], N.Inventory]) -> Pipeline:
        self.builder = f
        return self

    def enricher(self, f: Enricher) -> Pipeline:
        """Adds ``f`` ahead of the summary, which counts what enrichers have added."""
        at = self.enrichers.index(N.with_summary) if N.with_summary in self.enrichers else len(self.enrichers)
        self.enrichers.insert(at, f)
        return self

    def usage_provider(self, f: Callable[[DataFrame], DataFrame]) -> Pipeline:
        self.rules["usage_provider"] = f
        return self

    @contextmanager
    def _phase(self, phase: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
        """Times a phase.  What it makes is written by the function given, which counts its rows in the same pass."""
        began, counted = time.monotonic(), []

        def kept(frame: DataFrame, name: str) -> DataFrame:
            seen = Observation()
            out = written(frame.observe(seen, F.count(F.lit(1)).alias("rows")), name)
            counted.append(seen)
            return out

        at = len(self.metrics)
        try:
            yield kept
        finally:
            rows = sum(x.get.get("rows") or 0 for x in counted) if counted else None
            self.metrics.insert(at, (phase, int((time.monotonic() - began) * 1000), rows))

    def parsed(self, tree: DataFrame) -> dict[str, DataFrame]:
        """The scalars and the Java invocations of the files as tables of their own: every file is parsed once."""
        with self._phase("parsing") as kept:
            return {"scalars": kept(unshared(leaves(tree)), "scan-scalars"), "invocations": kept(unshared(java.invocation_rows(tree)), "scan-invocations")}

    def scan(self, tree: DataFrame, hints: dict | None = None, rules: dict | None = None, redacted: bool = False, project: dict | None = None) -> N.Inventory:
        """The inventory of ``tree`` (``schema.FILES``, any number of scans).

        A detector whose plan cannot be made gives a diagnostic and the others go on; a file that does not parse gives
        a diagnostic row of its own."""
        spark, found, failed = tree.sparkSession, [], []
        with self._phase("file-indexing") as kept:
            tree = kept(tree, "scan-files")  # every file is opened once, whatever reads it later
        with self._phase("detector-execution"):
            parsed = self.parsed(tree)
            tree = unshared(tree)
            context = self.rules | (rules or {}) | parsed
            for name, f in self.detectors.items():
                try:
                    with self._phase(f"detector:{name}") as kept:
                        found.append(kept(f(tree, context), f"scan-{name}"))
                except Exception as e:  # the scan goes on, and says so
                    failed.append(("ERROR", "detector-execution", f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", name))
        diagnostics = detectors.parse_diagnostics(parsed["scalars"], parsed["invocations"], tree)
        if failed:
            scans = tree.select("scan_id").distinct()
            diagnostics = diagnostics.unionByName(scans.join(F.broadcast(spark.createDataFrame(failed, "severity string, phase string, message string, component_id string"))))
        with self._phase("finding-processing"):
            if not found:
                found = [detectors.findings(detectors.environment_files(files.empty(spark)))]
            all_ = reduce(DataFrame.unionByName, found)
            for step in self.processors:
                all_ = step(all_)
        with self._phase("normalization") as kept:
            all_ = kept(N.with_ordinal(N.with_hints(self.normalizer(all_), **(hints or {}))).drop("emit_seq"), "scan-findings")
        with self._phase("inventory-building"):
            inv = self.builder(all_, diagnostics, project)
        with self._phase("enrichment"):
            return reduce(lambda i, f: f(i), [*([N.with_redaction] if redacted else []), *self.enrichers], inv)

    def metric_rows(self, spark: SparkSession, scan_id: str) -> DataFrame:
        return spark.createDataFrame([(scan_id, *m) for m in self.metrics], METRICS)
