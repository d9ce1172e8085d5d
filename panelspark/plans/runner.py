"""One run of a source: skip if unchanged, build into staging, check, gate, publish, record.

Every table is written once to a staging folder and read back from there, so later tables and all
checks work on columnar files instead of recomputing the chain, and a lost executor costs one
task.  Staged tables replace the published ones only after the gate.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.operators.release import is_unchanged, output_fingerprints, schema_fingerprint
from panelspark.quality.checks import FAIL, QualityFailure
from panelspark.sinks.writers import (_filesystem, append_run, archive_release, path_exists,
                                      replace_on_success, write_json_lines)
from panelspark.sources.readers import latest_successful_run, read_runs


@dataclass
class Layout:
    """Where a source's tables, run records and reports live."""

    root: str

    def table(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/tables/{name}"

    def runs(self) -> str:
        return f"{self.root.rstrip('/')}/runs"

    def report(self, source: str) -> str:
        return f"{self.root.rstrip('/')}/quality/{source}"

    def history(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/history/{name}"


@dataclass
class Stage:
    """Tables of a run that are not published yet."""

    spark: SparkSession
    layout: Layout
    run_id: str
    saved: dict[str, str] = field(default_factory=dict)

    def save(self, name: str, df: DataFrame, sort_by: Sequence[str] = ()) -> DataFrame:
        """Write a table to staging and return it read back."""
        path = f"{self.layout.root.rstrip('/')}/staging/{self.run_id}/{name}"
        ordered = df.sortWithinPartitions(*sort_by) if sort_by else df
        ordered.write.option("compression", "zstd").mode("overwrite").parquet(path)
        self.saved[name] = path
        return self.spark.read.parquet(path)

    def publish(self) -> None:
        for name, path in self.saved.items():
            source, fs = _filesystem(self.spark, path)

            def move(staged, source=source, fs=fs):
                target, _ = _filesystem(self.spark, staged)
                fs.mkdirs(target.getParent())
                if not fs.rename(source, target):
                    raise RuntimeError(f"could not move {source} to {staged}")

            replace_on_success(self.spark, self.layout.table(name), move)


def published(spark: SparkSession, layout: Layout, name: str) -> DataFrame:
    return spark.read.parquet(layout.table(name))


def previous_run(spark: SparkSession, layout: Layout, source: str) -> dict | None:
    if not path_exists(spark, layout.runs()):
        return None
    return latest_successful_run(read_runs(spark, layout.runs()), source)


def run_source(spark: SparkSession, layout: Layout, source: str, release: str, signature: str,
               pipeline: str, build: Callable[[Stage], dict[str, DataFrame]],
               checks: Callable[[dict[str, DataFrame]], DataFrame],
               impact: Callable[[dict[str, DataFrame], dict[str, DataFrame]], DataFrame] | None = None,
               tables: Sequence[str] = (), archive: Sequence[str] = ()) -> dict:
    """Run one source and return its run record (status SUCCESS or NO_CHANGE).

    ``tables`` are the published tables the unchanged test looks at, ``archive`` those kept per
    release before they are replaced.  A failing check leaves the published tables alone.
    """
    started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    run_id = f"{started:%Y%m%dT%H%M%S}-{uuid4().hex[:8]}"
    record = {"run_id": run_id, "source": source, "release": release, "started_at": started,
              "input_signature": signature, "pipeline_fingerprint": pipeline}
    last = previous_run(spark, layout, source)
    existing = {n: published(spark, layout, n) for n in tables if path_exists(spark, layout.table(n))}
    if last and last.get("input_signature") == signature and len(existing) == len(tables):
        if is_unchanged(last, signature, pipeline, output_fingerprints(existing)):
            return _record(spark, layout, record, "NO_CHANGE")

    stage = Stage(spark, layout, run_id)
    built = build(stage)
    results = stage.save(f"checks_{source}", checks(built))
    write_json_lines(results, layout.report(source))
    failed = sorted(r["name"] for r in results.filter(F.col("status") == FAIL).select("name").collect())
    if failed:
        _record(spark, layout, {**record, "detail": {"failed": ",".join(failed)}}, "FAILED")
        raise QualityFailure(f"{source}: quality checks failed: {', '.join(failed)}")

    detail = {}
    if impact is not None and last and existing:
        row = impact(existing, built).first()
        detail = {k: str(v) for k, v in row.asDict().items()}
    if last and last["release"] != release:
        for name in archive:
            if name in existing:
                archive_release(existing[name], layout.history(name), last["release"])
    del stage.saved[f"checks_{source}"]
    record["schema_fingerprint"] = schema_fingerprint(built)
    record["row_counts"] = {name: df.count() for name, df in built.items()}
    record["output_fingerprints"] = output_fingerprints({n: built[n] for n in tables})
    stage.publish()
    return _record(spark, layout, {**record, "detail": detail}, "SUCCESS")


def _record(spark: SparkSession, layout: Layout, record: dict, status: str) -> dict:
    record = {**record, "status": status,
              "finished_at": dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)}
    append_run(spark, layout.runs(), record)
    return record
