"""Session settings the operators assume."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import SparkSession

#: Settings that change results.  Everything else is tuning and belongs to the cluster.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

#: Adaptive execution splits skewed shuffle partitions and picks broadcast sides by their
#: measured size, which is why no operator carries a broadcast hint.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Checkpoints are dropped once nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "panelspark", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the semantic settings applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTIC_CONF, **ADAPTIVE_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df):
    """Materialise ``df`` on the shared checkpoint folder and return the short plan.

    The folder is the cluster's ``spark.checkpoint.dir``.  Without one (tests, notebooks) a
    temporary folder is set, which is only right while driver and executors share a disk.
    """
    import tempfile

    context = df.sparkSession.sparkContext
    jvm_context = context._jsc.sc()
    if jvm_context.getCheckpointDir().isEmpty():
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="panelspark-checkpoint-")
        context.setCheckpointDir(configured)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, for files that one run writes and reads back."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        cut_lineage(spark.range(1))
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir().get()
    return f"{folder.rstrip('/')}/{name}-{uuid4().hex}"
