"""Session helpers: a tuned SparkSession and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every keymerge job relies on.  AQE re-plans joins at runtime
# (broadcast only when the *measured* side is under the threshold), coalesces
# small shuffle partitions and splits skewed ones.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # coalesce shuffle partitions to the advisory size (64 MB), not to max parallelism
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # iterative jobs (components rounds) checkpoint every round: drop files of dead rounds
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "keymerge") -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in TUNING.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint`` usable and return the shared checkpoint folder.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is what
    we use.  Only when nothing is configured (unit tests on a laptop) do we
    create a scratch folder of our own.  With Spark Connect there is no
    SparkContext: the server's ``spark.checkpoint.dir`` applies as is.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect session
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder") from None
        return d
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="keymerge-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local on a cluster)."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/keymerge-{name}-{uuid.uuid4().hex[:12]}"




def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for tasks that run Python."""
    import shutil
    import tempfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="keymerge-code-")  # the driver's own; Spark serves the file
        sc.addPyFile(shutil.make_archive(f"{folder}/{root.name}_package", "zip", root.parent, root.name))
        _shipped.add(sc.applicationId)


_shipped: set[str] = set()


def materialize(df, name: str = ""):
    """Cut lineage: reliable ``checkpoint()`` into the cluster's shared checkpoint folder.

    A lost executor costs nothing afterwards - the checkpoint files are shared.
    (Measured locally: faster than a parquet round trip or cache + checkpoint.)
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df, name: str = "step"):
    """Cut lineage by a Parquet table in the shared folder.  For loops: the plan then starts from files,
    while a checkpoint keeps the estimated size of the plan before it, which joins multiply round by round."""
    path = shared_scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exchanged(df):
    """A side of a join that is dealt out by key however small Spark takes it to be.  For loops: a written table of
    packed ids looks small, and each broadcast of one passes through the driver, once per join and round."""
    return df.hint("merge")
