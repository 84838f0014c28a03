"""Session helpers: sane defaults for tests/bench and the shared checkpoint dir."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on for scale: AQE re-plans joins from runtime
# sizes (broadcast only when measured small), coalesces small shuffle
# partitions and splits skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Cleaning projects dozens of text expressions at once; a generated
    # method above HotSpot's 8000-byte JIT limit would run interpreted, so
    # such stages fall back to per-expression code instead (Spark's own
    # recommendation for HotSpot).  Measured: 20 s -> 11.7 s for the 42-column
    # work-order clean at sf0.1.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def small_methods(spark: SparkSession) -> None:
    """Set ``hugeMethodLimit`` of SCALE_CONF in a session that was started without it.

    It changes no result.  At Spark's default a wide cleaning stage runs in
    HotSpot's interpreter, which takes longer than all the rest of a query.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key, "65535")) > int(SCALE_CONF[key]):
        spark.conf.set(key, SCALE_CONF[key])


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "dealscope") -> SparkSession:
    """A local session for tests and the benchmark (UI off, UTC, AQE on)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is applied to the SparkContext at start-up, so
    an existing context directory is always used as is.  Only when the
    session has none (local tests) is a scratch folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        d = tempfile.mkdtemp(prefix="dealscope-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint dir.

    Used when a cleaned table feeds several operators: a lost executor
    then re-reads the checkpoint instead of recomputing the joins.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_table(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` as parquet into the shared checkpoint
    folder and reading it back.

    Unlike an RDD checkpoint the copy is columnar, so each later scan reads
    only the columns it needs; the plans built on it are small, too.
    """
    import uuid

    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def run_concurrently(*thunks):
    """Run independent eager steps (each submits its own Spark jobs) from
    separate driver threads, so their jobs share the cluster instead of
    queueing behind each other; results in argument order."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=len(thunks)) as pool:
        futures = [pool.submit(t) for t in thunks]
        return [f.result() for f in futures]
