"""Session settings the operators rely on, and the reliable checkpoint folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE splits skewed join partitions; forcing it keeps that true even where the
# split costs one more exchange, which is the cheaper side of a hot key.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a row can be a long text: few of them reach a Python worker at once
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else started."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


#: Compressed bytes of an input for each shuffle partition, and shuffled bytes that adaptive execution puts into one task.
INPUT_BYTES, TASK_BYTES = 4 << 20, 16 << 20


def cut_for(df: DataFrame) -> DataFrame:
    """The table itself, after its session cuts shuffles as finely as its size asks for.

    A fixed number of partitions would let the sorts and hash maps of one task grow with the
    input; adaptive execution merges partitions up to TASK_BYTES again.
    """
    spark, key = df.sparkSession, "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    wanted = -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // INPUT_BYTES)
    if wanted > int(spark.conf.get(key, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(key, str(wanted))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    return df


def local_session(cores: int | str = 8, memory: str = "8g", app: str = "sparkroll") -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_root(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
            folder = tempfile.mkdtemp(prefix="sparkroll-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder of spark.checkpoint.dir, so lost executors cost nothing."""
    _checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, for tables that must outlive an executor."""
    return f"{_checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def reliable_table(df: DataFrame) -> DataFrame:
    """Materialise as Parquet in that folder: for wide or long frames, as it is compressed and read by column. The folder is left to the user to clear."""
    folder = shared_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
