"""Session set-up, table loading and the shared folder for written state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gatewright", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators rely on (adaptive plans, UTC)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Partitions that `spread` deals rows to; 0, the default, leaves them as the source splits them.
SPREAD = "spark.gatewright.spread.partitions"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys to as many partitions as the setting SPREAD says.

    For work that costs much per byte, such as patterns over texts, on sources of few files: a
    bench or a test on one machine sets it. A source of any size has splits enough and is not shuffled.
    """
    n = int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(n, *keys) if n else df


def spread_rows(df: DataFrame, rows: int) -> DataFrame:
    """Rows dealt evenly to partitions of about `rows` rows each.

    For small rows that stand for much work each, such as the keys of texts that a plan makes: many of them
    fit one split of their source. The number of partitions grows with the table.
    """
    return df.repartition(max(1, -(-df.count() // rows)))


def inline_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small fixed table written into the plan, so that its size is known to Spark.

    Rows hold texts, numbers, None and lists of texts; `schema` is a DDL string.
    """
    from gatewright.functions.text import sql_str

    def literal(value) -> str:
        if value is None:
            return "null"
        if isinstance(value, list):
            return "array(" + ", ".join(literal(v) for v in value) + ")"
        if isinstance(value, bool):
            return str(value).lower()
        return sql_str(value) if isinstance(value, str) else repr(value)

    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"cast(c{i} as {dtype}) as {name}" for i, (name, dtype) in enumerate(fields))
    names = ", ".join(f"c{i}" for i in range(len(fields)))
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`.

    Only a local master may fall back to a folder of its own; a cluster without
    the setting is refused, since a machine-local folder would lose data there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = spark.conf.get("spark.gatewright.local.dir", None)
        if not folder:
            folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
            spark.conf.set("spark.gatewright.local.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_STAGED: list[list[str]] = []


@contextmanager
def staging(spark: SparkSession) -> Iterator[list[str]]:
    """Delete what is staged inside once the block ends, for callers that are then done with their results.

    with staging(spark):
        query(spark, sf_dir).write.parquet(target)
    """
    paths: list[str] = []
    _STAGED.append(paths)
    try:
        yield paths
    finally:
        _STAGED.remove(paths)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder, deleted at the end of a `staging` block around the call."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _STAGED:
        _STAGED[-1].append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint, which outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a table other steps read more than once, and read it back.

    Unlike a cache it outlives executors, and later steps read only their columns.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
