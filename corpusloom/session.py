"""Session, table loading and materialisation helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WRITTEN: list[tuple[SparkSession, str]] = []


def get_session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; anything in ``conf`` wins.

    Executor counts, memory and the shared checkpoint folder belong to the cluster and are not set here.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH = "500"  # rows of an Arrow batch


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of one small size for all plans of the engine, so that long texts do not swell a Python worker.

    The option is read when a plan runs; as it is the same for all, no plan changes another's.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only in local mode, where every task runs on this machine, a temporary folder stands in when it is unset.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, label: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and survives the loss of executors. The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
    w = df.write.mode("error")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a written table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Remove every table that ``materialize`` wrote in this process. Data frames that read them can't be used after."""
    for spark, path in _WRITTEN:
        try:
            drop_table(spark, path)
        except Exception:  # the session is gone; the cluster's own clean-up has the folder
            pass
    _WRITTEN.clear()


atexit.register(release)


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """``df`` with the place of each row in a total order over all of it, from ``start``.

    Rows are parted by ranges of the order and numbered inside each part; only the parts' sizes reach the driver.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ordered")
    sizes = sorted((r[0], r[1]) for r in parts.groupBy("_p").count().collect())  # a row per part
    offsets, total = [F.lit(-1), F.lit(0)], 0
    for p, n in sizes:
        offsets += [F.lit(p), F.lit(total)]
        total += n
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.create_map(*offsets)[F.col("_p")] + (start - 1)
    return parts.withColumn(name, place).drop("_p")


BROADCAST_BYTES = 32_000_000  # a side of a join is broadcast up to this size


def bytes_of(c: str, kind: T.DataType) -> Column:
    """The bytes that a value takes, near enough."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(c)), F.lit(0)) + 8
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(F.col(c)))), F.lit(0)) + 8
    return F.lit(8)


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_bytes: int = BROADCAST_BYTES, salts: int = 32) -> DataFrame:
    """Join ``big`` to a side that is usually small, safe for hot keys.

    ``small`` is materialised and measured. Up to ``max_bytes`` it is broadcast; beyond that both sides are
    shuffled on the key and a salt, with the rows of ``small`` repeated once per salt, so that a hot key is
    spread over ``salts`` tasks. ``how`` is inner, left, left_semi or left_anti; null keys match nothing.
    """
    small = materialize(small, "lookup")
    size = sum((bytes_of(f.name, f.dataType) for f in small.schema), F.lit(16))
    if (small.agg(F.sum(size)).first()[0] or 0) <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if not dict(big.dtypes)[c].startswith("map")]), F.lit(salts)).cast("int")
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(spread, [*on, "_salt"], how).drop("_salt")
