"""Well-log files: one CSV per series, the series id is the start of the file name."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import number_rows

KNOWN = ["MD", "X", "Y", "Z", "GR", "TVT_input"]
TRUTH = ["TVT", "ANCC", "ASTNU", "ASTNL", "EGFDU", "EGFDL", "BUDA"]


def _double_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def file_key(sep: str = "__"):
    """Series id: the file name up to the first separator."""
    return F.split(F.col("_metadata.file_name"), sep)[0]


def folder_key(name: str = "well"):
    """Series id: the value in the `name=value` folder of a file's path."""
    return F.regexp_extract(F.col("_metadata.file_path"), f"/{name}=([^/]*)/", 1)


def _folder(well: object) -> str:
    """The folder that `partitionBy("well")` gives an id."""
    name = "" if well is None else str(well)
    return "well=" + ("".join(f"%{ord(c):02X}" if c < " " or c in '"#%\'*/:=?\\{[]^\x7f' else c for c in name) or "__HIVE_DEFAULT_PARTITION__")


def _mounted(spark: SparkSession, path: str) -> str | None:
    """`path` for the tasks' own open(), where Hadoop takes it for a local or mounted folder; else None."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return p.toUri().getPath() if fs.getUri().getScheme() == "file" else None


def write_wells(wells: DataFrame, path: str, rows: int = 500_000) -> None:
    """One folder `well=<id>` of CSV files with a header per series; a series of more than `rows` rows is written by several tasks.

    In a local or mounted folder, where Hadoop starts processes (chmod) for every file, tasks write the lines that
    Spark made with open(); a file gets its name when it is whole, so a repeated task replaces it."""
    names = [c for c in KNOWN + TRUTH if c.lower() in wells.columns]
    t = wells.select("well", F.floor(F.col("seq") / rows).alias("piece"), *[F.col(c.lower()).alias(c) for c in names]).repartition("well", "piece")
    root = _mounted(wells.sparkSession, path)
    if root is None:
        t.drop("piece").write.partitionBy("well").option("header", True).csv(path)
        return
    os.makedirs(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, files = None, None, 0
        for batch in batches:
            for well, piece, line in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or (well, piece) != own:
                    if out is not None:
                        out.close()
                        os.replace(*now_and_then)
                    own, files = (well, piece), files + 1
                    folder = f"{root}/{_folder(well)}"
                    os.makedirs(folder, exist_ok=True)
                    now_and_then = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/part-{piece}{'-null' * (well is None)}.csv"
                    out = open(now_and_then[0], "w", encoding="utf-8")
                    out.write(",".join(names) + "\n")
                out.write(line + "\n")
        if out is not None:
            out.close()
            os.replace(*now_and_then)
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    lines = t.select("well", "piece", F.to_csv(F.struct(*names)).alias("line")).sortWithinPartitions("well", "piece")
    lines.mapInArrow(write, "files long").agg(F.sum("files")).collect()


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _listed(spark: SparkSession, load: Callable[[], DataFrame]) -> DataFrame:
    """`load` with its files listed by a few tasks a core; by itself Spark starts a task for each folder, up to 10,000."""
    before = spark.conf.get(LISTING, None)
    tasks = 4 * spark.sparkContext.defaultParallelism
    spark.conf.set(LISTING, str(min(tasks, int(before)) if before else tasks))
    try:
        return load()
    finally:
        if before is None:
            spark.conf.unset(LISTING)
        else:
            spark.conf.set(LISTING, before)


def read_wells(spark: SparkSession, path: str, truth: bool = True, columns: list[str] | None = None,
               order: str | None = "MD", files: str = "*__horizontal_well.csv", key: Column | None = None,
               nested: bool = False) -> DataFrame:
    """Horizontal wells as one DataFrame with lower-case columns, `well` and 0-based `seq` (by depth).

    `files` is the glob of the collection; the id comes from the file's name, or from `key`, an expression on `_metadata`.
    `nested`: files whose names match `files` in all folders below `path`, which tasks list, and not the driver.

    Columns are matched by header name, so files with and without the truth columns both read; NaN
    becomes null.  Only the requested columns are parsed.  `order=None` skips the numbering."""
    names = KNOWN + (TRUTH if truth else [])
    keep = [c for c in names if columns is None or c in columns or c == order]
    read = spark.read.option("header", True).option("enforceSchema", False).option("nanValue", "NaN").schema(_double_schema(names))
    if nested:
        read = read.option("recursiveFileLookup", True).option("pathGlobFilter", files)
    df = (_listed(spark, lambda: read.csv(path if nested else f"{path}/{files}"))
          .select((file_key() if key is None else key).alias("well"), *[F.nanvl(c, F.lit(None).cast("double")).alias(c.lower()) for c in keep]))
    if order is None:
        return df
    return number_rows(df.withColumn("__tie", F.xxhash64(*df.columns)), ["well"], order.lower(), "__tie").drop("__tie", "order0")


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """Reference curves (well, tvt, gr, geology) without rows that miss tvt or gr."""
    schema = T.StructType(_double_schema(["TVT", "GR"]).fields + [T.StructField("Geology", T.StringType())])
    df = spark.read.option("header", True).schema(schema).csv(f"{path}/*__typewell.csv")
    df = df.select(file_key().alias("well"), F.nanvl("TVT", F.lit(None).cast("double")).alias("tvt"),
                   F.nanvl("GR", F.lit(None).cast("double")).alias("gr"), F.col("Geology").alias("geology"))
    return df.dropna(subset=["tvt", "gr"])


def with_sidecar(wells: DataFrame, curves: DataFrame) -> DataFrame:
    """All wells with the number of curve knots they have; none is 0, never a lost well."""
    k = curves.groupBy("well").agg(F.count(F.lit(1)).alias("knots"))
    return wells.join(k, "well", "left").fillna({"knots": 0})


def read_params(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One parameter file as a one-row DataFrame."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def write_submission(template: DataFrame, predictions: DataFrame, path: str) -> None:
    fill_template(template, predictions).write.mode("overwrite").option("header", True).csv(path)


def fill_template(template: DataFrame, predictions: DataFrame) -> DataFrame:
    """Template ids with their prediction; a missing one takes the median of all predictions."""
    from ..operators.quantiles import group_quantiles
    med = group_quantiles(predictions, [], F.col("tvt"), {"__m": 0.5}).withColumn("__one", F.lit(1))
    t = template.select("id").join(predictions.select("id", "tvt"), "id", "left").withColumn("__one", F.lit(1))
    return t.join(med, "__one", "left").select("id", F.coalesce("tvt", "__m").alias("tvt"))


def read_scores(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Name and number pulled out of text log lines by a pattern with two groups."""
    t = spark.read.text(path)
    name, num = F.regexp_extract("value", pattern, 1), F.regexp_extract("value", pattern, 2)
    return t.where(F.col("value").rlike(pattern)).select(name.alias("name"), num.cast("double").alias("score"))
