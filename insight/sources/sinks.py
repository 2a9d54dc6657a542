"""Result sinks (S2-S4) and the long KPI table.

Writers are plain ``DataFrameWriter`` calls: each task writes its own part
file, nothing passes through the driver.  CSV keeps the reference dialect
(header row, null as empty, ``True``/``False``, numbers as pandas prints them,
quotes doubled); parquet is the default for anything large.

``publish`` replaces a table without a moment in which it is gone: rows go to
a new folder, and only when that is complete does a numbered manifest name it.
``read_published`` follows the latest manifest, so a failed or unfinished
write leaves the old table as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the CSV dialect: null and header as pandas writes them, quotes doubled inside quotes.
CSV_OPTIONS = {"header": "true", "nullValue": "", "escape": '"'}
MANIFESTS = "_manifests"


def _number_text(x: Column) -> Column:
    """A double as pandas prints it: plain from 1e-4 to 1e16, else with an exponent of two digits and a sign."""
    plain = F.regexp_replace(x.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    power = x.cast("string")
    for found, put in ((r"\.0E", "E"), (r"E(\d)$", "e+0$1"), (r"E(\d+)$", "e+$1"), (r"E-(\d)$", "e-0$1"), (r"E-", "e-")):
        power = F.regexp_replace(power, found, put)
    size = F.abs(x)
    return F.when(x.isNull() | F.isnan(x), F.lit(None)).when(x == 0, x.cast("string")).when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(
        (size >= 1e-4) & (size < 1e16), plain).otherwise(power)


def in_dialect(df: DataFrame, months: Sequence[str] = ()) -> DataFrame:
    """Columns as the text the reference's CSV files hold; ``months`` are dates of which only ``2023-01`` is kept."""
    def text(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if f.name in months:
            c = F.date_format(c, "yyyy-MM")
        elif isinstance(f.dataType, T.BooleanType):
            c = F.when(c, "True").when(~c, "False")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = _number_text(c.cast("string").cast("double"))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return c.alias(f.name)

    return df.select(*[text(f) for f in df.schema])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] | None = None, months: Sequence[str] = ()) -> None:
    """Write a cleaned table or result table (S2, S3); CSV in the reference's dialect."""
    writer = (in_dialect(df, months) if fmt == "csv" else df).write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_projection(df: DataFrame, cols: Sequence[str], path: str, fmt: str = "parquet",
                     mode: str = "overwrite") -> None:
    """Write a projected table (S4): id, dimensions, score, tier, label."""
    write_table(df.select(*cols), path, fmt=fmt, mode=mode)


def _files(spark: SparkSession):
    """Hadoop's file names, and the file context, which renames onto no existing file."""
    fs = spark._jvm.org.apache.hadoop.fs
    return fs, lambda path: fs.FileContext.getFileContext(fs.Path(path).toUri(), spark._jsparkSession.sessionState().newHadoopConf())


def _manifest_numbers(spark: SparkSession, path: str) -> list[int]:
    fs, context = _files(spark)
    folder = fs.Path(f"{path}/{MANIFESTS}")
    if not context(path).util().exists(folder):
        return []
    names = [s.getPath().getName() for s in context(path).util().listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def publish(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] | None = None, months: Sequence[str] = ()) -> int:
    """Write ``df`` as the new version of the table at ``path`` and return its number (from 1).

    Of writers at the same time each gets a number of its own; the highest is what readers see.  Folders of
    earlier versions stay, for readers that have begun on them.
    """
    path, spark = path.rstrip("/"), df.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    write_table(df, f"{path}/{folder}", fmt=fmt, mode="errorifexists", partition_by=partition_by, months=months)
    fs, context = _files(spark)
    context = context(path)
    draft = fs.Path(f"{path}/{MANIFESTS}/.draft-{uuid.uuid4().hex}")
    spark_fs = draft.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = spark_fs.create(draft, False)  # makes the folder too
    out.write(bytearray(json.dumps({"folder": folder, "format": fmt, "schema": df.schema.jsonValue()}).encode()))
    out.close()
    never_over = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    while True:
        number = max(_manifest_numbers(spark, path), default=0) + 1
        try:
            context.rename(draft, fs.Path(f"{path}/{MANIFESTS}/{number:012d}"), never_over)
            return number
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table at ``path`` as of its latest (or a given) version, with the types it was written with."""
    path = path.rstrip("/")
    numbers = _manifest_numbers(spark, path)
    number = version or max(numbers, default=0)
    if number not in numbers:
        raise FileNotFoundError(f"{path} has no version {number}")
    named = json.loads(spark.read.text(f"{path}/{MANIFESTS}/{number:012d}", wholetext=True).first()[0])
    reader = spark.read.format(named["format"]).schema(T.StructType.fromJson(named["schema"]))
    if named["format"] == "csv":
        reader = reader.options(**CSV_OPTIONS)
    return reader.load(f"{path}/{named['folder']}")


def kpi_table(df: DataFrame, specs: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """One aggregate pass, unpivoted to ``(section, metric, value double)``.

    ``specs`` holds ``(section, metric, aggregate Column)``; all aggregates are
    evaluated in a single ``agg`` (partial + final), then turned into rows with
    ``stack`` so the report is a table instead of driver-side text.
    """
    aggs = [c.cast("double").alias(f"_k{i}") for i, (_, _, c) in enumerate(specs)]
    wide = df.agg(*aggs)
    parts = []
    for i, (section, metric, _) in enumerate(specs):
        parts += [F.lit(section), F.lit(metric), F.col(f"_k{i}")]
    return wide.select(F.inline(F.array(*[
        F.struct(parts[3 * i].alias("section"), parts[3 * i + 1].alias("metric"),
                 parts[3 * i + 2].alias("value"))
        for i in range(len(specs))
    ])))
