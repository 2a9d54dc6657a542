"""Typed table source.

Tables are read with an explicit ``StructType`` so no schema inference job
runs and a drifting file fails loudly.  Parquet scans keep Catalyst's column
pruning and filter pushdown: callers select and filter after ``load`` and the
optimizer moves both into the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_L, _I, _D, _S, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


def _st(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


TABLE_SCHEMAS: dict[str, T.StructType] = {
    "region": _st(("r_regionkey", _I), ("r_name", _S)),
    "nation": _st(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _st(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I),
                    ("c_acctbal", _D), ("c_mktsegment", _S)),
    "supplier": _st(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "part": _st(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S),
                ("p_size", _I), ("p_retailprice", _D)),
    "orders": _st(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S),
                  ("o_totalprice", _D), ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _st(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L),
                    ("l_linenumber", _I), ("l_quantity", _D), ("l_extendedprice", _D),
                    ("l_discount", _D), ("l_tax", _D), ("l_returnflag", _S),
                    ("l_linestatus", _S), ("l_shipdate", _TS)),
    "events": _st(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S),
                  ("value", _D), ("props", _S)),
    "documents": _st(("doc_id", _L), ("text", _S), ("lang", _S), ("source", _S),
                     ("n_chars", _L)),
    "labels": _st(("doc_id", _L), ("quality", _I), ("toxic", _I)),
}


def load(spark: SparkSession, path: str, schema: T.StructType | None = None,
         fmt: str = "parquet", **options: str) -> DataFrame:
    """Read one table with a declared schema (parquet by default, csv/json/orc too)."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(**{"header": "true", "escape": '"'} | options)
    return reader.load(path)


def cast_or_reject(raw: DataFrame, schema: T.StructType, formats: Mapping[str, str] | None = None,
                   required: Sequence[str] = (), malformed: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of text columns in the types of ``schema``, and the fields that have no such value.

    Returns the good rows, and one row per bad field: ``row`` (the raw row as JSON), ``column``, ``value``, ``reason``
    (``not a <type>``, ``missing`` for a null in ``required``, ``malformed line``).  ``formats`` gives date patterns by
    column; ``malformed`` names a column that holds a line the parser could not split.  A row is in the good rows or
    has rejects, never both; nothing is shuffled, and no bad field fails the job.
    """
    def typed(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        pattern = (formats or {}).get(f.name)
        if pattern is not None:
            return F.try_to_timestamp(c, F.lit(pattern)).cast(f.dataType)
        return c.try_cast(f.dataType)

    def bad(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        failed = c.isNotNull() & typed(f).isNull()
        why = F.when(failed, F.lit(f"not a {f.dataType.simpleString()}"))
        if f.name in required:
            why = why.when(c.isNull(), F.lit("missing"))
        return F.struct(F.lit(f.name).alias("column"), c.cast("string").alias("value"), why.alias("reason"))

    fields = [bad(f) for f in schema]
    if malformed:
        fields.append(F.struct(F.lit(malformed).alias("column"), F.col(f"`{malformed}`").alias("value"),
                               F.when(F.col(f"`{malformed}`").isNotNull(), F.lit("malformed line")).alias("reason")))
    found = F.filter(F.array(*fields), lambda b: b["reason"].isNotNull())
    as_json = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in schema]))
    good = raw.where(F.size(found) == 0).select(*[typed(f).alias(f.name) for f in schema])
    rejects = raw.select(as_json.alias("row"), F.explode(found).alias("b")).select("row", "b.column", "b.value", "b.reason")
    return good, rejects


def load_checked(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", formats: Mapping[str, str] | None = None,
                 required: Sequence[str] = (), **options: str) -> tuple[DataFrame, DataFrame]:
    """Read a table of text fields; ``cast_or_reject`` of its rows."""
    fields = [T.StructField(f.name, T.StringType(), True) for f in schema]
    malformed = None
    if fmt == "csv":
        malformed = "_malformed"
        fields.append(T.StructField(malformed, T.StringType(), True))
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": malformed} | options
    return cast_or_reject(load(spark, path, T.StructType(fields), fmt, **options), schema, formats, required, malformed)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet`` with its declared schema."""
    return load(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", TABLE_SCHEMAS.get(name))
