"""S1 ``tables`` and S2 ``fill_defaults``: typed reads of the entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import DEFAULTS, TABLE_NAMES, entity_schema


def _default_literal(value: object, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.MapType):
        return F.create_map().cast(dtype)
    return F.lit(value).cast(dtype)


def conform(df: DataFrame, name: str, id_type: T.DataType = T.StringType()) -> DataFrame:
    """Project ``df`` onto the canonical schema of table ``name``.

    Missing optional columns become null, declared defaults fill nulls (S2),
    ``social_handles`` given as JSON text is parsed to a map (X6 rule: null
    and non-objects become {}). Narrow projection only: no shuffle.
    """
    schema = entity_schema(name, id_type)
    defaults = DEFAULTS.get(name, {})
    have = set(df.columns)
    cols = []
    for field in schema.fields:
        if field.name in have:
            c = F.col(field.name)
            if isinstance(field.dataType, T.MapType) and not isinstance(df.schema[field.name].dataType, T.MapType):
                c = F.from_json(c.cast("string"), field.dataType)
            else:
                c = c.cast(field.dataType)
        else:
            c = F.lit(None).cast(field.dataType)
        if field.name in defaults or isinstance(field.dataType, T.MapType):
            c = F.coalesce(c, _default_literal(defaults.get(field.name), field.dataType))
        cols.append(c.alias(field.name))
    return df.select(*cols)


def fill_defaults(df: DataFrame, name: str) -> DataFrame:
    """Replace nulls by the column defaults of table ``name``, keep other columns."""
    out = df
    schema = {f.name: f.dataType for f in df.schema.fields}
    for col, value in DEFAULTS.get(name, {}).items():
        if col in schema:
            out = out.withColumn(col, F.coalesce(F.col(col), F.lit(value).cast(schema[col])))
    if name == "clients" and "social_handles" in schema and isinstance(schema["social_handles"], T.MapType):
        out = out.withColumn("social_handles", F.coalesce("social_handles", F.create_map().cast(schema["social_handles"])))
    return out


def read_tables(spark: SparkSession, root: str, id_type: T.DataType = T.StringType(),
                fmt: str = "parquet") -> dict[str, DataFrame]:
    """Read ``root/<table>`` for the eight tables with explicit schemas.

    Reads use the declared schema (no inference); Parquet gives pushdown of
    filters and column pruning to every operator built on top.
    """
    out = {}
    for name in TABLE_NAMES:
        reader = spark.read.format(fmt).schema(entity_schema(name, id_type))
        out[name] = fill_defaults(reader.load(f"{root}/{name}"), name)
    return out


def uuid_ranges(column: str, n: int = 64) -> list[str]:
    """``n`` predicates (a power of two up to 65536) that together hold for every uuid text
    exactly once, cut at the first four hex digits; the last one takes null as well."""
    if n < 1 or n > 65536 or n & (n - 1):
        raise ValueError(f"{n} is no power of two up to 65536")
    cuts = [f"{i * 65536 // n:04x}0000-0000-0000-0000-000000000000" for i in range(1, n)]
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= '{a}' AND {column} < '{b}'" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < '{cuts[0]}'", *inner, f"{column} >= '{cuts[-1]}' OR {column} IS NULL"]


def read_jdbc(spark: SparkSession, url: str, properties: dict[str, str], id_type: T.DataType = T.StringType(),
              partition_column: str | None = None, bounds: dict[str, tuple[int, int]] | None = None,
              num_partitions: int = 64) -> dict[str, DataFrame]:
    """S1 (optional): read the eight tables from the relational database, each by
    ``num_partitions`` parallel range queries.

    Uuid ids are cut by their first digits (``uuid_ranges``). Number ids need
    ``partition_column`` and per-table ``bounds`` (lower, upper); a table without
    them is read in one query.
    """
    out = {}
    for name in TABLE_NAMES:
        column = "user_id" if name == "memberships" else "id"
        if isinstance(id_type, T.StringType):
            out[name] = conform(spark.read.jdbc(url, name, predicates=uuid_ranges(column, num_partitions), properties=properties),
                                name, id_type)
            continue
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
        for k, v in properties.items():
            reader = reader.option(k, v)
        if partition_column and bounds and name in bounds:
            lo, hi = bounds[name]
            reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lo)
                      .option("upperBound", hi).option("numPartitions", num_partitions))
        out[name] = conform(reader.load(), name, id_type)
    return out
