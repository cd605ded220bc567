"""Reading and writing the tables: script lines, aliases, datasets and results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.session import cut_lineage

LINE_SCHEMA = T.StructType([
    T.StructField("character_name", T.StringType()),
    T.StructField("line", T.StringType()),
    T.StructField("narration", T.StringType()),
    T.StructField("show", T.StringType()),
    T.StructField("episode", T.StringType()),
    T.StructField("season", T.IntegerType()),
    T.StructField("url", T.StringType()),
    T.StructField("line_no", T.LongType()),
])

RESULT_SCHEMA = T.StructType([
    T.StructField("show", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("entity", T.StringType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("item", T.StringType()),
    T.StructField("score", T.DoubleType()),
])


def check_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame, if it has every column of the schema with its type; otherwise an error."""
    found = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {f.dataType.simpleString()}" for f in schema
             if found.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("missing or mistyped columns: " + ", ".join(wrong))
    return df


def select_lines(lines: DataFrame, cols: Sequence[str] = ("*",), show: str | None = None,
                 seasons: Sequence[int] | None = None) -> DataFrame:
    """Projection and filters; both reach the parquet or JDBC scan."""
    if show is not None:
        lines = lines.where(F.col("show") == show)
    if seasons is not None:
        lines = lines.where(F.col("season").isin([int(s) for s in seasons]))
    return lines.select(*cols)


def scan_lines(spark: SparkSession, path: str, **filters) -> DataFrame:
    return select_lines(check_schema(spark.read.parquet(path), LINE_SCHEMA), **filters)


def scan_lines_jdbc(spark: SparkSession, options: dict[str, str], **filters) -> DataFrame:
    """The same over JDBC; give partitionColumn and its bounds in options to read in parallel."""
    return select_lines(spark.read.format("jdbc").options(**options).load(), **filters)


def sink_clean(text: Column) -> Column:
    return F.translate(text, "’\t", "' ")


def append_tsv(lines: DataFrame, path: str) -> None:
    (lines.withColumn("narration", sink_clean(F.col("narration")))
     .write.mode("append").option("sep", "\t").option("header", "true")
     .option("emptyValue", "").option("quoteAll", "true").option("escape", '"').csv(path))


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = LINE_SCHEMA) -> DataFrame:
    return (spark.read.schema(schema).option("sep", "\t").option("header", "true")
            .option("multiLine", "true").option("escape", '"').option("nullValue", "\0")
            .option("emptyValue", "").csv(path))


def create_table(spark: SparkSession, name: str, schema: T.StructType = LINE_SCHEMA) -> None:
    spark.createDataFrame([], schema).write.mode("errorifexists").saveAsTable(name)


def append_table(lines: DataFrame, name: str) -> None:
    lines.withColumn("narration", sink_clean(F.col("narration"))).write.mode("append").saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def materialize_once(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                     refresh: bool = False) -> DataFrame:
    """Read the dataset if its write was completed, otherwise build and write it first."""
    if refresh or not path_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def first_available(spark: SparkSession, path: str, *builders: Callable[[], DataFrame]) -> DataFrame:
    """The stored dataset, else the first builder that works, whose result is stored."""
    if path_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        return spark.read.parquet(path)
    failed: Exception | None = None
    for build in builders:
        try:
            return materialize_once(spark, path, build)
        except Exception as error:  # the next source is the answer to a failed one
            failed = error
    raise RuntimeError(f"no source for {path}") from failed


RESULT_PARTS = 16


def put_results(results: DataFrame, path: str) -> None:
    """Store results; only the shows and kinds present are replaced.

    A show's kind is spread over RESULT_PARTS tasks by entity.
    """
    part = F.pmod(F.xxhash64("entity"), F.lit(RESULT_PARTS))
    (check_schema(results, RESULT_SCHEMA).repartition("show", "kind", part).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("show", "kind").parquet(path))


def get_results(spark: SparkSession, path: str, show: str, kind: str,
                entity: str | None = None) -> DataFrame:
    found = spark.read.schema(RESULT_SCHEMA).parquet(path).where(
        (F.col("show") == show) & (F.col("kind") == kind))
    return found if entity is None else found.where(F.col("entity") == entity)


def stored_results(spark: SparkSession, path: str) -> DataFrame:
    """All stored results; none where nothing was stored yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], RESULT_SCHEMA)
    return spark.read.schema(RESULT_SCHEMA).parquet(path)


ENTITY = ["show", "kind", "entity"]


def results_or_build(spark: SparkSession, path: str, wanted: DataFrame,
                     build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of the wanted entities (show, kind, entity), built and stored first where they are missing.

    build gets the missing entities and gives their results; what it gives beyond them is left out. They are
    added to their partitions, so what is stored stays as it is. An entity without any result is built anew
    each time.
    """
    keys = wanted.select(*ENTITY).distinct()
    have = stored_results(spark, path).select(*ENTITY).distinct()
    missing = cut_lineage(keys.join(have, ENTITY, "left_anti"))
    if not missing.isEmpty():
        part = F.pmod(F.xxhash64("entity"), F.lit(RESULT_PARTS))
        (check_schema(build(missing), RESULT_SCHEMA).join(missing, ENTITY, "left_semi").select(*RESULT_SCHEMA.names)
         .repartition("show", "kind", part).write.mode("append").partitionBy("show", "kind").parquet(path))
    return stored_results(spark, path).join(keys, ENTITY, "left_semi").select(*RESULT_SCHEMA.names)


def decode_vector(column: Column) -> Column:
    return column.cast("array<double>")


def encode_vector(column: Column, scale: int = 18) -> Column:
    return column.cast(f"array<decimal(38,{scale})>")


def load_aliases(spark: SparkSession, path: str, show: str) -> DataFrame:
    """A JSON object {canonical: [alias, ..]} as (show, canonical, canon_ord, alias)."""
    text = spark.read.text(path, wholetext=True)
    return alias_rows(text.select(F.lit(show).alias("show"), F.col("value").alias("config")))


def alias_rows(configs: DataFrame) -> DataFrame:
    parsed = F.from_json("config", T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    return (configs.select("show", F.posexplode(F.map_entries(parsed)).alias("canon_ord", "entry"))
            .select("show", F.col("entry.key").alias("canonical"), "canon_ord",
                    F.explode_outer("entry.value").alias("alias")))
