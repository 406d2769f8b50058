"""Reading and writing the file formats the jobs exchange."""

from __future__ import annotations

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gradus.operators.ranking import global_index
from gradus.schemas import schema
from gradus.session import cut_lineage


def read_csv(
    spark: SparkSession, path: str, table: str, columns: list[str] | None = None, header: bool = True, line_breaks: bool = True
) -> DataFrame:
    """CSV under a declared schema; types are never inferred.

    Files whose fields may hold line breaks are read by one task each; give ``line_breaks=False`` to split large ones.
    """
    reader = spark.read.schema(schema(table)).option("header", header).option("multiLine", line_breaks)
    df = reader.option("escape", '"').csv(path)
    return df.select(columns) if columns else df


def read_sheet(spark: SparkSession, path: str, names: list[str], skip: int = 0) -> DataFrame:
    """A worksheet landed as CSV without header handling: all strings plus ``ordinal``.

    ``skip`` drops leading rows; ``ordinal`` counts rows of the sheet from 1.
    """
    strings = StructType([StructField(n, StringType()) for n in names])
    df = spark.read.schema(strings).option("header", False).option("multiLine", True).option("escape", '"').csv(path)
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    numbered = df.select("*", place[0].alias("_file"), place[1].alias("_block")).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    # Rows of one file block are read in order by one task.
    indexed = global_index(numbered, [F.col("_file"), F.col("_block"), F.col("_row")], "_index")
    return indexed.select(*names, (F.col("_index") + 1).cast("bigint").alias("ordinal")).where(F.col("ordinal") > skip)


def cell_range(sheet: DataFrame, first: int, last: int | None, columns: list[str]) -> DataFrame:
    """Rows ``first..last`` of a landed sheet, some of its columns."""
    rows = sheet.where(F.col("ordinal") >= first)
    return (rows if last is None else rows.where(F.col("ordinal") <= last)).select(*columns, "ordinal")


def with_links(sheet: DataFrame, url: str = "url") -> DataFrame:
    return sheet.where(F.col(url).isNotNull())


def map_parts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document cut after every closing bracket: ``value`` without it, in tasks of byte ranges like any text file."""
    return spark.read.option("lineSep", "]").text(path)


def read_code_map(spark: SparkSession, path: str, key: str = "employer_name", codes: str = "soc_codes") -> DataFrame:
    """A JSON document ``{name: [codes]}`` as one row per name, read by many tasks however few lines it has.

    Of a repeated name the last entry counts, as in any reader of JSON; a name with null instead of codes has no row.
    A part is what lies up to a closing bracket. Whether that bracket ends a list or stands in a string follows from the
    number of quotes before it: parts count their own, partitions add theirs up, and the sums tell every part its state
    and its entry. Only the parts of one entry come together. Several files are maps of their own, a later file's names
    counting over an earlier one's.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    parts = map_parts(spark, path).select(place.alias("_at"), F.col("value").alias("_part"), F.monotonically_increasing_id().alias("_row"))
    quotes = F.length(F.regexp_replace(F.regexp_replace("_part", r"(?s)\\.", ""), '[^"]+', ""))
    # Written once: the parts keep the partitions and places that they were numbered with.
    told = cut_lineage(parts.withColumn("_odd", (quotes % 2).cast("bigint")))
    # One row per byte range; their order in the file is that of the rows.
    ranges = Window.partitionBy("_at.file").orderBy("_at.block")
    before = told.groupBy("_at").agg(F.sum("_odd").alias("_sum")).withColumn("_before", F.sum("_sum").over(ranges) - F.col("_sum"))
    inside = Window.partitionBy("_at").orderBy("_row")
    stated = told.join(before, "_at").withColumn("_open", (F.col("_before") + F.sum("_odd").over(inside)) % 2 == 1)
    # A part whose end stands in a string goes on in the next; all others end an entry.
    ended = stated.withColumn("_end", F.when(F.col("_open"), 0).otherwise(1).cast("bigint"))
    ends = ended.groupBy("_at").agg(F.sum("_end").alias("_ends")).withColumn("_done", F.sum("_ends").over(ranges) - F.col("_ends"))
    numbered = ended.join(ends, "_at").withColumn("_entry", F.col("_done") + F.sum("_end").over(inside) - F.col("_end"))
    entries = numbered.groupBy("_at.file", "_entry").agg(F.sort_array(F.collect_list(F.struct("_at", "_row", "_part"))).alias("_parts"))
    whole = F.array_join(F.transform("_parts", lambda p: p["_part"]), "]")
    # The last part of a document is its closing brace, perhaps after entries with null.
    inner = F.regexp_replace(F.regexp_replace(whole, r"^\s*[{,]", ""), r"\}\s*$", "")
    text = F.when(inner.rlike(r"\S"), F.concat(F.lit("{"), inner, F.when(whole.rlike(r"\}\s*$"), F.lit("}")).otherwise(F.lit("]}"))))
    named = entries.select("file", "_entry", F.explode(F.from_json(text, "map<string,array<string>>")).alias(key, codes))
    last = named.groupBy(key).agg(F.max_by(codes, F.struct("file", "_entry")).alias(codes))
    return last.where(F.col(codes).isNotNull())


def write_code_map(df: DataFrame, path: str, key: str = "employer_name", codes: str = "soc_codes") -> None:
    """One JSON object per name and line, so that no single row has to hold the whole map."""
    df.select(F.create_map(key, codes).alias("value")).select(F.to_json("value").alias("value")).write.mode("overwrite").text(path)


def read_code_lines(spark: SparkSession, path: str, key: str = "employer_name", codes: str = "soc_codes") -> DataFrame:
    """The line form written by ``write_code_map``."""
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias(key, codes))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines; NULL fields are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(schema(table)).json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, vectors as arrays."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(columns) if columns else df


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def labels_or_default(labels: DataFrame | None, default: dict[int, str]) -> dict[int, str]:
    """Edited topic labels where there are any, else the default ones."""
    if labels is None:
        return dict(default)
    return {r["topic_id"]: r["label"] for r in labels.select("topic_id", "label").collect()}
