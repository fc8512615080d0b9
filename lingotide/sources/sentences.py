"""Sentence datasets: JSON documents with a header and a list of items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingotide.operators.blocks import number_sorted
from lingotide.session import staged

HEADER = ["schema_version", "dataset_id", "language", "generated_at"]

VOICE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("label", T.MapType(T.StringType(), T.StringType())),
        T.StructField("uri", T.StringType()),
        T.StructField("duration_ms", T.IntegerType()),
    ]
)
ITEM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("romanization", T.StringType()),
        T.StructField("gloss", T.MapType(T.StringType(), T.StringType())),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("difficulty", T.IntegerType()),
        T.StructField("example_audio", T.StructType([T.StructField("voices", T.ArrayType(VOICE))])),
    ]
)
DATASET = T.StructType(
    [T.StructField(c, T.StringType()) for c in HEADER] + [T.StructField("items", T.ArrayType(ITEM))]
)


def read_sentences(spark: SparkSession, paths: str | Sequence[str], keep_empty: bool = False) -> DataFrame:
    """One row per item with the header columns; ``keep_empty`` keeps datasets without items for validation."""
    docs = spark.read.schema(DATASET).option("multiLine", True).option("recursiveFileLookup", True).json(
        list(paths) if not isinstance(paths, str) else paths
    )
    explode = F.explode_outer if keep_empty else F.explode
    rows = docs.select(*HEADER, explode("items").alias("i"))
    fields = [F.col(f"i.{f.name}").alias(f.name) for f in ITEM.fields if f.name != "example_audio"]
    return rows.select(*HEADER, *fields, F.col("i.example_audio.voices").alias("voices"))


def iso_timestamp(ts: Column) -> Column:
    """ISO text of a UTC timestamp, with Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def documents(items: DataFrame, max_items: int = 1000) -> DataFrame:
    """Header + items rows: datasets cut into documents of at most ``max_items`` items in id order."""
    struct = []
    for field in ITEM.fields:
        if field.name == "example_audio":
            voices = F.col("voices") if "voices" in items.columns else F.lit(None)
            struct.append(F.struct(voices.cast(T.ArrayType(VOICE)).alias("voices")).alias("example_audio"))
        else:
            column = F.col(field.name) if field.name in items.columns else F.lit(None)
            struct.append(column.cast(field.dataType).alias(field.name))
    # header fields may be missing, so datasets are told apart by the header as text
    keyed = items.withColumn("_header", F.to_json(F.struct(*HEADER)))
    # numbered along the whole table, so a dataset of any size and any kind of ids is many shares
    placed = staged(number_sorted(keyed, ["_header", "id"], "_at"), "numbered-items")
    firsts = placed.groupBy("_header").agg(F.min("_at").alias("_first"))
    numbered = placed.join(firsts, "_header").withColumn("_no", F.col("_at") - F.col("_first")).drop("_at", "_first")
    return (
        numbered.groupBy("_header", F.floor(F.col("_no") / max_items).alias("_doc"))
        .agg(*[F.first(c).alias(c) for c in HEADER], _in_order(struct))
        .select(*HEADER, "items")
    )


def _in_order(struct: list[Column]) -> Column:
    """Items by number; their map fields cannot be compared, so only the numbers are."""
    pairs = F.collect_list(F.struct(F.col("_no").alias("n"), F.struct(*struct).alias("item")))
    ordered = F.array_sort(pairs, lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0))
    return F.transform(ordered, lambda p: p["item"]).alias("items")


def write_sentences(items: DataFrame, path: str, max_items: int = 1000, by_language: bool = False) -> None:
    """Write datasets as JSON documents, one per file; with ``by_language`` below ``lang=<code>`` folders."""
    docs = documents(items, max_items)
    if by_language:
        docs = docs.withColumn("lang", F.split("language", "-")[0])
    writer = docs.write.mode("overwrite").option("maxRecordsPerFile", 1)
    if by_language:
        writer = writer.partitionBy("lang")
    writer.json(path)
