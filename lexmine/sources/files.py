"""Reading and writing the engine's files: cards as CSV, targets as JSON, text caches, uploads."""

from __future__ import annotations

import os
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_cards_csv(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame:
    """SRC2, SET7. Card files with a header; a byte-order mark before it is ignored, missing required columns are an error."""
    df = spark.read.csv(paths, header=True, multiLine=True, escape='"', quote='"')
    df = df.toDF(*[c.lstrip("\ufeff").strip('"') for c in df.columns])
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def write_cards_csv(cards: DataFrame, path: str) -> None:
    """SRC3. Cards with a header, every value quoted."""
    cards.write.csv(path, header=True, quoteAll=True, escape='"')


def write_targets_json(rows: DataFrame, path: str, group: str, columns: list[str]) -> None:
    """SRC4. One object {"targets": [..]} for each group."""
    rows.groupBy(group).agg(F.collect_list(F.struct(*columns)).alias("targets")).select("targets").write.json(path)


def read_targets_json(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """SRC4. Rows of the objects' targets."""
    return spark.read.schema(f"targets array<struct<{fields.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>").json(path).select(F.explode("targets").alias("t")).select("t.*")


def through_text_cache(docs: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """SRC5. Documents with text from the cache where its row is valid and of this version, else computed; origin says which."""
    good = cache.where((F.col("version") == version) & F.col("text").isNotNull()).select("doc_id", "text")
    return good.withColumn("origin", F.lit("cached")).unionByName(docs.join(good.select("doc_id"), "doc_id", "left_anti").select("doc_id", "text").withColumn("origin", F.lit("recomputed")))


def _uri(path: str) -> str:
    """A path as Spark shows it, for pyarrow."""
    return quote(path if not path.startswith("file:/") or path.startswith("file:///") else "file://" + path[5:], safe="/:@")


def _heads(files: DataFrame, size: int) -> DataFrame:
    """files (path, length) with content: their first bytes alone, however long a file is."""
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])

    def read(batches):
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(_uri(path))
                with system.open_input_file(place) as file:
                    found.append(file.read(size))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(found, pa.binary())], schema=schema)

    return files.mapInArrow(read, "path string, length long, content binary")


def classify_uploads(spark: SparkSession, path: str, magic: dict[str, bytes], most_mb: int) -> DataFrame:
    """SRC6. Files with kind (by their first bytes), size and accepted.

    Spark lists the files; a task reads the first bytes of each. Spark reads files whole only in stores that pyarrow doesn't know.
    """
    df = spark.read.format("binaryFile").load(path)
    longest = max(map(len, magic.values()), default=0)
    try:
        fs.FileSystem.from_uri(_uri(path if ":/" in path else f"file:{os.path.abspath(path)}"))
        df = _heads(df.select("path", "length"), longest)
    except pa.ArrowInvalid:  # no such scheme
        pass
    kind = F.lit(None).cast("string")
    for name, head in magic.items():
        kind = F.when(F.substr("content", F.lit(1), F.lit(len(head))) == F.lit(head), name).otherwise(kind)
    named = df.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", kind.alias("kind"))
    return named.withColumn("accepted", F.col("kind").isNotNull() & (F.col("length") <= most_mb * 1_000_000))


def evolve(parts: list[DataFrame], defaults: dict) -> DataFrame:
    """SRC10. Tables of several ages as one; columns that older ones lack get defaults."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
