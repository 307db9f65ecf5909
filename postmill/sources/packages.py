"""Model packages: TAR members, the model and settings among them, the character list of settings."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """path, position, member, size, content of every file in TAR archives."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    rows = [(where, i, m.name, m.size, tar.extractfile(m).read()) for i, m in enumerate(tar) if m.isfile()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["path", "position", "member", "size", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, position int, member string, size long, content binary")


def model_packages(spark: SparkSession, path: str) -> DataFrame:
    """path, model, settings and error of every archive: its first model and settings file, an error without either."""
    first = lambda name: F.min_by("content", F.when(F.col("member").endswith(f"/{name}"), F.col("position")))
    rows = tar_members(spark, path).groupBy("path").agg(first("inference.onnx").alias("model"), first("inference.yml").cast("string").alias("settings"))
    return rows.withColumn("error", F.when(F.col("model").isNull() | F.col("settings").isNull(), "MODEL_PACKAGE_INCOMPLETE"))


def yaml_scalar(text: str) -> str:
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if len(text) >= 2 and text[0] == text[-1] == '"':
        import json

        return json.loads(text)
    return text


def character_list(settings: str, least: int = 100) -> list[str]:
    """The `character_dict` list of a settings file, with the space that recognition adds."""
    found = re.search(r"(?m)^(\s*)character_dict:\s*\n((?:\s*-[^\n]*\n?)+)", settings)
    out = [yaml_scalar(line.split("-", 1)[1][1:]) for line in found[2].splitlines()] if found else []
    if len(out) < least:
        raise ValueError("CHARACTER_LIST_INVALID")
    return [*out, " "]
