"""Made input of the state stress: images of equal lines, declared from a range of numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from postmill.operators.vision import TEXT_HEIGHT

#: Images and lines of the stress, line pitch and height, left and right edge.
IMAGES, LINES = 80, 80
PITCH, HEIGHT, LEFT, RIGHT = 28.0, 24.0, 24.0, 900.0


def stress_results(spark: SparkSession, images: int = IMAGES, lines: int = LINES) -> DataFrame:
    """note_id, image_index, text, lines: one row per image, each line with its text, score and box."""
    def line(n):
        text = F.concat(F.lit("Image "), (F.col("image_index") + 1).cast("string"), F.lit(" line "), (n + 1).cast("string"), F.lit(" GPA 3.82 TOEFL 108 application record"))
        top = n * F.lit(PITCH)
        corners = ((F.lit(LEFT), top), (F.lit(RIGHT), top), (F.lit(RIGHT), top + HEIGHT), (F.lit(LEFT), top + HEIGHT))
        return F.struct(text.alias("text"), F.lit(0.96).alias("score"), F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in corners)).alias("poly"))

    rows = spark.range(images).select(F.lit("stress-note").alias("note_id"), F.col("id").cast("int").alias("image_index"))
    rows = rows.withColumn("lines", F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), line))
    return rows.withColumn("text", F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))


SIDE = 96


@F.pandas_udf(BinaryType())
def block_image(values: pd.Series) -> pd.Series:
    """Black images SIDE wide and as high, with a bright block for each value, one below the other."""
    def drawn(shades: list[int]) -> bytes:
        rgb = np.zeros((SIDE, SIDE, 3), np.uint8)
        for i, shade in enumerate(shades):
            rgb[8 + 40 * i : 28 + 40 * i, 12:84] = shade
        return rgb.tobytes()

    return values.map(lambda x: drawn(list(x)) if x is not None else None)


class BlockSession:
    """A stand-in for models on block_image(): text is where it is bright, and a block reads as the letter of its shade."""

    def detect(self, planes: np.ndarray) -> np.ndarray:
        return (planes[2] > -1.5).astype(np.float32)

    def recognise(self, batch: np.ndarray) -> list[tuple[str, float]]:
        shades = np.floor((batch[:, :, TEXT_HEIGHT // 2, 20].mean(axis=1) + 1) * 127.5 + 0.5).astype(int)
        return [(chr(97 + (s - 100) // 5), 0.9) for s in shades]
