"""Binary files in the shared folder, written and read by Spark itself, so any store works and a lost task leaves none.

Spark's text sink writes a string's bytes as they are and then a line separator. A file's image is handed to it as a
string without its last byte, and that byte is the separator, so the file is exactly the image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_files(images: DataFrame, column: str, last: int, path: str) -> None:
    """One file below path for each row; column: its image without the last byte, which is `last` for all of them."""
    options = {"maxRecordsPerFile": 1, "encoding": "ISO-8859-1", "lineSep": bytes([last]).decode("latin-1")}
    images.select(F.col(column).cast("string").alias("value")).write.options(**options).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
