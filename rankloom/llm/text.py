"""Word and row-identity helpers shared by the text operators."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Maps ASCII letters to lower case, digits and bytes of other scripts to themselves, the rest to a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
ROWS_PER_BATCH = 1000
_SHIPPED: set[str] = set()


def words_of(raw: bytes | None) -> list[bytes]:
    """Words of UTF-8 text: A-Z lower-cased, runs of digits, a-z and characters outside ASCII."""
    return raw.translate(FOLD).split() if raw else []


def utf8(column: str) -> Column:
    """The text as bytes, so that Python tasks get it without decoding."""
    return F.col(column).cast("binary")


def text_key(column: str = "text") -> Column:
    """128-bit digest of the text. Rows with equal ids and equal keys are the same row to an operator."""
    return F.coalesce(F.md5(utf8(column)), F.lit("null"))


def prepare_python(spark: SparkSession) -> None:
    """Readies the session for operators with Python tasks.

    Ships this package to the executors once (as `--py-files` would; only the driver reads the archive, Spark
    serves it to the executors), and lets an Arrow batch hold fewer rows: with whole long texts, the default of 10,000 rows needs too much memory.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='rankloom-code-')}/rankloom", "zip", package.parent, package.name
        )
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
