"""What several operators of this subpackage use: the shared folder, checkpoints, word rules."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder that holds the package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: A word: everything but ASCII white space. Java, DuckDB and Python read this pattern alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Runs of letters and of numerals such as fractions, which Python's word class holds as well.
_LETTERS = re.compile(r"[^\W\d_]+")
#: Rows of a side that is sent to every executor at most.
BROADCAST_ROWS = 1_000_000
#: Bytes of rows that go to a Python worker at a time, unless the session names a limit of its own.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What this worker keeps from task to task.
_held: dict[str, Any] = {}


def letter_words(text: str | None) -> list[str]:
    """The runs of letters in lower case; numerals of all kinds stand between words."""
    words = _LETTERS.findall((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    return " ".join(w if w.isalpha() else "".join(c if c.isalpha() else " " for c in w) for w in words).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one is set where a local session names none (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not have.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = have.get() if have.isDefined() else "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
        if not have.isDefined():
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared folder, which outlives a lost executor, and goes on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Has rows sent to Python workers by BATCH_BYTES: 10,000 rows of long texts are too much for a worker, and for the buffers beside Spark's heap."""
    if _BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def held(name: str, make: Callable[[], Any]) -> Any:
    """What a worker keeps under ``name`` from task to task. It keeps one thing at a time, so that those of one job's operators don't add up."""
    if name not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[name] = make()
    return _held[name]


def at_hash(seed: int, *columns: str) -> Column:
    """A number in [0, 1) from the columns' hash."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def sent_small(df: DataFrame) -> DataFrame:
    """Marked for every executor while its size, counted first, allows that; otherwise Spark joins it by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def small_parts(df: DataFrame, column: str, rows: int | None = None) -> list[DataFrame]:
    """``df`` in parts by ``column``, each small enough for every executor and marked so. For joins with rows that are not to move.

    ``rows`` is its size where its rows hold lists; else they are counted.
    """
    parts = max(1, -(-(df.count() if rows is None else rows) // BROADCAST_ROWS))
    return [F.broadcast(df.filter(F.pmod(F.xxhash64(column), F.lit(parts)) == i) if parts > 1 else df) for i in range(parts)]


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (null for a null id)."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder. Python workers on this machine find the package wherever the driver was started."""
    paths = spark.sparkContext.environment
    if ROOT not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [paths.get("PYTHONPATH"), ROOT]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
