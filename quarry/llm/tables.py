"""Reading the given tables and writing intermediate ones."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word: a run of anything but the space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written since the innermost operator began, for each operator that is running.
_WRITTEN: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the cluster; it goes when the running operator ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Every later use reads the written rows, so a lost executor costs the
    re-reading of files and never a new run of what led to them.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def written(name: str):
    """For functions of a DataFrame: their result is written, and what they wrote on the way is deleted."""
    def deco(fn):
        @functools.wraps(fn)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            _WRITTEN.append([])
            try:
                out = fn(docs, *args, **options)
                on_the_way = _WRITTEN[-1]
                # the result belongs to the operator around this one, if any
                held, _WRITTEN[:] = _WRITTEN[:], _WRITTEN[:-1]
                out = materialise(out, name)
                _WRITTEN[:] = held
                _delete(docs.sparkSession, on_the_way)
                return out
            finally:
                _WRITTEN.pop()
        return run
    return deco


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(id_column: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo ``folds``; a null id is not held out."""
    part = F.crc32(F.col(id_column).cast("string").cast("binary")) % F.lit(folds)
    return F.coalesce(part == fold, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """``text`` with A to Z lower-cased and every other character as it is.

    ``lower`` is the same function, and much faster, on a text without
    other upper-case or title-case characters.
    """
    other = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(other, F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))
