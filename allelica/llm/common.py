"""Helpers that the training-data operators share: word splitting, scratch tables, text frames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the six ASCII controls 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"
#: bytes.translate table: A-Z to a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: bytes.translate table: A-Z to a-z, and every ASCII byte that is no digit or letter to a space.
LOWER_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def lower_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words between white space; none for a null."""
    return text.translate(LOWER).split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters; none for a null."""
    return text.translate(LOWER_ALNUM).split() if text else []


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="allelica-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/allelica-{uuid.uuid4().hex}"


#: Lists of the scratch tables that the surrounding ``scratch`` blocks have written, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths of the scratch tables that are written inside, for ``discard`` when nothing reads them any more."""
    own: list[str] = []
    mark = _OPEN.set((*_OPEN.get(), own))
    try:
        yield own
    finally:
        _OPEN.reset(mark)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are written inside go at the end, but for those written with ``keep``."""
    with scratch() as own:
        try:
            yield
        finally:
            discard(spark, own)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove scratch tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def noted(path: str, keep: bool = False) -> str:
    """``path``, told to the surrounding ``scratch`` block; with ``keep`` to the one around that."""
    if owners := _OPEN.get()[: -1 if keep else None]:
        owners[-1].append(path)
    return path


def written(df: DataFrame, compression: str = "snappy", keep: bool = False) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read again: lineage ends here."""
    path = noted(scratch_dir(df.sparkSession), keep)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Column of a row's own key, which tells rows apart where ids are null or repeated.
ROW = "_row_key"


def read_plainly(df: DataFrame) -> bool:
    """Whether the rows are those of Parquet files, at most filtered and projected, so that file and place name them."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName().startswith("LogicalRelation") and "_metadata" not in df.columns and _has_places(df)


def _has_places(df: DataFrame) -> bool:
    try:
        return df.select("_metadata.file_path", "_metadata.row_index").columns == ["file_path", "row_index"]
    except AnalysisException:
        return False  # files of another format


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own in ``ROW``, which stays the same however often they are read.

    Rows of Parquet files are named by file and place and read from there; others are written with a number.
    """
    if read_plainly(docs):
        return docs.withColumn(ROW, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    name = f"_{name}_"
    while name in df.columns:
        name += "_"
    return name


def own_names(*names: str):
    """For functions of a DataFrame that use columns of these names for themselves: a column of the input that
    has such a name goes through under another one."""

    def wrap(f):
        @wraps(f)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            clash = {n: free_name(docs, n) for n in names if n in docs.columns}
            out = f(docs.withColumnsRenamed(clash), *args, **kwargs)
            return out.withColumnsRenamed({v: k for k, v in clash.items()})

        return run

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
