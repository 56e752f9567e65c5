"""Helpers shared by the operators: words, materialised tables, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE_SPACE = r"[\x20\x09-\x0D]"  # the only separators of words
BROADCAST_ROWS = 1_000_000  # a side of at most so many narrow rows is broadcast, after counting it

_written: dict[str, SparkSession] = {}


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE + "+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Catalyst may copy a projected expression into each use of it, which inside
    a lambda means once per element; a lambda variable can't be copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(table: DataFrame, added: list[str], *read: str) -> DataFrame:
    """The columns an operator reads, and in ``_row`` all columns but those that it adds: its own names can't clash."""
    rest = [F.col(f"`{c}`") for c in table.columns if c.lower() not in added]
    return table.select(*[F.col(c) for c in read], F.struct(*rest).alias("_row"))


def unpacked(table: DataFrame, *added: Column | str, **replaced: Column) -> DataFrame:
    """The columns of ``_row``, some of them replaced, and those added."""
    names = table.schema["_row"].dataType.names
    return table.select(*[(replaced[c] if c in replaced else F.col("_row")[c]).alias(c) for c in names], *added)


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where unset, one of this machine for a local session, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name the cluster's shared folder there")
        folder = "file://" + tempfile.mkdtemp(prefix="wavepanel-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives later
    joins exact sizes.  ``forget`` drops a table that no result needs;
    the rest go when the driver ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"llm-{name}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(schema).parquet(path)
    out._llm_path = path
    return out


def forget(*tables: DataFrame) -> None:
    for t in tables:
        _delete(t._llm_path)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session may be gone already; nothing is lost but disk
            _written.pop(path, None)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (a shuffled join).

    For narrow rows (ids, names) only: the bound on rows then bounds the bytes.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` by a function of this package, which the workers may not have installed.

    The package's source is sent along once for each Spark application, as
    ``--py-files`` does; workers keep the module, and what it caches, between tasks.
    """
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _sent:
        package = Path(__file__).resolve().parent.parent
        archive = os.path.join(tempfile.mkdtemp(prefix="wavepanel-py-"), "wavepanel_llm_files.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for path in [package / "__init__.py", *sorted(package.glob("llm/*.py"))]:
                z.write(path, path.relative_to(package.parent))
        sc.addPyFile(archive)
        _sent.add(sc.applicationId)
    return df.mapInArrow(function, schema)


_sent: set[str] = set()
