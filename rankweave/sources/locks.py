"""One writer at a time, and places that may not be read."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..operators.contracts import ContractError

#: Fixed value: parts of a path that mark held-out data.
SEALED = r"(?:labels_|labelled_|export_)?(?:test|calibration|external(?:_[a-z0-9]+)*)"


@contextmanager
def exclusive_writer(spark: SparkSession, place: str) -> Iterator[None]:
    """Hold ``place`` by a lock file beside it, created only if absent; a second writer fails at once.

    The file is made in one step: on the driver's own disk by an exclusive open, in other stores by a create without
    overwrite, which a distributed file system does atomically. A run that dies leaves its lock to be looked at.
    """
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(place.rstrip("/") + ".lock")
    store = path.getFileSystem(context._jsc.hadoopConfiguration())
    store.mkdirs(path.getParent())
    try:
        if store.getScheme() == "file":
            os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        else:
            store.create(path, False).close()
    except Exception as error:
        if store.exists(path):
            raise ContractError(f"another writer holds {place}, or one died there: {path}") from error
        raise
    try:
        yield
    finally:
        store.delete(path, False)


def allowed_path(path: str, sealed: str = SEALED) -> str:
    """The path, unless one of its parts names a held-out place; nothing is read to find out."""
    bare = re.sub(r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "", path)
    if any(re.fullmatch(sealed, part, re.I) for part in bare.split("/") if part):
        raise ContractError(f"held-out place: {path}")
    return path


def reads_allowed(df: DataFrame, sealed: str = SEALED) -> DataFrame:
    """``df``, unless a file of its plan lies in a held-out place; the plan's file index is asked, no byte is read."""
    for path in df.inputFiles():
        allowed_path(path, sealed)
    return df
