"""Small files in whatever store Spark reads: read, created once, listed and deleted by its own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text as UTF-8; None where there is no such file."""
    store, place = _at(spark, path)
    if not store.exists(place):
        return None
    stream = store.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_head(spark: SparkSession, path: str, length: int) -> bytes:
    """The file's first bytes, fewer if it is shorter."""
    store, place = _at(spark, path)
    if store.getFileStatus(place).isDirectory():
        return b""
    stream = store.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, length)))
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Creates the file; False, and nothing is changed, where it is there already."""
    store, place = _at(spark, path)
    if store.exists(place):
        return False
    try:
        stream = store.create(place, False)
    except Exception:
        if store.exists(place):  # another writer was faster
            return False
        raise
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    return True


def once(spark: SparkSession, path: str, text: str) -> str:
    """The file's text, which is ``text`` if this call is the first to ask."""
    create_text(spark, path, text)
    return read_text(spark, path) or text


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none where there is no such folder."""
    store, place = _at(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    store, place = _at(spark, path)
    store.delete(place, True)
