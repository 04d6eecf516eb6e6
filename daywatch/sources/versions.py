"""Tables that are replaced as a whole: versions in folders of their own, and manifests that name them.

A version's data is written first, below ``data``. Then a manifest with the next number is
renamed into place, which is one step of the file system and fails if that number is taken. A
reader takes the manifest with the greatest number and keeps to the folder it names: it sees the
old version or the new one, whole, and a write that fails or is interrupted changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MANIFESTS, DATA = "_manifests", "data"


class Conflict(RuntimeError):
    """Another writer has published a version since this one's base was read."""


@dataclass(frozen=True)
class Version:
    number: int
    path: str
    about: dict


def _paths(spark: SparkSession, root: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{root.rstrip('/')}/{MANIFESTS}")
    return hadoop.Path, folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[Version]:
    """All published versions, oldest first."""
    _, folder, fs = _paths(spark, root)
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".json") and not name.startswith("."):
            about = json.loads(_read(spark, fs, status.getPath()))
            found.append(Version(int(name[:-5]), about.pop("path"), about))
    return sorted(found, key=lambda v: v.number)


def current(spark: SparkSession, root: str) -> Version:
    found = versions(spark, root)
    if not found:
        raise FileNotFoundError(f"{root} has no version")
    return found[-1]


def read(spark: SparkSession, root: str, version: Version | None = None, part: str = "") -> DataFrame:
    """The current or a given version (a folder of it); the rows stay those of that version."""
    pinned = version or current(spark, root)
    return spark.read.parquet(f"{pinned.path}/{part}".rstrip("/"))


def publish(
    spark: SparkSession,
    root: str,
    write: Callable[[str], object],
    base: Version | None = None,
    about: dict | None = None,
    keep: int | None = 3,
) -> Version:
    """Let ``write`` fill a new folder and make it the current version.

    With ``base`` the version must follow that one, else ``Conflict`` is raised; without, it
    follows whatever is current. ``about`` is kept in the manifest. Older versions than the last ``keep`` are
    removed, so a reader that pins one for longer asks for more.
    """
    path = f"{root.rstrip('/')}/{DATA}/{uuid.uuid4().hex}"
    write(path)
    while True:
        found = versions(spark, root)
        last = found[-1].number if found else 0
        if base is not None and base.number != last:
            raise Conflict(f"{root} is at version {last}, not {base.number}")
        done = Version(last + 1, path, about or {})
        if _claim(spark, root, done):
            break
    if keep is not None:
        _prune(spark, root, keep)
    return done


def replace(df: DataFrame, root: str, **how) -> Version:
    """Publish the rows as the table's new version."""
    return publish(df.sparkSession, root, lambda path: df.write.parquet(path), **how)


def _claim(spark: SparkSession, root: str, version: Version) -> bool:
    """Rename a manifest into place; false if its number is taken."""
    path_of, folder, fs = _paths(spark, root)
    fs.mkdirs(folder)
    held = path_of(folder, f".{uuid.uuid4().hex}")
    out = fs.create(held, True)
    out.write(bytearray(json.dumps({"path": version.path, **version.about}).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(held.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    from py4j.protocol import Py4JJavaError

    try:
        context.rename(held, path_of(folder, f"{version.number:010d}.json"), options)
    except Py4JJavaError as error:
        fs.delete(held, False)
        if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
            return False
        raise
    return True


def _prune(spark: SparkSession, root: str, keep: int) -> None:
    path_of, folder, fs = _paths(spark, root)
    for old in versions(spark, root)[: -max(keep, 1)]:
        fs.delete(path_of(folder, f"{old.number:010d}.json"), False)
        fs.delete(path_of(old.path), True)


def _read(spark: SparkSession, fs, path) -> str:
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
