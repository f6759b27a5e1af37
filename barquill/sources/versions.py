"""Tables that appear together: a version names a folder for each table, and readers see whole versions only.

Data go to new folders; then a small file with the version's number is put in place by one rename that fails if another
writer took the number, and that writer's work is looked at before trying again. Nothing that a reader has open changes. On
HDFS the rename is atomic; an object store needs a file system that refuses to overwrite, as for other tables of files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barquill.functions.tables import exists, remove


class Conflict(RuntimeError):
    """Other writers took every number that was tried."""


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, home: str) -> list[int]:
    """Numbers of the versions that can be read, oldest first."""
    where, fs = _hadoop(spark, f"{home}/versions")
    if not fs.exists(where):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit())


def pinned(spark: SparkSession, home: str, version: int | None = None) -> dict[str, str]:
    """The folders of a version's tables by name, of the newest if none is given; none if nothing was published."""
    known = versions(spark, home)
    if not known and version is None:
        return {}
    where, fs = _hadoop(spark, f"{home}/versions/{known[-1] if version is None else version}")
    stream = fs.open(where)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def read(spark: SparkSession, home: str, name: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(pinned(spark, home, version)[name])


def _claim(spark: SparkSession, home: str, number: int, folders: dict[str, str]) -> bool:
    """Put a version's file in place; false if the number is taken."""
    jvm = spark.sparkContext._jvm
    draft, fs = _hadoop(spark, f"{home}/drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(json.dumps(folders, sort_keys=True).encode())
    out.close()
    target, _ = _hadoop(spark, f"{home}/versions/{number}")
    fs.mkdirs(target.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), plain)
        return True
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e) or fs.exists(target):
            return False
        raise


def publish(spark: SparkSession, home: str, make: Callable[[dict[str, str]], dict[str, DataFrame | None]], tries: int = 5) -> int:
    """Make a version of the newest one's folders and what ``make`` gives for them, and return its number.

    ``make`` gets the folders by name and gives the tables that change (None: the table goes); the others are carried over as
    they are. If another writer was first, what was written goes and ``make`` is asked again with that writer's version, so no
    change is lost. If anything fails, readers keep seeing the last version.
    """
    for _ in range(tries):
        known = versions(spark, home)
        number = known[-1] if known else 0
        folders = pinned(spark, home, number) if known else {}
        mine = f"{home}/data/{uuid.uuid4().hex}"
        try:
            after = dict(folders)
            for name, table in make(dict(folders)).items():
                if table is None:
                    after.pop(name, None)
                else:
                    table.write.parquet(f"{mine}/{name}")
                    after[name] = f"{mine}/{name}"
            done = _claim(spark, home, number + 1, after)
        except BaseException:
            remove(spark, mine)
            raise
        if done:
            return number + 1
        remove(spark, mine)
    raise Conflict(f"{home}: another writer was first {tries} times")


def forget_before(spark: SparkSession, home: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` versions and the folders that only they name. Readers of those must be done."""
    known = versions(spark, home)
    old, new = known[: -max(1, keep)], known[-max(1, keep) :]
    held = {folder for v in new for folder in pinned(spark, home, v).values()}
    gone = {folder for v in old for folder in pinned(spark, home, v).values()} - held
    for v in old:
        remove(spark, f"{home}/versions/{v}")
    for folder in sorted(gone):
        if exists(spark, folder):
            remove(spark, folder)
