"""Folders that appear whole or not at all.

Rows are written to a stage beside the destination, then a manifest of the stage's files, and the stage is renamed to the destination by a
rename that never replaces. A reader sees nothing before the rename, a crash leaves only a stage that nobody reads, and of two writers
one renames first and the other finds its destination taken. A folder counts as finished if it has a manifest and all files of it with
their lengths; whatever else stands at a destination is broken: it was written by something else, or lost files.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_manifest.json"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _files(fs, at) -> dict[str, int]:
    """Lengths of all data files below a folder, by their path in it."""
    found, root = {}, fs.makeQualified(at).toString().rstrip("/") + "/"
    each = fs.listFiles(at, True)
    while each.hasNext():
        f = each.next()
        name = f.getPath().toString().removeprefix(root)
        if not name.rpartition("/")[2].startswith(("_", ".")):
            found[name] = f.getLen()
    return found


def state(spark: SparkSession, path: str) -> str:
    """absent, finished or broken."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return "absent"
    manifest = spark._jvm.org.apache.hadoop.fs.Path(at, MANIFEST)
    if not fs.exists(manifest):
        return "broken"
    stream = fs.open(manifest)
    try:
        said = json.loads(bytes(stream.readAllBytes()).decode())
    except ValueError:
        return "broken"
    finally:
        stream.close()
    return "finished" if said.get("files") == _files(fs, at) else "broken"


def _rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder to a name that nothing has; False if something has it."""
    fs, src = _fs(spark, source)
    _, dst = _fs(spark, target)
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(src), fs.makeQualified(dst), none)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(dst):
            return False
        raise
    return True


def stage(rows: DataFrame, path: str, partition: list[str] | None = None) -> str:
    """Write rows and their manifest beside path; the stage's name."""
    spark = rows.sparkSession
    at = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*partition) if partition else writer).parquet(at)
    fs, folder = _fs(spark, at)
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(folder, MANIFEST), False)
    out.write(bytearray(json.dumps({"files": _files(fs, folder)}, sort_keys=True).encode()))
    out.close()
    return at


def publish(rows: DataFrame, path: str, partition: list[str] | None = None, repair: bool = False) -> str:
    """written; refused if a finished folder stands at path, or one that was published meanwhile; broken if something else stands there. With
    repair, that is moved aside first, and kept."""
    spark = rows.sparkSession
    there = state(spark, path)
    if there == "finished" or (there == "broken" and not repair):
        return "refused" if there == "finished" else "broken"
    at = stage(rows, path, partition)
    if there == "broken":
        _rename_new(spark, path, f"{path.rstrip('/')}.broken-{uuid.uuid4().hex}")
    if _rename_new(spark, at, path):
        return "written"
    fs, folder = _fs(spark, at)
    fs.delete(folder, True)
    return "refused"


def stages(spark: SparkSession, path: str) -> list[str]:
    """What crashes have left beside path."""
    fs, _ = _fs(spark, path)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.stage-*"))
    return sorted(f.getPath().toString() for f in found or ())
