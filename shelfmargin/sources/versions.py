"""Several outputs that become visible together.

Outputs are written to a new folder under ``versions``. When all of them stand, one small file under
``commits`` names the folder, the outputs and their formats; readers follow the newest of these files.
A run that fails leaves the earlier version as it was. Runs number their commits one after the other;
of two runs that end at once, the second gets an error and its folder is deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shelfmargin.session import removed
from shelfmargin.sources.files import read_table


def _files(spark: SparkSession, folder: str):
    """The Java path of ``folder`` and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _commits(spark: SparkSession, out_dir: str) -> list[int]:
    path, system = _files(spark, f"{out_dir}/commits")
    names = [status.getPath().getName() for status in system.listStatus(path)] if system.exists(path) else []
    return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))


def manifest(spark: SparkSession, out_dir: str, number: int | None = None) -> dict[str, Any]:
    """``number, folder, outputs, metrics`` of a commit, by default the newest."""
    numbers = _commits(spark, out_dir)
    if not numbers or (number is not None and number not in numbers):
        raise ValueError(f"no such version under {out_dir}")
    number = numbers[-1] if number is None else number
    text = spark.read.text(f"{out_dir}/commits/{number:010d}.json", wholetext=True).first()[0]
    return {"number": number, **json.loads(text)}


def committed(
    spark: SparkSession, out_dir: str, outputs: Mapping[str, str], write: Callable[[str], Any]
) -> dict[str, Any]:
    """Let ``write(folder)`` write every one of ``outputs`` (name to format) and commit them together.

    What ``write`` returns is kept as ``metrics``. Returns the manifest.
    """
    numbers = _commits(spark, out_dir)
    number, folder = (numbers[-1] if numbers else 0) + 1, f"{out_dir}/versions/{uuid.uuid4().hex}"
    try:
        metrics = write(folder)
        for name in outputs:
            path, system = _files(spark, f"{folder}/{name}/_SUCCESS")
            if not system.exists(path):
                raise ValueError(f"output {name} is not complete")
        held = {"folder": folder, "outputs": dict(outputs), "metrics": metrics}
        draft, system = _files(spark, f"{folder}/manifest.json")
        stream = system.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(held).encode()))
        finally:
            stream.close()
        target, _ = _files(spark, f"{out_dir}/commits/{number:010d}.json")
        system.mkdirs(target.getParent())
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), system.getConf())
        rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
        context.rename(draft, target, spark.sparkContext._gateway.new_array(rename, 0))  # fails if it exists
    except BaseException:
        removed(spark, folder)
        raise
    return {"number": number, **held}


def read_committed(
    spark: SparkSession, out_dir: str, name: str, schema: T.StructType | str | None = None, number: int | None = None
) -> DataFrame:
    """An output of the newest version, or of commit ``number``."""
    held = manifest(spark, out_dir, number)
    fmt = held["outputs"][name]
    return read_table(spark, f"{held['folder']}/{name}", fmt, {"header": "true"} if fmt == "csv" else None, schema)


def drop_versions(spark: SparkSession, out_dir: str, keep: int = 2) -> int:
    """Delete all but the ``keep`` newest versions, and return how many went.

    No one may read those any more. A commit goes before its folder, so no reader finds it half deleted.
    """
    if keep < 1:
        raise ValueError("keep at least one version")
    old = _commits(spark, out_dir)[:-keep]
    for number in old:
        folder = manifest(spark, out_dir, number)["folder"]
        removed(spark, f"{out_dir}/commits/{number:010d}.json")
        removed(spark, folder)
    return len(old)
