"""Files of a run: environment files, durable appends, and the reset of generated data."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import MutableMapping

from pyspark.sql import DataFrame, SparkSession

_LINE = re.compile(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=(.*)")


def load_env(spark: SparkSession, path: str, env: MutableMapping[str, str] | None = None) -> dict[str, str]:
    """Settings ``NAME=value`` of a file, which may be missing; comments, blank lines and quotes around a value go. What
    the environment has already stays. Returns what was set."""
    env = os.environ if env is None else env
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(file):
        return {}
    stream = system.open(file)  # Spark's readers pass over names that begin with a dot
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    new = {}
    for line in text.splitlines():
        m = None if line.lstrip().startswith("#") else _LINE.fullmatch(line)
        if m and m[1] not in env and m[1] not in new:
            new[m[1]] = m[2].strip().strip("\"'")
    env.update(new)
    return new


def append_batch(rows: DataFrame, folder: str, batch: int | str | None = None) -> None:
    """Append rows as JSON lines for good: they are written beside the folder's files and moved in when complete. A batch
    of the same name replaces what it wrote before, so a repeated one (``foreachBatch``) adds nothing.

    What is replaced is moved aside first and deleted last; a run that died between is set right by the next call, or by
    ``recover``. Readers that must see a batch at every moment use ``results.ResultStore``."""
    spark = rows.sparkSession
    name = uuid.uuid4().hex if batch is None else str(batch)
    hadoop = spark._jvm.org.apache.hadoop.fs
    temp, target, old = (hadoop.Path(f"{folder}/{x}{name}") for x in ("_new-", "batch=", "_old-"))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    recover(spark, folder)
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(temp.toString())
    if system.exists(target):
        _moved(system, target, old)
    _moved(system, temp, target)
    system.delete(old, True)


def _moved(system, source, target) -> None:
    if not system.rename(source, target):
        raise OSError(f"cannot move {source} to {target}")


def recover(spark: SparkSession, folder: str) -> list[str]:
    """Set right what an append that died has left: a batch moved aside without a new one comes back, others go. Returns
    the names of the batches that came back."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    back = []
    for status in system.listStatus(root) if system.exists(root) else []:
        old = status.getPath()
        if old.getName().startswith("_old-"):
            name = old.getName().removeprefix("_old-")
            target = hadoop.Path(f"{folder}/batch={name}")
            if system.exists(target):
                system.delete(old, True)
            else:
                _moved(system, old, target)
                back.append(name)
    return sorted(back)


def reset(spark: SparkSession, folder: str, keep: tuple[str, ...] = ("clean.jsonl", "seeds"), dry_run: bool = False) -> list[str]:
    """Delete the generated files and folders below ``folder``, but those named in ``keep``, at any depth. Returns what
    was, or with ``dry_run`` would be, deleted."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []

    def walk(path) -> tuple[list[str], bool]:
        """(what goes below the path, whether all of it does)."""
        gone, all_ = [], True
        for status in system.listStatus(path):
            child = status.getPath()
            if child.getName() in keep:
                all_ = False
            elif status.isDirectory():
                below, whole = walk(child)
                gone += [child.toString()] if whole else below
                all_ &= whole
            else:
                gone.append(child.toString())
        return gone, all_

    out = sorted(walk(root)[0])
    if not dry_run:
        for x in out:
            system.delete(hadoop.Path(x), True)
    return out
