"""Several tables written as one commit: all of them become valid by one manifest, or none does.

Tables are staged in folders of their own under ``root/data``; a manifest ``root/manifest/<version>.json`` then names the
folder of each table, and those of tables that the commit leaves as they are. The manifest is written beside its place
and renamed there, which fails if that version exists, so of two writers one wins and the other has to begin anew.
Whatever fails before the rename leaves the state that readers see untouched.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has committed the version in the meantime."""


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _list(spark: SparkSession, folder: str) -> list[str]:
    place, fs = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(m[1]) for name in _list(spark, f"{root}/manifest") if (m := re.fullmatch(r"(\d+)\.json", name)))


def state(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict[str, str]]:
    """The latest version, or a given one, and the folder of each of its tables; version 0 has none."""
    found = versions(spark, root)
    at = version if version is not None else (found[-1] if found else 0)
    if not at:
        return 0, {}
    return at, json.loads(spark.read.text(f"{root}/manifest/{at:08d}.json", wholetext=True).first()[0])


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame | None:
    """A table of the latest or of a given version; None if that has no such table."""
    tables = state(spark, root, version)[1]
    return spark.read.parquet(f"{root}/data/{tables[name]}") if name in tables else None


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame | None]) -> int:
    """Write the tables and make them valid together; None takes a table away, tables that aren't named stay. The new version."""
    base, held = state(spark, root)
    new = dict(held)
    for name, df in tables.items():
        if df is None:
            new.pop(name, None)
            continue
        new[name] = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{root}/data/{new[name]}")
    staged, fs = _fs(spark, f"{root}/manifest/.{uuid.uuid4().hex}")
    fs.mkdirs(staged.getParent())
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    final, _ = _fs(spark, f"{root}/manifest/{base + 1:08d}.json")
    if fs.exists(final) or not fs.rename(staged, final):
        fs.delete(staged, False)
        raise Conflict(f"version {base + 1} of {root} exists")
    return base + 1


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete the folders that none of the latest ``keep`` versions names, and older manifests. No writer may be at work."""
    found = versions(spark, root)
    wanted = {folder for v in found[-keep:] for folder in state(spark, root, v)[1].values()}
    gone = [f for f in _list(spark, f"{root}/data") if f not in wanted]
    for path in [f"data/{f}" for f in gone] + [f"manifest/{v:08d}.json" for v in found[:-keep]]:
        place, fs = _fs(spark, f"{root}/{path}")
        fs.delete(place, True)
    return gone
