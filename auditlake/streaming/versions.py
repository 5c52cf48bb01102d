"""Folders on the shared file system: markers, published versions, leases, vacuum.

A version ``v=<n>`` of something stored exists once its marker ``_done`` does; the marker is made
(atomically) after everything else was written, so a reader sees a version whole or not at all.
Readers pin a version by its number and may lease it; ``vacuum`` removes what neither the newest
versions nor a lease refer to, so a reader that began before a new version can still finish.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

from auditlake.sources.sinks import _fs, _rename

GRACE = 2            # committed versions that vacuum keeps
LEASE_HOURS = 24.0   # a lease older than this belongs to a reader that died


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def mkdirs(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if not fs.mkdirs(p):
        raise OSError(f"folder not made: {path}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, s = _fs(spark, source)
    _rename(fs, s, _fs(spark, target)[1])


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under ``path``, sorted; empty if it doesn't exist."""
    fs, p = _fs(spark, path)
    return sorted(st.getPath().getName() for st in fs.listStatus(p)) if fs.exists(p) else []


def markers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Integer values of the ``<prefix>=<n>`` entries directly under ``path``."""
    out = []
    for name in names(spark, path):
        if name.startswith(prefix + "="):
            try:
                out.append(int(name.split("=", 1)[1]))
            except ValueError:
                pass
    return out


@dataclass(frozen=True)
class Versions:
    spark: SparkSession
    path: str

    def folder(self, version: int) -> str:
        return f"{self.path}/v={version}"

    def committed(self) -> list[int]:
        return sorted(v for v in markers(self.spark, self.path, "v") if exists(self.spark, self.folder(v) + "/_done"))

    def newest(self) -> int | None:
        """The newest committed version; only those begun after it are looked at besides."""
        for v in sorted(markers(self.spark, self.path, "v"), reverse=True):
            if exists(self.spark, self.folder(v) + "/_done"):
                return v
        return None

    def next(self) -> int:
        """A number above all versions, also those that were begun and never committed."""
        return max(markers(self.spark, self.path, "v"), default=0) + 1

    def commit(self, version: int) -> None:
        mkdirs(self.spark, self.folder(version) + "/_done")

    @contextmanager
    def lease(self, version: int | None = None) -> Iterator[int | None]:
        """Pin a version (the newest, unless named) while reading it."""
        version = self.newest() if version is None else version
        if version is None:
            yield None
            return
        mark = f"{self.path}/_leases/{version}-{uuid.uuid4().hex}"
        mkdirs(self.spark, mark)
        try:
            yield version
        finally:
            remove(self.spark, mark)

    def leased(self) -> set[int]:
        fs, p = _fs(self.spark, f"{self.path}/_leases")
        if not fs.exists(p):
            return set()
        alive = 1000 * (time.time() - 3600 * LEASE_HOURS)
        return {int(st.getPath().getName().split("-")[0]) for st in fs.listStatus(p) if st.getModificationTime() >= alive}

    def vacuum(self, grace: int = GRACE) -> list[int]:
        """Remove all but the newest ``grace`` versions and leased ones; returns the versions that stay."""
        done = self.committed()
        if not done:
            return []
        stay = set(done[-max(1, grace):]) | (self.leased() & set(done))
        for v in markers(self.spark, self.path, "v"):
            if v not in stay and v < max(done):   # above: begun by a writer at work
                remove(self.spark, self.folder(v))
        return sorted(stay)
