"""A durable queue of company purges.

A request is one small file. ``submit`` writes it aside and renames it into ``pending``; a run claims it by
renaming it into ``claimed`` and acknowledges it, after its effects are committed, by renaming it into ``done``. Every step
is one atomic rename, so a run that is killed leaves the request claimed and the next run takes it up again:
purging twice deletes nothing twice.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

from auditlake.sources.sinks import _fs
from auditlake.streaming.versions import mkdirs, names, rename


class PurgeRequests:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def submit(self, companies: list[str]) -> str:
        """Queue a purge (names trimmed, blanks dropped, unique); returns its id."""
        clean = sorted({c.strip() for c in companies if c and c.strip()})
        if not clean:
            raise ValueError("a purge request names at least one company")
        request = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        for folder in ("incoming", "pending", "claimed", "done"):
            mkdirs(self.spark, self._folder(folder))
        fs, p = _fs(self.spark, f"{self.path}/incoming/{request}")
        out = fs.create(p)
        out.write(bytearray(json.dumps(clean).encode()))
        out.close()
        rename(self.spark, f"{self.path}/incoming/{request}", f"{self.path}/pending/{request}")
        return request

    def pending(self) -> list[str]:
        """Requests that wait or were claimed by a run that did not finish."""
        return sorted(names(self.spark, self._folder("claimed")) + names(self.spark, self._folder("pending")))

    def claim(self) -> dict[str, list[str]]:
        """All open requests, oldest first, with their companies."""
        for request in names(self.spark, self._folder("pending")):
            rename(self.spark, f"{self.path}/pending/{request}", f"{self.path}/claimed/{request}")
        out = {}
        for request in names(self.spark, self._folder("claimed")):
            text = self.spark.read.option("wholetext", True).text(f"{self.path}/claimed/{request}").first()[0]
            out[request] = json.loads(text)
        return out

    def acknowledge(self, requests) -> None:
        for request in requests:
            rename(self.spark, f"{self.path}/claimed/{request}", f"{self.path}/done/{request}")
