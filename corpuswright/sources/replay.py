"""A Python data source that replays recorded service answers from files.

``spark.dataSource.register(ReplaySource)``, then
``spark.read.format("replay").option("path", folder).option("connector", name).load()``.

A folder holds one file a request, named ``<connector>__<anything>.json|xml|txt``; a file whose name ends in
``.error`` holds the failure a service gave. Rows: connector, request, status, payload. One
partition a file, so requests run in parallel; a failure is a row with its status and never ends the job.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "connector string, request string, status string, payload string"
# Failure codes and the status they mean.
FAILURES = {"401": "AUTHENTICATION_FAILED", "403": "AUTHENTICATION_FAILED", "429": "RATE_LIMITED", "timeout": "SOURCE_UNAVAILABLE", "credentials": "SKIPPED_NO_CREDENTIALS"}


def status_of(name: str, payload: str) -> str:
    if name.endswith(".error"):
        return FAILURES.get(payload.strip().lower(), "SOURCE_UNAVAILABLE")
    return "SUCCESS" if payload.strip() not in ("", "{}", "[]", "null") else "NO_RESULTS"


class Request(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ReplayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.connector = options.get("connector", "")
        self.limit = int(options.get("limit", "0"))
        self.credentials = options.get("credentials", "yes")

    def partitions(self) -> list[InputPartition]:
        names = sorted(n for n in os.listdir(self.folder) if n.split("__")[0] == self.connector or not self.connector)
        return [Request(os.path.join(self.folder, n)) for n in (names[: self.limit] if self.limit else names)]

    def read(self, partition: Request) -> Iterator[tuple]:
        name = os.path.basename(partition.path)
        connector = name.split("__")[0]
        if self.credentials == "no":
            yield connector, name, "SKIPPED_NO_CREDENTIALS", None
            return
        try:
            with open(partition.path, encoding="utf-8") as f:
                payload = f.read()
        except OSError:
            yield connector, name, "SOURCE_UNAVAILABLE", None
            return
        status = status_of(name, payload)
        yield connector, name, status, payload if status == "SUCCESS" else None


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ReplayReader(self.options)
