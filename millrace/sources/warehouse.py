"""A warehouse of Parquet tables in versions: a version is written aside and becomes current by one small file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .files import delete, read_text, write_text


class Warehouse:
    """One writer; readers see a version as a whole or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def state(self) -> dict:
        """The current version, its registered files and all attempts: one small file, so that they cannot part."""
        return json.loads(read_text(self.spark, f"{self.root}/STATE.json") or '{"version": null, "attempts": [], "files": {}}')

    def _put(self, state: dict) -> None:
        write_text(self.spark, f"{self.root}/STATE.json", json.dumps(state, ensure_ascii=False, sort_keys=True, indent=1))

    def current(self) -> str | None:
        return self.state()["version"]

    def table(self, name: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{version or self.current()}/{name}")

    def write(self, version: str, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{version}/{name}")
        return self.table(name, version)

    def publish(self, version: str, ledger: dict) -> None:
        """Makes a version current, with the ledger that belongs to it."""
        self._put(ledger | {"version": version})

    def discard(self, version: str) -> None:
        delete(self.spark, f"{self.root}/{version}")

    def ledger(self) -> dict:
        """Attempts and registered files."""
        own = self.state()
        return {k: own[k] for k in ("attempts", "files")}

    def record(self, ledger: dict) -> None:
        """Keeps a ledger beside the version that is current; a failure stays on record."""
        self._put(ledger | {"version": self.current()})
