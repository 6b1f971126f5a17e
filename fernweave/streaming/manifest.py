"""Which folders a table consists of: a small file beside them, written under the next number and renamed into place last.

A reader sees a change whole or not at all. The manifest before the newest stays, for readers that have begun with it.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Manifest:
    """The manifest of the table under path; what it says before there is one is `empty`."""

    def __init__(self, spark: SparkSession, path: str, empty: dict) -> None:
        self.spark, self.path, self.empty = spark, path, empty

    def at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)  # noqa: SLF001

    def files(self):
        return self.at("").getFileSystem(self.spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def names(self, folder: str) -> list[str]:
        """What lies in a folder of the table; none if it isn't there."""
        files, place = self.files(), self.at(folder)
        return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []

    def version(self) -> int:
        """The number of the newest manifest, 0 if there is none."""
        return max((int(n.split(".")[0]) for n in self.names("manifest") if n.endswith(".json")), default=0)

    def read(self) -> dict:
        version = self.version()
        if not version:
            return {"version": 0, **self.empty}
        opened = self.files().open(self.at(f"manifest/{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))  # noqa: SLF001
        finally:
            opened.close()

    def swap(self, told: dict) -> None:
        """told, which names its own version (one above the newest), becomes the newest."""
        files, version = self.files(), told["version"]
        draft = self.at(f"manifest/{version}.draft")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        if not files.rename(draft, self.at(f"manifest/{version}.json")):
            raise RuntimeError(f"manifest {version} of {self.path} is there already: two writers")
        if version > 2:
            files.delete(self.at(f"manifest/{version - 2}.json"), False)

    def delete(self, name: str) -> None:
        self.files().delete(self.at(name), True)
