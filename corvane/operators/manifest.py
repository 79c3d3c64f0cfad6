"""Versions of a folder, published one after another.

Version n exists once ``manifest/<n>.json`` does. A writer states which version it
started from and claims the next number by creating that file, complete, if and only if
nobody did before: of two writers that started from the same version one fails and
leaves nothing behind that readers look at.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class PublishConflict(RuntimeError):
    """Another writer published the version; read its state and run again."""


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def version(self) -> int:
        """The last published version, 0 if there is none."""
        fs, place = self._fs(f"{self.path}/manifest")
        if not fs.exists(place):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return max([int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()], default=0)

    def read(self, version: int) -> dict:
        """What a version holds; {} for version 0."""
        if version == 0:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{version}.json", wholetext=True).first()[0])

    def publish(self, content: dict, base: int) -> int:
        """Claim version ``base`` + 1 with ``content``; PublishConflict if it is taken.

        The text is written aside first. On a local disk it is then hard-linked to its
        name, elsewhere renamed without overwriting: both are one step of the file system
        and fail if the name is there (object stores need a committer that has such a step).
        """
        version = base + 1
        fs, place = self._fs(f"{self.path}/manifest/{version}.json")
        _, staged = self._fs(f"{self.path}/staged/{uuid.uuid4().hex}.json")
        fs.mkdirs(place.getParent())
        out = fs.create(staged)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if fs.getUri().getScheme() == "file":
                local = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (place, staged)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(staged, place, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if fs.exists(place):
                raise PublishConflict(f"version {version} of {self.path} was published by another run") from e
            raise
        finally:
            fs.delete(staged, False)
        return version
