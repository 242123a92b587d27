"""Small files in a file system that driver and executors share, by Hadoop's API."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``.  Only where all runs in one process,
    and the session has no such setting, is it a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/resultfeed-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="resultfeed-")
    atexit.register(shutil.rmtree, made, True)
    return made


class SharedFiles:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, below: str) -> str:
        return f"{self.root}/{below}"

    def _at(self, below: str):
        p = self._jvm.org.apache.hadoop.fs.Path(self.path(below))
        return p, p.getFileSystem(self._conf)

    def exists(self, below: str) -> bool:
        p, fs = self._at(below)
        return fs.exists(p)

    def read(self, below: str) -> str:
        p, fs = self._at(below)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, below: str, text: str) -> None:
        """Replaces the file in one rename: a reader sees the old text or the new one."""
        p, fs = self._at(below)
        draft, _ = self._at(below + ".draft")
        stream = fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self._conf)
        over = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = SparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = over
        context.rename(draft, p, options)

    def names(self, below: str) -> list[str]:
        p, fs = self._at(below)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, below: str) -> None:
        p, fs = self._at(below)
        fs.delete(p, True)
