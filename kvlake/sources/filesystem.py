"""Small file operations through Hadoop's FileSystem, so that any store Spark can use will do."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.  Only a local session
    gets a folder of its own where none is set."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kvlake-"))
    return context.getCheckpointDir()


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Shows a whole new file at once; False if there is one already, however many try at a time.

        The text is written aside under a name of its own.  On a local disk a hard link shows it, elsewhere
        a rename that does not overwrite; either fails if the target is there.
        """
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        stream = self._fs.create(self._path(draft), False)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        try:
            if self._fs.getScheme() == "file":
                os.link(self._local(draft), self._local(path))
            else:
                hadoop = self._jvm.org.apache.hadoop
                context = hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), self._conf)
                none = self._jvm.java.lang.reflect.Array.newInstance(hadoop.fs.Options.Rename.NONE.getClass(), 0)
                context.rename(self._path(draft), self._path(path), none)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self._fs.delete(self._path(draft), False)

    @staticmethod
    def _local(path: str) -> str:
        return unquote(urlparse(path).path) if path.startswith("file:") else path

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
