"""Numbered files of which each is made once: the order of changes that several
writers make to one state."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIGITS = 20


class ManifestLog:
    """``folder/00000000000000000001.json``, ``...02.json`` and so on, a JSON object each.

    A writer puts its change under the number after the last one it has seen.  The
    file appears whole and only if that number is still free, so of two writers who
    saw the same state one succeeds and the other is told that it did not.  On local
    paths a finished file is linked to its name, which fails if the name is taken;
    elsewhere it is renamed without overwriting, which the file system has to do in
    one step (HDFS does).
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:0{_DIGITS}d}.json"

    def _local(self) -> str | None:
        """The folder on this machine, if it is one."""
        if self.folder.startswith("file:"):
            return "/" + self.folder[len("file:"):].lstrip("/")
        if "://" in self.folder:
            return None
        default = self.spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        return self.folder if default.startswith("file:") else None

    def last(self) -> int:
        """The highest number, 0 if there is none."""
        local = self._local()
        if local is not None:
            names = os.listdir(local) if os.path.isdir(local) else []
        else:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n[:_DIGITS]) for n in names if n.endswith(".json") and n[:_DIGITS].isdigit()), default=0)

    def put(self, number: int, change: Mapping[str, object]) -> bool:
        """Make the file of ``number``; False if it is there already."""
        text = json.dumps({"number": number, **change})
        local = self._local()
        if local is not None:
            return self._link(local, number, text)
        return self._rename(number, text)

    def _link(self, folder: str, number: int, text: str) -> bool:
        os.makedirs(folder, exist_ok=True)
        draft = f"{folder}/.{uuid.uuid4().hex}"
        with open(draft, "x", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(draft, f"{folder}/{number:0{_DIGITS}d}.json")
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True

    def _rename(self, number: int, text: str) -> bool:
        from py4j.protocol import Py4JJavaError

        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        draft, final = hadoop.Path(f"{self.folder}/.{uuid.uuid4().hex}"), hadoop.Path(self._path(number))
        fs = draft.getFileSystem(conf)
        out = fs.create(draft, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        options = self.spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        options[0] = getattr(hadoop, "Options$Rename").NONE
        try:
            hadoop.FileContext.getFileContext(draft.toUri(), conf).rename(draft, final, options)
        except Py4JJavaError as err:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(err.java_exception):
                return False
            raise
        return True

    def read(self, schema: str) -> DataFrame:
        """A row per file: number and the fields of ``schema``."""
        try:
            return self.spark.read.schema(f"number bigint, {schema}").json(self.folder)
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            return self.spark.createDataFrame([], f"number bigint, {schema}")


def micros(column: str) -> object:
    """Time of a column of microseconds since 1970."""
    return F.timestamp_micros(F.col(column))
