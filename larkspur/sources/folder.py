"""Files below a path of any Hadoop file system, and small JSON files that are put there at most once."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm, self._gateway = path.rstrip("/"), spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def files(self, name: str, recursive: bool = False) -> list[tuple[str, int, int]]:
        """(name below the path, bytes, time of change in ms)."""
        if not self._fs.exists(self._at(name)):
            return []
        root, found, out = self._fs.makeQualified(self._at("")).toString(), self._fs.listFiles(self._at(name), recursive), []
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toString()[len(root) :].lstrip("/"), f.getLen(), f.getModificationTime()))
        return out

    def folders(self, name: str) -> list[tuple[str, int]]:
        """(name, time of change in ms) of what lies directly in a folder."""
        at = self._at(name)
        return [(x.getPath().getName(), x.getModificationTime()) for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, name: str, what: dict) -> bool:
        """Make a file that is there as a whole or not at all; False if there is one of this name.

        Of any number of writers one gets True. On local disks the draft gets the name by a hard link, which fails if the
        name is taken; elsewhere by a rename that the file system must refuse in that case in one step (HDFS does; tests
        run on local disks only). Plain object stores need a lock beside it.
        """
        draft, target = self._at(f"_drafts/{uuid.uuid4().hex}"), self._at(name)
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(what).encode()))
        stream.close()
        self._fs.mkdirs(target.getParent())
        try:
            self._place(draft, target)
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getName().endswith(".FileAlreadyExistsException"):
                raise
            return False
        finally:
            if self._fs.exists(draft):
                self._fs.delete(draft, False)
        return True

    def _place(self, draft, target) -> None:
        folder = self._fs.resolvePath(target.getParent())
        if folder.toUri().getScheme() == "file":
            file = lambda path: self._jvm.java.io.File(path.toUri().getPath()).toPath()
            link = self._jvm.org.apache.hadoop.fs.Path(folder, target.getName())
            self._jvm.java.nio.file.Files.createLink(file(link), file(self._fs.resolvePath(draft)))
            return
        rename = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
        never_replace = self._gateway.new_array(rename, 1)
        never_replace[0] = rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), never_replace)

    def move(self, name: str, to: str) -> None:
        self._fs.mkdirs(self._at(to).getParent())
        if not self._fs.rename(self._at(name), self._at(to)):
            raise OSError(f"can't move {name} to {to}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
