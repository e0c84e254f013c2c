"""Bodies written as files, one each, that appear only once every task has succeeded.

``df.write.format("volume_files").option("form", "glb").mode("append").save(path)`` for rows of (name string, height double,
rings array of rings), after ``spark.dataSource.register(VolumeFiles)``; ``form`` is glb, gltf, ifc or cityjson.  Each task
writes below ``_attempts`` and tells the driver what it wrote; at commit the files move to their names and ``_SUCCESS`` lists
them, and when a task fails for good all that was written goes.  ``path`` may be of any file system that Arrow reaches, and must be one
that driver and executors share.  Of bodies with one name the last one moved stays.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from zonarium.sources import volumes

FORMS = ("glb", "gltf", "ifc", "cityjson")


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: a folder and the names in it."""

    folder: str
    names: list[str]


def _bytes(form: str, name: str, rings: Any, height: float) -> bytes:
    if form == "ifc":
        return volumes.ifc(name, rings, height).encode()
    if form == "cityjson":
        return json.dumps(volumes.cityjson(name, rings, height)).encode()
    document, buffer = volumes.gltf(rings, height)
    if form == "glb":
        return volumes.glb(document, buffer)
    whole = document | {"buffers": [{"byteLength": len(buffer), "uri": "data:application/octet-stream;base64," + base64.b64encode(buffer).decode()}]}
    return json.dumps(whole).encode()


class VolumeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume_files"

    def schema(self) -> str:
        return "name string, height double, rings array<array<struct<x:double,y:double>>>"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return VolumeWriter(self.options, overwrite)


class VolumeWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.form, self.overwrite = options["path"].rstrip("/"), options.get("form", "glb"), overwrite
        if self.form not in FORMS:
            raise ValueError(f"form is one of {', '.join(FORMS)}")
        self.job = uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, top = self._place()
        folder, names = f"{top}/_attempts/{self.job}/{uuid.uuid4().hex}", []
        system.create_dir(folder)
        for row in iterator:
            if row.name is None or "/" in row.name or row.name.startswith(("_", ".")):
                raise ValueError(f"{row.name!r} is no name of a file")
            data = _bytes(self.form, row.name, row.rings, row.height)
            with system.open_output_stream(f"{folder}/{row.name}.{self.form}") as out:
                out.write(data)
            names.append(f"{row.name}.{self.form}")
        return Written(folder, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, top = self._place()
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                if info.type == fs.FileType.File:
                    system.delete_file(info.path)
        every = sorted((name, m.folder) for m in messages if m for name in m.names)
        for name, folder in every:
            system.move(f"{folder}/{name}", f"{top}/{name}")
        with system.open_output_stream(f"{top}/_SUCCESS") as out:
            out.write("\n".join(name for name, _ in every).encode())
        self._clear(system, top)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*self._place())

    def _clear(self, system: fs.FileSystem, top: str) -> None:
        """Drops this job's attempts, and the folder of attempts once no job uses it."""
        attempts = f"{top}/_attempts"
        if system.get_file_info(f"{attempts}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{attempts}/{self.job}")
        if system.get_file_info(attempts).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(attempts)):
            system.delete_dir(attempts)
