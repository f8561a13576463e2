"""Files written from inside tasks, to any shared file system that Arrow knows."""

from __future__ import annotations

from typing import Any


def file_system(folder: str) -> tuple[Any, str]:
    """The file system of a folder and its path there: ``hdfs://``, ``s3://``, ``gs://``, ``file:`` or a plain (mounted) path."""
    import os

    from pyarrow import fs

    if "://" not in folder:
        return fs.LocalFileSystem(), os.path.abspath(folder.removeprefix("file:"))
    return fs.FileSystem.from_uri(folder)


def write_file(system: Any, path: str, parts) -> int:
    """Write byte strings one after another; the file gets its name only when it is whole.  The number of bytes."""
    size = 0
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path + ".part") as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(path + ".part", path)
    return size
