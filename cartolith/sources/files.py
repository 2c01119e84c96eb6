"""Files by path or address: local ones, and those of any store that pyarrow can open (s3, gs, hdfs, file)."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager


def is_address(path: str) -> bool:
    return "://" in path or path.startswith("file:")


def store_of(path: str):
    """(file system, path in it) of an address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


def open_input(path: str):
    """A readable, seekable binary file."""
    if not is_address(path):
        return open(path, "rb")
    system, name = store_of(path)
    return system.open_input_file(name)


def file_size(path: str) -> int:
    if not is_address(path):
        return os.path.getsize(path)
    system, name = store_of(path)
    info = system.get_file_info(name)
    if not info.is_file:
        raise FileNotFoundError(path)
    return info.size


@contextmanager
def published(path: str) -> Iterator:
    """A writable stream whose bytes become the file ``path`` when the block ends well, and nothing otherwise."""
    part = path + ".partial"
    if is_address(path):
        system, name = store_of(path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        out = system.open_output_stream(name + ".partial", compression=None)
        move, remove = lambda: system.move(name + ".partial", name), lambda: system.delete_file(name + ".partial")
    else:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        out = open(part, "wb")
        move, remove = lambda: os.replace(part, path), lambda: os.remove(part)
    try:
        with out:
            yield out
    except BaseException:
        remove()
        raise
    move()


@contextmanager
def placed(path: str, head: bytes, size: int) -> Iterator[str]:
    """The path of a file of ``size`` bytes that begins with ``head``, for tasks to write at any place; it becomes ``path`` when the block ends well."""
    part = path + ".partial"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    try:
        with open(part, "wb") as f:
            f.write(head)
            f.truncate(size)
        yield part
        os.replace(part, path)
    except BaseException:
        if os.path.exists(part):
            os.remove(part)
        raise


def list_folder(folder: str) -> list[str] | None:
    """Paths of the files in a folder, sorted; None if it is no folder."""
    if not is_address(folder):
        if not os.path.isdir(folder):
            return None
        with os.scandir(folder) as entries:
            return sorted(e.path for e in entries if not e.is_dir())
    from pyarrow import fs

    system, name = store_of(folder)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return None
    scheme = folder[: len(folder) - len(name)] if folder.endswith(name) else folder.rsplit("/", name.count("/"))[0]
    return sorted(scheme + i.path for i in system.get_file_info(fs.FileSelector(name)) if i.is_file)
