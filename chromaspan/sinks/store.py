"""Files by name on any file system that Arrow opens: refused where they exist, and folders that appear whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path)


def refuse_existing(path: str) -> None:
    store, place = located(path)
    if store.get_file_info(place).type != fs.FileType.NotFound:
        raise FileExistsError(path)


def names(path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    store, place = located(path)
    found = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
    return sorted(x.base_name for x in found)


def write_bytes(path: str, data: bytes) -> None:
    store, place = located(path)
    with store.open_output_stream(place, compression=None) as out:
        out.write(data)


def read_bytes(path: str) -> bytes:
    store, place = located(path)
    with store.open_input_stream(place, compression=None) as source:
        return source.read()


def move(path: str, to: str) -> None:
    store, place = located(path)
    store.move(place, located(to)[1])


def delete_folder(path: str) -> None:
    store, place = located(path)
    store.delete_dir(place)


@contextmanager
def staged(path: str) -> Iterator[str]:
    """A folder beside ``path``, which must not exist, that takes its name at the end; after an error nothing is left of it."""
    refuse_existing(path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    store, place = located(staging)
    store.create_dir(place, recursive=True)
    try:
        yield staging
    except BaseException:
        store.delete_dir(place)
        raise
    refuse_existing(path)
    move(staging, path)
