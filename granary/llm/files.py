"""Files in the shared folder, from Python workers."""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that holds ``path``, a URI or an absolute path, and the path in it."""
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def publish(path: str, data: bytes) -> None:
    """Writes a whole file under a name of its own and then moves it to ``path``.

    A task that is run again replaces the file by an equal one; nobody sees a
    part of it.
    """
    store, inner = place(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    own = f"{inner}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(own) as out:
        out.write(data)
    try:
        store.move(own, inner)
    except OSError:  # some stores do not replace files by a move
        store.delete_file(inner)
        store.move(own, inner)
