"""Binary files that executors write to the shared folder."""

from __future__ import annotations

import os
import uuid


def put(uri: str, data: bytes) -> None:
    """Write a whole file, then move it to its name: a repeated or killed attempt leaves no half file."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    part = f"{os.path.dirname(path)}/_tmp-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


def folder(uri: str) -> str:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return uri
