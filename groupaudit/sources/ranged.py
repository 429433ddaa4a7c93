"""Parts of files of any file system, read inside tasks without reading the rest."""

from __future__ import annotations

import re
import uuid
from typing import BinaryIO
from urllib.parse import quote

from pyarrow import fs

SAME_STORE = {"s3a": "s3", "s3n": "s3"}  # Spark's names of a store that has another name elsewhere


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a path as Spark lists it: a scheme, or none for a local file."""
    scheme, rest = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", path, re.S).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), re.sub("^/+", "/", rest)
    return fs.FileSystem.from_uri(f"{SAME_STORE.get(scheme, scheme)}:{quote(rest, safe='/@:')}")


def opened(path: str) -> BinaryIO:
    """Seekable file; bytes are fetched where they are read."""
    store, inner = located(path)
    return store.open_input_file(inner)


def first_line(path: str, block: int = 1 << 16) -> str:
    """First line without its end and byte order mark; of a compressed file, of what it holds."""
    store, inner = located(path)
    line = b""
    with store.open_input_stream(inner, compression="detect") as file:
        while b"\n" not in line and (more := file.read(block)):
            line += more
    return line.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8-sig")


def write_whole(path: str, content: bytes) -> None:
    """Write under another name, then rename."""
    store, inner = located(path)
    folder, name = inner.rsplit("/", 1)
    store.create_dir(folder, recursive=True)
    aside = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as file:
        file.write(content)
    store.move(aside, inner)
