"""Binary files in a folder of any file system that pyarrow knows, published by a manifest.

Tasks write files under names of their own; the driver's commit lists those of the successful attempts in
the manifest, and readers open only what it lists. A task that is run again leaves at most an unlisted file."""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage

MANIFEST = "_manifest.json"


def located(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else f"file://{path[5:]}")
    return fs.LocalFileSystem(), path


def join(path: str, name: str) -> str:
    return posixpath.join(path, name)


def new_name(suffix: str) -> str:
    return f"part-{uuid.uuid4().hex}{suffix}"


def open_output(path: str):
    system, at = located(path)
    system.create_dir(posixpath.dirname(at), recursive=True)
    return system.open_output_stream(at, compression=None)


def open_input(path: str):
    system, at = located(path)
    return system.open_input_file(at)


def put(path: str, data: bytes) -> None:
    with open_output(path) as f:
        f.write(data)


def get(path: str) -> bytes:
    with open_input(path) as f:
        return f.read()


def delete(path: str) -> None:
    system, at = located(path)
    if system.get_file_info(at).type != fs.FileType.NotFound:
        system.delete_file(at)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: an entry for each file."""

    entries: list[dict]


def publish(path: str, messages: list) -> None:
    """Add the files of the messages to the manifest."""
    old = listed(path)
    new = [e for m in messages if m is not None for e in m.entries]
    put(join(path, MANIFEST), json.dumps(old + new).encode())


def listed(path: str) -> list[dict]:
    system, at = located(join(path, MANIFEST))
    return [] if system.get_file_info(at).type == fs.FileType.NotFound else json.loads(get(join(path, MANIFEST)))


def discard(path: str, messages: list) -> None:
    for m in messages:
        for e in m.entries if m is not None else []:
            delete(join(path, e["file"]))
