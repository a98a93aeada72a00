"""Files written by tasks in a shared folder, and their manifest.

Every task attempt writes files of its own name; the driver's commit lists
the files of the attempts that won in ``manifest.json`` (one entry per
partition).  Readers see only listed files, so a retried or abandoned attempt
leaves nothing that is read.  Paths are URIs that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs

MANIFEST = "manifest.json"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


def new_name(partition: int, suffix: str) -> str:
    return f"part-{partition:06d}-{uuid.uuid4().hex}{suffix}"


def write_manifest(uri: str, entries: list[dict]) -> None:
    system, path = open_folder(uri)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{MANIFEST}") as out:
        out.write(json.dumps({"parts": entries}).encode())


def read_manifest(uri: str) -> list[dict]:
    system, path = open_folder(uri)
    with system.open_input_stream(f"{path}/{MANIFEST}") as source:
        return json.loads(source.read())["parts"]


def remove(uri: str, names: list[str]) -> None:
    system, path = open_folder(uri)
    for name in names:
        try:
            system.delete_file(f"{path}/{name}")
        except OSError:
            pass
