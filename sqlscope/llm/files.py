"""Files in shared storage for the binary data sources, with one manifest per write.

Tasks write files under names of their own; the driver lists those of the
committed tasks in a manifest, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs

MANIFEST = "_manifest"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def new_file(path: str, suffix: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, folder's path, name of a new file in it); the folder is made."""
    system, folder = open_fs(path)
    system.create_dir(folder, recursive=True)
    return system, folder, f"part-{uuid.uuid4().hex}{suffix}"


def write_manifest(path: str, entries: list[dict], overwrite: bool) -> None:
    system, folder = open_fs(path)
    system.create_dir(folder, recursive=True)
    old = [] if overwrite else list_manifests(system, folder)
    name = f"{MANIFEST}-{len(old):05d}-{uuid.uuid4().hex}.json"
    with system.open_output_stream(f"{folder}/{name}") as f:
        f.write(json.dumps(entries).encode())
    if overwrite:
        for x in list_manifests(system, folder):
            if not x.endswith(name):
                system.delete_file(x)


def list_manifests(system: fs.FileSystem, folder: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(x.path for x in found if x.base_name.startswith(MANIFEST))


def read_manifest(path: str) -> list[dict] | None:
    """Entries of all writes in order; None where there is no manifest."""
    system, folder = open_fs(path)
    names = list_manifests(system, folder)
    if not names:
        return None
    out: list[dict] = []
    for name in names:
        with system.open_input_stream(name) as f:
            out += json.loads(f.read())
    return out


def delete(path: str, names: list[str]) -> None:
    system, folder = open_fs(path)
    for name in names:
        if system.get_file_info(f"{folder}/{name}").type == fs.FileType.File:
            system.delete_file(f"{folder}/{name}")
