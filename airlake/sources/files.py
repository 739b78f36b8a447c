"""Files of any store as seekable handles in Python tasks."""

from __future__ import annotations

import fnmatch
import posixpath
import re
import uuid

from pyarrow import fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path): a path without a scheme, or with file:, is local; others are what Arrow knows (hdfs, s3, gs)."""
    if not re.match(r"[a-z0-9+]+:/", uri) or uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri)


def listed(uri: str, pattern: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """Files below a folder, or those that a path with * in it names, whose name fits ``pattern``; hidden ones (. or _ in front of a name) are left out."""
    fs, path = opened(uri)
    base = path[: path.index("*")].rsplit("/", 1)[0] if "*" in path else path
    if fs.get_file_info(base).type == pafs.FileType.File:
        found = [fs.get_file_info(base)]
    else:
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=False))
    inside = lambda f: not re.search(r"/[._]", "/" + f.path[len(base) :].lstrip("/"))
    fits = lambda f: fnmatch.fnmatch(f.base_name, pattern) and ("*" not in path or fnmatch.fnmatch(f.path, path))
    return fs, sorted((f for f in found if f.type == pafs.FileType.File and inside(f) and fits(f)), key=lambda f: f.path)


class Draft:
    """A file that is written under a hidden name and moved to its own when it is whole."""

    def __init__(self, uri: str, name: str):
        self.fs, root = opened(uri)
        self.path = posixpath.join(root, name)
        self.hidden = posixpath.join(posixpath.dirname(self.path), f".{uuid.uuid4().hex}")
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)

    def move(self) -> None:
        self.fs.move(self.hidden, self.path)

    def drop(self) -> None:
        if self.fs.get_file_info(self.hidden).type == pafs.FileType.File:
            self.fs.delete_file(self.hidden)
