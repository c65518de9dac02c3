"""Files by path or URI, local or in a store that pyarrow opens (S3, GCS, HDFS)."""

from __future__ import annotations

from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def open_input(path: str):
    """A file that can be read and sought."""
    store, at = store_of(path)
    return store.open_input_file(at)


def read_bytes(path: str) -> bytes:
    with open_input(path) as f:
        return f.read()


def open_output(path: str):
    store, at = store_of(path)
    return store.open_output_stream(at, compression=None)


def joined(folder: str, path: str, head: bytes = b"", between: bytes = b"\n", end: bytes = b"\n") -> None:
    """The lines of a written folder's part files as one file, ``between`` them; copied piece by piece, never held whole."""
    store, at = store_of(folder)
    parts = sorted(x.path for x in store.get_file_info(fs.FileSelector(at)) if x.is_file and x.base_name.startswith("part-"))
    with open_output(path) as out:
        out.write(head)
        waiting = False
        for part in parts:
            with store.open_input_stream(part, compression=None) as f:
                while piece := f.read(1 << 22):
                    if waiting:
                        out.write(between)
                    waiting = piece.endswith(b"\n")
                    out.write((piece[:-1] if waiting else piece).replace(b"\n", between))
        out.write(end)
    store.delete_dir(at)


def fresh_folder(path: str, delete: bool = False) -> None:
    """Make a folder; what it holds already is deleted only where that is asked for, else it is an error."""
    store, at = store_of(path)
    if store.get_file_info(at).type == fs.FileType.Directory and store.get_file_info(fs.FileSelector(at)):
        if not delete:
            raise ValueError(f"{path} is not empty")
        store.delete_dir_contents(at)
    store.create_dir(at, recursive=True)
