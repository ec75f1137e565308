"""Committed binary files written and read by Spark tasks.

A task writes under a name of its own; the driver lists the files of successful
attempts in one manifest when the job commits.  Readers follow the manifest, so
files of lost or speculative attempts are never read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql.datasource import WriterCommitMessage

MANIFEST = "_manifest.json"


def open_store(uri: str):
    """(file system, path) of a URI in any store that Arrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.removeprefix("file:") if uri.startswith("file:") else uri)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its place in the order, and its file's figures.

    A task without rows writes no file and has no name.
    """

    partition: int
    name: str
    figures: dict


def new_name() -> tuple[int, str]:
    part = TaskContext.get().partitionId()
    return part, f"part-{part:06d}-{uuid.uuid4().hex[:12]}"


def commit(uri: str, messages: list[Written | None], header: dict) -> None:
    """One entry for each non-empty file, in partition order, with running sums.

    The manifest has as many entries as the job had tasks, whatever the rows.
    """
    entries, base = [], {}
    for m in sorted((m for m in messages if m is not None and m.name), key=lambda m: m.partition):
        entries.append({"name": m.name} | m.figures | {f"{k}_before": base.get(k, 0) for k in m.figures})
        base = {k: base.get(k, 0) + v for k, v in m.figures.items()}
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{MANIFEST}") as out:
        out.write(json.dumps(header | {"files": entries}).encode())


def abort(uri: str, messages: list[Written | None]) -> None:
    store, path = open_store(uri)
    for m in messages:
        if m is not None and m.name:
            for end in (".data", ".index"):
                try:
                    store.delete_file(f"{path}/{m.name}{end}")
                except OSError:
                    pass


def integers(file, at: int, n: int) -> np.ndarray:
    """``n`` little-endian 64-bit integers of an open file, from the ``at``-th on."""
    raw = file.read_at(8 * n, 8 * at)
    if len(raw) != 8 * n:
        raise OSError("a short read")
    return np.frombuffer(raw, "<i8")


def records_between(file, start: int, end: int, width: int = 2, page: int = 4096) -> np.ndarray:
    """Records of ``width`` integers, sorted by their first, for which that is in [start, end).

    The first of them is sought by halves down to a page, and pages are read until one
    goes beyond ``end``; so what is read follows the number of records found, not the file.
    """
    low, high = 0, file.size() // (8 * width)
    many = high
    while high - low > page:
        middle = (low + high) // 2
        if integers(file, middle * width, 1)[0] < start:
            low = middle + 1
        else:
            high = middle
    found = []
    while low < many:
        rows = integers(file, low * width, min(page, many - low) * width).reshape(-1, width)
        found.append(rows[(rows[:, 0] >= start) & (rows[:, 0] < end)])
        if rows[-1, 0] >= end:
            break
        low += len(rows)
    return np.concatenate(found) if found else np.zeros((0, width), np.int64)


def manifest(uri: str) -> dict:
    store, path = open_store(uri)
    with store.open_input_stream(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())
