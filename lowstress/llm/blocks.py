"""Rows dealt into blocks as compressed bodies: whole texts cross a shuffle at a fraction of their size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def by_block(batches):
    """Rows of a batch by block, compressed: (block, body)."""
    for batch in batches:
        block = batch.column(batch.schema.get_field_index("block")).to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(block[order], prepend=-1)), len(order))
        out = [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(batch.take(pa.array(order[s:e])))
            out[0].append(int(block[order[s]]))
            out[1].append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["block", "body"])


def unblock(table: pa.Table) -> pa.Table:
    """The rows of a block."""
    rows = pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in table["body"]])
    return rows.combine_chunks()


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step``, after which the worker, which idles until its next task, gives its free memory back."""

    def run(batches):
        try:
            yield from step(batches)
        finally:
            trim()

    return run


def trim() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
