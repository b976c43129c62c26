"""Arrow batches of sorted partitions cut at group borders, for operators that work on many groups at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Rows gathered before they are worked on.
BATCH_ROWS = 1 << 16


def _values(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where the values are; a null is a value of its own."""
    c = column.combine_chunks().dictionary_encode()
    return np.asarray(c.indices.fill_null(len(c.dictionary)))


def group_codes(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Running number of the groups of a table sorted by ``keys``."""
    head = np.zeros(t.num_rows, bool)
    head[:1] = True
    for k in keys:
        v = _values(t.column(k))
        head[1:] |= v[1:] != v[:-1]
    return np.cumsum(head) - 1


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows_at_once: int = BATCH_ROWS) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``; no group spans two tables.

    Every row is looked at once, however many batches a group spans: only a batch's own borders are judged, and
    what is held is joined when it is handed out.
    """
    held: list[pa.Table] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        code = group_codes(t, keys)
        # Rows before ``edge`` end a group; the rest belongs to a group that may go on.
        edge = int(np.searchsorted(code, code[-1]))
        ends = [[t.column(k)[i].as_py() for k in keys] for i in (0, t.num_rows - 1)]
        if rows >= rows_at_once and ends[0] != last:
            yield pa.concat_tables(held).combine_chunks()
            held, rows = [], 0
        if edge:
            held.append(t.slice(0, edge))
            rows += edge
            if rows >= rows_at_once:
                yield pa.concat_tables(held).combine_chunks()
                held, rows = [], 0
            t = t.slice(edge)
        held.append(t)
        rows += t.num_rows
        last = ends[1]
    if rows:
        yield pa.concat_tables(held).combine_chunks()
