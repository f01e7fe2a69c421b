"""Groups of consecutive rows in sorted partitions, handed on many at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts): rows of complete groups of equal keys and the index each group starts at. Rows must
    come sorted by keys; a group is held whole, so cut what may grow into blocks beforehand."""
    held: list[pa.Table] = []
    count = 0

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[:1] = True
        for k in keys:
            c = t.column(k).combine_chunks()
            if isinstance(c, pa.ChunkedArray):
                c = pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
            codes = np.asarray(c.dictionary_encode().indices.fill_null(-1)) if not pa.types.is_integer(c.type) else np.asarray(c.fill_null(-(2**31)))
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not len(batch):
            continue
        held.append(pa.Table.from_batches([batch]))
        count += len(batch)
        if count >= least:
            t = pa.concat_tables(held)
            s = starts(t)
            if s[-1] > 0:
                yield t.slice(0, s[-1]), s[:-1]
                held, count = [t.slice(s[-1])], len(t) - int(s[-1])
            else:
                held = [t]
                least = max(least, 2 * count)
    if held:
        t = pa.concat_tables(held)
        yield t, starts(t)
