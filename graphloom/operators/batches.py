"""Arrow batches cut where a key ends."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa


def starts(rows: pa.Table, key: Sequence[str]) -> np.ndarray:
    """Whether a row has another key than the one before it; nulls are equal."""
    out = np.ones(rows.num_rows, dtype=bool)
    out[1:] = False
    for name in key:
        column = rows.column(name).combine_chunks()
        if not pa.types.is_integer(column.type) or column.null_count:
            column = column.dictionary_encode(null_encoding="encode").indices
        codes = column.to_numpy()
        out[1:] |= codes[1:] != codes[:-1]
    return out


def whole_keys(batches: Iterable[pa.RecordBatch], key: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of batches that are in the order of a key, as tables of whole keys; holds a batch or a key."""
    held: list[pa.Table] = []  # their last key may go on
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        cut = int(np.flatnonzero(starts(rows, key))[-1])
        if cut:
            yield pa.concat_tables([*held, rows.slice(0, cut)])
            held = [rows.slice(cut)]
        elif held and starts(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), rows.slice(0, 1)]), key)[1]:
            yield pa.concat_tables(held)
            held = [rows]
        else:
            held.append(rows)
    if held:
        yield pa.concat_tables(held)
