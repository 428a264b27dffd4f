"""Arrow helpers of the Python operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def batch(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` as names that no column in ``taken`` has, whatever the case."""
    used, mark = {c.lower() for c in taken}, "_"
    while any((mark + w).lower() in used for w in wanted):
        mark += "_"
    return [mark + w for w in wanted]


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, Iterator[pa.RecordBatch]]]:
    """Rows sorted by a column without nulls -> each of its values with an iterator of its rows, which is used up before the next."""
    source, left = iter(batches), None

    def refill() -> None:
        nonlocal left
        while left is not None and not left.num_rows or left is None:
            left = next(source, False)
            if left is False:
                return

    def part(value) -> Iterator[pa.RecordBatch]:
        nonlocal left
        while left is not False and left[key][0].as_py() == value:
            same = left[key].to_numpy() == value
            n = left.num_rows if same.all() else int(np.argmin(same))
            rows, left = left.slice(0, n), left.slice(n) if n < left.num_rows else None
            refill()
            yield rows

    refill()
    while left is not False:
        value = left[key][0].as_py()
        rest = part(value)
        yield value, rest
        for _ in rest:
            pass
