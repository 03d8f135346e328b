"""One Arrow batch in, one Arrow batch out, row by row beside the input's own columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes of text that a function gets at once: bound what it makes of a batch. A longer text comes alone.
ROWS, BYTES = 1000, 8_000_000
#: Given a column of texts (null allowed), the new columns, a value for each text.
TextFunction = Callable[[pa.Array], list[pa.Array]]


def beside(docs: DataFrame, make: Callable[[], TextFunction], new: str, carry: list[str] | None = None,
           text: str = "text") -> DataFrame:
    """Columns ``row`` (a struct of the carried columns, None: all) and ``new`` (as DDL).

    The struct keeps the input's names apart from the new ones, whatever they are. ``make``
    runs once per task, so a function may build its tables there.
    """
    carried = docs.columns if carry is None else carry
    source = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for whole in batches:
            for first, last in _runs(whole.column(1)):
                batch = whole.slice(first, last - first)
                found = function(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=["row", *names])

    names = [x.split()[0] for x in _parts(new)]
    return source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, {new}")


def _sizes(values: pa.Array) -> np.ndarray:
    """Bytes of strings, elements of lists, of a struct those of its first field, else none."""
    kind = values.type
    if pa.types.is_struct(kind):
        return _sizes(values.field(0))
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        found = pc.binary_length(values)
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
        found = pc.list_value_length(values)
    else:
        return np.zeros(len(values), np.int64)
    return pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(values: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounded runs of rows."""
    ends = np.cumsum(_sizes(values))
    first = 0
    while first < len(values):
        before = ends[first - 1] if first else 0
        last = min(first + ROWS, max(first + 1, int(np.searchsorted(ends, before + BYTES, side="right"))), len(values))
        yield first, last
        first = last


def _parts(ddl: str) -> list[str]:
    out, depth = [""], 0
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]
