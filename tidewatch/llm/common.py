"""What the operators of this subpackage share: text conventions, and the library's scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.tables import materialize, scratch_dir  # noqa: F401

#: White space everywhere in this subpackage: space and the controls \t to \r.
#: ``bytes.split``, ``bytes.strip`` and ``bytes.lower`` follow the same ASCII rules.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Bytes of a text in a row on the way to Python, so that a batch of Spark's 10,000 rows has 5 MB, however long texts are.
CHUNK = 1 << 9
BYTES = 4 << 20  # of texts that a task works on at a time, or those of one text


def text_bytes(text: str | Column = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.cast("string"), F.lit("")).cast("binary")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def slices(texts: pa.Array, size: int = BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about ``size`` bytes, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, to
        at = to


def chunked(text: Column, size: int = CHUNK) -> Column:
    """Bytes as an array of parts of ``size``, one at least. A row's bytes are copied out once, not for each part."""

    def parts(all_: Column) -> Column:
        last = F.floor(F.greatest(F.octet_length(all_) - 1, F.lit(0)) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(all_, i * size + 1, F.lit(size)))

    return let(text, parts)


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) from rows (id, part's number, part): parts of a text lie in a row, so their bytes are not copied but for those of a batch's last text."""
    held_id, held = None, []
    for batch in batches:
        ids, number, part = batch.columns
        begins = np.flatnonzero(number.to_numpy(zero_copy_only=False) == 0)
        _, offsets, data = part.buffers()
        ends = np.frombuffer(offsets, np.int32)[part.offset : part.offset + len(part) + 1]
        held += [data[ends[0] : ends[begins[0] if len(begins) else -1]].to_pybytes()] if data is not None and len(part) else []
        if not len(begins):
            continue
        if held_id is not None:
            yield held_id, pa.array([b"".join(held)], pa.binary())
        if len(begins) > 1:
            yield ids.take(pa.array(begins[:-1])), pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(ends[begins].copy()), data])
        held_id, held = ids.slice(int(begins[-1]), 1), [data[ends[begins[-1]] : ends[-1]].to_pybytes()] if data is not None else []
    if held_id is not None:
        yield held_id, pa.array([b"".join(held)], pa.binary())


def give_back() -> None:
    """Hand memory that is free in this process, of Arrow's pool and of malloc's, back to the system."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The task for ``mapInArrow``, at whose end its memory goes back: workers live on, beside those of later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run
