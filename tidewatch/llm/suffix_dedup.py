"""Exact substring dedup: bytes go that a repeated string of ``length`` bytes covers.

A sparse suffix array over all texts, sorted as Spark partitions:

1. Anchors. Of the k-byte tokens in a window of ``length`` bytes the one with the least hash is the
   window's anchor. Equal windows have their anchors at the same place, so it is enough to sort the
   suffixes that start at anchors (one in about 75 bytes). Consecutive windows with one anchor
   form a region. A first shuffle orders the regions by their leading token's hash and their
   content's digest: a region whose leading token is alone in the corpus cannot repeat and is left
   out, regions that are equal throughout repeat as a whole, and of these one stands for all.
2. Suffix array. The other regions are split at their anchors into the suffix from it and the
   reversed text before it. Spark samples splitters and range-partitions the suffixes by what they
   begin with; each bucket sorts suffixes and reversed texts by multikey quicksort and takes the
   longest common prefixes of neighbours. A window that begins d bytes before its anchor repeats
   if another region shares length - d bytes of suffix and d bytes before, that is, if both lie in
   one run of the two orders at these depths.
3. Boundaries. A run that touches the first or last suffix of its bucket may go on in the next.
   Regions with such windows meet again in a second array, range-partitioned by the reversed text
   before the anchor, which tells apart what follows many different texts. Windows whose runs
   touch a bucket's end in both arrays are compared by the 128-bit digest of their whole bytes.

Hot groups: equal regions are counted in sorted order, where a group may span any number of
partitions, and enter the array once a partition at most; a token in very many different contexts
spreads over buckets by what follows it, then by what is before it. What returns to a text is at most a number a region.
Texts are shuffled once, those with undecided regions a second time. Digests of 128 bits stand for
texts, regions and windows at boundaries; all else is compared byte by byte.

Edge cases: null counts as empty; texts shorter than ``length`` keep all; repeated rows and equal
texts are each other's repeats, so they lose all their bytes; a null id is carried along; an empty
table gives an empty table; columns other than the id and the text are not read. Very long texts
go through in blocks of ``BLOCK`` windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_bytes

LENGTH = 200  # bytes of a string that counts as a repeat
TOKEN = 48  # bytes of a leading token
BLOCK = 1 << 21  # windows of a text at a time
SLICE = 1 << 21  # bytes of texts at a time
#: A region in a long: 15 bits to spread equal ones, 32 of the first window's start, 8 of the number of windows, 8 of the anchor's distance.
SPREAD_BITS, START_BITS = 48, 16
EQUAL, SINGLE, FIRST = 1, 2, 3  # repeats as a whole; to be sorted; both, and stands for its equals

_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTES = np.frombuffer(b"".join(blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), np.uint64)
_LOW = np.uint64((1 << 24) - 1)


def _token_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A number for each k bytes in a row; equal bytes give equal numbers."""
    spans, h, span = {}, _BYTES[data], 1
    power = lambda n: np.uint64(pow(_MULTIPLIER, n, 1 << 64))
    while True:
        spans[span] = h
        if 2 * span > k:
            break
        h = h[:-span] * power(span) + h[span:]
        span *= 2
    out, done = h, span
    for size in sorted(spans, reverse=True)[1:]:
        if k & size:
            part = spans[size][done:]
            out, done = out[: len(part)] * power(size) + part, done + size
    out = out[: len(data) - k + 1].copy()
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row."""
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    return np.minimum(values[: len(values) - (width - span)], values[width - span :])


def regions(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = TOKEN) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor's distance, leading token's hash) of texts at [start, end) of ``data``, fewer than 2**24 bytes."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    h = _token_hashes(data, k)
    anchor = (_least_of((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), length - k + 1) & _LOW).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int32)
    some = ends - starts >= length
    np.add.at(edge, starts[some], 1)
    np.add.at(edge, ends[some] - length + 1, -1)
    first = np.flatnonzero(np.cumsum(edge[: len(anchor)]) > 0)
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at = anchor[first]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(first) != 1) | (np.diff(at) != 0)]))
    return first[new], np.diff(np.append(new, len(first))), (at - first)[new], h[at[new]].view(np.int64)


def _blocks(ends: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of texts that lie in a row, or those of the blocks of one long text."""
    starts = np.concatenate([[0], ends[:-1]])
    if len(ends) != 1 or ends[0] <= BLOCK + length:
        yield starts, ends
    else:
        for at in range(0, int(ends[0]) - length + 1, BLOCK):
            yield np.array([at]), np.array([min(int(ends[0]), at + BLOCK + length - 1)])


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array in a row, and where each value ends."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at[1:] - at[0]


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)


REGION = ["key", "d0", "d1", "t0", "t1", "packed"]


def _regions_of(length: int, k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            for a, b in slices(batch.column(3), SLICE):
                data, ends = _bytes_of(batch.column(3).slice(a, b - a))
                for starts, stops in _blocks(ends, length):
                    base = int(starts[0])
                    part = data[base : int(stops[-1])]
                    first, n, at, key = regions(part, starts - base, stops - base, length, k)
                    if not len(first):
                        continue
                    view = memoryview(part)
                    digests = b"".join([blake2b(view[x:y], digest_size=16).digest() for x, y in zip(first.tolist(), (first + n + length - 1).tolist())])
                    d = np.frombuffer(digests, np.int64).reshape(-1, 2)
                    own = np.searchsorted(stops - base, first, side="right") if len(stops) > 1 else np.zeros(len(first), np.int64)
                    start = first + base - (starts[own] if len(stops) > 1 else 0)
                    packed = (ids[2][a + own] << SPREAD_BITS) | (start << START_BITS) | (n << 8) | at
                    yield _batch(REGION, key, d[:, 0], d[:, 1], ids[0][a + own], ids[1][a + own], packed)

    return task


def _judge(rows: np.ndarray, touches: np.ndarray) -> np.ndarray:
    """(t0, t1, mark) of sorted regions (key, d0, d1, t0, t1, packed) that repeat or may; ``touches``: the first and the last row's tokens may go on outside."""
    new_key = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
    new = new_key | np.concatenate([[True], (rows[1:, 1:3] != rows[:-1, 1:3]).any(1)])
    group = np.cumsum(new) - 1
    key = np.cumsum(new_key) - 1
    copies = np.bincount(group)[group]
    unlike = np.bincount(key[new])[key]
    is_open = ((key == 0) & touches[0]) | ((key == key[-1]) & touches[1])
    sort = (unlike > 1) | is_open
    status = np.where(copies > 1, np.where(sort & new, FIRST, EQUAL), np.where(sort, SINGLE, 0))
    kept = status > 0
    mark = ((rows[kept, 5] & ((1 << SPREAD_BITS) - 1)) << 2) | status[kept]
    return np.column_stack([rows[kept, 3:5], mark])


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of a sorted partition's regions. Tokens are judged when the next one begins."""
    held: list[np.ndarray] = []
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if held and rows[-1, 0] == held[0][0, 0]:
            held.append(rows)
            continue
        rows = np.concatenate([*held, rows])
        at = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if at:
            out = _judge(rows[:at], np.array([first, False]))
            yield _batch(["t0", "t1", "mark"], *out.T)
            first = False
        held = [rows[at:]]
    if held:
        yield _batch(["t0", "t1", "mark"], *_judge(np.concatenate(held), np.array([first, True])).T)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of unsigned words, first word first.

    Multikey quicksort: rows are parted by one word into less, equal and greater, and only runs of
    equal ones go on with the next word. All runs of a depth are parted in one call.
    """
    order = np.argsort(words[:, 0], kind="stable")
    value = words[order, 0]
    run = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]])) if len(order) else np.zeros(0, np.int64)
    for depth in range(1, words.shape[1]):
        tied = np.bincount(run)[run] > 1
        places = np.flatnonzero(tied)
        if not len(places):
            break
        value = words[order[places], depth]
        by = np.lexsort([value, run[places]])
        order[places] = order[places][by]
        value, of = value[by], run[places]  # runs stay in their places
        differs = np.zeros(len(order), np.int64)
        differs[places[1:]] = (value[1:] != value[:-1]) & (of[1:] == of[:-1])
        run = np.cumsum(np.concatenate([[0], run[1:] != run[:-1]]) + differs)
    return order


def _padded(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``width`` bytes for each value, filled up with zeros, and the lengths."""
    data, ends = _bytes_of(values)
    sizes = np.diff(np.concatenate([[0], ends]))
    out = np.zeros((len(sizes), width), np.uint8)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(data)) - np.repeat(ends - sizes, sizes)] = data
    return out, sizes


def _common(sorted_rows: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the one before; -1 at the first."""
    out = np.full(len(sorted_rows), -1, np.int64)
    for at in range(1, len(sorted_rows), 1 << 16):
        differs = sorted_rows[at : at + (1 << 16)] != sorted_rows[at - 1 : min(len(sorted_rows), at + (1 << 16)) - 1]
        out[at : at + (1 << 16)] = np.where(differs.any(1), differs.argmax(1), sorted_rows.shape[1])
    return out


class Bucket:
    """A bucket of the suffix array: regions by the suffix from their anchor and the reversed text before it.

    ``by``: 0 if buckets part the suffixes, 1 if they part the reversed texts. ``least``: windows
    that begin nearer to the anchor than this are not looked at.
    """

    def __init__(self, suffix: pa.Array, before: pa.Array, length: int = LENGTH, by: int = 0, least: np.ndarray | int = 0):
        self.length, self.by = length, by
        (self.suffixes, sizes), (self.befores, self.most) = (_padded(x, -(-length // 8) * 8) for x in (suffix, before))
        self.least = np.maximum(length - sizes, least)  # windows begin from least to most bytes before the anchor
        self.sorted = [self._sorted(x) for x in (self.suffixes, self.befores)]

    @staticmethod
    def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = multikey_order(rows.view(">u8").astype(np.uint64))
        return order, _common(rows[order])

    def _runs(self, side: int, depth: int) -> np.ndarray:
        """For each region the number of its run, whose members have ``depth`` bytes in common."""
        order, common = self.sorted[side]
        out = np.zeros(len(order), np.int64)
        if depth:
            out[order] = np.cumsum(common < depth) - 1
        return out

    def windows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each distance d: (d, regions with such a window, how many share it, whether it is the first of these, whether it may go on in another bucket)."""
        for d in range(int(self.most.max(initial=-1)) + 1):
            own = np.flatnonzero((self.least <= d) & (d <= self.most))
            if not len(own):
                continue
            runs = self._runs(0, self.length - d), self._runs(1, d)
            _, first, which, count = np.unique(runs[0][own] * len(runs[0]) + runs[1][own], return_index=True, return_inverse=True, return_counts=True)
            is_first = np.zeros(len(own), bool)
            is_first[first] = True
            run, order = runs[self.by], self.sorted[self.by][0]
            yield d, own, count[which], is_first, (run[own] == run[order[0]]) | (run[own] == run[order[-1]])

    def window(self, i: int, d: int) -> bytes:
        return self.befores[i, :d][::-1].tobytes() + self.suffixes[i, : self.length - d].tobytes()


ASKED = "t0 long, t1 long, start long, single boolean, suffix binary, before binary, least long"
FOUND = "t0 long, t1 long, start long, windows long, w0 long, w1 long, copies long"


def _array(length: int, by: int):
    """Repeated windows as FOUND; windows of open runs from the first array as ASKED beside it, from the second with their digests."""
    names = [x.split()[0] for x in f"{FOUND}, single boolean, suffix binary, before binary, least long".split(", ")]
    kinds = dict.fromkeys(names, pa.int64()) | {"single": pa.bool_(), "suffix": pa.binary(), "before": pa.binary()}

    def made(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) if c in columns else pa.nulls(n, kinds[c]) for c in names], names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        table = pa.Table.from_batches(table).combine_chunks()
        t0, t1, start, single, least = (table.column(c).to_numpy() for c in ("t0", "t1", "start", "single", "least"))
        suffix, before = (pa.concat_arrays(table.column(c).chunks) for c in ("suffix", "before"))
        bucket = Bucket(suffix, before, length, by, least)
        repeats, asked = np.zeros((len(t0), length), bool), np.full(len(t0), length)
        for d, own, copies, is_first, is_open in bucket.windows():
            repeats[own, bucket.most[own] - d] = copies > 1
            sent = np.flatnonzero(is_open & is_first)
            i = own[sent]
            if by == 0:
                asked[i] = np.minimum(asked[i], d)
            elif len(i):
                digests = np.frombuffer(b"".join([blake2b(bucket.window(x, d), digest_size=16).digest() for x in i.tolist()]), np.int64).reshape(-1, 2)
                yield made(len(i), t0=t0[i], t1=t1[i], start=start[i] + bucket.most[i] - d, windows=np.where(single[i], 1, 0), w0=digests[:, 0], w1=digests[:, 1], copies=copies[sent])
        again = np.flatnonzero(asked < length)
        if len(again):
            at = pa.array(again)
            yield made(len(again), t0=t0[again], t1=t1[again], start=start[again], single=single[again], suffix=suffix.take(at), before=before.take(at), least=asked[again])
        repeats &= single[:, None]
        # runs of repeated windows
        edge = np.diff(np.pad(repeats, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, a = np.nonzero(edge > 0)
        _, b = np.nonzero(edge < 0)
        yield made(len(i), t0=t0[i], t1=t1[i], start=start[i] + a, windows=b - a)

    return task, ", ".join(f"{c} {'boolean' if c == 'single' else 'binary' if c in ('suffix', 'before') else 'long'}" for c in names)


def removed_runs(starts: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of bytes that the windows cover."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate((starts + windows + length - 1)[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], b[np.concatenate([new[1:], [True]])]


def _result(text: bytes, starts: np.ndarray, windows: np.ndarray, length: int) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and kept_sha256."""
    made, at, gone, n, text = sha256(), 0, 0, 0, memoryview(text)
    if len(starts):
        a, b = removed_runs(starts, windows, length)
        n, gone = len(a), int((b - a).sum())
        for x, y in zip(a.tolist(), b.tolist()):
            made.update(text[at:x])
            at = y
    made.update(text[at:])
    return len(text), gone, n, made.hexdigest()


def _unpacked(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor's distance, status)."""
    packed = marks >> 2
    return packed >> START_BITS, (packed >> 8) & 255, packed & 255, marks & 3


STAGED = "doc_id {id}, t0 long, t1 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text binary, marks array<long>, start long, single boolean, suffix binary, before binary"


def _settle(length: int, id_type: pa.DataType):
    """Results of texts without open questions; the other texts, and what is asked."""
    schema = pa.schema([("doc_id", id_type), *((c, pa.int64()) for c in ("t0", "t1", "n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string()), ("text", pa.binary()), ("marks", pa.list_(pa.int64())), ("start", pa.int64()), ("single", pa.bool_()), ("suffix", pa.binary()), ("before", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, times = None, 0
        for batch in batches:
            for a, b in slices(batch.column(3), SLICE):
                rows = []
                for doc, t0, t1, text, marks in zip(*(batch.column(c).slice(a, b - a) for c in range(5))):
                    text = text.as_py()
                    marks = marks.values.to_numpy() if marks.is_valid else np.zeros(0, np.int64)
                    start, n, at, status = _unpacked(marks)
                    if not (status > EQUAL).any():
                        rows.append({"doc_id": doc.as_py()} | dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), _result(text, start, n, length))))
                        continue
                    own = {"t0": t0.as_py(), "t1": t1.as_py()}
                    if (status == SINGLE).any():
                        rows.append({"doc_id": doc.as_py(), **own, "n_bytes": len(text), "text": text, "marks": marks[status != SINGLE]})
                    else:
                        rows.append({"doc_id": doc.as_py()} | dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), _result(text, start, n, length))))
                    times = times + 1 if last == own else 0
                    if times < 2:  # equal texts follow each other; two of them are enough to see that they repeat
                        for x, m, anchor, s in zip(start.tolist(), n.tolist(), at.tolist(), status.tolist()):
                            if s > EQUAL:
                                rows.append({**own, "start": x, "single": s == SINGLE, "suffix": text[x + anchor : x + m + length - 1], "before": text[x : x + anchor][::-1]})
                    last = own
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

    return task


def _finish(length: int):
    """Results of the texts with open questions, by what the array has found."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for text, marks, spans in zip(*(batch.column(c) for c in (1, 2, 3))):
                start, n, _, _ = _unpacked(marks.values.to_numpy())
                more = spans.values.to_numpy() if spans.is_valid else np.zeros(0, np.int64)
                rows.append(_result(text.as_py(), np.concatenate([start, more >> START_BITS]), np.concatenate([n, more & ((1 << START_BITS) - 1)]), length))
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return task


def _half(digest: Column, at: int) -> Column:
    """Sixteen hex digits as a long."""
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, token: int = TOKEN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``. ``length``: 255 at most, and no shorter than ``token``."""
    if not token <= length <= 255:
        raise ValueError("a repeat has from token to 255 bytes")
    id_type = docs.schema[id_col].dataType
    digest = F.md5("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
    rows = rows.select("doc_id", _half(digest, 1).alias("t0"), _half(digest, 17).alias("t1"), "text")
    spread = (F.xxhash64("doc_id") % 16384 + 16384).cast("long").alias("spread")
    found = rows.select("t0", "t1", spread, "text").mapInArrow(_regions_of(length, token), ", ".join(f"{c} long" for c in REGION))
    marks = found.repartitionByRange(*REGION).sortWithinPartitions(*REGION).mapInArrow(_sift, "t0 long, t1 long, mark long")
    marks = marks.groupBy("t0", "t1").agg(F.collect_set("mark").alias("marks"))  # equal texts have equal marks

    from pyspark.sql.pandas.types import to_arrow_type

    told = rows.join(marks, ["t0", "t1"], "left").select("doc_id", "t0", "t1", "text", "marks")
    staged = materialize(told.mapInArrow(_settle(length, to_arrow_type(id_type)), STAGED.format(id=id_type.simpleString())), "repeats")
    asked = staged.where("suffix is not null").select("t0", "t1", "start", "single", "suffix", "before", F.lit(0).cast("long").alias("least"))
    names = [x.split()[0] for x in ASKED.split(", ")]
    answers = materialize(asked.repartitionByRange("suffix", "before").mapInArrow(*_array(length, 0)), "suffixes")
    again = answers.where("suffix is not null").select(*names).repartitionByRange("before", "suffix").mapInArrow(*_array(length, 1))
    answers = answers.where("windows is not null").unionByName(materialize(again, "befores"))
    # windows at boundaries of both: a row a bucket and window at most
    place = F.when(F.col("windows") > 0, F.struct("t0", "t1", "start"))
    across = answers.where("w0 is not null").groupBy("w0", "w1").agg(F.sum("copies").alias("copies"), F.collect_list(place).alias("places")).where("copies > 1")
    across = across.select(F.explode("places").alias("p")).select("p.*", F.lit(1).cast("long").alias("windows"))
    inside = answers.where("w0 is null").select("t0", "t1", "start", "windows")
    spans = inside.unionByName(across).groupBy("t0", "t1").agg(F.collect_set(F.shiftleft("start", START_BITS).bitwiseOR(F.col("windows"))).alias("spans"))
    open_texts = staged.where("text is not null").select("doc_id", "t0", "t1", "text", "marks").join(spans, ["t0", "t1"], "left")
    names = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    rest = open_texts.select("doc_id", "text", "marks", "spans").mapInArrow(_finish(length), f"doc_id {id_type.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return staged.where("kept_sha256 is not null").select(*names).unionByName(rest)


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Windows of 200 bytes by their MD5, cut from hex in pieces so that no long text is walked again and again.
OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT r, n, unnest(range(0, n - 199, 256)) AS b, h FROM d WHERE n >= 200),
k AS (SELECT r, b, least(256, n - 199 - b) AS m, substr(h, 2 * b + 1, 910) AS s FROM c),
w AS (SELECT r, b + o AS p, md5_number(substr(s, 2 * o + 1, 400)) AS x FROM (SELECT r, b, s, unnest(range(0, m)) AS o FROM k)),
t AS (SELECT x FROM w GROUP BY x HAVING count(*) > 1),
g AS (SELECT r, p, CASE WHEN p <= lag(p) OVER q + 200 THEN 0 ELSE 1 END AS new FROM w JOIN t USING (x) WINDOW q AS (PARTITION BY r ORDER BY p)),
i AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS s FROM g),
u AS (SELECT r, s, min(p) AS a, max(p) + 200 AS z FROM i GROUP BY r, s),
e AS (SELECT r, a, z FROM u UNION ALL SELECT r, n, n FROM d),
f AS (SELECT e.r, a, z, substr(h, 2 * lag(z, 1, 0) OVER (PARTITION BY e.r ORDER BY a, z) + 1, 2 * (a - lag(z, 1, 0) OVER (PARTITION BY e.r ORDER BY a, z))) AS kept FROM e JOIN d USING (r)),
j AS (SELECT r, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans, sha256(unhex(string_agg(kept, '' ORDER BY a, z))) AS kept_sha256 FROM f GROUP BY r)
SELECT doc_id, n AS n_bytes, n_removed, n_spans, kept_sha256 FROM d JOIN j USING (r)
"""
