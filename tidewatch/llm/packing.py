"""Harmonic packing of tokenized documents into fixed-capacity sequences.

A piece of length t belongs to the reciprocal-capacity class k = capacity // t, and a bin of
class k holds exactly k pieces, so a bin closes after a fixed count and never overflows. Every
worker fills the bins of its own rows, which needs no shuffle and no shared state.

Documents may be cut, so padding is kept small by cutting: whole capacities first, then
``cut_sizes`` (divisors of the capacity, whose bins fill without a gap), then one tail shorter
than the smallest cut. Bins still open at the end of a task are joined end to end and cut at the
capacity, which leaves at most one unfilled sequence a task besides what tail bins round off.

Edge cases: a null or empty text is the single end token; repeated rows are packed as often as
they occur; a null id is carried along; an empty table gives no pieces. Columns other than the
id and the text are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, chunked, lean, slices, text_bytes
from .common import whole as _whole

CAPACITY = 2048
CUT_SIZES = (1024, 512, 256)
END_ID = 1
CACHE_WORDS = 150_000  # distinct words that a Python worker keeps encoded, across its tasks
ROWS, TOKENS = 8_000, 1 << 18  # pieces and tokens in an output batch, about
SLICE = 1 << 20  # bytes of text encoded at a time
#: Sequence ids are the task's number times this, plus the task's own count.
TASK_STRIDE = 1 << 33


#: The characters that byte-level tokenizers write bytes as.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


class WordEncoder:
    """Encodes whole texts by encoding each distinct white-space separated word once.

    For tokenizers that lower-case, split at white space and drop it: their ids of a text are
    those of its words in a row. Words are told apart, counted and looked up as Arrow columns;
    new words are encoded many in one call with a mark of one id between them. Words that hold
    the mark are encoded one by one, texts that may hold a special token's string as they are.

    Words of Latin letters alone are one piece to tokenizers that split by kind of character and
    map bytes to characters; they go straight to the model, past what aligns and splits texts. A
    probe of all these letters tells whether a tokenizer is of this kind.

    At most ``cache_words`` words stay known; beyond that those go that were not met again.
    """

    MARK = "`"
    STOPS = ".,;:!?"
    LETTERS = "a-zà-öø-ÿÀ-ÖØ-Þ"
    JOINED = 2048

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words = cache_words
        self.mark = self._whole(self.MARK)
        self.stop_ids = np.array([self._whole(c) for c in self.STOPS], np.uint32)[:, 0]
        self.model = self.tokenizer.model
        letters = [c for c in map(chr, range(256)) if re.fullmatch(f"[{self.LETTERS}]", c)]
        self.spelled = str.maketrans({c: "".join(_BYTE_CHARS[b] for b in c.lower().encode()) for c in letters})
        probes = [*letters, "".join(letters), "".join(reversed(letters))]
        self.direct = self._direct(probes) == [self._whole(w) for w in probes]
        self._keep(np.zeros(0, np.int64))

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _direct(self, words: list[str]) -> list[list[int]]:
        """Ids of words of ``LETTERS`` alone."""
        return [[x.id for x in self.model.tokenize(w.translate(self.spelled))] for w in words]

    def _keep(self, places: np.ndarray) -> None:
        """Forget all words but those at these places of the table."""
        if not len(places):
            self.known, self.used, self.size = {}, 0, 0
            self.flat = np.empty(1 << 16, np.uint32)
            self.starts, self.counts, self.met = (np.zeros(1 << 14, kind) for kind in (np.int64, np.int64, bool))
            return
        words, counts, flat = list(self.known), self.counts[places], self.ids_at(places)  # a word's place is its number in the order of the table
        words = [words[i] for i in places]
        self._keep(places[:0])
        self._add(words, counts, flat)

    def _add(self, words: list[str], counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Put words at the end of the table: their places."""
        size, used = self.size + len(words), self.used + len(ids)
        while used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while size > len(self.starts):
            self.starts, self.counts, self.met = (np.resize(x, 2 * len(x)) for x in (self.starts, self.counts, self.met))
        self.flat[self.used : used] = ids
        self.counts[self.size : size], self.starts[self.size : size] = counts, self.used + np.cumsum(counts) - counts
        self.met[self.size : size] = False
        self.known.update(zip(words, range(self.size, size)))
        first, self.size, self.used = self.size, size, used
        return np.arange(first, size)

    def ids_at(self, places: np.ndarray) -> np.ndarray:
        """The ids of the words at these places, in a row."""
        counts = self.counts[places]
        ends = np.cumsum(counts)
        return self.flat[np.repeat(self.starts[places] - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _places(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words in the table; those not yet known are learnt."""
        places = np.fromiter(map(self.known.get, words.to_pylist(), repeat(-1)), np.int64, len(words))
        new = places < 0
        self.met[places[~new]] = True
        if new.any():
            places[new] = self._learn(words.filter(pa.array(new)))
        return places

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Places of words that are not in the table. A stop after a plain letter or digit is a part of its own."""
        stopped = pc.match_substring_regex(words, f"[a-z0-9à-öø-ÿ][{self.STOPS}]$")
        plain = words.filter(pc.invert(stopped))
        order = [self._encoded(plain)]
        if len(plain) < len(words):
            with_stop = words.filter(stopped)
            body = pc.utf8_slice_codeunits(with_stop, 0, -1).dictionary_encode()
            bodies = self._places(body.dictionary)[body.indices.to_numpy()]
            stop = pc.index_in(pc.utf8_slice_codeunits(with_stop, -1), value_set=pa.array(list(self.STOPS))).to_numpy()
            counts = self.counts[bodies]
            ids = np.insert(self.ids_at(bodies), np.cumsum(counts), self.stop_ids[stop])
            order.append(self._add(with_stop.to_pylist(), counts + 1, ids))
        out = np.empty(len(words), np.int64)
        is_stopped = stopped.to_numpy(zero_copy_only=False)
        out[~is_stopped] = order[0]
        if len(order) > 1:
            out[is_stopped] = order[1]
        return out

    def _encoded(self, words: pa.Array) -> np.ndarray:
        """Encode words and add them: their places."""
        if self.direct:
            letters = pc.match_substring_regex(words, f"^[{self.LETTERS}]+$")
            if pc.any(letters).as_py():
                out, is_direct = np.empty(len(words), np.int64), letters.to_numpy(zero_copy_only=False)
                plain, rest = words.filter(letters), words.filter(pc.invert(letters))
                plain = plain.to_pylist()
                made = self._direct(plain)
                counts = np.fromiter(map(len, made), np.int64, len(made))
                out[is_direct] = self._add(plain, counts, np.fromiter(chain.from_iterable(made), np.uint32, int(counts.sum())))
                out[~is_direct] = self._split(rest)
                return out
        return self._split(words)

    def _split(self, words: pa.Array) -> np.ndarray:
        """Encode words by the whole tokenizer and add them: their places."""
        alone = pc.match_substring(words, self.MARK).to_numpy(zero_copy_only=False) if len(self.mark) == 1 else np.ones(len(words), bool)
        single, joined = np.flatnonzero(alone).tolist(), np.flatnonzero(~alone)
        texts, between = words.to_pylist(), f" {self.MARK} "
        parts = [joined[at : at + self.JOINED] for at in range(0, len(joined), self.JOINED)]
        order, counts, ids = [], [], []
        for part in parts:  # one call each: what the tokenizer returns is large
            row = np.array(self._batch([between.join([texts[i] for i in part])])[0], np.uint32)
            ends = np.flatnonzero(row == self.mark[0])
            if len(ends) != len(part) - 1:  # some word holds the mark in another spelling
                single += part.tolist()
                continue
            order.append(part)
            counts.append(np.diff(np.concatenate([[-1], ends, [len(row)]])) - 1)
            ids.append(np.delete(row, ends))
        if single:
            made = [x for at in range(0, len(single), self.JOINED) for x in self._batch([texts[i] for i in single[at : at + self.JOINED]])]
            order.append(np.array(single))
            counts.append(np.fromiter(map(len, made), np.int64, len(made)))
            ids += [np.array(x, np.uint32) for x in made]
        out = np.empty(len(words), np.int64)
        if order:
            order = np.concatenate(order)
            out[order] = self._add([texts[i] for i in order], np.concatenate(counts), np.concatenate(ids))
        return out

    def encode(self, texts: pa.Array | list[bytes]) -> list[np.ndarray]:
        texts = pa.array(texts, pa.binary()) if isinstance(texts, list) else texts
        texts = texts.cast(pa.string())
        plain = pc.invert(pc.match_substring(texts, "<|"))
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(plain, texts, "")))
        each = words.flatten().dictionary_encode()
        if self.size > self.cache_words:
            met = np.flatnonzero(self.met[: self.size])
            self._keep(met if len(met) <= self.cache_words else met[:0])
        own = self._places(each.dictionary)[each.indices.to_numpy()]
        ids = self.ids_at(own)
        ends = np.concatenate([[0], np.cumsum(self.counts[own])])[np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]
        out = np.split(ids, ends[:-1]) if len(texts) else []
        for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)):
            out[i] = np.array(self._whole(texts[int(i)].as_py()), np.uint32)
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """This process's encoder: the tasks that a worker runs one after another share what it has learnt."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cuts(n: int, capacity: int, cut_sizes: tuple[int, ...]) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    for size in cut_sizes:
        if rest >= size:
            out.append(size)
            rest -= size
    return out + [rest] * (rest > 0)


def _chunked(text: Column) -> Column:
    return chunked(text, CHUNK)


class Packer:
    """One task's bins. ``rows`` gets (document, start, ids, document tokens, sequence, offset)."""

    def __init__(self, capacity: int, cut_sizes: tuple[int, ...], first_sequence: int):
        self.capacity, self.cut_sizes, self.next = capacity, cut_sizes, first_sequence
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []
        self.tokens = 0  # in the rows

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids, total, self.next, at))
            at += len(ids)
        self.tokens += at
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        start = 0
        for length in cuts(len(ids), self.capacity, self.cut_sizes):
            k = self.capacity // length
            held = self.open.setdefault(k, [])
            # a copy, so that a waiting piece doesn't hold its document
            held.append((doc, start, ids[start : start + length].copy(), len(ids)))
            if len(held) == k:
                self._close(self.open.pop(k))
            start += length

    def finish(self) -> None:
        """Join the pieces of open bins end to end, cutting at the capacity."""
        current, room = [], self.capacity
        for k in sorted(self.open):
            for doc, start, ids, total in self.open[k]:
                while len(ids):
                    part = ids[:room]
                    current.append((doc, start, part, total))
                    start, ids, room = start + len(part), ids[len(part) :], room - len(part)
                    if not room:
                        self._close(current)
                        current, room = [], self.capacity
        if current:
            self._close(current)
        self.open = {}


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, cut_sizes: tuple[int, ...] = CUT_SIZES, end_id: int = END_ID) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""
    if any(capacity % c for c in cut_sizes) or list(cut_sizes) != sorted(cut_sizes, reverse=True):
        raise ValueError("cut sizes divide the capacity and descend")
    id_type = docs.schema[id_col].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, cut_sizes, TaskContext.get().partitionId() * TASK_STRIDE)
        encoder = encoder_of(tokenizer_path)
        end = np.array([end_id], np.uint32)

        def taken(id_kind: pa.DataType) -> pa.RecordBatch:
            rows, packer.rows, packer.tokens = packer.rows, [], 0
            doc, start, ids, total, sequence, offset = zip(*rows)
            longs = lambda x: pa.array(x, pa.int64())
            columns = [pa.array(doc, id_kind), longs(start), longs([len(x) for x in ids]), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), longs(total), longs(sequence), longs(offset)]
            return pa.RecordBatch.from_arrays(columns, names)

        kind = None
        for doc_ids, texts in _whole(batches):
            kind = doc_ids.type
            for at, to in slices(texts, SLICE):
                for doc, ids in zip(doc_ids[at:to].to_pylist(), encoder.encode(texts.slice(at, to - at))):
                    packer.add(doc, np.concatenate([ids, end]))
                    if len(packer.rows) >= ROWS or packer.tokens >= TOKENS:
                        yield taken(kind)
            doc_ids = texts = ids = None  # not held while the next batch comes
            pa.default_memory_pool().release_unused()
        packer.finish()
        if packer.rows:
            yield taken(kind)

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = f"doc_id {id_type.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long"
    rows = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
    return rows.select("doc_id", F.posexplode(_chunked(F.col("text"))).alias("number", "part")).mapInArrow(lean(task), schema)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()))
