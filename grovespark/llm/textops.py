"""Vectorised text primitives: words, hashes and counts of a whole Arrow batch with numpy.

Texts are handled as UTF-8 bytes. A batch is cut into slices of whole texts of
about ``SLICE`` bytes, so that working arrays stay in cache; one text longer
than that is a slice of its own, never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_U = np.uint64
_P, _PINV = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

pa.set_memory_pool(pa.system_memory_pool())

Batches = Iterator[pa.RecordBatch]


def trimmed(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same work on batches; at its end the Python worker, which later tasks use again, gives back the memory it freed."""

    def run(batches: Batches) -> Batches:
        yield from work(batches)
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return run


def roomy(most: int = 4 << 20) -> None:
    """Have this worker keep freed arrays of up to ``most`` bytes for the next ones, until its task ends: new pages cost more than the sums in them."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, most)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, most)  # M_TRIM_THRESHOLD


WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U))
_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE + 2)
        for k, base in enumerate((_P, _PINV)):
            x = np.full(size, base, _U)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=_U)
    return _powers[0], _powers[1]


class Slice:
    """Whole texts ``lo..hi`` of a batch: ``data`` bytes and ``offs`` (their starts, and the end)."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offs: np.ndarray):
        self.lo, self.hi, self.data, self.offs = lo, hi, data, offs

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def words(self, lower: bool = False) -> "Words":
        return Words(self, lower)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice: byte ranges, text of each, counts by text, 64-bit hashes."""

    def __init__(self, s: Slice, lower: bool):
        self.s, self.data = s, LOWER[s.data] if lower else s.data
        self.solid = ~WHITE[s.data]
        first = np.zeros(len(s.data) + 1, bool)
        first[s.offs] = True
        begin = self.solid.copy()
        begin[1:] &= ~self.solid[:-1] | first[1:-1]
        self.starts = np.flatnonzero(begin)
        end = self.solid.copy()
        end[:-1] &= ~self.solid[1:] | first[1:-1]
        self.ends = np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, s.offs)  # words lo..hi of each text
        self.counts = np.diff(self.bounds)
        self._total: np.ndarray | None = None

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.s.n), self.counts)

    def hashes(self) -> np.ndarray:
        """Of the bytes of each word; equal words have equal hashes wherever they stand."""
        return self.range_hashes(self.starts, self.ends)

    def range_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(self.data)
        up, down = powers(n)
        if self._total is None:
            self._total = np.zeros(n + 1, _U)
            np.cumsum(_BYTE[self.data] * up[:n], out=self._total[1:])
        return mix((self._total[ends] - self._total[starts]) * down[starts] + (ends - starts).astype(_U))

    def runs(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of ``k`` words inside one text: hashes, index of their first word, runs by text."""
        n = len(hashes)
        many = np.maximum(self.counts - (k - 1), 0)
        at = np.arange(int(many.sum())) + np.repeat(self.bounds[:-1] - (np.cumsum(many) - many), many)
        out = np.zeros(len(at), _U)
        if n:
            for j in range(k):
                out = out * _U(0xD6E8FEB86659FD93) + hashes[at + j]
        return mix(out), at, many


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[Slice]:
    """Cut a string column into slices of whole texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    offs = np.frombuffer(where, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield Slice(lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def strings(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def longs(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for null) and null flags of an integer column."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), np.asarray(col.is_null())


def blobs(batch: pa.RecordBatch, name: str, kind) -> list[np.ndarray]:
    """A binary column as arrays that share its buffer."""
    return [np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind) for x in batch.column(batch.schema.get_field_index(name))]


def table_rows(values: np.ndarray, blocks: int) -> pa.RecordBatch:
    """A dense table as rows (block, part) to be summed by :func:`grovespark.llm.frames.summed`."""
    parts = np.array_split(values.reshape(-1), blocks)
    return pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "part"])
