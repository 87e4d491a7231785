"""How long xz makes a text after a fixed prefix, without reading the prefix again.

Python's lzma module can't go back to an encoder's state. liblzma can be made to: it takes
its memory from an allocator that the caller names, so an encoder that has read the prefix
is set back by copying its blocks. The three large ones are not copied whole: of the window
and of the tree only what the prefix has filled is ever read, and of the hash table only the
places of the text's own bytes have changed, which are written back. Those places follow from
liblzma's match finder (bt4); ``sizer`` checks on random bytes that nothing else in the table
changes, and takes the lzma module where that, or the library, is not as expected. The lengths
are those of ``lzma.compress`` in any case.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import lzma
import random
import zlib
from collections.abc import Callable

import numpy as np

_ALLOC = ctypes.CFUNCTYPE(ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t, ctypes.c_size_t)
_FREE = ctypes.CFUNCTYPE(None, ctypes.c_void_p, ctypes.c_void_p)
_RUN, _FINISH, _OK, _END, _CRC64 = 0, 3, 0, 1, 4
#: Of xz's default preset: bytes of its dictionary, and entries of the hash tables of 2, 3 and 4 bytes.
_PRESET, _DICT = 6, 1 << 23
_HASH2, _HASH3, _HASH4 = 1 << 10, 1 << 16, 1 << 22
_HASH, _TREE, _LARGE = 4 * (_HASH2 + _HASH3 + _HASH4), 8 * (_DICT + 1), 1 << 22
#: What the encoder may leave unread at the end of a prefix, more or less; and the most bytes of prefix and text that the window holds without moving.
_AHEAD, MOST = 5120, 6_000_000
_PAGE, _HUGEPAGE = 1 << 21, 14


class _Allocator(ctypes.Structure):
    _fields_ = [("alloc", _ALLOC), ("free", _FREE), ("opaque", ctypes.c_void_p)]


class _Stream(ctypes.Structure):
    _fields_ = [
        ("next_in", ctypes.c_void_p), ("avail_in", ctypes.c_size_t), ("total_in", ctypes.c_uint64),
        ("next_out", ctypes.c_void_p), ("avail_out", ctypes.c_size_t), ("total_out", ctypes.c_uint64),
        ("allocator", ctypes.POINTER(_Allocator)), ("internal", ctypes.c_void_p),
        ("reserved_p", ctypes.c_void_p * 4), ("seek_pos", ctypes.c_uint64), ("reserved_i", ctypes.c_uint64), ("reserved_s", ctypes.c_size_t * 2), ("reserved_e", ctypes.c_int * 2),
    ]


#: As liblzma's table: the CRC32 of each byte without the inversions at both ends.
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def _places(data: bytes) -> np.ndarray:
    """The entries of the hash tables that reading ``data`` changes."""
    c = np.frombuffer(data, np.uint8).astype(np.uint32)
    two = _CRC[c[:-3]] ^ c[1:-2]
    three = two ^ (c[2:-1] << np.uint32(8))
    four = three ^ (_CRC[c[3:]] << np.uint32(5))
    return np.concatenate([two & np.uint32(_HASH2 - 1), (three & np.uint32(_HASH3 - 1)) + np.uint32(_HASH2), (four & np.uint32(_HASH4 - 1)) + np.uint32(_HASH2 + _HASH3)])


class _Encoder:
    """An encoder that has read ``prefix``, and is there again after each text."""

    def __init__(self, prefix: bytes):
        self.lib = ctypes.CDLL(ctypes.util.find_library("lzma") or "liblzma.so.5")
        self.libc = ctypes.CDLL(None)
        self.libc.calloc.restype, self.libc.calloc.argtypes = ctypes.c_void_p, [ctypes.c_size_t, ctypes.c_size_t]
        self.libc.aligned_alloc.restype, self.libc.aligned_alloc.argtypes = ctypes.c_void_p, [ctypes.c_size_t, ctypes.c_size_t]
        self.libc.madvise.argtypes = [ctypes.c_void_p, ctypes.c_size_t, ctypes.c_int]
        self.libc.free.argtypes = [ctypes.c_void_p]
        self.lib.lzma_code.argtypes = [ctypes.POINTER(_Stream), ctypes.c_int]
        self.lib.lzma_easy_encoder.argtypes = [ctypes.POINTER(_Stream), ctypes.c_uint32, ctypes.c_int]
        self.blocks: dict[int, int] = {}
        self.late: list[int] = []
        self.started = False
        self.allocator = _Allocator(_ALLOC(self._alloc), _FREE(self._free), None)
        self.stream = _Stream(allocator=ctypes.pointer(self.allocator))
        self.out = ctypes.create_string_buffer(1 << 16)
        if self.lib.lzma_easy_encoder(self.stream, _PRESET, _CRC64) != _OK:
            raise OSError("no encoder")
        self._feed(prefix, _RUN, _OK)
        self.started = True
        self._keep(prefix)

    def _alloc(self, _opaque, n: int, size: int) -> int | None:
        if n * size < _LARGE:
            at = self.libc.calloc(n, size)
        elif at := self.libc.aligned_alloc(_PAGE, whole := -(-n * size // _PAGE) * _PAGE):
            self.libc.madvise(at, whole, _HUGEPAGE)  # reads and writes are all over the table; liblzma clears what it needs cleared
        if at and self.started:
            self.late.append(at)
        elif at:
            self.blocks[at] = n * size
        return at

    def _free(self, _opaque, at: int | None) -> None:
        if at and not self.started:  # later, what the state holds stays, and what came after it goes with the next restore
            self.blocks.pop(at, None)
            self.libc.free(at)

    def _feed(self, data: bytes, action: int, last: int) -> None:
        s = self.stream
        buffer = ctypes.c_char_p(data)
        s.next_in, s.avail_in = ctypes.cast(buffer, ctypes.c_void_p).value, len(data)
        while True:
            s.next_out, s.avail_out = ctypes.addressof(self.out), len(self.out)
            got = self.lib.lzma_code(s, action)
            if got not in (_OK, last):
                raise OSError(f"liblzma says {got}")
            if got == last and (last == _END or (not s.avail_in and s.avail_out)):
                return

    def _view(self, at: int, size: int) -> np.ndarray:
        return np.ctypeslib.as_array((ctypes.c_uint8 * size).from_address(at))

    def _keep(self, prefix: bytes) -> None:
        large = {at: n for at, n in self.blocks.items() if n >= _LARGE}
        tables = [at for at, n in large.items() if n == _HASH]
        trees = [at for at, n in large.items() if n == _TREE]
        if len(large) != 3 or len(tables) != 1 or len(trees) != 1:
            raise OSError("another layout")
        used = {at: n for at, n in self.blocks.items() if n < _LARGE}
        used |= {at: min(n, 8 * len(prefix) + 64 if n == _TREE else len(prefix) + 64) for at, n in large.items() if n != _HASH}
        self.kept = [(live := self._view(at, n), live.copy()) for at, n in used.items()]
        self.table = self._view(tables[0], _HASH).view(np.uint32)
        self.saved = np.zeros(len(self.table), np.uint32)
        filled = np.flatnonzero(self.table)
        self.saved[filled] = self.table[filled]
        self.tail = prefix[-3:]
        self.ahead = np.unique(_places(prefix[-_AHEAD:])) if len(prefix) > 3 else np.zeros(0, np.uint32)
        self.ahead_saved = self.saved[self.ahead]
        self.state = bytes(self.stream)

    def restore(self, data: bytes) -> None:
        for live, kept in self.kept:
            live[:] = kept
        self.table[self.ahead] = self.ahead_saved
        if len(changed := self.tail + data) > 3:
            at = _places(changed)
            self.table[at] = self.saved[at]
        ctypes.memmove(ctypes.addressof(self.stream), self.state, len(self.state))
        for at in self.late:
            self.libc.free(at)
        self.late.clear()

    def size(self, data: bytes) -> int:
        self._feed(data, _FINISH, _END)
        total = self.stream.total_out
        self.restore(data)
        return total

    def proves(self, prefix: bytes) -> bool:
        """Whether the state is as before after random bytes, and lengths are the module's."""
        rng = random.Random(1)
        probes = [rng.randbytes(50_000), prefix[: 1 << 15] + rng.randbytes(500), b"", b"a", b"abc" * 20_000, rng.randbytes(3)]
        return all(self.size(p) == len(lzma.compress(prefix + p)) and np.array_equal(self.table, self.saved) for p in probes)

    def close(self) -> None:
        self.kept, self.table = [], None
        for at in [*self.blocks, *self.late]:
            self.libc.free(at)
        self.blocks, self.late = {}, []

    def __del__(self):
        if hasattr(self, "late"):
            self.close()


def plain(prefix: bytes) -> Callable[[bytes], int]:
    return lambda data: len(lzma.compress(prefix + data))


def sizer(prefix: bytes) -> Callable[[bytes], int]:
    """A function of a text: ``len(lzma.compress(prefix + text))``."""
    slow = plain(prefix)
    try:
        encoder = _Encoder(prefix)
        if not encoder.proves(prefix):
            return slow
    except (OSError, AttributeError):
        return slow
    return lambda data: encoder.size(data) if len(prefix) + len(data) <= MOST else slow(data)
