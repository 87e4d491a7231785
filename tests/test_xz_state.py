"""Lengths after a prefix that is read once, against the lzma module."""

import lzma
import random

import pytest

from prosegauge.operators import compression, xz_state

RNG = random.Random(4)
WORDS = ["".join(RNG.choices("abcdefghij", k=RNG.randrange(2, 9))) for _ in range(900)]


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n)).encode()


SEEDS = [b"", b"x", prose(3), prose(700), prose(8000), bytes(200_000), RNG.randbytes(30_000)]
TEXTS = [b"", b"a", b"abc", prose(20), prose(400), prose(9000), RNG.randbytes(70_000), "żółć 文字 \u0000".encode() * 50, b"ab" * 200_000, b"".join(b"item %d\n" % i for i in range(30_000)), prose(170_000)[:1_000_000]]


@pytest.mark.parametrize("seed", SEEDS, ids=[f"{i}-{len(s)}" for i, s in enumerate(SEEDS)])
def test_lengths_are_those_of_the_module(seed):
    encoder = xz_state._Encoder(seed)
    assert encoder.proves(seed)
    for text in [*TEXTS, *TEXTS[::-1], seed, seed[: len(seed) // 2]]:
        assert encoder.size(text) == len(lzma.compress(seed + text))
    assert not encoder.late


def test_seed_is_read_once(monkeypatch):
    seed, texts = prose(8000), [prose(300) for _ in range(5)]
    want = [len(lzma.compress(seed + t)) for t in texts]
    size = compression.sized(seed)
    monkeypatch.setattr(lzma, "compress", lambda data: pytest.fail("the seed is read again"))
    assert [size(t) for t in texts] == want


def test_module_serves_where_the_library_is_not_as_expected(monkeypatch):
    seed, text = prose(500), prose(100)
    want = len(lzma.compress(seed + text))
    monkeypatch.setattr(xz_state, "_places", lambda data: xz_state.np.zeros(1, "uint32"))
    assert xz_state.sizer(seed)(text) == want
    monkeypatch.setattr(xz_state, "_HASH", 4)
    assert xz_state.sizer(seed)(text) == want
    monkeypatch.setattr(xz_state.ctypes, "CDLL", lambda name: (_ for _ in ()).throw(OSError(name)))
    assert xz_state.sizer(seed)(text) == want
