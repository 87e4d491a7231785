"""Spans that overlap, and contexts that reach over other matches."""

import pytest

from prosegauge.llm import pii


def test_overlapping_spans_are_masked_whole(texts):
    rows = texts("joe@mail.com-4041 8949 7460 8795", "see 1.2.3.4@host.org now", "a@b.c and 1.2.3.4", "a@b.c1.2.3.4 +1 (988) 555-2485")
    got = [r["text"] for r in sorted(pii.mask(rows).collect())]
    assert got == ["<EMAIL>", "see <EMAIL> now", "<EMAIL> and <IP>", "<EMAIL> <PHONE>"]
