"""Decoding of files without a byte-order mark."""

import pytest

from ledgerloom.sources.files import decoded

TEXT = "Café in Göteborg, 3 € each\nand more"


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16-le", "utf-16-be"])
def test_unmarked_files(encoding):
    assert decoded(TEXT.encode(encoding)) == TEXT


def test_even_orders_stay_little_endian():
    assert decoded(b"\xff\x00\x00\xff") == "\xff＀"
