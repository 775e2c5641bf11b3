import zlib

import pytest


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture
def lower():
    return lowered


@pytest.fixture
def crc():
    return lambda i: zlib.crc32(str(i).encode())
