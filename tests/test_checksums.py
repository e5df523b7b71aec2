"""Checksums: a sealed header sums to all ones, whatever it holds."""

from hypothesis import given, settings
from hypothesis import strategies as st

from skyledger.functions import checksum


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=80, max_size=80), max_size=34), st.integers(0, 2**32 - 1))
def test_sealed_headers_sum_to_all_ones(cards, data_sum):
    header = b"CHECKSUM= '0000000000000000'".ljust(80) + b"".join(cards) + b"END".ljust(80)
    header += b" " * (-len(header) % 2880)
    seal = checksum.sealed(header, data_sum)
    assert len(seal) == 16 and seal.isalnum() and seal.isascii()
    assert checksum.sum32(header[:11] + seal.encode() + header[27:], data_sum) == checksum.FULL


def test_published_and_odd_values():
    assert checksum.sum32(b"") == 0 and checksum.sum32(b"\xff\xff\xff\xff") == checksum.FULL and checksum.sum32(b"\x01") == 1 << 24
    # the example of the standard's appendix J, of a sum's complement
    assert checksum.encoded(checksum.FULL - 868229149) == "hcHjjc9ghcEghc9g"
    assert checksum.sealed(b" " * 2880) is None
