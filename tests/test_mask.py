import pytest

from lexaspan.functions.mask import SeedMask, is_valid_mask
from lexaspan.functions.symbols import successor
from lexaspan.operators.corpus import BuildOptions
from lexaspan.operators.listing import parse_ranks


@pytest.mark.parametrize("mask", ["101", "1001", "1101", "10101"])
def test_valid_masks(mask):
    assert is_valid_mask(mask) and str(SeedMask(mask)) == mask


@pytest.mark.parametrize("mask", ["", "abc", "1", "11", "111", "0", "00", "0111", "11100", "1a01", "0101", "1010", "1021", "1111"])
def test_invalid_masks(mask):
    assert not is_valid_mask(mask)
    with pytest.raises(ValueError):
        SeedMask(mask)


def test_mask_facts():
    m = SeedMask("110110101")
    assert (m.positions, m.differences, m.weight, m.span) == ([0, 1, 3, 4, 6, 8], [0, 0, 1, 1, 2, 3], 6, 9)
    assert SeedMask.from_bytes(bytes([1, 0, 1])).mask == "101"
    assert m.runs() == [(0, 2), (3, 2), (6, 1), (8, 1)]


@pytest.mark.parametrize("mask, spans", [("101", [0, 2, 3]), ("11011", [0, 1, 3, 4, 5]), ("10011001", [0, 3, 4, 7, 8])])
def test_span_of_common_symbols(mask, spans):
    assert [SeedMask(mask).span_of(i) for i in range(len(spans))] == spans


def test_projection():
    m = SeedMask("11011")
    assert m.project("ABCDEFG") == "ABDE" and m.project("ABCD", 2) == "AB" and m.project("ABC") == "AB" and m.project("") == ""


def test_rank_lists():
    assert parse_ranks("0") == [0] and parse_ranks("1,3-5") == [1, 3, 4, 5]
    for bad in ("+1", "-1", "", "a", "3-3", "5-2", "1-2-3", "1,,2"):
        with pytest.raises(ValueError):
            parse_ranks(bad)


def test_options_exclude_each_other():
    with pytest.raises(ValueError):
        BuildOptions(max_query_len=3, seed_mask="101")
    with pytest.raises(ValueError):
        BuildOptions(delimiter="%%")


def test_successor():
    assert successor(b"AB") == b"AC" and successor(b"A\xff") == b"B" and successor(b"\xff") is None and successor(b"") is None
