"""Columns of like values are not parted at their own letters or digits."""

import pytest

from lakewright.functions.documents import csv_rows


@pytest.mark.parametrize("value", ["1", "11", "7 1", "x1"])
def test_one_column_of_like_values_keeps_its_rows(value):
    rows = list(csv_rows("a\n" + f"{value}\n" * 5000))
    assert [number for _, number, _ in rows] == list(range(1, 5002)) and "".join(rows[-1][2]).replace(" ", "") == value.replace(" ", "")


@pytest.mark.parametrize("mark", [",", ";", "\t", "|", ":", " "])
def test_columns_are_parted_at_marks(mark):
    assert list(csv_rows(f"a{mark}b\n" + f"1{mark}2\n" * 50))[-1] == ("csv", 51, ["1", "2"])
