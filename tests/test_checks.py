"""Every registered check equals its SQL twin; every inventory row has a check."""

import re

import pytest

from checks.catalog import ORACLES, QUERIES
from checks.compare import compare, database

SIZES = {"a": 15, "b": 25, "c": 9, "d": 24, "e": 11, "f": 23, "g": 11, "h": 3, "i": 21, "j": 9}


@pytest.fixture(scope="module")
def con(folder):
    return database(folder)


def test_every_inventory_row_is_registered():
    found = {m.group(1) for name in QUERIES if (m := re.match(r"([a-j]\d\d)_", name))}
    wanted = {f"{letter}{n:02d}" for letter, size in SIZES.items() for n in range(1, size + 1)}
    assert wanted - found == set()


def test_every_check_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_check(spark, con, folder, name):
    same, detail = compare(spark, con, name, folder)
    assert same, detail
