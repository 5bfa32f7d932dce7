"""Maximal generalised parent sets by the pruned walk."""

import math
import time
from itertools import product

import pytest

from tabloom.operators.generate import Taxonomy, parent_sets


def brute(columns, tax, cells):
    options = [[None, *range(tax.depth(c))] for c in columns]
    size = lambda combo: math.prod(tax.width(c, lv) for c, lv in zip(columns, combo) if lv is not None)
    ok = {x for x in product(*options) if size(x) <= cells}

    def finer(x):
        for i, lv in enumerate(x):
            below = tax.depth(columns[i]) - 1 if lv is None else lv - 1
            if below >= 0:
                yield (*x[:i], below, *x[i + 1:])

    return {frozenset((c, lv) for c, lv in zip(columns, x) if lv is not None) for x in ok if not any(y in ok for y in finer(x))}


@pytest.mark.parametrize("cells", [1, 2, 7.5, 40, 300, 1e6])
def test_walk_finds_the_sets_that_nothing_refines(cells):
    tax = Taxonomy({"a": 16, "b": 5, "c": 25, "d": 3, "e": 4}, {"a"})
    got = parent_sets(list("abcde"), tax, cells)
    assert len(got) == len(set(got)) and {frozenset(x) for x in got} == brute(list("abcde"), tax, cells)


def test_thirty_columns_finish():
    columns = [f"c{i}" for i in range(30)]
    tax = Taxonomy({c: 16 if i % 2 else 12 for i, c in enumerate(columns)}, {c for i, c in enumerate(columns) if i % 2})
    start = time.time()
    got = parent_sets(columns, tax, 12.0)
    assert got and time.time() - start < 20
    assert all(math.prod(tax.width(c, lv) for c, lv in x) <= 12 for x in got)
    assert parent_sets(columns, tax, 0.5) == [] or parent_sets(columns, tax, 0.5) == [()]
