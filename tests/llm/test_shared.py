import weakref

import numpy as np
import pytest

from larkspur.llm import shared


@pytest.mark.parametrize("arguments", [1, 2, 3])
def test_memory_is_given_back_once_a_groups_arrays_are_freed(arguments, monkeypatch):
    arrays, alive = [], []
    monkeypatch.setattr(shared, "give_back", lambda: alive.append(arrays[-1]() is not None))

    def used():
        large = np.ones(1 << 17)
        arrays.append(weakref.ref(large))
        return [len(large)]

    def batches(rows):
        large = np.ones(1 << 17)
        arrays.append(weakref.ref(large))
        yield len(large)

    run = {1: batches, 2: lambda key, table: used(), 3: lambda key, left, right: used()}[arguments]
    assert list(shared.giving_back(run)(*[None] * arguments)) == [1 << 17]
    assert alive == [False]
