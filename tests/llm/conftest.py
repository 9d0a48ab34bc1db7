import os

import pytest

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def tiny():
    """The folder of the smallest tables."""
    folder = f"{DATA}/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder


def components(ids, edges):
    """Brute force: the smallest id reachable from each."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
