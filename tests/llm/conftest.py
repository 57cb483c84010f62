"""The small awkward tables as files."""

from __future__ import annotations

import pytest
from small_tables import corpus, save


@pytest.fixture(scope="session")
def tables():
    return corpus()


@pytest.fixture(scope="session")
def edge_dir(tables, tmp_path_factory):
    return save(tmp_path_factory.mktemp("edge"), tables)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return save(tmp_path_factory.mktemp("empty"), {k: [] for k in ("documents", "labels", "pages", "benchmark")})
