from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from samples import frame, texts  # noqa: E402

from hazeline.llm import blobs  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture
def many_blocks(monkeypatch):
    """Small blocks, so that a small table has many blocks and buckets."""
    monkeypatch.setattr(blobs, "LEAST_BLOCK", 40_000)
