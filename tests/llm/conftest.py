from __future__ import annotations

import tempfile

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    """Tests have no cluster: a temporary folder stands for the shared one."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quillmend-tests-"))
