"""Queries side by side in one session: each has its own tables, and leaves nothing but its result."""

import os
from concurrent.futures import ThreadPoolExecutor

from tabulon import storage
from tabulon.llm import catalog

NAMES = ["op4_repeated_strings", "op8_simhash", "op10_chunk_store"]


def rows(spark, folder, name):
    return sorted(map(str, catalog.QUERIES[name](spark, folder).collect()))


def test_queries_at_once(spark, folder):
    alone = {name: rows(spark, folder, name) for name in NAMES}
    home = storage._home(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(home))
    with ThreadPoolExecutor(len(NAMES)) as pool:
        found = {name: pool.submit(rows, spark, folder, name) for name in NAMES}
        assert {name: f.result() for name, f in found.items()} == alone
    left = set(os.listdir(home)) - before
    assert len(left) == len(NAMES) and not any("-call-" in x for x in left)
