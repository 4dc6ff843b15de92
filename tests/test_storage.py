"""Tables in the shared folder: each call has its own, and none stays after an error."""

import os
import threading

import pytest

from tabulon import storage


def names(spark):
    home = storage._home(spark).removeprefix("file:").replace("//", "/")
    return set(os.listdir(home)) if os.path.isdir(home) else set()


def test_calls_at_once_keep_their_own_tables(spark):
    """A call that ends first takes nothing from those still under way."""
    entered, first_done, failed = threading.Barrier(2), threading.Event(), []

    def slow():
        def make():
            inner = storage.stored(spark.range(5), "inner")
            entered.wait(30)
            first_done.wait(30)
            return inner.selectExpr("id * 2 AS twice")

        try:
            assert sorted(r.twice for r in storage.settled(spark, "slow", make).collect()) == [0, 2, 4, 6, 8]
        except BaseException as e:  # noqa: BLE001
            failed.append(e)

    def quick():
        def make():
            entered.wait(30)
            return storage.stored(spark.range(3), "inner")

        try:
            assert storage.settled(spark, "quick", make).count() == 3
        except BaseException as e:  # noqa: BLE001
            failed.append(e)
        first_done.set()

    threads = [threading.Thread(target=f) for f in (slow, quick)]
    before = names(spark)
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert not failed
    assert sorted(x.split("-")[0] for x in names(spark) - before) == ["quick", "slow"]


def test_nothing_stays_after_an_error(spark):
    def make():
        storage.stored(spark.range(5), "inner")
        storage.settled(spark, "deeper", lambda: storage.stored(spark.range(2), "inner"))
        raise RuntimeError("no rows")

    before = names(spark)
    with pytest.raises(RuntimeError):
        storage.settled(spark, "failing", make)
    assert names(spark) == before


def test_release(spark):
    storage.stored(spark.range(1), "one")
    assert names(spark)
    storage.release(spark)
    assert not names(spark)
    assert storage.stored(spark.range(1), "one").count() == 1
