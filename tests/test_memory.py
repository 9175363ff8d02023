"""Memory by versions: writers that break off anywhere, readers under way, writers side by side, and a store that age bounds."""

import threading
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.sources import memory
from tidewell.sources.memory import Store

VEC = [0.6, 0.8]


def at(day):
    return F.lit(f"2024-01-{day:02d}").cast("timestamp")


def posts(spark, *ids, author="x"):
    return spark.createDataFrame([(i, VEC, author) for i in ids], "id string, vec array<double>, author string")


def ids(df):
    return sorted(r.id for r in df.collect())


class StopError(Exception):
    pass


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "memory"))
    s.remember(posts(spark, "a", "b"), at(10), "1")
    s.remember(posts(spark, "c"), at(12), "2")
    return s


class Breaking:
    """A file system or a context whose n-th call of these fails, before it is made or after."""

    def __init__(self, n, after):
        self.left, self.after = n, after

    def wrap(self, call):
        def run(*args, **named):
            self.left -= 1
            if self.left == 0 and not self.after:
                raise StopError
            out = call(*args, **named)
            if self.left == 0:
                raise StopError
            return out

        return run


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("work", ["compact", "remember"])
def test_a_write_that_stops_anywhere_loses_nothing(spark, store, monkeypatch, work, after):
    stopped = 0
    for n in range(1, 40):
        breaking = Breaking(n, after)
        with monkeypatch.context() as m:
            for name in ("_files", "_read", "_write", "_commit", "_versions", "folders", "vacuum"):
                m.setattr(store, name, breaking.wrap(getattr(store, name)))
            for name in ("delete", "filesystem"):
                m.setattr(memory, name, breaking.wrap(getattr(memory, name)))
            try:
                if work == "compact":
                    store.compact(at(13), timedelta(0))
                else:
                    store.remember(posts(spark, "c", author="again"), at(13), "3")
            except StopError:
                stopped += 1
        assert ids(store.rows()) == ["a", "b", "c"] and ids(store.recall(at(13))) == ["a", "b", "c"]
        if breaking.left > 0:
            break
    assert stopped >= 5
    store.compact(at(13), timedelta(0))
    assert ids(store.rows()) == ["a", "b", "c"] and len(store.folders()[1]) == 1
    assert {n for n, _ in store._files("rows")} == {store.folders()[1][0].path.rsplit("/", 1)[-1]} and store._files("drafts") == []


def test_readers_under_way_go_on(spark, store):
    reading, recalling = store.rows(), store.recall(at(13))
    store.compact(at(18))  # b and a have expired
    assert ids(store.rows()) == ["c"]
    assert ids(reading) == ids(recalling) == ["a", "b", "c"]
    store.vacuum(timedelta(0))
    assert ids(store.rows()) == ["c"] and len(store._versions()) == 1


def test_writers_side_by_side(spark, store):
    other = Store(spark, store.path)
    errors = []

    def write(s, k):
        try:
            for n in range(3):
                s.remember(posts(spark, f"{k}{n}"), at(13), f"{k}{n}")
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(s, k)) for s, k in ((store, "x"), (other, "y"))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and ids(store.rows()) == ["a", "b", "c", "x0", "x1", "x2", "y0", "y1", "y2"]


def test_a_commit_beaten_by_another_writer_starts_from_its_version(spark, store, monkeypatch):
    real, beaten = store.folders, []

    def late():
        found = real()
        if not beaten:
            beaten.append(1)
            Store(spark, store.path).remember(posts(spark, "d"), at(13), "d")
        return found

    monkeypatch.setattr(store, "folders", late)
    store.remember(posts(spark, "e"), at(13), "e")
    assert beaten and ids(store.rows()) == ["a", "b", "c", "d", "e"]


def test_age_bounds_the_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "aged"))
    for day in range(1, 31):
        store.remember(posts(spark, f"p{day:02d}"), at(day), str(day))
    assert len(store.folders()[1]) == 8 and ids(store.recall(at(30))) == [f"p{d}" for d in range(23, 31)]
    store.vacuum(timedelta(0))
    assert len(store._files("rows")) == 8 and len(store._versions()) == 1
    store.forget_all()
    assert store.count() == 0
