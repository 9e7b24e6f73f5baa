"""A store brought up to date from files that come, change and go."""

import os
import time

import pytest
from pyspark.sql import functions as F

from strandlake.sources import store as S


def held(store, version=None):
    out = {}
    for r in store.rows(version).collect():
        out.setdefault(os.path.basename(r.path), []).append(r.line)
    return {k: sorted(v) for k, v in out.items()}


def test_store(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    read = []

    def lines(s, paths):
        read.append(sorted(os.path.basename(p) for p in paths))
        return S.lines(s, paths)

    store = S.Store(spark, f"{tmp_path}/store", lines)
    assert store.version() == 0 and store.files().count() == 0
    (folder / "a.txt").write_text("1\n2\n")
    (folder / "deep" / "b c+d.txt").write_text("3\n")
    (folder / "skip.csv").write_text("no\n")
    assert store.update(str(folder), "*.txt") == S.Update(1, 2, 0, 0, 0)
    assert held(store) == {"a.txt": ["1", "2"], "b c+d.txt": ["3"]}
    assert store.update(str(folder), "*.txt") == S.Update(2, 0, 0, 0, 2)
    # one changes, one goes, one comes; only what changed or came is read
    time.sleep(1.1)
    (folder / "a.txt").write_text("1\n9\n")
    (folder / "deep" / "b c+d.txt").unlink()
    (folder / "e.txt").write_text("")  # of no byte, so not listed
    (folder / "f.txt").write_text("5")
    assert store.update(str(folder), "*.txt") == S.Update(3, 1, 1, 1, 0)
    assert held(store) == {"a.txt": ["1", "9"], "f.txt": ["5"]}
    assert held(store, 1) == {"a.txt": ["1", "2"], "b c+d.txt": ["3"]}  # older versions can still be read
    assert read == [["a.txt", "b c+d.txt"], ["a.txt", "f.txt"]]
    # few at a time: the others wait, as they were
    time.sleep(1.1)
    for n in ("a", "f", "g"):
        (folder / f"{n}.txt").write_text(n)
        os.utime(folder / f"{n}.txt", (2_000_000_000 + ord(n), 2_000_000_000 + ord(n)))
    assert store.update(str(folder), "*.txt", most=1) == S.Update(4, 1, 2, 0, 0)
    assert held(store) == {"a.txt": ["a"], "f.txt": ["5"]}
    store.update(str(folder), "*.txt")
    assert held(store) == {"a.txt": ["a"], "f.txt": ["f"], "g.txt": ["g"]}


def test_updates_that_fail_or_meet(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("1\n")

    def broken(s, paths):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        S.Store(spark, f"{tmp_path}/store", broken).update(str(folder))
    store = S.Store(spark, f"{tmp_path}/store", S.lines)
    assert store.version() == 0

    def slow(s, paths):
        store.update(str(folder))  # another update is done meanwhile
        return S.lines(s, paths).withColumn("line", F.lit("late"))

    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        S.Store(spark, f"{tmp_path}/store", slow).update(str(folder))
    assert store.version() == 1 and held(store) == {"a.txt": ["1"]}
