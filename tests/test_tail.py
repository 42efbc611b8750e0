"""Following log files: growth, half-written lines, truncation in place, moves, oversized lines and restarts."""

import os
import random

import pytest

from sentrymill.streaming import tail


def rows(follower, start, end):
    got = []
    for p in follower.partitions(start, end):
        for b in follower.read(p):
            got += b.to_pylist()
    return got


class Steps:
    """One follower and what each step reads."""

    def __init__(self, path, **options):
        self.f, self.at = tail.Follower({"path": str(path), **options}), {}

    def __call__(self):
        end = self.f.latestOffset()
        got = rows(self.f, self.at, end)
        self.at = end
        return [None if r["oversized"] else r["value"] for r in got]


def test_growth_and_half_lines(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("one\ntwo\nthr")
    step = Steps(log)
    assert step() == ["one", "two"] and step() == []
    with log.open("a") as f:
        f.write("ee\n\n  \nfour")
    assert step() == ["three"] and step() == []
    with log.open("a") as f:
        f.write("\n")
    assert step() == ["four"]


def test_cut_to_nothing_in_place(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("".join(f"old {i}\n" for i in range(100)))
    step = Steps(log)
    assert len(step()) == 100
    inode = os.stat(log).st_ino
    with log.open("r+") as f:  # shorter than before
        f.truncate(0)
        f.write("new\n")
    assert os.stat(log).st_ino == inode and step() == ["new"]
    with log.open("r+") as f:  # longer than before, other first bytes
        f.truncate(0)
        f.write("".join(f"other {i}\n" for i in range(300)))
    assert len(step()) == 300


def test_moved_away_with_unread_lines(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("one\n")
    step = Steps(log)
    assert step() == ["one"]
    with log.open("a") as f:
        f.write("two\nlast without a break")
    log.rename(tmp_path / "a.log.1")
    log.write_text("fresh\n")
    assert step() == ["two", "last without a break", "fresh"]
    log.rename(tmp_path / "elsewhere")
    log.write_text("again\n")
    assert step() == ["again"]


def test_moved_away_while_a_batch_runs(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("one\ntwo\n")
    f = tail.Follower({"path": str(log)})
    end = f.latestOffset()
    planned = f.partitions({}, end)
    log.rename(tmp_path / "a.log.1")
    assert [r["value"] for p in planned for b in f.read(p) for r in b.to_pylist()] == ["one", "two"]
    (tmp_path / "a.log.1").rename(tmp_path / "gone")
    with pytest.raises(FileNotFoundError):
        [list(f.read(p)) for p in planned]


def test_oversized_lines(tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"a\n" + b"x" * 300_000 + b"\nb\n" + b"y" * 200_000)
    step = Steps(log, linecap=1000)
    assert step() == ["a", None, "b"] and step() == []
    with log.open("ab") as f:
        f.write(b"y\nc\n")
    assert step() == [None, "c"]


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_pieces_hold_every_line_once(tmp_path, split):
    rng = random.Random(split)
    want = ["".join(rng.choice("abé ") for _ in range(rng.randrange(1, 40))) + "." for _ in range(400)]
    log = tmp_path / "a.log"
    log.write_text("\n".join(want) + "\nhalf")
    f = tail.Follower({"path": str(log), "splitbytes": split, "linecap": 1000})
    got = rows(f, {}, f.latestOffset())
    assert sorted(r["start"] for r in got) == [r["start"] for r in got] and [r["value"] for r in got] == want


def test_missing_and_empty_files(tmp_path):
    step = Steps(tmp_path / "*.log")
    assert step() == []
    (tmp_path / "a.log").write_text("")
    (tmp_path / "b.log").write_bytes(b"\xff\xfe bad\nx\0y\n")
    assert step() == ["�� bad", "x\0y"]


def test_stream_restarts_where_it_was(spark, tmp_path):
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    logs.mkdir()

    def run():
        q = tail.follow(spark, str(logs / "*.log")).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        return sorted((os.path.basename(r["path"]), r["value"]) for r in spark.read.parquet(out).collect())

    (logs / "a.log").write_text("a1\na2\nhal")
    (logs / "b.log").write_text("b1\n")
    assert run() == [("a.log", "a1"), ("a.log", "a2"), ("b.log", "b1")]
    with (logs / "a.log").open("a") as f:
        f.write("f\n")
    (logs / "c.log").write_text("c1\n")
    assert run() == [("a.log", "a1"), ("a.log", "a2"), ("a.log", "half"), ("b.log", "b1"), ("c.log", "c1")]
    assert len(run()) == 5
