"""The live roll-up against a batch build: restarts, repeats, many names, idle addresses, and a start from what is stored."""

import random
from collections import Counter
from datetime import datetime, timedelta

from sentrymill.streaming.journal_state import Live

SCHEMA = "ts timestamp, kind string, src_ip string, src_port int, username string, raw string"


def event(i, ip, user, raw=None):
    return (datetime(2026, 7, 22, 8) + timedelta(seconds=i), "failed_password", ip, 1000 + i % 7, user, raw or f"line {i}")


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/{name}")


def run(spark, live, folder, state, **how):
    live.start(spark.readStream.schema(SCHEMA).json(f"{folder}/*"), str(state), **how).awaitTermination(120)
    return {r["src_ip"]: (r["event_count"], str(r["first_seen"]), str(r["last_seen"]), r["overflow"]) for r in live.totals().collect()}, {(r["src_ip"], r["username"]): r["n"] for r in live.users().collect()}


def want(rows):
    rows = list(dict.fromkeys(rows))
    totals = {ip: (len(own := [r[0] for r in rows if r[2] == ip]), str(min(own)), str(max(own)), 0) for ip in {r[2] for r in rows}}
    return totals, dict(Counter((r[2], r[4]) for r in rows if r[4] not in ("", "?")))


def test_equals_a_batch_build(spark, tmp_path):
    rng = random.Random(1)
    rows = [event(i, f"9.9.9.{rng.randrange(4)}", rng.choice(["root", "admin", "", "?", "ü"])) for i in range(120)]
    folder, live = tmp_path / "in", Live(spark, str(tmp_path / "t"), 2)
    put(spark, folder, "a", rows[:70] + rows[:5])  # repeats within a batch
    assert run(spark, live, folder, tmp_path / "cp") == want(rows[:70])
    put(spark, folder, "b", rows[60:] + rows[70:75])  # and of an earlier one
    assert run(spark, live, folder, tmp_path / "cp") == want(rows)
    assert live.tables.state()[1]["done"] == {"journal": 1}
    # a new query, without the checkpoint, starts from what is stored
    more = [event(i, "9.9.9.1", "later") for i in range(500, 510)]
    put(spark, tmp_path / "in2", "c", more)
    assert run(spark, live, tmp_path / "in2", tmp_path / "cp2", stream="second", stored=live.stored_state()) == want(rows + more)


def test_names_beyond_the_bound_go_to_the_overflow(spark, tmp_path):
    rows = [event(i, "1.1.1.1", f"u{i % 6}") for i in range(30)]
    live = Live(spark, str(tmp_path / "t"), 1, users=4)
    put(spark, tmp_path / "in", "a", rows)
    totals, users = run(spark, live, tmp_path / "in", tmp_path / "cp")
    assert totals["1.1.1.1"][0] == 30 and totals["1.1.1.1"][3] == 10 and users == {("1.1.1.1", f"u{k}"): 5 for k in range(4)}
    fewer = Live(spark, str(tmp_path / "t"), 1, users=2)  # hydration keeps the most counted names
    put(spark, tmp_path / "in2", "b", [event(100, "1.1.1.1", "u3"), event(101, "1.1.1.1", "u0")])
    totals, users = run(spark, fewer, tmp_path / "in2", tmp_path / "cp2", stream="second", stored=live.stored_state())
    assert totals["1.1.1.1"][0] == 32 and totals["1.1.1.1"][3] == 10 + 10 + 1 and users["1.1.1.1", "u0"] == 6


def test_idle_addresses_start_a_generation(spark, tmp_path):
    rows = [event(i, "1.1.1.1", "root") for i in range(10)]
    live = Live(spark, str(tmp_path / "t"), 1, idle="1 second", repeats="1 second")
    put(spark, tmp_path / "in", "a", rows)
    run(spark, live, tmp_path / "in", tmp_path / "cp")
    later = [event(i, "1.1.1.1", "root") for i in range(100, 105)]
    put(spark, tmp_path / "in", "b", later)
    got = run(spark, live, tmp_path / "in", tmp_path / "cp")
    assert got == want(rows + later) and live.tables.read("totals").count() == 2
