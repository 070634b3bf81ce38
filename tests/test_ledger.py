"""Polled events and the ledger: runs that are stopped lose nothing and repeat nothing."""

import os

import pytest
from pyspark.sql import functions as F

from textloom.streaming import ledger


def put(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.write("".join(x + "\n" for x in lines))
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


SCHEMA = "step long, kind string"


def found(spark, folder):
    files = ledger.event_files(spark, folder, SCHEMA, "checkpoint_*.json", 1)
    return ledger.judged(files, F.col("event.kind") == "full", F.col("event.step"), 10).select(F.col("event.step").alias("step"), "status", "file")


def test_events_are_seen_once(spark, tmp_path):
    folder, book = str(tmp_path / "in"), ledger.Ledger(spark, str(tmp_path / "out"))
    put(folder, "checkpoint_1.json", '{"step": 10, "kind": "full"}')
    put(folder, "checkpoint_2.json", '{"step": 15, "kind": "full"}', '{"step": 20, "kind": "part"}')
    put(folder, "other.json", '{"step": 30, "kind": "full"}')
    assert book.rows("step long, status string, file string").count() == 0
    book.drain(found(spark, folder))
    put(folder, "checkpoint_3.json", '{"step"', '{"step": 40, "kind": "full"}', '{"step": 40, "kind": "full"}', "null", '{"kind": "full"}')
    for _ in range(3):
        book.drain(found(spark, folder))
    got = sorted(((r["step"], r["status"], r["file"]) for r in book.rows("step long, status string, file string").collect()), key=str)
    assert got == sorted([(10, "due", "checkpoint_1.json"), (15, "passed", "checkpoint_2.json"), (20, "unsupported", "checkpoint_2.json"), (None, "damaged", "checkpoint_3.json"), (None, "damaged", "checkpoint_3.json"), (None, "damaged", "checkpoint_3.json"), (40, "due", "checkpoint_3.json"), (40, "due", "checkpoint_3.json")], key=str)
    due = ledger.once_in_all(book.rows("step long, status string, file string").where("status = 'due'"), "step", "file")
    assert sorted(r["step"] for r in due.collect()) == [10, 40]


@pytest.mark.parametrize("when", ["before the entry", "after the entry"])
def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch, when):
    """A run fails in its second batch, after the rows are written and before or after the entry; the next one has all events once."""
    folder, book = str(tmp_path / "in"), ledger.Ledger(spark, str(tmp_path / "out"))
    for k in range(4):
        put(folder, f"checkpoint_{k}.json", f'{{"step": {10 * k}, "kind": "full"}}', f'{{"step": {10 * k + 1}, "kind": "part"}}')
    handled, real = [], ledger.write_text

    def enter(session, path, text):
        if len(handled) == 2 and when == "after the entry":
            real(session, path, text)
        if len(handled) == 2:
            raise RuntimeError("stopped")
        real(session, path, text)

    monkeypatch.setattr(ledger, "write_text", enter)
    with pytest.raises(Exception, match="stopped"):
        book.drain(found(spark, folder), lambda rows, batch: handled.append((batch, rows.count())))
    monkeypatch.setattr(ledger, "write_text", real)
    assert book.batches() == ([0] if when == "before the entry" else [0, 1])
    # What has been written without an entry is not read.
    assert book.rows("step long, status string, file string").count() == 2 * len(book.batches())
    book.drain(found(spark, folder), lambda rows, batch: handled.append((batch, rows.count())))
    rows = book.rows("step long, status string, file string").collect()
    assert sorted(r["step"] for r in rows) == sorted(x for k in range(4) for x in (10 * k, 10 * k + 1)) and len({r["batch"] for r in rows}) == 4
    # A batch whose entry stands is not handled again; one without comes again as it was.
    assert handled == [(0, 2), (1, 2), *([(1, 2)] if when == "before the entry" else []), (2, 2), (3, 2)]
