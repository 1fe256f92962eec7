"""The paged source: restarts, resets, and where a restarted query goes on."""

import datetime as dt
import json
import os

import pytest

from tallywork.sources import provider as P


class Ledgered(P.Provider):
    """A provider whose pages and faults are in a file, so that every process sees the same: {"pages": {cursor: [ids, next, more]}, "faults": {cursor: [kind, times]}, "log": []}."""

    file = ""

    def fetch(self, cursor):
        with open(self.file) as f:
            state = json.load(f)
        key = str(cursor)
        state["log"].append(key)
        fault = state["faults"].get(key, ["", 0])
        hit = fault[1] > 0
        fault[1] -= 1
        part = f"{self.file}.{os.getpid()}"  # tasks fetch pages at the same time
        with open(part, "w") as f:
            json.dump(state, f)
        os.replace(part, self.file)
        if hit:
            raise {"moved": P.MutationDuringPaging, "bad": P.BadCursor}[fault[0]](key)
        if key not in state["pages"]:
            raise P.BadCursor(key)
        ids, following, more = state["pages"][key]
        return [("added", i, t, None, "p1", dt.date(2024, 1, 1), 1, "USD", "m", "d", False, None) for i, t in enumerate(ids)], following, more


def provider(path, pages, faults=None):
    path.write_text(json.dumps({"pages": pages, "faults": faults or {}, "log": []}))
    return type("Filed", (Ledgered,), {"file": str(path)})


def log(path):
    return json.loads(path.read_text())["log"]


PAGES = {"None": [["a", "b"], "1", True], "1": [["c"], "2", True], "2": [["d"], "3", False], "3": [[], "3", False]}


def test_a_mutation_starts_the_run_over(tmp_path):
    reader = P.Reader(provider(tmp_path / "p", PAGES, {"1": ["moved", 1]})())
    end = reader.latestOffset()
    assert end == {"cursors": [None, "1", "2", "3"], "page": 0, "attempt": 1, "reset": False} and log(tmp_path / "p") == ["None", "1", "None", "1", "2"]
    pages = reader.partitions(reader.initialOffset(), end)
    assert [r[3] for p in pages for r in reader.read(p)] == ["a", "b", "c", "d"] and [r[0] for p in pages for r in reader.read(p)] == [0, 0, 1, 2]
    assert reader.latestOffset() == end


def test_a_provider_that_keeps_moving_is_given_up(tmp_path):
    reader = P.Reader(provider(tmp_path / "p", PAGES, {"1": ["moved", 9]})())
    with pytest.raises(P.MutationDuringPaging):
        reader.latestOffset()
    assert log(tmp_path / "p") == ["None", "1"] * 3


def test_a_bad_cursor_resets_once(tmp_path):
    reader = P.Reader(provider(tmp_path / "p", PAGES, {"1": ["moved", 1]})(), cursor="stale")
    end = reader.latestOffset()
    # A mutation after the reset starts over from none, and is the first restart.
    assert end["reset"] and end["attempt"] == 1 and end["cursors"] == [None, "1", "2", "3"] and log(tmp_path / "p")[:2] == ["stale", "None"]
    assert [p.cursor for p in reader.partitions(reader.initialOffset(), end)] == [None, "1", "2"]
    worse = P.Reader(provider(tmp_path / "q", {})(), cursor="stale")
    with pytest.raises(P.BadCursor):
        worse.latestOffset()
    assert log(tmp_path / "q") == ["stale", "None"]


def test_pages_that_changed_after_the_walk_are_refused(tmp_path):
    reader = P.Reader(provider(tmp_path / "p", PAGES)())
    pages = reader.partitions(reader.initialOffset(), reader.latestOffset())
    provider(tmp_path / "p", {**PAGES, "1": [["x"], "9", True]})
    with pytest.raises(P.MutationDuringPaging):
        list(reader.read(pages[1]))


def test_long_runs_are_cut(tmp_path):
    reader = P.Reader(provider(tmp_path / "p", PAGES)(), most_pages=2)
    one = reader.latestOffset()
    assert one["cursors"] == [None, "1", "2"] and len(reader.partitions(reader.initialOffset(), one)) == 2
    two = reader.latestOffset()
    assert two["cursors"] == ["2", "3"] and two["page"] == 2 and [p.number for p in reader.partitions(one, two)] == [2]


def test_a_reader_that_lags_leaves_out_what_was_read(tmp_path):
    made = provider(tmp_path / "p", {**PAGES, "2": [["d"], "3", False]})
    reader = P.Reader(made(), state=str(tmp_path / "state"), most_pages=1)
    one = reader.latestOffset()
    reader.partitions(reader.initialOffset(), one)
    reader.commit(one)
    two = reader.latestOffset()
    reader.partitions(one, two)  # not committed
    again = P.Reader(made(), state=str(tmp_path / "state"))
    end = again.latestOffset()
    assert end["cursors"] == ["1", "2", "3"] and [(p.number, p.cursor) for p in again.partitions(two, end)] == [(2, "2")]


def test_stream_gives_each_row_once(spark, tmp_path):
    """Mutation in mid-paging, later a cursor that has become bad, a query that is started again."""
    file = tmp_path / "p"
    made = provider(file, {k: PAGES[k] for k in ("None", "1")} | {"2": [[], "2", False]}, {"1": ["moved", 1]})
    spark.dataSource.register(P.source(made, "filed"))

    def run():
        q = spark.readStream.format("filed").option("state", str(tmp_path / "state")).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r["page"], r["provider_tx_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(0, "a"), (0, "b"), (1, "c")]
    assert run() == [(0, "a"), (0, "b"), (1, "c")]
    state = json.loads(file.read_text())
    file.write_text(json.dumps(state | {"pages": PAGES}))
    assert run() == [(0, "a"), (0, "b"), (1, "c"), (3, "d")]
    # The cursor is of no use any more: all is read anew, once, under later page numbers.
    file.write_text(json.dumps(state | {"pages": {"None": [["a", "z"], "new", False], "new": [[], "new", False]}}))
    assert run()[4:] == [(4, "a"), (4, "z")] and len(run()) == 6
