"""What round 4's review found, one test a finding."""

import json

import numpy as np
import pytest

from loomtrace.operators import graphs as gr
from loomtrace.operators import mining as mi
from loomtrace.sources import files as fs
from loomtrace.streaming import events as st


@pytest.mark.parametrize("tile", [3, 2048])
def test_similarity_shuffles_a_row_a_bounded_number_of_times(spark, monkeypatch, tile):
    """A row was shuffled once for each 1,024 rows, and a task returned all its pairs at once (F1)."""
    monkeypatch.setattr(mi, "PAIR_ROWS", 2)
    monkeypatch.setattr(mi, "TILE_ROWS", tile)
    monkeypatch.setattr(mi, "SLICE_ROWS", 4)
    x = np.abs(np.random.default_rng(1).standard_normal((150, 5)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    classes = spark.createDataFrame([(f"t{i:03}", 1, list(range(5)), v.tolist()) for i, v in enumerate(x)], "class_id string, members long, f array<int>, x array<double>")
    rows = classes.selectExpr("class_id AS id", "members", "f", "x", "-1 AS by")
    cells = mi._cells(rows, mi.PAIR_ROWS)
    assert cells.count() == 150 * 16 and cells.select("a", "b").distinct().count() == 16 * 17 // 2
    got = [(r.i, r.j, r.value) for r in mi.similar_classes(classes, 1e-12).collect()]
    assert len(got) == 150 * 149 // 2 == len({g[:2] for g in got})
    c = x @ x.T
    assert all(i < j and v == pytest.approx(c[int(i[1:]), int(j[1:])]) for i, j, v in got)


def test_episode_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver held the status of every file (F4, F5). Odd files give what Spark's reader gives."""
    texts = {
        "a b%c.json": '{"trajectory_id": "a", "steps": [{"step_index": 1, "k": 2}]}', "two.json": '[{"trajectory_id": "x"},\n {"trajectory_id": "y", "sample_id": 3}]', "sub/none.json": "", "sub/blank.txt": " \n",
        "sub/bad.json": '{"trajectory_id": ', "sub/deep/er/é.txt": '{"trajectory_id": "é",\n"sample_id": 4}', "sub/kind.json": '{"trajectory_id": "k", "sample_id": "no"}', "sub/empty.json": "[]",
        "sub/_hidden.json": '{"trajectory_id": "h"}', ".h/x.json": '{"trajectory_id": "h"}', "sub/other.csv": "{}", "sub/null.json": "null",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "sub/wide.json").write_bytes('{"trajectory_id": "w"}'.encode("utf-16-le"))
    (tmp_path / "sub/marked.json").write_bytes('{"trajectory_id": "m"}'.encode("utf-8-sig"))
    got = fs.read_episode_files(spark, str(tmp_path))
    assert not got.inputFiles()
    monkeypatch.setattr(fs, "mounted", lambda *a: None)
    want = fs.read_episode_files(spark, str(tmp_path))
    assert want.inputFiles() and got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


class Handle:
    """The state of one key, and how many calls to it there were."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, {}, set()

    def getValueState(self, name, schema):
        return State(self, name)

    getListState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))


class State:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def _do(self, f):
        self.handle.calls += 1
        return f(self.handle.held)

    def get(self):
        return self._do(lambda held: held.get(self.name, None if self.name == "machines" else iter(())))

    def exists(self):
        return self._do(lambda held: self.name in held)

    def update(self, value):
        self._do(lambda held: held.__setitem__(self.name, value))

    put = update

    def appendValue(self, value):
        self._do(lambda held: held.setdefault(self.name, []).append(value))

    def clear(self):
        self._do(lambda held: held.pop(self.name, None))


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_state_is_called_for_batches_not_for_steps(monkeypatch):
    """A step was a message to the state store, and a trajectory some ten more (F6). Steps of two trajectories come in no order, in two batches and three watermarks."""
    machine, handle = st.PageMachine(10_000), Handle()
    machine.init(handle)
    order = np.random.default_rng(3).permutation(400).tolist()
    steps = [{"trajectory_id": f"t{i % 2}", "at": i * 1000 + 7, "event_id": i, "tool": ("search_action", "click_action")[i % 3 > 0], "keywords": "k", "value": ("buy now", "B0123456789", "back to search")[i % 5 % 3], "clickable_types": None} for i in order]
    rows = [{"at": s["at"], "step": json.dumps(s)} for s in steps]
    found = []

    def fire(ms):
        for at in sorted(t for t in handle.timers if t <= ms):
            found.extend(machine.handleExpiredTimer((1,), Clock(ms), None))
            handle.timers.discard(at)

    list(machine.handleInputRows((1,), rows[:200], Clock(0)))
    list(machine.handleInputRows((1,), rows[200:], Clock(0)))
    assert handle.calls <= 8 and len(handle.timers) == 1
    fire(100)
    assert sorted(r.event_id for r in found) == [i for i in range(400) if i < 100] and len(handle.timers) == 1
    fire(450)
    assert json.loads(handle.held["machines"][0]).keys() == {"t0", "t1"} and "waiting" not in handle.held and handle.timers == {398 + 10_000}
    fire(20_000)
    assert not handle.held and not handle.timers and handle.calls < 40
    for t in range(2):
        page, searched, want = "search", False, []
        for n, s in enumerate(sorted((s for s in steps if s["trajectory_id"] == f"t{t}"), key=lambda s: s["at"])):
            event = st.shop_event(page, searched, s["tool"], s["keywords"], s["value"], {})
            want.append((n, s["event_id"], event))
            page, searched = st.lb.NEXT_PAGE.get(event, page), searched or event.startswith("query_")
        assert [(r.step_index, r.event_id, r.shop_event) for r in found if r.trajectory_id == f"t{t}"] == want


def test_eigenvectors_of_many_nodes_are_blocks(spark):
    """The driver held 264 vectors and their images (F2, F3). Two equal halves, so that eigenvalues come twice, and a node without edges."""
    rng = np.random.default_rng(5)
    a = np.zeros((60, 60))
    for c in range(3):
        a[c * 20 : c * 20 + 20, c * 20 : c * 20 + 20] = rng.random((20, 20)) * (rng.random((20, 20)) < 0.6)
    a += 0.02 * (rng.random((60, 60)) < 0.05) - 0.01 * (rng.random((60, 60)) < 0.05)
    a = np.kron(np.eye(2), np.triu(a, 1) + np.triu(a, 1).T)
    d = np.abs(a).sum(axis=1)
    m = np.eye(121)
    m[:120, :120] -= a / np.sqrt(d[:, None] * d)
    i, j = np.nonzero(m - np.diag(np.diag(m)))
    rows = spark.createDataFrame([(int(x) * 3, int(y) * 3, float(m[x, y])) for x, y in zip(i, j)], "i long, j long, value double")
    nodes = spark.createDataFrame([(x * 3,) for x in range(121)], "i long")
    values, k, here = gr.spectral_rows(rows, 6, 2, 5, nodes=nodes)
    found, l, table = gr.spectral_rows(rows, 6, 2, 5, nodes=nodes, driver_nodes=10)
    assert found == pytest.approx(np.linalg.eigvalsh(m)[:6], abs=1e-9) and found == pytest.approx(values, abs=1e-9) and k == l
    got = sorted((r.id, np.array(r.v)) for r in table.collect())
    assert [g[0] for g in got] == here[0].tolist()
    x, y = np.stack([g[1] for g in got]), here[1]
    assert x @ x.T == pytest.approx(y @ y.T, abs=1e-5)  # the same rows but for a rotation
