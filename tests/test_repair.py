import hashlib

from tests.test_library import T, index, said
from threadlake.operators import maintenance
from threadlake.operators.library import SCHEMAS, Store
from threadlake.operators.service import Engine, Writer
from threadlake.plans.requests import SearchRequest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def packed(texts, rows, size):
    """(last, rows, bytes) of each window, by going through the orphans one by one."""
    out, key, seen, total = [], None, 0, 0
    for t in sorted(texts, key=digest):
        now = (seen // rows, total // size)
        if now != key:
            key = now
            out.append([None, 0, 0])
        seen, total = seen + 1, total + len(t.encode())
        out[-1] = [digest(t), out[-1][1] + 1, out[-1][2] + len(t.encode())]
    return [tuple(w) for w in out]


def test_repair_goes_by_windows_and_goes_on_after_a_break(spark, tmp_path):
    path = str(tmp_path / "lib")
    lib = index(spark, path, {"a": [said("kept words"), said("more")]}, {"a": "1"}, T[0])
    lost = [f"lost {n} " + "é" * (n % 7 * 20) for n in range(40)] + ["", "x" * 900]
    more = spark.createDataFrame([(digest(t), t) for t in lost], SCHEMAS["contents"])
    Store(spark, path).commit(lib.with_tables(contents=lib["contents"].unionByName(more)))
    lib = Store(spark, path).open()
    for rows, size in ((9, 10**6), (100, 600), (9, 600), (1000, 10**6), (1, 1)):
        expected = packed(lost, rows, size)
        got = [tuple(r) for r in maintenance.windows(lib, "", rows, size).orderBy("last").collect()]
        assert got == expected and all(n <= rows for _, n, _ in got)
        assert all(b < size + 900 for _, _, b in got)

    writer = Writer(spark, path)
    before = lib.generation
    windows = packed(lost, 15, 1500)
    assert len(windows) > 3
    steps = writer.repair_in_windows(15, 1500)
    first = [next(steps), next(steps)]
    assert [(s["windows"], s["after"]) for s in first] == [(1, windows[0][0]), (2, windows[1][0])]
    steps.close()  # broken off: the lock is free, and both windows are committed
    assert writer.store.lock_state() == "free" and writer.store.manifest()["generation"] == before + 2
    left = {r.text for r in Store(spark, path).open()["contents"].collect()}
    assert left == {t for t in lost if digest(t) > windows[1][0]} | {"kept words", "more"}

    # One of the texts that are left is needed again before the repair goes on.
    again = max((t for t in lost if t), key=digest)
    index(spark, path, {"a": [said("kept words"), said("more")], "b": [said(again)]}, {"a": "1", "b": "1"}, T[1])
    rest = list(writer.repair_in_windows(15, 1500))
    gone = [t for t in lost if t != again]
    assert rest[-1] == {"windows": 2 + len(rest), "rows": len(gone), "bytes": sum(len(t.encode()) for t in gone), "after": rest[-1]["after"], "ended": True}
    assert {r.text for r in Store(spark, path).open()["contents"].collect()} == {"kept words", "more", again}
    engine = Engine.open(spark, path)
    assert {k: n for k, n in engine.doctor(full=True).items() if n} == {}
    assert engine.search(SearchRequest("lost"))["support"]["occurrences"] == 1
    # A repair that has ended begins anew, and finds nothing.
    generation = writer.store.manifest()["generation"]
    assert list(writer.repair_in_windows()) == [] and writer.store.manifest()["generation"] == generation


def test_a_window_reads_its_own_range(spark, tmp_path):
    path = str(tmp_path / "lib")
    index(spark, path, {"a": [said("one"), said("two")]}, {"a": "1"}, T[0])
    plan = maintenance.orphans_between(Store(spark, path).open(), "4", "8")._jdf.queryExecution().toString()
    assert plan.count("GreaterThan(digest,4)") == 2 and plan.count("LessThanOrEqual(digest,8)") == 2
