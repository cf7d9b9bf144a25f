"""Lines of files that many tasks read, against reading them in one go."""

import pytest
import zstandard

from threadlake.sources import records

MOST = 4000


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def read(spark, paths):
    out = {}
    for r in records.lines(spark, [f"file:{p}" for p in paths], MOST).collect():
        out.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.no, r.line))
    return {n: sorted(v) for n, v in out.items()}


def test_lines(spark, tmp_path, small_ranges):
    """Numbers go on over ranges; carriage returns go, blank lines stay; names with blanks, signs and letters stay what they are."""
    rows = [f"{'é' if i % 7 == 0 else 'x'}{i} " * (i % 90) for i in range(3000)]
    names = ["a b+c%20é.jsonl", "plain.jsonl"]
    for n in names:
        (tmp_path / n).write_bytes("\n".join(r + "\r" * (i % 3 == 0) for i, r in enumerate(rows)).encode() + b"\n" * (n == names[1]))
    (tmp_path / "packed.jsonl.zst").write_bytes(zstandard.compress(b"one\r\n\ntwo"))
    (tmp_path / "empty.jsonl").touch()
    got = read(spark, [tmp_path / n for n in (*names, "packed.jsonl.zst", "empty.jsonl")])
    want = [(i, r or None) for i, r in enumerate(rows)]
    assert got == {names[0]: want, names[1]: want, "packed.jsonl.zst": [(0, "one"), (1, None), (2, "two")]}
    assert records._plain(spark, [f"file:{tmp_path / names[0]}"], MOST).rdd.getNumPartitions() > 1
    assert records.lines(spark, []).collect() == []


def test_what_cannot_be_read_is_told(spark, tmp_path, small_ranges):
    """Too long records, wherever they begin in a range, and bytes that aren't UTF-8; the longest that may be is read."""
    bad = (records.BAD_LINE, records.BAD)
    for at in (0, 10, 2000, 4090, 4096, 9000):
        for size, told in ((MOST, False), (MOST + 1, True), (MOST * 3, True)):
            (tmp_path / f"{at}-{size}").write_bytes(b"a" * max(at - 1, 0) + b"\n" * (at > 0) + b"y" * size + b"\nend\n") if at < MOST else (tmp_path / f"{at}-{size}").write_bytes((b"a" * 99 + b"\n") * (at // 100) + b"y" * size + b"\nend")
            assert (bad in read(spark, [tmp_path / f"{at}-{size}"])[f"{at}-{size}"]) == told, (at, size)
    (tmp_path / "odd").write_bytes(b"fine\n\xff\xfe\nlast")
    (tmp_path / "odd.zst").write_bytes(zstandard.compress(b"fine\n\xff\xfe\n"))
    (tmp_path / "long.zst").write_bytes(zstandard.compress(b"z" * (MOST + 1)))
    (tmp_path / "broken.zst").write_bytes(b"no frame")
    got = read(spark, [tmp_path / n for n in ("odd", "odd.zst", "long.zst", "broken.zst")])
    assert len(got) == 4 and all(bad in v for v in got.values())
