"""Replay of conversations, the digest index and the Merkle manifest against brute-force versions, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from threadlake.llm import digest_index, merkle, ranks, replay, store

RND = random.Random(11)
CLASH = ("p", "conv", "part", "range_no", "range_seq", "salt", "keep_id", "tree", "index", "block", "n", "value", "root", "leaf")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in CLASH})


def crc(text):
    return zlib.crc32(text.encode())


def fates(rows):
    """(conv_id, turn, p, status, attempts, first_at, last_at, release_no, state) by simulation of one turn after the other."""
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, crc(r[2] or "")))
        done = []
        for p, (_, turn, text) in enumerate(turns):
            h = lambda k: crc(f"{k}:{'' if conv is None else conv}:{'' if turn is None else turn}")  # noqa: B023, E731
            up = done[p - h(0) % 3] if h(0) % 3 and p >= h(0) % 3 else None
            if up and up["status"] != "delivered":
                done.append({"status": "blocked", "attempts": 0, "first": None, "last": None})
                continue
            now = max(7 * p, up["last"] if up else 0)
            fate = {"status": "dead", "attempts": 5, "first": now}
            for a in range(1, 6):
                fate["last"] = now
                if not (h(1) % 101 < 35 and (now < 7 * p + h(2) % 101 or h(a + 2) % 3 == 0)):
                    fate |= {"status": "delivered", "attempts": a}
                    break
                now += 10 * 2 ** (a - 1)
            done.append(fate)
        state = 0
        for number, p in enumerate(sorted((p for p, f in enumerate(done) if f["status"] == "delivered"), key=lambda p: (done[p]["last"], p)), 1):
            state += number * crc(turns[p][2] or "")
            done[p] |= {"number": number, "state": (state + 2**63) % 2**64 - 2**63}
        out += [(conv, turns[p][1], p, f["status"], f["attempts"], f["first"], f["last"], f.get("number"), f.get("state")) for p, f in enumerate(done)]
    return sorted(out, key=str)


def talk():
    rows = [(c, t * RND.choice((1, 1, 3)), f"text {RND.random()}") for c in range(40) for t in range(RND.randint(1, 30))]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows += [(500, t, "é" * (t % 50)) for t in range(6000)]
    return rows + [(None, 3, "a"), (None, 1, None), (7001, None, "n"), (7001, 2**60 + 1, "m"), (7001, 2**60, ""), (7002, 5, "same"), (7002, 5, "same"), (7002, 5, "other"), (7003, 1, "x" * 300_000)]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_replay(spark, partitions):
    """One partition holds every conversation whole; with seven, that of 6,000 turns is parted and its releases are ranked over its parts."""
    rows = talk()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = frame(spark, rows, "conv_id long, turn long, text string").repartition(5)
        got = sorted((tuple(r) for r in replay.replay(df).collect()), key=str)
        ranged = ranks.ranged(replay._drawn(df), ["has_id", "conv"], ["has_turn", "turn", "crc"], "t")
        parts = replay._parts(ranged).where("conv = 500").agg(F.max("parts"), F.count_distinct("part")).collect()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == fates(rows)
    assert parts[0] == parts[1] and (parts[0] > 3) == (partitions == "7")


def test_replay_of_nothing(spark):
    assert replay.replay(spark.createDataFrame([], "conv_id long, turn long, text string")).collect() == []


def test_states_wrap(spark):
    """Sums beyond 64 bits wrap in the batches and over parts alike."""
    rows = [(True, 1, True, t, t, 4_000_000_000, 2, "delivered", 1, t, t, None, None) for t in range(100_000)]
    turns = spark.createDataFrame(rows, replay._OUT)
    last = replay._whole_releases(turns).orderBy(F.desc("release_no")).first()
    total = sum(range(1, 100_001)) * 4_000_000_000
    assert total > 2**63 and (last["release_no"], last["state"]) == (100_000, (total + 2**63) % 2**64 - 2**63)


def test_batches_end_anywhere():
    """A part that is spread over several batches is replayed as one."""
    import pandas as pd

    rows = pd.DataFrame([(True, c, True, t, t, crc(f"{c}{t}"), 1, 0, crc(f"b{c}{t}") % 3, crc(f"f{c}{t}") % 2 == 0, t % 40, t % 32) for c in range(9) for t in range(c * 3 + 1)])
    rows.columns = ["has_id", "conv", "has_turn", "turn", "p", "crc", "parts", "part", "back", "faulty", "repair", "fails"]
    whole = replay.replayed(rows)
    for size in (1, 2, 5, 17):
        pieces = list(replay._each_part(iter([rows.iloc[i : i + size] for i in range(0, len(rows), size)] + [rows.iloc[:0]])))
        assert pd.concat(pieces, ignore_index=True).equals(whole)


# exact dedup


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


TEXTS = [(i, RND.choice(("Hot", "hOT", f"t{i % 37}", f"Once {i}"))) for i in range(600)] + [(900, None), (901, ""), (902, "É"), (903, "é"), (904, "x" * 200_000), (905, "X" * 200_000), (906, "twice"), (906, "twice"), (907, " twice"), (None, "hot"), (None, "no id"), (None, "no id")]


def test_exact_dedup(spark):
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(lowered(t), []).append(i)
    want = []
    for i, t in TEXTS:
        ids = [x for x in groups[lowered(t)] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[lowered(t)]), keep is None or i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    df = frame(spark, TEXTS, "doc_id long, text string")
    for batches in (1, 2, 5):
        assert sorted(map(tuple, digest_index.deduplicated(df, batches).collect()), key=str) == sorted(want, key=str)
    assert digest_index.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_index_lasts_and_grows(spark):
    """An index opened again lacks only what is new; a batch added again changes nothing; it is read by bucket, without an exchange of its own."""
    path = store.fresh_path(spark, "index-test")
    old, new = [(i, f"text {i % 50}") for i in range(200)], [(1000 + i, f"text {i % 80}") for i in range(160)]
    first = digest_index.DigestIndex.open(spark, path, 4)
    first.add(digest_index.hashed(frame(spark, old, "doc_id long, text string")), "a")
    first.close()
    again = digest_index.DigestIndex.open(spark, path, 4)
    assert again.table().count() == 50
    rows = digest_index.hashed(frame(spark, new, "doc_id long, text string"))
    for _ in range(2):
        again.add(rows, "b")
        kept = {r["text_sha256"]: (r["keep_id"], r["batch"]) for r in again.table().collect()}
        assert len(kept) == again.table().count() == 80
    sha = lambda i: hashlib.sha256(f"text {i}".encode()).hexdigest()
    assert all(kept[sha(i)] == ((150 + i, "a") if i < 50 else (1080 + i, "b")) for i in range(80))
    judged = again.judged(rows).collect()
    assert {r["doc_id"] for r in judged if r["kept"]} == {1080 + i for i in range(50, 80)}
    plan = again.unknown(digest_index.grouped(rows))._jdf.queryExecution().executedPlan().toString()
    right = plan[plan.index("SortMergeJoin") :].split("FileScan parquet spark_catalog")[0]
    assert "Bucketed: true" in plan and "LeftAnti" in plan and "Exchange" not in right.rsplit(":- ", 1)[0].rsplit("\n", 3)[-1]
    small = again.compact(store.fresh_path(spark, "index-compact"))
    assert sorted(map(tuple, small.table().collect())) == sorted(map(tuple, again.table().collect()))
    with pytest.raises(ValueError):
        again.add(rows, "no/slashes")


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climbed(values):
    """The root, and for each value the siblings before and after at every level."""
    paths, level = [[] for _ in values], list(values)
    at = list(range(len(values)))
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i // 8 * 8
            paths[k].append((level[first:i], level[i + 1 : first + 8]))
            at[k] = i // 8
        level = [H(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def manifest(rows):
    trees = {}
    for doc, text, lang, source, chars in rows:
        leaf = H(*map(told, (doc, source, lang, chars, text)))
        hit = doc is not None and crc(str(doc)) % 3 == 0 and text is not None
        altered = H(*map(told, (doc, source, lang, chars, lowered(text)))) if hit else leaf
        trees.setdefault(lang, []).append((doc is not None, doc or 0, leaf, altered))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subs = {x: climbed([r[2] for r in sorted(trees[x])]) for x in langs}
    root, above = climbed([subs[x][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for (known, doc, leaf, now), below in zip(sorted(trees[lang]), subs[lang][1]):
            path = below + above[k]
            for left, right in path:
                now = H(*left, now, *right)
            out.append((doc if known else None, leaf, subs[lang][0], root, H(*[d for left, right in path for d in left + right]), now, now == root))
    return sorted(out, key=str)


def papers(langs):
    return [(i, RND.choice(("Some Text", "no capital", None, "", "É Ü", f"T{i}")), lang, f"s{i % 3}", i % 100) for i in range(sum(langs.values())) for lang in [RND.choices(list(langs), langs.values())[0]]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("langs", [{"en": 1300, "de": 60, None: 9, "ß": 1, "z": 8}, {"only": 1}, {"a": 8}, {"a": 9, "b": 1}, {f"l{i}": 2 for i in range(70)}, {"big": 4700}])
def test_manifest(spark, langs):
    rows = papers(langs)
    got = sorted(map(tuple, merkle.manifest(frame(spark, rows, SCHEMA).repartition(6)).collect()), key=str)
    assert got == manifest(rows)


def test_manifest_of_odd_rows(spark):
    rows = [(1, "Twice", "en", "s", 5), (1, "Twice", "en", "s", 5), (1, "Other", "en", None, None), (None, "X", None, None, None), (None, None, None, None, None), (2**60, "y" * 300_000, "en", "s", -1), (3, "a", "", "s", 1)]
    assert sorted(map(tuple, merkle.manifest(frame(spark, rows, SCHEMA)).collect()), key=str) == manifest(rows)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_forest_is_a_commutative_monoid():
    """Any partition of the leaves, merged in any order and grouping, comes to the same root, and a complete stretch is one node."""
    sizes = {0: 700, 1: 1, 2: 64, 3: 8}
    values = {t: [H(f"{t}:{i}") for i in range(n)] for t, n in sizes.items()}
    want = climbed([climbed(values[t])[0] for t in sizes])[0]
    for _ in range(10):
        parts = [merkle.Forest(len(sizes)) for _ in range(RND.randint(1, 12))]
        for t, n in sizes.items():
            cuts = sorted(RND.randrange(n + 1) for _ in parts[1:])
            for part, low, high in zip(parts, [0, *cuts], [*cuts, n]):
                part.leaves[t] = n
                for i in range(low, high):
                    part.put(t, 0, i, values[t][i])
        assert all(len(p.nodes) < 120 for p in parts)
        while len(parts) > 1:
            a = parts.pop(RND.randrange(len(parts)))
            b = parts.pop(RND.randrange(len(parts)))
            parts.append(a.merge(b))
        assert parts[0].merge(merkle.Forest()).root() == want and len(parts[0].nodes) == 1


def test_files_stand_in_the_order_of_their_numbers(spark):
    """From 100,000 files on, names have more digits and sort otherwise."""
    from threadlake.llm import token_records

    names = [f"part-{n:05}-abc.txt" for n in (99_998, 99_999, 100_000, 100_001, 1_000_000, 7)]
    index = spark.createDataFrame([(n, k) for n in names for k in (2, 3)], "file string, n_tokens long")
    assert {r["file"]: r["base"] for r in token_records.bases(index).collect()} == {names[5]: 0, names[0]: 5, names[1]: 10, names[2]: 15, names[3]: 20, names[4]: 25}
