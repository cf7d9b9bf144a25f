"""Each operator against a brute-force version on a small fixture, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from threadlake.llm import bpe, components, decontaminate, embed_dup, licenses, line_dedup, near_dup, quality, queries, quotes, ring, store, token_records
from threadlake.llm import words as W

RND = random.Random(5)
WORDS = [f"w{i}" for i in range(300)]


def prose(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string"):
    """With columns beside, of names that operators use inside."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("clash") for c in ("n", "key", "rep", "node", "a", "b", "component", "form", "words", "h", "cell", "low", "tile", "padded")})


ODD = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "\u0085é 中文 \U0001f600"), (None, "no id"), (9005, "one"), (9006, "x" * 50_000), (9007, "twice"), (9007, "twice")]


def groups(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in linked:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# decontamination


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set())


def test_decontaminate(spark):
    items = [(i, prose(RND.randint(6, 40))) for i in range(30)] + [(100, "tiny Item"), (101, ""), (102, None), (None, "w1 w2"), (103, items_text := "w1 w2 w3 w4 w5"), (103, items_text)]
    docs = []
    for d in range(60):
        text = prose(RND.randint(0, 400)).split(" ")
        for _ in range(2):
            item = (items[RND.randrange(30)][1]).split(" ")
            for _ in range(RND.randint(0, 2)):
                item[RND.randrange(len(item))] = "changed"
            at = RND.randint(0, len(text))
            text[at:at] = item
        docs.append((d, " ".join(text).upper() if d % 2 else "\n".join(text)))
    docs += [*ODD, (500, "a tiny\titem b"), (501, "a tinyitem")]
    got = {(r.doc_id, r.item_id): r.n_found for r in decontaminate.find(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}
    want = {}
    for d, text in docs:
        padded = b" " + b" ".join((text or "").encode().lower().split()) + b" "
        for i, item in items:
            s = shingles(item)
            n = sum(b" " + x + b" " in padded for x in s)
            if s and i is not None and d is not None and n >= 0.75 * len(s):
                want[(d, i)] = n
    assert got == want and len(want) > 40
    empty = frame(spark, [])
    assert decontaminate.find(empty, frame(spark, items, "item_id long, text string")).count() == 0
    assert decontaminate.find(frame(spark, docs), frame(spark, [], "item_id long, text string")).count() == 0


# near-duplicates


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 8)
    monkeypatch.setattr(near_dup, "TILE_SETS", 5)
    texts = []
    for _ in range(6):
        base = prose(RND.randint(60, 200)).split(" ")
        for _ in range(15):
            w = list(base)
            for _ in range(RND.randint(0, max(1, len(w) // 25))):
                w[RND.randrange(len(w))] = RND.choice(WORDS)
            texts.append(" ".join(w))
    texts += ["a b c", "A  B c", "a b", "é É", "É é", "ab\u0085c d"]
    docs = list(enumerate(texts))
    got = {r.doc_id: r for r in near_dup.near_duplicates(frame(spark, docs + ODD)).collect()}
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = groups(len(texts), links)
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(len(sets[i]), root[i], root[i] == i) for i in range(len(texts))]
    assert (got[9001].n_shingles, got[9001].component_id, got[9001].kept) == (0, 9001, True) and got[9006].n_shingles == 1
    assert (got[None].component_id, got[None].kept) == (None, None)
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0
    kept = near_dup.without_duplicates(frame(spark, docs + ODD))
    assert kept.columns == frame(spark, docs).columns
    assert sorted(r.doc_id for r in kept.where("doc_id < 9000").collect()) == sorted(set(root)) and kept.where("doc_id IS NULL").count() == 1


def test_odd_sketch_estimates():
    base = [f"t{i}" for i in range(400)]
    flips = []
    for k in range(40):
        other = list(base)
        other[RND.randrange(400)] = f"n{k}"
        sk = next(near_dup._signatures([" ".join(base), " ".join(other)]))[3]
        flips.append(int(np.bitwise_count((sk[0] ^ sk[1]).view(np.uint64)).sum()))
    # One word of 400 changes five shingles of 396: similarity 0.975, so about 6 flips.
    assert 2 <= np.mean(flips) <= 12 and max(flips) < near_dup.max_flips()


def test_sketches_rule_out_no_pair_above_the_threshold():
    """Pairs of similarity 0.75 to 0.8, by brute force: all pass the sketch, and share a band."""
    tried = 0
    for _ in range(600):
        base = [f"t{RND.randrange(10**9)}" for _ in range(RND.choice((12, 40, 150, 600)))]
        other = list(base)
        for at in RND.sample(range(len(other)), max(1, round(len(other) * RND.uniform(0.02, 0.034)))):
            other[at] = "x"
        a, b = (shingles(" ".join(w)) for w in (base, other))
        if 0.75 <= len(a & b) / len(a | b) <= 0.8:
            tried += 1
            _, _, bands, sketch = next(near_dup._signatures([" ".join(base), " ".join(other)]))
            assert np.bitwise_count((sketch[0] ^ sketch[1]).view(np.uint64)).sum() <= near_dup.max_flips() and (bands[0] == bands[1]).any()
    assert tried > 100


def test_intersections():
    sets = [np.unique(np.array(RND.sample(range(50), 20), dtype=np.uint64)) for _ in range(9)] + [np.array([1 << 40], dtype=np.uint64)]
    assert near_dup.intersections(sets).tolist() == [[float(len(np.intersect1d(a, b))) for b in sets] for a in sets]


# embeddings


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embed_dup, "TILE", 4)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(12):
        base = rng.standard_normal(64)
        for _ in range(8):
            rows.append((base + rng.standard_normal(64) * rng.uniform(0, 0.45)).tolist())
    rows += [rows[0], rows[0], [2 * x for x in rows[0]]]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [None] + [1.0] * 63), (9006, [1.0, 2.0]), (9007, [1.0, 2.0]), (None, rows[0]), (9008, [1e300] * 64), (9009, [1e-300] * 64)]
    table = list(enumerate(rows)) + odd
    got = {r.vec_id: r for r in embed_dup.near_duplicates(frame(spark, table, "vec_id long, embedding array<double>")).collect()}
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    root = groups(len(rows), np.argwhere(near).tolist())
    # Filters are a search: what is found must be right, and nearly all must be found.
    found = sum(got[i].n_links for i in range(len(rows)))
    assert all(got[i].n_links <= near[i].sum() for i in range(len(rows))) and found >= 0.99 * near.sum() > 0
    if found == near.sum():
        assert [got[i].component_id for i in range(len(rows))] == root
    assert [(got[k].n_links, got[k].component_id) for k in (9001, 9002, 9003, 9004, 9005)] == [(0, k) for k in (9001, 9002, 9003, 9004, 9005)]
    assert got[9006].n_links == got[9007].n_links == 1 and got[9007].component_id == 9006 and got[9008].n_links == 1
    assert embed_dup.near_duplicates(frame(spark, [], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("dim", [2, 3, 4, 8, 12, 16, 31, 64, 256, 1024])
def test_cap_filter_recall(dim):
    """Pairs at the least cosine, against brute force: nearly all share a filter, whatever the number of components."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = rng.standard_normal(x.shape)
    r -= (r * x).sum(axis=1, keepdims=True) * x
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * r
    shared = [len(np.intersect1d(a, b)) for a, b in zip(embed_dup.decode(x), embed_dup.decode(y))]
    assert np.mean(np.array(shared) > 0) >= 0.985


@pytest.mark.parametrize("dim", [4, 16, 64])
def test_decoding_takes_all_directions_above_the_threshold(dim):
    """Against the inner products with every direction of a code."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = [[] for _ in x]
    base = 0
    for which in range(embed_dup.CODES):
        rotation, words = embed_dup.code(dim, which)
        total = np.zeros((len(x), 1))
        for part, w in zip(np.split(x @ rotation, len(words), axis=1), words):
            total = (total[:, :, None] + (part @ w.T)[:, None, :]).reshape(len(x), -1)
        for k, t in enumerate(total):
            want[k] += (base + np.flatnonzero(t >= t.max() - embed_dup.margin(dim))).tolist()
        base += total.shape[1]
    got = [f.tolist() for f in embed_dup.decode(x)]
    assert all(len(set(g) ^ set(w)) <= 1 for g, w in zip(got, want))  # but for rounding at the threshold


def test_a_link_does_not_depend_on_the_tile():
    rng = np.random.default_rng(10)
    x = rng.standard_normal((40, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[0] * 0.95 + (np.eye(24)[0] - x[0][0] * x[0]) / np.linalg.norm(np.eye(24)[0] - x[0][0] * x[0]) * np.sqrt(1 - 0.95**2)
    none = [np.zeros(0, np.int32)] * 41
    alone = embed_dup.tile_links(5, np.zeros(2, int), np.array([x[0], y]), none, False, 0.95)[0, 1]
    assert embed_dup.tile_links(5, np.zeros(41, int), np.vstack([x, y]), none, False, 0.95)[0, 40] == alone


# lines


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def edited(text, k):
    s = list(text)
    for _ in range(k):
        i, how = RND.randrange(len(s) + 1), RND.randrange(3)
        if how == 0:
            s.insert(i, RND.choice("abé\U0001f600"))
        elif s:
            s[min(i, len(s) - 1) : min(i, len(s) - 1) + 1] = [] if how == 1 else [RND.choice("abé\U0001f600")]
    return "".join(s)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_edit_distance_trimming_and_sketch(spark, most):
    rows = []
    for _ in range(600):
        a = "".join(RND.choice("abé\U0001f600") for _ in range(RND.randint(0, 50)))
        b = edited(a, RND.randint(0, 5))
        rows.append((a, b) if len(a) >= len(b) else (b, a))
    df = spark.createDataFrame(rows, "a string, b string").withColumn("true", F.levenshtein("a", "b"))
    sketch = lambda c: line_dedup.count_sketch(F.col(c))
    got = df.select("true", (F.char_length("a") - F.char_length("b")).alias("longer"), line_dedup.edit_distance(F.col("a"), F.col("b"), most).alias("d"), line_dedup.trimmed(F.col("a"), F.col("b"), (16, 8, 4)).alias("m"), sketch("a").alias("x"), sketch("b").alias("y"))
    checked = got.select("true", "longer", "d", F.levenshtein("m.p", "m.t").alias("trimmed"), sum(F.bit_count(F.expr(f"x.s{i} ^ y.s{i}")) for i in range(line_dedup.SKETCH_LONGS)).alias("flips")).collect()
    assert all((r.d == r.true if r.true <= most else r.d > most) and r.trimmed == r.true and r.flips <= 2 * r.true - r.longer for r in checked)


def test_line_classes(spark):
    base = ["".join(RND.choice("abcdefgh ") for _ in range(RND.randint(20, 45))) for _ in range(30)]
    lines = [edited(RND.choice(base), RND.randint(0, 4)) for _ in range(300)]
    docs = [(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(60)]
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.kept) for r in line_dedup.line_classes(frame(spark, docs)).collect()}
    at = [(d, n, line.strip(" \t\n\x0b\f\r")) for d, t in docs for n, line in enumerate(t.split("\n"))]
    links = [(i, j) for i in range(len(at)) for j in range(i) if min(len(at[i][2]), len(at[j][2])) >= 25 and abs(len(at[i][2]) - len(at[j][2])) <= 2 and levenshtein(at[i][2], at[j][2]) <= 2]
    root = groups(len(at), links)
    assert got == {(d, n): (*at[root[i]][:2], root[i] == i) for i, (d, n, _) in enumerate(at)} and len(links) > 50
    table = frame(spark, docs + ODD).withColumn("n_chars", F.char_length("text"))
    cut = line_dedup.without_repeated_lines(table)
    assert cut.columns == table.columns and cut.count() == table.count()
    by = {r.doc_id: r for r in cut.where("doc_id < 9000").collect()}
    for d, t in docs:
        want = "\n".join(line for n, line in enumerate(t.split("\n")) if got[(d, n)][2])
        assert by[d].text == want and by[d].n_chars == len(want)
    assert line_dedup.line_classes(frame(spark, [])).count() == 0
    assert {r.text for r in cut.where("doc_id IS NULL OR doc_id = 9001").collect()} == {"no id", None}


def test_long_lines_may_differ_in_more_edits(spark):
    letters = ["abcdefgh ", "eaodt. xyz", "|%&*$#", "\u4e2d\u6587\u5b57\u7b26\u4e00\u4e8c\u4e09\u4e0a\u4e0b", "xqkz", "x"]
    base = ["".join(RND.choice(letters[i % 6]) for _ in range(RND.choice((90, 146, 152, 210, 388, 597)))) for i in range(24)]
    base += [prose(60), prose(110), "The same passage of many words. " * 9]
    lines = [edited(b, k).strip() for b in base for k in (0, 1, 2, 3, 5, 8, 14)]
    RND.shuffle(lines)
    got = {r.doc_id: r.class_doc_id for r in line_dedup.line_classes(frame(spark, list(enumerate(lines)))).collect()}
    most = lambda i, j: max(2, max(len(lines[i]), len(lines[j])) // 50)
    pairs = [(i, j, lines[i], lines[j]) for i in range(len(lines)) for j in range(i) if abs(len(lines[i]) - len(lines[j])) <= most(i, j)]
    known = spark.createDataFrame(pairs, "i int, j int, a string, b string").select("i", "j", F.levenshtein("a", "b").alias("d")).collect()
    links = [(r.i, r.j) for r in known if r.d <= most(r.i, r.j)]
    assert [got[i] for i in range(len(lines))] == groups(len(lines), links)
    assert sum(r.d > 2 for r in known if (r.i, r.j) in set(links)) > 50


def test_copies_of_short_lines(spark, tmp_path):
    docs = [(1, "Ietzte.\n\nIetzte. \nIetzte!"), (2, " \n\tIetzte.\nx"), (3, "x\n")]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.kept) for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    repeats = {(1, 2): (1, 0, False), (2, 1): (1, 0, False), (3, 0): (2, 2, False)}
    assert got == {(d, n): repeats.get((d, n), (d, n, True)) for d, t in docs for n in range(t.count("\n") + 1)}


# token records


def test_token_records(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    texts = [prose(RND.randint(0, 50)) for _ in range(40)] + [None, "", "it's 'sab we'll  \n\n x''s", "<|endoftext|>a", "é中\U0001f600 \u0085\xa0", "a" * 3000, "  ", "a\r\n b\t\tc 12½"]
    docs = [(i * 3 - 20, t) for i, t in enumerate(texts)] + [(7000, "same"), (7000, "same")]
    RND.shuffle(docs)
    to = str(tmp_path / "records")
    token_records.write(frame(spark, docs), path, to, parts=3)
    rows = token_records.placed(spark, to).orderBy("start").collect()
    library = Tokenizer.from_file(path)
    start = 0
    assert [r.doc_id for r in rows] == sorted(d for d, _ in docs)
    by = dict(docs)
    for r in rows:
        ids = [*library.encode(by[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    # The offset index finds any record alone.
    one = spark.read.parquet(f"{to}/index").where("doc_id = 7000").collect()[0]
    data = (tmp_path / "records/data" / one.file).read_bytes()
    _, _, body = next(token_records.frames(data[one.offset : one.offset + one.length]))
    assert int.from_bytes(body[:8], "little", signed=True) == 7000
    picked = spark.read.parquet(f"{to}/index").where("doc_id IN (7000, -20) OR n_tokens > 100")
    want = sorted((r.doc_id, [*library.encode(by[r.doc_id] or "", add_special_tokens=False).ids, 0]) for r in picked.collect())
    assert sorted((r.doc_id, r.ids) for r in token_records.fetch(spark, to, picked).collect()) == want and len(want) >= 3
    for damaged in (data[:-3], data[:5] + b"\xff" + data[6:], data[:20] + bytes([data[20] ^ 1]) + data[21:]):
        with pytest.raises(ValueError):
            list(token_records.frames(damaged))
    token_records.write(frame(spark, []), path, str(tmp_path / "none"))
    assert token_records.placed(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="needs a doc_id"):
        token_records.write(frame(spark, [(None, "x")]), path, str(tmp_path / "null"))


def test_wide_ids_and_bounded_files(spark, tmp_path, monkeypatch):
    """Ids of 4 bytes are read back as such, and the number of files follows the bytes of text."""
    monkeypatch.setattr(token_records, "FILE_BYTES", 500)
    assert token_records.ids_of(memoryview(b"\0" * 8 + b"\x04" + np.array([70_000, 0], dtype="<u4").tobytes())).tolist() == [70_000, 0]
    with pytest.raises(ValueError):
        token_records.ids_of(memoryview(b"\0" * 8 + b"\x03abc"))
    docs = [(1, "same words"), (2, "b")] + [(7, f"hot {k} " + prose(20)) for k in range(60)]
    to = str(tmp_path / "hot")
    token_records.write(frame(spark, docs), P.path("byte_bpe_50k.json"), to)
    rows = token_records.placed(spark, to).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [1, 2] + [7] * 60 and len({r.file for r in rows}) > 5
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]


# sharding


def test_ring(spark):
    docs = [(i, prose(RND.randint(0, 20))) for i in range(1000)] + [(None, "a"), (None, None), (5, "again"), (5, "again")]
    rows = ring.assign(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    sizes = [len(v) for v in shards.values()]
    assert len(shards) == 24 and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in shards.values())
    by = dict(docs)
    assert all(r.size == len((by[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((by[r.doc_id] or "").encode()) for r in rows if r.doc_id not in (None, 5))
    assert ring.assign(frame(spark, [])).count() == 0 and {r.shard for r in ring.assign(frame(spark, [(1, "a")])).collect()} == {0}


def test_ring_against_one_by_one():
    """The counts' allotment is what the rounds give when every key is moved by itself."""
    counts = {c: RND.randint(0, 4) for c in RND.sample(range(ring.CELLS), 200)}
    shards, points = 7, ring.points(7, 16)
    got = {}
    for s in ring.allot(counts, shards, 16):
        for k in range(s.low, s.high):
            got[(s.cell, k)] = s.shard
    room = ring.capacities(sum(counts.values()), shards)
    waiting = [((c, k), next((i for i, (p, _) in enumerate(points) if p >= c), 0)) for c in sorted(counts) for k in range(counts[c])]
    want = {}
    while waiting:
        moved = []
        for key, at in waiting:
            while room[points[at][1]] == 0:
                at = (at + 1) % len(points)
            moved.append((key, at))
        waiting = []
        for key, at in moved:
            shard = points[at][1]
            if room[shard]:
                room[shard] -= 1
                want[key] = shard
            else:
                waiting.append((key, (at + 1) % len(points)))
    assert got == want
    more = {}
    loose = {c: 50 for c in range(0, ring.CELLS, 16)}
    for n in (20, 21):
        more[n] = {(s.cell, k): s.shard for s in ring.allot(loose, n, slack=0.25) for k in range(s.low, s.high)}
    assert sum(more[20][k] != more[21][k] for k in more[20]) < 0.2 * len(more[20])


def test_one_more_shard_moves_few_rows_with_exact_loads():
    """With the query's parameters: 24 shards that differ by a row at most, then 25. An even share of the rows, 1/25, has to move; less than three of them do."""
    rnd = random.Random(1)
    counts = {c: rnd.randint(20, 40) for c in range(0, ring.CELLS, 16)}
    at = {}
    for n in (24, 25):
        shares = ring.allot(counts, n)
        at[n] = {(s.cell, k): s.shard for s in shares for k in range(s.low, s.high)}
        loads = [sum(s.high - s.low for s in shares if s.shard == x) for x in range(n)]
        assert max(loads) - min(loads) <= 1 and sum(loads) == sum(counts.values())
    moved = sum(at[24][k] != at[25][k] for k in at[24]) / len(at[24])
    assert 1 / 25 <= moved + 0.001 and moved < 3 / 25


# conversations


def test_quotes(spark):
    chat = [
        (1, 0, "user", "First point.\nSecond point."),
        (1, 1, "assistant", "Another topic."),
        (1, 2, "user", "On Monday, someone wrote:\n> First  POINT.\n\nI agree."),
        (1, 3, "assistant", ">> First point.\n> I agree.\nSo do I."),
        (1, 4, "user", "> Another topic.\nNo."),
        (1, 5, None, "> never said\nHm."),
        (1, 5, "zzz", "a repeated turn"),
        (2, 0, "user", "> First point.\nElsewhere."),
        (2, None, "user", "lost"), (None, 0, "user", "lost"), (3, 0, "user", None), (3, 1, "user", ""),
    ]
    rows = quotes.conversations(frame(spark, chat, "conv_id long, turn long, role string, text string")).collect()
    got = {(r.conv_id, r.turn): r for r in rows}
    assert {k: r.parent_turn for k, r in got.items()} == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 2, (1, 4): 1, (1, 5): None, (2, 0): None, (3, 0): None, (3, 1): None}
    assert [t for _, t in sorted((r.position, r.turn) for r in rows if r.conv_id == 1)] == [0, 2, 3, 1, 4, 5]
    assert [got[(1, t)].text for t in (2, 3, 4, 5)] == ["I agree.", "So do I.", "No.", "Hm."] and got[(1, 5)].role == "unknown"
    assert got[(1, 3)].root_turn == 0 and got[(1, 4)].root_turn == 1 and got[(3, 0)].text == ""
    assert quotes.conversations(frame(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


def quoted_parents(chat):
    """The rules one message at a time: each quoted line or passage goes to the latest earlier turn that has it one level lower."""

    def runs(text):
        out = []
        for line in text.split("\n"):
            bare, level = line, 0
            while bare.lstrip(" \t").startswith(">"):
                bare, level = bare.lstrip(" \t")[1:], level + 1
            norm = " ".join(bare.encode().lower().decode().split())
            if not out or out[-1][0] != level:
                out.append((level, []))
            if norm:
                out[-1][1].append(norm)
        return out

    seen, parents = {}, {}
    for conv, turn, _, text in sorted(chat, key=lambda r: r[:2]):
        mine = runs(text)
        lines, found = {}, {}
        for i, (level, norms) in enumerate(mine):
            for x in norms:
                lines.setdefault((level, x), i)
        earlier = [(t, r) for (c, t), r in seen.items() if c == conv]
        whole = set()
        for i, (level, norms) in enumerate(mine):
            sought = " ".join(norms)
            if level and len(sought.split(" ")) >= 5:
                from_ = [t for t, r in earlier if any(k == level - 1 and f" {sought} " in " " + " ".join(n) + " " for k, n in r)]
                if from_:
                    whole.add(i)
                    found.setdefault(max(from_), []).append((level - 1, len(set(norms))))
        for (level, x), i in lines.items():
            if level and i not in whole:
                from_ = [t for t, r in earlier if any(k == level - 1 and x in n for k, n in r)]
                if from_:
                    found.setdefault(max(from_), []).append((level - 1, 1))
        if found:
            parents[(conv, turn)] = max((sum(n for at, n in v if at == 0), sum(n for _, n in v), t) for t, v in found.items())[2]
        seen[(conv, turn)] = mine
    return parents


def test_quotes_by_brute_force(spark):
    chat = []
    for conv in range(25):
        said = []
        for turn in range(RND.randint(1, 12)):
            text = "\n".join(prose(RND.randint(1, 12)) for _ in range(RND.randint(1, 4)))
            if said and RND.random() < 0.8:
                old = RND.choice(said).split("\n")
                low = RND.randrange(len(old))
                part = old[low : low + RND.randint(1, 4)]
                if RND.random() < 0.5:  # wrapped anew, and part of it
                    words = " ".join(x.lstrip("> ") for x in part).split(" ")
                    words = words[RND.randint(0, 2) :]
                    size = RND.randint(3, 9)
                    part = [" ".join(words[k : k + size]) for k in range(0, len(words), size)]
                quote = "\n".join(("> " if RND.random() < 0.9 else ">") + x.upper() for x in part)
                text = f"{quote}\n{text}" if RND.random() < 0.7 else f"{text}\n\n{quote}\n{prose(3)}"
            said.append(text)
            chat.append((conv, turn, "user", text))
    got = {(r.conv_id, r.turn): r.parent_turn for r in quotes.parents(frame(spark, chat, "conv_id long, turn long, role string, text string")).collect()}
    want = quoted_parents(chat)
    assert got == want and len(want) > 50


# BPE


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    alphabet = "ab 'sdtrevlm'\n\t  12é́ΣİßǅﬁK中\U0001f600_-!١​\u0085\xa0\x1cẞA"
    texts = ["".join(RND.choice(alphabet) for _ in range(RND.randint(0, 40))) for _ in range(400)]
    texts += [None, "", "<|endoftext|>Hi<|startoftext|> <|endoftext|>", "it's WE'LL x''s !'s", "a" * 5000, prose(300)]
    rows = {r.doc_id: r for r in bpe.encode_decode(frame(spark, list(enumerate(texts))), path).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == want, repr(t)[:80]
    codec = bpe.codec(path)
    assert codec.decode(codec.encode("Hello there")) == library.decode(library.encode("Hello there", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.encode_decode(frame(spark, []), path).count() == 0


def test_word_table_forgets(monkeypatch):
    learnt = []
    table = W.WordTable(learnt.extend, learnt.clear, limit=3)
    for text in ("a b c d", "a b", "e e"):
        whole, codes, at = W.code_points([text])
        starts, ends = W.word_end_slices(codes, at)
        slots = table.slots(whole, codes, starts, ends)
        assert [learnt[s] for s in slots] == text.split(" ")


# licenses


def test_licenses(spark):
    texts = [
        "Released under the MIT\n# License. See Apache-License, version 2.0", "gnu general public license v3 or the GNU Lesser General Public License v2.1", "mit licenses", "SPDX-License-Identifier: BSD-3-Clause",
        "MIT license MIT License", "nothing here", None, "", "é中 a_b 1-2", "Permission is hereby granted, free of charge, to any person obtaining a copy",
    ]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        w = licenses.WORD.findall((t or "").encode().lower().decode())
        at = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min([k for k, _ in at], default=None), max([k for k, _ in at], default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[0].labels == "apache,apache-2.0,mit" and got[1].labels == "gpl,gpl-3.0,lgpl-2.1" and got[3].labels == "bsd-3-clause" and got[9].labels == "mit"
    assert licenses.scan(frame(spark, [])).count() == 0


def test_contained_detections_are_suppressed():
    labels = [d.rule.label for d in licenses.detections("under gnu affero general public license version 3", {"affero", "general", "license"})]
    assert labels == ["agpl-3.0"]


def license_words():
    """Words of rules' own phrases, so that detections are many, neighbouring and nested."""
    phrases = [
        "mit license", "apache license version 2 0", "gnu general public license", "general public license v3", "gnu affero general public license version 3", "released under the mit license", "spdx license identifier",
        "mit", "apache 2 0", "licensed under", "public domain", "placed in the public domain", "all rights reserved", "copyright c 2020", "bsd license", "3 clause bsd", "the", "under", "version 2 only", "gplv2", "gplv2 or later", "lesser general public license 2 1",
        "either version 2 1 of the license or any later version", "see the license", "creative commons attribution 4 0", "dual licensed", "under either the mit license or the apache license", "foo",
    ]
    return " ".join(RND.choice(phrases) for _ in range(RND.randint(1, 25)))


def test_rules_by_brute_force(spark):
    """Every rule on every text without the keyword gate; a detection stands unless one that goes before it, taken, holds its interval."""
    texts = [license_words() for _ in range(150)] + ["x", "license"]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, list(enumerate(texts)))).collect()}
    kept = suppressed = 0
    for i, t in enumerate(texts):
        hits = []
        for r in licenses.rules():
            for m in r.pattern.finditer(t):
                granted = "grant" in r.pattern.groupindex and m["grant"]
                hits.append((80 if granted else r.priority, m.end() - m.start(), m.start(), m.end(), 0.9 if granted else r.score, r))
        hits.sort(key=lambda h: (-h[0], -h[1], h[2], -h[4], h[5].label, h[5].name))
        taken = []
        for h in hits:
            if any(x[2] <= h[2] and h[3] <= x[3] for x in taken):
                suppressed += 1
            else:
                taken.append(h)
        base = {label for phrase, label in licenses.BASE if f" {phrase} " in f" {t} "}
        kept += len(taken)
        assert got[i].labels == ",".join(sorted(base | {h[5].label for h in taken})), t
        assert got[i].score == max([0.6 if base else 0.0, *(h[4] for h in taken)])
    assert kept > 500 and suppressed > 500


def test_license_rules_are_many_and_distinct():
    rules = licenses.rules()
    assert len(rules) > 300 and len({r.pattern.pattern for r in rules}) >= len(rules) - 3
    assert all(r.keyword == "spdx" or r.keyword in r.pattern.pattern for r in rules)


# quality


def test_quality(spark):
    good = [(i, 1, ". ".join(prose(8).capitalize() for _ in range(RND.randint(2, 30)))) for i in range(300)]
    bad = [(1000 + i, 0, " | ".join(f"{w.upper()}!!" for w in prose(RND.randint(20, 200)).split())) for i in range(200)]
    rows = good + bad
    docs = frame(spark, [(i, t) for i, _, t in rows] + ODD)
    labels = frame(spark, [(i, y) for i, y, _ in rows] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None) and got[None].held_out
    held = [(i, y) for i, y, _ in rows if got[i].held_out]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(quality.fit(docs, flipped).means, model.means)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in quality.score(docs, model).collect())
    none = quality.fit(docs, frame(spark, [], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5} and quality.score(frame(spark, []), none).count() == 0


def test_scores_are_those_of_the_densities(spark):
    """The score worked out from the classes' full covariances by determinant and inverse, with neither moments nor factors."""
    rows = [(i, i % 2, (". " if i % 2 else " | ").join(prose(RND.randint(1, 12)) for _ in range(RND.randint(1, 20)))) for i in range(400)]
    docs = frame(spark, [(i, t) for i, _, t in rows])
    labels = frame(spark, [(i, y) for i, y, _ in rows], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    seen = [(y, t) for i, y, t in rows if zlib.crc32(str(i).encode()) % 5]
    x = [np.array([quality.features([t])[0] for y, t in seen if y == k]) for k in (0, 1)]
    spread = [np.cov(c.T, bias=True) for c in x]
    pooled = sum(len(c) * s for c, s in zip(x, spread)) / len(seen)
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    density = []
    for c, s in zip(x, spread):
        v = 0.85 * s + 0.1 * pooled + 0.05 * (np.diag(np.diag(s)) + 0.1 * scale) + 1e-4 * scale
        inverse, (_, logdet) = np.linalg.inv(v), np.linalg.slogdet(v)
        density.append(lambda z, m=c.mean(axis=0), inverse=inverse, logdet=logdet, n=len(c): np.log(n / len(seen)) - 0.5 * (z - m) @ inverse @ (z - m) - 0.5 * logdet)
    for i, _, t in rows[:60]:
        z = quality.features([t])[0]
        gap = np.clip(density[1](z) - density[0](z), -500, 500)
        assert abs(got[i] - 1 / (1 + np.exp(-gap))) < 1e-4


def test_quality_handles_repeated_rows_and_clashes(spark):
    docs = frame(spark, [(1, "a b c"), (1, "a b c"), (2, None)]).withColumns({c: F.lit(1.5) for c in ("score", "held_out", "predicted", "quality")})
    labels = frame(spark, [(1, 1), (1, 0), (2, 0)], "doc_id long, quality int").withColumn("text", F.lit("not this"))
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).count() == 3 and quality.accepted(docs, model).columns == docs.columns


# shared parts


def test_components(spark):
    n = 200
    edges = [(RND.randrange(n), RND.randrange(n)) for _ in range(120)] + [(i, i + 1) for i in range(n, n + 60)] + [(400, i) for i in range(401, 460)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect()}
    root = groups(500, edges)
    assert got == {i: root[i] for i in {x for e in edges if e[0] != e[1] for x in e}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_folder_is_the_session_s(spark):
    assert store.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")
