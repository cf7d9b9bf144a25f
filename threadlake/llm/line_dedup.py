"""Line near-duplicates within a few edits, by chunks of content and the segment-partition edit join.

Two lines are linked if few insertions, deletions and substitutions of characters
turn one into the other: one for each CHARS_AN_EDIT characters of the longer line,
and EDITS at least.

A line is cut at the blanks behind some letters. Where a cut is depends on two
neighbouring characters, so an edit changes two chunks of a line at most: of lines
within k edits, each has all but 2k of its chunks in common with the other. So they
meet in the first 2k + 1 chunks of each by any common order; the longest come first,
as they are the rarest, and each takes in the beginning of the next. If neither has
more than 2k chunks that are long enough, they may share none:

* lines with no more edits than EDITS are cut into EDITS + 1 segments. A line within
  EDITS edits holds one of them unchanged, near its place. So every line is indexed
  by (its length, segment number, segment) and probes, for each length up to EDITS
  shorter than its own, the substrings at which a segment can stand (left and right
  shifts together stay within EDITS).
* longer ones are cut again at every blank, and if that is too few, too, behind each of
  many characters. Those with too few chunks even so, such as runs of one character,
  meet all such lines of about their length.

Pairs that meet are verified by banded edit distance, up to EDITS bit-parallel: a
column of the band is a word of 2 EDITS + 2 bits, and a step is a few additions and shifts.

Copies of a line are one node, and only the first is indexed (where very many lines have
copies, of those with the most). A key's members are tried against a pivot, TURNS times, and each key draws its
own: where many lines are near, most are linked to some pivot. Keys that then still hold
several components are tried across them, so no link is missed. Before a pair becomes a row,
a sketch of character counts must allow it: characters are counted in 40 classes (frequent
letters one by one, the rest by the low bits of their code points), each count is a cyclic
code that changes one bit a step, and an edit changes two counts by one at most, so
sketches of lines within k edits differ in 2k bits at most, less the difference of their
lengths, as an insertion or deletion changes one count. All of it is DataFrame functions.

Lines of fewer than MIN_CHARS characters, white space around them not counted,
are too short for a fixed number of edits to mean likeness; no edits link them.
Their exact copies are one class from copies_from characters on: by default
MIN_CHARS, so that they are always kept; the queries and the pipeline take
every line that isn't blank (NOT_BLANK).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.llm import store
from threadlake.llm import text_sql as T
from threadlake.llm.components import components

EDITS = 2
#: Longer lines may differ in one edit for so many characters.
CHARS_AN_EDIT = 50
#: Cuts depend on two neighbouring characters; the second pattern is for long lines that the first leaves with few chunks.
CHUNKS = r"(?<=[eaodt.,]) "
_STRIPES = [(at, at + size - 1) for begin, end, step, size in ((0x80, 0x700, 32, 4), (0x3040, 0x3100, 32, 4), (0x4E00, 0xA000, 256, 32), (0xAC00, 0xD7A4, 256, 32)) for at in range(begin, end, step)]
FINE_CHUNKS = "(?<=[ea|%13579" + "".join(f"\\u{x:04x}-\\u{y:04x}" for x, y in _STRIPES) + "])"
MIN_CHARS = 25
#: For copies_from: exact copies of all lines but blank ones are one class.
NOT_BLANK = 1
#: Characters of the next chunk that a piece takes in, and of the next word.
AHEAD, WORD_AHEAD = 6, 4
#: Characters that are counted one by one; those of the rest that agree in the low four bits of their code points are counted together.
SINGLES = " abcdefghiklmnoprstuvwyA"
SKETCH_LONGS = (len(SINGLES) + 16) // 8
#: Numbers of copies are told apart up to the first; a line with more than one in HOT_LINES of all lines is indexed by its first copy alone in any case.
COPIES_TOLD, HOT_LINES = 1024, 100_000
#: So many times the members of a key are tried with one of them, before what is left is tried across components.
TURNS = 2
#: At most so many rows of a few numbers are broadcast, and of one number.
BROADCAST_ROWS, BROADCAST_KEYS = 500_000, 2_000_000


def _bounded(saved: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(saved) if saved.count() <= most else saved


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once: inside a lambda, an expression would be for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def edit_distance(pattern: Column, text: Column, most: int = EDITS) -> Column:
    """The edit distance of two strings if it is at most `most`, else a larger number.

    pattern must not be shorter than text. Bit b of a word stands for the pattern's
    character i - most - 1 + b in column i; vp and vn hold where the distance grows
    or falls from one row of the band to the next.
    """
    width = 2 * most + 2
    full = (1 << width) - 1
    m, n = F.char_length(pattern), F.char_length(text)
    chars = F.struct(F.split(pattern, "").alias("p"), F.split(text, "").alias("t"), (m - most).alias("last"))

    def columns(s: Column) -> Column:
        """For each column: which of the band's characters equal the text's, and which bit is followed once the band has left the pattern's end."""

        def of(c: Column, i: Column) -> Column:
            bits = []
            for b in range(width):
                at = i + (b - most - 1)
                same = F.get(s["p"], at) == c if b > most else F.when(at >= 0, F.get(s["p"], at) == c)
                bits.append(F.when(same, 1 << b).otherwise(0))
            eq = bits[0]
            for x in bits[1:]:
                eq = eq.bitwiseOR(x)
            return eq + F.when(i < s["last"], 0).otherwise((i - s["last"] + 1) * (full + 1))

        return F.transform(s["t"], of)

    def step(s: Column, packed: Column) -> Column:
        eq = packed.bitwiseAND(F.lit(full))
        beyond = F.shiftright(packed, width)
        d0 = (eq.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(eq).bitwiseOR(s["vn"]).bitwiseAND(F.lit(full))

        def with_d0(d: Column) -> Column:
            rest = F.bitwise_not(d.bitwiseOR(s["vp"])).bitwiseAND(F.lit(full))
            hp = s["vn"].bitwiseOR(rest)
            hn = d.bitwiseAND(s["vp"])
            down = F.shiftright(d, 1)
            vp = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(F.lit(full)))
            # Beyond the pattern's end its last row moves up through the band, a bit a column.
            followed = F.lit(width - 1) - beyond
            moved = F.expr("0") + F.when(beyond == 0, F.when(d.bitwiseAND(F.lit(1 << (width - 1))) == 0, 1).otherwise(0)).otherwise(
                F.getbit(hp, followed).cast("int") - F.getbit(hn, followed).cast("int")
            )
            return F.struct(vp.alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["d"] + moved).alias("d"))

        return _let(d0, with_d0)

    start = F.struct(F.lit(full & ~((1 << (most + 1)) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(most).alias("d"))
    inside = _let(chars, lambda s: F.aggregate(columns(s), start, step, lambda x: x["d"]))
    return F.when(m - n > most, m - n).when(n <= most, F.levenshtein(pattern, text)).otherwise(inside)


def trimmed(p: Column, t: Column, sizes: tuple[int, ...] = tuple(1 << k for k in range(16, 2, -1))) -> Column:
    """p and t without most of the beginning and end that they share, which changes no edit distance."""

    def step(s: Column, k: Column) -> Column:
        front = (F.char_length(s["t"]) >= k) & (F.left(s["p"], k) == F.left(s["t"], k))
        cut = lambda x: F.when(front, F.right(x, F.char_length(x) - k)).otherwise(x)
        return _let(F.struct(cut(s["p"]).alias("p"), cut(s["t"]).alias("t")), lambda r: back(r, k))

    def back(s: Column, k: Column) -> Column:
        end = (F.char_length(s["t"]) >= k) & (F.right(s["p"], k) == F.right(s["t"], k))
        cut = lambda x: F.when(end, F.left(x, F.char_length(x) - k)).otherwise(x)
        return F.struct(cut(s["p"]).alias("p"), cut(s["t"]).alias("t"))

    return F.aggregate(F.array(*map(F.lit, sizes)), F.struct(p.alias("p"), t.alias("t")), step)


def keys(line: str = "wide", length: str = "n", edits: int = EDITS) -> Column:
    """The keys of a line's index entries (the first edits + 1) and then of its probes, as an array of longs.

    line is the line in UTF-32: with four bytes to every character, a substring is
    cut out without a walk to where it begins.

    Segment i of a line of n characters starts at i (n div parts), and the last
    n mod parts segments have a character more.
    """
    parts = edits + 1
    index = [(0, i, 0) for i in range(parts)]
    probes = [
        (shorter, i, shift)
        for shorter in range(parts)
        for i in range(parts)
        for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1)
        if shorter or shift  # else it is the line's own index entry
    ]
    # A fold over a constant list: spelled out, the keys' code is too long a method for the JVM to compile.
    places = F.array(*[F.struct(F.lit(a).alias("shorter"), F.lit(i).alias("i"), F.lit(d).alias("shift")) for a, i, d in index + probes])

    def key(k: Column) -> Column:
        n = F.col(length) - k["shorter"]
        more = n % parts
        short = ((n - more) / parts).cast("int")
        begin = short * k["i"] + F.greatest(F.lit(0), k["i"] - parts + more) + k["shift"]
        size = short + F.when(more >= F.lit(parts) - k["i"], 1).otherwise(0)
        return F.xxhash64(n, k["i"], F.substring(line, begin * 4 + 1, size * 4))

    return F.transform(places, key)


def count_sketch(line: Column) -> Column:
    """Five longs: for each class of characters, 8 bits whose pattern moves by one bit as the class's count grows by one."""
    times = lambda s, c: (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(c), F.lit("")))).cast("int")
    rest = F.translate(line, SINGLES, "")
    digits = F.regexp_replace(F.hex(F.encode(rest, "UTF-32")), ".......(.)", "$1")
    # The count k mod 16 as a cyclic code: k ones from below up to 8, then ones vanish from below.
    codes = F.array(*[F.lit((1 << k) - 1 if k <= 8 else 255 & ~((1 << (k - 8)) - 1)).cast("long") for k in range(16)])

    def packed(counts: list[Column]) -> Column:
        out = F.get(codes, counts[0] % 16)
        for c in counts[1:]:
            out = F.shiftleft(out, 8).bitwiseOR(F.get(codes, c % 16))
        return out

    def of(s: Column) -> Column:
        counts = [times(s["line"], c) for c in SINGLES] + [times(s["digits"], c) for c in "0123456789ABCDEF"]
        return F.struct(*[packed(counts[i * 8 : i * 8 + 8]).alias(f"s{i}") for i in range(SKETCH_LONGS)])

    return _let(F.struct(line.alias("line"), digits.alias("digits")), of)


def edits_of(n: Column, edits: int = EDITS) -> Column:
    """How many edits link a line of n characters to one that isn't longer."""
    return F.greatest(F.lit(edits), F.floor(n / CHARS_AN_EDIT).cast("int"))


def near_length(n: Column, edits: int = EDITS) -> Column:
    """A number for the length, which differs by one at most between linked lines."""
    flat = CHARS_AN_EDIT * (edits + 1)  # shorter lines have the least number of edits
    ratio = math.log(CHARS_AN_EDIT / (CHARS_AN_EDIT - 1)) * 1.005
    return F.when(n < flat, F.floor(n / (edits + 1))).otherwise(CHARS_AN_EDIT + F.floor(F.log(n / flat) / ratio)).cast("int")


def chunk_keys(chunks: Column, most: Column, ahead: int = 0) -> Column:
    """(keys, few): the first so many pieces, the longest first, as longs of length and 48 bits of hash; whether there are fewer.

    With ahead, a piece is a chunk of more characters than that, together with so many
    characters of the next chunk: an edit near the end of a chunk changes it and the one
    behind, an edit near its beginning the one before and it, so still two pieces at most.
    """
    beyond = -(ahead << 48) if ahead else 0  # the keys of chunks that are long enough are less

    def key(c: Column, i: Column) -> Column:
        seen = F.xxhash64(c, F.substring(F.coalesce(F.get(chunks, i + 1), F.lit("")), 1, ahead)) if ahead else F.xxhash64(c)
        return F.shiftleft(-F.least(F.char_length(c), F.lit(32_767)).cast("long"), 48).bitwiseOR(seen.bitwiseAND(F.lit((1 << 48) - 1)))

    def first(x: Column) -> Column:
        few = F.coalesce(F.get(x, most - 1) >= F.lit(beyond), F.lit(True))
        return F.struct(F.array_distinct(F.filter(F.slice(x, F.lit(1), most), lambda k: k < F.lit(beyond))).alias("keys"), few.alias("few"))

    return _let(F.sort_array(F.transform(chunks, key)), first)


#: The low bits of an entry.
_CHUNK, _SEGMENT, _PROBE = 0, 1, 2


def entries(form: str = "form", wide: str = "wide", length: str = "n", edits: int = EDITS) -> Column:
    """All keys under which a line meets others, as an array of longs.

    The low two bits tell what an entry is. Lines that have a chunk's key meet if their
    near_length() differs by one at most. The key of a segment has the length in it, and one of
    the two lines is to have it as an index entry, not as a probe.
    """
    n = F.col(length)
    flat = CHARS_AN_EDIT * (edits + 1)
    # The most edits to a line that is longer: (n + k) div CHARS_AN_EDIT = k at the most.
    most = 2 * F.greatest(F.lit(edits), F.floor(n / (CHARS_AN_EDIT - 1)).cast("int")) + 1
    none = F.array().cast("array<bigint>")
    marked = lambda key, bits: key.bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(bits))
    salted = lambda keys, salt: F.transform(keys, lambda k: marked(k.bitwiseXOR(F.lit(salt)), _CHUNK))
    segments = F.transform(keys(wide, length, edits), lambda k, i: marked(k, _PROBE) - F.when(i <= edits, _PROBE - _SEGMENT).otherwise(0))
    same_length = F.array(*[marked(F.xxhash64(F.lit("length"), near_length(n, edits) + d), _SEGMENT) for d in (0, 1)])

    def cut(chunks: Column, ahead: int, salt: int, further: Column) -> Column:
        """The keys of the chunks, and those of `further` if they are too few."""
        return _let(chunk_keys(chunks, most, ahead), lambda f: F.when(f["few"], F.concat(salted(f["keys"], salt), further)).otherwise(salted(f["keys"], salt)))

    fine = _let(F.filter(F.split(form, FINE_CHUNKS), lambda c: c != ""), lambda c: cut(c, 0, 4, same_length))
    words = _let(F.split(form, " "), lambda c: cut(c, WORD_AHEAD, 8, fine))
    finer = F.concat(F.when(n < flat, segments).otherwise(none), F.when(n >= flat - edits - 1, words).otherwise(none))
    return _let(F.split(form, CHUNKS), lambda c: cut(c, AHEAD, 0, finer))


def _allowed(x: str, y: str, edits: int) -> Column:
    most = edits_of(F.greatest(f"{x}.n", f"{y}.n"), edits)
    flips = sum((F.bit_count(F.col(f"{x}.s.s{i}").bitwiseXOR(F.col(f"{y}.s.s{i}"))) for i in range(SKETCH_LONGS)), F.lit(0))
    longer = F.abs(F.col(f"{x}.n") - F.col(f"{y}.n"))
    return (longer <= most) & (flips <= 2 * most - longer)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), form (without white space around), n (characters), k1, k2 (128 bits of hash)."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))
    form = each.select("doc_id", "line_no", F.btrim("line", F.lit(T.BLANKS)).alias("form"))
    return form.select("doc_id", "line_no", "form", F.char_length("form").alias("n"), F.xxhash64("form").alias("k1"), F.xxhash64(F.lit("line"), "form").alias("k2"))


def forms(docs: DataFrame) -> DataFrame:
    """One row for each different line: k1, k2, n, size (its copies), first (doc_id and line_no of the first)."""
    each = lines(docs).select("doc_id", "line_no", "n", "k1", "k2")
    return each.groupBy("k1", "k2").agg(F.min("n").alias("n"), F.count("*").alias("size"), F.min(F.struct("doc_id", "line_no")).alias("first"))


def _indexed_lines(docs: DataFrame, of: DataFrame, min_chars: int) -> DataFrame:
    """Lines of min_chars or more; of those with copies, only the first.

    Copies are one node, so their keys say nothing new. The firsts are broadcast, so where there are more than
    BROADCAST_ROWS, those with the most copies are.
    """
    copied = of.where((F.col("n") >= min_chars) & (F.col("size") > 1))
    each = copied.groupBy(F.least("size", F.lit(COPIES_TOLD)).alias("copies")).agg(F.count("*").alias("n"), F.sum("size").alias("lines")).collect()
    least, held = None, 0
    for r in sorted(each, key=lambda r: -r["copies"]):
        held += r["n"]
        if held > BROADCAST_ROWS:
            break
        least = r["copies"]
    if least is None:
        least = max(COPIES_TOLD, sum(r["lines"] for r in each) // HOT_LINES)  # so there are HOT_LINES of them at most
    hot = copied.where(F.col("size") >= least).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), "first")
    long = lines(docs).where(F.col("n") >= min_chars)
    copy = (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")) & ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no")))
    return long.join(F.broadcast(hot), copy, "left_anti")


#: A cell is so many lengths.
CELL = 4


def _cell(b: Column) -> Column:
    return F.floor(b / CELL).cast("int")


def _cells(rows: DataFrame) -> DataFrame:
    """The rows, each once for every cell where members of about its length stand, one or two; a segment's key has the length in it."""
    b = F.col("b")
    return rows.withColumn("at", F.explode(F.when(b < 0, F.array(_cell(b))).otherwise(F.array_distinct(F.array(_cell(b - 1), _cell(b + 1))))))


def links(docs: DataFrame, of: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """k1, k2, component of the different lines that links join; components are numbers of no meaning. of is forms(docs), saved; so is the result, and what was written for it goes."""
    long = _indexed_lines(docs, of, min_chars)
    wide = F.when(F.col("n") < CHARS_AN_EDIT * (edits + 1), F.encode("form", "UTF-32")).alias("wide")
    spread = long.select("k1", "n", "form", wide).select("k1", near_length(F.col("n"), edits).alias("b"), F.explode(entries(edits=edits)).alias("e"))
    kind = F.col("e").bitwiseAND(F.lit(3))
    # Keys of chunks are even and those of segments odd.
    entry = spread.select("k1", F.col("e").bitwiseAND(F.lit(-4)).bitwiseOR(F.when(kind == _CHUNK, 0).otherwise(1)).alias("key"), F.when(kind == _CHUNK, F.col("b")).otherwise(-1).alias("b"), (kind != _PROBE).alias("indexed"))
    near = Window.partitionBy("key").orderBy("b").rangeBetween(-1, 1)
    met = entry.select("*", F.max("indexed").over(near).alias("found"), F.min("k1").over(near).alias("least"), F.max("k1").over(near).alias("most"))
    shared = store.saved(met.where("found AND least <> most").select("key", "k1", "b", "indexed").distinct(), "shared")
    nodes = store.saved(shared.select("k1").distinct(), "nodes")
    # Lines that differ may have k1 in common, so a node is a number for (k1, k2) from here on.
    text = long.select("k1", "k2", "form", "n").join(_bounded(nodes, BROADCAST_KEYS), "k1").groupBy("k1", "k2").agg(F.min(F.struct("form", "n")).alias("t"))
    texts = store.saved(text.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "t.form", "t.n", count_sketch(F.col("t.form")).alias("s")), "texts")
    # Most keys are shared by chance. What no other line of a key comes near goes before all else, and leaves no pairs.
    every = shared.join(_bounded(texts.select("k1", "id", "n", "s")), "k1").drop("k1")
    in_cell = lambda rows: rows.withColumn("at", _cell(F.col("b")))
    beside = F.abs(F.col("x.b") - F.col("y.b")) <= 1
    near_by = (F.col("x.key") == F.col("y.key")) & (F.col("x.at") == F.col("y.at")) & beside & _allowed("x", "y", edits)
    other = (F.col("x.id") != F.col("y.id")) & (F.col("x.indexed") | F.col("y.indexed"))
    beside_another = lambda rows, how: in_cell(rows).alias("x").join(_cells(rows).alias("y"), how & other, "left_semi").drop("at")
    members = store.saved(beside_another(every, near_by), "members")
    store.drop(shared, nodes)

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = texts.select(F.col("id").alias("a"), F.struct("n", "form").alias("x")), texts.select(F.col("id").alias("b"), F.struct("n", "form").alias("y"))
        middle = trimmed(F.greatest("x", "y")["form"], F.least("x", "y")["form"])
        most = edits_of(F.greatest("x.n", "y.n"), edits)
        within = lambda s: F.when(most == edits, edit_distance(s["p"], s["t"], edits) <= edits).otherwise(F.call_function("levenshtein", s["p"], s["t"], most) >= 0)
        return store.saved(pairs.join(x, "a").join(y, "b").where(_let(middle, within)).select("a", "b"), "links")

    pair = [F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")]
    meet = near_by & (F.col("x.c") != F.col("y.c"))
    tried = joined = None
    tries: list[DataFrame] = []
    open_ = members.withColumn("c", F.col("id"))
    for turn in range(TURNS):
        # Each key has a pivot of its own, so a member that meets others in many keys is tried with many of them.
        order = F.struct(F.xxhash64("key", "id", F.lit(turn)).alias("order"), "id", "n", "s", "c")
        pivots = open_.where("indexed").groupBy("key", "b").agg(F.min(order).alias("p")).select("key", "b", "p.id", "p.n", "p.s", "p.c")
        x, y = in_cell(open_).alias("x"), _cells(pivots).alias("y")
        fresh = x.join(y, meet).select(*pair).distinct()
        fresh = store.saved(fresh if tried is None else fresh.join(tried, ["a", "b"], "left_anti"), "tried")
        tries.append(fresh)
        tried = fresh if tried is None else tried.unionByName(fresh)
        new = verified(fresh)
        joined = components(new if joined is None else joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new))
        placed = members.join(_bounded(joined.withColumnRenamed("node", "id")), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        before, open_ = open_, store.saved(beside_another(placed, meet), "open")
        store.drop(new, *([before] if turn else []))
    store.drop(members)
    # What is left of a key in several components, across them. A pair that meets in several keys is tried in the
    # smallest that the first line is indexed by, so there is a row for each pair, not for each key that it shares.
    keyed = open_.groupBy("id").agg(F.collect_set(F.when(F.col("indexed"), F.col("key"))).alias("own"), F.collect_set("key").alias("every"))
    keyed = keyed.select("id", "own", F.when(F.size("every") > F.size("own"), F.col("every")).alias("every"))  # no more than a line's entries
    held = store.saved(open_.join(keyed, "id"), "held")
    store.drop(open_)
    x, y = in_cell(held.where("indexed")).alias("x"), _cells(held).alias("y")
    all_of = lambda side: F.coalesce(F.col(f"{side}.every"), F.col(f"{side}.own"))
    first = F.array_min(F.array_intersect(F.col("x.own"), all_of("y"))) == F.col("x.key")
    once = (F.col("x.id") < F.col("y.id")) | ~F.arrays_overlap(F.col("y.own"), all_of("x"))
    crossing = store.saved(x.join(y, meet & first & once).select(*pair).distinct().join(tried, ["a", "b"], "left_anti"), "crossing")
    if crossing.take(1):
        joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified(crossing)))
    out = store.saved(texts.select("id", "k1", "k2").join(joined.withColumnRenamed("node", "id"), "id").select("k1", "k2", "component"), "linked")
    store.drop(texts, held, crossing, *tries)
    return out


def _repeated(docs: DataFrame, edits: int, min_chars: int, copies_from: int) -> DataFrame:
    """k1, k2, class_doc_id, class_line_no of the lines that have a copy or a link, saved."""
    of = store.saved(forms(docs), "forms")
    linked = links(docs, of, edits, min_chars)
    wanted = of.where(F.col("n") >= copies_from)
    joined = wanted.join(_bounded(linked), ["k1", "k2"]).select("k1", "k2", "component", "first")
    firsts = joined.groupBy("component").agg(F.min("first").alias("class"))
    classed = joined.join(firsts, "component").select("k1", "k2", "class")
    copies = wanted.where("size > 1").join(_bounded(linked), ["k1", "k2"], "left_anti").select("k1", "k2", F.col("first").alias("class"))
    out = store.saved(classed.unionByName(copies).select("k1", "k2", F.col("class.doc_id").alias("class_doc_id"), F.col("class.line_no").alias("class_line_no")), "repeated")
    store.drop(of, linked)
    return out


def line_classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, copies_from: int = MIN_CHARS) -> DataFrame:
    """One row for each line of docs (doc_id, text): doc_id, line_no, class_doc_id, class_line_no, kept.

    A class is all lines that links reach from one another, or all copies of a line of copies_from characters or more; it is named by its first
    line, by doc_id (null first) and line number, and only that one is kept. Lines end at
    a line feed; a null text has no lines, an empty one has one empty line. Lines that
    share doc_id and line_no with the first of their class, in repeated rows, are all
    kept: they can't be told apart. Other columns are left out; an empty table gives no rows.
    """
    repeated = _repeated(docs, edits, min_chars, copies_from).withColumn("classed", F.lit(True))
    each = lines(docs).select("doc_id", "line_no", "k1", "k2").join(_bounded(repeated), ["k1", "k2"], "left")
    alone = F.col("classed").isNull()
    return each.select(
        "doc_id",
        "line_no",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_doc_id")).alias("class_doc_id"),
        F.when(alone, F.col("line_no")).otherwise(F.col("class_line_no")).alias("class_line_no"),
        (alone | (F.col("class_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("class_line_no") == F.col("line_no")))).alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, copies_from: int = MIN_CHARS) -> DataFrame:
    """The rows of docs with every line that isn't kept taken out of text; n_chars follows, other columns stay.

    A row without a doc_id keeps its text, and a null text stays null. A document may end
    up empty; its row stays. Rows that share a doc_id lose the same line numbers. Columns
    of any name may stand beside; an empty table gives no rows.
    """
    gone = line_classes(docs, copies_from=copies_from).where("NOT kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("line_no").alias("lines"))
    name = store.free_name(docs)
    gone = store.saved(gone.select(F.struct("doc_id", "lines").alias(name)), "gone-lines")
    joined = docs.join(_bounded(gone), F.col("doc_id").cast("long") == F.col(f"{name}.doc_id"), "left")
    all_lines = F.split(F.col("text").cast("string"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(f"{name}.lines"))
    cut = F.array_join(_let(all_lines, lambda x: F.transform(left, lambda i: F.get(x, i))), "\n")
    touched = F.col(name).isNotNull() & F.col("text").isNotNull()
    out = joined.withColumn("text", F.when(touched, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(touched, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
