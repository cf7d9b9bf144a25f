"""Chat formatting by quotation linking.

A message's leading '>' marks give each line a quote level. Lines of level 0 are
the message's own words; runs of quoted lines of one level are passages of earlier
messages. Lines and passages are normalised (white space collapsed, A-Z
lower-cased) and hashed, and joined within their conversation to the latest earlier
message that wrote or itself quoted them at a level lower by one, so nested quotes
count for whom they were taken from:

* a quoted line to a whole line with the same hash;
* a passage of RUN words or more to a run of lines in which its words stand one
  after another, wherever lines break: the hash of its first RUN words is joined to
  those of all runs of RUN words, and the whole passage is then looked for.

The message that most quoted lines of the lowest level lead to is the parent (a
passage counts as its lines); among equals, the one that most lines of any level
lead to, then the latest.

A message without a linked quotation starts a thread. A conversation is ordered
by thread (by the turn of its first message), then by turn, so a reply follows
what it replies to; its text is given without quotes and attribution lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.llm import store
from threadlake.llm import text_sql as T

#: Words of a passage's beginning that are hashed.
RUN = 5
_MARKS = r"^(?:[ \t]*>)+"
_ATTRIBUTION = r"(?i)^[ \t]*(?:on .* wrote|.* (?:wrote|writes|said)) *:[ \t]*$"


def quote_level(line: Column) -> Column:
    """How many '>' marks lead a line."""
    return F.char_length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), r"[ \t]", ""))


def normalised(line: Column) -> Column:
    bare = F.regexp_replace(line, _MARKS, "")
    return F.btrim(F.regexp_replace(T.ascii_lower(bare), r"[\x20\x09-\x0D]+", " "), F.lit(" "))


def _lines(messages: DataFrame) -> DataFrame:
    """One row for each line: conv_id, turn, no, level, first (number of the first line of its run of one level), norm, h (null for blank lines).

    Runs are told by the changes of level in a message, an array of its lines; no window over the conversation.
    """
    parts = messages.select("conv_id", "turn", F.split("text", "\n").alias("parts"))
    leveled = parts.select("conv_id", "turn", "parts", F.transform("parts", quote_level).alias("levels"))
    begins = F.filter(F.sequence(F.lit(0), F.size("levels") - 1), lambda i: (i == 0) | (F.get("levels", i) != F.get("levels", i - 1)))
    runs = leveled.select("conv_id", "turn", "parts", "levels", begins.alias("begins"))
    numbered = runs.select("conv_id", "turn", "parts", "levels", F.col("begins").alias("all"), F.posexplode("begins").alias("k", "first"))
    end = F.coalesce(F.get("all", F.col("k") + 1), F.size("parts")) - 1
    each = numbered.select("conv_id", "turn", "first", F.get("levels", F.col("first")).alias("level"), F.explode(F.transform(F.sequence(F.col("first"), end), lambda i: F.struct(i.alias("no"), F.get("parts", i).alias("line")))).alias("x"))
    out = each.select("conv_id", "turn", F.col("x.no").alias("no"), "level", "first", normalised(F.col("x.line")).alias("norm"))
    return out.withColumn("h", F.when(F.octet_length("norm") > 0, F.xxhash64("norm")))


def _latest(marks: DataFrame, keys: list[str], source: Column) -> DataFrame:
    """marks with the greatest source of the turns before theirs that share the keys."""
    before = Window.partitionBy("conv_id", *keys).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return marks.withColumn("source", F.max(source).over(before))


def _by_line(lines: DataFrame) -> DataFrame:
    """conv_id, turn, source, at, first (the line's passage), n of the quoted lines that stand whole in an earlier turn."""
    each = lines.where("h IS NOT NULL").groupBy("conv_id", "turn", "level", "h").agg(F.min("first").alias("first"))
    # A line at level k of turn t can be taken from one at level k - 1 of a turn before t: the last such turn is carried forward.
    marks = each.select("conv_id", "h", F.col("level").alias("at"), "turn", F.lit(None).cast("int").alias("first")).unionByName(
        each.where("level > 0").select("conv_id", "h", (F.col("level") - 1).alias("at"), "turn", "first")
    )
    placed = _latest(marks, ["h", "at"], F.when(F.col("first").isNull(), F.col("turn")))
    return placed.where("first IS NOT NULL AND source IS NOT NULL").select("conv_id", "turn", "source", "at", "first", F.lit(1).cast("long").alias("n"))


def _by_passage(lines: DataFrame) -> DataFrame:
    """The same of the passages that stand in an earlier turn, n being their lines. Conversations without a quotation aren't looked at."""
    quoting = lines.where("level > 0").select("conv_id").distinct()
    runs = lines.join(quoting, "conv_id", "left_semi").where("h IS NOT NULL").groupBy("conv_id", "turn", "level", "first")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "norm"))), lambda x: x["norm"]), " ")
    passages = store.saved(runs.agg(said.alias("said"), F.count_distinct("h").alias("n")), "passages")
    words = F.split("said", " ")
    asks = passages.where((F.col("level") > 0) & (F.size(words) >= RUN)).select("conv_id", "turn", (F.col("level") - 1).alias("at"), "first", "n", F.col("said").alias("sought"), F.xxhash64(*[F.get(words, F.lit(k)) for k in range(RUN)]).alias("h"))
    told = passages.select("conv_id", F.col("turn").alias("source"), F.col("level").alias("at"), "said", F.explode(F.array_distinct(T.shingle_hashes(words, RUN))).alias("h"))
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    there = (F.col("source") < F.col("turn")) & F.contains(pad("said"), pad("sought"))
    return asks.join(told, ["conv_id", "at", "h"]).where(there).groupBy("conv_id", "turn", "at", "first", "n").agg(F.max("source").alias("source")).select("conv_id", "turn", "source", "at", "first", "n")


def parents(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, n_lines (quoted lines that led there) of the messages with a linked quotation."""
    lines = store.saved(_lines(messages), "lines")
    whole = _by_passage(lines)
    # The lines of a passage that was found as a whole don't count once more.
    single = _by_line(lines).join(whole.select("conv_id", "turn", "first"), ["conv_id", "turn", "first"], "left_anti")
    votes = whole.unionByName(single).groupBy("conv_id", "turn", "source").agg(F.sum(F.when(F.col("at") == 0, F.col("n")).otherwise(0)).alias("direct"), F.sum("n").alias("n"))
    best = F.max(F.struct("direct", "n", "source")).alias("best")
    return votes.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", F.col("best.source").alias("parent_turn"), F.col("best.n").alias("n_lines"))


def _roots(links: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn for every linked message, by pointer doubling; each round is written to the shared folder."""
    now = store.saved(links.select("conv_id", "turn", F.col("parent_turn").alias("root_turn")), "roots")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"))
        moved = store.saved(now.join(up, ["conv_id", "root_turn"], "left").select("conv_id", "turn", F.coalesce("higher", "root_turn").alias("root_turn"), F.col("higher").isNotNull().alias("moved")), "roots")
        now = moved.drop("moved")
        if not moved.where("moved").take(1):
            return now


def conversations(messages: DataFrame) -> DataFrame:
    """One row for each message, in reply order: conv_id, position, turn, role, parent_turn, root_turn, n_quoted, text, formatted.

    messages has conv_id, turn, role, text; other columns are left out. A null text
    counts as empty, a null role as "unknown". A row without conv_id or turn has no
    place in a conversation and is left out. Of rows that share conv_id and turn,
    one stays, the least by role and text. Quotation marks in a message that link
    to nothing are taken out all the same. An empty table gives no rows. A conversation's
    order is a window over its messages, whose texts stay outside it.
    """
    clean = (
        messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
        .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .groupBy("conv_id", "turn")
        .agg(F.min(F.struct("role", "text")).alias("m"))
        .select("conv_id", "turn", "m.role", "m.text")
    )
    clean = store.saved(clean, "messages")
    linked = store.saved(parents(clean), "parents")
    roots = _roots(linked)
    parts = F.split("text", "\n")
    quoted = F.size(F.filter(parts, lambda line: quote_level(line) > 0))
    own = F.btrim(F.array_join(F.filter(parts, lambda line: (quote_level(line) == 0) & ~((quoted > 0) & line.rlike(_ATTRIBUTION))), "\n"), F.lit(T.BLANKS))
    placed = clean.join(linked, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    body = placed.select("conv_id", "turn", "role", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), quoted.cast("long").alias("n_quoted"), own.alias("text"))
    order = Window.partitionBy("conv_id").orderBy("root_turn", "turn")
    place = clean.select("conv_id", "turn").join(roots, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("root_turn", "turn").alias("root_turn"))
    place = place.select("conv_id", "turn", (F.row_number().over(order) - 1).cast("long").alias("position"))
    return body.join(place, ["conv_id", "turn"]).select(
        "conv_id",
        "position",
        "turn",
        "role",
        "parent_turn",
        "root_turn",
        "n_quoted",
        "text",
        F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>")).alias("formatted"),
    )
