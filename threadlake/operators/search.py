"""Literal full-text search with BM25 over distinct texts.

Every term of a query is a phrase of tokens; "all" wants every term in one text,
"any" at least one. Texts are scored once, however often they occur; scores use
the statistics of all texts, whatever the filter. Lower scores are better.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.functions import columns as C
from threadlake.operators import entries as E
from threadlake.operators import excerpts, filters, lineage
from threadlake.operators.library import Library
from threadlake.plans.requests import EntryFilter, search_terms
from threadlake.sources import shared

K1, B = 1.2, 0.75


#: A block holds the texts of one length class and one digest range. A class spans lengths up to this factor, and a range has about BLOCK_TEXTS texts if all classes are alike.
LENGTH_STEP, BLOCK_TEXTS, RANGE_BITS = 1.25, 4096, 20


@dataclass(frozen=True)
class Index:
    """Postings (term, block, digest, length, positions), blocks (term, block, texts, most, least) and, over all texts, their number and mean length in tokens.

    Of each term, a block says how many of its texts have it, how often one of them has it at most, and how
    long one of them is at least: no text of the block scores higher than those two would.
    """

    postings: DataFrame
    blocks: DataFrame
    texts: int
    mean_length: float
    contents: DataFrame | None = None

    @property
    def stored(self) -> bool:
        return self.contents is None

    def of(self, terms: list[str]) -> DataFrame:
        """The postings of some terms; without a stored index, made of the texts for those terms alone."""
        if self.stored:
            return self.postings.where(F.col("term").isin(terms))
        listed = self.contents.select("digest", C.tokens(F.col("text")).alias("tokens"))
        each = listed.select("digest", F.size("tokens").cast("long").alias("length"), F.posexplode("tokens").alias("position", "term")).where(F.col("term").isin(terms))
        return each.groupBy("term", "digest").agg(F.lit(0).alias("block"), F.first("length").alias("length"), F.array_sort(F.collect_list("position")).alias("positions"))


def range_bits(texts: int) -> int:
    """How many bits of a digest tell blocks apart."""
    return min(RANGE_BITS, max(0, (texts // BLOCK_TEXTS).bit_length()))


#: Tokens of texts that a task groups at a time; a longer text is grouped alone.
GROUP_TOKENS = 1 << 19


def postings(contents: DataFrame, bits: int = 0) -> DataFrame:
    """term, block, digest, length (of the text, in tokens) and positions (from 0, ascending), one row for each term of each text; made of the text's own row, in blocks of texts."""
    listed = contents.select("digest", C.tokens(F.col("text")).alias("tokens")).withColumn("length", F.size("tokens").cast("long"))
    made = listed.select("digest", _block(bits).alias("block"), "tokens").mapInArrow(_grouped, "term string, block int, digest string, length long, positions array<int>")
    return made.select("term", "block", "digest", "length", "positions")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of digest and tokens, and perhaps block, as one row for each term of each: term, block, digest, length, positions. They come in long runs by term and block, which are soon sorted."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.unique((np.cumsum(sizes) - sizes) // GROUP_TOKENS, return_index=True)[1].tolist()
        for low, high in zip(starts, [*starts[1:], len(sizes)]):
            size, rows = sizes[low:high], batch.slice(low, high - low)
            terms = rows.column("tokens").flatten().dictionary_encode()
            if not len(terms):
                continue
            text = np.repeat(np.arange(len(size)), size)
            position = np.arange(len(terms)) - np.repeat(np.cumsum(size) - size, size)
            of_text = [c for c in ("block", "digest") if c in batch.schema.names]
            term_rank, text_rank = np.empty(len(terms.dictionary), np.int64), np.arange(len(size))
            term_rank[pc.sort_indices(terms.dictionary).to_numpy()] = np.arange(len(terms.dictionary))
            if "block" in of_text:
                text_rank[np.argsort(pc.fill_null(rows.column("block"), 0).to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(size))
            key = term_rank[terms.indices.to_numpy()] * len(size) + text_rank[text]
            order = np.argsort(key, kind="stable")  # equal terms of a text stand together, by position
            key = key[order]
            begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            at = order[begins]
            positions = pa.ListArray.from_arrays(pa.array(np.append(begins, len(key)).astype(np.int32)), pa.array(position[order].astype(np.int32)))
            told = [rows.column(c).take(pa.array(text[at])) for c in of_text]
            yield pa.RecordBatch.from_arrays([terms.dictionary.take(terms.indices.take(pa.array(at))), *told, pa.array(size[text[at]]), positions], ["term", *of_text, "length", "positions"])


def _block(bits: int) -> Column:
    """The block of a text by its digest and length."""
    kind = F.floor(F.log(F.col("length").cast("double")) / math.log(LENGTH_STEP)).cast("int")
    place = F.shiftright(F.conv(F.substring("digest", 1, RANGE_BITS // 4), 16, 10).cast("int"), RANGE_BITS - bits)
    return kind * (1 << RANGE_BITS) + place


def blocks(kept: DataFrame) -> DataFrame:
    """term, block, texts, most (occurrences in one text), least (length of one) of postings."""
    return kept.groupBy("term", "block").agg(F.count("*").alias("texts"), F.max(F.size("positions")).alias("most"), F.min("length").alias("least"))


def partial_blocks(kept: DataFrame) -> DataFrame:
    """blocks() of rows that stand by term and block in their files, without an exchange: where a block's texts are in several files or batches it has several rows of a term, which add up."""
    told = kept.select("term", "block", F.size("positions").alias("size"), "length")
    return told.mapInArrow(_summed, "term string, block int, texts long, most int, least long")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one term and block as one: how many, the largest size and the least length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        term, block = batch.column("term").dictionary_encode().indices.to_numpy(), batch.column("block").to_numpy()
        begins = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])))
        most, least = np.maximum.reduceat(batch.column("size").to_numpy(), begins), np.minimum.reduceat(batch.column("length").to_numpy(), begins)
        first = batch.take(pa.array(begins))
        yield pa.RecordBatch.from_arrays([first.column("term"), first.column("block"), pa.array(np.diff(np.append(begins, batch.num_rows))), pa.array(most), pa.array(least)], ["term", "block", "texts", "most", "least"])


def without_blocks(kept: DataFrame) -> DataFrame:
    """What blocks get for postings that go: their number is taken off; what is left scores no higher than before."""
    return blocks(kept).select("term", "block", (-F.col("texts")).alias("texts"), F.lit(0).alias("most"), F.lit(None).cast("long").alias("least"))


def lengths(contents: DataFrame) -> DataFrame:
    """digest, length in tokens."""
    return contents.select("digest", F.size(C.tokens(F.col("text"))).cast("long").alias("length"))


def corpus(long: DataFrame) -> DataFrame:
    """One row: texts, and tokens in all, of lengths."""
    return long.agg(F.count("*").alias("texts"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))


def totals(contents: DataFrame, kept: DataFrame) -> DataFrame:
    """corpus() of texts whose postings are there: every token is a position of one of them."""
    tokens = kept.agg(F.coalesce(F.sum(F.size("positions").cast("long")), F.lit(0)).alias("tokens"))
    return contents.agg(F.count("*").alias("texts")).crossJoin(tokens)  # one row each


_TABLES = ("postings", "blocks", "corpus")


def is_stored(library: Library) -> bool:
    return all(library.stored(n) is not None for n in _TABLES)


def index(library: Library) -> Index:
    """The stored index, of whose tables a query reads its own terms' row groups and a few rows of totals; or one worked out from the texts."""
    stored = is_stored(library)
    if stored:
        kept, held, totals = (library[n] for n in _TABLES)
    else:
        kept = postings(library["contents"])
        held, totals = blocks(kept), corpus(lengths(library["contents"]))
    n = totals.agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens")).collect()[0]
    texts = n["texts"] or 0
    return Index(kept, held, texts, (n["tokens"] or 0) / texts if texts else 0.0, None if stored else library["contents"])


def vocabulary(kept: DataFrame) -> DataFrame:
    """term, texts (that have it), instances."""
    return kept.groupBy("term").agg(F.count("*").alias("texts"), F.sum(F.size("positions")).alias("instances"))


def vocabulary_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """The terms whose numbers of texts or instances differ between two postings tables (null where a side lacks the term)."""
    x = vocabulary(left).select("term", F.col("texts").alias("left_texts"), F.col("instances").alias("left_instances"))
    y = vocabulary(right).select("term", F.col("texts").alias("right_texts"), F.col("instances").alias("right_instances"))
    same = F.col("left_texts").eqNullSafe(F.col("right_texts")) & F.col("left_instances").eqNullSafe(F.col("right_instances"))
    return x.join(y, "term", "full").where(~same)


def vocabulary_difference_within(kept: DataFrame, left: Column, right: Column) -> DataFrame:
    """vocabulary_difference() of two parts of one postings table, told by conditions on its rows: the postings are made and counted once."""
    counts = lambda side, c: (F.count_if(c).alias(f"{side}_texts"), F.sum(F.when(c, F.size("positions"))).alias(f"{side}_instances"))
    both = kept.groupBy("term").agg(*counts("left", left), *counts("right", right))
    both = both.select("term", *[F.when(F.col(f"{side}_texts") > 0, F.col(f"{side}_{c}")).alias(f"{side}_{c}") for side in ("left", "right") for c in ("texts", "instances")])
    same = F.col("left_texts").eqNullSafe(F.col("right_texts")) & F.col("left_instances").eqNullSafe(F.col("right_instances"))
    return both.where(~same)


def token_list(text: str) -> list[str]:
    """The same tokens as columns.tokens, for a query's own text."""
    import unicodedata

    source, target = C.fold_map()
    plain = text.replace("İ", "i").lower().translate(str.maketrans(source, target))
    out, now = [], ""
    for c in plain:
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            now += c
        elif now:
            out.append(now)
            now = ""
    return [*out, now] if now else out


def phrase_counts(found: Index, phrases: list[list[str]]) -> DataFrame:
    """digest, block, length and tf_0 .. tf_n: how often each phrase stands in each text that has any of its tokens."""
    wanted = sorted({t for p in phrases for t in p})
    held = found.of(wanted).groupBy("digest").agg(
        F.first("block").alias("block"), F.first("length").alias("length"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at")
    )

    def back(k: int):
        return lambda p: p - k

    def count(phrase: list[str]) -> Column:
        none = F.array().cast("array<int>")
        starts = F.coalesce(F.col("at")[phrase[0]], none)
        for k, token in enumerate(phrase[1:], 1):
            starts = F.array_intersect(starts, F.transform(F.coalesce(F.col("at")[token], none), back(k)))
        return F.size(starts)

    return held.select("digest", "block", "length", *[count(p).alias(f"tf_{i}") if p else F.lit(0).alias(f"tf_{i}") for i, p in enumerate(phrases)])


def text_phrases(contents: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """length and tf_0 .. tf_n of every text, made of its own row, and the digest of those that have any phrase (else null)."""
    tokens, tf = F.col("tokens"), [f"tf_{i}" for i in range(len(phrases))]

    def count(phrase: list[str]) -> Column:
        if len(phrase) < 2:
            return F.size(tokens) - F.size(F.array_remove(tokens, phrase[0])) if phrase else F.lit(0)
        follows = lambda t, i: reduce(and_, [F.get(tokens, i + k) == w for k, w in enumerate(phrase[1:], 1)], t == phrase[0])
        return F.when(reduce(and_, [F.array_contains(tokens, w) for w in phrase]), F.size(F.filter(tokens, follows))).otherwise(0)

    listed = contents.select("digest", C.tokens(F.col("text")).alias("tokens"))
    counts = listed.select("digest", F.size("tokens").cast("long").alias("length"), *[count(p).alias(c) for p, c in zip(phrases, tf)])
    return counts.select(F.when(F.greatest(F.lit(0), *tf) > 0, F.col("digest")).alias("digest"), "length", *tf)


def text_counts(found: Index, phrases: list[list[str]], counts: DataFrame | None = None) -> list[int]:
    """How many texts have each phrase: by the stored blocks where it is one token, else counted."""
    out = [0] * len(phrases)
    if found.stored:
        single = {p[0] for p in phrases if len(p) == 1}
        known = {r["term"]: r["texts"] for r in found.blocks.where(F.col("term").isin(sorted(single))).groupBy("term").agg(F.sum("texts").alias("texts")).collect()} if single else {}
        out = [known.get(p[0], 0) if len(p) == 1 else 0 for p in phrases]
    left = [i for i, p in enumerate(phrases) if p and not (found.stored and len(p) == 1)]
    if left:
        counts = phrase_counts(found, [phrases[i] for i in left]) if counts is None or found.stored else counts.select(*[F.col(f"tf_{i}").alias(f"tf_{k}") for k, i in enumerate(left)])
        seen = counts.agg(*[F.count_if(F.col(f"tf_{k}") > 0).alias(f"n_{k}") for k in range(len(left))]).collect()[0]
        for k, i in enumerate(left):
            out[i] = seen[f"n_{k}"]
    return out


def weights(found: Index, seen: list[int]) -> list[float]:
    """A phrase's weight by the number of texts that have it."""
    return [max(math.log((found.texts - n + 0.5) / (n + 0.5)) if n else 0.0, 1e-6) for n in seen]


def strength(tf: Column, length: Column, mean: float) -> Column:
    """How well a text of that length matches by that many occurrences; it grows with them and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def parsed(text: str, mode: str) -> list[list[str]] | None:
    """The phrases of a query; None where no text can match, as a term without a token matches nothing."""
    phrases = [token_list(t) for t in search_terms(text)]
    return phrases if any(phrases) and (mode == "any" or all(phrases)) else None


def matched(counts: DataFrame, n: int, mode: str) -> DataFrame:
    """The texts that have all or any of n phrases."""
    match = F.lit(mode == "all")
    for i in range(n):
        match = (match & (F.col(f"tf_{i}") > 0)) if mode == "all" else (match | (F.col(f"tf_{i}") > 0))
    return counts.where(match)


def rated(rows: DataFrame, found: Index, idf: list[float]) -> DataFrame:
    """rows with their score."""
    score = F.lit(0.0)
    for i, w in enumerate(idf):
        score = score - w * strength(F.col(f"tf_{i}"), F.col("length"), found.mean_length)
    return rows.withColumn("score", score)


def scored(library: Library, text: str, mode: str = "all", found: Index | None = None) -> DataFrame:
    """digest, score and tf_i (a repeated term is another phrase) of every text that matches."""
    phrases = parsed(text, mode)
    if phrases is None:
        return library.spark.createDataFrame([], "digest string, score double, " + ", ".join(f"tf_{i} int" for i in range(len(search_terms(text)))))
    if found.stored if found else is_stored(library):
        found = found or index(library)
        counts, seen = phrase_counts(found, phrases), text_counts(found, phrases)
    else:
        # One pass over the texts tells the totals, the weights and the hits; it is written, as all of them read it.
        contents = found.contents if found else library["contents"]
        every = shared.saved(text_phrases(contents, phrases), "phrase-counts")
        n, tokens, *seen = every.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), *[F.count_if(F.col(f"tf_{i}") > 0) for i in range(len(phrases))]).collect()[0]
        kept = postings(contents)
        found = Index(kept, blocks(kept), n, tokens / n if n else 0.0, contents)
        counts = every.where("digest IS NOT NULL")
    return rated(matched(counts, len(phrases), mode), found, weights(found, seen)).select("digest", "score", *[f"tf_{i}" for i in range(len(phrases))])


def places(library: Library) -> DataFrame:
    """digest, KEY, segment_ordinal and origin of every text occurrence: stored by digest, or as the occurrences have them."""
    kept = library.stored("places")
    return text_places(library["occurrences"]) if kept is None else kept


def text_places(occurrences: DataFrame) -> DataFrame:
    return occurrences.where("digest IS NOT NULL").select("digest", *E.KEY, "segment_ordinal", "origin")


def matching(library: Library, text: str, f: EntryFilter = EntryFilter(), mode: str = "all", found: Index | None = None) -> DataFrame:
    """Every occurrence that matches and passes the filter: its keys, digest, score, tf_i and the conversation's activity."""
    return located(scored(library, text, mode, found), places(library), library, f)


def located(texts: DataFrame, where: DataFrame, library: Library, f: EntryFilter) -> DataFrame:
    """The occurrences (of `where`) of texts that pass the filter, with their conversation's activity."""
    spine = library.retained().where(filters.conversations(f)).select(*C.ID, "activity")
    entry = library["entries"].where(filters.entries(f)).select(*E.KEY)
    if f.origin is not None:
        where = where.where(F.col("origin") == f.origin)
    hits = texts.join(where.select(*E.KEY, "segment_ordinal", "digest"), "digest")
    return hits.join(entry, E.KEY, "left_semi").join(spine, C.ID)


def support(matches: DataFrame, library: Library) -> DataFrame:
    """One row: matching occurrences, distinct texts, distinct known roots and conversations without one; all exact."""
    counts = matches.agg(F.count("*").alias("occurrences"), F.count_distinct("digest").alias("distinct_texts"))
    return counts.crossJoin(lineage.support(matches, library))  # one row each


def hits(matches: DataFrame, text: str, mode: str = "all") -> DataFrame:
    """One row for each entry: its best segment (by score, then ordinal), how many others match, and the matched terms."""
    terms = search_terms(text)
    w = Window.partitionBy(*E.KEY)
    ranked = matches.withColumn("rank", F.row_number().over(w.orderBy("score", "segment_ordinal"))).withColumn("additional_segments", F.count("*").over(w) - 1)
    if mode == "all":
        matched = F.array(*[F.lit(t) for t in dict.fromkeys(terms)])
    else:
        any_of = {t: F.lit(False) for t in dict.fromkeys(terms)}
        for i, t in enumerate(terms):
            any_of[t] = any_of[t] | (F.max(F.col(f"tf_{i}")).over(w) > 0)
        matched = F.array_compact(F.array(*[F.when(c, t) for t, c in any_of.items()]))
    return ranked.withColumn("matched_terms", matched).where("rank = 1").select(*E.KEY, "segment_ordinal", "digest", "score", "activity", "additional_segments", "matched_terms")


def order() -> list[Column]:
    """Best score first, then latest activity (none last), identity and ordinal."""
    return [F.asc("score"), F.desc_nulls_last("activity"), *[F.asc(c) for c in E.KEY]]


def page(library: Library, text: str, f: EntryFilter = EntryFilter(), mode: str = "all", limit: int = 20, offset: int = 0, found: Index | None = None) -> DataFrame:
    """limit + 1 hits in order; texts are joined only to these. Over a stored index only the blocks that can reach the page are read."""
    from threadlake.operators import topk

    if found.stored if found else is_stored(library):
        found = found or index(library)
        return topk.page(library, text, f, mode, limit, offset, found).hits
    return hits(matching(library, text, f, mode, found), text, mode).orderBy(*order()).offset(offset).limit(limit + 1)


def with_snippets(rows: DataFrame, library: Library, query: str) -> DataFrame:
    """snippet and snippet_truncated for a page of hits; only their texts are read."""
    texts = library["contents"].join(rows.select("digest").distinct(), "digest", "left_semi").select("digest", "text")
    return rows.join(excerpts.excerpts(texts, [p for p in map(token_list, search_terms(query)) if p]).drop("excerpt"), "digest")
