"""Benchmark passages in documents, by a prefix-filtered join.

A passage occurs in a document only if its rarest word does. Words are ordered by how often the documents hold them;
every window of a benchmark item is represented by its rarest word, together with the words around it in the item (an
anchor). Occurrences of these words in documents meet the anchors by an equality join; how far the words to either side
agree, within the window's length, decides exactly which windows occur and what part of the document they cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.llm.columns import KEY, ascii_lower, union_length, with_key
from labelsieve.session import materialize, small_table

#: Fixed value: letters a-z, digits and everything beyond ASCII make words.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
_WORDS = "_words_of_the_text"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def agreeing(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    first = F.array_position(same, 0)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def around(words: Column, at: Column, reach: int) -> tuple[Column, Column]:
    """Up to ``reach`` words before position ``at`` (0-based), nearest first, and as many after it."""
    begin = F.greatest(at - reach, F.lit(0))
    return F.reverse(F.slice(words, begin + 1, at - begin)), F.slice(words, at + 2, F.lit(reach))


def item_anchors(items: DataFrame, item: str, text: str, counts: DataFrame, window: int) -> DataFrame:
    """(anchor, item, word, left, right, before, after): ``before`` and ``after`` words must agree for a short item."""
    words = items.select(F.col(item).alias("item"), words_of(F.col(text)).alias("words")).filter(F.size("words") > 0).distinct()
    placed = words.select("item", "words", F.posexplode("words").alias("at", "word")).join(counts, "word", "left").select(
        "item", "words", "at", "word", F.coalesce("n", F.lit(0)).alias("n"))
    ranked = placed.groupBy("item", "words").agg(F.array_sort(F.collect_list(F.struct("at", "n", "word"))).alias("ranked"))
    size = F.size("words")
    starts = ranked.select("*", F.explode(F.sequence(F.lit(0), F.greatest(size - window, F.lit(0)))).alias("start"))
    rarest = F.array_min(F.transform(
        F.slice("ranked", F.col("start") + 1, F.lit(window)), lambda r: F.struct(r["n"], r["word"], r["at"])))
    chosen = starts.select("item", "words", rarest["at"].alias("at"), rarest["word"].alias("word")).distinct()
    left, right = around(F.col("words"), F.col("at"), window - 1)
    short = size < window
    anchors = chosen.select(
        "item", "word", left.alias("left"), right.alias("right"),
        F.when(short, F.col("at")).otherwise(0).alias("before"), F.when(short, size - 1 - F.col("at")).otherwise(0).alias("after"),
        F.least(size, F.lit(window)).alias("length"))
    parts = ["word", "left", "right", "before", "after", "length"]
    return anchors.withColumn("anchor", F.md5(F.to_json(F.struct(*parts))))


def find_passages(
    docs: DataFrame, text: str, items: DataFrame, item: str, item_text: str, identity: tuple[str, ...], window: int = WINDOW,
) -> DataFrame:
    """(key, n_hit, items): words of a document inside occurring windows, and the items they belong to.

    Documents without a hit have no row. The key is that of ``with_key(docs, *identity)``; ``identity`` must determine
    the text. Null and empty texts and items hold no words. Rows of the same identity count once.
    """
    return passages_of(materialize(with_key(docs, *identity).select(*KEY, words_of(F.col(text)).alias("words"))), items, item, item_text, window)


def passages_of(keyed: DataFrame, items: DataFrame, item: str, item_text: str, window: int = WINDOW) -> DataFrame:
    """``find_passages`` of documents whose words (``KEY``, words) have been split and written before."""
    vocabulary = small_table(items.select(F.explode(words_of(F.col(item_text))).alias("word")).distinct())
    counts = materialize(
        keyed.select(F.explode("words").alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n")))
    anchors = materialize(item_anchors(items, item, item_text, counts, window))
    needed = small_table(anchors.select("word").distinct())
    occurrences = keyed.select(*KEY, "words", F.posexplode("words").alias("at", "word")).join(needed, "word")
    left, right = around(F.col("words"), F.col("at"), window - 1)
    occurrences = occurrences.select(*KEY, "at", "word", left.alias("doc_left"), right.alias("doc_right"))
    distinct = anchors.select("anchor", "word", "left", "right", "before", "after", "length").distinct()
    runs = occurrences.join(distinct, "word").select(
        *KEY, "at", "anchor", "before", "after", "length",
        agreeing(F.col("left"), F.col("doc_left")).alias("l"), agreeing(F.col("right"), F.col("doc_right")).alias("r"))
    hits = materialize(
        runs.filter((F.col("l") + F.col("r") + 1 >= F.col("length")) & (F.col("l") >= F.col("before")) & (F.col("r") >= F.col("after")))
        .select(*KEY, "anchor", (F.col("at") - F.col("l")).alias("start"), (F.col("at") + F.col("r") + 1).alias("end")))
    covered = hits.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans")).select(
        *KEY, union_length(F.col("spans")).cast("long").alias("n_hit"))
    of_items = (
        hits.select(*KEY, "anchor").distinct().join(anchors.select("anchor", F.col("item").cast("string").alias("item")), "anchor")
        .groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items")))
    return covered.join(of_items, KEY)


def mark_contamination(
    docs: DataFrame, text: str, items: DataFrame, item: str, item_text: str, identity: tuple[str, ...], window: int = WINDOW,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (ids as sorted strings) and ``contaminated``: a word was hit and at
    least one word in twenty. Every row stays, also repeated ones; columns of these names are replaced."""
    new = ["n_words", "n_hit", "items", "contaminated"]
    rows = with_key(docs.drop(*[c for c in new if c not in identity and c != text]), *identity)
    split = materialize(rows.withColumn(_WORDS, words_of(F.col(text))))  # words are read twice more, splitting is dear
    found = passages_of(split.select(*KEY, F.col(_WORDS).alias("words")), items, item, item_text, window)
    joined = split.withColumn("n_words", F.size(_WORDS).cast("long")).drop(_WORDS).join(found, KEY, "left").drop(*KEY)
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.withColumns({
        "n_hit": hit, "items": F.coalesce("items", F.array().cast("array<string>")),
        "contaminated": (hit > 0) & (20 * hit >= F.col("n_words"))})
