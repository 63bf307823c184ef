"""Benchmark decontamination with a positional inverted index over the training documents.

Texts are lower-cased in A-Z and cut into words of letters, digits and characters beyond ASCII. The frequency of each
benchmark word is counted over all documents. Of each window of ``WINDOW`` consecutive item words (a shorter item is
one window) the two rarest words are chosen, and of each item the ``NEAR_TERMS`` rarest that occur at all; the postings
of those words, (term, document, place), are stored in the shared folder. They serve this benchmark: another one needs
other postings. A posting of item word p at place q says that the item begins at q - p: lists adjusted by these offsets
are intersected, and where both rare words of some window agree the whole phrase is compared with the document. From
the same postings come the documents where an item's rarest words stand within ``NEAR_SPAN`` words, in any order.

Null texts have no words and so no hits. Items without item_id or words match nothing. Rows that repeat a document
get the same result each; rows of one doc_id with different texts are told apart by a hash of both. Occurrences that
overlap count each word once. Empty tables give empty results, or no hits. Other columns are ignored. A long text is
one row with its array of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, small, stash

WINDOW = 10
NEAR_TERMS, NEAR_SPAN = 3, 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEY = ["k1", "k2"]


def words_of(text: Column) -> Column:
    """The words of a text; lower() is the quicker way where it changes A-Z only."""
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _CAPITALS, _CAPITALS.lower()))
    return F.regexp_extract_all(F.coalesce(lowered, F.lit("")), F.lit(WORD), F.lit(0))


def _keys() -> tuple[Column, Column]:
    both = (F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    return F.xxhash64(*both), F.hash(*both)


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row's words under a key of 96 bits made of doc_id and text."""
    k1, k2 = _keys()
    return docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), words_of(F.col("text")).alias("words"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item (a number of each distinct item row), item_id as text, its words, their number m and the window length."""
    found = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("item_words")).where(F.size("item_words") > 0).distinct()
    found = found.withColumn("item", F.xxhash64("item_id", "item_words")).withColumn("m", F.size("item_words"))
    return stash(found.withColumn("length", F.least("m", F.lit(WINDOW))), "items")


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """How often each benchmark word occurs in all documents: word, n (0 included)."""
    terms = stash(items.select(F.explode("item_words").alias("word")).distinct(), "terms")
    said = docs.select(F.explode(words_of(F.col("text"))).alias("word")).join(small(terms), "word").groupBy("word").agg(F.count("*").alias("n"))
    return stash(terms.join(said, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")), "counts")


def anchors(items: DataFrame, counts: DataFrame, per_window: int = 2) -> DataFrame:
    """The rarest words of each window that can occur at all: item, ipos, term (a number), word."""
    words = items.select("item", "m", "length", F.posexplode("item_words").alias("ipos", "word")).join(counts, "word")
    first = F.greatest(F.lit(0), F.col("ipos") - F.col("length") + 1)
    windows = words.withColumn("start", F.explode(F.sequence(first, F.least("ipos", F.col("m") - F.col("length")))))
    window = Window.partitionBy("item", "start")
    ranked = windows.withColumn("rank", F.row_number().over(window.orderBy("n", "ipos"))).withColumn("least", F.min("n").over(window))
    chosen = ranked.where((F.col("rank") <= per_window) & (F.col("least") > 0)).select("item", "ipos", "word", "n").distinct()
    return stash(chosen.withColumn("term", F.xxhash64("word")), "anchors")


def rarest_terms(items: DataFrame, counts: DataFrame, terms: int = NEAR_TERMS) -> DataFrame:
    """The ``terms`` rarest different words of each item that occur in the documents (ties: the word that sorts first): item, word, term."""
    words = items.select("item", F.explode("item_words").alias("word")).distinct().join(counts.where("n > 0"), "word")
    ranked = words.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("n", "word")))
    return stash(ranked.where(F.col("rank") <= terms).select("item", "word", F.xxhash64("word").alias("term")), "rarest")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Store the postings of ``terms`` (word, term): k1, k2, doc_id, n_words, term, pos.

    Each document also has one row without a term, so the index knows all documents and their lengths.
    """
    wanted = stash(terms.select("word", "term").distinct(), "wanted")
    placed = _keyed(docs).select("doc_id", *_KEY, F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    found = placed.join(small(wanted), "word", "left").where("term IS NOT NULL OR pos = 0 OR pos IS NULL")
    rows = found.withColumn("base", F.coalesce(F.col("pos") == 0, F.lit(True))).select(
        "doc_id", *_KEY, "n_words", F.explode(F.when(F.col("base") & F.col("term").isNotNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array("base"))).alias("base"), "term", "pos"
    )
    return stash(rows.select("doc_id", *_KEY, "n_words", F.when(~F.col("base"), F.col("term")).alias("term"), F.when(~F.col("base"), F.col("pos")).alias("pos")), "postings")


def exact_matches(docs: DataFrame, index: DataFrame, items: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every occurrence of a window: k1, k2, item_id, first word, end."""
    aligned = index.where("term IS NOT NULL").join(small(chosen.drop("word")), "term").select(*_KEY, "item", (F.col("pos") - F.col("ipos")).alias("offset"))
    agreed = aligned.groupBy(*_KEY, "item", "offset").agg(F.count("*").alias("n"))
    lengths = items.select("item", "length")
    agreed = agreed.join(small(lengths), "item").where("n >= least(2, length)")
    places = agreed.groupBy(*_KEY, "item").agg(F.collect_list("offset").alias("offsets")).join(small(items), "item")
    by_doc = stash(places.groupBy(*_KEY).agg(F.collect_list(F.struct("item_id", "item_words", "m", "length", "offsets")).alias("candidates")), "candidates")
    k1, k2 = _keys()
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), "text").join(small(by_doc), _KEY).select(*_KEY, "candidates", words_of(F.col("text")).alias("words"))

    def phrases(c: Column) -> Column:
        """The windows of one item that stand in the document where its offsets say; words are compared one by one."""

        def at(offset: Column) -> Column:
            low = F.greatest(F.lit(0), -offset)
            high = F.least(c["m"], F.size("words") - offset) - c["length"]
            starts = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            same = F.filter(starts, lambda j: F.forall(F.sequence(j, j + c["length"] - 1), lambda i: F.get("words", offset + i) == F.get(c["item_words"], i)))
            return F.transform(same, lambda j: F.struct(c["item_id"].alias("item_id"), (offset + j).alias("first"), (offset + j + c["length"]).alias("end")))

        return F.flatten(F.transform(c["offsets"], at))

    # no row for each candidate here: it would carry all words of its document
    found = texts.select(*_KEY, F.explode(F.flatten(F.transform("candidates", phrases))).alias("hit"))
    return found.select(*_KEY, "hit.item_id", "hit.first", "hit.end").distinct()


def proximity_matches(index: DataFrame, chosen: DataFrame, counts: DataFrame, terms: int = NEAR_TERMS, span: int = NEAR_SPAN) -> DataFrame:
    """Documents in which an item's ``terms`` rarest indexed words stand within ``span`` words: doc_id, k1, k2, item, pos, span.

    ``pos`` is the last word of the closest such place; the words may come in any order. Items with fewer indexed
    words take all they have.
    """
    by_item = Window.partitionBy("item").orderBy("n", "word")
    distinct = chosen.select("item", "word", "term").distinct().join(counts, "word")
    ranked = distinct.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= terms)
    ranked = ranked.withColumn("wanted", F.max("rank").over(Window.partitionBy("item")))
    hits = index.where("term IS NOT NULL").join(small(stash(ranked.select("item", "term", "rank", "wanted"), "near")), "term")
    so_far = Window.partitionBy(*_KEY, "item").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.max(F.when(F.col("rank") == r, F.col("pos"))).over(so_far) for r in range(1, terms + 1)]
    seen = sum((x.isNotNull().cast("int") for x in last[1:]), last[0].isNotNull().cast("int"))
    width = F.col("pos") - F.least(*(F.coalesce(x, F.col("pos")) for x in last)) + 1
    close = hits.withColumn("seen", seen).withColumn("span", width).where((F.col("seen") == F.col("wanted")) & (F.col("span") <= span))
    return close.groupBy("doc_id", *_KEY, "item").agg(F.min(F.struct("span", "pos")).alias("best")).select("doc_id", *_KEY, "item", "best.pos", "best.span")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all columns, in which no window of a benchmark item occurs."""
    items = benchmark_items(benchmark)
    chosen = anchors(items, term_counts(docs, items))
    index = build_index(docs, chosen)
    bad = stash(exact_matches(docs, index, items, chosen).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct(), "contaminated")
    drop(index)
    k1, k2 = _keys()
    return docs.join(small(bad), (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left_anti")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near (items whose rarest words stand close) of every document."""
    items = benchmark_items(benchmark)
    counts = term_counts(docs, items)
    chosen, rarest = anchors(items, counts), rarest_terms(items, counts)
    index = build_index(docs, chosen.select("word", "term").unionByName(rarest.select("word", "term")))
    hits = stash(exact_matches(docs, index, items, chosen), "hits")
    close = proximity_matches(index, rarest, counts).join(small(stash(items.select("item", "item_id"), "item_ids")), "item")
    close = close.groupBy(*_KEY).agg(F.count_distinct("item_id").alias("n_near"))

    before = Window.partitionBy(*_KEY).orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    new = hits.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("first"), reached)))
    per_doc = new.groupBy(*_KEY).agg(F.sum("new").alias("n_hit"), F.collect_set("item_id").alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    found = index.where("term IS NULL").select("doc_id", *_KEY, "n_words").join(per_doc, _KEY, "left").join(close, _KEY, "left")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.coalesce("items", none)), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
