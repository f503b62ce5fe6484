"""Benchmark decontamination by a prefix-filtered set join; DataFrame functions only.

An item is seen as its windows of ``window`` consecutive words (a shorter item is one window). A window occurs only where all of its
words do, so one prefix token is enough: its rarest word by the documents' counts. Windows of an item that share this word
at one place form an anchor, and each place of the word in a document is one candidate for the anchor. Positions and lengths bound
which of its windows can lie there, and these are compared word by word. An anchor carries the words of its windows only, at most
2 * window - 1, so anchors take room in proportion to the items' words, however long an item is; equal anchors are there once.

Defined results: a null or empty text has no words; an item without words has no window; rows given twice get equal results; a null
doc_id is kept; an item with a null item_id marks words but is not listed; empty tables give no hits; other columns are
ignored by ``contamination`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm.workspace import materialize, scratch

#: Anchors are broadcast in blocks of about this many words, some 20 MB; documents meet the blocks one after the other, and no document's words
#: are shuffled.
BROADCAST_WORDS = 500_000


def _lower(c: Column) -> Column:
    """A-Z in lower case. Where every character is one byte, lower() does just that and is faster."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _words() -> Column:
    """The words as they are; they are lower-cased one by one, where they are compared."""
    return F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)).alias("words")


def _sequence(words: Column) -> Column:
    return _lower(F.array_join(words, " "))


def anchors(items: DataFrame, doc_words: DataFrame, window: int, small: bool) -> DataFrame:
    """word, size (of a window), near (the words of the anchor's windows, in lower case), off (the word's place in near), windows, content (a name of all
    that), item_id. Anchors of equal content stand in several rows, one for each item."""
    there = items.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("place", "word")).withColumn("word", _lower(F.col("word")))
    vocabulary = there.select("word").distinct()
    if small:
        counts = doc_words.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("c"))
    else:
        counts = doc_words.groupBy("word").agg(F.count("*").alias("c")).join(vocabulary, "word")
    rarest = F.min(F.struct("c", "word", "place")).over(Window.partitionBy("item").orderBy("place").rowsBetween(0, window - 1))
    ranked = there.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0))).withColumn("r", rarest)
    windows = ranked.where((F.col("place") <= F.greatest(F.col("n") - window, F.lit(0))) & (F.col("r.c") > 0))
    found = windows.groupBy(F.col("r.word").alias("word"), "item", "item_id", F.least("n", F.lit(window)).alias("size"), F.col("r.place").alias("at")).agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    near = F.transform(F.slice("words", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("size")), _lower)
    found = found.join(items.select("item", "words"), "item").select("word", "size", near.alias("near"), (F.col("at") - F.col("lo")).alias("off"), (F.col("hi") - F.col("lo") + 1).alias("windows"), "item_id")
    return found.withColumn("content", F.md5(F.to_json(F.struct("word", "size", "near", "off", "windows"))))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int, path: str) -> tuple[DataFrame, DataFrame]:
    """(occurrences, items). doc_id, row_key, content, a, b: words [a, b) of the document lie in an occurrence of one of the content's windows; and for each
    row of docs one row whose b is null and whose a is the number of words. content, item_id: the items that the content is of. Both are tables."""
    items = benchmark.select("item_id", "text").distinct().select(F.xxhash64("item_id", "text").alias("item"), "item_id", _words()).where(F.size("words") > 0)
    small = (items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).first()["n"]) <= BROADCAST_WORDS
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), _words())
    every = materialize(anchors(items, texts.select(F.explode("words").alias("word")).select(_lower(F.col("word")).alias("word")), window, small), f"{path}/anchors")
    kinds = materialize(every.drop("item_id").dropDuplicates(["content"]), f"{path}/kinds")
    # Every block of anchors is broadcast against all documents; there is one block up to BROADCAST_WORDS words.
    blocks = max(1, -(-kinds.agg(F.coalesce(F.sum(F.size("near")), F.lit(0)).alias("n")).first()["n"] // BROADCAST_WORDS))
    # an empty word behind the last one meets an anchor of its own and counts the words, so texts are cut into words once
    end = docs.sparkSession.createDataFrame([("", 0, 0, 1)], "word string, size int, off int, windows int")
    exploded = texts.select("doc_id", "row_key", "words", F.posexplode(F.array_append("words", F.lit(""))).alias("p", "word")).withColumn("word", _lower(F.col("word")))
    out = None
    for block in range(blocks):
        table = kinds.where(F.pmod(F.xxhash64("content"), F.lit(blocks)) == block) if blocks > 1 else kinds
        found = _found(exploded.join(F.broadcast(table if block else table.unionByName(end, allowMissingColumns=True)), "word"))
        out = found if out is None else out.unionByName(found)
    return materialize(out, f"{path}/occurrences"), every.select("content", "item_id").distinct()


def _found(pairs: DataFrame) -> DataFrame:
    """A window of two words or more holds a neighbour of its anchor's word. All up to the comparison stays in one generated stage, so only occurrences
    become rows, and none carries a document's words."""
    off, p, last = F.col("off"), F.col("p"), F.col("size") == 0
    same = lambda i: _lower(F.get("words", p + i)) == F.get("near", off + i)
    lo, hi = F.greatest(F.lit(0), off - p), F.least(F.col("windows") - 1, F.size("words") - F.col("size") - p + off)
    windows = pairs.where(last | ((F.col("size") == 1) | same(1) | same(-1)) & (lo <= hi))
    windows = windows.select("doc_id", "row_key", "content", "size", "words", "near", "p", (p - off).alias("shift"), F.explode(F.when(last, F.sequence(F.lit(0), F.lit(0))).otherwise(F.sequence(lo, hi))).alias("s"))
    s, size = F.col("s"), F.col("size")
    equal = _sequence(F.slice("words", s + F.col("shift") + 1, size)) == F.array_join(F.slice("near", s + 1, size), " ")
    a = F.when(last, p).otherwise(s + F.col("shift"))
    return windows.where(last | equal).select("doc_id", "row_key", "content", a.alias("a"), F.when(~last, a + size).alias("b"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    path = scratch(docs.sparkSession)
    rows, owners = occurrences(docs, benchmark, window, path)
    hits = rows.where("b is not null").select("row_key", "content", "a", "b").distinct()
    before = F.max("b").over(Window.partitionBy("row_key").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select("row_key", "a", "b").distinct().withColumn("before", F.coalesce(before, F.lit(0)))
    n_hit = spans.groupBy("row_key").agg(F.sum(F.greatest(F.col("b") - F.greatest("a", "before"), F.lit(0))).alias("n_hit"))
    items = hits.select("row_key", "content").distinct().join(owners, "content").groupBy("row_key").agg(F.collect_set("item_id").alias("ids"))
    listed = F.array_join(F.array_sort(F.transform("ids", lambda x: x.cast("string"))), ",")
    found = n_hit.join(items, "row_key").select("row_key", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"))
    own = rows.where("b is null").select("doc_id", "row_key", F.col("a").cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return own.join(found, "row_key", "left").select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs with all their columns, without those in which a window of an item occurs."""
    path = scratch(docs.sparkSession)
    hit = occurrences(docs, benchmark, window, path)[0].where("b is not null").select("row_key").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("row_key"))  # columns of any name ride along
    return rows.join(hit, "row_key", "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
