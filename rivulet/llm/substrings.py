"""Substring deduplication by seed and extend.

A word is removed where a window of ``length`` consecutive words covers it whose word sequence also starts elsewhere.

1. Seeds: of the hashes of ``k`` words inside each window the least one (the rightmost of equals) is its anchor; equal windows
   have equal anchors at equal places. Neighbouring windows with one anchor form a stretch, which reaches as far as the anchor serves.
2. Anchors that occur once end here. Equal stretches of an anchor are one kind with a count, so copies of a passage are never paired.
3. Documents are joined on anchors: of each anchor one kind, the most frequent, leads; every other kind is laid over it at the anchor, and the
   match is extended to the left and to the right word by word, as far as both agree. Its windows are repeated in both.
4. Windows that the leader doesn't have may still be in two other kinds: they are counted by 128-bit hashes.
5. Runs of repeated windows are the maximal repeats of ``length`` words or more, and their words go.

No pairs are made inside a group: an anchor with n kinds makes n - 1 matches.

Defined results: a null text has no words; rows given twice (the same doc_id and text) are copies of one another; a null doc_id is
kept; an empty table gives an empty result; other columns are ignored by ``dedup`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.arrow import each_once, keyed, list_array, map_blocks
from rivulet.llm.words import Words, blocks, buffers, covered, signed
from rivulet.llm.workspace import materialize, scratch

_U = np.uint64
_PLACE = _U((1 << 28) - 1)


def stretches(words: Words, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, the anchor (their first words in the block) and the anchor's hash of every stretch."""
    windows = words.windows(length)
    if not len(windows):
        return windows, windows, windows, np.zeros(0, _U)
    n = len(words.hash)
    seeds = np.zeros(n, _U)
    seeds[: n - k + 1] = words.ranges(np.arange(n - k + 1), np.arange(n - k + 1) + k)
    # rank by the hash's upper bits, of equals the rightmost; a window's seeds all lie in its document
    least = (seeds & ~_PLACE) | (_PLACE - np.arange(n).astype(_U))
    span, have = length - k + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    anchor = (_PLACE - (least[windows] & _PLACE)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (words.doc[windows[1:]] != words.doc[windows[:-1]]))))
    last = np.append(first[1:], len(windows)) - 1
    return windows[first], windows[last], anchor[first], seeds[anchor[first]]


def anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """row_key, anchor, first (window), more (windows after it), off (words before the anchor), s1 and s2 (the stretch's hash) of every stretch."""

    def per_batch(batch: pa.RecordBatch):
        for first, n, data, at in blocks(batch.column("text")):
            words = Words(data, at)
            a, b, place, anchor = stretches(words, length, k)
            doc = words.doc[a]
            yield {
                "row_key": batch.column("row_key").slice(first, n).take(pa.array(doc)), "anchor": signed(anchor), "first": a - words.first[doc], "more": b - a, "off": place - a,
                "s1": signed(words.ranges(a, b + length)), "s2": signed(words.ranges(a, b + length, other=True)),
            }

    return map_blocks(keyed(docs), per_batch, "row_key long, anchor long, first int, more int, off int, s1 long, s2 long")


def contexts(texts: DataFrame, length: int) -> DataFrame:
    """Each kind in ``kinds`` with its words, joined by single spaces."""

    def per_batch(batch: pa.RecordBatch):
        kinds = batch.column("kinds")
        own = [f.flatten() if pa.types.is_nested(f.type) else f for f in kinds.flatten().flatten()]
        columns = dict(zip([f.name for f in kinds.type.value_type], own))
        edges = np.concatenate(([0], np.cumsum(kinds.value_lengths().to_numpy())))
        firsts, mores = columns["first"].to_pylist(), columns["more"].to_pylist()
        for row, text in enumerate(batch.column("text").to_pylist()):
            words = text.encode().split()
            lo, hi = int(edges[row]), int(edges[row + 1])
            joined = [b" ".join(words[a : a + m + length]) for a, m in zip(firsts[lo:hi], mores[lo:hi])]
            yield {name: c.slice(lo, hi - lo) for name, c in columns.items()} | {"words": joined}

    return map_blocks(texts, per_batch, KIND + ", words binary")


def laid_over(pairs: DataFrame, length: int, k: int) -> DataFrame:
    """Of every kind and its leader: what the match that is extended from the anchor covers of each, as a bit for each window, and the kind's windows
    beyond the match."""

    def per_batch(batch: pa.RecordBatch):
        col = {name: batch.column(name).to_pylist() for name in ("words", "off", "more", "led_words", "led_off", "led_more")}
        own, led, rows, place = [], [], [], []
        for i, (a, off, more, b, led_off, led_more) in enumerate(zip(*col.values())):
            a, b = a.split(b" "), b.split(b" ")
            lo = hi = off
            if a[off : off + k] == b[led_off : led_off + k]:
                d = led_off - off
                while lo > max(0, -d) and a[lo - 1] == b[lo - 1 + d]:
                    lo -= 1
                hi, end = off + k, min(len(a), len(b) - d)
                while hi < end and a[hi] == b[hi + d]:
                    hi += 1
            many = max(hi - lo - length + 1, 0)
            bits = (1 << many) - 1
            own.append(bits << lo)
            led.append(bits << lo + led_off - off if many else 0)
            for w in range(more + 1):
                if not own[-1] >> w & 1:
                    rows.append(i)
                    place.append(w)
        words = Words(*buffers(batch.column("words")))
        start = words.first[np.array(rows, int)] + np.array(place, int)
        end = start + length
        counts = np.bincount(np.array(rows, int), minlength=len(own))
        open_ = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(signed(words.ranges(start, end))), pa.array(signed(words.ranges(start, end, other=True)))], names=["w", "h1", "h2"])
        yield {c: batch.column(c) for c in ("anchor", "s1", "s2", "n", "l1", "l2")} | {"own": own, "led": led, "open": list_array(open_, counts, open_.type)}

    return map_blocks(pairs, per_batch, "anchor long, s1 long, s2 long, n long, l1 long, l2 long, own long, led long, open array<struct<w:int,h1:long,h2:long>>")


KIND = "anchor long, s1 long, s2 long, first int, more int, off int, n long, l1 long, l2 long"


def marked(docs: DataFrame, length: int, k: int, path: str) -> DataFrame:
    """row_key, marks (first window of a stretch, and a bit for each of its windows that is repeated)."""
    if not 1 <= k <= length or length - k + 1 > 62:
        raise ValueError("a stretch has length - k + 1 windows, of 1 to 62")
    every = materialize(anchors(docs, length, k), f"{path}/anchors")
    # Aggregates are written first, so that joins read plain shuffles and adaptive execution can split a hot anchor.
    varied = (F.min("s1") != F.max("s1")) | (F.min("s2") != F.max("s2"))
    often = materialize(every.groupBy("anchor").agg(F.count("*").alias("n"), varied.alias("varied")).where("n > 1").drop("n"), f"{path}/often")
    seeds = materialize(every.join(often, "anchor"), f"{path}/seeds")
    kind = ["anchor", "s1", "s2"]
    one = F.min(F.struct("row_key", "first")).alias("one")
    kinds = materialize(seeds.where("varied").groupBy(*kind, "more", "off").agg(F.count("*").alias("n"), one), f"{path}/kinds")
    leaders = materialize(kinds.groupBy("anchor").agg(F.max(F.struct("n", "s1", "s2")).alias("l")).select("anchor", F.col("l.s1").alias("l1"), F.col("l.s2").alias("l2")), f"{path}/leaders")
    led = kinds.join(leaders, "anchor")
    by_doc = led.groupBy(F.col("one.row_key").alias("row_key")).agg(F.collect_list(F.struct("anchor", "s1", "s2", F.col("one.first").alias("first"), "more", "off", "n", "l1", "l2")).alias("kinds"))
    placed = materialize(contexts(each_once(docs, f"{path}/twice").join(by_doc, "row_key"), length), f"{path}/contexts")
    leads = (F.col("s1") == F.col("l1")) & (F.col("s2") == F.col("l2"))
    front = placed.where(leads).select("anchor", F.col("words").alias("led_words"), F.col("off").alias("led_off"), F.col("more").alias("led_more"))
    matches = materialize(laid_over(placed.where(~leads).join(front, "anchor"), length, k), f"{path}/matches")

    open_ = matches.where(F.size("open") > 0).select(*kind, "n", F.explode("open").alias("o")).select(*kind, "n", "o.w", "o.h1", "o.h2")
    again = materialize(open_.groupBy("anchor", "h1", "h2").agg(F.sum("n").alias("c"), F.count("*").alias("r")).where("c > 1 and r > 1").select("anchor", "h1", "h2"), f"{path}/again")
    late = open_.where("n = 1").join(again, ["anchor", "h1", "h2"]).select(*kind, F.expr("shiftleft(1L, w)").alias("mask"))
    masks = matches.where("n = 1").select(*kind, F.col("own").alias("mask")).unionByName(late)
    masks = masks.unionByName(matches.groupBy("anchor", F.col("l1").alias("s1"), F.col("l2").alias("s2")).agg(F.bit_or("led").alias("mask")))
    masks = masks.groupBy(*kind).agg(F.bit_or("mask").alias("mask"))
    full = F.expr("shiftleft(1L, more + 1) - 1")
    known = kinds.select(*kind, "n", "more").join(masks, kind, "left").select(*kind, F.when(F.col("n") > 1, full).otherwise(F.coalesce("mask", F.lit(0).cast("long"))).alias("mask"))
    known = materialize(known, f"{path}/masks")
    out = seeds.where("varied").join(known, kind).select("row_key", "first", "mask").where("mask != 0").unionByName(seeds.where("not varied").select("row_key", "first", full.alias("mask")))
    return out.groupBy("row_key").agg(F.collect_list(F.struct("first", "mask")).alias("marks"))


def with_marks(docs: DataFrame, length: int, k: int) -> DataFrame:
    path = scratch(docs.sparkSession)
    return materialize(marked(docs, length, k, path), f"{path}/marks")


def _repeated(words: Words, marks: pa.ListArray, length: int) -> np.ndarray:
    """First words of the block's repeated windows, ascending and each once."""
    offsets = marks.offsets.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(words.docs), np.diff(offsets))
    first, mask = (x.to_numpy(zero_copy_only=False).astype(np.int64)[offsets[0] : offsets[-1]] for x in (marks.values.field("first"), marks.values.field("mask")))
    row, bit = np.nonzero((mask[:, None] >> np.arange(63)) & 1)
    return np.unique(words.first[doc[row]] + first[row] + bit)


def _filled(column: pa.ListArray) -> pa.ListArray:
    """Nulls as empty lists."""
    if not column.null_count:
        return column
    return list_array(column.flatten(), np.array([0 if x is None else x for x in column.value_lengths().to_pylist()]), column.type.value_type)


def _each(batch: pa.RecordBatch, length: int):
    """(row, text as bytes, words, which of them stay or None for all, maximal repeats)."""
    marks = _filled(batch.column("marks"))
    for first, n, data, at in blocks(batch.column("text")):
        words = Words(data, at)
        windows = _repeated(words, marks.slice(first, n), length)
        stays = ~covered(windows, windows + length, len(words.hash))
        doc = words.doc[windows]
        head = np.flatnonzero(np.concatenate(([True], (np.diff(windows) != 1) | (np.diff(doc) != 0)))) if len(windows) else np.zeros(0, int)
        tail = np.append(head[1:], len(windows))[: len(head)] - 1
        edge = np.searchsorted(doc[head], np.arange(n + 1))
        begin, many = (windows[head] - words.first[doc[head]]).tolist(), (windows[tail] - windows[head] + length).tolist()
        raw = data.tobytes()
        for i in range(n):
            text = raw[at[i] : at[i + 1]]
            own = stays[words.first[i] : words.first[i] + words.count[i]]
            lo, hi = edge[i], edge[i + 1]
            yield first + i, text, text.split(), None if lo == hi else own.tolist(), list(zip(begin[lo:hi], many[lo:hi]))


def dedup(docs: DataFrame, length: int = 35, k: int = 10) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (first word and number of each run that goes), repeats (those of each maximal repeat)."""

    def per_batch(batch: pa.RecordBatch):
        out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "removed", "repeats")}
        for _, _, words, stays, repeats in _each(batch, length):
            kept = words if stays is None else list(compress(words, stays))
            edges = np.flatnonzero(np.diff(np.concatenate(([False], ~np.array(stays), [False])).astype(np.int8))).reshape(-1, 2) if stays else np.zeros((0, 2), int)
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            out["removed"].append([{"first": int(a), "words": int(b - a)} for a, b in edges])
            out["repeats"].append([{"first": a, "words": n} for a, n in repeats])
        yield {"doc_id": batch.column("doc_id"), **out}

    joined = keyed(docs).join(with_marks(docs, length, k), "row_key", "left").select("doc_id", "text", "marks")
    run = "array<struct<first:int,words:int>>"
    return map_blocks(joined, per_batch, f"doc_id long, n_words long, n_removed long, kept_sha256 string, removed {run}, repeats {run}")


def without_repeats(docs: DataFrame, length: int = 35, k: int = 10) -> DataFrame:
    """docs with all their columns; texts that lose words become their kept words joined by single spaces, and n_chars follows."""
    schema = docs.schema
    rows = docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), F.xxhash64("doc_id", "text").alias("row_key"))  # columns of any name ride along
    joined = rows.join(with_marks(docs, length, k), "row_key", "left").drop("row_key")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").to_pylist()
            changed = {}
            for row, _, words, stays, _ in _each(batch, length):
                if stays is not None:
                    texts[row] = b" ".join(compress(words, stays)).decode()
                    changed[row] = len(texts[row])
            row = batch.column("row")
            columns = dict(zip([f.name for f in row.type], row.flatten()))
            columns["text"] = pa.array(texts, batch.column("text").type)
            if "n_chars" in columns and changed:
                n = columns["n_chars"]
                columns["n_chars"] = pa.array([changed.get(i, x) for i, x in enumerate(n.to_pylist())], n.type)
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], names=schema.names)

    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
