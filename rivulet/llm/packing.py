"""Packing documents into training sequences by patterns of lengths.

Lengths form a histogram of at most ``capacity`` bins, whatever the number of documents. Patterns of up to three
documents that fill a sequence are enumerated over classes of lengths; non-negative least squares fits their repeat
counts to the histogram; the counts are rounded down and filled with real lengths, and what is left (and the gaps of
the patterns) is packed by best fit over the histogram, for several shares of the counts, of which the one with the fewest sequences
is kept. The plan has a few thousand slots at any size of the input; documents
get theirs by their rank among those of equal length.

Defined results: a null or empty text is the end id alone; longer documents are cut, the first piece taking the
remainder; rows given twice are packed twice; a null doc_id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm.arrow import keyed, map_blocks
from rivulet.llm.tokens import encoder
from rivulet.llm.words import blocks
from rivulet.llm.workspace import materialize, scratch

#: Shares of the fitted counts that are tried.
SHARES = (1.0, 0.98, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.35, 0.2, 0.1, 0.0)
PIECES = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, forget: bool = False) -> DataFrame:
    """doc_id, row_key, piece, start, length, ids_crc32 of every piece. forget: whether a partition's end empties the memo of words."""

    def per_batch(batch: pa.RecordBatch):
        make = encoder(vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        for first, n, data, at in blocks(batch.column("text")):
            raw, doc, piece, start, length, crc = data.tobytes(), [], [], [], [], []
            for i in range(n):
                ids = make(raw[at[i] : at[i + 1]].decode()) + end
                size, a = len(ids) // 4, 0
                b = size % capacity or capacity
                while a < size:
                    doc.append(i)
                    piece.append((a + capacity - 1) // capacity)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                    a, b = b, b + capacity
            own = batch.slice(first, n)
            take = pa.array(doc, pa.int64())
            yield {"doc_id": own.column("doc_id").take(take), "row_key": own.column("row_key").take(take), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    return map_blocks(keyed(docs), per_batch, PIECES, after=(lambda: encoder(vocabulary).forget()) if forget else None)


# -- the plan: numpy over a histogram of bounded size, on the driver --------------------------------------------------


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by an active set."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gram, right = a.T @ a, a.T @ b
    for _ in range(rounds):
        gain = np.where(free, -np.inf, right - gram @ x)
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9:
            break
        free[best] = True
        while True:
            own = np.flatnonzero(free)
            z = np.linalg.solve(gram[np.ix_(own, own)] + 1e-10 * np.eye(len(own)), right[own])
            if z.min() > 0:
                x[:] = 0
                x[own] = z
                break
            bad = z <= 0
            step = np.min(x[own][bad] / np.maximum(x[own][bad] - z[bad], 1e-300))
            x[own] += step * (z - x[own])
            free[own[x[own] <= 1e-12]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def patterns(classes: np.ndarray, top: int) -> list[tuple[int, ...]]:
    """Multisets of one to three of the given classes that add up to top."""
    there, own = set(classes.tolist()), sorted(classes.tolist(), reverse=True)
    found: list[tuple[int, ...]] = [(top,)] if top in there else []
    for i, a in enumerate(own):
        if top - a in there and top - a <= a:
            found.append((a, top - a))
        found += [(a, b, top - a - b) for b in own[i:] if 0 < top - a - b <= b and top - a - b in there]
    return found


def plan(histogram: dict[int, int], capacity: int, unit: int = 16, shares: tuple[float, ...] = SHARES) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, how many in each sequence), ...]) that use up the histogram.

    Patterns that take nearly all short documents leave none to fill the residual's gaps, so the counts are rounded down to several
    shares of themselves, and the share with the fewest sequences is kept (of equals the largest). The share 0 is best fit alone.
    """
    kinds, counts = fitted(histogram, capacity, unit)
    best, fewest = [], None
    least = -(-sum(k * v for k, v in histogram.items()) // capacity)
    for share in shares if kinds else (0.0,):
        groups = filled(histogram, capacity, unit, kinds, np.floor(counts * share + 1e-6).astype(int))
        n = sum(n for n, _ in groups)
        if fewest is None or n < fewest:
            best, fewest = groups, n
        if fewest == least:
            break
    return best


def fitted(histogram: dict[int, int], capacity: int, unit: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """The patterns of classes of lengths, and how often the fit repeats each."""
    sizes: dict[int, int] = {}
    for length, n in histogram.items():
        if n:
            sizes[-(-length // unit)] = sizes.get(-(-length // unit), 0) + n
    classes = np.array(sorted(sizes), int)
    kinds = patterns(classes, -(-capacity // unit)) if len(classes) else []
    if not kinds:
        return [], np.zeros(0)
    row = {c: i for i, c in enumerate(classes.tolist())}
    counts = np.array([sizes[c] for c in classes.tolist()], float)
    a = np.zeros((len(classes), len(kinds)))
    for j, kind in enumerate(kinds):
        for c in kind:
            a[row[c], j] += 1
    return kinds, least_squares(a, counts / counts.sum(), 3 * len(classes)) * counts.sum()


def filled(histogram: dict[int, int], capacity: int, unit: int, kinds: list[tuple[int, ...]], repeats: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """The patterns' sequences with real lengths, and best fit for what is left."""
    left = {k: v for k, v in histogram.items() if v}
    heads: dict[int, list[int]] = {}
    for length in sorted(left):
        heads.setdefault(-(-length // unit), []).append(length)  # the longest of a class is taken first
    bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, parts: list[tuple[int, int]]) -> None:
        if room not in bins:
            insort(rooms, room)
            bins[room] = []
        bins[room].append((n, parts))

    if len(repeats):
        there = sorted(left)
        for j in np.argsort(-repeats, kind="stable"):
            n = int(repeats[j])
            while n > 0:
                taken: dict[int, int] = {}
                for c in kinds[j][:-1]:
                    length = next((x for x in reversed(heads[c]) if left[x] > taken.get(x, 0)), None)
                    if length is None:
                        break
                    taken[length] = taken.get(length, 0) + 1
                if sum(taken.values()) < len(kinds[j]) - 1:
                    break
                # the last one is the longest that fits, so that classes' rounding leaves no gap
                room = capacity - sum(x * k for x, k in taken.items())
                at = bisect_right(there, room) - 1
                while at >= 0 and left[there[at]] <= taken.get(there[at], 0):
                    if not left[there[at]]:
                        there.pop(at)
                    at -= 1
                if at < 0:
                    break
                taken[there[at]] = taken.get(there[at], 0) + 1
                many = min([n, *(left[x] // k for x, k in taken.items())])
                for x, k in taken.items():
                    left[x] -= many * k
                for c in kinds[j]:
                    while heads[c] and not left[heads[c][-1]]:
                        heads[c].pop()
                put(capacity - sum(x * k for x, k in taken.items()), many, list(taken.items()))
                n -= many
    for length in sorted((x for x in left if left[x]), reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if n // each:
                    put(capacity - each * length, n // each, [(length, each)])
                if n % each:
                    put(capacity - n % each * length, 1, [(length, n % each)])
                break
            room = rooms[at]
            have, parts = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(at)
            each = room // length
            if n < each:
                many, k = 1, n
            else:
                k = each
                many = min(have, n // each)
            if have > many:
                put(room, have - many, parts)
            put(room - k * length, many, [*parts, (length, k)])
            n -= many * k
    return [group for groups in bins.values() for group in groups]


def slots(groups: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, sequences, first sequence, offset): rank r goes to sequence first + r % sequences."""
    used: dict[int, int] = {}
    out, base = [], 0
    for n, parts in groups:
        offset = 0
        for length, k in parts:
            out.append((length, used.get(length, 0), n * k, n, base, offset))
            used[length] = used.get(length, 0) + n * k
            offset += length * k
        base += n
    return out


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """items with sequence_id and offset; they have a length of at most capacity, and doc_id, row_key and piece tell them apart."""
    spark = items.sparkSession
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    rows = slots(plan(histogram, capacity))
    table = spark.createDataFrame(rows or [(0, 0, 0, 1, 0, 0)], "length long, from long, ranks long, many long, base long, at long")
    # Ranks among equal lengths: each length is dealt into lots of bounded size, so no length lands in one task.
    lots = max(1, sum(histogram.values()) // 100_000)
    dealt = items.withColumn("lot", F.pmod(F.xxhash64("row_key", "piece"), F.lit(lots)))
    sizes = dealt.groupBy("length", "lot").agg(F.count("*").alias("n"))
    before = sizes.select("length", "lot", (F.sum("n").over(Window.partitionBy("length").orderBy("lot")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "lot").orderBy("doc_id", "row_key", "piece")) - 1).join(before, ["length", "lot"]).withColumn("rank", F.col("rank") + F.col("before"))
    found = ranked.join(F.broadcast(table), "length").where("rank >= from and rank < from + ranks").withColumn("r", F.col("rank") - F.col("from"))
    return found.select(*items.columns, (F.col("base") + F.col("r") % F.col("many")).alias("sequence_id"), (F.col("at") + F.col("length") * F.floor(F.col("r") / F.col("many"))).alias("offset"))


def packed(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, forget: bool = False) -> DataFrame:
    """forget: for jobs with other stages that need memory; the memos of workers, up to some 200 MB each, then end with a partition."""
    path = scratch(docs.sparkSession)
    return pack(materialize(pieces(docs, vocabulary, end_id, capacity, forget), f"{path}/pieces"), capacity).drop("row_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
