"""Content-addressed store of token ids.

A rolling hash over the ids cuts every document's stream into chunks; equal chunks have equal digests and are stored
once. A recipe lists a document's chunks; recipes lie in shards of ascending doc_id, and each shard has a Merkle root over
all that its recipes say in a manifest. Reading checks chunks against their digests and recipes against the roots, and raises
where a chunk is missing, changed or there twice, or a recipe is missing, changed or in another place.

Layout under a path: ``chunks`` (digest, data: ids as little-endian unsigned 16- or 32-bit integers), ``recipes`` (shard,
place, doc_id, row_key, local_start, n_tokens, digests, after), ``manifest`` (shard, docs, tokens, root), all Parquet.

Defined results: a null text is an empty one (its only id is the end id); a null doc_id sorts first; rows given twice
have two recipes; an empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm.arrow import keyed, list_array, map_blocks
from rivulet.llm.tokens import encoder
from rivulet.llm.words import blocks, mix
from rivulet.llm.workspace import materialize, passing, scratch

WINDOW, LEAST, MASK, MOST = 8, 64, 255, 1024
SHARD_DOCS = 20_000
MEMO = (600_000, 250_000)
_U = np.uint64


def borders(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: where the hash of the WINDOW ids before ends in zeros."""
    if len(ids) < WINDOW:
        return np.zeros(0, np.int64)
    h = mix(ids.astype(_U) + _U(1))
    rolled = np.zeros(len(ids) - WINDOW + 1, _U)
    for k in range(WINDOW):
        rolled = rolled * _U(0x9E3779B97F4A7C15) + h[k : len(ids) - WINDOW + 1 + k]
    return np.flatnonzero((mix(rolled) & _U(MASK)) == 0) + WINDOW


def cut(n: int, found: list[int]) -> list[int]:
    """Ends of the chunks of n ids, LEAST to MOST each but for the last one; found: where they may end."""
    ends, last = [], 0
    for end in found:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST:
            last = end
            ends.append(end)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _encode(path: str, end_id: int, width: str):
    def per_batch(batch: pa.RecordBatch):
        make, seen, end = encoder(path, *MEMO).encode, set(), np.array([end_id], "<u4").tobytes()
        for first, n, data, at in blocks(batch.column("text")):
            counts, digests, after, fresh = [], [], [], []
            raw = data.tobytes()
            own = [make(raw[a:b].decode()) + end for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            total = [len(x) // 4 for x in own]
            edge = np.concatenate(([0], np.cumsum(total)))
            ids = np.frombuffer(b"".join(own), "<u4")  # a block's documents at once
            stored = ids.astype(width).tobytes()
            size = np.dtype(width).itemsize
            found = borders(ids)
            doc = np.searchsorted(edge, found, "left") - 1
            found = found - edge[doc]
            inside = found >= WINDOW  # the others reach into the document before
            found, where = found[inside].tolist(), np.searchsorted(doc[inside], np.arange(n + 1)).tolist()
            for i, (start, many) in enumerate(zip(edge.tolist(), total)):
                ends, at_ = cut(many, found[where[i] : where[i + 1]]), 0
                for e in ends:
                    d = digest(piece := stored[(start + at_) * size : (start + e) * size])
                    fresh.append(None if d in seen else piece)
                    seen.add(d)
                    digests.append(d)
                    after.append(many - e)
                    at_ = e
                counts.append(len(ends))
            own = batch.slice(first, n)
            yield {
                "doc_id": own.column("doc_id"), "row_key": own.column("row_key"), "n_tokens": total,
                "digests": list_array(pa.array(digests, pa.binary()), counts, pa.binary()),
                "after": list_array(pa.array(after, pa.int32()), counts, pa.int32()),
                "fresh": list_array(pa.array(fresh, pa.binary()), counts, pa.binary()),
            }

    return per_batch


def _leaf() -> F.Column:
    """Digest of all that a recipe says."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "row_key", "shard", "place", "local_start", "n_tokens")]
    return F.sha2(F.concat_ws("|", *parts, F.array_join(F.transform("digests", F.hex), ","), F.array_join(F.col("after").cast("array<string>"), ",")), 256)


def leaves(recipes: DataFrame) -> DataFrame:
    return recipes.select("shard", "place", "n_tokens", _leaf().alias("leaf"))


def merkle_roots(leaves: DataFrame) -> DataFrame:
    """shard, docs, tokens, root of (shard, place, n_tokens, leaf); a shard's leaves, about SHARD_DOCS of 32 bytes, are one group."""

    def root(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        level = [bytes.fromhex(x) for x in table["leaf"].to_pylist()]
        while len(level) > 1:
            level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
        return pa.table({"shard": table["shard"][:1], "docs": [len(table)], "tokens": [sum(table["n_tokens"].to_pylist())], "root": [level[0].hex()]})

    return leaves.groupBy("shard").applyInArrow(root, "shard int, docs long, tokens long, root string")


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int, width: str = "<u2", shard_docs: int = SHARD_DOCS, forget: bool = False) -> None:
    """width: "<u2" for vocabularies of up to 65,536 ids, else "<u4". Shards of about shard_docs documents, so their number grows with the input.
    forget: whether a partition's end empties the memo of words, for jobs with other stages that need memory."""
    columns = "doc_id long, row_key long, n_tokens long, digests array<binary>, after array<int>, fresh array<binary>"
    with passing(docs.sparkSession) as stage:
        _write(map_blocks(keyed(docs), _encode(vocabulary, end_id, width), columns, after=(lambda: encoder(vocabulary, *MEMO).forget()) if forget else None), stage, path, shard_docs)


def _write(encoded: DataFrame, stage: str, path: str, shard_docs: int) -> None:
    spark, schema = encoded.sparkSession, encoded.schema
    encoded.write.option("compression", "zstd").parquet(f"{stage}/encoded")
    encoded = spark.read.schema(schema).parquet(f"{stage}/encoded")
    fresh = encoded.select(F.explode(F.arrays_zip("digests", "fresh")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.fresh").alias("data")).where("data is not null")
    fresh.dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")

    def place(batches):
        at = start = 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            starts = start + np.concatenate(([0], np.cumsum(n)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(n))), pa.array(starts[:-1]), *batch.columns], names=["place", "local_start", *batch.schema.names])
            at, start = at + len(n), int(starts[-1])

    columns = "doc_id long, row_key long, n_tokens long, digests array<binary>, after array<int>, shard int"
    recipes = encoded.drop("fresh").withColumn("copy", F.monotonically_increasing_id())  # tells repeated rows apart, so that they can be split
    shards = max(1, -(-encoded.count() // shard_docs))
    ordered = recipes.repartitionByRange(shards, "doc_id", "row_key", "copy").sortWithinPartitions("doc_id", "row_key", "copy").drop("copy").withColumn("shard", F.spark_partition_id())
    written = materialize(ordered.mapInArrow(place, f"place long, local_start long, {columns}"), f"{path}/recipes")
    merkle_roots(leaves(written)).write.parquet(f"{path}/manifest")


# -- reading ---------------------------------------------------------------------------------------------------------

_CRC = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo that of crc32, lowest degree in the highest bit."""
    out, a, b = np.zeros(len(a), np.uint32), a.astype(np.uint32), b.astype(np.uint32)
    for bit in range(31, -1, -1):
        out ^= b & -((a >> np.uint32(bit)) & np.uint32(1))
        b = (b >> np.uint32(1)) ^ (np.uint32(_CRC) & -(b & np.uint32(1)))
    return out


def crc_shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What crc32 values of parts add (by exclusive or) to that of a whole, where after ids of 32 bits follow the part."""
    out, after = crc.astype(np.uint32), after.astype(np.int64).copy()
    power = np.array([1 << 31], np.uint32)
    for _ in range(32):  # x ** 32
        power = (power >> np.uint32(1)) ^ (np.uint32(_CRC) & -(power & np.uint32(1)))
    while after.any():
        odd = (after & 1).astype(bool)
        out[odd] = _times(out[odd], np.broadcast_to(power, odd.sum()))
        after >>= 1
        power = _times(power, power)
    return out


def _sound(batch: pa.RecordBatch) -> list[bytes]:
    """The chunks' data; one that differs from its digest ends the job."""
    digests, data = batch.column("digest").to_pylist(), batch.column("data").to_pylist()
    if any(d is None or x is None or digest(x) != d for d, x in zip(digests, data)):
        raise ValueError("a stored chunk differs from its digest")
    return data


def read_chunks(spark: SparkSession, path: str, width: str = "<u2") -> DataFrame:
    """digest, data, ids_crc32 of every stored chunk; a chunk that differs from its digest ends the job."""

    def check(batch: pa.RecordBatch):
        data = _sound(batch)
        yield {"digest": batch.column("digest"), "ids_crc32": [zlib.crc32(np.frombuffer(x, width).astype("<u4").tobytes()) for x in data], "n": [len(x) // np.dtype(width).itemsize for x in data]}

    return map_blocks(spark.read.parquet(f"{path}/chunks"), check, "digest binary, ids_crc32 long, n int")


def verify(spark: SparkSession, path: str) -> None:
    """Compares the recipes' Merkle roots with the manifest."""
    found = merkle_roots(leaves(spark.read.parquet(f"{path}/recipes")))
    kept = spark.read.parquet(f"{path}/manifest")
    if kept.exceptAll(found).unionAll(found.exceptAll(kept)).count():
        raise ValueError("the recipes differ from the manifest")


def _damaged(kind: str) -> F.Column:
    return F.raise_error(F.lit("a stored chunk is missing, or there twice")).cast(kind)


def read_summary(spark: SparkSession, path: str, width: str = "<u2") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files. crc32 is linear, so chunks' values combine without moving ids."""
    verify(spark, path)
    bases = spark.read.parquet(f"{path}/manifest").select("shard", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("base"))
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("shard", "place", F.explode(F.arrays_zip("digests", "after")).alias("c")).select("shard", "place", F.col("c.digests").alias("digest"), F.col("c.after").alias("after"))
    parts = refs.join(read_chunks(spark, path, width), "digest", "left").withColumn("ids_crc32", F.coalesce("ids_crc32", _damaged("long")))

    def shift(batch: pa.RecordBatch):
        out = crc_shifted(batch.column("ids_crc32").to_numpy(), batch.column("after").to_numpy())
        yield {"shard": batch.column("shard"), "place": batch.column("place"), "part": out.astype(np.int64), "n": batch.column("n")}

    sums = map_blocks(parts.select("shard", "place", "after", "ids_crc32", "n"), shift, "shard int, place long, part long, n int")
    sums = sums.groupBy("shard", "place").agg(F.bit_xor("part").alias("ids_crc32"), F.sum("n").alias("read_tokens"))
    small = recipes.select("shard", "place", "doc_id", "local_start", "n_tokens")
    out = small.join(sums, ["shard", "place"], "left").join(F.broadcast(bases), "shard")  # a row for each shard
    return out.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), F.when(F.col("read_tokens") == F.col("n_tokens"), F.col("n_tokens")).otherwise(_damaged("long")).alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, path: str, width: str = "<u2") -> DataFrame:
    """doc_id, row_key, data: each document's ids as stored, rebuilt from its recipe."""

    def check(batch: pa.RecordBatch):
        yield {"digest": batch.column("digest"), "data": _sound(batch)}

    verify(spark, path)
    chunks = map_blocks(spark.read.parquet(f"{path}/chunks"), check, "digest binary, data binary")
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("shard", "place", F.posexplode("digests").alias("i", "digest")).join(chunks, "digest", "left")
    own = refs.groupBy("shard", "place").agg(F.sort_array(F.collect_list(F.struct("i", "data"))).alias("c"))
    own = own.select("shard", "place", F.aggregate("c.data", F.lit(b""), lambda a, x: F.concat(a, x)).alias("data"))
    out = recipes.select("shard", "place", "doc_id", "row_key", "n_tokens").join(own, ["shard", "place"], "left")
    full = F.length("data") == F.col("n_tokens") * np.dtype(width).itemsize
    return out.select("doc_id", "row_key", F.when(full, F.col("data")).otherwise(_damaged("binary")).alias("data"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark)
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_summary(spark, path)
