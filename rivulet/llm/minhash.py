"""MinHash near-duplicates with tensored banding.

``sides`` keys of ``rows`` minhashes are drawn twice; every pair of a left and a right key is the key of one table, so
sides ** 2 tables of 2 * rows minhashes each need 2 * sides * rows minhashes in all. With 10 and 3, a pair at the
similarity of 0.85 shares a table with a probability of 0.9998.

1. Texts with equal sets form a class, and only its least document goes on.
2. In every table's bucket each member is compared with the least one. Links are confirmed on full sets.
3. The same with each bucket's member that has the most links so far, which is close to a group's middle.
4. Where a bucket still holds documents of different components, pairs across components are compared that a prefix filter lets pass.
5. Components come from star steps over the links.

Before texts are compared, parities rule out pairs: bit j of a set's parity tells whether an odd number of its shingles hash to j. Wherever two
parities differ, the sets differ in at least one shingle, so a pair with more differing bits than a link's sets may have differing shingles is no link.
No link is lost. Among near copies of one text, which miss the threshold by a few shingles, two to three times as many pairs as links are left.

No bucket is capped, and none is gathered in one place: sets are compared in lots of bounded size.

Rows are told apart by doc_id and text. Sets are equal where their sizes and two independent 64-bit sums of mixed shingle hashes are; links
between different sets are confirmed on the sets.

Defined results: a null text or one without words has an empty set, links with nothing and is kept; rows given twice are one
class; a doc_id given with two texts is two documents, each in the component of its own text; rows with a null doc_id take part like others, but
their component's id is null only if no doc_id is in it, and only then are they kept; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm.arrow import each_once, keyed, list_array, map_blocks
from rivulet.llm.graph import components
from rivulet.llm.words import Words, blocks, mix, per_doc_sum, signed
from rivulet.llm.workspace import materialize, scratch

_U = np.uint64
SHINGLE, ROWS, SIDES = 5, 3, 10
_SEEDS = np.random.default_rng(85).integers(0, 2**63, (2 * SIDES, ROWS), dtype=np.uint64) * _U(2) + _U(1)
_NAMES = [f"{side}{i}" for side in "lr" for i in range(SIDES)]
LOT = 200_000
PARITY = 16  # words of 64 bits; pairs at 0.8 are told from links up to about 1,500 shingles, longer ones less often


def shingle_sets(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of distinct shingles, by document and hash; a document with fewer words has one shingle."""
    starts = words.windows(n)
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    h = np.concatenate((words.ranges(starts, starts + n), words.ranges(words.first[short], words.first[short] + words.count[short])))
    doc = np.concatenate((words.doc[starts], short))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_shingles, two fingerprints of the set, and the left and right keys (null for empty sets)."""

    def per_batch(batch: pa.RecordBatch):
        for first, n, data, at in blocks(batch.column("text")):
            doc, h = shingle_sets(Words(data, at, lower=True))
            size = per_doc_sum(n, doc)
            there = np.flatnonzero(size)
            edge = np.concatenate(([0], np.cumsum(size[there])[:-1])) if len(there) else np.zeros(0, int)
            out = {"doc_id": batch.column("doc_id").slice(first, n), "row_key": batch.column("row_key").slice(first, n), "n_shingles": size}

            def spread(values: np.ndarray) -> pa.Array:
                full = np.zeros(n, np.int64)
                full[there] = signed(values)
                return pa.array(full, mask=size == 0)

            for name, seed in (("f1", _U(0x632BE59BD9B4E019)), ("f2", _U(0xC2B2AE3D27D4EB4F))):
                out[name] = spread(np.add.reduceat(mix(h ^ seed), edge) if len(there) else h)
            for name, seeds in zip(_NAMES, _SEEDS):
                key = np.zeros(len(there), _U)
                for s in seeds:
                    least = np.minimum.reduceat((h ^ (h >> _U(29))) * s, edge) if len(there) else h
                    key = mix(key * _U(0x9E3779B97F4A7C15) + least)
                out[name] = spread(key)
            yield out

    return map_blocks(keyed(docs), per_batch, "doc_id long, row_key long, n_shingles long, f1 long, f2 long, " + ", ".join(f"{x} long" for x in _NAMES))


def parities(texts: DataFrame) -> DataFrame:
    """doc_id, n_shingles, parity of each row of texts (doc_id, n_shingles, text)."""

    def per_batch(batch: pa.RecordBatch):
        for first, n, data, at in blocks(batch.column("text")):
            doc, h = shingle_sets(Words(data, at, lower=True))
            bits = np.zeros(n * PARITY, _U)
            place = mix(h ^ _U(0x8CB92BA72F3D8DD7))
            np.bitwise_xor.at(bits, doc * PARITY + (place >> _U(6)).astype(np.int64) % PARITY, _U(1) << (place & _U(63)))
            yield {"doc_id": batch.column("doc_id").slice(first, n), "n_shingles": batch.column("n_shingles").slice(first, n), "parity": list_array(pa.array(signed(bits)), np.full(n, PARITY), pa.int64())}

    return map_blocks(texts.select("doc_id", "n_shingles", "text"), per_batch, "doc_id long, n_shingles long, parity array<long>")


def may_link(part: int, whole: int) -> Column:
    """Whether parities p and q of sets of m and n shingles differ in no more bits than sets of a link differ in shingles."""
    differing = " + ".join(f"bit_count(p[{i}] ^ q[{i}])" for i in range(PARITY))
    return F.expr(f"({differing}) * {part + whole} <= {whole - part} * (m + n)")


def confirmed(pairs: DataFrame, texts: DataFrame, part: int, whole: int, path: str) -> DataFrame:
    """Pairs (a, b) whose sets have part * |union| <= whole * |intersection|; texts: doc_id, n_shingles, text.

    Pairs lie under a; its partners are dealt into lots by size, and each lot gets a's text once.
    """
    sized = pairs.join(texts.select(F.col("doc_id").alias("b"), "n_shingles", "text"), "b")
    weights = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("m")), "b").groupBy("a").agg(F.ceil(F.sum("m") / LOT).alias("lots"))
    weights = materialize(weights, path)  # so that the next join reads plain shuffles, and a hot a can be split
    right = sized.join(weights, "a").select("a", F.pmod(F.xxhash64("b"), "lots").alias("lot"), F.col("b").alias("doc_id"), "text")
    left = weights.join(texts.select(F.col("doc_id").alias("a"), "text"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), F.col("a").alias("doc_id"), "text")

    def compare(table: pa.Table) -> pa.Table:
        a, ids = table["a"][0].as_py(), table["doc_id"].to_numpy()
        own = table.filter(pa.array(ids == a)).slice(0, 1)
        base = next((shingle_sets(Words(data, at, lower=True))[1] for _, _, data, at in blocks(own["text"])), np.zeros(0, _U))
        rest = table.filter(pa.array(ids != a))
        good = []
        for first, n, data, at in blocks(rest["text"]):
            doc, h = shingle_sets(Words(data, at, lower=True))
            i = np.minimum(np.searchsorted(base, h), max(len(base) - 1, 0))
            both = per_doc_sum(n, doc[base[i] == h]) if len(base) else np.zeros(n, int)
            good.append(ids[ids != a][first : first + n][whole * both >= part * (len(base) + per_doc_sum(n, doc) - both)])
        b = np.concatenate(good) if good else np.zeros(0, np.int64)
        return pa.table({"a": np.full(len(b), a), "b": b})

    return left.unionAll(right).groupBy("a", "lot").applyInArrow(compare, "a long, b long")


def pairs_across(docs: DataFrame, texts: DataFrame, marks: DataFrame, part: int, whole: int, path: str) -> DataFrame:
    """Pairs (a, b) of different components among docs (doc_id, n_shingles, component) that the sizes and prefixes of their sets let pass.

    Shingles are ordered by rarity among docs. With o the shingles that a pair must share, the first one that both have must leave at least o in
    either set, itself included. Shingles of one document only come first and take places, but join nothing: near copies with more edits than the
    threshold bears have used up their places by then, so a large group of them makes no pairs. Of those with fewer edits, marks (doc_id, parity)
    let pass few besides the links; they are part of the join's condition, so that the others never become rows.
    """

    def spread(batch: pa.RecordBatch):
        for first, n, data, at in blocks(batch.column("text")):
            doc, h = shingle_sets(Words(data, at, lower=True))
            yield {"doc_id": batch.column("doc_id").slice(first, n).take(pa.array(doc)), "shingle": signed(h)}

    own = docs.select("doc_id").join(texts.select("doc_id", "text"), "doc_id").select("doc_id", "text")
    every = materialize(map_blocks(own, spread, "doc_id long, shingle long"), f"{path}/shingles")
    often = materialize(every.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1"), f"{path}/often")
    ordered = every.join(often, "shingle").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("s"))
    alone = F.col("n_shingles") - F.size("s")
    places = F.col("n_shingles") - F.ceil(F.lit(part) * F.col("n_shingles") / whole) + 1
    prefix = docs.join(ordered, "doc_id").select("doc_id", "n_shingles", "component", alone.alias("alone"), F.slice("s", 1, F.greatest(places - alone, F.lit(0)).cast("int")).alias("s"))
    prefix = prefix.select("doc_id", "n_shingles", "component", "alone", F.posexplode("s").alias("i", "t")).select("doc_id", "n_shingles", "component", (F.col("alone") + F.col("i")).alias("place"), F.col("t.shingle").alias("shingle"))
    prefix = materialize(prefix, f"{path}/prefix")
    meeting = prefix.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("shingle")
    prefix = materialize(prefix.join(meeting, "shingle").join(marks.select("doc_id", "parity"), "doc_id"), f"{path}/meeting")
    x = prefix.select("shingle", F.col("doc_id").alias("a"), F.col("n_shingles").alias("m"), F.col("component").alias("ca"), F.col("place").alias("pa"), F.col("parity").alias("p"))
    y = prefix.select("shingle", F.col("doc_id").alias("b"), F.col("n_shingles").alias("n"), F.col("component").alias("cb"), F.col("place").alias("pb"), F.col("parity").alias("q"))
    shared = F.expr(f"least(m - pa, n - pb) * {part + whole} >= {part} * (m + n) and {whole} * least(m, n) >= {part} * greatest(m, n)")
    return x.join(y, "shingle").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & shared & may_link(part, whole)).select("a", "b").distinct()


def classes_of(docs: DataFrame, part: int, whole: int, path: str) -> DataFrame:
    """doc_id, row_key, n_shingles, component (null for empty sets) of every row; components are named by a row key of theirs.

    In here, a document is a class of equal sets, and its least row key stands in for its doc_id.
    """
    sketched = materialize(sketches(docs), f"{path}/sketches")
    group = ["f1", "f2", "n_shingles"]
    classes = sketched.where("n_shingles > 0").groupBy(*group).agg(F.min("row_key").alias("doc_id"), *[F.min(x).alias(x) for x in _NAMES])
    classes = materialize(classes, f"{path}/classes")
    tables = F.array(*[F.xxhash64(F.lit(i * SIDES + j), f"l{i}", f"r{j}") for i in range(SIDES) for j in range(SIDES)])
    keys = classes.select("doc_id", "n_shingles", F.explode(tables).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = materialize(keys.join(shared, "key"), f"{path}/members")
    wanted = members.select(F.col("doc_id").alias("row_key"), "n_shingles").distinct()
    texts = each_once(docs, f"{path}/twice").join(wanted, "row_key").withColumnRenamed("row_key", "doc_id")
    texts = materialize(texts, f"{path}/texts")
    marks = materialize(parities(texts), f"{path}/marks")
    left = marks.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("m"), F.col("parity").alias("p"))
    right = marks.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n"), F.col("parity").alias("q"))

    fits = F.expr(f"{whole} * least(n_shingles, m) >= {part} * greatest(n_shingles, m)")
    compared = links = None
    placed = members.withColumn("component", F.col("doc_id"))
    for k in (1, 2):
        if k == 1:
            leader = members.groupBy("key").agg(F.min("doc_id").alias("a"))
        else:
            degree = links.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("d"))
            leader = members.join(degree, "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("d", -F.col("doc_id"))).alias("a"))
        led = placed.join(leader, "key").where("doc_id != a").select("a", F.col("doc_id").alias("b"), "n_shingles", F.col("component").alias("cb")).distinct()
        ends = placed.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("m"), F.col("component").alias("ca")).distinct()
        pairs = led.join(ends, "a").where(fits & (F.col("ca") != F.col("cb"))).select("a", "b")
        pairs = pairs.join(left, "a").join(right, "b").where(may_link(part, whole)).select("a", "b")
        pairs = materialize(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), f"{path}/pairs{k}")
        compared = pairs if compared is None else compared.unionAll(pairs)
        found = materialize(confirmed(pairs, texts, part, whole, f"{path}/lots{k}"), f"{path}/links{k}")
        links = found if links is None else links.unionAll(found)
        linked = components(links, f"{path}/star{k}")
        placed = materialize(members.join(linked, members.doc_id == linked.node, "left").select("key", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component")), f"{path}/placed{k}")

    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    open_ = materialize(placed.join(mixed, "key"), f"{path}/open")
    across = pairs_across(open_.select("doc_id", "n_shingles", "component").distinct(), texts, marks, part, whole, path)
    rest = materialize(across.join(compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), f"{path}/rest")
    links = links.unionAll(confirmed(rest, texts, part, whole, f"{path}/lots"))

    linked = materialize(components(links, f"{path}/all"), f"{path}/linked")
    whole_class = classes.select(*group, "doc_id").join(linked, F.col("doc_id") == F.col("node"), "left").select(*group, F.coalesce("component", "doc_id").alias("component"))
    return sketched.select("doc_id", "row_key", *group).join(whole_class, group, "left").select("doc_id", "row_key", "n_shingles", "component")


def near_duplicates(docs: DataFrame, part: int = 85, whole: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; documents with whole * |intersection| >= part * |union| are linked."""
    path = scratch(docs.sparkSession)
    found = materialize(classes_of(docs, part, whole, path), f"{path}/found")
    # written first, so that the next join reads plain shuffles and a large component can be split
    least = materialize(found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")), f"{path}/least")
    out = found.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def one_of_each(docs: DataFrame, nulls_stay: bool = True, part: int = 85, whole: int = 100) -> DataFrame:
    """docs with all their columns: of each component one row, and all rows without words.

    The row with the least doc_id stays, one without a doc_id only where none has one; of equal rows the one whose columns come first as
    JSON. With ``nulls_stay`` rows without a doc_id all stay besides.
    """
    path = scratch(docs.sparkSession)
    found = materialize(classes_of(docs, part, whole, path).where("n_shingles > 0").groupBy("doc_id", "row_key", "component").agg(F.count("*").alias("n")), f"{path}/found")
    first = materialize(found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("best")).select("component", F.col("best.row_key").alias("best")), f"{path}/first")
    decided = (found.where("doc_id is not null") if nulls_stay else found).join(first, "component")
    gone = materialize(decided.where("row_key != best").select("row_key"), f"{path}/gone")
    again = materialize(decided.where("row_key = best and n > 1").select("row_key"), f"{path}/again")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("row_key"))  # columns of any name ride along
    out = rows.join(gone, "row_key", "left_anti")
    if again.isEmpty():
        return out.select("row.*")
    place = F.row_number().over(Window.partitionBy("row_key").orderBy(F.to_json("row")))
    single = out.join(again, "row_key").withColumn("place", place).where("place = 1")
    return out.join(again, "row_key", "left_anti").select("row.*").unionAll(single.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
