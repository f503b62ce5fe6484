import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.errors import PySparkException
from tokenizers import Tokenizer

from rivulet.llm import packing, token_store
from rivulet.llm.tokens import Encoder

VOCABULARIES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD = ["", " ", "\n\n a  b\t c ", "<|endoftext|> x", "a\x1cb c", "'s it's I'LL don't 12345 3.14", "日本 語 text é́ x", "x \n y\n\n\nz ", " lead", "a\xa0b   c", "İstanbul ß ﬁ", "word. Word, (word)"]


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", VOCABULARIES)
def test_ids_equal_the_library(name):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice(" \n\tab'sZé1!. ́ñ<|\xa0") for _ in range(60)) for _ in range(300)]
    encode, want = Encoder(public_tokenizers.path(name)).encode, plain(name)
    for text in texts * 2:
        assert np.frombuffer(encode(text), "<u4").tolist() == want(text), text


def docs(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(ODD)) for i in range(20)] + [(30, "the cat sat. " * 900), (31, None), (None, "null id"), (33, "x y"), (33, "x y"), (29, "the cat sat. " * 900 + "end")]
    return rows, spark.createDataFrame([(*r, "c", 5) for r in rows], "doc_id long, text string, shard string, n int")


def test_store_round_trip(spark, tmp_path):
    rows, df = docs(spark)
    path, want = f"file://{tmp_path}/store", plain("word_bpe_49k.json")
    token_store.write_store(df, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(want(t) + [2])
    got = token_store.read_ids(spark, path).collect()
    assert sorted((str(r.doc_id), np.frombuffer(bytes(r.data), "<u2").tolist()) for r in got) == sorted((str(d), x) for d, v in ids.items() for x in v)
    summary = sorted(token_store.read_summary(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r in summary:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[r.doc_id]]
        at += r.n_tokens
    known = [r.doc_id for r in summary if r.doc_id is not None]
    assert known == sorted(known) and len(summary) == len(rows)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count() < spark.read.parquet(f"{path}/recipes").selectExpr("sum(size(digests))").first()[0]


def test_store_notices_damage(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs(spark)[1], path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    recipes = spark.read.parquet(f"{path}/recipes").collect()
    schema = spark.read.parquet(f"{path}/recipes").schema
    changed = [r if i else type(r)(**{**r.asDict(), "n_tokens": r.n_tokens + 1}) for i, r in enumerate(recipes)]
    spark.createDataFrame(changed, schema).write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError):
        token_store.verify(spark, path)


def test_reading_notices_lost_and_doubled_chunks(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs(spark)[1], path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    chunks = spark.read.parquet(f"{path}/chunks")
    rows, schema = chunks.collect(), chunks.schema
    for own in (rows[1:], rows[:1], [*rows, rows[0]]):
        spark.createDataFrame(own, schema).write.mode("overwrite").parquet(f"{path}/chunks")
        for read in (token_store.read_summary, token_store.read_ids):
            with pytest.raises(PySparkException, match="missing"):
                read(spark, path).collect()


@pytest.mark.parametrize("change", ["after", "local_start", "order", "missing", "doc_id"])
def test_changed_recipes_are_noticed(spark, tmp_path, change):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs(spark)[1], path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    recipes = spark.read.parquet(f"{path}/recipes")
    rows, schema = [r.asDict() for r in recipes.orderBy("shard", "place").collect()], recipes.schema
    if change == "after":
        rows[-1]["after"] = [x + 1 for x in rows[-1]["after"]]
    elif change == "local_start":
        rows[-1]["local_start"] += 1
    elif change == "order":
        rows[-1]["place"], rows[-2]["place"] = rows[-2]["place"], rows[-1]["place"]
    elif change == "missing":
        rows.pop()
    else:
        rows[-1]["doc_id"] = 10**6
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/recipes")
    for read in (token_store.read_summary, token_store.read_ids):
        with pytest.raises(ValueError, match="manifest"):
            read(spark, path)


def test_changed_chunks_are_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs(spark)[1], path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    chunks = spark.read.parquet(f"{path}/chunks")
    rows, schema = chunks.collect(), chunks.schema
    other = bytearray(rows[0].data)
    other[0] ^= 1
    spark.createDataFrame([(rows[0].digest, other), *rows[1:]], schema).write.mode("overwrite").parquet(f"{path}/chunks")
    for read in (token_store.read_summary, token_store.read_ids):
        with pytest.raises(PySparkException, match="differs"):
            read(spark, path).collect()


def test_shards_grow_with_the_input(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    repeated = spark.range(300).selectExpr("7L as doc_id", "'the same text' as text")  # copies of one row can be split
    token_store.write_store(repeated, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2, shard_docs=50)
    sizes = [r.docs for r in spark.read.parquet(f"{path}/manifest").collect()]
    assert len(sizes) >= 5 and max(sizes) <= 100 and sum(sizes) == 300
    starts = sorted(r.start for r in token_store.read_summary(spark, path).collect())
    assert starts == [i * (starts[1] - starts[0]) for i in range(300)]


def test_empty_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs(spark)[1].limit(0), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    assert token_store.read_summary(spark, path).count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50000, 20000)
    ends = lambda x: token_store.cut(len(x), token_store.borders(x).tolist())
    a, b = ends(ids), ends(np.concatenate((rng.integers(0, 50000, 333), ids)))
    assert a[-1] == 20000 and max(np.diff([0, *a])) <= token_store.MOST
    assert len({x + 333 for x in a} & set(b)) > 0.8 * len(a)


def test_packing(spark):
    rows, df = docs(spark)
    want, capacity = plain("byte_bpe_50k.json"), 512
    got = packing.packed(df, public_tokenizers.path("byte_bpe_50k.json"), 0, capacity).collect()
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append(want(t) + [0])
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for d, v in ids.items():
        assert sum(x[2] for x in pieces[d]) == sum(map(len, v))
        if len(v) == 1:
            at = 0
            for i, (piece, start, length) in enumerate(sorted(pieces[d])):
                assert (piece, start) == (i, at) and (length == capacity or i == 0)
                at += length
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // capacity) + 1
    assert packing.packed(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("shape", ["uniform", "short", "long", "one"])
def test_plan_uses_every_length_once_and_is_tight(shape):
    rng = np.random.default_rng(0)
    x = {"uniform": rng.integers(1, 2049, 5000), "short": np.minimum(2048, rng.lognormal(5.5, 1, 5000).astype(int) + 1), "long": np.minimum(2048, rng.lognormal(6.9, 0.8, 5000).astype(int) + 1), "one": np.array([2048] * 9 + [7])}[shape]
    histogram = dict(zip(*(v.tolist() for v in np.unique(x, return_counts=True))))
    groups, used = packing.plan(histogram, 2048), defaultdict(int)
    for n, parts in groups:
        assert n > 0 and sum(length * k for length, k in parts) <= 2048
        for length, k in parts:
            used[length] += n * k
    assert used == histogram
    rooms, best = [], 0
    for length in sorted(x.tolist(), reverse=True):  # best fit, item by item
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            best += 1
            rooms.append(2048 - length)
    assert -(-int(x.sum()) // 2048) <= sum(n for n, _ in groups) <= best


def test_least_squares():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3, (12, 30)).astype(float), rng.normal(size=12)
    x = packing.least_squares(a, b, 200)
    gradient = a.T @ (a @ x - b)
    assert x.min() >= 0 and gradient.min() > -1e-6 and np.abs(gradient[x > 0]).max() < 1e-6
