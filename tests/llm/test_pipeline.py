import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from plain import components, contamination, without_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from rivulet.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages_equal_a_plain_version(spark):
    """Every stage after the first (a model's verdicts) against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = toxicity.clean(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert clean.columns == docs.columns and 0.8 * docs.count() < len(rows) < docs.count()
    root = components(rows)
    rows = [(d, t) for d, t in rows if root[d][1] == d]
    rows = [(d, kept if n else t) for (d, t), (_, _, n, _, kept) in zip(rows, without_repeats(rows, 35))]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = contamination(rows, items, 10)
    rows = [r for r, x in zip(rows, leaks) if not x[5]]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {(d, zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0][-2048:], "<u4").tobytes())) for d, x in rows}
    got = corpus_pipeline.run(spark, SF).collect()
    last = defaultdict(lambda: (-1, 0))
    for r in got:
        last[r.doc_id] = max(last[r.doc_id], (r.piece, r.ids_crc32))
    assert {(d, crc) for d, (_, crc) in last.items()} == want
    sizes = defaultdict(int)
    for r in got:
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 2048


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0
        assert name == "packing" or out.columns == docs.columns
