import random
from collections import Counter

import pytest
from plain import contamination, rows_of, without_repeats

from rivulet.llm import decontaminate, substrings

TEXTS = "doc_id long, text string, row_key string, words double"


def repeated_documents():
    rnd = random.Random(3)
    out = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.choice([0, 5, 36, 80])))) for i in range(40)]
    long = " ".join(str(rnd.random()) for _ in range(2000))
    out += [(100, " ".join(["x", "y"] * 60)), (101, long), (102, "p q " + long[500:9000] + " z"), (103, None), (104, ""), (105, long), (105, long), (None, long[:5000]), (None, "ü " * 40)]
    return out + [(107, " ".join(f"w{i % 30}" for i in range(90))), (108, "ä\t" * 10)]


@pytest.mark.parametrize("length,k", [(35, 10), (5, 2)])
def test_substrings_equal_brute_force(spark, length, k):
    docs = repeated_documents()
    df = spark.createDataFrame([(*r, "m", 0.5) for r in docs], TEXTS)
    want = without_repeats(docs, length)
    got = rows_of(substrings.dedup(df, length, k), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted([r[:4] for r in want], key=str)
    spans = substrings.dedup(df, length, k).selectExpr("n_removed", "aggregate(removed, 0, (a, x) -> a + x.words) n").collect()
    assert all(r.n == r.n_removed for r in spans)


def test_repeats_equal_brute_force(spark):
    """Maximal runs of windows that are there elsewhere; an anchor with very many different surroundings among them."""
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for i in range(150):
        a = rnd.randrange(0, 30)
        own = [rnd.choice("abcdefgh") for _ in range(rnd.randrange(40))]
        docs.append((i, " ".join(own + passage[a : a + rnd.randrange(20, 60)] + [str(rnd.random()) for _ in range(rnd.randrange(4))])))
    docs += [(200, None), (201, " ".join(passage)), (201, " ".join(passage))]
    length, counts, want = 20, Counter(), []
    words = [(d, (t or "").split()) for d, t in docs]
    for _, w in words:
        counts.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    for d, w in words:
        there = [i for i in range(len(w) - length + 1) if counts[tuple(w[i : i + length])] > 1]
        runs = []
        for i in there:
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        want.append((d, [(a, b - a + length) for a, b in runs]))
    got = substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string"), length, 5).collect()
    assert sorted((r.doc_id, [(x.first, x.words) for x in r.repeats]) for r in got) == sorted(want)


def test_texts_without_repeats(spark):
    docs = [(1, "a b c d e x"), (2, "y a  b c d e"), (3, " as  it is "), (4, None)]
    df = spark.createDataFrame([(d, t, "s", 1, 7, [d]) for d, t in docs], "doc_id long, text string, source string, n_chars long, row_key int, marks array<int>")
    got = rows_of(substrings.without_repeats(df, 5, 2), "doc_id", "text", "source", "n_chars")
    assert rows_of(substrings.without_repeats(df, 5, 2), "doc_id", "row_key", "marks") == [(d, 7, [d]) for d, _ in docs]
    assert got == sorted([(1, "x", "s", 1), (2, "y", "s", 1), (3, " as  it is ", "s", 1), (4, None, "s", 1)], key=str)
    assert substrings.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_WORDS, 100])
def test_contamination_equals_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", bound)
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.choice([0, 3, 30, 200])))) for i in range(30)]
    docs += [(50, None), (None, "a b c, d! a"), (51, "é Z z é"), (51, "é Z z é"), (52, "X9 " * 3000)]
    items = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.choice([0, 1, 4, 12, 30])))) for i in range(12)]
    items += [(20, None), (None, "z é"), (21, "x y"), (22, "a " * 12), (22, "a " * 12), (23, "x9 x9")]
    texts = spark.createDataFrame([(*r, "m", 0.5) for r in docs], TEXTS)
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, place int")
    got = rows_of(decontaminate.contamination(texts, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(contamination(docs, items, 10), key=str)
    kept = sorted([r[0] for r in contamination(docs, items, 10) if not r[5]], key=str)
    assert [r[0] for r in rows_of(decontaminate.clean(texts, bench), "doc_id")] == kept


def test_a_long_item_makes_a_small_broadcast(spark, tmp_path):
    """An item of 50,000 words, and one that repeats a word as often."""
    rnd = random.Random(9)
    words = [f"w{rnd.randrange(20_000)}" for _ in range(50_000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "x " * 50_000), (3, " ".join(words[100:130]))], "item_id long, text string")
    docs = [(1, "start " + " ".join(words[100:112]) + " end"), (2, " ".join(words[49_000:])), (3, "x " * 30 + "y"), (4, "x " * 9 + "y"), (5, " ".join(words[::2]))]
    path = f"file://{tmp_path}/a"
    decontaminate.occurrences(spark.createDataFrame(docs, "doc_id long, text string"), bench, 10, path)
    carried = spark.read.parquet(f"{path}/kinds").selectExpr("sum(size(near))", "max(size(near))", "sum(length(array_join(near, ' ')))").first()
    assert carried[0] < 10 * 50_000 and carried[1] <= 19 and carried[2] < 8 * 10 * 50_000
    got = rows_of(decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench), "doc_id", "n_hit", "n_items")
    assert got == [(1, 12, 2), (2, 1000, 1), (3, 30, 1), (4, 0, 0), (5, 0, 0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, items).count() == 0
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert rows_of(decontaminate.contamination(some, items), "doc_id", "n_hit", "contaminated") == [(1, 0, False)]


def test_main_path_is_native(spark):
    texts = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = decontaminate.contamination(texts, texts.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
