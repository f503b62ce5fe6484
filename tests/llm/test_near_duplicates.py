import random

import pytest
from plain import components, rows_of

import corpus_pipeline
from rivulet.llm import graph, minhash


def documents():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    out = [(1, "a b c"), (2, "A b  c"), (3, "a b"), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "one")]
    for base in range(12):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([8, 60, 150, 400]))]
        for k in range(rnd.choice([1, 3, 12])):
            copy = words[:]
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            out.append((100 + 20 * base + k, " ".join(copy)))
    return out


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in documents()], "doc_id long, text string, component_id string, key double")
    return {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}


def test_components_equal_brute_force(found):
    want = components(documents())
    assert {d: (r.n_shingles, r.component_id) for d, r in found.items()} == want
    assert all(r.kept == (d == r.component_id) for d, r in found.items())
    assert len({c for _, c in want.values()}) <= len(want) - 10


def test_repeated_rows_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(9, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (8, "a b c d e f")], "doc_id long, text string")
    got = rows_of(minhash.near_duplicates(docs), "doc_id", "component_id", "kept")
    assert got == sorted([(9, 8, False), (9, 8, False), (None, 8, False), (None, None, True), (8, 8, True)], key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert rows_of(minhash.one_of_each(docs), "doc_id") == sorted([(8,), (None,), (None,)], key=str)


def test_one_row_of_each_component(spark):
    """Repeated rows, rows without a doc_id, and a doc_id given with two texts, all with their columns."""
    same, other, third = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = [(8, same, 2, [1]), (8, same, 1, [1]), (8, same, 1, [1]), (9, same, 1, [1]), (None, same, 1, [1])]
    rows += [(3, same, 5, [2]), (3, other, 6, [2]), (7, other, 7, [2]), (7, third, 8, [2])]
    rows += [(None, "z", 1, [3]), (None, "z", 1, [3]), (None, " ", 1, [4]), (None, " ", 1, [4]), (5, None, 1, [4]), (5, None, 1, [4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key int, row array<int>")
    got = minhash.one_of_each(docs, nulls_stay=False)
    assert got.columns == docs.columns
    want = [(3, same, 5, [2]), (3, other, 6, [2]), (7, third, 8, [2]), (None, "z", 1, [3]), *rows[-4:]]
    assert rows_of(got, *docs.columns) == sorted(want, key=str)
    repeated = docs.where("doc_id in (8, 9) or doc_id is null")
    want = [(8, same, 1, [1]), (None, "z", 1, [3]), (None, " ", 1, [4]), (None, " ", 1, [4])]
    assert rows_of(minhash.one_of_each(repeated, nulls_stay=False), *docs.columns) == sorted(want, key=str)
    assert rows_of(corpus_pipeline.drop_near_duplicates(spark, repeated, ""), *docs.columns) == sorted(want, key=str)


def test_a_doc_id_with_two_texts_is_two_documents(spark):
    one, two = "a b c d e f g", "h i j k l m n"
    docs = spark.createDataFrame([(5, one), (5, two), (6, one), (7, two), (4, "p q"), (None, two)], "doc_id long, text string")
    got = rows_of(minhash.near_duplicates(docs), "doc_id", "component_id", "kept")
    assert got == sorted([(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (4, 4, True), (None, 5, False)], key=str)


def test_recall_close_to_the_threshold(spark):
    """Pairs with similarities from 0.85 to 0.90, and pairs just below, among texts of one vocabulary; a very long pair too."""
    rnd = random.Random(11)
    rows, pairs = [], {}
    for k in range(900):
        n = rnd.choice([40, 80, 200, 500]) if k else 60_000
        words = [f"v{rnd.randrange(5000)}" for _ in range(n)]
        other = words[:]
        for i in rnd.sample(range(n), max(1, round(n * rnd.uniform(0.010, 0.022)))):
            other[i] = f"q{rnd.randrange(10**6)}"
        a, b = ({tuple(w[i : i + 5]) for i in range(n - 4)} for w in (words, other))
        share = len(a & b) / len(a | b)
        if 0.8 <= share < 0.9:
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
            pairs[2 * k] = 100 * len(a & b) >= 85 * len(a | b)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [got[d + 1] == d for d, near in pairs.items() if near]
    assert len(linked) > 100 and sum(linked) >= 0.995 * len(linked)
    assert not any(got[d + 1] == d for d, near in pairs.items() if not near)


def test_near_copies_below_the_threshold_make_few_pairs(spark, tmp_path):
    """Copies with two edits each, without their original: any two share so much that sizes and prefixes let them pass, few are links."""
    rnd = random.Random(300)
    base = [f"w{i}" for i in range(174)]
    rows = []
    for k in range(300):
        words = base[:]
        first = rnd.randrange(5, 160)
        for place in (first, rnd.randrange(first + 6, 169)):
            words[place] = f"e{k}x{place}"
        rows.append((k, " ".join(words)))
    path = f"file://{tmp_path}/c"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component for r in minhash.classes_of(docs, 85, 100, path).collect()}
    want = components(rows)
    groups = [sorted(sorted(d for d in found if named[d] == c) for c in set(named.values())) for named in (found, {d: c for d, (_, c) in want.items()})]
    assert groups[0] == groups[1] and 20 < len(groups[0]) < 280
    assert sum(spark.read.parquet(f"{path}/{name}").count() for name in ("pairs1", "pairs2", "rest")) < 2 * len(rows)


def test_parities_never_differ_in_more_bits_than_sets_in_shingles(spark):
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(4)}" for _ in range(rnd.choice([1, 4, 9, 200, 3000]))) for _ in range(30)] + ["", " ", "w0"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "0L n_shingles", "text")
    marks = {r.doc_id: [x % 2**64 for x in r.parity] for r in minhash.parities(rows).collect()}
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            bits = sum((x ^ y).bit_count() for x, y in zip(marks[i], marks[j], strict=True))
            assert bits <= len(a ^ b) and bits % 2 == len(a ^ b) % 2


def test_star_steps(spark, tmp_path):
    rnd = random.Random(7)
    links = [(i, i + 1) for i in range(200)] + [(300, 300 + i) for i in range(1, 80)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(70)]
    rnd.shuffle(links)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for a, b in links if a != b for x in (a, b)}
    got = graph.components(spark.createDataFrame(links, "a long, b long"), f"file://{tmp_path}/g")
    assert {r.node: r.component for r in got.collect()} == want
