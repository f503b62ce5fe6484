import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from plain import LOWER, alnum, rows_of, spaced

from rivulet.llm import licenses, lm, quality, toxicity, urls

SF = "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_licenses(spark):
    texts = ["The MIT License. mit  license", "under the Apache\nLicence!", "GNU general public licence v3", "mit", "submit license", None, "", "general-public,license " * 3, "x " * 5000 + "apache license", "mitlicense mit licenses", "apachelicense"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "mit license"), (0, texts[0])]
    got = licenses.find_licenses(spark.createDataFrame([(*r, "l") for r in rows], "doc_id long, text string, labels string")).collect()
    phrases = [("mit license".split(), "mit"), ("apache license".split(), "apache"), ("general public license".split(), "gpl")]
    assert len(got) == len(rows)
    for r in got:
        w = alnum("mit license" if r.doc_id is None else texts[r.doc_id])
        places = [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p)] == p]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
        assert (r.score == 1) == bool(places) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[1].labels == "apache" and by[1].spans[0].edits == 1 and by[1].spans[0].word == 2
    assert by[2].labels == "gpl" and by[3].labels == by[4].labels == "" and by[9].labels == "mit"
    assert licenses.find_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_seeds_find_every_match_within_the_bound():
    rnd = random.Random(1)
    for phrase, _, edits in licenses.PHRASES:
        p = licenses._Phrase(phrase, "x", edits)
        for _ in range(200):
            text = list(phrase)
            for _ in range(rnd.randint(0, edits)):
                i = rnd.randrange(len(text))
                text[i] = rnd.choice(["", "q", text[i] + "q"])
            text = " ".join("".join(text).split())
            if p.pattern.fullmatch(text):
                assert p.fuzzy(f"left {text} right"), text


def test_neighbouring_notices_are_all_found(spark):
    p = licenses._Phrase("mit license", "mit", 1)
    for text, want in [
        ("mit licens mit license", [(0, 10, 1), (11, 22, 0)]),
        ("mit license mit licens", [(0, 11, 0), (12, 22, 1)]),
        ("mit licens or mit license", [(0, 10, 1), (14, 25, 0)]),
        ("mit licens mit lcense mit license mt license mit license", [(0, 10, 1), (11, 21, 1), (22, 33, 0), (34, 44, 1), (45, 56, 0)]),
        ("mit licens " * 3000 + "mit license", [(11 * i, 11 * i + 10, 1) for i in range(3000)] + [(33000, 33011, 0)]),
    ]:
        assert p.fuzzy(text) == want
    g = licenses._Phrase("general public license", "gpl", 3)
    texts = ["genral public licens", "general publc license", "general public license", "gneral pblic licnse"]
    rnd = random.Random(8)
    for _ in range(100):
        own = [rnd.choice(texts) for _ in range(rnd.randint(1, 6))]
        assert [(text, e) for a, b, e in g.fuzzy(" ".join(own)) for text in [" ".join(own)[a:b]]] == [(x, {0: 2, 1: 1, 2: 0, 3: 3}[texts.index(x)]) for x in own]
    rows = licenses.find_licenses(spark.createDataFrame([(1, "Mit Licens, mit license; apach license or apache license")], "doc_id long, text string")).collect()
    assert [(x.label, x.word, x.edits) for x in rows[0].spans] == [("mit", 0, 1), ("mit", 2, 0), ("apache", 4, 1), ("apache", 7, 0)]


def edits_between(a, b):
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_spans_equal_brute_force():
    """All spans of whole words within the bound; those with fewer edits first, of equals the leftmost, none over another."""
    rnd = random.Random(12)
    for phrase, label, edits in licenses.PHRASES:
        p = licenses._Phrase(phrase, label, edits)
        for _ in range(150):
            words = []
            for _ in range(rnd.randint(1, 5)):
                text = list(phrase if rnd.random() < 0.8 else rnd.choice(["some other words", "mit", "licensé"]))
                for _ in range(rnd.randint(0, edits + 1)):
                    i = rnd.randrange(len(text))
                    text[i] = rnd.choice(["", "q", "é", " ", text[i] + "q"])
                words += "".join(text).split()
            text = " ".join(words)
            starts = [len(" ".join(words[:i])) + (i > 0) for i in range(len(words))]
            every = [(e, starts[i], starts[j] + len(words[j])) for i in range(len(words)) for j in range(i, min(i + 8, len(words))) if (e := edits_between(phrase, text[starts[i] : starts[j] + len(words[j])])) <= edits]
            want = []
            for e, a, b in sorted(every):
                if all(b <= x or a >= y for x, y, _ in want):
                    want.append((a, b, e))
            assert p.fuzzy(text) == sorted(want), text


def test_dense_texts_take_linear_time_and_spans_lie_in_the_original(spark):
    p = licenses._Phrase("general public license", "gpl", 3)
    began = time.process_time()
    assert len(p.fuzzy("general public licence " * 220_000)) == 220_000  # 5 MB
    assert len(licenses._Phrase("mit license", "mit", 1).fuzzy("icense" * 800_000 + " mit lmit l" * 100)) == 0
    assert time.process_time() - began < 20
    text = "ÄÖ: The M.I.T; Apache--LICENCE é, General\nPublic Licence"
    spans = licenses.find_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert [(x.label, text[x.start : x.end], x.text) for x in spans] == [("apache", "Apache--LICENCE", "Apache--LICENCE"), ("gpl", "General\nPublic Licence", "General\nPublic Licence")]
    assert [(x.word, x.words) for x in spans] == [(5, 2), (8, 3)]


def test_near_misses_stay_without_a_label(spark):
    """Phrases that only resemble a notice, and one that the bound can't tell apart."""
    near = ["submit license", "limit licence fees", "patchy license", "general public notice", "general license", "the public license", "apache licensing board", "mit licensing"]
    rows = licenses.find_licenses(spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in rows} == dict.fromkeys(range(len(near)), "")
    known = licenses.find_licenses(spark.createDataFrame([(1, "emit license")], "doc_id long, text string")).first()
    assert (known.labels, known.base_labels, known.spans[0].edits) == ("mit", "", 1)


def test_quality_base_and_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a b\n\na b\n a b\na b"), (None, "# x " * 30), (-3, "a b\n\na b\n a b\na b"), (-4, "w " * 20000)], docs.schema)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [tuple(r) for r in docs.unionAll(extra).collect()]
    got = quality.quality(docs.unionAll(extra), labels).collect()
    want = []
    for d, t in rows:
        t = t or ""
        w = spaced(t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit, seen, dup = set(), set(), 0
        for i in range(len(w) - 7):
            if c[tuple(w[i : i + 8])] > 1:
                hit.update(range(i, i + 8))
        for line in t.split("\n"):
            if spaced(line):
                dup += line in seen
                seen.add(line)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)))
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], key=str) == sorted(want, key=str)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(truth[r.doc_id], r.kept) for r in got if r.doc_id in truth and not r.base_failed]
    assert sum(bool(q) == k for q, k in judged) > 0.95 * len(judged)
    assert not any(r.kept and r.base_failed for r in got)
    none = quality.quality(extra, labels.limit(0)).collect()
    assert len(none) == extra.count()


def test_quality_on_held_out_labels(spark):
    """Learned from four folds, judged on the fifth."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r.doc_id: r for r in quality.quality(docs, labels.where("crc32(cast(doc_id as string)) % 5 != 0")).collect()}
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and not got[r.doc_id].base_failed]
    assert len(held) > 500 and sum(bool(q) == g.kept for q, g in held) > 0.95 * len(held)
    good = [g.kept for q, g in held if q]
    assert sum(good) > 0.97 * len(good)


def test_quality_edges(spark):
    """An empty table, clashing columns, repeated rows, and documents with very many lines in the fit and in the verdict."""
    good, bad = "The ferry crossed the wide bay in the morning. It came back at noon with all the mail.", "Menu | Home | $$$ 99 | ### | CLICK"
    docs = [(i, "\n".join([f"{good} {i}"] * 1 + [f"{good} {i} {k}" for k in range(5)]) if i % 2 else "\n".join(f"{bad} {i} {k}" for k in range(8))) for i in range(80)]
    docs += [(100, "\n".join(f"{good} {k}" for k in range(30_000))), (101, "\n".join(f"{bad} {k}" for k in range(3_000))), (101, "\n".join(f"{bad} {k}" for k in range(3_000)))]
    df = spark.createDataFrame([(*r, True, 3) for r in docs], "doc_id long, text string, kept boolean, n_lines int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(100, 1), (101, 0)], "doc_id long, quality int")
    got = quality.quality(df, labels, lines=50).collect()
    assert len(got) == 83 and [r.n_lines for r in got if r.doc_id == 100] == [30_000]
    assert all(r.kept == (r.doc_id % 2 == 1 or r.doc_id == 100) for r in got if not r.base_failed and r.doc_id != 101)
    assert quality.quality(df.limit(0), labels).count() == 0


def test_decoding_together_equals_one_by_one():
    rng = np.random.default_rng(5)
    scores = [rng.normal(size=n) for n in [0, 1, 3, 70, 64, 2, 0, 200, 9, 9]]
    move = rng.normal(size=(2, 2))
    for s, got in zip(scores, quality.viterbi_together(scores, move)):
        assert got.astype(int).tolist() == (quality.viterbi(s.tolist(), move) if len(s) else [])
    assert quality.viterbi_together([np.zeros(0)], move)[0].size == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7):
        score, move = rng.normal(size=n), rng.normal(size=(2, 2))
        value = lambda path: sum(s * y for s, y in zip(score, path)) + sum(move[a, b] for a, b in zip(path, path[1:]))
        paths = [[k >> i & 1 for i in range(n)] for k in range(2**n)]
        assert value(quality.viterbi(score.tolist(), move)) == pytest.approx(max(map(value, paths)))
        p, _ = quality._posterior(score[None], np.ones((1, n), bool), move)
        weights = np.exp([value(x) for x in paths])
        assert np.allclose(p[0], (weights[:, None] * np.array(paths)).sum(0) / weights.sum())


def test_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(-1, None), (-2, "no host"), (-3, "http://X.Example.NET/en/a?b#c"), (-4, "ftp://net"), (-5, "http://mynet/"), (-6, "http://a.org/fr/"), (-7, "http://org/fr"), (None, "http://a.net?x=/en/"), (-3, "http://X.Example.NET/en/a?b#c")], pages.schema)
    every = pages.unionAll(odd)
    got = urls.filter_urls(every.withColumn("host", every.url)).collect()
    want = []
    for r in every.collect():
        rest = (r.url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [x for x in urls.RULES if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        want.append((r.page_id, host, path, best and best[0] + best[1], best and best[2]))
    assert sorted([(r.page_id, r.host, r.path, r.rule, r.rule and r.verdict) for r in got], key=str) == sorted(want, key=str)
    assert {r.verdict for r in got} == {"allow", "block"}
    assert urls.filter_urls(odd.where("page_id = -1")).first().verdict == "allow"
    assert urls.filter_urls(pages.limit(0)).count() == 0


def lexical_pages(hosts, seed):
    """URLs under one suffix: on bad hosts long, deep and full of digits and parameters. Only hosts below 20 have a rule."""
    rnd = random.Random(seed)
    rows = []
    for h in range(hosts):
        for k in range(12):
            bad = h % 2 == 0
            path = "/".join(("".join(rnd.choice("0123456789abcdef") for _ in range(9)) if bad else rnd.choice(["news", "about", "team"])) for _ in range(rnd.randrange(4, 7) if bad else rnd.randrange(1, 3)))
            tail = "?" + "&".join(f"p{i}={rnd.randrange(10**6)}" for i in range(4)) if bad else ""
            rows.append((100 * h + k, f"http://host{h}.com/{path}{tail}"))
    return rows, [(f"host{h}.com", "/", "block" if h % 2 == 0 else "allow") for h in range(20)]


def test_trees_judge_hosts_they_never_saw_by_their_urls(spark):
    """All hosts share a suffix, so the suffix decides nothing; accuracy on hosts without a label, by host."""
    rows, rules = lexical_pages(40, 1)
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    by_host = {}
    for r in got:
        if r.rule is None:
            by_host.setdefault(r.host, []).append((r.verdict == "block") == (int(r.host[4:-4]) % 2 == 0))
    assert len(by_host) == 20
    assert all(sum(x) > 0.9 * len(x) for x in by_host.values())


def test_suffix_statistics_leave_the_own_host_out(spark, tmp_path):
    rows = [(f"http://a{i}.zz/{k}", "zz") for i in range(6) for k in range(3)] + [("http://only.yy/", "yy"), ("http://free.yy/", None)]
    df = spark.createDataFrame([(u, 1.0 if s == "zz" else 0.0 if s else None) for u, s in rows], "url string, label double")
    df = urls.parsed(df).withColumn("suffix", urls.suffix())
    table = {(r.suffix, r.fold): r for r in urls.suffix_statistics(df, f"file://{tmp_path}/s").collect()}
    own = {r.host: (r.suffix, r.fold) for r in df.withColumn("fold", urls.fold()).collect()}
    prior = 6 / 7
    assert table[own["only.yy"]].suffix_blocked == pytest.approx(2 * prior / 2)  # nothing but the prior: its own label isn't there
    assert table[own["only.yy"][0], -1].suffix_blocked == pytest.approx(2 * prior / 3)
    fold = own["a0.zz"]
    others = sum(own[f"a{i}.zz"][1] != fold[1] for i in range(6))
    assert table[fold].suffix_blocked == pytest.approx((others + 2 * prior) / (others + 2))


def test_very_long_urls(spark):
    long = "http://a.net/" + "x9/" * 300_000
    got = urls.filter_urls(spark.createDataFrame([(1, long), (2, "http://b.org/fr/x"), (3, "http://c.io/" + "?a=1" * 100_000)], "page_id long, url string")).collect()
    assert {r.page_id: (r.rule, len(r.path)) for r in got} == {1: ("net/", 900_001), 2: ("org/fr/", 5), 3: (None, 1)}


def test_toxicity_by_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    held = [(r.toxic, got[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(g.held_out for _, g in held)
    right = [g.predicted for t, g in held if t]
    wrong = [g.predicted for t, g in held if not t]
    assert sum(right) > 0.8 * len(right) and sum(wrong) < 0.03 * len(wrong)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} {'vile' if i % 5 == 0 else 'fine'}", "t", 1) for i in range(400)] + [(None, "vile", "t", 1), (401, None, "t", 1), (401, None, "t", 1)], "doc_id long, text string, score string, kind int")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    rows = toxicity.scored(docs, labels).collect()
    assert len(rows) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.predicted == (r.doc_id % 5 == 0) for r in rows if r.doc_id is not None and r.doc_id < 400)
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.where("text like '%vile%'").count() == 0 and kept.count() == 322
    assert {r.score for r in toxicity.scored(docs, labels.limit(0)).collect()} <= {0.0, 1 / (1 + math.exp(50))}
    assert toxicity.scored(docs.limit(0), labels).count() == 0


def test_toxicity_learns_from_confirmed_documents_alone(spark):
    """All labels are toxic: the plain positive-unlabelled input. And a very long text among them."""
    docs = [(i, f"word{i % 7} {'vile' if i % 5 == 0 else 'fine'}") for i in range(400)] + [(500, "vile " + " ".join(f"x{i}" for i in range(300_000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in [*range(0, 400, 10), 500]], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(df, labels, prior=0.2, words=50).collect()}
    assert all(got[d].predicted == ("vile" in t) for d, t in docs if d < 400)
    assert len(got) == len(docs) and 0 <= got[500].score <= 1
    assert toxicity.scored(df, labels).count() == len(docs)


def test_toxicity_slope_is_the_gradient_of_the_risk():
    rng = np.random.default_rng(6)
    for prior, shift in ((0.1, 0.0), (0.5, 3.0)):
        zp, zu = rng.normal(size=5) + shift, rng.normal(size=7) - shift
        bracket, got = toxicity.slope(zp, zu, prior)
        assert (bracket < 0) == (shift > 0)

        def value(z):
            first, rest = toxicity.risk(z[:5], z[5:], prior)
            return first + rest if bracket >= 0 else -rest

        z = np.concatenate((zp, zu))
        want = [(value(z + 1e-5 * e) - value(z - 1e-5 * e)) / 2e-5 for e in np.eye(12)]
        assert np.allclose(got, want, atol=1e-6)


def test_lattice_sums_all_segmentations():
    own = lm.pieces(PIECES)
    logp = np.append(own.first, -np.inf)
    words = [b"the", b"nation", "été".encode(), b"x" * 40, "日本".encode(), b"\xff\xfe"]
    got = lm.log_probability(pa.array(words, pa.binary()), own, logp)
    number = {h: i for i, h in enumerate(own.hashes.tolist())}

    def piece(b):
        data, at = np.frombuffer(b, np.uint8), np.array([0, len(b)])
        return number.get(int(lm._spans(data, at)[0]))

    for w, g in zip(words, got):
        b, a = "▁".encode() + w, [1.0]
        for j in range(1, len(b) + 1):
            a.append(sum(a[i] * math.exp(logp[p]) for i in range(max(0, j - own.longest), j) if (p := piece(b[i:j])) is not None))
        assert math.log(a[-1]) == pytest.approx(g)
    counts = lm.expected(pa.array([b"the"], pa.binary()), np.array([2.0]), own, logp)
    assert (counts[:-1] * own.lengths).sum() == pytest.approx(2 * 6)


@pytest.mark.parametrize("rounds", [0, 1])
def test_document_scores_equal_a_plain_recursion(spark, tmp_path, rounds):
    """Every document's log-probability, from the same piece probabilities, word by word and byte by byte."""
    rnd = random.Random(3)
    vocab = ["the", "nation", "été", "日本", "running", "x9", "zzz", "lighthouse"]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(12)))) for i in range(60)] + [(100, None), (101, "neverseen the")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    own = lm.pieces(PIECES)
    train = [(d, t) for d, t in docs if zlib.crc32(str(d).encode()) % 10]
    counts = Counter(w for _, t in train for w in spaced(t, lower=True))
    table = spark.createDataFrame([(w.encode(), c) for w, c in counts.items()], "word binary, c long")
    logp = lm.fitted(table, PIECES, "ranks", rounds)
    number = {h: i for i, h in enumerate(own.hashes.tolist())}

    def probability(word):
        b, a = "▁".encode() + word.encode(), [1.0]
        for j in range(1, len(b) + 1):
            spans = [(i, number.get(int(lm._spans(np.frombuffer(b[i:j], np.uint8), np.array([0, j - i]))[0]))) for i in range(max(0, j - own.longest), j)]
            a.append(sum(a[i] * math.exp(logp[p]) for i, p in spans if p is not None))
        return a[-1]

    total = sum(counts.values()) + len(train)
    stop = (len(train) + 0.5) / (total + 1)
    for r in lm.score_documents(df, PIECES, rounds=rounds, lot_chars=300).collect():
        words = spaced(dict(docs)[r.doc_id], lower=True)
        assert r.score == pytest.approx(sum(math.log10(probability(w)) + math.log10(1 - stop) for w in words) + math.log10(stop), rel=1e-9)
    if rounds:  # the fit is likelier on its training words than its start
        start = lm.fitted(table, PIECES, "ranks", 0)
        arrays = pa.array([w.encode() for w in counts], pa.binary())
        weight = np.array(list(counts.values()))
        assert (lm.log_probability(arrays, own, logp) * weight).sum() > (lm.log_probability(arrays, own, start) * weight).sum()


def test_scores_equal_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "y " * 9000), (10**6 + 2, "y " * 9000), (None, "only here"), (10**6 + 3, "z" * 3000)]
    df = spark.createDataFrame([(*r, "w", 1) for r in docs], "doc_id long, text string, word string, c int")
    got = lm.score_documents(df, PIECES, lot_chars=100_000).collect()
    tokens = [(d, [*spaced(t, lower=True), None]) for d, t in docs]
    learned = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 != 0
    c = Counter(x for d, t in tokens if learned(d) for x in t)
    n, v = sum(c.values()), len(c)
    want = sorted([(d, len(t), sum(c[x] > 0 for x in t), n, d is not None and not learned(d)) for d, t in tokens], key=str)
    assert sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.held_out) for r in got], key=str) == want
    base = {d: sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t) for d, t in tokens}
    assert all(r.base_score == pytest.approx(base[r.doc_id], rel=1e-9) and r.score < 0 for r in got)
    own = [r for r in got if r.held_out]
    assert sum(r.score for r in own) / sum(r.n_tokens for r in own) > -9
    assert lm.score_documents(df.limit(0), PIECES).count() == 0
    assert rows_of(lm.score_documents(df.where("doc_id is null"), PIECES), "n_tokens", "n_known", "train_tokens") == [(3, 0, 0)]
