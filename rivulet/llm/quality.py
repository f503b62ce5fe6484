"""Quality rules with a linear-chain conditional random field over lines.

Every line with a word gets features; the field's Viterbi path marks it as content or boilerplate, and the share of a
document's words on content lines decides whether it is kept. The field is fitted by gradient ascent on its
log-likelihood over a sample of at most ``sample`` labelled documents (good documents' lines are content, low ones' boilerplate unless a first,
chainless fit takes a line for content); of a document with more than ``lines`` lines a stretch of so many takes part in the fit, at a place
that its doc_id decides. Every document is judged on all of its lines.

Defined results: a null or empty text has no words and fails the base rules; equal rows get equal results; a null doc_id is kept;
without labels of both kinds among the sample every line is content, and the base rules alone decide; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.arrow import map_blocks
from rivulet.llm.words import Words, blocks, covered, in_doc, per_doc_sum, repeated, sums

#: Documents with more lines are decoded one by one, the others of a block together.
TOGETHER = 64
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def _bytes_of(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_SYMBOL, _DIGIT, _UPPER, _BANG, _BAR, _STOP = map(_bytes_of, ("#*$%&|<>", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!", "|", ".!?"))
_LEADS = (np.arange(256) & 0xC0) != 0x80
FEATURES = 12


class Lines:
    """Counts of a block's documents, and features of their lines with a word."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        words = Words(data, at)
        n = words.docs
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, words.start, 1)
        np.add.at(inside, words.end, -1)
        self.n_words = words.count
        self.word_chars = sums((np.cumsum(inside)[:-1] > 0) & _LEADS[data], at)
        self.n_symbols = sums(_SYMBOL[data], at)
        starts = words.windows(8)
        twice = starts[repeated(in_doc(words.ranges(starts, starts + 8), words.doc[starts]))]
        again = covered(twice, twice + 8, len(words.hash))
        self.n_repeat_words = per_doc_sum(n, words.doc[again])
        lines = Words(data, at, _NOT_NEWLINE)
        edge = np.searchsorted(words.start, np.append(lines.start, len(data)))
        has = np.diff(edge) > 0
        self.start, self.end, self.doc = lines.start[has], lines.end[has], lines.doc[has]
        self.words = np.diff(edge)[has]
        key = in_doc(lines.hash[has], self.doc)
        first = np.zeros(len(key), bool)
        first[np.unique(key, return_index=True)[1]] = True
        self.n_dup_lines = per_doc_sum(n, self.doc[~first])
        self.lines = per_doc_sum(n, self.doc)
        size = np.maximum(self.end - self.start, 1)

        def share(table: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
            return (total[self.end] - total[self.start]) / size

        repeats = np.concatenate(([0], np.cumsum(again, dtype=np.int64)))
        word_edge = np.searchsorted(words.start, self.start)
        self.x = np.column_stack([
            np.ones(len(size)), np.minimum(self.words, 30) / 30, np.minimum(5 * share(_SYMBOL), 1), np.minimum(3 * share(_DIGIT), 1), share(_UPPER),
            (~first).astype(float), np.minimum(5 * share(_BANG), 1), np.minimum(size / self.words, 20) / 20, _STOP[data[self.end - 1]].astype(float) if len(size) else np.zeros(0),
            (self.words < 3).astype(float), (repeats[word_edge + self.words] - repeats[word_edge]) / self.words, np.minimum(10 * share(_BAR), 1),
        ])


# -- the field --------------------------------------------------------------------------------------------------------


def _posterior(score: np.ndarray, there: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each line, and expected moves; score (documents, lines): of content over boilerplate; there: which lines there are, from the first on.

    Documents are taken by falling length, so that step t works on those that have a line t only.
    """
    lengths = there.sum(1)
    order = np.argsort(-lengths, kind="stable")
    score, lengths = score[order], lengths[order]
    docs, n = score.shape
    many = np.searchsorted(-lengths, -np.arange(n), "left")  # documents with more than t lines
    a, b = np.zeros((docs, n, 2)), np.zeros((docs, n, 2))
    a[:, 0, 1] = score[:, 0]
    for t in range(1, n):
        m = many[t]
        a[:m, t] = np.logaddexp(a[:m, t - 1, :1] + move[0], a[:m, t - 1, 1:] + move[1])
        a[:m, t, 1] += score[:m, t]
    last = a[np.arange(docs), np.maximum(lengths - 1, 0)]
    z = np.logaddexp(last[:, 0], last[:, 1])
    moves = np.zeros((2, 2))
    for t in range(n - 1, 0, -1):
        m = many[t]
        own = b[:m, t].copy()
        own[:, 1] += score[:m, t]
        moves += np.exp(a[:m, t - 1, :, None] + move[None] + own[:, None, :] - z[:m, None, None]).sum(0)
        b[:m, t - 1] = np.logaddexp(own[:, :1] + move[None, :, 0], own[:, 1:] + move[None, :, 1])
    p = np.zeros_like(score)
    p[order] = np.exp(a[..., 1] + b[..., 1] - z[:, None])
    return p, moves


def fit(documents: list[tuple[np.ndarray, int]], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights of content over boilerplate, and scores of moves (from, to), of (features of lines, quality)."""
    documents = [x for x in documents if len(x[0])]
    if len({q for _, q in documents}) < 2:
        return np.eye(1, FEATURES)[0] * 10, np.zeros((2, 2))
    size = np.array([len(x) for x, _ in documents])
    x = np.concatenate([lines for lines, _ in documents])  # a line each; no document is filled up
    good = np.repeat(np.array([q for _, q in documents], float), size)
    weight = np.repeat(1 / size, size)  # a document counts once, however many lines it has
    share = np.where(good, 0.5 / (weight * good).sum(), 0.5 / (weight * (1 - good)).sum()) * weight
    w, move = np.zeros(FEATURES), np.zeros((2, 2))
    for _ in range(300):  # a first fit without the chain
        p = 1 / (1 + np.exp(-(x @ w)))
        w += 2 * ((good - p) * share) @ x - 1e-4 * w
    gold = np.where(good == 0, (x @ w > 0).astype(float), good)
    there = np.arange(size.max()) < size[:, None]
    score, labels = np.zeros(there.shape), np.zeros(there.shape)
    labels[there] = gold
    pairs = there[:, 1:]
    seen = np.array([[((labels[:, :-1] == i) & (labels[:, 1:] == j) & pairs).sum() for j in (0, 1)] for i in (0, 1)], float)
    for _ in range(rounds):
        score[there] = x @ w
        p, moves = _posterior(score, there, move)
        w += 4 * (gold - p[there]) @ x / len(x) - 1e-4 * w
        move += 4 * (seen - moves) / len(x) - 1e-4 * move
    return w, move


def viterbi(score: list[float], move: np.ndarray) -> list[int]:
    """The likeliest labels, 1 for content."""
    (bb, bc), (cb, cc) = move.tolist()
    back = []
    b, c = 0.0, score[0]
    for s in score[1:]:
        from_b, from_c = c + cb > b + bb, c + cc >= b + bc
        back.append((from_b, from_c))
        b, c = (c + cb if from_b else b + bb), (c + cc if from_c else b + bc) + s
    label = int(c >= b)
    out = [label]
    for from_b, from_c in reversed(back):
        label = int(from_c if label else from_b)
        out.append(label)
    return out[::-1]


def viterbi_together(scores: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """``viterbi`` of several documents, a line of all at a time; those with more than TOGETHER lines one by one."""
    out: list = [None] * len(scores)
    short = sorted((i for i, s in enumerate(scores) if 0 < len(s) <= TOGETHER), key=lambda i: -len(scores[i]))
    for i, s in enumerate(scores):
        if len(s) > TOGETHER:
            out[i] = np.array(viterbi(s.tolist(), move), bool)
        elif not len(s):
            out[i] = np.zeros(0, bool)
    if not short:
        return out
    lengths = np.array([len(scores[i]) for i in short])
    n = int(lengths[0])
    own = np.zeros((len(short), n))
    for row, i in enumerate(short):
        own[row, : lengths[row]] = scores[i]
    many = np.searchsorted(-lengths, -np.arange(n), "left")
    best, back = np.zeros((len(short), 2)), np.zeros((len(short), n, 2), np.int8)
    best[:, 1] = own[:, 0]
    for t in range(1, n):
        m = many[t]
        into = best[:m, :, None] + move[None]  # from, to
        back[:m, t] = np.stack([into[:, 1, 0] > into[:, 0, 0], into[:, 1, 1] >= into[:, 0, 1]], 1)
        best[:m] = into.max(1)
        best[:m, 1] += own[:m, t]
    label = np.zeros((len(short), n), np.int8)
    label[np.arange(len(short)), lengths - 1] = best[:, 1] >= best[:, 0]
    for t in range(n - 1, 0, -1):
        m = many[t]
        label[:m, t - 1] = back[np.arange(m), t, label[:m, t]]
    for row, i in enumerate(short):
        out[i] = label[row, : lengths[row]].astype(bool)
    return out


def sample_lines(docs: DataFrame, labels: DataFrame, sample: int, most: int) -> list[tuple[np.ndarray, int]]:
    """(features, quality) of at most sample labelled documents, those with the least hashes of their ids; at most ``most`` lines of each."""
    ids = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = docs.sparkSession.createDataFrame(ids.collect(), ids.schema)  # at most sample rows
    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def per_batch(batch: pa.RecordBatch):
        for first, n, data, at in blocks(batch.column("text")):
            lines = Lines(data, at)
            edge = np.concatenate(([0], np.cumsum(lines.lines)))
            own = batch.slice(first, n)
            begin = [a + (zlib.crc32(str(d).encode()) % (b - a - most + 1) if b - a > most else 0) for d, a, b in zip(own.column("doc_id").to_pylist(), edge[:-1].tolist(), edge[1:].tolist())]
            yield {"doc_id": own.column("doc_id"), "quality": own.column("quality"), "x": [lines.x[a : min(a + most, b)].astype("<f4").tobytes() for a, b in zip(begin, edge[1:].tolist())]}

    rows = map_blocks(own.select("doc_id", "quality", "text"), per_batch, "doc_id long, quality int, x binary").collect()
    return [(np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES).astype(float), r["quality"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["x"]))]


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_content_lines long, content_share double, kept boolean"


def quality(docs: DataFrame, labels: DataFrame, sample: int = 3000, least_share: float = 0.5, lines: int = 200) -> DataFrame:
    """The contract's columns, n_lines, n_content_lines and content_share; sample and lines bound the fit only."""
    w, move = fit(sample_lines(docs, labels, sample, lines))

    def per_batch(batch: pa.RecordBatch):
        for first, n, data, at in blocks(batch.column("text")):
            lines = Lines(data, at)
            content = np.concatenate(viterbi_together(np.split(lines.x @ w, np.cumsum(lines.lines)[:-1]), move))
            share = np.bincount(lines.doc, lines.words * content, n) / np.maximum(lines.n_words, 1)
            failed = (lines.n_words < 20) | (100 * lines.n_repeat_words > 30 * lines.n_words)
            yield {
                "doc_id": batch.column("doc_id").slice(first, n), "n_words": lines.n_words, "word_chars": lines.word_chars, "n_symbols": lines.n_symbols, "n_dup_lines": lines.n_dup_lines,
                "n_repeat_words": lines.n_repeat_words, "base_failed": failed, "n_lines": lines.lines, "n_content_lines": per_doc_sum(n, lines.doc[content]), "content_share": share, "kept": ~failed & (share >= least_share),
            }

    return map_blocks(docs.select("doc_id", "text"), per_batch, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
