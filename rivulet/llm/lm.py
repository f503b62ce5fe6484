"""Subword lattice likelihood.

The pieces of an existing vocabulary span a lattice over each word; its arcs carry piece probabilities, and the forward
recursion in log space sums over all segmentations. A piece never crosses a word's border, so a document's marginal
log-probability is the sum over its words, and each distinct word is scored once.

What weights the arcs is the vocabulary's own scores, by the parameter ``scores``: "ranks" (default, for the vocabulary at hand, a pair-merge one whose
scores are minus the merges' ranks) takes them as Zipf's law has it, "log" (for a unigram vocabulary) as log-probabilities. With ``rounds`` of
expectation-maximisation over all training words (default 1) they are the start of a fit; with 0 they stand as they are. The default is 1 as
ranks alone are no probabilities: on held-out text they cost more than a refitted model.

Word counts are summed over the whole corpus by Spark. For scoring, documents are dealt into lots of about ``lot_chars`` characters; each lot
asks once for each of its distinct words, so neither vocabulary nor counts are ever held whole by one task.

Defined results: a null or empty text is the end token alone; rows given twice count twice and get equal scores; a row with a null
doc_id is scored, but neither held out nor learned from; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.arrow import keyed, map_blocks
from rivulet.llm.words import _BYTES, SPACED, Words, _byte_powers, blocks, buffers, mix
from rivulet.llm.workspace import materialize, scratch

_U = np.uint64
_MARK = "▁".encode()
_CELLS = 1 << 21


class Pieces:
    """A sentencepiece vocabulary: pieces as bytes, sorted hashes to find them by, and first probabilities from their ranks."""

    def __init__(self, path: str, scores: str = "ranks"):
        import sentencepiece

        if scores not in ("ranks", "log"):
            raise ValueError(f"scores are ranks or log, not {scores}")

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, weight = [], []
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                pieces.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
                weight.append(1e-3)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and model.get_score(i) > -1e6:
                pieces.append(model.id_to_piece(i).encode())
                weight.append(1000 / (1000 - model.get_score(i)) if scores == "ranks" else float(np.exp(model.get_score(i))))
        merged: dict[bytes, float] = {}
        for p, w in zip(pieces, weight):
            merged[p] = merged.get(p, 0) + w
        hashes = _spans(*buffers(pa.array(merged, pa.binary())))
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.lengths = np.array([len(p) for p in merged])[order]
        self.longest = int(self.lengths.max())
        p = np.array(list(merged.values()))[order]
        self.first = np.log(p / p.sum())


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _byte_powers.get(len(data) + 1)
    return np.concatenate(([_U(0)], np.cumsum(_BYTES[data] * up[:-1]))), down


def _spans(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    total, down = _prefix(data)
    return mix((total[at[1:]] - total[at[:-1]]) * down[at[:-1]] + np.diff(at).astype(_U))


@lru_cache(maxsize=2)
def pieces(path: str, scores: str = "ranks") -> Pieces:
    return Pieces(path, scores)


def lattices(words: pa.Array, own: Pieces):
    """(rows, ends, arcs): of words of one length; arcs (rows, k) are pieces' numbers or -1, from ends[j] on those that end after byte j."""
    marked = pc.binary_join_element_wise(pa.scalar(_MARK), words.cast(pa.binary()), pa.scalar(b""))
    data, at = buffers(marked)
    total, down = _prefix(data)
    size = np.diff(at)
    for n in np.unique(size).tolist():
        lengths = np.minimum(np.arange(1, n + 1), own.longest)
        ends = np.concatenate(([0], np.cumsum(lengths)))
        stop = np.repeat(np.arange(1, n + 1), lengths)
        span = np.arange(ends[-1]) - np.repeat(ends[:-1], lengths) + 1
        rows = np.flatnonzero(size == n)
        step = max(1, _CELLS // len(span))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            b = at[some][:, None] + stop
            h = mix((total[b] - total[b - span]) * down[b - span] + span.astype(_U))
            found = np.minimum(np.searchsorted(own.hashes, h), len(own.hashes) - 1)
            yield some, ends, np.where(own.hashes[found] == h, found, -1)


def forward(logp: np.ndarray, ends: np.ndarray, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(arcs' log-probabilities, log of the summed probability of each beginning); logp's last entry is that of no piece."""
    weight, n = logp[arcs], len(ends) - 1
    a = np.full((len(arcs), n + 1), -np.inf)
    a[:, 0] = 0
    for j in range(1, n + 1):
        t = a[:, j - (ends[j] - ends[j - 1]) : j][:, ::-1] + weight[:, ends[j - 1] : ends[j]]
        top = t.max(1)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            a[:, j] = safe + np.log(np.exp(t - safe[:, None]).sum(1))
    return weight, a


def log_probability(words: pa.Array, own: Pieces, logp: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words))
    for rows, ends, arcs in lattices(words, own):
        out[rows] = forward(logp, ends, arcs)[1][:, -1]
    return out


def expected(words: pa.Array, counts: np.ndarray, own: Pieces, logp: np.ndarray) -> np.ndarray:
    """How often each piece is expected in counts[i] times word i."""
    out = np.zeros(len(logp))
    for rows, ends, arcs in lattices(words, own):
        weight, a = forward(logp, ends, arcs)
        n = len(ends) - 1
        b = np.full(a.shape, -np.inf)
        b[:, n] = 0
        for j in range(n, 0, -1):
            lo = j - (ends[j] - ends[j - 1])
            t = a[:, lo:j][:, ::-1] + weight[:, ends[j - 1] : ends[j]] + b[:, j : j + 1]
            post = np.exp(t - a[:, n:]) * counts[rows][:, None]
            out += np.bincount(arcs[:, ends[j - 1] : ends[j]].ravel() % len(logp), post.ravel(), len(logp))
            b[:, lo:j] = np.logaddexp(b[:, lo:j], (weight[:, ends[j - 1] : ends[j]] + b[:, j : j + 1])[:, ::-1])
    out[-1] = 0
    return out


def distinct(words: Words) -> tuple[list[bytes], np.ndarray]:
    _, first, n = np.unique(words.hash, return_index=True, return_counts=True)
    raw = words.data.tobytes()
    return [raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist())], n


def held_out(folds: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def word_counts(train: DataFrame) -> DataFrame:
    """word (bytes), c."""

    def per_batch(batch: pa.RecordBatch):
        for _, _, data, at in blocks(batch.column("text"), 1 << 22):
            words, n = distinct(Words(data, at, SPACED, lower=True))
            yield {"word": words, "c": n}

    return map_blocks(train.select("text"), per_batch, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fitted(counts: DataFrame, path: str, scores: str, rounds: int) -> np.ndarray:
    """Log-probabilities of the pieces (and of no piece, at the end) after some rounds over the counted words."""
    first = np.append(pieces(path, scores).first, -np.inf)
    for _ in range(rounds):
        first = refit(counts, path, scores, first)
    return first


def refit(counts: DataFrame, path: str, scores: str, first: np.ndarray) -> np.ndarray:
    def per_batch(batch: pa.RecordBatch):
        got = expected(batch.column("word"), batch.column("c").to_numpy().astype(float), pieces(path, scores), first)
        there = np.flatnonzero(got)
        yield {"piece": there, "n": got[there]}

    sums = map_blocks(counts, per_batch, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row for each piece of the vocabulary at most
    n = 10 * np.exp(first)  # a few tokens by the first probabilities keep every piece possible
    for r in sums:
        n[r["piece"]] += r["n"]
    with np.errstate(divide="ignore"):
        return np.log(n / n.sum())


def score_documents(docs: DataFrame, vocabulary: str, folds: int = 10, lot_chars: int = 8_000_000, scores: str = "ranks", rounds: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    path = scratch(spark)
    # Rows without a doc_id aren't learned from.
    train = docs.where((F.crc32(F.col("doc_id").cast("string")) % folds) != 0)
    counts = materialize(word_counts(train), f"{path}/counts")
    seen = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    size = docs.agg(F.count("*").alias("docs"), F.count(F.when((F.crc32(F.col("doc_id").cast("string")) % folds) != 0, 1)).alias("train"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    ends = size["train"]
    total, kinds = seen["n"] + ends, seen["v"] + (ends > 0)
    logp = fitted(counts, vocabulary, scores, rounds)
    stop = np.log10((ends + 0.5) / (total + 1))
    go = np.log10(1 - (ends + 0.5) / (total + 1)) if total else np.log10(0.5)
    lots = max(1, -(-size["chars"] // lot_chars))

    def score_words(batch: pa.RecordBatch):
        yield {"word": batch.column("word"), "c": batch.column("c"), "w": log_probability(batch.column("word"), pieces(vocabulary, scores), logp) / np.log(10)}

    known = materialize(map_blocks(counts, score_words, "word binary, c long, w double"), f"{path}/known")
    dealt = keyed(docs, held_out(folds).alias("held_out")).withColumn("lot", F.pmod("row_key", F.lit(lots)))

    def ask(table: pa.Table) -> pa.Table:
        out = []
        for _, _, data, at in blocks(table["text"], 1 << 24):
            out.append(pa.array(distinct(Words(data, at, SPACED, lower=True))[0], pa.binary()))
        words = pa.chunked_array(out, pa.binary()).unique() if len(out) > 1 else pa.chunked_array(out, pa.binary())
        return pa.table({"lot": pa.array(np.full(len(words), table["lot"][0].as_py())), "word": words})

    # As many partitions as lots: a task gets one on average, and few more however many there are.
    dealt = dealt.repartition(int(lots), "lot")
    asked = dealt.groupBy("lot").applyInArrow(ask, "lot long, word binary").join(known, "word", "left").repartition(int(lots), "lot")

    def answer(texts: pa.Table, words: pa.Table) -> pa.Table:
        column = words["word"].combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        c = words["c"].fill_null(0).to_numpy().astype(float)
        w = words["w"].to_numpy().copy()
        new = np.flatnonzero(np.isnan(w))
        if len(new):
            w[new] = log_probability(column.take(pa.array(new)), pieces(vocabulary, scores), logp) / np.log(10)
        h = Words(*buffers(column), SPACED).hash  # a word each
        order = np.argsort(h)
        h, c, w = h[order], c[order], w[order]
        tokens, known_n, base, score = [], [], [], []
        for _, n, data, at in blocks(texts["text"]):
            own = Words(data, at, SPACED, lower=True)
            i = np.searchsorted(h, own.hash) if len(own.hash) else np.zeros(0, int)
            tokens.append(own.count + 1)
            known_n.append(np.bincount(own.doc, c[i] > 0, n) + (ends > 0))
            base.append(np.bincount(own.doc, np.log10(c[i] + 0.1), n) + np.log10(ends + 0.1))
            score.append(np.bincount(own.doc, w[i] + go, n) + stop)
        tokens = np.concatenate(tokens)
        return pa.table({
            "doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": tokens.astype(np.int64), "n_known": np.concatenate(known_n).astype(np.int64), "train_tokens": np.full(len(tokens), total),
            "base_score": np.concatenate(base) - tokens * np.log10(total + 0.1 * (kinds + 1)), "score": np.concatenate(score),
        })

    return dealt.groupBy("lot").cogroup(asked.groupBy("lot")).applyInArrow(answer, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
