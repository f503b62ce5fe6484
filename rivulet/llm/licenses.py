"""Fuzzy search for short licence notices.

Exact places come from hashes of consecutive words. For places with up to k edits, each phrase is split into k + 1 seeds: one of
them must be there unchanged (pigeonhole), so a plain search locates candidates in the text with its words joined by single spaces.
A notice starts and ends at words' borders, so a seed leaves a few spans of whole words, and the regex library's bounded-error
matching verifies each of them for itself: the work grows with the seeds found, not with their square.
Notices of one phrase don't overlap: those with fewer edits come first, of equals the leftmost. Edits count characters. A word that resembles a
phrase's word within the bound counts as it ("emit license" is one edit from "mit license").

Defined results: a null or empty text has no words; rows given twice get equal results; a null doc_id is kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from rivulet.llm.arrow import map_blocks
from rivulet.llm.words import ALNUM, LOWER, Words, blocks, buffers

# Phrase, label, edits allowed.
PHRASES = (("mit license", "mit", 1), ("apache license", "apache", 2), ("general public license", "gpl", 3))
_SPACES = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def seeds(phrase: str, edits: int) -> list[tuple[str, int]]:
    """edits + 1 pieces of the phrase, as even as can be, and their places."""
    edges = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(phrase[a:b], a) for a, b in zip(edges, edges[1:])]


class _Phrase:
    def __init__(self, phrase: str, label: str, edits: int):
        self.label, self.edits, self.size = label, edits, len(phrase)
        self.hashes = Words(*buffers(pa.array([phrase])), ALNUM).hash
        self.seeds = seeds(phrase, edits)
        self.patterns = [regex.compile(f"(?:{regex.escape(phrase)})" + (f"{{e<={e}}}" if e else "")) for e in range(edits + 1)]
        self.pattern = self.patterns[-1]
        self.distance = lru_cache(1 << 14)(self._distance)

    def exact(self, words: Words) -> np.ndarray:
        """First words of the places where the phrase's words stand consecutively in a document."""
        k = len(self.hashes)
        at = np.flatnonzero(words.hash[: max(len(words.hash) - k + 1, 0)] == self.hashes[0])
        for i in range(1, k):
            at = at[(words.hash[at + i] == self.hashes[i]) & (words.doc[at + i] == words.doc[at])]
        return at

    def _distance(self, text: str) -> int | None:
        """Edits between the phrase and the text, None beyond the bound."""
        if not self.pattern.fullmatch(text):
            return None
        return next(e for e, p in enumerate(self.patterns) if p.fullmatch(text))

    def fuzzy(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, edits) in a text with its words joined by single spaces."""
        near = set()
        for seed, offset in self.seeds:
            at = text.find(seed)
            while at >= 0:
                near.add(at - offset)
                at = text.find(seed, at + 1)
        if not near:
            return []
        size = np.array(list(map(len, text.split(" "))))
        ends = (np.cumsum(size + 1) - 1).tolist()
        starts = (np.array(ends) - size).tolist()
        firsts = {i for at in near for i in range(bisect_left(starts, at - self.edits), bisect_right(starts, at + self.edits))}
        spans = []
        for i in firsts:
            a = starts[i]
            for j in range(bisect_left(ends, a + self.size - self.edits), bisect_right(ends, a + self.size + self.edits)):
                if (e := self.distance(text[a : ends[j]])) is not None:
                    spans.append((e, i, j))
        taken, found = set(), []
        for e, i, j in sorted(spans):
            if taken.isdisjoint(range(i, j + 1)):
                taken.update(range(i, j + 1))
                found.append((starts[i], ends[j], e))
        return sorted(found)

    def notices(self, text: str) -> list[tuple[int, int, int]]:
        """(first word, words, edits)."""
        found, at, word, out = self.fuzzy(text), 0, 0, []
        for a, b, e in found:
            word += text.count(" ", at, a)
            words = text.count(" ", a, b) + 1
            out.append((word, words, e))
            at = a
        return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,word:long,words:long,edits:int,start:long,end:long,text:string>>"


def find_licenses(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """The contract's columns, and spans: label, first word, words, edits, place in the text's characters, the text there.

    phrases: (words of a-z and 0-9 joined by single spaces, label, edits allowed).
    """

    def per_batch(batch: pa.RecordBatch):
        own = [_Phrase(*x) for x in phrases]
        for first, n, data, at in blocks(batch.column("text")):
            words, raw = Words(data, at, ALNUM, lower=True), data.tobytes()
            exact = [(p, i) for p in own for i in p.exact(words).tolist()]
            by_doc: list[list] = [[] for _ in range(n)]
            for p, i in exact:
                by_doc[words.doc[i]].append((i - int(words.first[words.doc[i]]), p.label))
            out = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for d in range(n):
                whole = raw[at[d] : at[d + 1]]
                text = b" ".join(whole.translate(_SPACES).split()).decode(errors="replace")
                spans = [(w, p.label, k, e, p.size) for p in own for w, k, e in p.notices(text)]
                places = [w for w, _ in by_doc[d]]
                base = {x for _, x in by_doc[d]}
                out["n_base"].append(len(places))
                out["first_word"].append(min(places, default=None))
                out["last_word"].append(max(places, default=None))
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {label for _, label, _, _, _ in spans})))
                out["score"].append(1.0 if places else max((1 - e / size for _, _, _, e, size in spans), default=0.0))
                out["spans"].append(_placed(sorted(spans), whole.decode(errors="replace")) if spans else [])
            yield {"doc_id": batch.column("doc_id").slice(first, n), "n_words": words.count, **out}

    return map_blocks(docs.select("doc_id", "text"), per_batch, SCHEMA)


def _placed(spans: list[tuple], text: str) -> list[dict]:
    places = [m.span() for m in _WORD.finditer(text)]
    rows = [(label, w, k, e, places[w][0], places[w + k - 1][1]) for w, label, k, e, _ in spans]
    return [{"label": label, "word": w, "words": k, "edits": e, "start": a, "end": b, "text": text[a:b]} for label, w, k, e, a, b in rows]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
