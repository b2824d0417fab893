"""Operator 8: licence scans by a positional index of rare template words.

Templates are licence texts, headers and one-line notices, with key phrases that a match must have.  Document frequencies of
all template words are counted over all files.  The index holds every position of a template word in every template: word -> (template, position).  A file
looks up its licence words of highest IDF: those at or above the largest IDF that every template has in its key phrases.  So the
look-up leaves out common words, and no match can be missed for it, as a match has the rarest word of its phrases.
Each posting gives the relative position of template and file (file position minus template position).  Postings of one template are intersected by
relative position: those that differ by no more than a small slack, for words inserted or dropped, belong together, up to a
drift of eight times the slack in all.  A stretch is a candidate if it has enough of the template's positions that are looked up, and a
match if all key phrases occur in it or within the slack around it.

Plan: one narrow counting stage whose result is bounded by the template words, and one narrow matching stage; no shuffle of
texts.  The index is a few kilobytes and doesn't grow with the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .licence_texts import TEMPLATES, Template

AGREE, DRIFT = 0.6, 8
SCHEMA = "doc_id long, licence string, template string, start int, end int, n_anchors int, n_expected int"


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the lower-case words."""
    low = tk.lower_latin(data)
    s, e = tk.runs(tk.WORD[low], off)
    return s, e, (tk.range_hash(low, s, e) if len(s) else np.zeros(0, dtype=np.uint64))


def hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return words(data, np.array([0, len(data)]))[2]


def slack(n_words: int) -> int:
    """By how much relative positions of neighbouring anchors may differ."""
    return 2 + n_words // 16


@dataclass
class Index:
    names: list[tuple[str, str]]  # licence, template
    sizes: list[int]  # words of each template
    expected: list[int]  # positions of each template that are looked up
    phrases: list[list[np.ndarray]]
    keys: np.ndarray  # sorted hashes of the words that are looked up
    first: np.ndarray  # postings of keys[i] are first[i] to first[i + 1]
    template: np.ndarray
    position: np.ndarray


def vocabulary(templates: tuple[Template, ...]) -> np.ndarray:
    return np.unique(np.concatenate([hashes(t.text) for t in templates])) if templates else np.zeros(0, dtype=np.uint64)


def document_frequencies(docs: DataFrame, vocab: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of files and, for each word of `vocab`, of files that have it; over all of (doc_id, text)."""

    def run(batches):
        for b in batches:
            count = np.zeros(len(vocab) + 1, dtype=np.int64)
            for lo, hi, data, off in tk.slices(b.column(0)):
                count[-1] += hi - lo
                s, _, h = words(data, off)
                at = find(vocab, h)
                hit = np.flatnonzero(at >= 0)
                if len(hit):
                    pairs = np.unique(tk.rows_of(s[hit], off) * len(vocab) + at[hit])
                    count[:-1] += np.bincount(pairs % len(vocab), minlength=len(vocab))
            at = np.flatnonzero(count)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], names=["w", "n"])

    got = docs.select("text").mapInArrow(run, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocab) + 1, dtype=np.int64)
    out[got["w"].to_numpy()] = got["n"].to_numpy()
    return int(out[-1]), out[:-1]


def find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash among the sorted `keys`, or -1; most hashes are turned away by a small table of 16-bit ends."""
    out = np.full(len(h), -1, dtype=np.int64)
    if not len(keys) or not len(h):
        return out
    table = np.zeros(1 << 16, dtype=bool)
    table[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    may = np.flatnonzero(table[(h & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, h[may]), len(keys) - 1)
    out[may] = np.where(keys[at] == h[may], at, -1)
    return out


def build_index(templates: tuple[Template, ...], vocab: np.ndarray, n_docs: int, df: np.ndarray) -> Index:
    """Every position of the template words whose IDF is at least what each template's key phrases reach."""
    idf = np.array([math.log((n_docs + 1) / (x + 1)) for x in df.tolist()])
    where = [np.searchsorted(vocab, hashes(t.text)) for t in templates]
    phrases = [[hashes(p) for p in t.phrases] for t in templates]
    best = []
    for p in phrases:
        at = find(vocab, np.concatenate(p)) if p else np.zeros(0, dtype=np.int64)
        best.append(float(idf[at[at >= 0]].max()) if (at >= 0).any() else 0.0)
    least = min(best, default=0.0) - 1e-9
    keep = [np.flatnonzero(idf[w] >= least) for w in where]
    word = np.concatenate([w[k] for w, k in zip(where, keep)]) if templates else np.zeros(0, dtype=np.int64)
    template, position = np.repeat(np.arange(len(keep)), [len(k) for k in keep]), np.concatenate(keep) if keep else np.zeros(0, dtype=np.int64)
    order = np.lexsort((position, template, word))
    used, start = np.unique(word[order], return_index=True)
    return Index([(t.licence, t.name) for t in templates], [len(w) for w in where], [len(k) for k in keep], phrases, vocab[used], np.concatenate((start, [len(order)])), template[order], position[order])


def _stretches(row: np.ndarray, t: np.ndarray, diag: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Where a new stretch of postings (sorted by row, template, relative position) begins."""
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (t[1:] != t[:-1]) | (diag[1:] - diag[:-1] > gap[1:])))
    while True:  # stretches that have drifted too far are cut there
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        far = diag - diag[head] > DRIFT * gap
        if not far.any():
            return new
        new |= far & ~np.concatenate(([False], far[:-1] & (head[1:] == head[:-1])))


def has_phrase(h: np.ndarray, phrase: np.ndarray) -> bool:
    n = len(phrase)
    at = np.flatnonzero(h[: max(0, len(h) - n + 1)] == phrase[0])
    for k in range(1, n):
        at = at[h[at + k] == phrase[k]]
    return len(at) > 0


def scan(column: pa.Array, index: Index, agree: float = AGREE):
    """(row, template, first word's start, last word's end, anchors found) of every match; offsets are in characters."""
    for lo, hi, data, off in tk.slices(column):
        s, e, h = words(data, off)
        at = find(index.keys, h)
        hit = np.flatnonzero(at >= 0)
        if not len(hit):
            continue
        n = index.first[at[hit] + 1] - index.first[at[hit]]
        tok = np.repeat(hit, n)
        p = np.repeat(index.first[at[hit]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        t, pos = index.template[p], index.position[p]
        row = tk.rows_of(s[tok], off)
        order = np.lexsort((pos, tok - pos, t, row))
        row, t, pos, diag = row[order], t[order], pos[order], (tok - pos)[order]
        gap = np.array([slack(x) for x in index.sizes])[t]
        new = _stretches(row, t, diag, gap)
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        pairs = np.unique(group * (max(index.sizes) + 1) + pos) // (max(index.sizes) + 1)
        found = np.bincount(pairs, minlength=len(head))
        need = np.ceil(agree * np.array(index.expected) - 1e-9).astype(np.int64)[t[head]]
        tail = np.concatenate((head[1:], [len(t)])) - 1
        begin_of = np.searchsorted(s, off)  # first word of each row
        for g in np.flatnonzero(found >= need):
            r, k = int(row[head[g]]), int(t[head[g]])
            a = max(int(diag[head[g]]), int(begin_of[r]))
            b = min(int(diag[tail[g]]) + index.sizes[k], int(begin_of[r + 1]))
            wide = slack(index.sizes[k])  # words may be inserted or dropped where there is no anchor
            near = h[max(a - wide, int(begin_of[r])) : min(b + wide, int(begin_of[r + 1]))]
            if all(has_phrase(near, x) for x in index.phrases[k]):
                ends = np.array([s[a], e[b - 1]])
                c = tk.char_index(data, off, ends, np.array([r, r]))
                yield lo + r, k, int(c[0]), int(c[1]), int(found[g])


def licence_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, agree: float = AGREE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA: a row for every match of a template in a file, with its character offsets.

    Null and empty texts match nothing; null ids and repeated rows are scanned like any other; a file with a notice
    twice has two rows; other columns are ignored.  Without templates nothing matches.
    """
    if not 0 < agree <= 1:
        raise ValueError("need 0 < agree <= 1")
    if any(not len(hashes(t.text)) or not all(len(hashes(p)) for p in t.phrases) for t in templates):
        raise ValueError("templates and key phrases need words")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vocab = vocabulary(templates)
    n, df = document_frequencies(d, vocab)
    index = build_index(templates, vocab, n, df)
    kind = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches):
        for b in batches:
            got = list(scan(b.column(1), index, agree)) if index.names else []
            if got:
                rows, t, start, end, found = zip(*got)
                ids = b.column(0).take(pa.array(rows))
                cols = [ids, [index.names[k][0] for k in t], [index.names[k][1] for k in t], start, end, found, [index.expected[k] for k in t]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, x) for c, x in zip(cols, kind)], names=["doc_id", "licence", "template", "start", "end", "n_anchors", "n_expected"])

    return d.mapInArrow(run, SCHEMA)
