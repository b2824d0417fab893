"""Operator 1: toxic spans by a linear-chain conditional random field.

The field has two labels (0 clean, 1 toxic) over the words of a sentence.  A word's potential is a sum of hashed
features (the whole word, its first 3 to 6 and last 3 and 4 bytes, its shape); neighbours share a 2 x 2 potential.
Tokens for training are labelled from the document labels: in a bounded, hash-chosen sample of labelled documents
a word is toxic if the word itself or one of its beginnings of 4 to 6 bytes occurs in toxic documents more often than
chance explains and (nearly) never in clean ones.  The field then generalises over these features.  Forward-backward gives each
word its marginal probability; a document's score is its largest marginal, its `expected_toxic` the sum of the
marginals, and runs of words at or over the threshold are the offending character offsets.

Plan: one narrow Arrow stage over the documents, no shuffle of texts; the model (about 1 MB) does not grow with
the data.  Only the bounded sample reaches the driver.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .support import give_back, stratified

BITS, BLOCK = 18, 256
SCHEMA = "n_tokens int, score double, expected_toxic double, toxic boolean, spans array<struct<start:int,end:int,score:double>>"
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], dtype=np.uint64)
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Crf:
    weights: np.ndarray
    bias: float
    trans: np.ndarray  # log potentials [from, to]

    def emissions(self, idx: np.ndarray) -> np.ndarray:
        return sum(self.weights[x].astype(np.float64) for x in idx) + self.bias


def _packed(low: np.ndarray, s: np.ndarray, e: np.ndarray, k: int, back: bool) -> np.ndarray:
    out = np.zeros(len(s), dtype=np.uint64)
    n = e - s
    for i in range(k):
        at = e - 1 - i if back else s + i
        ok = n > i
        out |= np.where(ok, low[np.where(ok, at, 0)], 0).astype(np.uint64) << np.uint64(8 * i)
    return out


def features(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Feature indices [8, tokens]."""
    low = tk.lower_latin(data)
    head, tail = _packed(low, s, e, 8, False), _packed(low, s, e, 8, True)
    n = (e - s).astype(np.uint64)
    caps = (data[s] != low[s]).astype(np.uint64) + (data[e - 1] != low[e - 1]).astype(np.uint64) * np.uint64(2) if len(s) else n
    out = np.empty((8, len(s)), dtype=np.int32)

    def put(i: int, x: np.ndarray) -> None:  # one at a time: a list of all would take 64 bytes a token
        out[i] = ((tk.mix(x + _MULT[i])) >> np.uint64(64 - BITS)).astype(np.int32)

    put(0, tk.range_hash(low, s, e))
    for i, k in enumerate((3, 4, 5, 6), 1):
        put(i, head & np.uint64((1 << (8 * k)) - 1))
    for i, k in enumerate((3, 4), 5):
        put(i, tail & np.uint64((1 << (8 * k)) - 1))
    put(7, caps * np.uint64(64) + np.minimum(n, np.uint64(24)))
    return out


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, rows, and the first word of each sentence."""
    s, e = tk.runs(tk.WORD[data], off)
    if not len(s):
        return s, e, s, s
    row = tk.rows_of(s, off)
    stops = np.cumsum(_STOP[data], dtype=np.int32)[s]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (stops[1:] != stops[:-1])))
    return s, e, row, np.flatnonzero(new)


def _step(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log-odds after a transition: t = [from, to] potentials, x = log-odds of the source label."""
    y = np.exp(np.clip(x, -40, 40))
    return np.log((y * t[1, 1] + t[0, 1]) / (y * t[1, 0] + t[0, 0]))


def _carried(em: np.ndarray, begin: np.ndarray, end: np.ndarray, new: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The log-odds that reach each block of a sentence from the one before it.

    A block is a product of 2 x 2 matrices.  All blocks are multiplied together, position by position; then each sentence's blocks are
    passed through one after the other.
    """
    out = np.zeros(len(begin))
    several = np.flatnonzero(~new | np.concatenate((~new[1:], [False])))
    if not len(several):
        return out
    at, stop = begin[several] + new[several], end[several]  # the first word of a sentence starts the vector
    m = np.tile(np.eye(2), (len(several), 1, 1))
    for p in range(int((stop - at).max(initial=0))):
        live = np.flatnonzero(at + p < stop)
        e = np.exp(np.clip(em[at[live] + p], -80, 80))[:, None]
        a, b = m[live, 0], m[live, 1]
        m[live, 0], m[live, 1] = t[0, 0] * a + t[1, 0] * b, e * (t[0, 1] * a + t[1, 1] * b)
        m[live] /= m[live].max(axis=(1, 2))[:, None, None]
    v = np.ones(2)
    for k, i in enumerate(several):
        if new[i]:
            v = np.array([1.0, np.exp(np.clip(em[begin[i]], -80, 80))])
        else:
            out[i] = np.log(v[1] / v[0])
        v = m[k] @ v
        v = np.maximum(v / v.max(), 1e-300)
    return out


def _chain(em: np.ndarray, first: np.ndarray, t: np.ndarray) -> np.ndarray:
    """a[i] = em[i] + step(a[i - 1]) within every sentence.

    Sentences are advanced together, longest first, in blocks of `BLOCK` words, so the loop runs over positions of a block and not over words.
    """
    n, a = len(em), em.copy()
    if not n:
        return a
    last = np.concatenate((first[1:], [n]))
    parts = -(-(last - first) // BLOCK)
    begin = np.repeat(first, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * BLOCK
    end = np.minimum(begin + BLOCK, np.repeat(last, parts))
    new = np.isin(begin, first, assume_unique=True)
    into = _carried(em, begin, end, new, t)
    a[begin[~new]] += _step(into[~new], t)
    size = end - begin
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    for p, k in enumerate(np.searchsorted(-size, -np.arange(1, size[0]), side="left") if size[0] > 1 else [], 1):
        i = begin[:k] + p
        a[i] = em[i] + _step(a[i - 1], t)
    return a


def forward_backward(em: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of forward messages (with the own emission) and of backward messages for every token."""
    t, n = np.exp(trans), len(em)
    a = _chain(em, first, t)
    ends = np.concatenate((first[1:], [n]))[: len(first)]
    return a, _chain(em[::-1], n - ends[::-1], t.T)[::-1] - em


def marginals(em: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    a, b = forward_backward(em, first, trans)
    return 1 / (1 + np.exp(-np.clip(a + b, -40, 40)))


def _beyond_chance(t: np.ndarray, c: np.ndarray, share: float, level: float) -> np.ndarray:
    """Which of the keys in t toxic and c clean documents are no accident, where a document is toxic with probability `share`.

    Of the keys found, a share of about `level` at most is there by chance (Benjamini and Hochberg).  P(t or more of t + c
    toxic) is bounded by C(t + c, c) * share ** t.
    """
    log_p = t * np.log(share) + c * (1 + np.log((t + c) / np.maximum(c, 1)))
    order = np.sort(log_p)
    passed = np.flatnonzero(order <= np.log(level * np.arange(1, len(order) + 1) / max(1, len(order))))
    return log_p <= order[passed[-1]] if len(passed) else np.zeros(len(t), dtype=bool)


def families(word: np.ndarray, row: np.ndarray, n: int, bands: int = 24) -> np.ndarray:
    """A number for each of `n` documents, the same for near copies: those that meet in a band of three MinHash values of word 3-grams.

    `word` holds word hashes, `row` their documents in order.  Documents linked through others share a number.
    """
    out = np.arange(n)
    if not len(word):
        return out
    gram = word.copy()
    for k in (1, 2):
        same = row[k:] == row[:-k]
        gram[:-k] = tk.mix(gram[:-k] + np.where(same, word[k:], np.uint64(0)) * _MULT[k])
    head = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    docs = row[head]
    groups, salt = [], np.arange(1, 3 * bands + 1, dtype=np.uint64) * _MULT[0]
    for b in range(bands):
        key = np.zeros(len(head), dtype=np.uint64)
        for k in range(3):
            key = tk.mix(key + np.minimum.reduceat(tk.mix(gram + salt[3 * b + k]), head))
        groups.append(np.unique(key, return_inverse=True)[1])
    while True:
        before = out.copy()
        for g in groups:
            least = np.full(g.max() + 1, n)
            np.minimum.at(least, g, out[docs])
            out[docs] = least[g]
        if (out == before).all():
            return out


def distant_labels(texts: list[str], toxic: np.ndarray, min_support: int = 6, level: float = 0.01, precision: float = 0.9) -> tuple[np.ndarray, ...]:
    """Bytes, offsets, words and 0/1 labels of the words of the sample (exact copies of a text count once).

    How many toxic documents a marker needs depends on chance alone, not on their number, so larger samples find rarer ones.
    Near copies share their label and all their words; against chance a family of them counts as one document.
    """
    seen: dict[str, int] = {}
    for t, y in zip(texts, toxic):
        seen[t] = max(seen.get(t, 0), int(y))
    texts, labels = list(seen), np.array(list(seen.values()), dtype=np.int64)
    data, off = tk.string_buffers(pa.array(texts, pa.large_string()))
    s, e, row, first = tokens(data, off)
    low = tk.lower_latin(data)
    head, n, whole = _packed(low, s, e, 8, False), e - s, tk.range_hash(low, s, e)
    n_tox = max(1, int(labels.sum()))
    n_clean = max(1, len(labels) - n_tox)
    kin = families(whole, row, len(labels))
    toxic_kin, clean_kin = np.unique(kin[labels == 1]), np.unique(kin[labels == 0])
    share = len(toxic_kin) / max(1, len(toxic_kin) + len(clean_kin))
    y = np.zeros(len(s), dtype=bool)
    if not labels.any():
        return data, off, s, e, row, first, y
    for k in (8, 4, 5, 6):
        value, ok = (whole, n >= 3) if k == 8 else (head & np.uint64((1 << (8 * k)) - 1), n > k)
        keys, inv = np.unique(value[ok], return_inverse=True)
        del value
        pair = np.unique(inv.astype(np.int64) * (len(labels) + 1) + row[ok])
        key, doc = pair // (len(labels) + 1), pair % (len(labels) + 1)
        t = np.bincount(key, weights=labels[doc], minlength=len(keys))
        c = np.bincount(key, weights=1 - labels[doc], minlength=len(keys))
        rt, rc = t / n_tox, c / n_clean
        good = (t >= min_support) & (rt / np.maximum(rt + rc, 1e-12) >= precision) & (c <= 0.02 * t)
        lone = np.unique((key * (len(labels) + 1) + kin[doc]) * 2 + labels[doc])
        at, toxic_one = lone // 2 // (len(labels) + 1), lone % 2
        t, c = np.bincount(at, weights=toxic_one, minlength=len(keys)), np.bincount(at, weights=1 - toxic_one, minlength=len(keys))
        often = t + c >= min_support
        good &= often
        good[often] &= _beyond_chance(t[often], c[often], share, level)
        y[np.flatnonzero(ok)[good[inv]]] = True
    return data, off, s, e, row, first, y


def train(texts: list[str], toxic: np.ndarray, rounds: int = 25, rate: float = 0.5, l2: float = 1e-4) -> Crf:
    """Maximum likelihood by AdaGrad over the whole sample; with no toxic word the field says clean everywhere."""
    crf = Crf(np.zeros(1 << BITS, dtype=np.float32), -5.0, np.zeros((2, 2)))
    if not len(texts):
        return crf
    data, off, s, e, row, first, y = distant_labels(texts, toxic)
    if not y.any():
        return crf
    idx = features(data, s, e)
    w, n = np.zeros(1 << BITS), len(s)
    gw, gb, gt = np.zeros(1 << BITS), 0.0, np.zeros((2, 2))
    inner = np.ones(n, dtype=bool)
    inner[first] = False
    nxt = np.flatnonzero(inner)
    seen_pairs = np.array([[np.sum(~y[nxt - 1] & ~y[nxt]), np.sum(~y[nxt - 1] & y[nxt])], [np.sum(y[nxt - 1] & ~y[nxt]), np.sum(y[nxt - 1] & y[nxt])]], dtype=float)
    scale = max(1.0, float(y.sum()))
    for _ in range(rounds):
        em = sum(w[x] for x in idx) + crf.bias
        a, b = forward_backward(em, first, crf.trans)
        p = 1 / (1 + np.exp(-np.clip(a + b, -40, 40)))
        d = y - p
        grad = sum(np.bincount(x, weights=d, minlength=1 << BITS) for x in idx) / scale - l2 * w
        gw += grad * grad
        w += rate * grad / (np.sqrt(gw) + 1e-8)
        g = d.sum() / scale
        gb += g * g
        crf.bias += rate * g / (np.sqrt(gb) + 1e-8)
        left, right = np.exp(np.clip(a[nxt - 1], -40, 40)), np.exp(np.clip(em[nxt] + b[nxt], -40, 40))
        t = np.exp(crf.trans)
        q = [np.full(len(nxt), t[0, 0]), right * t[0, 1], left * t[1, 0], left * right * t[1, 1]]
        z = q[0] + q[1] + q[2] + q[3]
        want = np.array([[(q[0] / z).sum(), (q[1] / z).sum()], [(q[2] / z).sum(), (q[3] / z).sum()]])
        g2 = (seen_pairs - want) / scale - l2 * crf.trans
        gt += g2 * g2
        crf.trans += 0.2 * rate * g2 / (np.sqrt(gt) + 1e-8)
    crf.weights = w.astype(np.float32)
    return crf


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Crf:
    """Train on at most 1.5 * 2 * `per_class` labelled documents, chosen by a hash of their id.

    Ids whose labels disagree count as toxic; labels without a document, null labels and null texts are left out.
    """
    one = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    ids = stratified(one, "_id", "_y", per_class)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id").where("_text is not null").select("_text", "_y").toArrow()
    return train(rows["_text"].to_pylist(), rows["_y"].to_numpy())


def score_texts(column: pa.Array, crf: Crf, threshold: float = 0.5) -> pa.StructArray:
    """SCHEMA for each text, in order; null and wordless texts have no tokens, score 0 and no spans."""
    n_tok, top, mass = [np.zeros(0, dtype=np.int32)], [np.zeros(0)], [np.zeros(0)]
    span_rows, spans = [], ([], [], [])
    for lo, hi, data, off in tk.slices(column):
        k = hi - lo
        s, e, row, first = tokens(data, off)
        p = marginals(crf.emissions(features(data, s, e)), first, crf.trans)
        n_tok.append(np.bincount(row, minlength=k).astype(np.int32))
        best = np.zeros(k)
        np.maximum.at(best, row, p)
        top.append(best)
        mass.append(np.bincount(row, weights=p, minlength=k))
        hot = np.flatnonzero(p >= threshold)
        if len(hot):
            fresh = np.concatenate(([True], (np.diff(hot) > 1) | np.isin(hot[1:], first)))
            a = np.flatnonzero(fresh)
            z = np.concatenate((a[1:], [len(hot)])) - 1
            r = row[hot[a]]
            span_rows.append(r + lo)
            spans[0].append(tk.char_index(data, off, s[hot[a]], r))
            spans[1].append(tk.char_index(data, off, e[hot[z]], r))
            spans[2].append(np.round(np.maximum.reduceat(p[hot], a), 6))
    n = len(column)
    per = np.bincount(np.concatenate(span_rows), minlength=n) if span_rows else np.zeros(n, dtype=np.int64)
    flat = [np.concatenate(x) if x else np.zeros(0) for x in spans]
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    items = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int32)), pa.array(flat[1].astype(np.int32)), pa.array(flat[2])], fields=list(kind))
    score = np.round(np.concatenate(top), 6)
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate(n_tok)), pa.array(score), pa.array(np.round(np.concatenate(mass), 6)), pa.array(score >= threshold), tk.list_array(items, per)],
        names=["n_tokens", "score", "expected_toxic", "toxic", "spans"],
    )


def scorer(docs: DataFrame, crf: Crf, threshold: float = 0.5):
    """Column function text -> SCHEMA with the model held in a broadcast variable."""
    held = docs.sparkSession.sparkContext.broadcast(crf)

    @F.arrow_udf(SCHEMA)
    def run(text: pa.Array) -> pa.Array:
        out = score_texts(text, held.value, threshold)
        give_back()
        return out

    return run


def toxic_spans(docs: DataFrame, crf: Crf, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score, expected_toxic, toxic, spans) for every row of `docs`.

    Null ids and repeated rows are scored like any other; null, empty and wordless texts get score 0; other columns
    are ignored, whatever their names.
    """
    run = scorer(docs, crf, threshold)
    out = docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col).cast("string")).alias("_r"))
    return out.select("doc_id", "_r.n_tokens", "_r.score", "_r.expected_toxic", "_r.toxic", "_r.spans")


def drop_toxic(docs: DataFrame, crf: Crf, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text is not toxic."""
    return docs.where(~scorer(docs, crf, threshold)(F.col(text_col).cast("string"))["toxic"])
