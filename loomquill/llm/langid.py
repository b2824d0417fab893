"""Operator 6: language identification by segmentation-marginalised unigrams.

The pieces come from a fixed public vocabulary (a SentencePiece model file, given by path); pieces of letters are used,
in lower case, with a blank for the word border.  Every language has its own probability for each piece, fitted by
expectation-maximisation over all segmentations of the words of a bounded, hash-chosen sample of labelled documents.  The
probability of a word is the sum over all its segmentations, found by the forward recursion
``A[i] = sum_l A[i - l] p(piece)``; a byte that no piece covers has a small fixed probability.  A document's
log-likelihood is the sum over its words.  A word is a run of letters and marks in lower case, of any length: a sentence
without blanks is one word, and its probability is carried in rescaled numbers.  (Only for fitting, words of the sample are cut at
character borders into parts of about `SHORT` bytes.)

Plan: one narrow Arrow stage, no shuffle.  A slice of texts is reduced to its distinct words, and the recursion runs
over all words of one length and all languages together.  The model (vocabulary times languages) does not grow with the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .support import give_back, stratified

SHORT, FLOOR, CHUNK = 40, 1e-6, 4096
SLICE = 1 << 20
REMEMBERED = 500_000
_U = np.uint64
_B = _U(0x9E3779B97F4A7C15 | 1)
SCHEMA = "language string, log_odds double, per_byte double, n_words int"


def pieces(model_file: str) -> list[bytes]:
    """Letter pieces of the vocabulary as bytes, the word border as a blank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    out = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        body = p.replace("▁", "")
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or p.count("▁") > 1 or (body and not body.isalpha()) or p != p.lower():
            continue
        out[p.replace("▁", " ").encode()] = True
    return list(out)


def _poly(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), rows.shape[1] + 1), dtype=_U)
    for i in range(rows.shape[1]):
        out[:, i + 1] = out[:, i] * _B + rows[:, i].astype(_U) + _U(1)
    return out


_POW = np.concatenate(([_U(1)], np.multiply.accumulate(np.full(1 << 10, _B, dtype=_U))))


_K1, _K2 = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)


def _slot(h: np.ndarray, k: np.uint64) -> np.ndarray:
    return ((h ^ (h >> _U(29))) * k) >> _U(45)


@dataclass
class Model:
    languages: list[str]
    keys: np.ndarray  # sorted hashes of the pieces
    probs: np.ndarray  # [pieces + 1, languages]; the last row is no piece
    longest: int  # bytes of the longest piece

    def __post_init__(self) -> None:
        # two direct-mapped tables: keys that collide in the first one are found by the second, others by search
        none, n = np.int32(len(self.keys)), np.arange(len(self.keys), dtype=np.int32)
        self.one, self.two = np.full(1 << 19, none, dtype=np.int32), np.full(1 << 19, none, dtype=np.int32)
        self.padded = np.concatenate((self.keys, [_U(0)]))
        self.one[_slot(self.keys, _K1)] = n
        lost = n[self.one[_slot(self.keys, _K1)] != n]
        self.two[_slot(self.keys[lost], _K2)] = lost
        self.rest = lost[self.two[_slot(self.keys[lost], _K2)] != lost]
        self.known, self.values = np.zeros(0, dtype=_U), np.zeros((0, len(self.languages)))

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, or the number of pieces."""
        at = self.one[_slot(h, _K1)]
        miss = np.flatnonzero(self.padded[at] != h)
        if len(miss):
            x = h[miss]
            other = self.two[_slot(x, _K2)]
            other = np.where(self.padded[other] == x, other, np.int32(len(self.keys)))
            for r in self.rest:
                other[x == self.keys[r]] = r
            at[miss] = other
        return at

    def remembered(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the word hashes are known from earlier slices of this worker, and where."""
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        return (self.known[at] == h if len(self.known) else np.zeros(len(h), dtype=bool)), at

    def remember(self, h: np.ndarray, values: np.ndarray) -> None:
        """Keep the values of distinct new words; start afresh where there would be more than REMEMBERED."""
        if len(self.known) + len(h) > REMEMBERED:
            self.known, self.values = np.zeros(0, dtype=_U), np.zeros((0, len(self.languages)))
        both = np.concatenate((self.known, h))
        order = np.argsort(both, kind="stable")
        self.known, self.values = both[order], np.concatenate((self.values, values))[order]


def _lattice(model: Model, words: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Piece index of every substring (end, length) of words of one length."""
    acc = _poly(words)
    return {(i, n): model.lookup(acc[:, i] - acc[:, i - n] * _POW[n]) for i in range(1, words.shape[1] + 1) for n in range(1, min(i, model.longest) + 1)}


def _forward(model: Model, words: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """log p(word) [words, languages]."""
    acc, n = _poly(words), words.shape[1]
    none = len(model.keys)
    a = np.zeros((n + 1, len(words), probs.shape[1]))
    a[0] = 1.0
    for i in range(1, n + 1):
        a[i] = a[i - 1] * FLOOR
        for k in range(1, min(i, model.longest) + 1):
            at = model.lookup(acc[:, i] - acc[:, i - k] * _POW[k])
            hit = np.flatnonzero(at != none)
            if len(hit):
                a[i, hit] += a[i - k, hit] * probs[at[hit]]
    return np.log(a[n])


def _forward_long(model: Model, word: np.ndarray) -> np.ndarray:
    """log p(word) [languages] of one word of any length; messages are rescaled as they go."""
    s, width, n_lang = np.concatenate(([np.uint8(32)], word)), model.longest, len(model.languages)
    none, log = len(model.keys), np.zeros(n_lang)
    a = np.zeros((width, n_lang))  # the messages of the last positions
    a[-1] = 1.0
    for lo in range(0, len(s), CHUNK):
        hi, back = min(len(s), lo + CHUNK), min(lo, width)
        acc = _poly(s[None, lo - back : hi])[0]
        at = np.full((hi - lo, width), none, dtype=np.int64)  # at[i, -k]: the piece of k bytes that ends after position lo + i
        end = np.arange(back + 1, back + hi - lo + 1)
        for k in range(1, width + 1):
            ok = np.flatnonzero(end >= k)
            at[ok, width - k] = model.lookup(acc[end[ok]] - acc[end[ok] - k] * _POW[k])
        p = model.probs[at]
        p[:, -1] += FLOOR
        a = np.concatenate((a, np.zeros((hi - lo, n_lang))))
        for i in range(hi - lo):
            a[width + i] = (a[i : i + width] * p[i]).sum(axis=0)
            if i % 16 == 15 or i == hi - lo - 1:
                top = a[i + 1 : width + i + 1].max(axis=0)
                a[i + 1 : width + i + 1] /= top
                log += np.log(top)
        a = a[-width:]
    return log + np.log(a[-1])


def lettered(column: pa.Array) -> pa.Array:
    """Lower case; where there may be signs beyond ASCII, all that is neither letter nor mark becomes a blank."""
    low = pc.utf8_lower(column.cast(pa.large_string()))
    data, off = tk.string_buffers(low)
    data = data[off[0] : off[-1]]
    return pc.replace_substring_regex(low, r"[^\pL\pM]+", " ") if ((data == 0xC2) | (data >= 0xE1) | ((data >= 0xCA) & (data <= 0xCB))).any() else low


def _slices(column: pa.Array):
    """(bytes, offsets) of consecutive rows; few rows are lowered at once, so large batches need no second copy."""
    for at in range(0, len(column), 512):
        for _, _, data, off in tk.slices(lettered(column.slice(at, 512)), SLICE):
            yield data, off


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and starts, ends and rows of letter runs."""
    s, e = tk.runs(tk.LETTER[data], off)
    return data, s, e, tk.rows_of(s, off)


def _parts(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Long words of a sample in parts that end at character borders."""
    wide = np.flatnonzero(e - s > SHORT)
    begin, end = [np.delete(s, wide)], [np.delete(e, wide)]
    for w in wide:
        lead = s[w] + np.flatnonzero((low[s[w] : e[w]] & 0xC0) != 0x80)
        cut = np.unique(lead[np.minimum(np.searchsorted(lead, np.arange(s[w], e[w], SHORT - 4)), len(lead) - 1)])
        begin.append(cut)
        end.append(np.concatenate((cut[1:], e[w : w + 1])))
    return np.concatenate(begin), np.concatenate(end)


def _matrix(low: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate((np.full((len(s), 1), 32, dtype=np.uint8), low[s[:, None] + np.arange(n)]), axis=1)


def distinct_words(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and index of a sample of each distinct word and, for each word, its number among them."""
    return np.unique(tk.range_hash(low, s, e), return_index=True, return_inverse=True)


def log_words(model: Model, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    out = np.zeros((len(s), len(model.languages)))
    size = e - s
    for n in np.unique(size[size <= SHORT]):
        at = np.flatnonzero(size == n)
        out[at] = _forward(model, _matrix(low, s[at], int(n)), model.probs)
    for i in np.flatnonzero(size > SHORT):
        out[i] = _forward_long(model, low[s[i] : e[i]])
    return out


def fit_texts(texts: list[str], langs: list[str], vocabulary: list[bytes], rounds: int = 4, alpha: float = 0.05) -> Model:
    """EM over the labelled texts; languages in alphabetical order."""
    names = sorted(set(langs))
    h = np.array([int(_poly(np.frombuffer(p, dtype=np.uint8)[None, :])[0, -1]) for p in vocabulary], dtype=_U)
    keys = np.unique(h)
    longest = max(map(len, vocabulary), default=1)
    model = Model(names, keys, np.zeros((len(keys) + 1, len(names))), longest)
    for k, name in enumerate(names):
        data, off = tk.string_buffers(lettered(pa.array([t for t, g in zip(texts, langs) if g == name], pa.large_string())))
        low, s, e, _ = words_of(data, off)
        s, e = _parts(low, s, e)
        p = np.zeros(len(keys) + 1)
        if len(s):
            _, first, inv = distinct_words(low, s, e)
            weight = np.bincount(inv)
            s1, size = s[first], e[first] - s[first]
            groups = []
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                groups.append((int(n) + 1, weight[at].astype(float), _lattice(model, _matrix(low, s1[at], int(n)))))
            counts = np.zeros(len(keys) + 1)
            for n, w, lat in groups:
                for at in lat.values():
                    counts += np.bincount(at, weights=w, minlength=len(counts))
            for _ in range(rounds + 1):
                counts[-1] = 0
                p = (counts + alpha) / (counts.sum() + alpha * len(keys))
                p[-1] = 0
                counts = np.zeros(len(keys) + 1)
                for n, w, lat in groups:
                    a = np.zeros((n + 1, len(w)))
                    b = np.zeros((n + 1, len(w)))
                    a[0] = b[n] = 1
                    for i in range(1, n + 1):
                        a[i] = a[i - 1] * FLOOR + sum(a[i - m] * p[lat[i, m]] for m in range(1, min(i, longest) + 1))
                    for i in range(n - 1, -1, -1):
                        b[i] = b[i + 1] * FLOOR + sum(b[i + m] * p[lat[i + m, m]] for m in range(1, min(n - i, longest) + 1))
                    for (i, m), at in lat.items():
                        counts += np.bincount(at, weights=w * a[i - m] * p[at] * b[i] / a[n], minlength=len(counts))
        else:
            p[:-1] = 1 / max(1, len(keys))
        model.probs[:, k] = p
    return model


def fit(docs: DataFrame, model_file: str, per_language: int = 250, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most 1.5 * `per_language` documents a language, chosen by a hash of their id; null texts and languages are left out."""
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    rows = stratified(d, "_id", "_lang", per_language).where("_text is not null").select("_text", "_lang").toArrow()
    return fit_texts(rows["_text"].to_pylist(), rows["_lang"].to_pylist(), pieces(model_file))


def score_texts(column: pa.Array, model: Model) -> pa.StructArray:
    """SCHEMA for each text; a null or wordless text has a null language, log-odds 0 and 0 words."""
    n_lang = len(model.languages)
    total, n_words, n_bytes = [np.zeros((0, n_lang))], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for data, off in _slices(column):
        k = len(off) - 1
        low, s, e, row = words_of(data, off)
        t = np.zeros((k, n_lang))
        if len(s) and n_lang:
            h, first, inv = distinct_words(low, s, e)
            old, at = model.remembered(h)
            lp = np.empty((len(h), n_lang))
            lp[old] = model.values[at[old]]
            new = first[~old]
            lp[~old] = log_words(model, low, s[new], e[new])
            model.remember(h[~old], lp[~old])
            for j in range(n_lang):
                t[:, j] = np.bincount(row, weights=lp[inv, j], minlength=k)
        total.append(t)
        n_words.append(np.bincount(row, minlength=k))
        n_bytes.append(np.bincount(row, weights=e - s, minlength=k))
    t, w, nb = np.concatenate(total), np.concatenate(n_words), np.concatenate(n_bytes)
    if not n_lang:
        best = np.zeros(len(t), dtype=np.int64)
        w[:] = 0
        top = gap = np.zeros(len(t))
    else:
        best = t.argmax(axis=1) if len(t) else np.zeros(0, dtype=np.int64)
        ordered = np.sort(t, axis=1)
        top = ordered[:, -1]
        gap = ordered[:, -1] - ordered[:, -2] if n_lang > 1 else np.zeros(len(t))
    none = w == 0
    names = np.array([*model.languages, None], dtype=object)[np.where(none, n_lang, best)]
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.round(np.where(none, 0, gap), 4)), pa.array(np.round(np.where(none, 0, top) / np.maximum(nb, 1), 6)), pa.array(w.astype(np.int32))], names=["language", "log_odds", "per_byte", "n_words"])


def scorer(docs: DataFrame, model: Model):
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(SCHEMA)
    def run(text: pa.Array) -> pa.Array:
        out = score_texts(text, held.value)
        give_back()
        return out

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, log_odds, per_byte, n_words) for every row.

    log_odds is the lead over the second language in nats (a tie takes the language first in the alphabet).  Null ids
    and repeated rows are scored like any other; null, empty and wordless texts get a null language; other columns are ignored.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), scorer(docs, model)(F.col(text_col).cast("string")).alias("_r"))
    return out.select("doc_id", "_r.language", "_r.log_odds", "_r.per_byte", "_r.n_words")


def keep_identified(docs: DataFrame, model: Model, sure: float = 10.0, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` whose text has words and is not surely (`sure` nats) of another language than the one declared.

    Where the declared language is null or not among the model's, any language passes.
    """
    got = scorer(docs, model)(F.col(text_col).cast("string"))
    known = F.col(lang_col).isin(list(model.languages))
    wrong = known & (got["language"] != F.col(lang_col)) & (got["log_odds"] >= sure)
    return docs.where((got["n_words"] > 0) & ~F.coalesce(wrong, F.lit(False)))
