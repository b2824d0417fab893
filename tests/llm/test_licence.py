import math
import re

import pytest

from loomquill.llm import licence as L
from loomquill.llm.licence_texts import TEMPLATES

BY_NAME = {t.name: t for t in TEMPLATES}


def words(t):
    return [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+", t or "")]


def brute(rows, templates=TEMPLATES, agree=L.AGREE):
    """The definition without an index: every template against every file, word by word."""
    lists = [[w for _, _, w in words(t)] for _, t in rows]
    sets = [set(x) for x in lists]
    out = []
    vocab = {w for t in templates for _, _, w in words(t.text)}
    idf = {w: math.log((len(rows) + 1) / (sum(w in s for s in sets) + 1)) for w in vocab}
    least = min(max(idf[w] for p in t.phrases for _, _, w in words(p) if w in vocab) for t in templates) - 1e-9
    chosen = {w for w in vocab if idf[w] >= least}
    for t in templates:
        tw = [w for _, _, w in words(t.text)]
        places = [i for i, w in enumerate(tw) if w in chosen]
        for (doc, text), fw in zip(rows, lists):
            hits = sorted((i - p, p) for i, w in enumerate(fw) if w in chosen for p in places if tw[p] == w)
            groups = []
            for d, p in hits:
                if groups and d - groups[-1][-1][0] <= L.slack(len(tw)) and d - groups[-1][0][0] <= L.DRIFT * L.slack(len(tw)):
                    groups[-1].append((d, p))
                else:
                    groups.append([(d, p)])
            for g in groups:
                found = len({p for _, p in g})
                a, b = max(0, g[0][0]), min(len(fw), g[-1][0] + len(tw))
                joined = " " + " ".join(fw[max(0, a - L.slack(len(tw))) : b + L.slack(len(tw))]) + " "
                if found >= math.ceil(agree * len(places) - 1e-9) and all(" " + " ".join(w for _, _, w in words(x)) + " " in joined for x in t.phrases):
                    w = words(text)
                    out.append((doc, t.name, w[a][0], w[b - 1][1], found))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.template, r.start, r.end, r.n_anchors) for r in L.licence_scan(df).collect()), key=str)


def test_equals_brute_force_on_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = got(docs)
    assert found == brute(rows) and len(found) >= 3


def test_texts_headers_and_edits(make):
    mit = BY_NAME["MIT text"].text
    commented = "\n".join("# " + line for line in BY_NAME["Apache-2.0 header"].text.split("\n"))
    edited = mit.replace("sublicense", "sublicence").replace("to deal in the Software", "to deal in the SOFTWARE (as such)")
    rows = [(1, "Copyright 2020 Å.\n\n" + mit), (2, commented + "\nimport x"), (3, edited), (4, "no licence here"), (5, mit[:200]), (6, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY 4.0."), (8, "under Licensed CC NC BY 4.0")]
    found = got(make(rows))
    assert found == brute(rows)
    names = {}
    for d, t, *_ in found:
        names.setdefault(d, set()).add(t)
    assert "MIT text" in names[1] and "Apache-2.0 header" in names[2] and "MIT text" in names[3]
    assert names[6] == {"CC-BY-NC-4.0 notice: licensed under"} and names[7] == {"CC-BY-4.0 notice: licensed under"}
    assert not {4, 5, 8} & set(names)


def test_offsets(make):
    text = "Ö é. Released under the MIT License. Ö. Released under the MIT License."
    rows = [r for r in got(make([(1, text)])) if r[1] == "MIT notice: released under"]
    assert len(rows) == 2 and all(text[s:e] == "Released under the MIT License" for _, _, s, e, _ in rows)


def test_odd_rows(make):
    notice = "Released under the MIT License."
    rows = [(1, None), (2, ""), (None, notice), (3, notice), (3, notice), (4, "word " * 200_000 + notice)]
    found = got(make(rows))
    assert found == brute(rows)
    assert {d for d, *_ in found} == {None, 3, 4}
    assert L.licence_scan(make([])).count() == 0 and L.licence_scan(make(rows), templates=()).count() == 0
    with pytest.raises(ValueError):
        L.licence_scan(make(rows), agree=0)
