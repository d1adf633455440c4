"""PII, line dedup, licences, toxicity, mixing: rules, brute force and odd input."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitquarry.llm import licenses, line_dedup, mixing, pii, toxicity

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


PII_TEXTS = [
    "mail a.b@c.de, x@y.z_w@e.f and a@b no, 1.2.3.4.5.6.7.8 999.1.1.1 001.0255.3.4 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111000, +49 (30) 1234-567. +1 +12345678901234567",
    "4111 1111 1111 1111@b.com 日本 𝔘 x@y.zz +4930123456 1.1.1.1",
    "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 or DE89370400440532013001",
    "my ssn is 123-45-6789 but order 123-45-6789" + " filler" * 20 + " 321-54-9876",
    "a@" + "b." * 20000 + "c " + "1" * 30000 + " " + "9." * 20000,
]


def test_pii(make):
    docs = make(list(enumerate(PII_TEXTS)))
    found = {r["doc_id"]: r for r in pii.digest(pii.detect(docs)).collect()}
    for i, text in enumerate(PII_TEXTS):
        spans = base_spans(text)
        counts = Counter(k for k, _, _ in spans)
        assert [found[i][f"n_{k}"] for k in PATTERNS] == [counts[k] for k in PATTERNS], i
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert found[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), i
        assert found[i]["spans"].startswith(joined)
    assert found[3]["spans"].count("iban:") == 2
    assert found[4]["spans"] == "ssn:10:21"  # context is what stands between neighbouring matches of a kind


def test_pii_many(make):
    text = " ".join(f"u{i}@x.org" for i in range(5000))
    row = pii.digest(pii.detect(make([(1, text)]))).first()
    assert row["n_email"] == 5000 and row["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text))


def test_pii_redaction(make, odd, empty):
    texts = {r["doc_id"]: r["text"] for r in pii.redact(make(list(enumerate(PII_TEXTS[:4])))).collect()}
    assert texts[2] == "[PII] 日本 𝔘 [PII] [PII]"  # card and email overlap, and so do phone and address
    assert "DE89 3704" not in texts[3] and texts[3].endswith("DE89370400440532013001")
    kept = pii.redact(odd)
    assert kept.columns == odd.columns
    assert sorted(map(repr, kept.select("doc_id", "text").collect())) == sorted(map(repr, odd.select("doc_id", "text").collect()))
    assert pii.digest(pii.detect(odd)).count() == odd.count() and pii.redact(empty).count() == 0


def test_pii_tags_and_names(make):
    """A tag with quotes, and a column that is spelt otherwise."""
    rows = make([(1, "mail a@b.de"), (2, "none")])
    got = pii.redact(rows.withColumnRenamed("text", "TEXT"), tag="it's \\ \"x\"")
    assert got.columns == ["doc_id", "TEXT", "lang", "source", "n_chars"]
    assert {r["doc_id"]: r["TEXT"] for r in got.collect()} == {1: "mail it's \\ \"x\"", 2: "none"}


def test_pii_scores(make):
    rows = make([(1, "call me: +49 30 1234567"), (2, "value +49 30 1234567")])
    score = {r["doc_id"]: r["pii"][0]["score"] for r in pii.detect(rows).collect()}
    assert score[1] > score[2]


def test_pii_whole_context(make):
    """Neighbouring matches of a kind do not shorten the window of context words."""
    texts = ["SSNs: 123-45-6789, 223-45-6789, 323-45-6789", "123-45-6789 223-45-6789 is my ssn", PII_TEXTS[4], PII_TEXTS[5], " ".join(f"{i} {i}{i}-45-6789" for i in range(10, 40)) + " 123-45-6789" * 9 + " ssn"]
    rows = pii.detect(make(list(enumerate(texts))), whole_context=True).collect()
    for r in rows:
        text = texts[r["doc_id"]]
        want = [m.span() for m in re.finditer("[0-9]{3}-[0-9]{2}-[0-9]{4}", text) if not re.match("000|666|9", m[0]) and re.search("(?i)ssn|social|security|taxpayer", text[max(0, m.start() - 40) : m.start()] + "\n" + text[m.end() : m.end() + 40])]
        assert [(s["start"], s["end"]) for s in r["pii"] if s["kind"] == "ssn"] == want, r["doc_id"]
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(make(list(enumerate(texts)))).collect()}
    assert redacted[0] == "SSNs: [PII], [PII], [PII]" and redacted[1] == "[PII] [PII] is my ssn"


LONG = "one two three four five six seven"


def test_line_dedup(make, odd, empty):
    docs = make([(1, f"{LONG}\nshort line\nAlpha beta gamma delta epsilon zeta. Tail of this."), (2, f"{LONG.upper()}  \nshort line"), (3, f"start {LONG} x. alpha  beta gamma delta epsilon zeta."), (4, f"{LONG}\n{LONG}")])
    got = sorted(map(tuple, line_dedup.duplicates(docs).collect()), key=lambda r: r[:2])
    assert [(r[0], r[1], r[4], r[5]) for r in got] == [(2, 0, 1, 0), (3, 1, 1, 2), (4, 0, 1, 0), (4, 1, 1, 0)]
    texts = {r["doc_id"]: r["text"] for r in line_dedup.remove(docs).collect()}
    assert texts[2] == "  \nshort line" and texts[4] == "\n" and texts[3] == f"start {LONG} x. "
    spans = {r["doc_id"]: r["removed"] for r in line_dedup.remove(docs).collect()}
    assert [tuple(x) for x in spans[4]] == [(0, len(LONG)), (len(LONG) + 1, 2 * len(LONG) + 1)] and spans[1] == []
    assert line_dedup.duplicates(odd).count() == 0 and line_dedup.remove(odd).count() == odd.count()
    assert set(line_dedup.remove(odd).columns) == set(odd.columns)
    assert line_dedup.duplicates(empty).count() == 0
    assert [line_dedup.units("a\n\nb\nc", k) for k in ("line", "paragraph")] == [[(0, 1), (3, 3), (3, 4), (5, 6)], [(0, 1), (3, 6)]]


def test_line_dedup_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first, want = {}, set()
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        for u, (low, high) in enumerate(line_dedup.units(r["text"], "line")):
            w = r["text"][low:high].lower().split()
            if len(w) >= 3:
                place = first.setdefault(tuple(w), (r["doc_id"], u))
                if place != (r["doc_id"], u):
                    want.add((r["doc_id"], u, low, high, *place))
    assert set(map(tuple, line_dedup.duplicates(docs, "line", 3).collect())) == want and want


def test_line_dedup_of_repeated_ids(make):
    """Rows that share an id lose their own units alone; copies of a whole row are one document in rank."""
    other = "this different text must stay whole because nothing repeats"
    given = [(1, LONG), (6, LONG), (6, other), (6, f"x y\n{LONG}\n{other} not"), (9, f"{LONG}\n{LONG}"), (9, f"{LONG}\n{LONG}"), (None, LONG), (-5, "one row\nwith a negative id is first of all")]
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.remove(make(given), "line").collect()), key=repr)
    assert got == sorted([(1, LONG), (6, ""), (6, other), (6, f"x y\n\n{other} not"), (9, "\n"), (9, "\n"), (None, ""), given[-1]], key=repr)
    low = [(-5, "a b c d e f g"), (-6, "a b c d e f g"), (3, "a b c d e f g"), ((1 << 63) - 2, "a b c d e f g"), (-(1 << 63), "a b c d e f g")]
    found = sorted((r["doc_id"], r["first_doc_id"]) for r in line_dedup.duplicates(make(low)).collect())
    assert found == sorted((d, -(1 << 63)) for d, _ in low if d != -(1 << 63))
    first = line_dedup.duplicates(make([(4, LONG), (4, LONG + " eight"), (4, LONG)])).collect()
    assert first == []  # the same row twice is one occurrence


def test_line_dedup_hot_unit(make, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 4)
    rows = [(i, f"{LONG}\nline number {i // 2} of all these lines here") for i in range(300)]
    got = line_dedup.duplicates(make(rows), "line").collect()
    assert len(got) == 299 + 150 and {r["first_doc_id"] for r in got if r["unit"] == 0} == {0}


def test_line_dedup_whole(make, odd, empty):
    """Short lines, and long lines of short sentences, repeat too."""
    given = [(1, f"All rights reserved.\nNo. Yes. Maybe so. Not at all. Go on.\n{LONG}. Then x."), (2, f"x\nall rights  reserved.\nNo. Yes. Maybe so. Not at all. Go on.\nGo on. {LONG}."), (3, "All rights\nreserved.")]
    docs = make(given)
    rows = {(r["doc_id"], r["start"], r["end"]) for r in line_dedup.duplicates(docs, "all").collect()}
    second, third = given[1][1], given[2][1]
    cut = lambda text, doc: {text[s:e] for d, s, e in rows if d == doc}
    assert cut(second, 2) == {"all rights  reserved.", "No. Yes. Maybe so. Not at all. Go on.", f"{LONG}."} and cut(third, 3) == {third}
    texts = {r["doc_id"]: r["text"] for r in line_dedup.remove(docs, "all").collect()}
    assert texts[1] == given[0][1] and texts[2] == "x\n\n\nGo on. " and texts[3] == ""
    nested = {r["doc_id"]: r["text"] for r in line_dedup.remove(make([(1, f"{LONG}. {LONG} x. tail"), (2, f"a\n{LONG}. {LONG} x. tail\nb")]), "all").collect()}
    assert nested[2] == "a\n\nb"  # the sentences of a repeated line go with it, once
    assert line_dedup.duplicates(empty, "all").count() == 0 and line_dedup.remove(odd, "all").count() == odd.count()


def test_line_dedup_whole_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first, want, short = {}, set(), 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        t = r["text"]
        whole = {*line_dedup.units(t, "line"), *line_dedup.units(t, "paragraph")}
        for low, high in sorted(whole | {x for x in line_dedup.units(t, "sentence") if len(t[slice(*x)].split()) >= 6}):
            w = t[low:high].lower().split()
            if w and first.setdefault(tuple(w), (r["doc_id"], low)) != (r["doc_id"], low):
                want.add((r["doc_id"], low, high, first[tuple(w)][0]))
                short += len(w) < 6
    got = {(r["doc_id"], r["start"], r["end"], r["first_doc_id"]) for r in line_dedup.duplicates(docs, "all").collect()}
    assert got == want and short


def test_licenses(spark, make, odd, empty):
    apache = licenses.TEMPLATES["Apache-2.0-header"]
    changed = apache.replace("writing", "paper")
    rows = [(1, "x " * 50 + licenses.TEMPLATES["MIT"] + ". " + "y " * 9), (2, f"{'pre ' * 7}{changed}"), (3, "released under the license MIT"), (4, f"{apache}\n{apache}"), (5, "RELEASED under The mit-License")]
    got = defaultdict(list)
    for r in licenses.scan(make(rows)).collect():
        got[r["doc_id"]].append(r)
    assert [r["license"] for r in got[1]] == ["MIT"] and rows[0][1][got[1][0]["start"] : got[1][0]["end"]] == licenses.TEMPLATES["MIT"]
    assert [r["license"] for r in got[2]] == ["Apache-2.0-header"] and 0.8 <= got[2][0]["containment"] < 1
    assert 3 not in got and [r["license"] for r in got[4]] == ["Apache-2.0-header"] * 2 and [r["license"] for r in got[5]] == ["MIT"]
    assert licenses.scan(odd).count() == 0 == licenses.scan(empty).count()
    assert 1 - (1 - 1 / licenses.WINDOW) ** licenses.BANDS > 0.99999 and licenses.bands_for(0.5, 0.999) == 10


def test_license_wordings_and_versions():
    """Each notice is found under its own key, and no header under that of another licence or version."""
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    found = {key: {m[0] for m in scanner.scan(f"word {text} word")} for key, text in licenses.TEMPLATES.items()}
    assert [key for key in found if key not in found[key]] == []
    number = lambda key: tuple(re.match(r"(.*?)(?:-(\d[.\d]*))?(?:-(?!\d).*)?$", key).groups())
    assert [(key, other) for key in found for other in found[key] if number(other) != number(key)] == []
    for key in licenses._GNU_HEADERS:
        assert found[key] == {key}
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    for text, want in ((gpl, "GPL-3.0-or-later-header"), (gpl.replace("GNU", "GNU Lesser"), "LGPL-3.0-or-later-header"), (gpl.replace("GNU", "GNU Affero"), "AGPL-3.0-or-later-header"), ("it is Licensed under the MIT License.", "MIT-notice")):
        assert [m[0] for m in scanner.scan(text)] == [want]


def test_licenses_by_words(spark):
    """Names, offsets and containment against tuples of words, without the operator's hashes; the bands lose none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = lambda text: [(m[0], *m.span()) for m in re.finditer("[a-z0-9]+", text.lower())]
    grams = lambda ws: [tuple(w[0] for w in ws[i : i + 5]) for i in range(len(ws) - 4)]
    templates = {name: (set(grams(words(text))), int((len(words(text)) - 4) * 1.5) + 1) for name, text in licenses.TEMPLATES.items()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = licenses.scan(docs).collect()
    for r in got:
        ws = [w for w in words(texts[r["doc_id"]]) if r["start"] <= w[1] and w[2] <= r["end"]]
        own, wide = templates[r["license"]]
        assert ws[0][1] == r["start"] and ws[-1][2] == r["end"] and len(grams(ws)) <= wide
        assert abs(len(own & set(grams(ws))) / len(own) - r["containment"]) < 1e-9 and r["containment"] >= 0.8
    want = set()
    for doc, text in texts.items():
        if len(text) == len(text.lower()):
            g = grams(words(text))
            for name, (own, wide) in templates.items():
                at = [i for i, x in enumerate(g) if x in own]
                if any(len({g[j] for j in at if i <= j < i + wide}) >= 0.8 * len(own) for i in at):
                    want.add((doc, name))
    found = {(r["doc_id"], r["license"]) for r in got}
    assert len(want) > 30 and len(found & want) >= 0.999 * len(want) and found <= want | {(d, n) for d, n in found if len(texts[d]) != len(texts[d].lower())}


def test_licenses_far_into_long_texts(make):
    """Windows of all places are looked up, in groups of texts too."""
    notice = licenses.TEMPLATES["MIT-permission"]
    rows = [(i, "filler words here " * (40 * i) + notice + " more") for i in range(30)] + [(99, " ".join(f"w{k}" for k in range(60000)) + " " + notice)]
    got = sorted((r["doc_id"], r["start"]) for r in licenses.scan(make(rows)).collect() if r["license"] == "MIT-permission")
    assert got == [(i, t.index(notice)) for i, t in rows]


def test_licenses_against_brute_force(spark):
    """Templates whose shingles a stretch contains, tried at every place of every document."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    want = set()
    for r in docs.collect():
        s = licenses._shingles(re.findall("[a-z0-9]+", r["text"].lower()))
        for name, own in scanner.templates.items():
            hit = np.flatnonzero(np.isin(s, own))
            wide = int(scanner.lengths[name] * licenses.SPREAD) + 1
            if any(len(np.unique(s[hit[(hit >= h) & (hit < h + wide)]])) >= 0.8 * len(own) for h in hit):
                want.add((r["doc_id"], name))
    assert {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()} == want and len(want) > 30


def test_toxicity(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0
    model = toxicity.fit(docs, labels.filter(~part))  # held out: a quarter of the labels
    held = toxicity.score(docs, model).select("doc_id", F.col("toxic").alias("said"), "severity").join(labels.filter(part), "doc_id").toPandas()
    right = held["said"] == (held["toxic"] == 1)
    assert right.mean() > 0.97 and held[held["toxic"] == 0]["said"].mean() < 0.005
    assert held[held["toxic"] == 1]["severity"].mean() > 10 * held[held["toxic"] == 0]["severity"].mean()
    assert len(model.weights) <= toxicity.FEATURES
    assert toxicity.score(odd, model).count() == odd.count() == toxicity.accept(odd, model).count()
    assert toxicity.accept(odd, model).columns == odd.columns and toxicity.score(empty, model).count() == 0
    none = toxicity.fit(empty, labels)
    assert toxicity.score(odd, none).filter("toxic").count() == 0 and not none.weights


def test_toxicity_fit_is_the_likelihoods_maximum():
    """Against brute force: no step from the fitted weights and thresholds, in any direction tried, is likelier."""
    rng = np.random.default_rng(5)
    grade = rng.integers(0, 4, 400)
    has = rng.random((400, 3)) < (0.2 + 0.2 * grade[:, None]) * np.array([1.0, 0.7, 0.4])
    row, column = np.nonzero(has)

    def loss(w, t):
        p = 1 / (1 + np.exp(-((has @ w)[:, None] - t)))
        above = grade[:, None] > np.arange(3)
        return -np.where(above, np.log(p), np.log(1 - p)).sum() / len(grade) + toxicity.RIDGE / len(grade) * (w**2).sum() / 2

    w, t = toxicity._descend(row, column, 3, grade)
    best = loss(w, t)
    steps = [s * x for x in np.eye(6) for s in (0.05, -0.05)] + [0.05 * x / np.linalg.norm(x) for x in rng.normal(size=(200, 6))]
    assert all(loss(w + s[:3], t + s[3:]) > best - 1e-9 for s in steps) and (np.diff(t) > 0).all()
    grid = [(a, b, c) for a in np.linspace(-1, 3, 9) for b in np.linspace(-1, 3, 9) for c in np.linspace(-1, 3, 9)]
    assert best <= min(loss(np.array(g), t) for g in grid)


def test_toxicity_severity_of_held_out_grades(make, spark):
    """Ordinal labels: the expected severity of unseen documents follows their grade."""
    rng = np.random.default_rng(6)
    bad = [["rotten", "filthy"], ["vile", "wretched"], ["abominable", "despicable"]]
    rows, marks = [], []
    for i in range(1200):
        g = int(rng.integers(0, 4))
        words = ["".join(rng.choice(list("klmnostu"), 5)) for _ in range(20)] + [bad[k][rng.integers(0, 2)] for k in range(g)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, g))
    docs, labels = make(rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.filter("doc_id < 800"))
    got = toxicity.score(docs.filter("doc_id >= 800"), model).join(labels.withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    assert (got["grade"] == got["label"]).mean() > 0.95 and (got["severity"] - got["label"]).abs().mean() < 0.15


def test_toxicity_grades():
    """More than two labels are grades that share their weights."""
    rng = np.random.default_rng(0)
    features, labels = [], []
    for _ in range(600):
        grade = int(rng.integers(0, 4))
        features.append(np.array([100 + i for i in range(3) if grade > i] + [int(rng.integers(1000, 1200))], np.int64))
        labels.append(grade)
    model = toxicity.fit_rows(features, np.array(labels))
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    score = lambda n: toxicity._sigmoid(sum(model.weights.get(100 + i, 0) for i in range(n)) - model.thresholds).sum()
    assert score(0) < score(1) < score(2) < score(3) and score(0) < 0.5 and score(3) > 2.2


@pytest.mark.parametrize("target", [mixing.Target(repeats=1.5), mixing.Target(entropy=1.05), mixing.Target(repeats=2.0, budget=None)])
def test_mixing(make, target):
    rows = [(i, "w " * (5 + i % 7)) for i in range(3000)]
    docs = make(rows, source=lambda i: "hot" if i % 3 else "mid" if i % 2 else "rare")
    got = mixing.plan(docs, target).toPandas()
    tokens = got.groupby("source")["n_tokens"].sum().to_dict()
    assert sum(tokens.values()) == sum(5 + i % 7 for i in range(3000))
    w = mixing.weights(tokens, mixing.solve(tokens, target))
    budget = mixing.total_budget(tokens, w, target)
    if target.entropy:
        assert abs(mixing.entropy(w) - target.entropy) < 1e-6
    else:
        assert mixing.repetition(tokens, w, target) <= target.repeats * (1 + 1e-9)
    got["read"] = got["n_tokens"] * got["copies"]
    for s, n in got.groupby("source")["read"].sum().items():
        assert 0 <= budget * w[s] - n < 12, s  # the prefix falls short by less than one document
    if target.budget is None:
        assert got["copies"].min() == 1
    half = got[got["mix_key"] <= 0.5].groupby("source")["n_tokens"].sum()
    assert half.notna().all()
    again = mixing.plan(docs.repartition(7), target).toPandas()
    assert got.sort_values("doc_id")["copies"].tolist() == again.sort_values("doc_id")["copies"].tolist()


def test_mixing_is_what_was_asked(make):
    """Steep weights by exponents above 1; a target that no exponent meets is an error; sources of any type."""
    rows = [(i, "w " * 10) for i in range(1000)]
    docs = make(rows, source=lambda i: "big" if i % 10 else "small")
    steep = mixing.plan(docs, mixing.Target(entropy=0.1)).toPandas()
    tokens = {"big": 9000, "small": 1000}
    w = mixing.weights(tokens, alpha := mixing.solve(tokens, mixing.Target(entropy=0.1)))
    assert alpha > 1 and abs(mixing.entropy(w) - 0.1) < 1e-6
    read = (steep["n_tokens"] * steep["copies"]).groupby(steep["source"]).sum()
    assert all(0 <= 10000 * w[s] - read[s] <= 10 for s in w)
    for bad in (mixing.Target(repeats=2, budget=5), mixing.Target(entropy=1.0), mixing.Target(entropy=-0.5)):
        with pytest.raises(ValueError):
            mixing.plan(docs, bad)
    numbered = docs.withColumn("source", (F.col("doc_id") % 3).cast("int"))
    assert mixing.plan(numbered, mixing.Target(repeats=2.0)).count() == 1000
    assert mixing.mix(numbered, mixing.Target(repeats=2.0, budget=None)).schema == numbered.schema


def mixed_by_force(rows, target):
    """``copies`` from the definition: whole epochs, then the blocks' and the documents' order up to the budget."""
    from collections import defaultdict as dd

    tokens, docs = dd(int), dd(int)
    for r in rows:
        tokens[r["source"]] += len((r["text"] or "").split())
        docs[r["source"]] += 1
    w = mixing.weights(tokens, mixing.solve(tokens, target))
    budget = mixing.total_budget(tokens, w, target)
    return {s: (budget * w[s], tokens[s], docs[s]) for s in tokens}


@pytest.mark.parametrize("target", [mixing.Target(repeats=1.5), mixing.Target(entropy=0.9), mixing.Target(repeats=2.0, budget=None)])
def test_mixing_against_brute_force(make, target, monkeypatch):
    """Copies and order: the last epoch's prefix is the greatest that fits; ``mix`` gives the plan's copies, block after block."""
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "GROUP", 4)
    rows = [(i, "w " * (i % 9)) for i in range(1500)] + [(7, "w w w")] * 5
    docs = make(rows, source=lambda i: "hot" if i % 3 else "mid" if i % 2 else "rare")
    got = mixing.plan(docs, target)
    p = mixing._Plan(docs, target, 0)
    every = p.dealt.collect()
    budgets = mixed_by_force(docs.collect(), target)
    for source, (share, tokens, _) in budgets.items():
        own = sorted((r for r in every if r["__bq_of"] == source), key=lambda r: (r["__bq_turn"], r["__bq_block"], r["__bq_inner"], r["__bq_key"]))
        epochs = int(share / tokens * (1 + 1e-12))
        left, sums = share - epochs * tokens, Counter()
        groups = {}
        for r in own:  # equal rows enter together
            groups.setdefault((r["__bq_turn"], r["__bq_block"], r["__bq_inner"], r["__bq_key"]), []).append(r["n_tokens"])
        at = 0
        for place, sizes in groups.items():
            at += sum(sizes)
            sums[place[3]] = (epochs + (at <= left * (1 + 1e-12) and not (epochs and left < 0.5))) * len(sizes)
        copies = Counter()
        for r in got.filter(F.col("source") == source).select(F.xxhash64(F.lit(0), F.col("doc_id").cast("string"), "text").alias("key"), "copies").collect():
            copies[r["key"]] += r["copies"]
        assert copies == sums and sum(copies.values()) > 0
    mixed = mixing.mix(docs, target)
    want = Counter()
    for r in got.collect():
        want[r["doc_id"], r["text"]] += r["copies"]
    out = mixed.collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == +want
    # In the first tenths of the mixed corpus, sources stand in their weights.
    total = sum(len(r["text"].split()) for r in out)
    shares, at = Counter(), 0
    for r in out:
        at += (n := len(r["text"].split()))
        if at > 0.5 * total:
            break
        shares[r["source"]] += n
    whole = sum(s for s, _, _ in budgets.values())
    assert all(abs(shares[s] / (0.5 * total) - budgets[s][0] / whole) < 0.08 for s in budgets)
    # Block after block: a block's documents follow each other among their source's.
    block = {r["__bq_key"]: (r["__bq_of"], r["__bq_block"]) for r in every}
    keys = mixed.select(F.xxhash64(F.lit(0), F.col("doc_id").cast("string"), "text").alias("key")).collect()
    for source in budgets:
        runs = [k for k, _ in itertools.groupby(block[r["key"]][1] for r in keys if block[r["key"]][0] == source)]
        assert len(runs) <= (max(r["copies"] for r in got.collect()) + 1) * len({b for s, b in block.values() if s == source})


def test_mixing_odd(odd, empty):
    t = mixing.Target(repeats=3.0, budget=None)
    plan = mixing.plan(odd, t)
    assert plan.count() == odd.count() and plan.filter("copies < 1").count() == 0
    unknown = odd.withColumn("source", F.when(F.col("doc_id") > 4, F.col("source")))
    assert mixing.plan(unknown, t).filter("source is null").count() == unknown.filter("source is null").count() > 0
    assert mixing.mix(odd, t).columns == odd.columns and mixing.mix(empty, t).count() == 0
    with pytest.raises(ValueError):
        mixing.solve({"a": 1}, mixing.Target())
    assert mixing.solve({"a": 5, "b": 5}, mixing.Target(entropy=9.0)) == 0.0
