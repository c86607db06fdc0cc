"""Licence scan against a search for every template at every place."""

import random
from collections import Counter

import brute
from lodestar.llm import license_scan
from lodestar.llm.license_templates import TEMPLATES
from lodestar.llm.license_scan import plain_words


def _brute(text):
    """Licences of which some window of a template's length and a drift holds every phrase and half of the words."""
    w, out = plain_words(text or ""), set()
    for name, template, phrases in TEMPLATES:
        t = plain_words(template)
        keys = [plain_words(p) for p in phrases]
        n = len(t) + 2 * license_scan.DRIFT
        starts = [[i for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k] for k in keys]
        if not all(starts):
            continue
        for i in starts[0]:
            for lo in range(max(0, i - n + 1), i + 1):
                window = w[lo : lo + n]
                inside = all(any(lo <= s and s + len(k) <= lo + n for s in found) for k, found in zip(keys, starts))
                if inside and sum((Counter(window) & Counter(t)).values()) >= license_scan.SCORE * len(t):
                    out.add(name)
                    break
    return out


def _found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, set()).add(r.license)
    return out


def test_every_template_is_found(spark):
    rng = random.Random(1)
    rows = [(i, brute.prose(rng, 50) + "\n" + t[1].upper().replace(" ", "\n * ") + "\n" + brute.prose(rng, 20)) for i, t in enumerate(TEMPLATES)]
    found = license_scan.scan_licenses(brute.table(spark, rows)).collect()
    for i, (name, template, _) in enumerate(TEMPLATES):
        best = [r for r in found if r.doc_id == i and r.license == name and r.score == 1.0]
        assert [(r.start, r.end) for r in best] == [(50, 50 + len(plain_words(template)))], name


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: found for r in docs.collect() if (found := _brute(r.text))}
    assert want and _found(license_scan.scan_licenses(docs)) == want


def test_edits_and_missing_phrases(spark):
    rng = random.Random(2)
    mit = TEMPLATES[0][1]
    edited = " ".join("other" if rng.random() < 0.05 and i > 32 else w for i, w in enumerate(mit.split(" ")) if i <= 32 or rng.random() > 0.03)
    rows = [(1, edited), (2, mit.replace("hereby granted", "hereby given")), (3, mit[:60]), (4, brute.prose(rng, 100) + " " + mit + " " + brute.prose(rng, 100) + " " + mit)]
    docs = brute.table(spark, rows)
    assert _found(license_scan.scan_licenses(docs)) == {i: f for i, t in rows if (f := _brute(t))} == {1: {"MIT"}, 4: {"MIT"}}
    assert license_scan.scan_licenses(docs.where("doc_id = 4")).count() == 2


def test_notices_close_to_each_other(spark):
    """Two short notices of one licence, the second with a word more between, are two places."""
    line = "Licensed under the Apache License, Version 2.0."
    n = len(plain_words(line))
    rows = [(1, line + " " + line), (2, f"{line} Also: {line} And so on. {line}")]
    found = {(r.doc_id, r.start) for r in license_scan.scan_licenses(brute.table(spark, rows)).collect() if r.license == "Apache-2.0"}
    assert found == {(1, 0), (1, n), (2, 0), (2, n + 1), (2, 2 * n + 4)}


def test_awkward_rows(spark):
    line = "Licensed under the Apache License, Version 2.0."
    rows = [(1, None), (2, ""), (3, " "), (None, line), (4, line), (4, line), (5, "word " * 200_000 + line)]
    docs = brute.table(spark, rows, extra=["license", "start", "end", "score", "word", "df"])
    found = sorted([(r.doc_id, r.license, r.start) for r in license_scan.scan_licenses(docs).collect()], key=str)
    assert found == sorted([(None, "Apache-2.0", 0), (4, "Apache-2.0", 0), (4, "Apache-2.0", 0), (5, "Apache-2.0", 200_000)], key=str)
    assert license_scan.scan_licenses(docs.limit(0)).collect() == []
