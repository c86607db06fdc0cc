"""Line rules against the plain version."""

import pytest

import brute
from lodestar.llm import quality_rules

LINES = [
    "A plain sentence that says something.", "Home | Products | About | Contact", "home", "  Login ", "Read our Privacy Policy for more.",
    "Wow!! Really?? Yes!!", "spam spam spam spam", "Spam spam SPAM spam ham", "spam spam spam", "### $$$ %%% ***", "a » b » c » d", "x · y · z · w",
    "The words privacy and policy apart.", "Alle Rechte vorbehalten 2020 bei uns hier.", "Unsere DATENSCHUTZERKLÄRUNG gilt für alle Seiten hier.", "Startseite", "Mentions légales", "Tous droits réservés, 2019, dans le monde entier.", "Política de privacidad y otras cosas que se leen.",
    "Añadir al carrito o seguir con la compra de hoy.", "Contact\u00e9z nous", "Short end.", "Who said so?", "«Oui»", "one two three four", "one two three four five", "four words that end:  ", "Kapitel 3", "(see note)", "Search for the truth.", "", "   ", "tab\tspam spam\tspam  spam", "he said: what?! and left the room again",
]


@pytest.mark.parametrize("line", LINES)
def test_each_line(spark, line):
    text = line + "\n" + "An ordinary sentence of many words follows here, long enough to hold the most of it. " * 2
    got = [r.text for r in quality_rules.clean(brute.table(spark, [(1, text)])).collect()]
    assert got == ([brute.cleaned(text)] if brute.cleaned(text) is not None else [])


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: t for r in docs.collect() if (t := brute.cleaned(r.text)) is not None}
    got = quality_rules.clean(docs).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert 0 < len(want) < docs.count()


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (None, "A sentence stands here."), (4, "fine text."), (4, "fine text."), (5, "menu\nhome\nok"), (6, "word of text.\n" * 60_000), (11, "word of text\n" * 10), (7, "spam " * 200_000), (8, "x" * 500_000 + " y"), (9, "\n" * 300_000 + "a fine line."), (10, " \r" * 200_000 + "\nhome")]
    docs = brute.table(spark, rows, extra=["line", "lines", "whole", "left", "signs", "Made", "_made"])
    got = quality_rules.clean(docs)
    assert got.columns == docs.columns
    same = ["doc_id", "signs", "Made", "_made"]
    assert {tuple(r[c] for c in same) for r in got.collect()} <= {tuple(r[c] for c in same) for r in docs.collect()}
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(i, t) for i, x in rows if (t := brute.cleaned(x)) is not None], key=str)
    assert quality_rules.clean(docs.limit(0)).collect() == []
