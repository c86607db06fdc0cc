"""Line-first cleaning: rules look at each line, failing lines go, and a document that loses too much text is rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import fresh

#: Lines that hold any of these are boilerplate; a dot stands for a letter with a mark, whose case engines fold unlike.
_PHRASES = (
    "lorem ipsum|cookie policy|privacy policy|terms of use|terms of service|all rights reserved|enable javascript|javascript is disabled|use of cookies|subscribe to our|sign up for|click here|share on facebook|share on twitter|add to cart|skip to content|skip to main content",
    "alle rechte vorbehalten|datenschutzerkl.rung|nutzungsbedingungen|verwendung von cookies|javascript aktivieren|hier klicken|klicken sie hier|teilen auf facebook|teilen auf twitter|in den warenkorb|zum inhalt springen|newsletter abonnieren",
    "tous droits r.serv.s|politique de confidentialit.|conditions d.utilisation|utilisation de cookies|activer javascript|cliquez ici|partager sur facebook|partager sur twitter|ajouter au panier|aller au contenu|abonnez-vous",
    "todos los derechos reservados|pol.tica de privacidad|condiciones de uso|uso de cookies|activar javascript|haga clic aqu.|compartir en facebook|compartir en twitter|a.adir al carrito|saltar al contenido|suscr.bete a",
)
_BY_LETTER = {x[0]: [y[1:] for p in _PHRASES for y in p.split("|") if y[0] == x[0]] for p in _PHRASES for x in p.split("|")}
#: A phrase begins after no letter; by first letters, so that few places of a text are tried with more than one.
BOILERPLATE = rf"(?i)(^|[^A-Za-z])({'|'.join(f'{x}({"|".join(rest)})' for x, rest in sorted(_BY_LETTER.items()))})"
#: Bars, arrows and bullets that part the entries of a navigation line; and lines that are one menu word.
_MENU = "(home|menu|next|previous|back|login|log in|sign in|search|contact us|about us)"
NAVIGATION = rf"( \| .* \| )|( [»›>] .* [»›>] )|( [·•] .* [·•] )|(?i)^\s*{_MENU}\s*$"
#: Marks that belong to no sentence, and runs of one mark.
SYMBOLS = r"[#$%&*~^=_|<>{}@\\\[\]+]"
SHOUTS = r"[!?]{2,}"
WORDS = r"\S+"
#: Words that follow themselves.
REPEATS = r"(?i)(?<!\S)(\S++)(?:\s++\1(?!\S)){3}"
#: What a line ends with that is no fragment; and lines of one to four words, of which those without an end are headings and menus, in whatever language.
END = r"[.!?…。！？:;,\"'”’»)\]]\s*\z"
FEW_WORDS = r"\A\s*\S+(\s+\S+){0,3}\s*\z"
#: Shares of a document's characters, white space aside.
MAX_LOST = 0.5
MAX_SYMBOLS = 0.1
MAX_SHOUTS = 0.2


#: What a whole text holds if one of its lines fails by the rule in the same place of bad_line(), and at times if none does; most texts hold none of it.
_SIGNS = (r" [|»›>·•] ", rf"(?imd)^[^\S\n]*+{_MENU}[^\S\n]*+$", BOILERPLATE, SYMBOLS, SHOUTS, REPEATS)
#: A line end after anything but an end mark; the last line's end is looked at by itself.
_NO_END = r"\n(?<![.!?…。！？:;,\"'”’»)\]\n]\n)"


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _dense(c: Column) -> Column:
    """Characters that aren't white space."""
    for space in " \t\n\x0b\f\r":
        c = F.replace(c, F.lit(space), F.lit(""))
    return F.length(c)


def bad_line(line: Column, signs: Column | int = -1) -> Column:
    """Whether a line fails: navigation, boilerplate, over a tenth of marks, shouting after a fifth of its words, a word over three times on end, or one to four words without an end.

    signs: which bits of _SIGNS the whole text has; a rule without its sign isn't looked at."""
    has = lambda *bits: F.lit(signs).bitwiseAND(F.lit(sum(1 << b for b in bits))) != 0
    return (
        (has(0, 1) & line.rlike(NAVIGATION))
        | (has(2) & line.rlike(BOILERPLATE))
        | (has(3) & (_count(line, SYMBOLS) > MAX_SYMBOLS * _dense(line)))
        | (has(4) & (_count(line, SHOUTS) > MAX_SHOUTS * _count(line, WORDS)))
        | (has(5) & line.rlike(REPEATS))
        | (has(6) & line.rlike(FEW_WORDS) & ~line.rlike(END))
    )


def clean(docs: DataFrame) -> DataFrame:
    """Documents that pass, all columns, with failing lines taken out of text and n_chars (where there is one) made to fit.

    A document is rejected if its lines that fail hold over half of its characters (white space aside), or if it
    has no text. So null, empty and blank texts are rejected. Rows are judged one by one: repeated rows get equal
    verdicts, and null in another column changes nothing. An empty table gives an empty one; a column of any
    other name is kept as it is; very long texts are judged line by line, whole."""
    text = F.col("text")
    held = [*(text.rlike(p) for p in _SIGNS), text.rlike(_NO_END) | ~F.right(text, F.lit(1)).rlike(END)]
    signs = sum((F.when(x, 1 << bit).otherwise(0) for bit, x in enumerate(held)), F.lit(0))
    mark, made = fresh(docs, "signs", "made")
    signed = docs.where("text is not null").withColumn(mark, signs)
    good = F.filter(F.split("text", "\n"), lambda x: ~bad_line(x, F.col(mark)))
    left = F.when(F.col(mark) == 0, text).otherwise(F.array_join(good, "\n"))
    # the cleaned text is an array's only element, so that it is made once and not once more for the filter
    passed = F.filter(F.array(left), lambda t: (_dense(text) > 0) & (_dense(t) >= (1 - MAX_LOST) * _dense(text)))
    out = signed.select("*", F.explode_outer(passed).alias(made)).where(F.col(made).isNotNull())
    fixed = [F.col(made).alias(c) if c == "text" else F.length(made).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*fixed)


_WS = r"[ \t\n\x0B\f\r]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: RE2 knows no back references: words that follow themselves are found by comparing a list of words with itself.
ORACLE = f"""
WITH d AS (SELECT *, row_number() OVER () AS r FROM documents WHERE text IS NOT NULL),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
w AS (SELECT *, length(regexp_replace(line, '{_WS}', '', 'g')) AS dense, list_filter(regexp_split_to_array(translate(line, '{_UPPER}', '{_UPPER.lower()}'), '{_WS}+'), lambda x: x <> '') AS words FROM l),
b AS (SELECT *, regexp_matches(line, '{NAVIGATION.replace(chr(92) + "s", _WS)}') OR regexp_matches(line, '{BOILERPLATE}')
        OR len(regexp_extract_all(line, '{SYMBOLS}')) > CAST({MAX_SYMBOLS} AS DOUBLE) * dense OR len(regexp_extract_all(line, '{SHOUTS}')) > CAST({MAX_SHOUTS} AS DOUBLE) * len(words)
        OR len(list_filter(range(1, greatest(len(words) - 2, 1)), lambda i: words[i] = words[i + 1] AND words[i] = words[i + 2] AND words[i] = words[i + 3])) > 0
        OR (len(words) BETWEEN 1 AND 4 AND NOT regexp_matches(line, '{END.replace(chr(39), chr(39) * 2).replace(chr(92) + "s", _WS)}')) AS bad FROM w),
t AS (SELECT r, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT bad) AS kept, sum(dense) AS whole, coalesce(sum(dense) FILTER (WHERE NOT bad), 0) AS rest FROM b GROUP BY r)
SELECT doc_id, kept AS text, lang, source, CAST(length(kept) AS BIGINT) AS n_chars FROM d JOIN t USING (r) WHERE whole > 0 AND rest >= {1 - MAX_LOST} * whole
"""
