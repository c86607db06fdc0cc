"""Slow and plain versions of the operators, and tables to hold them against."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, extra=()):
    """documents of (doc_id, text) pairs; extra: further columns, by name, whose values are awkward."""
    schema = SCHEMA + "".join(f", `{c}` string" for c in extra)
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), *[None if (i or 0) % 2 else c for c in extra]) for i, t in rows], schema)


def prose(rng: random.Random, n: int, vocabulary: int = 5000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def split(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\t\n\x0b\x0c\r ]+", text or "") if w]


def fold(text: str | None) -> list[str]:
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in split(text)]


def bag(text: str | None) -> Counter:
    w = split(text)
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)


def jaccard(a: str | None, b: str | None) -> float:
    x, y = bag(a), bag(b)
    total = sum((x | y).values())
    return sum((x & y).values()) / total if total else 0.0


def near(rows: list[tuple[int, str | None]], threshold: float = 0.5) -> dict[tuple[int, int], float]:
    """Every pair of doc_ids whose nearest rows reach the threshold."""
    out: dict[tuple[int, int], float] = {}
    for i, a in rows:
        for j, b in rows:
            if i is not None and j is not None and i < j and (value := jaccard(a, b)) >= threshold:
                out[i, j] = max(value, out.get((i, j), 0))
    return out


def groups(pairs) -> dict[int, int]:
    """node -> least node of its component, for nodes that aren't the least."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root if find(x) != x}


def repeated(rows: list[tuple[int, str]], least: int) -> dict[tuple[int, int], set[int]]:
    """(doc_id, word) of each window's start that occurs at two places or more -> the other doc_ids that hold the window."""
    places = defaultdict(set)
    for i, text in rows:
        w = split(text)
        for at in range(len(w) - least + 1):
            places[tuple(w[at : at + least])].add((i, at))
    out = {}
    for found in places.values():
        if len(found) > 1:
            for i, at in found:
                out[i, at] = {j for j, _ in found if j != i}
    return out


def runs(a: list[str], b: list[str], least: int) -> list[tuple[int, int]]:
    """Longest common runs of `least` words or more, as (start, end) in b."""
    out, before = [], [0] * (len(b) + 1)
    for x in a + [None]:
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else 0
        for j in range(1, len(b) + 1):
            if before[j] >= least and (j == len(b) or row[j + 1] != before[j] + 1):
                out.append((j - before[j], j))
        before = row
    return out


def naive_best_two_fit(sizes: list[tuple[int, tuple]], capacity: int) -> list[list[int]]:
    """The packing rule word for word, over a sorted list."""
    left = sorted(sizes, key=lambda x: (-x[0], x[1]))
    bins = []
    while left:
        held, gap = [], capacity
        while (i := next((i for i, x in enumerate(left) if x[0] <= gap), None)) is not None:
            held.append(left.pop(i))
            gap -= held[-1][0]
        if gap and len(held) > 1 and left:
            room, best = gap + held[-1][0], (held[-1][0], None)
            for i, x in enumerate(left):
                for j in range(i + 1, len(left)):
                    if best[0] < x[0] + left[j][0] <= room:
                        best = (x[0] + left[j][0], (x[0], left[j][0]))
            if best[1]:
                out = held.pop()
                for size in best[1]:
                    held.append(left.pop(next(i for i, x in enumerate(left) if x[0] == size)))
                left = sorted([*left, out], key=lambda x: (-x[0], x[1]))
        bins.append([s for s, _ in held])
    return bins


PHRASES = """lorem ipsum|cookie policy|privacy policy|terms of use|terms of service|all rights reserved|enable javascript|javascript is disabled|use of cookies|subscribe to our|sign up for|click here
share on facebook|share on twitter|add to cart|skip to content|skip to main content|alle rechte vorbehalten|datenschutzerkl.rung|nutzungsbedingungen|verwendung von cookies|javascript aktivieren|hier klicken
klicken sie hier|teilen auf facebook|teilen auf twitter|in den warenkorb|zum inhalt springen|newsletter abonnieren|tous droits r.serv.s|politique de confidentialit.|conditions d.utilisation|utilisation de cookies
activer javascript|cliquez ici|partager sur facebook|partager sur twitter|ajouter au panier|aller au contenu|abonnez-vous|todos los derechos reservados|pol.tica de privacidad|condiciones de uso|uso de cookies
activar javascript|haga clic aqu.|compartir en facebook|compartir en twitter|a.adir al carrito|saltar al contenido|suscr.bete a"""
BOILERPLATE = re.compile(f"(?<![A-Za-z])(?:{PHRASES.replace(chr(10), '|')})", re.I | re.A)
ENDS = tuple(".!?…。！？:;,\"'”’»)]")
MENU = re.compile(r"[ \t\n\x0b\x0c\r]*(home|menu|next|previous|back|login|log in|sign in|search|contact us|about us)[ \t\n\x0b\x0c\r]*", re.I | re.A)


def bad_line(line: str) -> bool:
    w = split(line)
    dense = sum(map(len, w))
    again = any(len({re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w[i : i + 4]}) == 1 for i in range(len(w) - 3))
    bars = any(re.search(p, line) for p in (r" \| .* \| ", r" [»›>] .* [»›>] ", r" [·•] .* [·•] "))
    marks = sum(c in "#$%&*~^=_|<>{}@\\[]+" for c in line)
    shouts = len(re.findall(r"[!?]{2,}", line))
    return bool(bars or MENU.fullmatch(line) or BOILERPLATE.search(line) or marks > 0.1 * dense or shouts > 0.2 * len(w) or again or 0 < len(w) < 5 and not w[-1].endswith(ENDS))


def cleaned(text: str | None) -> str | None:
    """The text without failing lines, or None where the document is rejected."""
    if not split(text):
        return None
    out = "\n".join(line for line in text.split("\n") if not bad_line(line))
    dense = lambda t: sum(map(len, split(t)))
    return out if dense(out) >= 0.5 * dense(text) else None
