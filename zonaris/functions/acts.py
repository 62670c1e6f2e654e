"""Reading planning acts: tokens with offsets, clauses, scopes of zone symbols, quantities, conditions and findings.

A text is scanned once into tokens; everything after works on tokens and never searches the text again, so the time is in proportion
to its length. Clauses are kept on a stack by the rank of their list mark (paragraph, section, point, letter, dash): a mark closes
all clauses of its rank or an inner one. A clause inherits from the one around it the symbols that it holds for, and the parameter that the
heading ends with. Within a clause a value belongs to the nearest parameter before it, unless a sentence ends between them or it
is too far; nothing is guessed: a value without a parameter, or with a unit that does not suit it, is none.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

#: Stems of the words that name a parameter (of several words all must follow within four words), by family.
NOUNS = {
    "height": (("wysokoś",),),
    "bio": (("biologicznie", "czynn"),),
    "coverage": (("powierzchni", "zabudowy"), ("wskaźnik", "zabudowy")),
    "intensity": (("intensywnoś",),),
    "roof": (("nachyleni",), ("spadek", "połaci"), ("spadk", "połaci")),
    "parking": (("miejsc", "postojow"), ("miejsc", "parkingow")),
    "setback": (("linia", "zabudowy"), ("linię", "zabudowy"), ("linie", "zabudowy"), ("odległoś",)),
    "plot": (("powierzchni", "działk"),),
    "storeys": (("liczb", "kondygnacj"),),
    "other": (("szerokoś",), ("głębokoś",), ("ogrodze",), ("promie",), ("długoś",)),
}
#: Stems of things whose height is no parameter of a zone.
ASIDE = ("ogrodze", "reklam", "szyld", "maszt", "anten")
#: Units by their spelling, and the units that suit a family (`none`: a bare number).
UNITS = {"m": "metre", "mb": "metre", "m2": "area", "m²": "area", "mkw": "area", "ha": "hectare", "%": "percent", "procent": "percent", "°": "degree", "º": "degree", "˚": "degree", "stopni": "degree"}
UNIT_STEMS = {"kondygnacj": "storey", "stop": "degree", "metr": "metre", "miejsc": "place", "stanowisk": "place"}
SUITS = {
    "height": ("metre",), "bio": ("percent", "none"), "coverage": ("percent", "none"), "intensity": ("none", "percent"), "roof": ("degree", "none"), "parking": ("place", "none"), "setback": ("metre",),
    "plot": ("area", "hectare"), "storeys": ("storey", "none"), "other": ("metre", "area", "percent", "none", "degree", "storey", "place", "hectare"),
}
#: Least and most sensible value of a family.
BOUNDS = {"height": (0, 400), "storeys": (1, 40), "bio": (0, 100), "coverage": (0, 100), "intensity": (0, 20), "roof": (0, 90), "setback": (0, 500), "parking": (0, 100), "plot": (0, 10_000_000)}
#: Words that tell a limit, as stems.
MOST = ("maksym", "maks", "max")
LEAST = ("minim", "min")
NOT_OVER, NOT_UNDER = ("więcej", "wyższ", "większ", "przekracza"), ("mniej", "niższ", "mniejsz")
#: Small numbers in words.
NUMBERS = {"jedna": 1, "jedno": 1, "jeden": 1, "jednej": 1, "dwie": 2, "dwa": 2, "dwóch": 2, "trzy": 3, "trzech": 3, "cztery": 4, "czterech": 4, "pięć": 5, "pięciu": 5, "sześć": 6, "sześciu": 6}
#: Words before a number that make it a reference, and words that tell that symbols of zones follow.
REFERENCES = {"art", "ust", "pkt", "lit", "poz", "nr", "strona", "str", "dz", "rys", "zał"}
ABBREVIATIONS = REFERENCES | {"ul", "al", "os", "pl", "św", "im", "np", "tzw", "gen", "dr", "min", "maks", "max"}
SCOPE_STEMS = ("teren", "obszar", "symbol", "oznaczon", "jednost")
MONTH_STEMS = ("styczni", "lut", "mar", "kwiet", "maj", "czerw", "lip", "sierp", "wrze", "październik", "listopad", "grud")
GAP = 14  # tokens between a parameter and its value
WIDEST_RANGE = 200

_TOKEN = re.compile(
    r"(?P<num>(?<![\w.])\d{1,3}(?:[  ]\d{3})+(?:,\d+)?(?![\w,.]\w)|(?<![\w.])\d+(?:[.,]\d+)?(?![\d\w]|[.,]\d))"
    r"|(?P<unit>[%°º˚]|m²|m2\b)"
    r"|(?P<run>[^\W_]+(?:[./+\-][^\W_]+)*)"
    r"|(?P<line>\n)|(?P<sign>[§.;:,()!?–—\-])"
)
_MARKS = (("point", re.compile(r"\d+[a-z]?\)")), ("section", re.compile(r"\d+[a-z]?\.(?=\s)")), ("letter", re.compile(r"[a-ząćęłńóśźż]\)")), ("dash", re.compile(r"[–—-](?=\s)")))
_PARAGRAPH = re.compile(r"§\s*(\d+[a-z]?)\.?")
RANK = {"paragraph": 0, "section": 1, "point": 2, "letter": 3, "dash": 4}
_SYMBOL = re.compile(r"(?:\d+\.)*\d{0,3}[A-ZĄĆĘŁŃÓŚŹŻ]{1,4}(?:/[A-ZĄĆĘŁŃÓŚŹŻ]{1,4})*(?:[.\-]?\d{1,3})?")
_PARTS = re.compile(r"(\D*)(\d+)(\D*)")


@dataclass
class Token:
    kind: str  # num, unit, word, symbol, mark, line or the sign itself
    text: str
    start: int
    end: int
    value: float = 0.0  # of a number; of a word 1 if it begins with a capital


def tokens(text: str) -> list[Token]:
    """Tokens of a text; list marks are those at the start of a line. Words are in lower case."""
    out: list[Token] = []
    at, n, fresh = 0, len(text), True
    while at < n:
        if fresh:
            while at < n and text[at] in " \t ":
                at += 1
            fresh = False
            m = _PARAGRAPH.match(text, at)
            if m:
                out.append(Token("mark", "paragraph", at, m.end()))
                at, fresh = m.end(), True
                continue
            for kind, pattern in _MARKS:
                m = pattern.match(text, at)
                if m:
                    out.append(Token("mark", kind, at, m.end()))
                    at, fresh = m.end(), True
                    break
            if m:
                continue
        m = _TOKEN.search(text, at)
        if not m:
            break
        kind, raw = m.lastgroup, m.group()
        if kind == "num":
            out.append(Token("num", raw, m.start(), m.end(), float(raw.replace(" ", "").replace(" ", "").replace(",", "."))))
        elif kind == "run":
            symbol = _SYMBOL.fullmatch(raw) and any(c.isupper() for c in raw)
            out.append(Token("symbol" if symbol else "word", raw if symbol else raw.lower(), m.start(), m.end(), float(raw[0].isupper())))
        else:
            out.append(Token(kind if kind in ("unit", "line") else raw, raw, m.start(), m.end()))
        fresh = kind == "line"
        at = m.end()
    return out


def _masked(t: list[Token]) -> list[bool]:
    """Numbers of dates, references to laws and units of the act, journals and page footers."""
    out = [False] * len(t)
    for i, k in enumerate(t):
        if k.kind != "num":
            continue
        before = t[i - 1] if i else None
        prior = t[i - 2] if i > 1 else None
        after = t[i + 1] if i + 1 < len(t) else None
        dotted = before is not None and before.kind == "." and prior is not None and prior.text in REFERENCES
        out[i] = (
            before is not None and (before.text in REFERENCES or before.kind == "§") or dotted
            or after is not None and after.kind == "word" and (after.text.startswith(MONTH_STEMS) and k.value <= 31 and k.value == int(k.value) or after.text in ("r", "roku") and 1900 <= k.value <= 2200)
            or before is not None and before.kind == "word" and before.text.startswith(MONTH_STEMS) and 1900 <= k.value <= 2200
            or before is not None and before.text in ("z", "strona") and prior is not None and prior.kind == "num" and out[i - 2]
        )
    return out


def expanded(first: str, last: str) -> list[str] | None:
    """The symbols of a range such as 1MN to 3MN; null unless both have the same letters and the numbers rise by at most `WIDEST_RANGE`."""
    a, b = _PARTS.fullmatch(first), _PARTS.fullmatch(last)
    if not a or not b or (a[1], a[3]) != (b[1], b[3]) or not 0 <= int(b[2]) - int(a[2]) <= WIDEST_RANGE:
        return None
    return [f"{a[1]}{k}{a[3]}" for k in range(int(a[2]), int(b[2]) + 1)]


@dataclass
class Clause:
    """A list item: its tokens from `first` to `last` (exclusive) without those of its own items, the index of the clause around it, and what it hands on."""

    rank: int
    parent: int
    first: int
    last: int = 0
    start: int = 0
    end: int = 0
    symbols: list[str] = field(default_factory=list)


def clauses(t: list[Token], length: int) -> list[Clause]:
    """Clauses in order; the first is the whole text. `end` is where the last item inside ends."""
    out = [Clause(-1, -1, 0, len(t), 0, length)]
    stack = [0]
    for i, k in enumerate(t):
        if k.kind != "mark":
            continue
        rank = RANK[k.text]
        out[-1].last = i
        while out[stack[-1]].rank >= rank:
            out[stack.pop()].end = k.start
        out.append(Clause(rank, stack[-1], i + 1, len(t), k.start, length))
        stack.append(len(out) - 1)
    return out


def _symbol_groups(t: list[Token], a: int, b: int) -> Iterator[tuple[int, int, list[str]]]:
    """(first token, token after, symbols) of each list of symbols in a span that follows a word such as `terenu` or `symbolem`."""
    i, armed = a, False
    while i < b:
        k = t[i]
        if k.kind == "word" and k.text.startswith(SCOPE_STEMS):
            armed = True
        elif k.kind == "symbol" and armed:
            first, found = i, []
            while i < b:
                if t[i].kind == "symbol":
                    wide = expanded(t[i].text, t[i + 2].text) if i + 2 < b and t[i + 1].kind in "–—-" and t[i + 2].kind == "symbol" else None
                    one = t[i].text.split("-") if "-" in t[i].text else None
                    wide_one = expanded(*one) if one and len(one) == 2 else None
                    found += wide or wide_one or [t[i].text]
                    i += 3 if wide else 1
                elif t[i].kind == "," or t[i].text in ("i", "oraz", "lub", "a", "z") or t[i].kind == "word" and t[i].text.startswith(SCOPE_STEMS):
                    i += 1
                else:
                    break
            yield first, i, list(dict.fromkeys(found))
            armed = False
            continue
        elif k.kind in (";", "line") or k.kind == ".":
            armed = False
        i += 1


def scoped(t: list[Token], length: int) -> list[Clause]:
    """Clauses with the symbols that they hold for: the first list of symbols before any value, or those of the clause around."""
    out = clauses(t, length)
    for c in out:
        groups = _symbol_groups(t, c.first, c.last)
        head = next((s for f, _, s in groups if not any(k.kind == "num" for k in t[c.first : f])), None)
        c.symbols = head if head is not None else out[c.parent].symbols if c.parent >= 0 else []
    return out


def innermost(ranges: Sequence[tuple[int, int]], places: Sequence[int]) -> list[int]:
    """For each place the index of the range [start, end) around it that starts last (of equal ones the shorter, then the later); -1 for none.

    One sweep over starts and places with a heap of open ranges; ranges may be nested or interleaved.
    """
    order = sorted(range(len(ranges)), key=lambda k: ranges[k][0])
    out, heap, at = [-1] * len(places), [], 0
    for p in sorted(range(len(places)), key=lambda i: places[i]):
        while at < len(order) and ranges[order[at]][0] <= places[p]:
            k = order[at]
            heapq.heappush(heap, (-ranges[k][0], ranges[k][1], -k))
            at += 1
        while heap and heap[0][1] <= places[p]:
            heapq.heappop(heap)  # ended: no later place lies in it
        if heap:
            out[p] = -heap[0][2]
    return out


def scope_of(text: str, places: Sequence[int]) -> list[list[str]]:
    """The symbols that the clause around each place holds for; empty: all zones."""
    t = tokens(text)
    c = scoped(t, len(text))
    return [c[k].symbols for k in innermost([(x.start, x.end) for x in c], places)]


def _noun(t: list[Token], i: int, b: int) -> tuple[str, int] | None:
    """(family, token after) of a parameter that begins at token i; names of several words win."""
    if t[i].kind != "word":
        return None
    best: tuple[str, int] | None = None
    words = 0
    for family, names in NOUNS.items():
        for stems in names:
            if len(stems) <= words or not t[i].text.startswith(stems[0]):
                continue
            at = i + 1
            for stem in stems[1:]:
                stop = min(b, at + 4)
                while at < stop and not (t[at].kind == "word" and t[at].text.startswith(stem)):
                    at = stop if t[at].kind in (".", ";", ":", "num") else at + 1
                if at >= stop:
                    at = -1
                    break
                at += 1
            if at > 0:
                best, words = (family, at), len(stems)
    return best


def _limit(t: list[Token], i: int) -> str | None:
    """The limit that the word at i tells: max, min, or null."""
    k = t[i]
    if k.kind != "word":
        return None
    if k.text.startswith(MOST):
        return "max"
    if k.text.startswith(LEAST):
        return "min"
    before = t[i - 1].text if i else ""
    if before == "nie" or before in ("może", "mogą") and i > 1 and t[i - 2].text == "nie":
        return "max" if k.text.startswith(NOT_OVER) else "min" if k.text.startswith(NOT_UNDER) else None
    if k.text == "najmniej" and before == "co":
        return "min"
    return "max" if k.text == "do" else None


def _unit(t: list[Token], i: int) -> tuple[str, int]:
    """(unit, token after) of what stands at token i."""
    if i < len(t):
        k = t[i]
        if k.text in UNITS and k.kind in ("unit", "word"):
            return UNITS[k.text], i + 1
        if k.kind == "word":
            for stem, unit in UNIT_STEMS.items():
                if k.text.startswith(stem):
                    return unit, i + 1
    return "none", i


def normal(family: str, value: float, unit: str, raw: str, in_brackets: float | None = None) -> tuple[float, list[str]] | None:
    """A value in the family's unit and how it was changed; null if unit or size does not suit.

    Ratios of bio and coverage become per cent, also where `0,5 (50%)` tells both (flagged if they differ by over half a point), per cent of intensity a
    ratio, hectares square metres. A bare whole number from 1 to 100 is per cent, a bare number of a roof degrees.
    """
    if family not in BOUNDS or unit not in SUITS[family]:
        return None
    flags: list[str] = []
    if family in ("bio", "coverage") and unit == "none":
        if ("," in raw or "." in raw) and value <= 1:
            value, flags = round(value * 100, 9), ["ratio_to_percent"]
            if in_brackets is not None:
                same = abs(value - in_brackets) <= 0.51
                value, flags = (in_brackets, ["double_notation"]) if same else (value, [*flags, "double_notation_mismatch"])
        elif value == int(value) and 1 <= value <= 100:
            flags = ["implicit_percent"]
        else:
            return None
    elif family == "intensity" and unit == "percent":
        value, flags = round(value / 100, 9), ["percent_to_ratio"]
    elif family == "plot" and unit == "hectare":
        value, flags = value * 10_000, ["hectare_to_m2"]
    elif family == "roof" and unit == "none":
        flags = ["unit_implied"]
        if value > 90 and value % 10 == 0:
            value, flags = value / 10, ["degree_artifact"]  # the degree sign read as a zero
    elif family == "storeys" and value != int(value):
        return None
    least, most = BOUNDS[family]
    return (value, flags) if least <= value <= most and (value > 0 or least == 0 and family in ("bio", "coverage", "intensity", "roof")) else None


@dataclass
class Quantity:
    """A value of a parameter: least and most (one of them null for a limit), where it stands, and the symbols it holds for."""

    family: str
    operator: str
    low: float | None
    high: float | None
    flags: list[str]
    start: int
    end: int
    noun_start: int
    noun_end: int
    symbols: list[str]
    clause: int


def quantities(text: str) -> list[Quantity]:
    """All quantities of a text in order."""
    t = tokens(text)
    return _quantities(t, scoped(t, len(text)))


def _quantities(t: list[Token], found: list[Clause]) -> list[Quantity]:
    masked = _masked(t)
    out: list[Quantity] = []
    heading: list[tuple[str, int, int, str | None] | None] = []  # of each clause: family, span and limit that its items inherit
    for number, c in enumerate(found):
        inherited = heading[c.parent] if c.parent >= 0 else None
        noun, limit, symbols = None, None, c.symbols
        noun_limit = pending = None
        groups = {f: (after, s) for f, after, s in _symbol_groups(t, c.first, c.last)}
        i, last_noun = c.first, -GAP
        open_noun = True  # the noun has no value yet: items may inherit it
        while i < c.last:
            k = t[i]
            if i in groups:
                i, symbols = groups[i]
                continue
            named = _noun(t, i, c.last)
            if named:
                family, after = named
                if i > c.first and t[i - 1].text in ("%", "procent") and family != "bio":
                    i = after  # `40% powierzchni działki`: what the share is of
                    continue
                if family in ("height", "setback") and any(t[j].text.startswith(ASIDE) for j in range(max(c.first, i - 4), min(c.last, after + 2))):
                    family = "other"  # of a fence or a mast, not of buildings
                near = [x for j in range(max(c.first, i - 3), i) if t[j].kind == "word" and (x := _limit(t, j)) and t[j].text != "do"]
                inside = [x for j in range(i, after) if (x := _limit(t, j)) and t[j].text != "do"]
                noun, last_noun, noun_limit, pending, open_noun = (family, k.start, t[after - 1].end), after, (near or inside or [None])[-1], None, True
                i = after
                continue
            if k.kind in (".", "!", "?") and i + 1 < c.last and t[i + 1].kind in ("word", "symbol", "line"):
                short = i > 0 and t[i - 1].text in ABBREVIATIONS or t[i + 1].kind == "word" and not t[i + 1].value
                if not short:
                    noun, noun_limit, pending, inherited, symbols = None, None, None, None, c.symbols
            elif k.kind == ";":
                pending = None
            limit = _limit(t, i)
            if limit:
                pending = limit
            value = k.value if k.kind == "num" and not masked[i] else NUMBERS.get(k.text) if k.kind == "word" else None
            if value is None:
                i += 1
                continue
            first, raw, unit, after = i, k.text, *_unit(t, i + 1)
            if k.kind == "word" and unit != "storey":
                i += 1
                continue
            low, brackets, second = value, None, None
            # `0,5 (50%)`; `od 3 do 5 m`, `3 – 5 m`
            if unit == "none" and after + 3 < len(t) and t[after].kind == "(" and t[after + 1].kind == "num" and t[after + 2].text == "%" and t[after + 3].kind == ")":
                brackets, after = t[after + 1].value, after + 4
            else:
                link = after < c.last and (t[after].kind in ("–", "—", "-") or t[after].text == "do" and i > c.first and t[i - 1].text == "od")
                if link and after + 1 < c.last and t[after + 1].kind == "num" and not masked[after + 1]:
                    unit2, after2 = _unit(t, after + 2)
                    if unit in ("none", unit2) and t[after + 1].value >= value:
                        second, unit, after = t[after + 1], unit2, after2
            bound = None
            if noun and i - last_noun <= GAP and unit in SUITS[noun[0]]:
                bound = (*noun, noun_limit)
            elif unit == "storey":
                bound = ("storeys", k.start, k.end, None)
            elif unit == "place" and after < len(t) and t[after].text.startswith(("postojow", "parkingow")):
                bound, after = ("parking", k.start, k.end, None), after + 1
            elif not noun and inherited and unit in SUITS[inherited[0]]:
                bound = inherited
            if bound:
                one = normal(bound[0], low, unit, raw, brackets)
                two = normal(bound[0], second.value, unit, second.text) if second else None
                if one and (two or not second):
                    if second:
                        operator, least, most = "range", one[0], two[0]
                    else:
                        before = t[first - 1].text if first > c.first else ""
                        operator = "min" if before == "od" else pending or bound[3] or "exact"
                        least, most = (one[0] if operator != "max" else None), (one[0] if operator != "min" else None)
                    flags = sorted({*one[1], *(two[1] if two else []), *(["number_word"] if k.kind == "word" else []), *(["inherited"] if bound is inherited else [])})
                    out.append(Quantity(bound[0], operator, least, most, flags, t[first].start, t[after - 1].end, bound[1], bound[2], symbols, number))
                    open_noun = False
            pending = None
            i = max(after, i + 1)
        heading.append((*noun, noun_limit) if noun and open_noun and noun[0] != "other" else inherited if not noun and not any(q.clause == number for q in out[-1:]) else None)
    return out


#: Endings of Polish adjectives and nouns that forms of a word differ by, longest first.
ENDINGS = ("owego", "owych", "owymi", "owanie", "owania", "owej", "owym", "owe", "owa", "owy", "iego", "iej", "ach", "ami", "ego", "emu", "ych", "ymi", "ich", "imi", "ów", "om", "em", "ej", "ym", "im", "ie", "ą", "ę", "a", "e", "y", "i", "u", "o")
#: What is built (subject), and the words that tell a modality.
SUBJECTS = ("budyn", "zabudow", "garaż", "wiat", "obiekt", "ogrodze", "reklam", "dach", "usług", "parking", "ziele", "drzew")
FORBID = ("zakaz", "wyklucz", "niedopuszcz", "zabran")
ALLOW = ("dopuszcz", "zezwal", "możliw", "dozwol")
REQUIRE = ("nakaz", "obowiąz", "wymag", "ustala")
EXCEPT = (("z", "wyjątkiem"), ("za", "wyjątkiem"), ("z", "wyłączeniem"), ("oprócz",), ("poza",))
PLACE = (("od", "strony"), ("w", "strefie"), ("w", "pasie"), ("wzdłuż",), ("w", "granicach"), ("przy", "granicy"), ("na", "części"), ("w", "odległości"))
SMALL = {"i", "oraz", "lub", "w", "z", "na", "do", "dla", "o", "się", "od", "przy", "a", "albo", "ze", "jest", "są", "lokalizacj", "budow", "realizacj", "sytuowan", "wznosz", "nie", "tych", "tej"}


def stem(word: str) -> str:
    """A word without its ending; at least four letters stay."""
    for e in ENDINGS:
        if word.endswith(e) and len(word) - len(e) >= 4:
            return word[: -len(e)]
    return word


def _phrase(t: list[Token], i: int, stop: int) -> tuple[list[str], int]:
    """Stems of the words from token i on up to a sign, and where it ends; numbers keep their value."""
    out = []
    while i < stop and t[i].kind in ("word", "num", "symbol", "unit"):
        if any(all(i + j < stop and t[i + j].text == w for j, w in enumerate(p)) for p in (*EXCEPT, *PLACE)):
            break
        if t[i].kind == "word":
            s = stem(t[i].text)
            if s not in SMALL and t[i].text not in SMALL:
                out.append(s)
        else:
            out.append(t[i].text)
        i += 1
    return out, i


def conditions(t: list[Token], a: int, b: int) -> dict[str, list[str] | str | None]:
    """Subject, modality, exceptions and places of a clause's tokens, and the key that paraphrases share."""
    modality, subjects, exceptions, places = None, [], [], []
    i = a
    while i < b:
        k = t[i]
        spot = next(((what, p) for what, ps in (("except", EXCEPT), ("place", PLACE)) for p in ps if all(i + j < b and t[i + j].text == w for j, w in enumerate(p))), None)
        if spot:
            words, i = _phrase(t, i + len(spot[1]), b)
            if words:
                (exceptions if spot[0] == "except" else places).append(" ".join(sorted(words)) if spot[0] == "except" else f"{spot[1][-1]} {' '.join(sorted(words))}")
            continue
        if k.kind == "word":
            negated = i > a and t[i - 1].text == "nie"
            for name, stems in (("forbidden", FORBID), ("allowed", ALLOW), ("required", REQUIRE)):
                if modality is None and k.text.startswith(stems):
                    modality = {"allowed": "forbidden", "forbidden": "allowed"}.get(name, name) if negated else name
            if k.text.startswith(SUBJECTS):
                own = next(s for s in SUBJECTS if k.text.startswith(s))
                around = []
                for j in range(i + 1, min(b, i + 4)):  # adjectives follow their noun
                    if t[j].kind != "word" or t[j].text in SMALL or t[j].text.startswith(SUBJECTS) or any(t[j].text == p[0] for p in EXCEPT):
                        break
                    if t[j].text.endswith(("e", "ej", "ych", "ego", "ymi", "y", "a", "ym", "ą")):
                        around.append(stem(t[j].text))
                subjects.append(" ".join([own, *sorted(around)]))
        i += 1
    parts = [f"is:{modality}"] if modality else []
    parts += [f"what:{s}" for s in sorted(set(subjects))] + [f"except:{s}" for s in sorted(set(exceptions))] + [f"where:{s}" for s in sorted(set(places))]
    return {"modality": modality, "subjects": sorted(set(subjects)), "exceptions": sorted(set(exceptions)), "places": sorted(set(places)), "key": "|".join(parts)}


def condition_key(text: str) -> str:
    """The key of a text taken as one clause."""
    t = tokens(text or "")
    return conditions(t, 0, len(t))["key"]


def findings(text: str) -> list[dict]:
    """Prohibitions, permissions and duties of a text, clause by clause and sentence by sentence, with place, key and symbols."""
    t = tokens(text)
    out = []
    for c in scoped(t, len(text)):
        a = c.first
        while a < c.last:
            b = a
            while b < c.last and not (t[b].kind == ";" or t[b].kind == "." and (b + 1 == c.last or t[b + 1].kind in ("line", "word", "symbol")) and t[b - 1].text not in REFERENCES):
                b += 1
            got = conditions(t, a, b)
            if got["modality"] and got["subjects"]:
                out.append({"modality": got["modality"], "key": got["key"], "symbols": c.symbols, "start": t[a].start, "end": t[b - 1].end})
            a = b + 1
    return out
