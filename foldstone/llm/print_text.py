"""Normal forms of scanned print: what of a text survives misreading, line breaks and columns."""

from __future__ import annotations

import re

import numpy as np

#: Parameters, chosen for this kind of print and not fixed by any format: letters and digits that scanners take for one another, by class.
CONFUSED = ("aceo0", "tfl1ij", "rv", "hb", "un", "gq9", "s5")
#: Parameters: marked letters and ligatures, and the letter that they are taken for.
MARKED = {
    "a": "àáâãäå", "e": "èéêë", "i": "ìíîï!", "o": "òóôõöø", "u": "ùúûü", "c": "ç", "n": "ñ",
    "s": "ſß", "y": "ýÿ", "ae": "æ", "oe": "œ", "fi": "ﬁ", "fl": "ﬂ",
}
#: Parameters: pairs of letters that scanners make of one letter.
PAIRS = (("nn", "m"), ("rn", "m"), ("vv", "w"), ("cl", "d"))


def _tables() -> tuple[dict[int, str], list[tuple[str, str]]]:
    one = {ch: group[0] for group in CONFUSED for ch in group}
    table = {ord(ch): head for ch, head in one.items()}
    for plain, marked in MARKED.items():
        table |= {ord(ch): "".join(one.get(p, p) for p in plain) for ch in marked}
    fold = lambda s: "".join(one.get(ch, ch) for ch in s)
    return table, [(fold(a), fold(b)) for a, b in PAIRS]


_TABLE, _PAIRS = _tables()
_NOT_WORD = re.compile(r"[\W_]+")
_GAP = re.compile(r"\s{3,}")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def fold(text: str) -> str:
    """Letters and digits alone, in lower case, with one letter for each class of confused ones."""
    s = _NOT_WORD.sub("", text.lower()).translate(_TABLE)
    for a, b in _PAIRS:
        s = s.replace(a, b)
    return s


def fragments(text: str) -> list[str]:
    """The pieces of lines that belong to one column: lines, cut at wide gaps."""
    return [piece for line in text.splitlines() for piece in _GAP.split(line) if piece]


_BREAK, _BETWEEN = re.compile(r"\s{3,}|[\r\n\v\f\x1c-\x1e\x85\u2028\u2029]+"), re.compile(r"[^\w\n]+|_+")


def fold_fragments(text: str) -> list[str]:
    """The folded fragments of a text that have letters; the whole text is folded at once."""
    s = _BETWEEN.sub("", _BREAK.sub("\n", text).lower()).translate(_TABLE)
    for a, b in _PAIRS:
        s = s.replace(a, b)
    return [f for f in s.split("\n") if f]


def folded_ends(parts: list[str]) -> list[int]:
    """End of each of ``parts`` among the folded letters of them all; pairs that cross two parts count for the first."""
    raw = [_NOT_WORD.sub("", p.lower()).translate(_TABLE) for p in parts]
    ends, s = np.cumsum([len(r) for r in raw]), "".join(raw)
    for a, b in _PAIRS:
        at = np.array([m.start() for m in re.finditer(a, s)], np.int64)
        ends = ends - (len(a) - len(b)) * np.searchsorted(at, ends - len(a), "right")
        s = s.replace(a, b)
    return [int(e) for e in ends]


_HYPHEN = re.compile(r"[-=~¬­‐] *\r?\n")


def spaced(text: str) -> str:
    """The folded words of a text between single blanks, hyphens at line ends undone; so a phrase is looked for with its word borders."""
    return f" {' '.join(fold_words(_HYPHEN.sub('', text)))} "


def words(text: str) -> list[str]:
    return _WORD.findall(text)


_SPLIT = re.compile(r"[\W_]+")


def fold_words(text: str) -> list[str]:
    """The folded words of a text, in order."""
    s = text.lower().translate(_TABLE)
    for a, b in _PAIRS:
        s = s.replace(a, b)
    return [w for w in _SPLIT.split(s) if w]
