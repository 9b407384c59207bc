"""Reading a listing's title and attributes into the parts that make a product.

Two steps, both free of lists of brands, lines or article names: :func:`parts`
takes out what has a form of its own (model codes, sizes, pack units, colours)
and leaves words; :func:`Lexicon.resolve` reads brand, line and kind of article
from the words by lexicons learned from all rows, and mends one-letter typing
errors towards lexicon words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import ChainMap
from functools import lru_cache


# Colour names in Spanish, Portuguese and English.
COLORS = {
    "amarillo": "amarillo", "amarelo": "amarillo", "yellow": "amarillo",
    "azul": "azul", "blue": "azul",
    "blanco": "blanco", "branco": "blanco", "white": "blanco",
    "dorado": "dorado", "dourado": "dorado", "gold": "dorado", "golden": "dorado",
    "gris": "gris", "cinza": "gris", "grey": "gris", "gray": "gris",
    "marron": "marron", "marrom": "marron", "brown": "marron",
    "naranja": "naranja", "laranja": "naranja", "orange": "naranja",
    "negro": "negro", "preto": "negro", "black": "negro",
    "plateado": "plateado", "prateado": "plateado", "silver": "plateado",
    "rojo": "rojo", "vermelho": "rojo", "red": "rojo",
    "rosa": "rosa", "pink": "rosa",
    "turquesa": "turquesa", "turquoise": "turquesa",
    "verde": "verde", "green": "verde",
    "violeta": "violeta", "roxo": "violeta", "purple": "violeta", "violet": "violeta",
}
# Colour names that are also words of another language ("cable de red").
AMBIGUOUS_COLORS = ["red"]
# Units of size and what they measure, with the factor to the base unit.
UNITS = {
    "g": ("g", 1), "gr": ("g", 1), "grs": ("g", 1), "gramo": ("g", 1), "gramos": ("g", 1), "gramas": ("g", 1), "grams": ("g", 1), "kg": ("g", 1000), "kgs": ("g", 1000), "kilo": ("g", 1000), "kilos": ("g", 1000),
    "mm": ("mm", 1), "cm": ("mm", 10), "cms": ("mm", 10), "m": ("mm", 1000), "mt": ("mm", 1000), "mts": ("mm", 1000), "metro": ("mm", 1000), "metros": ("mm", 1000),
    "ml": ("ml", 1), "cc": ("ml", 1), "cl": ("ml", 10), "l": ("ml", 1000), "lt": ("ml", 1000), "lts": ("ml", 1000), "litro": ("ml", 1000), "litros": ("ml", 1000), "liters": ("ml", 1000),
    "gb": ("gb", 1), "giga": ("gb", 1), "gigas": ("gb", 1), "tb": ("gb", 1024),
    "w": ("w", 1), "watt": ("w", 1), "watts": ("w", 1), "vatios": ("w", 1), "kw": ("w", 1000),
}
# Words before a shoe size, and words of a pack.
SIZE_WORDS = "talle|talla|tamanho|tamano|numero|nro|num|size|t"
PACK_WORDS = "unidades|units|unids|pzas|piezas|pcs|un|u"
PACK_HEADS = "pack|kit|set|combo|lote|caja"
# A word is mended to one so many times as frequent.
MEND_RATIO = 5
MEMORY = 200_000  # readings of words that a task remembers
DIMENSIONS = {"POWER": "w", "CAPACITY": "ml", "STORAGE": "gb", "LENGTH": "mm", "WEIGHT": "g", "SHOE_SIZE": "size"}

# standard patterns, not those of the regex package: twice as fast here; folded text has no marks to look after
_L = r"[^\W\d_]"
_START, _END = r"(?<![^\W_])", r"(?![^\W_])"
_MARK = re.compile(r"[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_NUMBER = r"(\d+(?:[.,]\d+)?)"
_SIZE = re.compile(rf"{_START}{_NUMBER}\s*({'|'.join(sorted(UNITS, key=len, reverse=True))}){_END}")
_SHOE = re.compile(rf"{_START}(?:{SIZE_WORDS})\s*(\d{{2}}){_END}")
_PACK = [
    re.compile(rf"{_START}(?:{PACK_HEADS})\s+(?:de\s+|x\s*)?(\d+)(?:\s*(?:{PACK_WORDS}){_END}\.?)?{_END}"),
    re.compile(rf"{_START}x\s*(\d+)(?:\s*(?:{PACK_WORDS}){_END}\.?)?{_END}"),
    re.compile(rf"{_START}(\d+)\s*(?:{PACK_WORDS}){_END}\.?"),
]
_CODE = re.compile(rf"{_START}([a-z]{{1,4}})[\s._-]?(\d{{3,6}})(?![^\W_]|%)")
_CODE_ONLY = re.compile(r"([a-z]{1,4})[\s._-]?(\d{3,6})")
_LINE = re.compile(rf"(?=(?<!{_L})({_L}+)[\s._-]+({_L}+)[\s._-]+(\d{{1,4}})(?![^\W_]|%))")
_LINE_ONLY = re.compile(rf"(?:linea|linha|line|modelo)?\s*({_L}+)[\s._-]+({_L}+)[\s._-]+(\d{{1,4}})")
_WORD = re.compile(rf"{_L}+|\d+%?")
_ANY_NUMBER = re.compile(rf"\D*?{_NUMBER}\D*")
_DIGITS = re.compile(r"\d+")


def fold(text: str | None) -> str:
    if not text:
        return ""
    t = text.lower()
    return t if t.isascii() else _MARK.sub("", unicodedata.normalize("NFD", t))


def _amount(number: str, factor: int) -> int:
    whole, _, part = number.replace(",", ".").partition(".")
    return round((int(whole) + (int(part) / 10 ** len(part) if part else 0)) * factor)


def read_size(text: str, dimension: str | None = None) -> str | None:
    m = _SIZE.search(text)
    if m:
        base, factor = UNITS[m.group(2)]
        return f"{base}{_amount(m.group(1), factor)}" if dimension in (None, base) else None
    if dimension:
        m = _ANY_NUMBER.fullmatch(text)
        return f"{dimension}{_amount(m.group(1), 1)}" if m else None
    return None


def read_model(text: str) -> tuple[str | None, tuple[str, str, str] | None]:
    """A model code, or the two words and the number of a line."""
    if m := _CODE_ONLY.fullmatch(text):
        return m.group(1) + m.group(2), None
    if m := _LINE_ONLY.fullmatch(text):
        return None, (m.group(1), m.group(2), m.group(3).lstrip("0") or "0")
    return None, None


@lru_cache(1 << 16)
def read_attribute(name: str | None, value: str | None) -> tuple[tuple[str, object], ...]:
    """The parts that one attribute states; the same few attributes come again and again."""
    key, value = (name or "").strip().upper(), fold(value).strip()
    if not value:
        return ()
    if key == "BRAND":
        return (("brand_a", " ".join(_WORD.findall(value)) or None),)
    if key in ("MODEL", "LINE"):
        code, line = read_model(value)
        return (("code_a", code),) if code else (("line_a", line),) if line else ()
    if key == "COLOR":
        return (("color_a", COLORS.get(value, value)),)
    if key == "PACK_UNITS":
        m = _DIGITS.search(value)
        return (("pack_a", int(m.group())),) if m else ()
    size = read_size(value, DIMENSIONS[key]) if key in DIMENSIONS else None
    return (("size_a", size),) if size else ()


def parts(title: str | None, attributes) -> dict:
    """What title and attributes say: ``*_a`` from attributes, ``*_t`` from the title, ``words`` the rest of the title."""
    out = dict.fromkeys(("brand_a", "code_a", "line_a", "color_a", "pack_a", "size_a", "code_t", "color_t", "pack_t", "size_t"))
    out["lines_t"] = []
    for x in attributes if attributes is not None else ():
        if x is not None:
            for part, value in read_attribute(x["id"], x["value_name"]):
                out[part] = value
    t = " ".join(fold(title).split())

    def take(pattern: re.Pattern) -> re.Match | None:
        nonlocal t
        m = pattern.search(t)
        if m:
            t = f"{t[: m.start()]} | {t[m.end() :]}"
        return m

    for pattern in _PACK:
        if m := take(pattern):
            out["pack_t"] = int(m.group(1))
            break
    if m := take(_SIZE):
        base, factor = UNITS[m.group(2)]
        out["size_t"] = f"{base}{_amount(m.group(1), factor)}"
    elif m := take(_SHOE):
        out["size_t"] = f"size{int(m.group(1))}"
    out["lines_t"] = [[m.group(1), m.group(2), m.group(3).lstrip("0") or "0"] for m in _LINE.finditer(t)]
    if m := take(_CODE):
        out["code_t"] = m.group(1) + m.group(2)
    out["words"] = _WORD.findall(t)
    named = [w for w in out["words"] if w in COLORS]
    if named:
        # of several, one that is neither a word of another language nor a misspelled brand
        doubtful = lambda w: w in AMBIGUOUS_COLORS or (out["brand_a"] is not None and damerau_at_most_one(w, out["brand_a"]))
        out["color_t"] = COLORS[next((w for w in named if not doubtful(w)), named[0])]
    return out


def damerau_at_most_one(a: str, b: str) -> bool:
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (a[i + 1 : i + 2] == b[i : i + 1] and a[i : i + 1] == b[i + 1 : i + 2] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]


class Speller:
    """Nearest word within one typing error, by shared deletions; mends words of ``least`` letters or more."""

    def __init__(self, words: dict[str, float], least: int = 4):
        self.words, self.least = words, least
        self.table: dict[str, list[str]] = {}
        for w in words:
            if len(w) >= least - 1:
                for d in self._deletions(w):
                    self.table.setdefault(d, []).append(w)

    @staticmethod
    def _deletions(w: str) -> set[str]:
        return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}

    def mend(self, w: str) -> str | None:
        if w in self.words:
            return w
        if len(w) < self.least:
            return None
        near = self._near(w)
        return min(near, key=lambda c: (-self.words[c], c)) if near else None

    def _near(self, w: str) -> set[str]:
        return {c for d in self._deletions(w) for c in self.table.get(d, ()) if damerau_at_most_one(w, c)}

    def with_words(self, words: dict[str, float]) -> Speller:
        return _WiderSpeller(self, words) if words else self


class _WiderSpeller(Speller):
    """A speller and a few more words."""

    def __init__(self, inner: Speller, words: dict[str, float]):
        self.inner, self.more, self.words, self.least = inner, words, ChainMap(words, inner.words), inner.least

    def _near(self, w: str) -> set[str]:
        return self.inner._near(w) | {c for c in self.more if len(c) >= self.least - 1 and damerau_at_most_one(w, c)}


class Lexicon:
    """What all rows together say about words.

    ``brands``, ``firsts``, ``seconds``: brand words and the two words of lines,
    with their rows; ``kinds``: word -> (rows, {category: rows} of its foremost
    categories); ``priors``: category -> rows, ``total`` of all categories.
    Words below ``least`` rows are not among them.  Words too many to hold come
    by :meth:`with_words`; ``named`` are words of ``kinds`` that are brand or line
    words there.
    """

    def __init__(self, brands: dict[str, int], firsts: dict[str, int], seconds: dict[str, int], kinds: dict[str, tuple[int, dict[str, int]]], priors: dict[str, int], least: int = 3, alpha: float = 5.0, dominant: float = 0.4, total: int | None = None, named: frozenset[str] = frozenset()):
        self.total = (sum(priors.values()) if total is None else total) or 1
        self.alpha, self.dominant = alpha, dominant
        self.brands, self.firsts, self.seconds = brands, firsts, seconds
        self.rows = {w: n for w, (n, _) in kinds.items()}
        self.unseen = max(1, least // 2)
        self.weights = self._weigh({w: x for w, x in kinds.items() if w not in named}, priors)
        self._brand_speller, self._first_speller, self._second_speller = Speller(brands), Speller(firsts), Speller(seconds)
        self._kind_speller = Speller({w: kinds[w][0] for w in self.weights})
        self._seen: dict[tuple[str, str], object] = {}

    def _weigh(self, kinds: dict[str, tuple[int, dict[str, int]]], priors: dict[str, int]) -> dict[str, tuple[float, dict[str, float]]]:
        weights, alpha = {}, self.alpha
        for w, (n, by) in kinds.items():
            if w in self.brands or w in self.firsts or w in self.seconds or w in COLORS or not by or max(by.values()) < self.dominant * n:
                continue
            prior = {c: priors.get(c, 1) / self.total for c in by}
            weights[w] = (math.log(alpha / (n + alpha)), {c: math.log((k + alpha * prior[c]) / (n + alpha) / prior[c]) for c, k in by.items()})
        return weights

    def with_words(self, entries) -> Lexicon:
        """This lexicon and the words of ``entries``: ``w, brand, first, second, rows, tops`` as in the lexicon table."""
        brands, firsts, seconds, rows = ({e["w"]: e[k] for e in entries if e[k] is not None} for k in ("brand", "first", "second", "rows"))
        out = object.__new__(Lexicon)
        out.__dict__.update(self.__dict__)
        out.brands, out.firsts, out.seconds, out.rows = ChainMap(brands, self.brands), ChainMap(firsts, self.firsts), ChainMap(seconds, self.seconds), ChainMap(rows, self.rows)
        kinds = {e["w"]: (e["rows"], {t["category"]: t["n"] for t in e["tops"]}) for e in entries if e["rows"] is not None}
        weights = out._weigh(kinds, {t["category"]: t["prior"] for e in entries if e["rows"] is not None for t in e["tops"] if t["prior"] is not None})
        out.weights = ChainMap(weights, self.weights)
        out._brand_speller, out._first_speller, out._second_speller = self._brand_speller.with_words(brands), self._first_speller.with_words(firsts), self._second_speller.with_words(seconds)
        out._kind_speller = self._kind_speller.with_words({w: rows[w] for w in weights})
        out._seen = {}
        return out

    def _once(self, what: str, w: str, read):
        """``read(w)``, remembered: most words come again."""
        key = (what, w)
        if key not in self._seen:
            if len(self._seen) >= MEMORY:
                self._seen.clear()
            self._seen[key] = read(w)
        return self._seen[key]

    def _mend(self, speller: Speller, w: str, ratio: int = MEND_RATIO) -> str | None:
        """The word itself, or a word within one typing error that is ``ratio`` times as frequent."""
        if w in speller.words:
            return w
        near = speller.mend(w)
        return near if near and self.rows.get(w, self.unseen) * ratio <= speller.words[near] else None

    def _brand(self, w: str) -> str | None:
        return self._once("brand", w, lambda x: self._mend(self._brand_speller, x))

    def brand(self, words: list[str]) -> str | None:
        exact = [w for w in words if w in self.brands]
        if exact:
            return exact[0]
        return next((b for w in words if w not in self.weights and len(w) >= 4 and (b := self._brand(w))), None)

    def line(self, lines) -> tuple[str, str, str] | None:
        for first, second, number in lines:
            f = self._once("first", first, lambda x: self._mend(self._first_speller, x))
            s = f and self._once("second", second, lambda x: self._mend(self._second_speller, x))
            if f and s:
                return f, s, number
        return None

    def _kind_words(self, w: str) -> list[str]:
        if w in self.weights:
            return [w]
        if w in self.brands or w in self.firsts or w in self.seconds or w in COLORS:
            return []
        if m := self._mend(self._kind_speller, w):
            return [m]
        # a missing blank
        return next(([w[:i], w[i:]] for i in range(3, len(w) - 2) if w[:i] in self.weights and w[i:] in self.weights), [])

    def kind(self, words: list[str]) -> str | None:
        known = [self.weights[k] for w in words for k in self._once("kind", w, self._kind_words)]
        scores = {c: sum(by.get(c, floor) for floor, by in known) for c in {c for _, by in known for c in by}}
        best = max(scores, key=lambda c: (scores[c], c), default=None)
        return best if best is not None and scores[best] > 0 else None

    def article(self, words: list[str]) -> str:
        """Words that name the article, or are too rare to be known, without blanks: what survives a misplaced blank."""
        skip = lambda w: w in COLORS or w in self.brands or w in self.firsts or w in self.seconds or not w.isalpha()
        return "".join(w for w in words if not skip(w) and (w in self.weights or w not in self.rows) and not (w not in self.weights and self._brand(w)))

    def resolve(self, p: dict) -> dict:
        """Kind, brand, model, size, colour and pack of one listing; null where neither title nor attributes say it."""
        line = p["line_a"] or (None if p["code_a"] else self.line(p["lines_t"]))
        model = p["code_a"] or (" ".join(line) if line is not None else p["code_t"])
        return {"kind": self.kind(p["words"]), "brand": p["brand_a"] or self.brand(p["words"]), "model": model, "size": p["size_a"] or p["size_t"], "color": p["color_a"] or p["color_t"], "pack": int(p["pack_a"] or p["pack_t"] or 1), "article": self.article(p["words"])}
