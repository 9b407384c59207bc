"""Snowball stemmers for English, Spanish and Portuguese.

Written from the published descriptions of the algorithms.  They run on the
distinct vocabulary of an index, never on running text: ``stem_column`` is an
Arrow function that the index applies to distinct terms.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _after_vowel_consonant(word: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _longest(word: str, suffixes) -> str:
    """The longest of ``suffixes`` that ends ``word``, or an empty text."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


# English ----------------------------------------------------------------

# Fixed values of the published English algorithm.
_EN_VOWELS = "aeiouy"
_EN_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EN_LI = "cdeghkmnrt"
_EN_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_EN_KEEP = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_EN_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
_EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _short_syllable_at_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _EN_VOWELS and w[1] not in _EN_VOWELS
    return len(w) >= 3 and w[-3] not in _EN_VOWELS and w[-2] in _EN_VOWELS and w[-1] not in _EN_VOWELS + "wxY"


def english(word: str) -> str:
    w = word.replace("’", "'")
    if len(w) <= 2:
        return w
    w = w.removeprefix("'")
    if w in _EN_EXCEPTIONS:
        return _EN_EXCEPTIONS[w]
    marked = []
    for i, c in enumerate(w):
        marked.append("Y" if c == "y" and (i == 0 or marked[i - 1] in _EN_VOWELS) else c)
    w = "".join(marked)
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), "")
    r1 = len(head) if head else _after_vowel_consonant(w, _EN_VOWELS)
    r2 = _after_vowel_consonant(w, _EN_VOWELS, r1)
    # 0: possessive
    w = w.removesuffix(_longest(w, ("'", "'s", "'s'")))
    # 1a: plural
    s = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and any(c in _EN_VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _EN_KEEP:
        return w
    # 1b: past and progressive
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in _EN_VOWELS for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_EN_DOUBLES):
            w = w[:-1]
        elif _short_syllable_at_end(w) and r1 >= len(w):
            w += "e"
    # 1c: final y
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN_VOWELS:
        w = w[:-1] + "i"
    # 2 and 3: derivations
    s = _longest(w, _EN_STEP2)
    if s and len(w) - len(s) >= r1:
        if s == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif s == "li":
            w = w[:-2] if w[-3:-2] and w[-3] in _EN_LI else w
        else:
            w = w[: -len(s)] + _EN_STEP2[s]
    s = _longest(w, _EN_STEP3)
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - len(s) >= r2):
        w = w[: -len(s)] + _EN_STEP3[s]
    # 4: remaining suffixes
    s = _longest(w, _EN_STEP4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    # 5: final e and double l
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable_at_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# Romance languages ------------------------------------------------------


def _romance_rv(w: str, vowels: str) -> int:
    """If the second letter is a consonant, after the next vowel; if the first two are vowels, after the next consonant; else after the third letter."""
    if len(w) < 3:
        return len(w)
    if w[1] not in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] in vowels), len(w))
    if w[0] in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in vowels), len(w))
    return 3


def _cut(w: str, region: int, suffixes) -> tuple[str, str]:
    """The longest suffix that lies in the region, and the word without it."""
    s = _longest(w[region:], suffixes)
    return s, w[: len(w) - len(s)] if s else w


# Fixed values of the published Spanish algorithm.
_ES_VOWELS = "aeiouáéíóúü"
_ES_ACCENTS = str.maketrans("áéíóú", "aeiou")
_ES_PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
_ES_PRONOUN_ACCENTED = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"}
_ES_PRONOUN_PLAIN = ("ando", "iendo", "ar", "er", "ir")
_ES_STANDARD = ("anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos")
_ES_ATION = ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias", "acion")
_ES_OTHER = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
_ES_Y_VERBS = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos")
_ES_VERBS_GU = ("en", "es", "éis", "emos")
_ES_VERBS = (
    "arían", "arías", "arán", "arás", "aríais", "aría", "aréis", "aríamos", "aremos", "ará", "aré",
    "erían", "erías", "erán", "erás", "eríais", "ería", "eréis", "eríamos", "eremos", "erá", "eré",
    "irían", "irías", "irán", "irás", "iríais", "iría", "iréis", "iríamos", "iremos", "irá", "iré",
    "aba", "ada", "ida", "ía", "ara", "iera", "ad", "ed", "id", "ase", "iese", "aste", "iste", "an", "aban", "ían", "aran", "ieran", "asen", "iesen", "aron", "ieron",
    "ado", "ido", "ando", "iendo", "ió", "ar", "er", "ir", "as", "abas", "adas", "idas", "ías", "aras", "ieras", "ases", "ieses", "ís", "áis", "abais", "íais", "arais", "ierais",
    "aseis", "ieseis", "asteis", "isteis", "ados", "idos", "amos", "ábamos", "íamos", "imos", "áramos", "iéramos", "iésemos", "ásemos",
)
_ES_RESIDUAL = ("os", "a", "o", "á", "í", "ó")


def spanish(word: str) -> str:
    w = word
    rv = _romance_rv(w, _ES_VOWELS)
    r1 = _after_vowel_consonant(w, _ES_VOWELS)
    r2 = _after_vowel_consonant(w, _ES_VOWELS, r1)
    # 0: attached pronoun
    s = _longest(w, _ES_PRONOUNS)
    if s:
        before = w[: -len(s)]
        tail = before[rv:]
        if accented := _longest(tail, _ES_PRONOUN_ACCENTED):
            w = before[: -len(accented)] + _ES_PRONOUN_ACCENTED[accented]
        elif _longest(tail, _ES_PRONOUN_PLAIN) or (tail.endswith("yendo") and before.endswith("uyendo")):
            w = before
    # 1: standard suffixes
    start = w
    s = _longest(w, (*_ES_STANDARD, *_ES_ATION, *_ES_OTHER, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"))
    cut = len(w) - len(s)
    if s == "amente":
        if cut >= r1:
            w = w[:cut]
            if w.endswith("iv") and len(w) - 2 >= r2:
                w = w[:-2]
                if w.endswith("at") and len(w) - 2 >= r2:
                    w = w[:-2]
            elif w.endswith(("os", "ic", "ad")) and len(w) - 2 >= r2:
                w = w[:-2]
    elif s and cut >= r2:
        w = w[:cut]
        if s in _ES_ATION:
            if w.endswith("ic") and len(w) - 2 >= r2:
                w = w[:-2]
        elif s in _ES_OTHER:
            w += _ES_OTHER[s]
        elif s == "mente":
            more = _longest(w, ("ante", "able", "ible"))
            if more and len(w) - len(more) >= r2:
                w = w[: -len(more)]
        elif s in ("idad", "idades"):
            more = _longest(w, ("abil", "ic", "iv"))
            if more and len(w) - len(more) >= r2:
                w = w[: -len(more)]
        elif s in ("iva", "ivo", "ivas", "ivos") and w.endswith("at") and len(w) - 2 >= r2:
            w = w[:-2]
    # 2: verb endings, if nothing went
    if w == start:
        s, rest = _cut(w, rv, _ES_Y_VERBS)
        if s and rest.endswith("u"):
            w = rest
        else:
            s, rest = _cut(w, rv, (*_ES_VERBS, *_ES_VERBS_GU))
            if s:
                w = rest
                if s in _ES_VERBS_GU and w.endswith("gu"):
                    w = w[:-1]
    # 3: residual vowel
    s, rest = _cut(w, rv, (*_ES_RESIDUAL, "e", "é"))
    if s in ("e", "é"):
        w = rest
        if w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    elif s:
        w = rest
    return w.translate(_ES_ACCENTS)


# Fixed values of the published Portuguese algorithm.
_PT_VOWELS = "aeiouáéíóúâêô"
_PT_STANDARD = ("eza", "ezas", "ico", "ica", "icos", "icas", "ismo", "ismos", "ável", "ível", "ista", "istas", "oso", "osa", "osos", "osas", "amento", "amentos", "imento", "imentos", "adora", "ador", "aça~o", "adoras", "adores", "aço~es", "ante", "antes", "ância")
_PT_OTHER = {"logia": "log", "logias": "log", "ução": "u", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
_PT_VERBS = (
    "ada", "ida", "ia", "aria", "eria", "iria", "ará", "ara", "erá", "era", "irá", "ava", "asse", "esse", "isse", "aste", "este", "iste", "ei", "arei", "erei", "irei", "am", "iam", "ariam", "eriam", "iriam",
    "aram", "eram", "iram", "avam", "em", "arem", "erem", "irem", "assem", "essem", "issem", "ado", "ido", "ando", "endo", "indo", "ara~o", "era~o", "ira~o", "ar", "er", "ir", "as", "adas", "idas", "ias",
    "arias", "erias", "irias", "arás", "aras", "erás", "eras", "irás", "avas", "es", "ardes", "erdes", "irdes", "ares", "eres", "ires", "asses", "esses", "isses", "astes", "estes", "istes", "is", "ais", "eis", "íeis",
    "aríeis", "eríeis", "iríeis", "áreis", "areis", "éreis", "ereis", "íreis", "ireis", "ásseis", "ésseis", "ísseis", "áveis", "ados", "idos", "ámos", "amos", "íamos", "aríamos", "eríamos", "iríamos",
    "áramos", "éramos", "íramos", "ávamos", "emos", "aremos", "eremos", "iremos", "ássemos", "êssemos", "íssemos", "imos", "armos", "ermos", "irmos", "eu", "iu", "ou", "ira", "iras",
)
_PT_RESIDUAL = ("os", "a", "i", "o", "á", "í", "ó")


def portuguese(word: str) -> str:
    w = word.replace("ã", "a~").replace("õ", "o~")
    rv = _romance_rv(w, _PT_VOWELS)
    r1 = _after_vowel_consonant(w, _PT_VOWELS)
    r2 = _after_vowel_consonant(w, _PT_VOWELS, r1)
    start = w
    # 1: standard suffixes
    s = _longest(w, (*_PT_STANDARD, *_PT_OTHER, "amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras"))
    cut = len(w) - len(s)
    if s == "amente":
        if cut >= r1:
            w = w[:cut]
            if w.endswith("iv") and len(w) - 2 >= r2:
                w = w[:-2]
                if w.endswith("at") and len(w) - 2 >= r2:
                    w = w[:-2]
            elif w.endswith(("os", "ic", "ad")) and len(w) - 2 >= r2:
                w = w[:-2]
    elif s in ("ira", "iras"):
        if cut >= rv and w[:cut].endswith("e"):
            w = w[:cut] + "ir"
    elif s and cut >= r2:
        w = w[:cut]
        if s in _PT_OTHER:
            w += _PT_OTHER[s]
        elif s == "mente":
            more = _longest(w, ("ante", "avel", "ível"))
            if more and len(w) - len(more) >= r2:
                w = w[: -len(more)]
        elif s in ("idade", "idades"):
            more = _longest(w, ("abil", "ic", "iv"))
            if more and len(w) - len(more) >= r2:
                w = w[: -len(more)]
        elif s in ("iva", "ivo", "ivas", "ivos") and w.endswith("at") and len(w) - 2 >= r2:
            w = w[:-2]
    # 2: verb endings, if nothing went
    if w == start:
        s, rest = _cut(w, rv, _PT_VERBS)
        if s:
            w = rest
    # 3: i after c, if something went; 4: else a residual vowel
    if w != start:
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    else:
        s, rest = _cut(w, rv, _PT_RESIDUAL)
        if s:
            w = rest
    # 5: final e, with the u of gu or the i of ci; cedilla
    s, rest = _cut(w, rv, ("e", "é", "ê"))
    if s:
        w = rest
        if (w.endswith("gu") or w.endswith("ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


STEMMERS: dict[str, Callable[[str], str]] = {"en": english, "es": spanish, "pt": portuguese}


@lru_cache(maxsize=8)
def stem_column(language: str):
    """Arrow function for distinct terms."""
    stem = STEMMERS[language]

    @F.pandas_udf(T.StringType())
    def run(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: None if t is None else stem(t))

    return run


def stem_by(language: str, term: str):
    """Stems of distinct terms by the columns of their language and of themselves; other languages than ours leave a term as it is."""

    @F.pandas_udf(T.StringType())
    def run(languages: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s not in STEMMERS else STEMMERS[s](t) for s, t in zip(languages, terms)], dtype="object")

    return run(language, term)
