"""The Spanish stemmer in SQL, written by itself, to compare stems with."""

from __future__ import annotations

from tamiz.functions import stemmers as fixed  # the published lists of endings only

_V = fixed._ES_VOWELS


def _any(endings) -> str:
    """Of all endings the longest: a match at the end begins as far left as it can."""
    return f"({'|'.join(sorted(endings))})$"


def _left(text: str, less: str) -> str:
    return f"left({text}, CAST(length({text}) - ({less}) AS BIGINT))"


def spanish_stems(terms: str) -> str:
    """``term, stem`` of a query that gives distinct ``term``."""
    after = lambda text: f"CASE WHEN regexp_matches({text}, '[{_V}][^{_V}]') THEN length(regexp_extract({text}, '^.*?[{_V}][^{_V}]')) ELSE length({text}) END"
    found = lambda pattern: f"CASE WHEN regexp_matches(term, '{pattern}') THEN length(regexp_extract(term, '{pattern}')) ELSE length(term) END"
    rv = f"""CASE WHEN length(term) < 3 THEN length(term)
      WHEN regexp_matches(term, '^.[^{_V}]') THEN {found(f'^..[^{_V}]*[{_V}]')}
      WHEN regexp_matches(term, '^[{_V}]{{2}}') THEN {found(f'^..[{_V}]*[^{_V}]')} ELSE 3 END"""
    regions = f"SELECT term, rv, r1, r1 + {after('substr(term, CAST(r1 + 1 AS BIGINT))')} AS r2 FROM (SELECT term, {rv} AS rv, {after('term')} AS r1 FROM ({terms}))"
    # 0
    pronoun = f"SELECT *, {_left('term', 'length(p)')} AS before FROM (SELECT *, regexp_extract(term, '{_any(fixed._ES_PRONOUNS)}') AS p FROM ({regions}))"
    tails = f"SELECT *, regexp_extract(tail, '{_any(fixed._ES_PRONOUN_ACCENTED)}') AS acc FROM (SELECT *, substr(before, CAST(rv + 1 AS BIGINT)) AS tail FROM ({pronoun}))"
    w1 = f"""CASE WHEN p = '' THEN term WHEN acc <> '' THEN concat({_left('before', 'length(acc)')}, translate(acc, 'áéí', 'aei'))
      WHEN regexp_matches(tail, '{_any(fixed._ES_PRONOUN_PLAIN)}') OR (tail LIKE '%yendo' AND before LIKE '%uyendo') THEN before ELSE term END"""
    zero = f"SELECT term, rv, r1, r2, {w1} AS w FROM ({tails})"
    # 1
    standard = [*fixed._ES_STANDARD, *fixed._ES_ATION, *fixed._ES_OTHER, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"]
    cut = f"SELECT *, {_left('w', 'length(s)')} AS b FROM (SELECT *, regexp_extract(w, '{_any(standard)}') AS s FROM ({zero}))"
    isin = lambda vs: f"s IN ({', '.join(repr(v) for v in vs)})"
    drop = lambda endings: f"CASE WHEN regexp_matches(b, '{_any(endings)}') AND length(b) - length(regexp_extract(b, '{_any(endings)}')) >= r2 THEN regexp_replace(b, '{_any(endings)}', '') ELSE b END"
    other = " ".join(f"WHEN s = '{k}' THEN concat(b, '{v}')" for k, v in fixed._ES_OTHER.items())
    w2 = f"""CASE WHEN s = '' THEN w
      WHEN s = 'amente' THEN CASE WHEN length(b) < r1 THEN w WHEN b LIKE '%ativ' AND length(b) - 4 >= r2 THEN {_left('b', '4')} ELSE {drop(['iv', 'os', 'ic', 'ad'])} END
      WHEN length(b) < r2 THEN w WHEN {isin(fixed._ES_ATION)} THEN {drop(['ic'])} {other}
      WHEN s = 'mente' THEN {drop(['ante', 'able', 'ible'])} WHEN {isin(['idad', 'idades'])} THEN {drop(['abil', 'ic', 'iv'])}
      WHEN {isin(['iva', 'ivo', 'ivas', 'ivos'])} THEN {drop(['at'])} ELSE b END"""
    one = f"SELECT term, rv, w AS w1, {w2} AS w FROM ({cut})"
    # 2
    ends = f"SELECT *, {_left('w', 'length(y)')} AS cy, {_left('w', 'length(v)')} AS cv FROM (SELECT *, regexp_extract(z, '{_any(fixed._ES_Y_VERBS)}') AS y, regexp_extract(z, '{_any([*fixed._ES_VERBS, *fixed._ES_VERBS_GU])}') AS v FROM (SELECT *, substr(w, CAST(rv + 1 AS BIGINT)) AS z FROM ({one})))"
    gu = ", ".join(repr(v) for v in fixed._ES_VERBS_GU)
    w3 = f"CASE WHEN w <> w1 THEN w WHEN y <> '' AND cy LIKE '%u' THEN cy WHEN v = '' THEN w WHEN v IN ({gu}) AND cv LIKE '%gu' THEN {_left('cv', '1')} ELSE cv END"
    two = f"SELECT term, rv, {w3} AS w FROM ({ends})"
    # 3
    rest = f"SELECT *, {_left('w', 'length(e)')} AS b FROM (SELECT *, regexp_extract(substr(w, CAST(rv + 1 AS BIGINT)), '{_any([*fixed._ES_RESIDUAL, 'e', 'é'])}') AS e FROM ({two}))"
    return f"SELECT term, translate(CASE WHEN e IN ('e', 'é') AND b LIKE '%gu' AND length(b) - 1 >= rv THEN {_left('b', '1')} ELSE b END, 'áéíóú', 'aeiou') AS stem FROM ({rest})"
