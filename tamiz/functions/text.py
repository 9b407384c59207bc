"""Text expressions that stay inside the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with a mark and the letter they count as.
ACCENTED = "áàâãäåāăąéèêëēėęěíìîïīįóòôõöøōőúùûüūůűųñńňçćčýÿšśžźżłďťřğ"
PLAIN = "aaaaaaaaaeeeeeeeeiiiiiioooooooouuuuuuuunnncccyysszzzldtrg"

NOT_WORD = r"[^\p{L}\p{N}]+"
WORD = r"[\p{L}\p{N}]+"
BLANKS = r"[\s\x{a0}\x{2000}-\x{200b}\x{202f}\x{3000}\x{feff}]+"


def fold(col: Column) -> Column:
    """Lower case, with letters that carry a mark as their base letter."""
    return F.translate(F.regexp_replace(F.lower(col), r"\p{M}+", ""), ACCENTED, PLAIN)


def squeeze(col: Column) -> Column:
    """Outer blanks cut, inner runs of blanks as one."""
    return F.trim(F.regexp_replace(col, BLANKS, " "))


def words(col: Column) -> Column:
    """Longest runs of letters and digits, in lower case; no words for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(col), F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def trim_to_word(col: Column) -> Column:
    """Lower case, without what stands before the first and after the last letter or digit."""
    return F.regexp_replace(F.lower(col), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


# tokenizer of the index --------------------------------------------------

_W = r"\p{L}\p{N}\p{M}_"
#: Unicode words: letters joined by one inner mark, numbers by one inner separator; no look-around, so that other engines take it too.
TOKEN = rf"(?:[{_W}]*(?:\p{{L}}(?:[.:·'’]\p{{L}})+|\p{{Nd}}(?:[.,;'’]\p{{Nd}})+))+[{_W}]*|[{_W}]+"
TOKEN_TRIM = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def tokenize(col: Column) -> Column:
    """Words with at least one letter or digit, trimmed to these; an empty array for null."""
    found = F.regexp_extract_all(col, F.lit(f"({TOKEN})"), F.lit(1))
    return F.coalesce(F.filter(F.transform(found, lambda t: F.regexp_replace(t, TOKEN_TRIM, "")), lambda t: t != ""), F.array().cast("array<string>"))


def keyword_tokens(col: Column) -> Column:
    """The whole text as one token; none for empty text or null."""
    return F.when(F.length(col) > 0, F.array(col)).otherwise(F.array().cast("array<string>"))


def lower_tokens(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def tokenize_python(text: str) -> list[str]:
    """The same words on the driver, for query strings."""
    import regex

    return [t for t in (regex.sub(TOKEN_TRIM, "", m) for m in regex.findall(f"({TOKEN})", text)) if t]


def token_offsets(col: Column) -> Column:
    """``array<struct<text, start, end, position>>`` with byte offsets (OP-34); an Arrow function, since no built-in has offsets."""
    @F.pandas_udf("array<struct<text:string,start:int,end:int,position:int>>")
    def run(texts: pd.Series) -> pd.Series:
        import regex

        pattern, trim = regex.compile(TOKEN), regex.compile(TOKEN_TRIM)

        def one(text: str | None) -> list[dict]:
            out: list[dict] = []
            for m in pattern.finditer(text or ""):
                word = trim.sub("", m.group())
                if word:
                    at = m.start() + m.group().index(word)
                    start = len(text[:at].encode())
                    out.append({"text": word, "start": start, "end": start + len(word.encode()), "position": len(out)})
            return out

        return texts.map(one)

    return run(col)
