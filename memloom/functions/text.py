"""Tokens, stop words, stems and stable ids."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z][A-Za-z0-9_-]{2,}"
SHORT_TOKEN = "[A-Za-z][A-Za-z0-9_-]{1,}"

# Stop words of unstemmed routing tokens.
ROUTING_STOP_WORDS = (
    "how many much what which who when where why did does have has had been being was were are the and or for from with that this these those "
    "currently recently past last next into onto about after before over under between during i you we they"
).split()
# Stop words of stemmed tokens.
STEMMED_STOP_WORDS = (
    "a an and are can did do doe for from had have how i in is it many mani me my of on or that the thi this to wa what when where which who with you"
).split()
# Stop words of the term rankers.
RANKER_STOP_WORDS = (
    "a an the is are was were be to for of on in by as or and that this with from it its at into about over under also can could should would will "
    "may might do does did done not no yes if then than there their we you they he she them our your"
).split()
# Concepts that are never matched.
NOISE_CONCEPTS = (
    "a an and are as at be by for from if in is it its of on or the to via with api app apps auth build config data doc docs feature features file files "
    "guide help id index info issue issues key keys log logs model models page pages role roles run runs service services setup status system test tests "
    "tool tools user users web cli sdk repo project"
).split()


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """Lower-case words of a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)


def sentence_total(text: Column) -> Column:
    """Stretches between . ! ? that aren't blank, at least one."""
    parts = F.filter(F.split(text, "[.!?]"), lambda s: F.trim(F.regexp_replace(s, r"\s", " ")) != "")
    return F.greatest(F.size(parts), F.lit(1))


def is_noise(concept: Column, more: list[str] | None = None) -> Column:
    """Concepts too short, of digits only, or too common to be matched."""
    return (F.octet_length(concept) < 3) | concept.rlike("^[0-9]+$") | concept.isin(NOISE_CONCEPTS + (more or []))


def concept_key(raw: Column) -> Column:
    """A concept's comparison form; letters with marks keep theirs (see ``plain_letters`` to drop them)."""
    return F.lower(F.translate(F.trim(raw), "_-", "  "))


def plain_letters(text: str) -> str:
    """Latin letters without marks; letters without a plain form are kept."""
    text = text.translate({ord("ß"): "ss", ord("ø"): "o", ord("Ø"): "O", ord("æ"): "ae", ord("Æ"): "AE", ord("œ"): "oe", ord("ł"): "l", ord("đ"): "d"})
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


# ---- English stems (the published Snowball "Porter2" rules) ----

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_INVARIANT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_STOP_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"),
    ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic"]


def _region(w: str, start: int) -> int:
    for k in range(max(start, 1), len(w)):
        if w[k] not in _V and w[k - 1] in _V:
            return k + 1
    return len(w)


def _short(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case English word."""
    w = word
    if len(w) <= 2:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    if w in _INVARIANT:
        return w
    if w[0] == "y":
        w = "Y" + w[1:]
    w = re.sub(r"(?<=[aeiouy])y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, 1) if r1 is None else r1
    r2 = _region(w, r1 + 1)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _STOP_1A:
        return w.lower()
    if w.endswith(("eed", "eedly")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if any(c in _V for c in w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLES):
                        w = w[:-1]
                    elif r1 >= len(w) and _short(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + to
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for s, to in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + to
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2:
                w = w[: -len(s)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()


_INDEX_TOKEN = re.compile("[A-Za-z][A-Za-z0-9]+")


def index_form(text: str | None) -> str | None:
    """Letters made plain, lower case, words of two or more characters that begin with a letter, stemmed."""
    if text is None:
        return None
    return " ".join(stem(m) for m in _INDEX_TOKEN.findall(plain_letters(text).lower()))


def index_forms(text: Column) -> Column:
    @F.pandas_udf("string")
    def forms(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(index_form, na_action="ignore")

    return forms(text)


def query_terms(normalized: Column) -> Column:
    """Terms of a normalised query: its words of three or more characters, duplicates kept."""
    return tokens(normalized)


# ---- stable ids: 64-bit FNV-1a over parts that end with a 0xFF byte ----

_FNV_OFFSET, _FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def fnv1a(parts: list[bytes]) -> int:
    value = int(_FNV_OFFSET)
    for part in parts:
        for b in part + b"\xff":
            value = ((value ^ b) * int(_FNV_PRIME)) & 0xFFFFFFFFFFFFFFFF
    return value


def stable_id(kind: str, *parts: Column) -> Column:
    """``kind:`` and 16 hex digits; the first part counts as it stands, the others in lower case with single spaces."""

    @F.pandas_udf("string")
    def ids(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            plain = [str(row[0] or "")] + [" ".join(str(x or "").split()).lower() for x in row[1:]]
            out.append(f"{kind}:{fnv1a([p.encode() for p in plain]):016x}")
        return pd.Series(out)

    return ids(*parts)
