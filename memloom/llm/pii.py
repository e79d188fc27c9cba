"""Personal information in free text: found and replaced by typed placeholders.

Generators with high recall propose overlapping spans of five types; boosted
trees score each from its format and its context; spans over their type's
threshold are kept, the best of those that overlap.  The trees are fitted on a
bounded, made-up sample (TRAINING_TEXTS texts from the grammar of ``pii_texts``,
labelled by construction), the thresholds on a held-out part of it, so nothing is
learnt from the data worked on.

Types: ``email``, ``phone``, ``id_number``, ``street_address``, ``person_name``.

Edge cases: null and empty texts have no spans and stay as they are; a JSON text,
cut off or not, is searched string by string after decoding, and placeholders are
put into the raw text at the same place; repeated rows give the same spans; texts
are read whole.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions.sizing import spread_out, within
from memloom.llm.boost import Boosted
from memloom.llm.pii_texts import sample
from memloom.llm.pii_words import ADDRESSING_ANY, AND, DETERMINERS, GREETING, HEADING, PLACE, ROLES_ANY, SAYING_ANY, THINGS, TITLES_ANY, WHO

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDERS = {t: f"[{t.upper()}]" for t in TYPES}
TRAINING_TEXTS = 4_000
#: Names up to which the lexicon is sent to every task; those of a larger one are joined to the texts that hold them.
LEXICON_ROWS = 100_000

# Words that begin or bind sentences and are no part of a name.
COMMON = frozenset(
    """a about after again all also although an and answer any are as asked assigned at author be because before best between billing both build but by call
    callback cc contact could day dear deliver do does don't during each every everyone everybody few first for from further ging give has have he hello
    hi her here his home how i if in into is it its itself last late later let many mail may me meanwhile meet meine mi monday more most mr mrs ms my name need never next
    no nobody not note now of offset on once only open or other our out over overnight owner owns per phone ping please port record regards reply reviewed
    see send she ship since site so some somebody someone soon sometimes still sure talk team tel tell text thank thanks that that's the their them then there these they they're this those though
    ticket to today together tomorrow too two under unit until up upon user very wants was we we'll welcome were what when where whether which while who why will with without wrote yes
    yesterday yet you your dr prof nr nummer number apt suite invoice commit batch part ratio decorator install january february march april june july august september october november december tuesday wednesday
    thursday friday saturday sunday
    aber alle als am an auf auch aus außerdem bei bis da dann das dem den der des deshalb die dies diese ein eine einer er es für gestern heute hier ich ihr im in ist jede jetzt man mit nach nein noch nun ob oder
    ohne seit sie sind so über um und uns unser unter viele vom von vor wann war warum was wegen wenn wer wie wieder wir wo zu zum zur anschrift adresse nummer
    au aussi aux avec avant ce ces cette chaque comme dans de depuis des donc du elle elles en encore est et hier il ils je la le les leur lui mais merci même moi mon nous on ou où par pas plus pour pourquoi
    quand que qui sans ses si son sont sous sur tous tout très un une vous
    ahora al algo ante aquí así aunque cada como con cuando de del desde donde dos el ella en entre era es esta este esto fue gracias ha hace hasta hay hoy la las lo los más mi mientras muy nada no nos notamos nuestra
    nuestro o otra otro para pero por porque que quien se según si sin sobre son su también tras un una y ya""".split()
)
_DOT = r"(?:\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+|\.)"
_AT = r"(?:\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+|@)"
_EMAIL = regex.compile(rf"(?i)(?<![\w.+%@/-])[\p{{L}}\p{{N}}](?:[\w.+%'-]*[\p{{L}}\p{{N}}_])?{_AT}[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]*(?:{_DOT}[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]*)+")
_EXT = r"(?:,?\s*(?:ext\.?|extension|x|Durchwahl|poste)\s*\d{1,6})?"
_PHONES = [
    re.compile(rf"(?<![\w.@:/+-])\+\d{{1,3}}(?:[ .-]?\(0\)[ .-]?\d+|[ .-]?\(\d{{1,5}}\)|[ .-]?\d+)(?:[ .-]\d{{1,8}})*{_EXT}(?![\w-])"),
    re.compile(rf"(?<![\w.@:/+-])00\d{{1,3}}(?:[ .-]\d{{1,8}}){{2,6}}{_EXT}(?![\w-])"),
    re.compile(rf"(?<![\w.@:/+-])(?:1[ .-])?\(\d{{3,5}}\)[ .-]?\d{{2,4}}(?:[ .-]\d{{2,4}}){{1,3}}{_EXT}(?![\w-])"),
    re.compile(rf"(?<![\w.@:/+-])(?:1[ .-])?\d{{3}}[ .-]\d{{3}}[ .-]\d{{2}}[ .-]?\d{{2}}{_EXT}(?![\w-]|\.\d)"),
    re.compile(rf"(?<![\w.@:/+-])0\d{{1,4}}(?:[ .-]\d{{2,8}}){{1,4}}{_EXT}(?![\w-]|\.\d)"),
    re.compile(rf"(?<![\w.@:/+-])\d{{3}}-\d{{4}}{_EXT}(?![\w-]|\.\d)"),
    re.compile(rf"(?<![\w.@:/+-])\d[\d ().-]{{5,20}}\d{_EXT}(?![\w-]|\.\d)"),
]
_IDS = [
    re.compile(r"(?<![\w.@:/+-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    re.compile(r"(?<![\w.@:/+-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D A-Z](?![\w-])"),
    re.compile(r"(?<![\w.@:/+-])\d{2}(?: \d{3}){3}(?![\w-])"),
    re.compile(r"(?<![\w.@:/+-])[A-Z]{1,3}-?\d{4}-?\d{4}(?![\w-])"),
    re.compile(r"(?<![\w.@:/+-])\d{6}-\d{4}(?![\w-])"),
    re.compile(r"(?<![\w.@:/+-])(?=[A-Z0-9]{6,18}(?![\w-]))(?=[A-Z]*\d)[A-Z0-9]+"),
    re.compile(r"(?<![\w.@:/+-])(?=[A-Z\d]*\d)[A-Z\d]{3,4}(?:-[A-Z\d]{3,4}){2}(?![\w-])"),
    re.compile(r"(?<![\w.@:/+-])\d{2} \d{6} [A-Z] \d{3}(?![\w-])"),
    re.compile(r"(?<![\w.@:/+-])(?=[\w -]{6,})(?:[A-Z]{1,3}[ -]?)?\d{1,9}(?:[ -]\d{1,8}){0,7}(?:-?[A-Z])?(?![\w-])"),
]
_NUMBER_WORD = re.compile(r"(?:ID|NO|NR|SSN|DNI|NIE|NIF|NI)[ -]")
_ID_CUE = re.compile(
    r"(?i)(?:social security|national insurance|insurance|passport|driv(?:ing|er'?s?|er’s) licen[cs]e|licen[cs]e|national(?: identity| id)?|personal identity|identity(?: card)?|"
    r"\bid(?: card)?|\btax|\bssn\b|\bni\b|\bnino\b|\bnin\b|steuer-?id|steuernummer|steueridentifikationsnummer|sozialversicherungs|personalausweis|reisepass|ausweis|führerschein|"
    r"sécurité sociale|passeport|permis de conduire|carte d[’']identité|numéro fiscal|\bnir\b|pasaporte|\bdni\b|\bnie\b|\bnif\b|seguridad social|carnet de conducir|"
    r"medicare|aadhaar|codice fiscale|\bbsn\b|burgerservicenummer|\bpesel\b|\bcpf\b|\bcurp\b)"
    r"[^\d\n.;!?]{0,24}?(?:(?:no|nr|n)\.|number|nummer|número|numéro|id|n[°º])?[^\d\n;!?]{0,24}$"
)
_WRONG_CUE = re.compile(
    r"(?i)\b(?:invoice|ticket|order|batch|part|port|offset|build|version|commit|ratio|serial|sku|item|page|line|row|case|issue|job|task|request|tracking|code|model|amount|total|ttl|isbn|account|rechnung|facture|factura)"
    r"(?:\s+(?:number|no\.?|nr\.?|id|#))*\s*[:#=]?\s*$"
)
_PHONE_CUE = re.compile(
    r"(?i)(?:call|phone|tel|telephone|mobile|cell|text|callback|fax|whatsapp|reach|dial|desk at|nummer|telefon|handy|numéro|téléphone|portable|teléfono|móvil|número|ring|sms|hotline|line)[\w .:=,'’]{0,18}$"
)
_STREET_EN = "St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Lane|Ln|Drive|Dr|Court|Ct|Close|Way|Place|Pl|Terrace|Ter|Square|Sq|Crescent|Grove|Row|Walk|Mews|Parkway|Pkwy|Highway|Hwy|Alley|Trail|Circle"
_FLAT = r"(?:,? (?:Apt|Apartment|Suite|Ste|Unit|Flat|Floor|Room|Rm|#)\.? ?#?[A-Z0-9][\w-]*)?"
_STREETS = [
    regex.compile(rf"(?<![\w.,-])\d{{1,5}}[A-Za-z]?,? (?:(?:North|South|East|West|[NSEW]\.?|NE|NW|SE|SW) )?(?:\d{{1,3}}(?:st|nd|rd|th) |(?:\p{{Lu}}[\p{{L}}'’-]* ){{1,4}}?)(?:{_STREET_EN})\b(?: (?:NE|NW|SE|SW)\b| (?:North|South|East|West|[NSEW])\b(?!\.? \p{{Ll}}))?{_FLAT}"),
    regex.compile(rf"(?i:(?<![\w.,-])\d{{1,4}}(?: ?(?:bis|ter|quater)| ?[a-d])?,? (?:rue|avenue|quai|impasse|allée|boulevard|chemin|place|cours|route|square|passage|faubourg|sentier|villa))(?: (?:du|de la|des|de|le|la|les)\b| de l[’']| d[’']| l[’'])?(?: ?\p{{Lu}}[\p{{L}}’'-]*){{1,4}}{_FLAT}"),
    regex.compile(r"(?<![\w-])\p{Lu}[\p{L}-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ufer|ring|damm|steig|hof|markt|chaussee|pfad|stieg|graben|brücke|berg) \d{1,4}(?: ?[a-z](?!\p{L}))?(?![\d-])"),
    regex.compile(r"(?<![\w-])(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den) \p{Lu}[\p{L}-]+(?: \p{Lu}[\p{L}-]+)? \d{1,4}(?: ?[a-z](?!\p{L}))?(?![\d-])"),
    regex.compile(r"(?i:(?<![\w-])(?:calle|avenida|avda\.?|av\.|plaza|paseo|camino|carrera|ronda|travesía|c/))(?: (?:de la|de los|de las|del|de|la|el|las|los))?(?: \p{Lu}[\p{L}-]*){1,4},?(?: n\.?º)? \d{1,4}(?:, \d{1,2}\.?º(?: [A-Z])?)?(?![\d-])"),
    regex.compile(r"(?i:(?<![\w-])(?:via|viale|piazza|corso|largo|vicolo|rua|travessa))(?: (?:della|delle|del|dei|di|da|do|dos|das|de))?(?: \p{Lu}[\p{L}’'-]*){1,4},? \d{1,4}(?:/[A-Za-z])?(?![\d-])"),
]
_PARTICLES = frozenset("de van von der den da di del la dos ter ten bin al".split())
_TOKEN = regex.compile(r"[\p{L}][\p{L}\p{M}’']*(?:-[\p{L}][\p{L}\p{M}’']+)*")
def _near(cue: re.Pattern, text: str, start: int, reach: int = 64) -> float:
    return float(cue.search(text[max(0, start - reach) : start]) is not None)


def _clip(text: str, start: int, end: int) -> tuple[int, int]:
    """A street or name without sentence words that were taken along at its end."""
    while True:
        span = text[start:end]
        words = list(_TOKEN.finditer(span))
        if len(words) > 1 and words[-1].end() == len(span) and span[words[-1].start() - 1] == " " and words[-1].group().lower() in COMMON:
            end = start + len(span[: words[-1].start()].rstrip())
        else:
            return start, end


# Usual last labels of addresses.
_TLDS = frozenset("com org net edu gov io co de fr es jp uk us eu info biz invalid test example localhost dev app at ch it nl pl se local".split())


# What a text must have for the patterns above to be tried at all: each is necessary for a match of its kind.
_DIGIT = re.compile(r"\d")
_MAIL_SIGN = re.compile(r"[\[({<]\s*at\s*[\])}>]|\sat\s+[^\W_][\w-]*(?:\s*[\[({<]\s*dot|\s+dot\s|\.)")
_NUMBER = re.compile(r"\d(?:[ ().-]{0,4}[A-Z]{0,9}[ ().-]{0,2}\d){3}")
_STREET_WORDS = [
    frozenset(_STREET_EN.lower().split("|")), frozenset("rue avenue quai impasse allée boulevard chemin place cours route square passage faubourg sentier villa".split()),
    re.compile(r"(?:straße|strasse|str\.|weg|platz|gasse|allee|ufer|ring|damm|steig|hof|markt|chaussee|pfad|stieg|graben|brücke|berg) \d"), frozenset("am an auf im in zum zur unter".split()),
    frozenset("calle avenida avda av plaza paseo camino carrera ronda travesía c".split()), frozenset("via viale piazza corso largo vicolo rua travessa".split()),
]
_PAIR = regex.compile(r"\p{Lu}[\p{L}\p{M}'’-]*[.,]? (?:(?:de|van|von|der|den|da|di|del|la|dos|ter|ten|bin|al) ){0,2}\p{Lu}")
#: The same words as ``_TOKEN``, faster.
_WORD = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036f'’]|-(?=[^\\W\\d_]))*")


def candidates(text: str, lexicon: dict[str, int]) -> list[tuple[int, int, int]]:
    """(type, start, end) of all spans that may be personal information."""
    out: set[tuple[int, int, int]] = set()
    low = text.lower()
    words = _WORD.findall(low)
    if "@" in text or ("at" in words and _MAIL_SIGN.search(low)):
        for m in _EMAIL.finditer(text, overlapped=True):
            out.add((0, m.start(), m.end()))
    if _DIGIT.search(text):
        if _NUMBER.search(text):
            for p in _PHONES:
                for m in p.finditer(text):
                    if ". " not in re.split("[a-zA-Z]", m.group())[0]:  # a number ends where its sentence ends
                        out.add((1, m.start(), m.end()))
            for p in _IDS:
                for m in p.finditer(text):
                    if sum(c.isdigit() for c in m.group()) >= 4 and not _NUMBER_WORD.match(m.group()):
                        out.add((2, m.start(), m.end()))
        for p, word in zip(_STREETS, _STREET_WORDS, strict=True):
            for m in p.finditer(text) if (word.search(text) if isinstance(word, re.Pattern) else not word.isdisjoint(words)) else ():
                out.add((3, *_clip(text, m.start(), m.end())))
    if not _PAIR.search(text) and lexicon.keys().isdisjoint(words):
        return sorted(out)
    streets = [(s, e) for k, s, e in out if k == 3]
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
    if streets:
        tokens = [x if all(x[1] <= s or x[0] >= e for s, e in streets) else (x[0], x[1], "the") for x in tokens]
    known = [lexicon.get(w.lower(), 0) for _, _, w in tokens]
    for k, (s, _, w) in enumerate(tokens[:-1]):
        start_ok = w.lower() not in COMMON and w.lower() not in TITLES_ANY and w.lower() not in DETERMINERS and len(w) > 1 and (w[0].isupper() or known[k])
        if not start_ok:
            continue
        parts = 1
        for j in range(k + 1, min(k + 5, len(tokens))):
            gap, (a, e, v) = text[tokens[j - 1][1] : tokens[j][0]], tokens[j]
            initial = len(v) == 1 and v.isupper()
            if gap not in (" ", ". ", ", ", ". ") or (gap.startswith(".") and len(tokens[j - 1][2]) != 1) or (gap == ", " and j != k + 1):
                break
            particle = v in _PARTICLES and gap == " "  # inside a name only
            if not initial and not particle and (v.lower() in COMMON or not (v[0].isupper() or known[j] or (known[k] and w[0].islower()))):
                break
            parts += not initial and not particle
            if parts > 3:
                break
            if particle:
                continue
            if not initial:
                e -= 2 if v.endswith(("'s", "’s")) and len(v) > 3 else 0  # a possessive
                out.add((4, s, e))
            elif gap == " " and text[e : e + 1] == "." and j > k + 1:
                out.add((4, s, e + 1))
    return sorted(out)


def features(text: str, span: tuple[int, int, int], lexicon: dict[str, int]) -> list[float]:
    kind, start, end = span
    s, before, after = text[start:end], text[max(0, start - 64) : start], text[end : end + 48]
    digits = sum(c.isdigit() for c in s)
    left = before[-1:] or " "
    base = [len(s), digits, float(left.isspace()), float(left in "\"'([{<;=:|"), float(left in "/@.:"), float((after[:1] or " ") in " .,;!?)>]}|\n\"'")]
    if kind == 0:
        low = s.lower()
        local, domain = _halves(low)
        tld = re.split(r"[^\w-]+", domain)[-1]
        return [
            *base, float("@" in s), float(bool(re.search(r"[\[({<]\s*at", low))), float(" at " in low), float(bool(re.search(r"[\[({<]\s*dot", low))),
            float(" dot " in low), float(tld in _TLDS), float(tld.isalpha()), float(local in COMMON), float(any(c in local for c in "._+-") or any(c.isdigit() for c in local)),
            float(bool(lexicon.get(local, 0))), float(after[:1] == ":" and after[1:2].strip() != ""), float(after[:1] == "/"), float(local in ("git", "hg", "svn")),
            float(before.endswith(("ssh://", "//"))),
        ]
    if kind == 1:
        shape = re.sub(r"\d", "9", s)
        wrong, ident = _near(_WRONG_CUE, text, start), _near(_ID_CUE, text, start)
        return [
            *base, float(s[0] == "+"), float(s.startswith("0")), float(s.startswith(("1 ", "1-", "1."))), float("(" in s), s.count(" "), s.count("-"), s.count("."),
            float(bool(re.search(r"(?i)ext|x\s*\d", s))), float(bool(re.fullmatch(r"9{3}[.-]9{3}[.-]9{4}", shape))), float(bool(re.fullmatch(r"9{3}-9{4}.*", shape))),
            float(bool(re.fullmatch(r"9{3}-9{2}-9{4}", shape))), float(bool(re.fullmatch(r"(?:9{4}-){2}9{4}|9{6}-9{4}|9+", shape))),
            float(bool(re.match(r"(?i),?\s*(?:ext|x\d)", after))), float(not before.strip()), float(bool(re.search(r"[\n;|,(=]\s*$", before))), _near(_PHONE_CUE, text, start), wrong, ident, max((len(x) for x in re.findall(r"\d+", s)), default=0),
            min((len(x) for x in re.findall(r"\d+", s)), default=0),
        ]
    if kind == 2:
        shape = re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s))
        cue = _ID_CUE.search(before)
        return [
            *base, float(cue is not None), float(len(before) - cue.end(0) + len(cue.group()) if cue else 99), _near(_WRONG_CUE, text, start), _near(_PHONE_CUE, text, start),
            float(shape == "999-99-9999"), float(bool(re.fullmatch(r"AA(?: ?99){3} ?A", shape))), float(shape == "99 999 999 999"), float(bool(re.fullmatch(r"A99999999|AAA-9999-9999|999999-9999|9{9}", shape))),
            float(s[0].isalpha()), float(s[-1].isalpha()), s.count(" "), s.count("-"), float(bool(re.match(r"[ -]?[A-Z]?\d", after))), float(bool(re.search(r"[\dA-Z][ -]$", before))),
        ]
    if kind == 3:
        return [
            *base, float(bool(regex.search(rf"\b(?:{_STREET_EN})\b", s))), float(bool(re.search(r"(?i)\b(?:rue|avenue|quai|impasse|calle|plaza)\b", s))),
            float(bool(re.search(r"\d+ ?[a-z]?$", s))), float(bool(re.search(r"(?i)\b(?:apt|suite|unit|flat)", s))), float(len(_TOKEN.findall(s))),
            float(any(w.lower() in COMMON for w in _TOKEN.findall(s)[1:])), float(bool(re.match(r"[ ,]+(?:Apt|Suite|Unit)", after))), *_after_street(after),
        ]
    words = _TOKEN.findall(s)
    kinds = [lexicon.get(w.lower(), 0) for w in words]
    prior, gap = _word_before(before)
    follows = re.match(r"([ ]?)([^\W\d_][\w'’]*)?", after)
    beside, then = follows.group(1) == " ", (follows.group(2) or "")
    last, nxt = prior.lower(), then.lower()
    return [
        *base, float(len(words)), float("," in s), float(any(len(w) == 1 for w in words)), float(s.isupper()), float(s.islower()), float(kinds[0] & 1), float(kinds[0] >> 1 & 1),
        float(kinds[-1] & 1), float(kinds[-1] >> 1 & 1), float(sum(k > 0 for k in kinds)), float(sum(w.lower() in COMMON for w in words)), float(sum(w.lower() in THINGS for w in words)),
        float(words[0].lower() in HEADING), float(words[-1].lower() in HEADING), float(sum(w.islower() for w in words)),
        float(last in TITLES_ANY), float(last in ADDRESSING_ANY), float(last in ROLES_ANY), float(last in GREETING), float(last in DETERMINERS), float(last in PLACE), float(last in AND), float(bool(gap.strip())), float(gap == " "),
        float(prior[:1].isupper() and last not in COMMON), float(not prior), float(bool(re.search(r"[.!?\n]\s*$", before)) or not before.strip()), float(bool(re.search(r"[;{|<\"=:]\s*$", before))),
        float(beside and nxt in SAYING_ANY), float(beside and nxt in WHO), float(beside and nxt in THINGS), float(beside and nxt in HEADING), float(beside and nxt in AND), float(beside and then[:1].isupper() and nxt not in COMMON), float(beside and bool(then) and then.islower()),
        float(bool(re.match(r"\s*[<(|;]", after))), float(after[:1] in ",.!?;:" and after[:1] != ""), float(not after.strip()), float(bool(re.match(r"['’]s\b", after))), float(bool(re.match(r"\s*\n", after))), float(bool(re.match(r",? ?\d", after))),
        float(bool(re.search(r"\d[A-Za-z]?,? (?:[NSEW]\.? |North |South |East |West )?$", before))), float(bool(regex.search(rf"\b(?:{_STREET_EN})$", s))), float(min(len(w) for w in words)),
    ]


_BEFORE = re.compile(r"([^\W\d_][\w'’-]*)?\.?([^\w]*)$")


def _word_before(before: str) -> tuple[str, str]:
    """The last word of the context and what stands after it."""
    m = _BEFORE.search(before)
    return (m.group(1) or "", m.group(2)) if m else ("", "")


def _after_street(after: str) -> tuple[float, float]:
    """Whether the next word is a thing that the would-be street names, and whether it is a plural."""
    m = re.match(r" ([a-z]+)", after)
    w = m.group(1) if m else ""
    return float(w in THINGS or w.removesuffix("s") in THINGS), float(len(w) > 3 and w.endswith("s"))


def _halves(low: str) -> tuple[str, str]:
    m = re.search(r"\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+|@", low)
    return (low[: m.start()], low[m.end() :]) if m else (low, "")


@lru_cache(maxsize=1)
def model(texts: int = TRAINING_TEXTS, seed: int = 7) -> tuple[list[Boosted], list[float]]:
    """A model and a threshold for each type, fitted on made-up texts; a fifth of them sets the thresholds."""
    rng = random.Random(seed)
    rows: list[list[tuple[list[float], float]]] = [[] for _ in TYPES]
    held: list[list[tuple[list[float], float]]] = [[] for _ in TYPES]
    for n in range(texts):
        text, spans, lexicon = sample(rng)
        true = set(spans)
        for c in candidates(text, lexicon):
            (held if n % 5 == 0 else rows)[c[0]].append((features(text, c, lexicon), float(c in true)))
    models, cuts = [], []
    for own, test in zip(rows, held, strict=True):
        trees = Boosted().fit(np.array([f for f, _ in own]), np.array([y for _, y in own]))
        p, y = trees.probability(np.array([f for f, _ in test])), np.array([y for _, y in test])
        levels = np.linspace(0.1, 0.9, 33)
        f1 = [2 * ((p >= t) & (y > 0)).sum() / max(1, (p >= t).sum() + (y > 0).sum()) for t in levels]
        # The middle of the levels that do best.
        cuts.append(float(np.median(levels[np.array(f1) >= max(f1) - 1e-9])))
        models.append(trees)
    return models, cuts


def find(texts: list[str], lexicon: dict[str, int] | list[dict[str, int]], fitted: tuple[list[Boosted], list[float]]) -> list[list[tuple[int, int, int]]]:
    """Kept (type, start, end) of each text, in order and without overlaps; one lexicon for all, or one a text."""
    models, cuts = fitted
    of = (lambda n: lexicon) if isinstance(lexicon, dict) else lexicon.__getitem__
    spans = [(n, c) for n, t in enumerate(texts) for c in candidates(t, of(n))]
    score = np.zeros(len(spans))
    for k in range(len(TYPES)):
        own = [i for i, (_, c) in enumerate(spans) if c[0] == k]
        if own:
            score[own] = models[k].probability(np.array([features(texts[spans[i][0]], spans[i][1], of(spans[i][0])) for i in own]))
    kept: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = [i for i in range(len(spans)) if score[i] >= cuts[spans[i][1][0]]]
    # Best first; fairly sure ones by length, so that a number with its extension wins over the number alone.
    order.sort(key=lambda i: (-min(round(score[i], 1), 0.6), spans[i][1][1] - spans[i][1][2], spans[i]))
    for i in order:
        n, (k, s, e) = spans[i]
        if all(e <= a or s >= b for _, a, b in kept[n]):
            kept[n].append((k, s, e))
    return [sorted(x, key=lambda c: c[1]) for x in kept]


_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)("|\\?$)', re.S)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
_SURROGATE = re.compile("[\ud800-\udfff]")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def json_strings(raw: str) -> list[tuple[str, list[int]]]:
    """The decoded strings of a JSON text, cut off or not, each with the raw place of every character and of its end."""
    if raw.lstrip()[:1] not in ("{", "[", '"'):
        return [(raw, [*range(len(raw) + 1)])]
    out = []
    for m in _LITERAL.finditer(raw):
        chars, places, at, body = [], [], 0, m.group(1)
        for e in _ESCAPE.finditer(body):
            chars += body[at : e.start()]
            places += range(m.start(1) + at, m.start(1) + e.start())
            code = int(e.group(1), 16) if e.group(1) else None
            chars.append(chr(code) if code is not None else _PLAIN.get(e.group(2), e.group(2)))
            places.append(m.start(1) + e.start())
            at = e.end()
        chars += body[at:]
        places += range(m.start(1) + at, m.start(1) + len(body))
        places.append(m.start(1) + len(body))
        text, kept = "".join(chars), places
        if _SURROGATE.search(text):  # pairs of surrogates make one character
            joined, kept, i = [], [], 0
            while i < len(text):
                if 0xD800 <= ord(text[i]) < 0xDC00 and i + 1 < len(text) and 0xDC00 <= ord(text[i + 1]) < 0xE000:
                    joined.append(chr(0x10000 + ((ord(text[i]) - 0xD800) << 10) + ord(text[i + 1]) - 0xDC00))
                    kept.append(places[i])
                    i += 2
                else:
                    joined.append(text[i] if not 0xD800 <= ord(text[i]) < 0xE000 else "�")
                    kept.append(places[i])
                    i += 1
            text, kept = "".join(joined), [*kept, places[-1]]
        out.append((text, kept))
    return out


def redact_all(raws: list[str], is_json: list[bool], lexicon: dict[str, int] | list[dict[str, int]], fitted: tuple) -> list[tuple[list[dict], str]]:
    """Found items and redacted text of each raw text."""
    parts = [(n, t, places) for n, raw in enumerate(raws) for t, places in (json_strings(raw) if is_json[n] else [(raw, None)])]
    cuts: list[list[tuple[int, int, str]]] = [[] for _ in raws]
    found: list[list[dict]] = [[] for _ in raws]
    for (n, text, places), spans in zip(parts, find([t for _, t, _ in parts], lexicon if isinstance(lexicon, dict) else [lexicon[n] for n, _, _ in parts], fitted), strict=True):
        for k, s, e in spans:
            found[n].append({"pii_type": TYPES[k], "found_text": text[s:e]})
            cuts[n].append((places[s] if places else s, places[e] if places else e, PLACEHOLDERS[TYPES[k]]))
    out = []
    for raw, own, items in zip(raws, cuts, found, strict=True):
        text, at = [], 0
        for s, e, mark in sorted(own):
            text += [raw[at:s], mark]
            at = e
        out.append((items, "".join([*text, raw[at:]])))
    return out


def _names(rows: Iterable[tuple[str, str | None]]) -> dict[str, int]:
    """The parts of names in lower case: 1 for given names, 2 for family names, 3 for both."""
    names: dict[str, int] = {}
    for name, kind in rows:
        for part in _TOKEN.findall(name):
            names[part.lower()] = names.get(part.lower(), 0) | (2 if kind == "family" else 1)
    return names


def _held_names(records: DataFrame, lexicon: DataFrame, text: str, is_json: str) -> DataFrame:
    """(_key, _names): the names of a lexicon of any size that each text holds; at most as many as the text has words."""

    @F.pandas_udf("array<string>")
    def held(texts: pd.Series, flags: pd.Series) -> pd.Series:
        parts = lambda t, j: [x for x, _ in json_strings(t)] if j else [t]
        return pd.Series([sorted({w for x in parts(t, j) for w in _WORD.findall(x.lower())}) for t, j in zip(texts, flags.fillna(False), strict=True)])

    @F.pandas_udf("array<string>")
    def split(names: pd.Series) -> pd.Series:
        return pd.Series([[w.lower() for w in _TOKEN.findall(n)] for n in names])

    known = lexicon.where(F.col("name").isNotNull()).select(F.explode(split("name")).alias("word"), F.when(F.col("kind") == "family", 2).otherwise(1).alias("bit"))
    known = known.groupBy("word").agg(F.bit_or("bit").alias("bit"))
    own = records.where(F.col(text).isNotNull()).select(F.md5(text).alias("_key"), F.explode(held(text, is_json)).alias("word")).distinct()
    return own.join(known, "word").groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "bit"))).alias("_names"))


def redact(records: DataFrame, lexicon: DataFrame, text: str = "text", is_json: str = "is_json", lexicon_rows: int = LEXICON_ROWS) -> DataFrame:
    """``records`` with ``found`` (array of pii_type, found_text) and ``redacted``; ``is_json`` marks texts to decode.

    A lexicon (name, kind) of at most ``lexicon_rows`` rows goes to every task; the
    names of a larger one meet the texts by a join, with the same result.
    """
    small = within(lexicon, lexicon_rows)
    names = _names((r["name"], r["kind"]) for r in lexicon.where(F.col("name").isNotNull()).select("name", "kind").collect()) if small else None
    shared = records.sparkSession.sparkContext.broadcast((names, model()))

    def done(texts: pd.Series, flags: pd.Series, known: dict[str, int] | list[dict[str, int]]) -> pd.DataFrame:
        rows = redact_all(texts.fillna("").tolist(), flags.fillna(False).tolist(), known, shared.value[1])
        return pd.DataFrame({"found": pd.Series([f for f, _ in rows], dtype=object), "redacted": pd.Series([r for _, r in rows], dtype=object)})

    schema = "struct<found: array<struct<pii_type: string, found_text: string>>, redacted: string>"
    if small:

        @F.pandas_udf(schema)
        def work(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for texts, flags in it:
                yield done(texts, flags, shared.value[0])

        out = spread_out(records).withColumn("_pii", work.asNondeterministic()(F.col(text), F.col(is_json)))
    else:

        @F.pandas_udf(schema)
        def work(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for texts, flags, known in it:
                yield done(texts, flags, [dict(k) if k is not None else {} for k in known])

        held = records.join(_held_names(records, lexicon, text, is_json), F.md5(text) == F.col("_key"), "left")
        out = held.withColumn("_pii", work.asNondeterministic()(F.col(text), F.col(is_json), F.col("_names"))).drop("_key", "_names")
    kept = F.when(F.col(text).isNotNull(), F.col("_pii.redacted"))
    return out.withColumn("found", F.col("_pii.found")).withColumn("redacted", kept).drop("_pii")
