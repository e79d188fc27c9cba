"""Made-up training texts for personal information, from a small grammar of four languages.

Values follow public formats (numbering plans, mail addresses, postal addresses,
identity numbers) over invented words; sentences are put together from general
word lists, so that no sentence is given as such.  Nothing is taken from the
tables worked on.
"""

from __future__ import annotations

import random

from memloom.llm.pii_words import ADDRESSING, ROLES, SAYING, THINGS, TITLES

_SYLLABLES = "ba be bri ca cor da del dra el en fa fen gal gri ha hol in is ja jor ka kel la lin lor ma mar mi mor na nel ol or pa pel ra ren ri sa sel so ta tel tor ul va ven vor wa wil ya yor za zel shi wei qua nha tsu dje bru kwa ndi".split()
_ENDS = "dam ford wick hurst stein berg mond grave stad land well croft more dale holm vane brook son sen ez ova ski ic ini eau ard ura oto wala oglu poulos".split()
_OBJECTS = {
    "en": "the report,a new chair,the second draft,her notes,that idea,the bill,a long letter,the garden,our roof,two boxes,this question,the old car,lunch,a ticket for the train,some advice".split(","),
    "de": "den Bericht,einen neuen Stuhl,das Fahrrad,die Rechnung,einen langen Brief,den Garten,zwei Kisten,diese Frage,das alte Auto".split(","),
    "fr": "le rapport,une chaise,la facture,une longue lettre,le jardin,deux boîtes,cette question,la vieille voiture".split(","),
    "es": "el informe,una silla,la cuenta,una carta larga,el jardín,dos cajas,esta pregunta,el coche viejo".split(","),
}
_LATER = {
    "en": ["last week", "again", "before noon", "in the end", "without a word", "for now", "on Tuesday", "this year", "", "", ""],
    "de": ["letzte Woche", "wieder", "vor Mittag", "am Ende", "am Dienstag", "", ""],
    "fr": ["la semaine dernière", "encore", "avant midi", "à la fin", "mardi", "", ""],
    "es": ["la semana pasada", "otra vez", "al final", "el martes", "", ""],
}
_FILLER = {
    "en": ["It rained all day.", "Nobody minded.", "There were forty guests, and most stayed.", "The lamp is broken; buy another.", "What a long winter!", "We will see."],
    "de": ["Es regnete den ganzen Tag.", "Niemand war da.", "Die Lampe ist kaputt.", "Mal sehen."],
    "fr": ["Il a plu toute la journée.", "Personne n'est venu.", "La lampe est cassée.", "On verra."],
    "es": ["Llovió todo el día.", "No vino nadie.", "La lámpara está rota.", "Ya veremos."],
}
_CUES = {
    "en": "social security number,SSN,ssn,national insurance number,NI number,tax ID,tax number,tax id number,passport number,passport no.,passport,driving licence,driver's license number,driving licence no.,national ID,national id number,identity card number,ID card,personal identity number,Medicare number,Aadhaar number,insurance number,social insurance number,identity number,licence number".split(","),
    "de": "Steuer-ID,Steuernummer,Sozialversicherungsnummer,Personalausweis Nr.,Reisepass,Reisepassnummer,Führerscheinnummer,Ausweisnummer,Steueridentifikationsnummer".split(","),
    "fr": "numéro de sécurité sociale,passeport n°,passeport numéro,carte d'identité n°,numéro fiscal,permis de conduire n°".split(","),
    "es": "DNI,NIE,NIF,pasaporte,número de la seguridad social,carnet de conducir,codice fiscale".split(","),
}
_WRONG = {
    "en": "invoice,invoice number,order,order no.,ticket,ticket number,batch,part no.,serial,serial number,SKU,version,build,offset,account code,tracking code,commit,case,page,model,item number,job,request".split(","),
    "de": "Rechnung,Bestellung,Auftrag,Seriennummer,Artikel,Vorgang".split(","),
    "fr": "facture,commande,colis,article,dossier".split(","),
    "es": "factura,pedido,artículo,lote,expediente".split(","),
}
_PHONE_LEAD = {
    "en": "call {},ring {},phone: {},tel. {},tel: {},telephone {},mobile {},cell {},text {},dial {},fax {},reach {V} on {},reach {V} at {},my number is {},the number is now {},{} is my new number,the line {} was dead,try {} instead,WhatsApp {},call back on {},{V} left {} with the clerk,{},contact: {},phone={}".split(","),
    "de": "Tel. {},Telefon: {},ruf {} an,unter {} erreichbar,Handy {},meine Nummer ist {},Fax {},{}".split(","),
    "fr": "appelez le {},tél. {},téléphone : {},mon portable est le {},au {} avant midi,{}".split(","),
    "es": "llame al {},teléfono {},tel. {},mi móvil es {},WhatsApp {},{}".split(","),
}
_MAIL_LEAD = {
    "en": "write to {},mail {},e-mail {},<{}>,({}),contact {},send it to {},{} bounced,reply to {},via {},{} answers fast,mail={},from {},cc {},{}".split(","),
    "de": "schreiben Sie an {},Mail an {},E-Mail: {},{}".split(","), "fr": "écrivez à {},courriel : {},{}".split(","), "es": "escriba a {},correo: {},{}".split(","),
}
_STREET_LEAD = {
    "en": "{V} lives at {},{V} moved to {},the flat at {},send it to {},deliver to {},address: {},home address {},a fire at {},in front of {},outside {},the office is {},{} was sold,the tenant of {},met at {},shop={},{}".split(","),
    "de": "{V} wohnt in der {},Anschrift: {},Adresse {},das Haus {},Lieferung an {},{}".split(","),
    "fr": "{V} habite au {},adresse : {},livrez au {},{}".split(","), "es": "{V} vive en {},dirección: {},envíe a {},{}".split(","),
}
_LIVES = {"en": ["she", "he", "my aunt", "the guest", "someone", "we", "they", "I"], "de": ["sie", "er", "meine Tante", "jemand"], "fr": ["elle", "il", "ma tante", "on"], "es": ["ella", "él", "mi tía", "alguien"]}
_PLACES = {"en": ["in", "at", "near", "from", "towards", "around"], "de": ["in", "bei", "nach", "aus"], "fr": ["vers", "près de", "dans"], "es": ["en", "hacia", "cerca de"]}
_THE = {"en": ["the", "a", "our", "this", "each"], "de": ["der", "die", "das", "ein"], "fr": ["le", "la", "un", "notre"], "es": ["el", "la", "un", "nuestro"]}
_TASKS = "Open Close Visit Read Write Run Start Stop Check Add Remove Update Create Delete Install Click Select Call Buy See Use Try Show Move Copy Save Merge Push Pull Test Plan Watch Join".split()
_LABELS = "Request Guide Notes Report Chapter Section Table Figure Page Release Changes Settings Template Overview Basics Summary Review Status Week Day Morning Project List Order Number Version Road Park Bridge Museum University Bank Station".split()
_STREET_EN = "St Street Ave Avenue Rd Road Blvd Lane Drive Court Close Way Place Terrace Square Crescent Parkway".split()


def _values(rng: random.Random) -> dict:
    syl = lambda n: "".join(rng.choice(_SYLLABLES) for _ in range(n))
    dig = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cap = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))
    return {"syl": syl, "dig": dig, "cap": cap}


def person(rng: random.Random, lexicon: dict[str, int], styled: bool = True) -> str:
    """A name; parts of it may become known to the lexicon."""
    v = _values(rng)
    given = v["syl"](rng.choice([1, 2, 2, 3])).capitalize()
    family = (v["syl"](rng.randint(1, 2)) + rng.choice([*_ENDS, "", ""])).capitalize()
    if len(given) < 3:
        given += "ra"
    if rng.random() < 0.08:
        family += "-" + v["syl"](2).capitalize()
    if rng.random() < 0.05:
        family = rng.choice(["de ", "van ", "von ", "Al-", "El-", "O'", "Mc"]) + family
    known = rng.random()
    if known < 0.45:
        lexicon[given.lower()] = 1
    if known < 0.35 or known > 0.9:
        lexicon[family.lower()] = 2
    if not styled:
        return f"{given} {family}"
    name = rng.choice([f"{given} {family}"] * 8 + [f"{family}, {given}", f"{given} {v['cap'](1)}. {family}", *[f"{given} {v['syl'](2).capitalize()} {family}"] * 2, f"{given} {family}".upper()])
    return name.lower() if known < 0.35 and rng.random() < 0.3 and " van " not in name else name


def mail(rng: random.Random) -> str:
    v = _values(rng)
    a, b = v["syl"](2), v["syl"](2) + rng.choice(_ENDS)
    local = rng.choice([f"{a}.{b}", f"{a}_{b}", f"{b}-{a}", f"{a[0]}{b}", f"{a}{v['dig'](2)}", f"{a}.{b}+{v['syl'](2)}", a, "info", "support", "billing", f"{a[0]}.{b}"])
    tld = rng.choice("org com net invalid test de io fr es it co.uk example".split())
    host = rng.choice([v["syl"](2), f"mail.{v['syl'](2)}", "example", f"{v['syl'](1)}.example", f"{v['syl'](2)}-{v['syl'](1)}"])
    kind = rng.random()
    if kind < 0.55:
        full = f"{local}@{host}.{tld}"
        return full.upper() if rng.random() < 0.08 else full
    spaced = f"{host}.{tld}".replace(".", " dot ") if kind >= 0.85 else f"{host}.{tld}".replace(".", " [dot] ")
    return f"{local} [at] {spaced}" if kind < 0.7 else f"{local}(at){host}.{tld}" if kind < 0.85 else f"{local} at {spaced}"


def phone(rng: random.Random) -> str:
    """Forms of public numbering plans."""
    d = _values(rng)["dig"]
    base = rng.choice([
        f"+44 {d(4)} {d(6)}", f"0{d(4)} {d(6)}", f"0{d(4)} {d(3)} {d(3)}", f"0{d(2)} {d(4)} {d(4)}", f"(0{d(2)}) {d(4)} {d(4)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
        f"+49 (0){d(2)} {d(5)} {d(3)}", f"+49 {d(2)} {d(6)}", f"0{d(3)} {d(7)}", f"{d(3)}.{d(3)}.{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+1 {d(3)}-{d(3)}-{d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}",
        f"+1{d(10)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"1 {d(3)} {d(3)} {d(2)} {d(2)}", *[f"{d(3)}-{d(4)}"] * 3, f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(8)}", f"0{d(4)} {d(3)} {d(3)}", *[f"({d(3)}) {d(3)}-{d(4)}"] * 2, f"+34 {d(3)} {d(3)} {d(3)}", f"+{d(2)} {d(5)} {d(5)}", f"+{d(2)} {d(2)} {d(3)} {d(4)}", f"{d(3)} {d(3)} {d(4)}",
    ])
    return base + rng.choice([f" ext. {d(2)}", f" x{d(3)}", f", ext {d(3)}"]) if rng.random() < (0.5 if len(base) == 8 else 0.15) else base


def identity(rng: random.Random) -> str:
    v = _values(rng)
    d, c = v["dig"], v["cap"]
    return rng.choice([
        f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9), f"{c(2)} {d(2)} {d(2)} {d(2)} {c(1)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{c(1)}{d(8)}", f"{c(1)}{d(7)}", f"{c(3)}-{d(4)}-{d(4)}", f"{c(2)}-{d(4)}-{d(4)}", f"{d(6)}-{d(4)}",
        f"{d(8)}{c(1)}", f"{c(1)}{d(7)}{c(1)}", f"{d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}", f"{c(1)}{d(2)}{c(1)}{d(5)}", f"{c(6)}{d(2)}{c(1)}{d(2)}{c(1)}{d(3)}{c(1)}", f"{d(1)}{c(2)}{d(1)}-{c(2)}{d(1)}-{c(2)}{d(2)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{c(5)}{d(6)}",
        d(12), f"{c(2)}{d(6)}{c(1)}", f"{d(2)} {d(6)} {c(1)} {d(3)}",
    ])


def street(rng: random.Random) -> str:
    v = _values(rng)
    way = " ".join(v["syl"](2).capitalize() for _ in range(rng.choice([1, 1, 2])))
    n = lambda: rng.randint(1, rng.choice([9, 99, 999, 1999]))
    unit = rng.choice(["", "", "", f", Apt {v['dig'](2)}", f", Suite {v['dig'](3)}", f" Unit {v['dig'](1)}B", f", Flat {v['dig'](1)}"])
    return rng.choice([
        f"{n()}{rng.choice(['', '', '', 'A'])} {rng.choice(['', '', '', 'North ', 'W. ', 'East '])}{rng.choice([way] * 6 + ['4th', '22nd'])} {rng.choice(_STREET_EN)}{rng.choice(['', '', '', ' NW'])}{unit}",
        f"{n()} {way} {rng.choice(_STREET_EN)}{unit}",
        f"{rng.randint(1, 199)}{rng.choice(['', '', ' bis'])}{rng.choice(['', ','])} {rng.choice(['rue', 'quai', 'impasse', 'avenue', 'chemin'])} {rng.choice(['des ', 'du ', 'de la ', ''])}{way}",
        f"{way.split()[0]}{rng.choice(['weg', 'straße', 'platz', 'ufer', 'gasse', 'str.', 'allee'])} {rng.randint(1, 199)}{rng.choice(['', '', 'b'])}",
        f"{rng.choice(['Calle', 'Avenida', 'Plaza', 'Paseo'])} {rng.choice(['', 'de la ', 'del '])}{way} {rng.randint(1, 199)}", f"{rng.choice(['Via', 'Viale', 'Corso', 'Piazza', 'Rua'])} {way} {rng.randint(1, 199)}",
    ])


Span = tuple[int, int, int]


def _clause(rng: random.Random, lang: str, lexicon: dict[str, int]) -> list[str | tuple[int, str]]:
    """A clause as pieces: plain text, or (type, value)."""
    verb, later, obj = rng.choice(SAYING[lang]), rng.choice(_LATER[lang]), rng.choice(_OBJECTS[lang])
    kind = rng.random()
    if kind < 0.12:
        return _card(rng, lexicon)
    if kind < 0.42:
        name = (4, person(rng, lexicon))
        other = (4, person(rng, lexicon, styled=False))
        role = rng.choice(ROLES[lang])
        title = rng.choice(TITLES[lang])
        ask, to = rng.choice(ADDRESSING[lang]), rng.choice({"en": ["by", "to", "with", "for", "from", "of"], "de": ["von", "mit", "an", "für"], "fr": ["par", "avec", "à", "pour", "de"], "es": ["por", "con", "a", "para", "de"]}[lang])
        my = {"en": ["my", "our", "the", "their"], "de": ["mein", "unser", "der"], "fr": ["mon", "notre", "le"], "es": ["mi", "nuestro", "el"]}[lang]
        return rng.choice([
            [name, f" {verb} {obj} {later}"], [name, f" {verb} {obj} {later}"], [f"{ask} ", name, f" {later}"], [f"{ask} ", name], [f"{obj} {to} ", name, f" {later}"], [f"{rng.choice(my)} {role}, ", name, f", {verb} {obj}"], [f"{rng.choice(my)} {role} ", name, f" {verb} {obj}"],
            [name, ", " + rng.choice(my) + f" {role}, {verb} {obj}"], [f"{title} ", name, f" {verb} {obj}"], [f"{ask} {title} ", name, f" {later}"], [f"{title} ", name], [{"en": "Yesterday ", "de": "Gestern ", "fr": "Hier ", "es": "Ayer "}[lang], name, f" {verb} {later}"], [name, {"en": " and ", "de": " und ", "fr": " et ", "es": " y "}[lang], other, f" {verb} {obj}"], [f"{role}: ", name], [f"{role}=", name, ";"],
            [{"en": "it was ", "de": "es war ", "fr": "c'était ", "es": "fue "}[lang], name, {"en": " who ", "de": ", wer ", "fr": " qui ", "es": " quien "}[lang] + f"{verb} {obj}"], [rng.choice({"en": ["Regards,\n", "Best wishes, ", "Thank you, ", "Hello ", "Dear "], "de": ["Viele Grüße\n", "Hallo ", "Liebe "], "fr": ["Cordialement,\n", "Bonjour ", "Cher "], "es": ["Saludos,\n", "Hola ", "Querido "]}[lang]), name, ","],
            [name, " <", (0, mail(rng)), "> "], [name, ", ", rng.choice([(1, phone(rng)), (3, street(rng))]), f", {verb} {obj}"], [f"{role}: ", name, " | ", (0, mail(rng))],
            [name], ['"', name, '"'], [rng.choice({"en": ["I am ", "I'm ", "my name is ", "this is "], "de": ["ich bin ", "ich heiße "], "fr": ["je suis ", "je m'appelle "], "es": ["soy ", "me llamo "]}[lang]), name, f" {to} {_values(rng)['syl'](2).capitalize()}"],
            [name, "'s " + rng.choice(["hat", "desk", "idea"])] if lang == "en" else [name, f" {verb} {obj}"], [f"{obj} {to} ", name, ", ", other, {"en": " and ", "de": " und ", "fr": " et ", "es": " y "}[lang], (4, person(rng, lexicon, styled=False))],
        ])
    def framed(leads: dict, k: int, value: str) -> list:
        a, _, b = rng.choice(leads[lang]).replace("{V}", rng.choice(_LIVES[lang])).partition("{}")
        return [a, (k, value), rng.choice([f"{b} {later}", b, b])]

    if kind < 0.47:
        return framed(_MAIL_LEAD, 0, mail(rng))
    if kind < 0.59:
        return framed(_PHONE_LEAD, 1, phone(rng))
    if kind < 0.71:
        cue = rng.choice(_CUES[lang]) + rng.choice(["", ":", " is", ",", " was"] if lang == "en" else ["", ":"])
        lead = rng.choice(["", "", rng.choice(["my ", "her ", "the ", "old "]) if lang == "en" else "", f"{obj}, "])
        return [f"{lead}{cue} ", (2, identity(rng)), rng.choice(["", f" {later}", f" {verb} {later}"])]
    if kind < 0.82:
        town = " ".join(_values(rng)["syl"](2).capitalize() for _ in range(rng.choice([1, 1, 2])))
        near = rng.choice(_PLACES[lang])
        return [*framed(_STREET_LEAD, 3, street(rng))[:2], rng.choice(["", f" {later}", f", {town}", f" {near} {town}", f" {near} {town}. ", f" {near} {town} {later}"])]
    return _negative(rng, lang, lexicon)


def _card(rng: random.Random, lexicon: dict[str, int]) -> list[str | tuple[int, str]]:
    """Two to four items about a person in a row, as in signatures, lists and exports."""
    items = [(4, person(rng, lexicon)), *rng.sample([(0, mail(rng)), (1, phone(rng)), (3, street(rng))], rng.randint(1, 3))]
    if rng.random() < 0.2:
        rng.shuffle(items)
    if rng.random() < 0.3:
        return [items[0], " (", items[1], *[x for i in items[2:] for x in (", ", i)], ")"]
    sign = rng.choice([", ", "; ", ";", " | ", "\n", "\n", " / ", "\t"])
    return [x for i in items for x in (sign, i)][1:]


def _negative(rng: random.Random, lang: str, lexicon: dict[str, int]) -> list[str]:
    v = _values(rng)
    word = lambda: v["syl"](rng.choice([1, 2, 2])).capitalize() + rng.choice(["", "", rng.choice(_ENDS)])
    a, b = word(), word()
    for w, p in ((a, 0.35), (b, 0.35)):
        if rng.random() < p:
            lexicon[w.lower()] = rng.choice([1, 2])
    thing, the, place, later = rng.choice(sorted(THINGS)), rng.choice(_THE[lang]), rng.choice(_PLACES[lang]), rng.choice(_LATER[lang])
    obj = rng.choice(_OBJECTS[lang])
    verb, wrong, label, d = rng.choice(SAYING[lang]), rng.choice(_WRONG[lang]), rng.choice(_LABELS), v["dig"]
    return [rng.choice([
        f"{wrong} {rng.choice([identity(rng), identity(rng), phone(rng).split(' ext')[0].lstrip('+')])} {later}", f"{wrong} {rng.choice([identity(rng), d(6) + '-' + d(4)])} was closed", f"{the} {a} {b} {thing} {verb} {later}", f"{the} {a} {thing.capitalize()} and {the} {b} {thing}",
        f"{the} {a} {b} {verb} {later}", f"{the} {a} {rng.choice(_LABELS)} {verb}", f"{place} {a} {b} {later}", f"{obj} {place} {a} {b}", f"{place} {a}", f"{rng.choice(_TASKS)} {a} {later}", f"{rng.choice(_TASKS)} {a} {label}", f"{rng.choice(_TASKS)} {the} {a} {label}", f"{label} {d(1)} {a}",
        f"{rng.choice(_TASKS)} {rng.choice(_LABELS)} {later}", f"{d(2)} {rng.choice(_STREET_EN)} {thing}s {verb}", f"{d(2)} {a} {rng.choice(_STREET_EN)} {thing}s", f"{the} {a} {rng.choice(_STREET_EN)} {thing} {verb}", f"port 10.0.{d(1)}.1:{d(4)}", f"version {d(1)}.{d(3)}.{d(4)}", f"a total of {d(3)} {d(3)} rows", f"{d(3)}:{d(4)} in all",
        f"line {d(3)}-{d(4)}", f"{rng.choice(['git', 'hg'])}@{v['syl'](2)}.{rng.choice(['org', 'invalid', 'test'])}:{v['syl'](2)}/{v['syl'](2)}.git", f"@{v['syl'](2)}/{v['syl'](2)}@{d(1)}.{d(1)}.0", f"@{v['syl'](2)}.{v['syl'](1)}(x={d(2)})", f"sat at {v['syl'](2)} dot {v['syl'](2)}s", f"looked at {the} dot on {the} map",
        f"on {d(1)} May 20{d(2)} {place} {a} {rng.choice(_LABELS)}", f"commit {d(4)}abc{d(3)}", f"{a} {b} {rng.choice(['Inc', 'Ltd', 'GmbH', 'University', 'Airport', 'Station', 'League'])} {verb}", f"# {a} {label}", f"{the} {label} {rng.choice(_LABELS)} {verb}", f"20{d(2)}-0{d(1)}-1{d(1)} 1{d(1)}:0{d(1)}", f"{rng.choice(_LABELS)} {a} {thing}",
    ])]


def sample(rng: random.Random) -> tuple[str, list[Span], dict[str, int]]:
    """One text, its true spans and the lexicon that goes with it."""
    lexicon: dict[str, int] = {}
    lang = rng.choice(["en", "en", "en", "de", "fr", "es"])
    text, spans = "", []
    for _ in range(rng.randint(2, 4)):
        if rng.random() < 0.5:
            text += rng.choice(_FILLER[lang]) + rng.choice([" ", "\n"])
        pieces = _clause(rng, lang, lexicon)
        first = True
        for p in pieces:
            value = p if isinstance(p, str) else p[1]
            if first and isinstance(p, str) and value[:1].islower() and rng.random() < 0.7:
                value = value[0].upper() + value[1:]
            if not isinstance(p, str):
                spans.append((p[0], len(text), len(text) + len(value)))
            text, first = text + value, False
        text = text.rstrip(" ") + rng.choice([". ", ".\n", " ", "! ", " - ", "\n", ", "])
    return text, [s for s in spans if s[2] <= len(text)], lexicon
