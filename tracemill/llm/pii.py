"""Personal data: exact base kinds, and further spans that candidate gradient boosting accepts.

Base kinds (email, ip, card, phone) follow fixed patterns and always stay. Beyond them high-recall generators propose
overlapping spans of further kinds: spelt-out mail addresses, IPv6 addresses, IBANs, local phone numbers, national ids,
dates of birth, street addresses and titled names. Boosted trees score each from its format, its checks and its context,
and a threshold per kind selects what is redacted: the lowest calibrated probability from which on held-out examples
are as precise as asked. The trees learn from examples made by rule for several countries (:func:`examples`; the number is a
parameter), as no table labels spans; cues are missing from some wanted ones and stand before some look-alikes, so that
neither format nor context decides alone.

Defined results: a null or empty text has no spans; repeated rows are scanned each; an empty table gives an empty one;
columns other than the id and the text are not read. Offsets are code points, ends exclusive. Of overlapping accepted
candidates the likeliest stays, then the leftmost, then the longest; a candidate that touches a base span goes.
"""

from __future__ import annotations

import bisect
import functools
import ipaddress
import itertools
import random
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .boosting import Trees, boosted, calibrated
from .common import map_rows, own_names, table
from .secret_scan import digests

Span = tuple[str, int, int]
BASE_KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Runs of digits and of what may stand between them; every ip and card lies in one.
CLUSTER = re.compile(r"[0-9]++(?:[\x20.()-]*+[0-9]++)*+")

#: What parts a spelt-out address: local part, separator, then the domain.
AT = re.compile(r" ?(?:\[at\]|\(at\)|\{at\}) ?| (?:at|arroba) ", re.I)
AT_LOCAL = re.compile(r"[A-Za-z0-9._-]{2,40}\Z")
AT_DOMAIN = re.compile(r"[A-Za-z0-9-]{2,40}(?: ?(?:\[dot\]|\(dot\)|\{dot\}) ?[A-Za-z0-9-]{2,20}| (?:dot|punkt|point|punto) [A-Za-z0-9-]{2,20}|\.[A-Za-z0-9-]{2,20}){1,3}", re.I)
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember|janvier|février|mars|avril|juin|juillet|août|septembre|octobre|novembre|décembre|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
#: Generators over the whole text: kind, pattern, words of which the text has to hold one, in lower case, for a try.
GENERATORS = (
    ("address", re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]? (?:[A-Z][\w'-]{1,20} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd)\b"), ("street", "avenue", "road", " lane", " drive", "boulevard", "blvd", *(f" {w}{end}" for w in ("st", "ave", "rd", "ln", "dr") for end in " .,;\n"))),
    ("address", re.compile(r"\b[A-ZÄÖÜ][\wäöüß-]{1,30}(?:straße|strasse|str\.|weg|platz|gasse|allee) [0-9]{1,4}[a-z]?\b"), ("straße", "strasse", "str.", "weg ", "platz ", "gasse ", "allee ")),
    ("address", re.compile(r"(?<![0-9A-Za-z])[0-9]{1,4}(?: bis)?,? (?:rue|avenue|boulevard|place|quai) (?:(?:de|du|des|la|le|les|l'|d') ?){0,3}[A-ZÀ-Ý][\w'-]{1,30}"), ("rue ", "avenue ", "boulevard ", "place ", "quai ")),
    ("address", re.compile(r"\b(?:Calle|Avenida|Plaza|Paseo) (?:(?:de|del|la|el|los|las) ){0,3}[A-ZÁ-Ú][\w'-]{1,30},? [0-9]{1,4}\b"), ("calle ", "avenida ", "plaza ", "paseo ")),
    ("name", re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Herrn|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra)\.? (?:[A-ZÀ-Ý][\w'-]{1,20})(?: [A-ZÀ-Ý][\w'-]{1,20}){0,2}"), (*(f" {w}{end}" for w in ("mr", "mrs", "ms", "dr", "prof", "mme", "sra") for end in " ."), "herr", "frau", "monsieur", "madame", "señor")),
    ("name", re.compile(r"\b(?:[Mm]y name is|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo) (?:[A-ZÀ-Ý][\w'-]{1,20})(?: [A-ZÀ-Ý][\w'-]{1,20}){0,2}"), ("my name is", "ich heiße", "je m'appelle", "me llamo")),
)
#: Generators tried inside the digit clusters only.
NUMERIC = (
    ("phone_local", re.compile(r"(?<![0-9])\(?[0-9]{2,5}\)?[ .-][0-9]{3,4}(?:[ .-][0-9]{3,4}){0,2}(?![0-9])")),
    ("phone_local", re.compile(r"(?<![0-9])0[0-9](?:[ .-][0-9]{2}){4}(?![0-9])")),
    ("phone_local", re.compile(r"(?<![0-9])0[0-9]{8,11}(?![0-9])")),
    ("national_id", re.compile(r"(?<![0-9])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9])")),
    ("national_id", re.compile(r"(?<![0-9])[12] ?[0-9]{2} ?[01][0-9] ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9])")),
)
#: Dates: tried at a cluster's begin, or at the name of a month before it.
DATES = (
    re.compile(r"(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}([./-])[0-9]{1,2}\2[0-9]{1,2})(?![0-9])"),
    re.compile(rf"[0-9]{{1,2}}\.? (?:de )?(?:{MONTHS}) (?:de )?(?:19|20)[0-9]{{2}}(?![0-9])"),
)
MONTH_FIRST = re.compile(rf"\b(?:{MONTHS}) [0-9]{{1,2}}(?:st|nd|rd|th)?,? (?:19|20)[0-9]{{2}}(?![0-9])")
#: National ids with letters: tried at a cluster's begin, or two letters before it.
NINO = re.compile(r"(?<![A-Za-z0-9])[A-CEGHJ-PR-TW-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D](?![A-Za-z0-9])")
DNI = re.compile(r"(?<![A-Za-z0-9])[0-9]{8}-?[A-Z](?![A-Za-z0-9])")
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
KINDS = ("email_spelt", "ipv6", "iban", "phone_local", "national_id", "birth_date", "address", "name")
#: Words before a span, in lower case, that speak for a kind, and some that speak against any.
CUES = {
    "email_spelt": ("mail", "email", "contact", "write", "reach", "correo", "kontakt", "schreib", "contacter"),
    "ipv6": ("ip", "host", "address", "client", "server", "ping", "from"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "phone_local": ("phone", "tel", "call", "mobile", "fax", "cell", "dial", "telefon", "téléphone", "teléfono", "anruf", "ring"),
    "national_id": ("ssn", "social", "security", "national", "taxpayer", "insurance", "dni", "nif", "sécu", "sécurité", "sociale"),
    "birth_date": ("born", "birth", "dob", "birthday", "geboren", "geburtsdatum", "né", "née", "naissance", "nacido", "nacida", "nacimiento"),
    "address": ("lives", "live", "address", "home", "wohnt", "adresse", "anschrift", "habite", "vive", "dirección", "resides", "at"),
    "name": ("patient", "customer", "contact", "dear", "signed", "am", "i", "hello", "liebe", "sehr", "geehrter", "cher", "estimado", "by"),
}
AGAINST = ("version", "order", "invoice", "isbn", "page", "pages", "item", "no", "part", "model", "chapter", "score", "year", "sku", "ref", "released", "published", "updated", "meeting", "character", "novel", "store", "serial")


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Per kind leftmost and not overlapping; a match that fails its test still uses up its text."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, end := m.end()))
        else:
            end = at + 1
        at = text.find("@", end)
    for c in CLUSTER.finditer(text):
        if c.end() - c.start() < 7:
            continue
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text, c.start(), c.end()) if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split("."))]
        for m in CARD.finditer(text, c.start(), c.end()):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 10 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append(("phone", at, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return found


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """The words that a text has to hold for a try, with the numbers of their generators; none stands for AT."""
    numbers: dict[str, tuple[int, ...]] = dict.fromkeys((" at ", "[at]", "(at)", "{at}", " arroba "), ())
    for i, (_, _, needs) in enumerate(GENERATORS):
        for n in needs:
            numbers[n] = (*numbers.get(n, ()), i)
    found = ahocorasick.Automaton()
    for word, own in numbers.items():
        found.add_word(word, (len(word), own))
    found.make_automaton()
    return found


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of the further kinds."""
    parted, tried = [], set()
    for end, (size, numbers) in automaton().iter(f" {text.encode().lower().decode()} "):
        tried.update(numbers)
        if not numbers:
            parted.append(end - size)  # the automaton reads one space more before the text
    found = {(kind, m.start(), m.end()) for n in tried for kind, pattern, _ in [GENERATORS[n]] for m in pattern.finditer(text)}
    for at in parted:
        m = (AT.match(text, at - 1) if text[at - 1 : at] == " " else None) or AT.match(text, max(at, 0))
        before, after = m and AT_LOCAL.search(text, max(0, m.start() - 40), m.start()), m and AT_DOMAIN.match(text, m.end())
        if before and after:
            found.add(("email_spelt", before.start(), after.end()))
    if "::" in text or text.count(":") >= 7:
        found |= {("ipv6", m.start(), m.end()) for m in IPV6.finditer(text) if "::" in m[0] or m[0].count(":") == 7}
    for c in CLUSTER.finditer(text):
        start = c.start()
        if c.end() - start >= 7:
            open_ = start - (text[start - 1 : start] == "(")
            found |= {(kind, m.start(), m.end()) for kind, pattern in NUMERIC for m in pattern.finditer(text, open_, c.end())}
            found |= {("national_id", m.start(), m.end()) for m in [DNI.match(text, start)] if m}
        if c.end() - start <= 12:  # a day, or a date in figures
            found |= {("birth_date", m.start(), m.end()) for pattern in DATES for m in [pattern.match(text, start)] if m}
            if text[start - 1 : start] == " " and (m := MONTH_FIRST.search(text, max(0, start - 11), c.end() + 12)):
                found.add(("birth_date", m.start(), m.end()))
        for at in (start - 2, start - 3):
            if at >= 0 and text[at : at + 2].isupper():
                found |= {(kind, m.start(), m.end()) for kind, pattern in (("iban", IBAN), ("national_id", NINO)) for m in [pattern.match(text, at)] if m}
    return sorted(found)


def mod97(code: str) -> bool:
    plain = re.sub("[^A-Z0-9]", "", code.upper())
    return len(plain) >= 15 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def is_ipv6(code: str) -> bool:
    try:
        return len(ipaddress.IPv6Address(code).exploded) > 0 and len(re.sub("[^0-9A-Fa-f]", "", code)) >= 4
    except ValueError:
        return False


def plausible_date(code: str) -> bool:
    numbers = [int(n) for n in re.findall("[0-9]+", code)]
    year = next((n for n in numbers if n > 1000), 0)
    rest = [n for n in numbers if n <= 1000]
    return 1900 <= year <= 2020 and all(1 <= n <= 31 for n in rest) and min(rest, default=0) <= 12


def holds(kind: str, own: str) -> float:
    """What a kind's own check says: 1 if it holds, 0 if not, 0.5 where there is none."""
    digits = re.sub("[^0-9]", "", own)
    if kind == "iban":
        return float(mod97(own))
    if kind == "ipv6":
        return float(is_ipv6(own))
    if kind == "birth_date":
        return float(plausible_date(own))
    if kind == "national_id":
        if len(digits) == 9:
            return float(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000")
        if len(digits) == 8:
            return float(own[-1] == DNI_LETTERS[int(digits) % 23])
        if len(digits) == 15:
            return float(97 - int(digits[:13]) % 97 == int(digits[13:]))
    return 0.5


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its context: 32 characters before it and 12 after it."""
    kind, a, b = span
    own, before, after = text[a:b], re.findall(r"[^\W\d_]+", text[max(0, a - 32) : a].lower())[-4:], text[b : b + 12]
    digits = re.sub("[^0-9]", "", own)
    groups = [len(g) for g in re.findall("[0-9]+", own)][:5]
    cue = [max((4 - len(before) + i + 1 for i, w in enumerate(before) if w in CUES[kind]), default=0), max((4 - len(before) + i + 1 for i, w in enumerate(before) if w in AGAINST), default=0)]
    shape = [len(own), len(digits), sum(c.isalpha() for c in own), own.count("."), own.count("-"), own.count(" "), own.count(":"), own.count("("), len(groups), *(groups + [0] * 5)[:5]]
    tests = [holds(kind, own), digits[:1] == "0", bool(groups) and groups[:1] == [4] and digits[:2] in ("19", "20"), len(set(digits)) <= 2, kind == "email_spelt" and own.lower().rsplit(" ", 1)[-1].strip("])} ") in ("com", "org", "net", "de", "fr", "es", "io", "edu", "uk", "info")]
    context = [text[a - 1 : a] == "+" if a else 0, text[a - 1 : a].isalnum() if a else 0, text[a - 1 : a] in "./#$-_=" if a else 0, after[:1].isalnum(), after[:1] in ("%", "/", "-", "_", ":"), "dot" in own.lower(), own[-1:].isalnum()]
    return [float(v) for v in [*(kind == k for k in KINDS), *cue, *shape, *tests, *context]]


def made(rng: random.Random, kind: str, good: bool) -> str:
    """A span of the kind, or a look-alike, in one of several countries' forms."""
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(3, 9)))
    cap, year = lambda: word().capitalize(), lambda: str(rng.randint(1930, 2015))
    if kind == "email_spelt":
        at, dot = rng.choice([(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), (" arroba ", " punto "), (" at ", " punkt ")])
        if good:
            return f"{word()}{rng.choice(['', '.' + word(), d(2)])}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}"
        return rng.choice([f"{word()} at {word()} dot {word()}", f"{word()} at {word()} point {word()}", f"{word()} at {word()}.{word()}"])
    if kind == "ipv6":
        part = lambda: f"{rng.randrange(65536):x}"
        if good:
            return rng.choice([":".join(part() for _ in range(8)), "2001:db8::" + part(), "fe80::" + ":".join(part() for _ in range(4)), ":".join(part() for _ in range(3)) + "::" + part()])
        return rng.choice([":".join(d(2) for _ in range(8)), f"{d(2)}::{d(2)}::{d(2)}", f"::{rng.choice('abcdef')}", ":::" + d(2), f"{d(1)}::"])
    if kind == "iban":
        country, n = rng.choice([("DE", 18), ("FR", 23), ("ES", 20), ("NL", 0), ("GB", 0), ("AT", 16), ("CH", 17)])
        body = "".join(rng.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(4)) + d(10 if country == "NL" else 14) if not n else d(n)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country) + "00") % 97
        code = f"{country}{(check if good else (check + 1 + int(d(1))) % 97):02d}{body}"
        return " ".join(code[i : i + 4] for i in range(0, len(code), 4)) if rng.random() < 0.5 else code
    if kind == "phone_local":
        if good:
            return rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(10)}", "0" + " ".join([d(1), *(d(2) for _ in range(4))]), f"6{d(2)} {d(3)} {d(3)}", f"0{d(2)}-{d(4)} {d(3)}"])
        return rng.choice([f"{d(3)}-{d(4)}", f"20{d(2)}-{d(4)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(3)} {d(3)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(9)}", f"{d(2)} {d(4)} {d(4)} {d(4)}", f"{d(5)}.{d(4)}", f"{rng.choice('abcdef')}0{d(rng.randint(8, 11))}{rng.choice('abcdef')}", f"0{d(9)}{rng.choice('abcdef')}{d(2)}", f"{d(3)} {d(4)}{rng.choice('abcdef')}{d(2)}"])
    if kind == "national_id":
        body, n = int(d(8)), int(rng.choice("12") + d(2) + f"{rng.randint(1, 12):02d}" + d(8))
        if good:
            return rng.choice([f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", f"{body:08d}{DNI_LETTERS[body % 23]}", f"{n}{97 - n % 97:02d}", f"{rng.choice(['AB', 'CE', 'JG', 'NR', 'WK'])} {d(2)} {d(2)} {d(2)} {rng.choice('ABCD')}"])
        return rng.choice([f"{rng.choice(['000', '9' + d(2), '666'])}-{d(2)}-{d(4)}", f"{d(3)}-00-{d(4)}", f"{body:08d}{DNI_LETTERS[(body + 1 + int(d(1))) % 23]}", f"{n}{(97 - n % 97 + 1 + int(d(1))) % 100:02d}", f"{d(3)}-{d(2)}-{d(4)}"])
    if kind == "birth_date":
        day, month, name = rng.randint(1, 28), rng.randint(1, 12), rng.choice(MONTHS.split("|"))
        form = rng.choice([f"{day}.{month}.{{}}", f"{day:02d}/{month:02d}/{{}}", f"{{}}-{month:02d}-{day:02d}", f"{day} {name} {{}}", f"{name} {day}, {{}}"])
        return form.format(year() if good or rng.random() < 0.6 else str(rng.randint(2016, 2030)))
    if kind == "address":
        if good:
            return rng.choice([f"{rng.randint(1, 9999)} {cap()} {rng.choice(['Street', 'Avenue', 'Road', 'Lane', 'Drive'])}", f"{cap()}{rng.choice(['straße', 'weg', 'platz', 'gasse'])} {rng.randint(1, 200)}", f"{rng.randint(1, 200)} rue {rng.choice(['', 'de ', 'du ', 'de la '])}{cap()}", f"Calle {rng.choice(['', 'de ', 'del '])}{cap()}, {rng.randint(1, 200)}"])
        return rng.choice([f"{cap()}{rng.choice(['weg', 'platz'])} {year()}", f"{rng.randint(1, 20)} place {cap()}", f"Plaza {cap()} {year()}"])
    title = rng.choice(["Mr", "Mrs.", "Ms", "Dr.", "Herr", "Frau", "Madame", "Señor", "Señora"])
    return f"{title} {cap()}{rng.choice(['', ' ' + cap()])}" if good else rng.choice([f"Dr {rng.choice(['No', 'Who', 'Pepper', 'Strange'])}", f"Mr {rng.choice(['Bean', 'Men', 'Universe'])}", f"Prof {rng.choice(['Plum', 'X', 'Moriarty'])}"])


def examples(n: int, seed: int) -> list[tuple[str, Span, int]]:
    """(text, span, label) made by rule: wanted spans and look-alikes of each kind, most wanted ones after a word that speaks
    for the kind, most look-alikes after another; all candidates that overlap are examples, and only the wanted span itself
    is right."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(3, 9)))
    while len(out) < n:
        kind, good = rng.choice(KINDS), rng.random() < 0.5
        own = made(rng, kind, good)
        cue = rng.choice(CUES[kind]) if rng.random() < (0.8 if good else 0.03) else word() if good or rng.random() < 0.5 else rng.choice(AGAINST)
        head = f"{word()} {word()} {cue}{rng.choice([' ', ': ', ' is ', ' number '] if good else [' ', ': ', ' #', ' '])}"
        text = f"{head}{own}{rng.choice([' ', '. ', ', ', ''])}{word()}" if rng.random() < 0.95 else head + own
        near = [s for s in candidates(text) if s[1] < len(head) + len(own) and s[2] > len(head)]
        out += [(text, s, int(good and s[0] == kind and text[s[1] : s[2]] == own)) for s in near]
    return out[:n]


@functools.cache
def trained(n_examples: int = 8000, seed: int = 7, precision: float = 0.97) -> tuple[Trees, dict[str, float]]:
    """Trees from half of the examples, calibration from a quarter, thresholds from the last quarter: per kind the lowest
    probability from which on so large a share is wanted, wherever it lies; 2 where there is none."""
    rows = examples(n_examples, seed)
    x, y = np.array([features(t, s) for t, s, _ in rows]), np.array([label for *_, label in rows], dtype=float)
    a, b = len(rows) // 2, 3 * len(rows) // 4
    model = calibrated(boosted(x[:a], y[:a], rounds=80), x[a:b], y[a:b])
    p, held, cuts = model.probability(x[b:]), y[b:], {}
    for kind in KINDS:
        own = np.array([s[0] == kind for _, s, _ in rows[b:]])
        q, right = p[own], held[own]
        order = np.argsort(-q, kind="stable")
        share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero((share >= precision) & np.append(q[order][1:] < q[order][:-1], True)) if len(order) else []
        cuts[kind] = float(q[order][good[-1]]) if len(good) else 2.0
    return model, cuts


def personal_data(text: str | None, model: Trees, cuts: dict[str, float]) -> list[Span]:
    if not text:
        return []
    base = base_spans(text)
    proposed = clear_of(candidates(text), [(a, b) for _, a, b in base])
    if not proposed:
        return base
    p = model.probability(np.array([features(text, s) for s in proposed]))
    chosen: list[Span] = []
    begins: list[int] = []
    ends: list[int] = []
    for q, s in sorted(zip(p, proposed, strict=True), key=lambda c: (-c[0], c[1][1], -c[1][2], c[1][0])):
        if q < cuts[s[0]]:
            continue
        k = bisect.bisect_left(begins, s[2])  # chosen spans don't overlap, so only the last that begins before its end can
        if k == 0 or ends[k - 1] <= s[1]:
            begins.insert(k, s[1])
            ends.insert(k, s[2])
            chosen.append(s)
    return base + chosen


def clear_of(spans: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """Those that touch none of the intervals in ``taken``."""
    if not taken:
        return spans
    taken = sorted(taken)
    starts, ends = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
    return [s for s in spans if (k := bisect.bisect_left(starts, s[2])) == 0 or ends[k - 1] <= s[1]]


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_examples: int = 8000, seed: int = 7, precision: float = 0.97) -> DataFrame:
    """(id, spans): ``spans`` lists kind, begin and stop of all personal data of the whole text."""
    model = docs.sparkSession.sparkContext.broadcast(trained(n_examples, seed, precision))  # some KB

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            yield {id_col: b[id_col], "spans": [[{"kind": k, "begin": a, "stop": z} for k, a, z in personal_data(t, *model.value)] for t in b[text_col]]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(own_names(docs, [id_col, text_col]), work, f"`{id_col}` {kind}, spans array<struct<kind: string, begin: int, stop: int>>")


def redact(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars", n_examples: int = 8000, seed: int = 7, precision: float = 0.97) -> DataFrame:
    """The documents, all columns kept, with personal data replaced in the text; a null text stays null."""
    model = docs.sparkSession.sparkContext.broadcast(trained(n_examples, seed, precision))

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            texts = [t and redacted(t, personal_data(t, *model.value)) for t in b[text_col]]
            lengths = {n_chars_col: [n if t is None else len(t) for t, n in zip(texts, b[n_chars_col], strict=True)]} if n_chars_col in b else {}
            yield b | {text_col: texts} | lengths

    return map_rows(docs, work, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            rows = [digests(s, BASE_KINDS) for s in b["spans"]]
            yield {"doc_id": b["doc_id"]} | {f"n_{k}": [r[0][i] for r in rows] for i, k in enumerate(BASE_KINDS)} | {"base_sha256": [r[1] for r in rows], "spans": [r[2] for r in rows]}

    return map_rows(find_personal_data(table(spark, sf_dir, "documents")), work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
