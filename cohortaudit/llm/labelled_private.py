"""A small labelled table for the personal-data model, made from phrases and value forms.

Every row is a phrase with one value in it, which is personal (1) or only looks so (0).
A phrase belongs to one split, so what is tested stands in phrases that were not trained.
"""

from __future__ import annotations

import random

FIRST = ("anna", "jonas", "maria", "li.wei", "olu", "petra", "samir", "chloe", "diego", "ingrid")
LAST = ("meyer", "garcia", "dubois", "okafor", "larsen", "rossi", "novak", "tanaka", "smith", "silva")
SITES = ("posteo", "gmx", "mailbox", "outlook", "webpost", "uni-bonn", "correo", "laposte")
TOPS = ("de", "org", "fr", "net", "es", "co")

#: (kind, personal): phrases around a value.
PHRASES = {
    ("spelled", 1): ("write to {} any time", "mail me: {}", "Kontakt: {} oder per Post", "contact {} for the files", "you can reach her via {}", "Schreiben Sie bitte an {}", "escriba a {} por favor", "e-mail {} with questions", "my address is {}", "envoyez un message à {}", "send it over to {}", "email: {}", "ask {} about it", "correo: {}", "maintained by {}"),
    ("spelled", 0): ("they {} every week", "please {} first", "we {} again soon", "he liked to {} then", "users {} for news", "people {} before they go", "have a {} tomorrow", "I always {} instead", "she will {} later", "and {} too", "to {} was hard", "do not {} yet", "it did {} once", "both {} now", "let us {} there"),
    ("ip6", 1): ("logged in from {} last night", "client {} connected", "host {} replied", "visitor address {}", "peer {} closed the session", "request by {} denied", "source {} port 443", "adresse {} du poste", "IP {} seen", "IPv6: {}", "assigned {} to the laptop", "ping {} works", "from {} via proxy", "user at {} left", "{} - - GET /index"),
    ("ip6", 0): ("at {} the train left", "started {} finished late", "ratio {} of the parts", "it lasted {} in all", "um {} Uhr", "a las {} en punto", "time {} elapsed", "verse {} says", "scale {} is used", "record of {} stands", "from {} on", "aspect {} screens", "à {} précises", "lap {} was best", "the clock showed {}"),
    ("iban", 1): ("transfer to {} today", "IBAN: {}", "Konto {} bei der Bank", "pay into {} please", "account {} holder", "cuenta {} del cliente", "compte {} ouvert", "Bankverbindung {}", "bank details {}", "refund goes to {}", "Überweisung an {}", "virement sur {}", "her account is {}", "IBAN {} BIC", "salary paid to {}"),
    ("iban", 0): ("part {} in stock", "model {} replaces it", "licence key {} expired", "serial {} on the back", "catalogue {} lists", "Artikel {} lieferbar", "reference {} only", "tracking {} shipped", "product {} sold out", "code {} printed", "chip {} datasheet", "réf. {} épuisée", "pieza {} nueva", "lot {} recalled", "build {} passed"),
    ("number", 1): ("call me on {} after six", "phone: {}", "Tel. {} (Büro)", "mobile {} or landline", "fax {} only mornings", "teléfono {} de casa", "téléphone {} le soir", "ring {} and ask", "her cell is {}", "Telefon {} privat", "text me at {}", "whatsapp {} please", "my number is {}", "contact by phone {}", "Handy: {}", "appelez le {}", "llame al {} hoy", "dial {} now"),
    ("number", 0): ("ISBN {} hardcover", "order {} was shipped", "invoice {} is due", "a population of {} in all", "version {} fixes it", "see pages {} there", "{}", "the {} of it", "and {} were counted", "grant {} funded this", "ISSN {} online", "ticket {} closed", "sum of {} euros", "between {} and later", "case {} of the court", "doi {} cited", "code {} in the table", "in {} was the", "patent {} granted", "Nr. {} im Katalog", "measured {} units", "build {} passed"),
    ("identity", 1): ("SSN {} on file", "social security number {}", "passport {} issued", "her SSN: {}", "Ausweis {} gültig", "passport no. {}", "DNI {} del titular", "national id {}", "Reisepass {} von ihr", "numéro de sécurité sociale {}", "identity card {}", "pasaporte {} vigente", "taxpayer id {}", "driver licence {}", "Steuer-ID {}"),
    ("identity", 0): ("part {} fits", "room {} upstairs", "order {} shipped", "{}", "the {} of it", "model {} replaced", "item {} is new", "flight {} delayed", "and {} more", "invoice {} paid", "standard {} applies", "build {} passed", "id {} of the row", "route {} closed", "log {} rotated", "batch {} tested"),
    ("birth", 1): ("born {} in Lyon", "date of birth: {}", "DOB {} female", "geboren am {} in Bonn", "né le {} à Nice", "nacida el {} en Vigo", "birthday {} party", "birth date {}", "Geburtsdatum {}", "nacimiento: {}", "naissance {} Paris", "b. {} in Oslo", "her birthday is {}", "geb. {} ledig", "patient born on {}"),
    ("birth", 0): ("published {} online", "meeting on {} at ten", "{}", "due {} at noon", "updated {} again", "release {} is out", "on {} it rained", "Stand {} vorläufig", "le {} au matin", "el {} por la tarde", "valid until {} only", "founded {} in Rome", "signed {} by both", "version {} beta", "the {} of it"),
    ("handle", 1): ("follow {} for more", "on Twitter: {}", "Instagram {} posts", "via {} on the net", "tweet by {} said", "thanks {} for it", "DM {} please", "photo by {} today", "ping {} in chat", "Telegram {} group", "cc {} and others", "as {} wrote", "sígueme en {} ya", "folgt mir: {} dort", "profile {} online"),
    ("handle", 0): ("    {}\n    def area", "{} public void run", "{} screen and", "line {} of the doc", "\n{} class Foo", "rule {} in css", "/** {} x the value", "decorator {} on it", "annotation {} here", "css {} block", "tag {} in javadoc", "{} static final", "\n{} int value", "uses {} twice", "{} name the name"),
}


def _digits(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def _iban(rng: random.Random, valid: bool) -> str:
    land, length = rng.choice((("DE", 18), ("ES", 20), ("FR", 23), ("NL", 14), ("BE", 12), ("AT", 16)))
    body = "".join(rng.choice("0123456789") for _ in range(length))
    check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
    whole = f"{land}{check if valid else (check + rng.randint(1, 90)) % 97 + 2:02d}{body}"
    return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rng.random() < 0.5 else whole


def _date(rng: random.Random, years: tuple[int, int]) -> str:
    d, m, y, sep = rng.randint(1, 28), rng.randint(1, 12), rng.randint(*years), rng.choice("./-")
    return f"{y}-{m:02d}-{d:02d}" if rng.random() < 0.3 else f"{d:02d}{sep}{m:02d}{sep}{y}"


def value(rng: random.Random, kind: str, personal: int) -> str:
    """One value of the kind, or one that its generator also proposes."""
    pick = rng.choice
    if kind == "spelled":
        if not personal:
            return f"{pick(('look', 'meet', 'stay', 'arrive', 'chat', 'shop'))} at {pick(('noon', 'home', 'python', 'work', 'night', 'school'))}.{pick(('Then', 'It', 'org', 'We', 'The', 'com'))}"
        at, dot = pick(((" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", ".")))
        return f"{pick(FIRST)}{pick(('.', '_', ''))}{pick(LAST)}{at}{pick(SITES)}{dot}{pick(TOPS)}"
    if kind == "ip6":
        if not personal:
            return pick((f"{rng.randint(0, 23)}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}", f"{rng.randint(1, 20)}:{rng.randint(1, 20)}:{rng.randint(1, 20)}"))
        groups = [f"{rng.randrange(1 << 16):x}" for _ in range(8)]
        return pick((":".join(["2001", *groups[1:]]), "fe80::" + ":".join(groups[4:]), "2001:db8::" + ":".join(groups[6:]), ":".join(groups)))
    if kind == "iban":
        return _iban(rng, bool(personal))
    if kind == "number":
        d = _digits(rng, 12)
        if personal:
            return pick((f"0{d[:2]} {d[2:6]} {d[6:10]}", f"({d[:3]}) {d[3:6]}-{d[6:10]}", f"{d[:3]}-{d[3:6]}-{d[6:10]}", f"0{d[:3]}/{d[3:10]}", f"0{d[0]} {d[1:3]} {d[3:5]} {d[5:7]} {d[7:9]}", f"0{d[:10]}"))
        return pick((f"978-{d[0]}-{d[1:4]}-{d[4:9]}-{d[9]}", d, f"{d[:2]} {d[2:5]} {d[5:8]}", f"19{d[:2]}-19{d[2:4]}", f"{d[:2]}.{d[2:5]}.{d[5:8]}", d[:8], f"10.{d[:4]}/{d[4:10]}", f"{d[:4]}-{d[4:8]}"))
    if kind == "identity":
        d = _digits(rng, 9)
        passport = rng.choice("CFGHKL") + d[:8]
        if personal:
            return pick((f"{d[:3]}-{d[3:5]}-{d[5:]}", passport, d, d[:8] + rng.choice("ABDHJK")))
        return pick((d, d[:6], passport, d[:7]))
    if kind == "birth":
        return _date(rng, (1930, 2015) if personal else (1950, 2030))
    if personal:
        return "@" + pick(FIRST).replace(".", "_") + pick(("_", "", "x")) + pick((*LAST, _digits(rng, 3)))
    return "@" + pick(("property", "Override", "media", "param", "staticmethod", "Test", "return", "import", "Nullable", "Bean"))


def rows(each: int = 8, seed: int = 11) -> list[tuple[int, str, str, int, int, int, str]]:
    """(id, text, kind, start, end, personal, split): `each` values in every phrase; start and end in code points.

    Of a list of phrases every fifth is for testing, the one after it for calibration.
    """
    rng, out = random.Random(seed), []
    for (kind, personal), phrases in PHRASES.items():
        for k, phrase in enumerate(phrases):
            split = {3: "test", 4: "calibrate"}.get(k % 5, "train")
            for _ in range(each):
                before, _, after = phrase.partition("{}")
                made = value(rng, kind, personal)
                out.append((len(out), before + made + after, kind, len(before), len(before) + len(made), personal, split))
    return out
