"""Identifiers with a format of their own: e-mail addresses, phone numbers, identity numbers, street addresses."""

from __future__ import annotations

import re

_AT = r"\s?(?:@|＠|\(at\)|\[at\]|\{at\})\s?"
_DOT = r"(?:\.|\s?[\[({]dot[\])}]\s?)"
EMAIL = re.compile(rf"(?<![\w.+-])[^\W_][\w.+'-]*{_AT}[^\W_](?:[\w-]*[^\W_])?(?:{_DOT}[^\W_](?:[\w-]*[^\W_])?)+", re.IGNORECASE)

_FREE, _DONE = r"(?<![\w.,/:+\-])", r"(?![\w]|[.,/:\-]\d)"
# Notations of identity numbers of several countries.
ID_FORMS = (
    r"\d{3}-\d{2}-\d{4}", r"\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}", r"\d{3}\.\d{3}\.\d{3}-\d{2}", r"\d{2} \d{3} \d{3} \d{3}", r"\d{12}", r"[XYZ]-?\d{7}(?:-?[A-Z])?", r"[A-Z]{2} ?\d{6} ?[A-Z]",
    r"[A-Z]{2}\d{2} ?\d{2} ?\d{2} ?[A-Z]",
)
ID_NUMBER = re.compile(rf"{_FREE}(?:{'|'.join(ID_FORMS)}){_DONE}", re.IGNORECASE)
PHONE = re.compile(
    rf"{_FREE}(?:\+\d{{1,3}}[ .\-]?(?:\(\d{{1,4}}\)[ .\-]?)?\d(?:[ .\-/]?\d){{6,11}}|\(\d{{2,5}}\)[ .\-]?\d(?:[ .\-/]?\d){{5,9}}|0\d(?:[ .\-/]?\d){{6,13}}|\d{{3}}[.\-]\d{{3}}[.\-]\d{{4}}){_DONE}"
)

# Kinds of streets and what stands around them, by language.
_EN = "Street|Road|Lane|Avenue|Drive|Close|Rise|Way|Court|Place|Square|Terrace|Crescent|Grove|Gardens|Row|Boulevard|Walk|Mews|Hill|Park|View|St|Rd|Ave|Blvd"
_DE = "straße|strasse|str\\.|weg|gasse|platz|allee|ring|ufer|damm|steig|hof|markt|holz|berg|graben|stieg|pfad"
_FR = "rue|avenue|av\\.|boulevard|bd|impasse|quai|place|chemin|allée|route|cours|square|passage|ruelle|sentier"
_ES = "C/|Calle|Avda\\.|Avenida|Av\\.|Plaza|Pza\\.|Paseo|P\\.º|Camino|Ronda|Travesía|Carretera|Glorieta"
_VI = "đường|phố|đại lộ"
_CAP = r"[A-ZÀ-ÞŁĐŒŠŽĂƠƯẠ-Ỹ][^\W\d_]*(?:[-'’][^\W\d_]+)*"
_NAME = rf"{_CAP}(?: {_CAP})?"
_ZIP = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}|[A-Z]{2} \d{5}|\d{5})"
_EN_STREET = rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Room) \d+[A-Za-z]?, )?\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}(?:{_EN})\b(?:, (?:Suite|Apt\.?|Floor|Unit|Flat) \d+[A-Za-z]?)?"
_ADDRESS = (
    rf"{_EN_STREET}(?:,?(?:\s|\r\n)(?:{_NAME}),?\s{_ZIP}\b|, {_NAME}(?! {_EN})(?: {_ZIP})?)?",
    rf"(?:(?:(?:Alte|Neue|Große|Kleine|Obere|Untere|Hohe|Lange|Kurze)[rs]? )?(?:[A-ZÄÖÜ][\w-]*?(?:{_DE})|(?:[A-ZÄÖÜ]\w+-)+(?:Straße|Platz|Weg|Allee|Ring|Gasse|Ufer|Damm))|(?:Am|Im|An der|An den|Auf dem|Auf der|Zum|Zur|Hinter dem|In der) (?!Tag|Ende|Woche)[A-ZÄÖÜ][\w-]+) \d{{1,4}}\s?[a-h]?\b(?:, \d{{5}} {_NAME})?",
    rf"\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:{_FR}) (?:(?:de la|de l['’]|du|des|de|d['’]|la|le|les|aux?) ?)?{_CAP}(?: {_CAP})*(?:, \d{{5}} {_NAME})?",
    rf"(?:{_ES}) ?(?:(?:de la|de los|de las|del|de) )?{_CAP}(?: (?:(?:de|del|la|los|las) )?{_CAP})*,? \d{{1,4}}(?:, (?:bajo|ático|entresuelo|\d+\.?[ºª](?: ?[A-Z]\b)?|piso \d+))*(?:, \d{{5}} {_NAME})?",
    rf"[Ss]ố \d{{1,4}}[A-Za-z]?(?:/\d+)*,? (?:(?:ngõ|hẻm|ngách|kiệt) \d+(?:/\d+)*,? )*(?:{_VI}) {_CAP}(?: {_CAP})*(?:, (?:phường|quận|xã|huyện|thị xã|thành phố|tỉnh|TP\.?) {_CAP}(?: {_CAP})*)*",
)
ADDRESS = re.compile("|".join(rf"(?<![\w])(?:{p})" for p in _ADDRESS))
_UP = r"[A-ZÀ-ÞŁĐ][A-ZÀ-ÞŁĐ'’\-]+"
ADDRESS_UPPER = re.compile(
    rf"(?<!\w)(?:(?:(?:FLAT|APT|UNIT) \d+[A-Z]?, )?\d{{1,5}}[A-Z]? (?:{_UP} ){{1,3}}(?:{_EN.upper()})\b(?:, (?:SUITE|APT|FLOOR|UNIT) \d+[A-Z]?)?(?:,?(?:\s|\r\n){_UP}(?: {_UP})?,?\s{_ZIP}\b|, {_UP}(?: {_UP})?(?: {_ZIP})?)?"
    rf"|(?:(?:ALTE|NEUE|AM|IM|AN DER) )?[A-ZÄÖÜß\-]+(?:STRASSE|STRAßE|WEG|GASSE|PLATZ|ALLEE|RING|HOLZ) \d{{1,4}}\s?[A-H]?\b(?:, \d{{5}} {_UP}(?: {_UP})?)?"
    rf"|\d{{1,4}}(?: (?:BIS|TER))? (?:RUE|AVENUE|IMPASSE|QUAI|BOULEVARD|PLACE|CHEMIN) (?:(?:DE LA|DU|DES|DE) )?{_UP}(?: {_UP})*(?:, \d{{5}} {_UP})?"
    rf"|(?:C/|CALLE|AVDA\.|AVENIDA|PLAZA|PASEO) ?(?:(?:DEL|DE LOS|DE LA|DE) )?{_UP}(?: {_UP})* \d{{1,4}}(?:, (?:BAJO|\d+\.?[ºª] ?[A-Z]\b))?(?:, \d{{5}} {_UP}(?: {_UP})?)?"
    rf"|SỐ \d{{1,4}} (?:(?:NGÕ|HẺM) \d+ )?(?:{_VI.upper()}) {_UP}(?: {_UP})*(?:, (?:PHƯỜNG|QUẬN) {_UP}(?: {_UP})*)?)"
)
FORMATS = (("email", EMAIL), ("address", ADDRESS), ("address", ADDRESS_UPPER), ("id_number", ID_NUMBER), ("phone", PHONE))

# What every match of a format holds, found faster than the format itself: an at sign, six digits in a row, a number beside a word of the kind.
_WRITTEN_AT = re.compile(r"[(\[{][aA][tT][)\]}]")
_SIX = re.compile(r"\d(?:[ .\-/]?\d){5}")
# apart, since a search for one kind of first letter is faster than for several
_STREETS = tuple(re.compile(x) for x in (rf"\d[A-Za-z]? (?:{_CAP} ){{1,3}}(?:{_EN})\b", rf"\d(?: (?:bis|ter|quater))?,? (?:{_FR}) ", _ES))
_UPPERS = tuple(re.compile(x) for x in (r"\d[A-Z]? [A-ZÀ-ÞŁĐ][A-ZÀ-ÞŁĐ'’\-]", r"[A-ZÀ-ÞŁĐß'’\-]{2} \d", r"SỐ \d"))
_NEXT_NUMBER = re.compile(r" \d")
_STREET_ENDS = ("straße", "strasse", "str.", *_DE.split("|")[3:], *(f"-{x}" for x in "Straße Platz Weg Allee Ring Gasse Ufer Damm".split()), "ố")
_STREET_BEGINS = tuple(f"{x} " for x in "Am|Im|An der|An den|Auf dem|Auf der|Zum|Zur|Hinter dem|In der".split("|"))


def _has_street(text: str) -> bool:
    """Whether the text may match ADDRESS."""
    if any(p.search(text) for p in _STREETS):
        return True
    for m in _NEXT_NUMBER.finditer(text):
        end = m.start()
        if text.endswith(_STREET_ENDS, 0, end) or text.endswith(_STREET_BEGINS, 0, text.rfind(" ", 0, end) + 1):
            return True
    return False


def _may_match(text: str) -> tuple[bool, bool, bool, bool, bool]:
    """Whether each of FORMATS may match."""
    six = _SIX.search(text) is not None
    return "@" in text or "＠" in text or _WRITTEN_AT.search(text) is not None, _has_street(text), any(p.search(text) for p in _UPPERS), six, six


def typed_spans(text: str) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind), in order; of overlapping ones the kind listed first in FORMATS."""
    taken: list[tuple[int, int, str]] = []
    for (kind, pattern), may in zip(FORMATS, _may_match(text)):
        for m in pattern.finditer(text) if may else ():
            a, b = m.span()
            while b > a and text[b - 1].isspace():
                b -= 1
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, kind))
    return sorted(taken)
