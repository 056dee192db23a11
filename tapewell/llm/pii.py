"""Personal information in free text: candidate spans, boosted trees, calibrated thresholds, placeholders."""

from __future__ import annotations

import gc
import pickle
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewell.llm.boosting import BoostedTrees
from tapewell.llm.tokens import DEFAULT_FOLDER, common_words
from tapewell.operators.records import latest_records
from tapewell.session import spread

_DATA = Path(__file__).with_name("data")
KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
#: Sentences made for training, half of them kept for the thresholds.
TRAINING = 10_000
#: Runs of words that are names with less than this probability whatever stands beside them aren't looked at further. On made
#: texts of another seed fewer than one name in a thousand is lost so (tests/llm/test_pii.py).
LEAST_OWN = 0.002
#: Features of the words themselves, the first ones of a name.
OWN = 17

_RECORD = "\ue000"
_L = r"[^\W\d_]"
_DIGIT = "zero|oh|one|two|three|four|five|six|seven|eight|nine"

# ---------------------------------------------------------------- generators
_AT = re.compile(r"\s?(?:@|[\[({]\s?at\s?[\])}])\s?|\sat\s(?=[\w-]+\s?(?:dot\s|[\[(]dot))", re.I)
#: The same from its first sign that is no space.
_AT_FROM = re.compile(r"[@\[({aA](?i:(?<=@)\s?|(?<=[\[({])\s?at\s?[\])}]\s?|(?<=\s[aA])t\s(?=[\w-]+\s?(?:dot\s|[\[(]dot)))")
_DOMAIN = re.compile(r"[\w-]+(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)[\w-]+)*", re.I)
_NUMBER = (
    rf"(?<![\w$.,])\+?\d{{1,4}}(?:[ .-]?\d{{1,4}}){{0,3}}[ .-](?:(?:{_DIGIT})\b[ -]?){{3,}}"
    r"|(?<![\w$])[A-Z]{2}\d{2} ?(?:[A-Z]{4}|\d{4})(?: ?\d{4}){1,6}(?: ?\d{1,4})?(?!\w)"
    r"|(?<![\w$])[A-Z](?=[A-Z\d]{8}(?!\w))(?:[A-Z]*\d){4,8}[A-Z\d]*(?!\w)"
    r"|(?<![\w$€£.,])(?:[A-Z]{1,2}[ -]?)?(?:\+ ?|\(\+?)?\d(?:\d|[ .\-/()]{1,2}(?=[\d(]))*\d(?:[ -]?[A-Z](?![\w]))?(?![\w%,]\d|\w)"
)
#: The same, looked for only where a first sign of it stands; nothing but that sign is consumed.
_NUMBER_FROM = re.compile(rf"[\d+(A-Z](?<![\w$].)(?:(?<![A-Z])|(?=[A-Z\d]{{8}}|[A-Z]?[ -]?[+(]{{0,2}} ?\d))(?<=(?=({_NUMBER}))[\d+(A-Z])")
_PLACE = rf"(?:\d{{4,5}} )?[A-ZÄÖÜÉÁ][\w'’-]+(?: [A-ZÄÖÜÉÁ][a-zß-ÿ'’-]+)?(?: (?:[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}}|[A-Z]{{2}} \d{{5}}|\d{{5}}))?"
_STREET = r"(?:street|st|avenue|ave|road|rd|lane|ln|drive|dr|court|ct|way|boulevard|blvd|place|pl|square|sq|terrace|close|crescent|gardens|grove|hill|mews|row|walk|park|circle|trail|alley|loop|parkway|highway|hwy)"
_ADDRESS = [
    re.compile(rf"(?<![\w$.,])\d{{1,5}}[a-zA-Z]? (?:{_L}[\w'’-]*\.? ){{1,3}}?(?i:{_STREET})\b\.?(?:,? (?i:apt|apartment|suite|unit|flat|no)\.? ?#?\w+)?(?P<place>,? {_PLACE})?"),
    re.compile(rf"(?<![\w$.,])\d{{1,5}} (?:[a-z][\w'’-]* ){{1,2}}{_STREET}\b\.?(?P<place>,? [a-z][\w'’-]+(?: (?!(?:and|on|in|at|for|to|or|if|but|with|last|next|this|is)\b)[a-z][\w'’-]+)?)?"),
    re.compile(rf"(?i:\bp\.? ?o\.? ?box|\bpost office box|\bpostfach|\bapartado(?: de correos)?|\bboîte postale|\bbp) \d+(?P<place>,? {_PLACE}|,? (?=[a-z])[a-z]+(?: [a-z]+)?(?=[.\n]))?"),
    re.compile(rf"\b(?i:calle|avenida|avda\.?|plaza|paseo|camino|c/) ?{_L}[\w'’-]*(?: {_L}[\w'’-]*)?,? \d+(?:, ?\d+ ?[ºª°]\.? ?[A-Z]?)?(?P<place>, {_PLACE})?"),
    re.compile(rf"\b{_L}[\w'’-]*(?i:straße|strasse|str\.|weg|platz|allee|gasse|damm|ufer) \d+ ?[a-z]?(?P<place>, {_PLACE}|,? \d{{5}} {_L}[\w-]+)?"),
    re.compile(rf"(?<![\w$.,])\d+(?: ?(?:bis|ter))?,? (?i:rue|avenue|boulevard|place|chemin|allée|impasse|quai) (?:(?:de|du|des|la|le|les|d'|l') ?)*{_L}[\w'’-]*(?: {_L}[\w'’-]*)?(?P<place>, {_PLACE})?"),
]
#: What an address holds; the patterns are tried only around these.
_STREET_WORDS = [
    *(f" {w}" for w in ("street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "drive", "dr", "court", "ct", "way", "boulevard", "blvd", "place", "pl", "square", "sq", "terrace", "close", "crescent", "gardens", "grove", "hill", "mews", "row", "walk", "park", "circle", "trail", "alley", "loop", "parkway", "highway", "hwy", "rue ", "chemin ", "allée ", "impasse ", "quai ", "bp ")),
    *("box ", "postfach", "apartado", "calle ", "avenida ", "avda", "plaza ", "paseo ", "camino ", "c/", "straße", "strasse", "str. ", "weg ", "platz ", "allee ", "gasse ", "damm ", "ufer ", "boîte postale"),
]
_PARTICLES = "van|von|der|den|de|del|della|di|da|dos|du|la|le|ten|ter|bin|ibn|al|el|af|av|zu|y"
_PART = r"[^\W\d_](?:[\w'’̀-ͯ-]*[^\W\d_][̀-ͯ]*)?"
#: Only the first sign is consumed, so that a title after a name begins a candidate of its own.
_TITLED = re.compile(
    r"[MmDdPpSHF](?<=\b(?=(?P<title>Miss|(?:[Mm]r|[Mm]rs|[Mm]s|[Dd]r|[Pp]rof|MR|MRS|MS|DR|Sra?|Mme|Mlle)\b\.?|Professor|Herr|Frau|Señora?|Monsieur|Madame|Sir) "
    rf"(?P<lead>(?:{_L}\. ?){{0,3}})(?P<a>{_L}[\w'’̀-ͯ-]+)(?P<mid>(?: (?:{_L}(?!\w)\.?|(?:{_PARTICLES})(?!\w))){{0,3}})(?: (?P<b>{_L}[\w'’̀-ͯ-]+)(?: (?P<c>{_L}[\w'’̀-ͯ-]+))?)?)[MmDdPpSHF])"
)
_NAME_PART = re.compile(f"({_PART})")
_MORE = re.compile(rf" ({_L}[\w'’-]+)")
_WORD = re.compile(rf"{_L}(?:[\w'’-]*{_L})?")


@lru_cache(maxsize=1)
def _first_names() -> frozenset[str]:
    lines = (_DATA / "first_names.txt").read_text(encoding="utf-8").splitlines()
    return frozenset(w for line in lines if not line.startswith("#") for w in line.split())


#: Words that tell what stands beside them, by kind.
_SETS = {
    "mail": "mail mails email emails e-mail e-mails mailbox inbox write writes wrote contact contacts reach ping message send sent forward forwarded cc bcc reply replied subscribe address account login spam postfach courriel correo escribe schreib schick écris mándalo",
    "phone": "call calls called calling tel phone phones telephone telephoned whatsapp telegram signal text texts number numbers no mobile cell cellphone landline fax ring rang dial dialled hotline helpline voicemail sms extension desk line reach handy telefon telefonnummer festnetz rufnummer ruf anruf erreichbar tél téléphone portable numéro appelle teléfono móvil llama llámame número",
    "id": "ssn social security tax taxpayer tin ein id ids passport passports national insurance nin iban bic account accounts bank identity number licence license card visa permit resident form steuer steuernummer steuer-id ausweis personalausweis reisepass pass konto kontonummer überweise rentenversicherung passeport sécu sécurité sociale compte virement carte pasaporte cuenta dni nie nif transferencia applicant wire transfer payroll w-9 hmrc irs",
    "not": "order orders filing filings isin cusip sku page pages version release volume shares support resistance spread expiry expires price prices target lots lot case ticket tickets build tracking invoice reference ref strike calls puts model serial revenue sales cik flight code ratio units premium coupon yield latitude longitude port ip server row line item part chapter section paragraph batch contract docket patent",
    "live": "live lives lived living address house home flat apartment office moved move moving deliver delivered delivers courier ship shipped mail mailed letter letters notice send sent meet visit visiting parked tenant tenants neighbours neighbors cottage registered label return pick headquarters wohne wohnt wohnung haus anschrift adresse habite bureau domicile vive vivo calle dirección",
    "who": "name names named am is mr regards signed sincerely faithfully dear advisor adviser manager colleague coworker friend boss accountant agent lawyer attorney solicitor doctor dentist nurse teacher trainer neighbour neighbor landlord tenant uncle aunt cousin brother sister wife husband father mother son daughter partner auditor treasurer chairman director cfo ceo ask asked tell told met meet spoke speak call called thank thanks contact with by from to for guy woman man lady cheers yours sentiments grüße gruß cordialement atentamente saludos herr frau",
    "did": "said says told tells wrote writes signed sold sells bought works worked runs ran is was has had who from never replied called emailed drove moved lives lived quit resigned left joined leads chairs married died owes lost taught lent spoke came",
    "firm": "systems holdings holding group inc incorporated corp corporation company co ltd limited llc plc ag se sa gmbh power trust motors stores therapeutics bancorp partners capital energy bank banks banking ventures industries labs laboratories pharma pharmaceuticals technologies technology tech resources foods media networks airlines air railways freight logistics software solutions services insurance financial finance securities investments realty properties materials chemicals mining minerals metals gold oil gas petroleum electric water steel semiconductor semiconductors devices microdevices instruments biosciences genetics health healthcare medical hotels entertainment studios brands international global national american united first savings credit acquisition enterprises stock shares etf index fund funds earnings calls puts bonds street avenue road lane square valley city county university college hospital club lake river mountain island park airport",
}
_SETS = {k: frozenset(v.split()) for k, v in _SETS.items()}


#: Words of an address before and after its street word: no pattern reaches further.
_ADDRESS_WORDS = (6, 12)
_HAS_DIGIT = re.compile(r"\d")
_PARTICLE_SET = frozenset(_PARTICLES.split("|"))
#: Middle names between a given and a family name, initials and particles not counted; and all of these together.
_MIDDLE_NAMES, _MIDDLE = 2, 4
_BREAK = re.compile(rf"[.!?]\s|\n|{_RECORD}")


class Candidate:
    __slots__ = ("kind", "start", "end", "x")

    def __init__(self, kind: str, start: int, end: int, x: Sequence[float]) -> None:
        self.kind, self.start, self.end, self.x = kind, start, end, x


_TOKEN = re.compile(r"[\w'’-]+")


def _parted(pattern: re.Pattern, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The matches of ``pattern``, which is one group, and where they begin and end."""
    parts = pattern.split(text)
    ends = np.fromiter(map(len, parts), np.int64, len(parts)).cumsum()
    return parts[1::2], ends[:-1:2], ends[1::2]


#: What a sign can be: a letter, part of a word (``_TOKEN``), between the letters of a name (``_PART``), letter or digit, combining, space.
_IS_LETTER, _IN_TOKEN, _IN_PART, _IS_ALNUM, _COMBINES, _IS_SPACE = 1, 2, 4, 8, 16, 32
_SIGNS = np.full(0x110000, 255, np.uint8)


def _signs(codes: np.ndarray) -> np.ndarray:
    """What each sign is; 255 stands for a sign not seen before."""
    out = _SIGNS[codes]
    new = out == 255
    if new.any():
        for code in np.unique(codes[new]).tolist():
            c = chr(code)
            known, mark = c.isalnum(), 0x300 <= code <= 0x36F
            word = known or c in "_'’-"
            _SIGNS[code] = known * _IS_ALNUM + (known and not c.isdecimal()) * _IS_LETTER + word * _IN_TOKEN + (word or mark) * _IN_PART + mark * _COMBINES + c.isspace() * _IS_SPACE
        out = _SIGNS[codes]
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _tokens(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the matches of ``_TOKEN`` begin and end."""
    inside = np.concatenate([[0], (signs & _IN_TOKEN) // _IN_TOKEN, [0]]).astype(np.int8)
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _sentence_ends(codes: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Where the matches of ``_BREAK`` end, but for those after "no." and "nr."."""
    point = np.isin(codes, [ord(c) for c in ".!?"])
    stop = point & np.append((signs[1:] & _IS_SPACE) > 0, False)[: len(codes)]
    if len(codes) > 2:
        stop[2:] &= ~((codes[2:] == 46) & np.isin(codes[:-2], [ord(c) for c in "nN"]) & np.isin(codes[1:-1], [ord(c) for c in "oOrR"]))
    line = (codes == 10) & ~np.append(False, point[:-1])[: len(codes)]
    return np.sort(np.concatenate([np.flatnonzero(stop) + 2, np.flatnonzero(line | (codes == ord(_RECORD))) + 1]))


def _parts(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the matches of ``_NAME_PART`` begin and end: from the first to the last letter of a run."""
    letters = np.flatnonzero(signs & _IS_LETTER)
    if not len(letters):
        return letters, letters
    run = np.cumsum((signs & _IN_PART) == 0)[letters]
    new = np.flatnonzero(run[1:] != run[:-1])
    first, last = letters[np.concatenate([[0], new + 1])], letters[np.concatenate([new, [len(letters) - 1]])] + 1
    more = np.flatnonzero((last < len(signs)) & (last - first > 1))
    for i in more[(signs[last[more]] & _COMBINES) > 0].tolist():
        while last[i] < len(signs) and signs[last[i]] & _COMBINES:
            last[i] += 1
    return first, last


def _lower(text: str) -> str:
    """Small letters, sign by sign: a few capitals have longer small forms and stay."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


_CUES = ("mail", "phone", "id", "not", "live", "who")
_CUES_OF = {w: [i for i, k in enumerate(_CUES) if w in _SETS[k]] for k in _CUES for w in _SETS[k]}


class _Index:
    """Where the words of a text and the ends of its sentences are, so that neighbours are found at any length of words."""

    last: tuple[str, "_Index"] | None = None

    def __init__(self, text: str) -> None:
        self.text = text
        self.codes = _codes(text)
        self.signs = _signs(self.codes)
        self.first, self.last = _tokens(self.signs)
        self.starts, self.ends = self.first.tolist(), self.last.tolist()
        self.stops = _sentence_ends(self.codes, self.signs).tolist()

    @classmethod
    def of(cls, text: str) -> _Index:
        if cls.last is None or cls.last[0] is not text:
            cls.last = (text, cls(text))
        return cls.last[1]

    def before(self, start: int, number: int) -> list[str]:
        """Up to ``number`` words before ``start`` in its sentence, the nearest first."""
        i, j = bisect_right(self.ends, start), bisect_right(self.stops, start)
        low = self.stops[j - 1] if j else 0
        return [self.text[self.starts[k] : self.ends[k]].lower() for k in range(i - 1, max(-1, i - 1 - number), -1) if self.starts[k] >= low]

    def cues_before(self, start: int, number: int) -> list[float]:
        """How near the nearest word of each set of cues is, within ``number`` words of the sentence."""
        out = [0.0] * len(_CUES)
        i, j = bisect_right(self.ends, start), bisect_right(self.stops, start)
        low, starts = self.stops[j - 1] if j else 0, self.starts
        for k in range(i - 1, max(-1, i - 1 - number), -1):
            if starts[k] < low:
                break
            for c in _CUES_OF.get(self.text[starts[k] : self.ends[k]].lower(), ()):
                out[c] = out[c] or float(8 - i + k + 2)
        return out

    def after(self, end: int, number: int) -> list[str]:
        i, j = bisect_left(self.starts, end), bisect_right(self.stops, end)
        high = self.stops[j] if j < len(self.stops) else len(self.text)
        some = [self.text[self.starts[k] : self.ends[k]].lower() for k in range(i, min(len(self.starts), i + number)) if self.ends[k] <= high]
        return [w for w in some if w != "--"]

    def window(self, at: int, back: int, ahead: int) -> tuple[int, int]:
        """From ``back`` words before ``at`` to ``ahead`` words after."""
        i = bisect_right(self.starts, at)
        return self.starts[max(0, i - 1 - back)] if i else 0, self.ends[min(len(self.ends) - 1, i + ahead)] if self.ends else len(self.text)


def _before(text: str, start: int) -> list[str]:
    return _Index.of(text).before(start, 6)


def _after(text: str, end: int) -> list[str]:
    return _Index.of(text).after(end, 3)


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Words before (nearest first) and after, within the record and the sentence."""
    return _before(text, start), _after(text, end)


def _cues_before(before: Sequence[str]) -> list[float]:
    """How near the nearest word of each set is."""
    out = [0.0] * len(_CUES)
    for i, w in enumerate(before):
        for k in _CUES_OF.get(w, ()):
            out[k] = out[k] or float(9 - i)
    return out


def _cues_after(after: Sequence[str]) -> list[float]:
    return [float(any(w in _SETS["not"] for w in after)), float(bool(after) and after[0] in _SETS["did"]), float(sum(w in _SETS["firm"] for w in after[:2]))]


def _cues(before: Sequence[str], after: Sequence[str]) -> list[float]:
    return _cues_before(before) + _cues_after(after)


def _ats(text: str) -> Iterator[tuple[int, int]]:
    """Where the matches of ``_AT`` begin and end."""
    at = upto = 0
    while m := _AT_FROM.search(text, at):
        start, at = m.start(), m.start() + 1
        if start > upto and text[start - 1].isspace():
            start -= 1
        elif m[0][0] in "aA":  # the space before it is taken
            continue
        at = upto = m.end()
        yield start, upto


def _email(text: str) -> Iterator[Candidate]:
    for begin, stop in _ats(text):
        a, sign = begin, text[begin:stop]
        while a and (text[a - 1].isalnum() or text[a - 1] in "._+-"):
            a -= 1
        left, right = text[a:begin], _DOMAIN.match(text, stop)
        if not left or not right:
            continue
        b = right.end()
        domain = right[0]
        if not re.search(r"\.|\bdot\b", domain, re.I):
            continue
        last = re.split(r"[.\s)\]}]+", domain.strip())[-1]
        before, after = _around(text, a, b)
        local = left.lstrip(".+-")
        a += len(left) - len(local)
        if not local:
            continue
        parts = len(re.findall(r"\.|dot", domain, re.I))
        x = [float(parts), float(last.isalpha()), float(len(last)), float(local.replace(".", "").isdigit()), float(domain.replace(".", "").isdigit()), float("@" in sign), float(len(local)), float(sign.strip() == "at"), float(sum(c.isdigit() for c in domain))]
        yield Candidate("email", a, b, x + _cues(before, after))


def _number_features(span: str, text: str, start: int, end: int) -> list[float]:
    groups = [len(g) for g in re.findall(r"\d+", span)]
    digits = sum(groups)
    first = re.search(r"\d+", span)
    head = first[0] if first else ""
    lead = re.match(r"[A-Za-z]*", span)[0]
    tail = re.search(r"[A-Za-z]?$", span)[0]
    g = groups + [0] * 6
    spoken = len(re.findall(_DIGIT, span))
    before, after = _around(text, start, end)
    prior = text[start - 1] if start else " "
    return [
        float(digits), float(len(groups)), float(g[0]), float(g[1]), float(g[2]), float(g[3]), float(groups[-1] if groups else 0),
        float("+" in span), float(head.startswith("00")), float(head.startswith("0")), float("(" in span), float("-" in span), float("." in span), float("/" in span), float(" " in span),
        float(len(lead)), float(bool(tail) and len(span) > 1 and spoken == 0), float(spoken), float(prior == "/" or prior == "#"),
        float(sum(c.isalpha() for c in span) - len(lead) - 20 * spoken), float(groups[:3] == [3, 3, 4]), float(groups == [3, 2, 4]),
        float(bool(re.fullmatch(r"(?:\d\d?[-./]\d\d?[-./](?:19|20)\d\d|(?:19|20)\d\d[-./]\d\d?[-./]\d\d?)", span))), float(digits == 11 and head[:1] == "1"),
        float(len(groups) > 2 and max(groups) <= 3 and "." in span and digits < 12 and groups[-1] < 4),
    ] + _cues(before, after)


def _numbers(text: str) -> Iterator[Candidate]:
    upto = 0
    while m := _NUMBER_FROM.search(text, upto):  # on from its end, as every start within would look at the whole number again
        upto = m.end(1)
        span = m[1].rstrip(" -")
        digits = sum(c.isdigit() for c in span) + len(re.findall(_DIGIT, span))
        if digits < 6 or digits < 7 and not any(c.isalpha() for c in span):
            continue
        start, end = m.start(), m.start() + len(span)
        x = _number_features(span, text, start, end)
        yield Candidate("phone", start, end, x)
        yield Candidate("id_number", start, end, x)
        if len(span) > 2 and span[-1].isalpha() and span[-2] in " -":  # so may a letter after
            x = _number_features(span[:-2], text, start, end - 2)
            yield Candidate("phone", start, end - 2, x)
            yield Candidate("id_number", start, end - 2, x)
        if span[:1].isalpha() and " " in span and span.split(" ", 1)[0].isalpha():  # a word before may not belong to it
            inner = start + len(span.split(" ", 1)[0]) + 1
            x = _number_features(span[inner - start :], text, inner, end)
            yield Candidate("phone", inner, end, x)
            yield Candidate("id_number", inner, end, x)


def _address(text: str, hints: Sequence[int]) -> Iterator[Candidate]:
    """``hints``: where words end that addresses hold; at least one digit must be within the words an address can have."""
    seen: set[tuple[int, int]] = set()
    upto = -1
    for at in hints:
        if at < upto or at + 1 < len(text) and text[at].isalpha() and text[at + 1].isalpha():
            continue
        low, high = _Index.of(text).window(at, *_ADDRESS_WORDS)
        if not _HAS_DIGIT.search(text, low, high):
            continue
        cut = text.rfind(_RECORD, low, at)
        low = cut + 1 if cut >= 0 else low
        cut = text.find(_RECORD, at, high)
        high = cut if cut >= 0 else high
        for k, pattern in enumerate(_ADDRESS):
            for m in pattern.finditer(text, low, high):
                a, b = m.span()
                if not (a <= at and b >= at) or (a, b) in seen:
                    continue
                seen.add((a, b))
                upto = max(upto, b)
                yield _address_candidate(text, m, k, b)
                short = re.search(r"(?<=[\w'’-]) [A-ZÄÖÜÉÁ][a-zß-ÿ'’-]+$", m["place"] or "")
                if short:  # the second word of the place may belong to what follows
                    yield _address_candidate(text, m, k, b - len(short[0]))


def _address_candidate(text: str, m: re.Match, k: int, end: int) -> Candidate:
    span, place = text[m.start() : end], (m["place"] or "")
    place = place[: len(place) - (m.end() - end)]
    before, _ = _around(text, m.start(), end)
    words = _WORD.findall(span)
    x = [
        float(k), float(bool(place)), float(len(place)), float(any(c.isdigit() for c in span)), float(sum(c.isdigit() for c in span)), float(any(w[0].isupper() for w in words[1:])), float(len(words)),
        float(bool(re.search(r"\d{5}|[A-Z]{1,2}\d ?\d?[A-Z]{2}", place))), float(bool(re.search(r"(?i)\bapt|\bsuite|[ºª]", span))), float(sum(w.lower() in _SETS["firm"] for w in words)),
    ]
    return Candidate("address", m.start(), end, x + _cues(before, []))  # what follows says nothing about a place


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which characters are letters or digits."""
    different, back = np.unique(codes, return_inverse=True)
    return np.array([chr(c).isalnum() for c in different.tolist()], bool)[back]


#: Places from which on their surroundings are read together.
MANY = 32
#: What is known of a word beside a candidate: its sets of cues; capital, of a firm, common, of what is no number of a person, a deed, a dash.
_TOKEN_SIGNS = len(_CUES) + 6


class Finder:
    """Generators and models together; pickled with the task. ``folder`` holds the public vocabulary."""

    def __init__(self, folder: str = DEFAULT_FOLDER) -> None:
        self.folder = folder
        self.companies: frozenset[tuple[str, str]] = frozenset()  # neighbouring words of company names
        self.company_words: frozenset[str] = frozenset()
        self.models: dict[str, BoostedTrees] = {}
        self.thresholds = {k: 0.5 for k in KINDS}
        self._automaton = None
        self._possible: dict = {}
        self._forms: dict[tuple, int] = {}
        self._known: list[tuple] = []
        self._read_of: dict[str, int] = {}
        self._read_rows: list[tuple] = [(0,) * _TOKEN_SIGNS]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_possible": {}, "_forms": {}, "_known": [], "_read_of": {}, "_read_rows": [(0,) * _TOKEN_SIGNS]}

    def _word(self, w: str) -> tuple[bool, bool, bool, float, float, bool]:
        """Given name, common, of a company, shape, length, particle."""
        low = w.lower()
        shape = 0.0 if not w else 3.0 if w.isupper() and len(w) > 1 else 2.0 if w[0].isupper() else 1.0
        return low in _first_names(), low in common_words(self.folder), low in _SETS["firm"], shape, float(min(len(w), 12)), low in _PARTICLE_SET

    @staticmethod
    def _own(title: bool, order: float, given: tuple, family: tuple, mid: tuple) -> list[float]:
        """Features of the words themselves; ``mid`` counts initials, particles, names, common words and small letters."""
        return [
            float(title), order, float(given[0]), float(given[1]), float(given[2]), given[3], given[4],
            float(family[0]), float(family[1]), float(family[2]), family[3], family[4], *map(float, mid),
        ]

    def _left(self, text: str, start: int) -> list[float]:
        index = _Index.of(text)
        k = bisect_right(index.ends, start) - 1
        prior = text[index.starts[k] : index.ends[k]] if k >= 0 and index.ends[k] == start - 1 and text[start - 1] == " " else ""
        prior = prior.lower() if prior[:1].isupper() and len(prior) > 1 else ""
        return [
            float(bool(prior)), float(prior in _SETS["firm"]), float(prior in common_words(self.folder)),
            float(text[start - 1 : start] in "@/#$." if start else False), float(text[max(0, start - 3) : start] == "-- "),
        ] + index.cues_before(start, 6)

    def _right(self, text: str, end: int) -> list[float]:
        follow = text[end : end + 1]
        more = _MORE.match(text, end)
        more = more[1].lower() if more and more[1][0].isupper() else ""
        return [
            float(bool(more)), float(more in _SETS["firm"]), float(more in common_words(self.folder)),
            float(bool(follow) and (follow in "@_" or follow.isalnum())), float(follow == ","),
        ] + _cues_after(_after(text, end))

    def _read(self, index: _Index, tokens: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """What the tokens with these numbers are, a row of ``_TOKEN_SIGNS`` each; zeros where not ``inside``."""
        needed = np.zeros(len(index.starts) + 1, bool)
        needed[tokens[inside]] = True
        needed = np.flatnonzero(needed)
        if len(self._read_rows) > 400_000:
            self._read_rows, self._read_of = [(0,) * _TOKEN_SIGNS], {}
        rows, of, text = self._read_rows, self._read_of, index.text
        number = np.zeros(len(index.starts) + 1, np.int64)
        got = []
        for a, b in zip(index.first[needed].tolist(), index.last[needed].tolist()):
            w = text[a:b]
            n = of.get(w)
            if n is None:
                n = of[w] = len(rows)
                low, cues = w.lower(), _CUES_OF.get(w.lower(), ())
                capital = len(w) > 1 and w[0].isupper()
                rows.append((*(c in cues for c in range(len(_CUES))), capital, low in _SETS["firm"], low in common_words(self.folder), low in _SETS["not"], low in _SETS["did"], low == "--"))
            got.append(n)
        number[needed] = got
        different, back = np.unique(np.where(inside, number[tokens * inside], 0), return_inverse=True)
        return np.array([rows[n] for n in different.tolist()], bool).reshape(-1, _TOKEN_SIGNS)[back.reshape(tokens.shape)]

    def _lefts(self, text: str, start: np.ndarray) -> np.ndarray:
        """``_left`` of many places."""
        index = _Index.of(text)
        signs = np.concatenate([[0, 0, 0], index.codes])  # from three before
        at = lambda i: signs[i + 3]
        nearest = np.searchsorted(index.last, start, side="right") - 1
        stops = np.array([0, *index.stops])
        low = stops[np.searchsorted(stops[1:], start, side="right")]
        back = nearest[:, None] - np.arange(6)
        inside = back >= 0
        back = back * inside
        inside &= index.first[back] >= low[:, None]
        # the word just before may stand in another sentence
        beside = (nearest >= 0) & (index.last[back[:, 0]] == start - 1) & (at(start - 1) == 32)
        prior = self._read(index, back[:, :1], beside[:, None])[:, 0]
        capital = prior[:, len(_CUES)]
        out = np.zeros((len(start), 5 + len(_CUES)))
        out[:, 0] = capital
        out[:, 1], out[:, 2] = capital & prior[:, len(_CUES) + 1], capital & prior[:, len(_CUES) + 2]
        out[:, 3] = np.isin(at(start - 1), [ord(c) for c in "@/#$."])
        out[:, 4] = (at(start - 3) == 45) & (at(start - 2) == 45) & (at(start - 1) == 32)
        cues = self._read(index, back, inside)[:, :, : len(_CUES)]
        out[:, 5:] = np.where(cues.any(1), 9.0 - cues.argmax(1), 0.0)
        return out

    def _rights(self, text: str, end: np.ndarray) -> np.ndarray:
        """``_right`` of many places."""
        if len(end) < MANY:
            return np.array([self._right(text, e) for e in end.tolist()]).reshape(len(end), 8)
        index = _Index.of(text)
        signs, is_a = np.concatenate([index.codes, [0, 0]]), np.concatenate([index.signs, [0, 0]])
        stops = np.array([*index.stops, len(text)])
        high = stops[np.searchsorted(stops[:-1], end, side="right")]
        ahead = np.searchsorted(index.first, end, side="left")[:, None] + np.arange(3)
        inside = ahead < len(index.first)
        ahead = ahead * inside
        beside = inside[:, 0] & (index.first[ahead[:, 0]] == end + 1) & (signs[end] == 32)
        more = self._read(index, ahead[:, :1], beside[:, None])[:, 0]
        inside &= index.last[ahead] <= high[:, None]
        after = self._read(index, ahead, inside)
        _, firm, common, shun, did, dash = range(len(_CUES), _TOKEN_SIGNS)
        rank = np.cumsum(inside & ~after[:, :, dash], axis=1) * (inside & ~after[:, :, dash])  # of a word among those that count
        capital = more[:, len(_CUES)]
        return np.stack([
            capital, capital & more[:, firm], capital & more[:, common],
            ((is_a[end] & _IS_ALNUM) > 0) | (signs[end] == 64) | (signs[end] == 95), signs[end] == 44,
            after[:, :, shun].any(1), ((rank == 1) & after[:, :, did]).any(1), ((rank > 0) & (rank < 3) & after[:, :, firm]).sum(1),
        ], axis=1).astype(float)

    def know(self, names: Sequence[str]) -> None:
        """Take up names of companies."""
        words = [[w.lower() for w in _TOKEN.findall(n)] for n in names]
        self.companies = frozenset(pair for w in words for pair in zip(w, w[1:]))
        self.company_words = frozenset(w[0] for w in words if w)

    def _company(self, text: str, start: int, end: int) -> list[float]:
        words = [w.lower() for w in _TOKEN.findall(text[start:end])]
        pairs = zip(words, words[1:])
        return [float(any(p in self.companies for p in pairs)), float(words[0] in self.company_words), float(words[-1] in self.company_words)]

    def _context(self, text: str, start: int, end: int) -> list[float]:
        return self._left(text, start) + self._right(text, end) + self._company(text, start, end)

    def _can_be(self, own: list[float]) -> bool:
        """False if the words alone rule a name out. Two steps: trees fitted on the words' own features give less than
        ``LEAST_OWN``; or no context whatever could lift the candidate to the threshold, as the sum of the best leaves that
        the trees can reach stays below it (what is left out so, the trees would have refused)."""
        model = self.models.get("name")
        if model is None:
            return True
        x = np.array(own)
        if "own" in self.models and self.models["own"].one(x) < LEAST_OWN:
            return False
        known = model.features < len(x)
        right = x[np.where(known, model.features, 0)] > model.limits
        fits = np.ones((len(model.leaves), 1), bool)
        for level in range(model.depth):
            at = slice(2**level - 1, 2 ** (level + 1) - 1)
            low, high = fits & (~known[:, at] | ~right[:, at]), fits & (~known[:, at] | right[:, at])
            fits = np.stack([low, high], 2).reshape(len(low), -1)
        top = model.base + np.where(fits, model.leaves, -np.inf).max(1).sum()
        return 1 / (1 + np.exp(-top)) >= self.thresholds["name"] - 1e-9

    def _hits(self, text: str) -> list[int]:
        """Places of street words: one scan for all."""
        import ahocorasick

        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for word in _STREET_WORDS:
                self._automaton.add_word(word, 0)
            self._automaton.make_automaton()
        return [end for end, _ in self._automaton.iter(_lower(text))]

    def _names(self, text: str) -> Iterator[Candidate]:
        nothing = self._word("")
        for m in _TITLED.finditer(text):
            a, b, c = m["a"], m["b"] or "", m["c"] or ""
            if not a[0].isupper() and a.lower() in common_words(self.folder):
                continue
            first, initials = self._word(a), len(re.findall(_L, m["lead"]))
            end = m.end("a")
            yield Candidate("name", m.start(), end, self._own(True, 0.0, nothing, first, (initials, 0, 0, 0, 0)) + self._context(text, m.start(), end))
            if b and (b[0].isupper() or not a[0].isupper()):
                between = re.findall(_PART, m["mid"])
                short = sum(len(w) == 1 for w in between)
                mid = (initials + short, len(between) - short, 0, 0, 0)
                yield Candidate("name", m.start(), m.end("b"), self._own(True, 0.0, first, self._word(b), mid) + self._context(text, m.start(), m.end("b")))
                if c and (c[0].isupper() or not b[0].isupper()):
                    second = self._word(b)
                    mid = (mid[0], mid[1], 1, int(second[1]), int(second[3] == 1.0))
                    yield Candidate("name", m.start(), m.end("c"), self._own(True, 0.0, first, self._word(c), mid) + self._context(text, m.start(), m.end("c")))
        if len(self._possible) > 500_000:
            self._possible.clear()
        yield from self._untitled(text)

    def _untitled(self, text: str) -> Iterator[Candidate]:
        """Every run of words apart by one space, whatever their letters: given name, initials, middle names, particles, family
        name; and every two words around a comma. No list decides, only the trees; runs that they can't accept are skipped."""
        index = _Index.of(text)
        first, last = _parts(index.signs)
        if len(first) < 2:
            return
        parts = [text[a:b] for a, b in zip(first.tolist(), last.tolist())]
        codes, different = pd.factorize(np.array(parts, object))
        forms = self._forms
        numbers = np.empty(len(different), np.int64)
        for n, w in enumerate(different):
            form = self._word(w)
            if form not in forms:
                forms[form] = len(forms)
                self._known.append(form)
            numbers[n] = forms[form]
        kind = numbers[codes]
        known = np.array(self._known, float)
        signs = np.concatenate([[32], index.codes, [32, 32]])
        at = lambda i: signs[i + 1]
        # what may stand before a name and what may not stand after it
        glued = np.isin(at(first - 1), [ord(c) for c in "_@/.$#"]) | _letters(at(first - 1))
        stops = ~(np.isin(at(last), [ord(c) for c in "_@"]) | _letters(at(last)))
        length, particle = known[kind, 4], known[kind, 5] == 1.0
        single = length == 1.0
        gap = np.full(len(parts), 99)
        gap[1:] = first[1:] - last[:-1]
        sign, after = at(np.roll(last, 1)), at(np.roll(last, 1) + 1)
        near = (gap == 1) & (sign == 32) | np.roll(single, 1) & ((gap == 1) & (sign == 46) | (gap == 2) & (sign == 46) & (after == 32))
        name = ~single & ~particle
        counted = np.stack([single, ~single & particle, name, name & (known[kind, 1] == 1.0), name & (known[kind, 3] == 1.0)])
        sums = np.concatenate([np.zeros((5, 1), np.int64), counted.cumsum(1)], axis=1)
        run, found = ~glued, []
        for size in range(1, _MIDDLE + 2):
            number = len(parts) - size
            if number <= 0:
                break
            run = run[:number] & near[size:]
            i = np.flatnonzero(run & (length[size:] > 1.0) & stops[size:])
            mid = sums[:, i + size] - sums[:, i + 1]
            few = mid[2] <= _MIDDLE_NAMES
            i, mid = i[few], mid[:, few]
            keys = ((kind[i] << 20) + kind[i + size]) * 3125 + np.array([1, 5, 25, 125, 625]) @ mid
            different, back = np.unique(keys, return_inverse=True)
            example = np.empty(len(different), np.int64)
            example[back] = np.arange(len(i))
            can = self._possible_runs(different.tolist(), i[example], size, kind, mid[:, example])
            chosen = can[back] if len(i) else np.zeros(0, bool)
            found.append((i[chosen], np.full(int(chosen.sum()), size), mid[:, chosen]))
        words, starts, ends, kinds = self._known, first.tolist(), last.tolist(), kind.tolist()
        if any(len(f[0]) for f in found):
            i, size, mid = (np.concatenate(x, axis=-1) for x in zip(*found))
            order = np.lexsort((size, i))
            i, size, mid = i[order], size[order], mid[:, order]
            some, stop = kind[i], kind[i + size]
            own = np.concatenate([np.zeros((len(i), 2)), known[some, :5], known[stop, :5], mid.T], axis=1)
            starting, left = np.unique(i, return_inverse=True)
            ending, right = np.unique(i + size, return_inverse=True)
            context = np.concatenate([self._lefts(text, first[starting])[left], self._rights(text, last[ending])[right]], axis=1)
            companies: dict[str, list[float]] = {}  # of runs of the same words
            spans, last_columns = list(zip(first[i].tolist(), last[i + size].tolist())), []
            for start, end in spans:
                run = text[start:end]
                company = companies.get(run)
                if company is None:
                    company = companies[run] = self._company(text, start, end)
                last_columns.append(company)
            x = np.concatenate([own, context, np.array(last_columns).reshape(len(i), 3)], axis=1)
            yield from (Candidate("name", start, end, row) for (start, end), row in zip(spans, x))
        comma = np.flatnonzero(~glued[:-1] & (gap[1:] == 2) & (sign[1:] == 44) & (after[1:] == 32) & ~single[:-1] & stops[1:])
        keys = (kind[comma] * len(words) + kind[comma + 1]).tolist()
        never: dict[int, bool] = {}  # by the words' forms: neither with an initial nor without
        for i, key in zip(comma.tolist(), keys):
            if key not in never:
                never[key] = not any(self._can_be_inverted(words[kinds[i]], words[kinds[i + 1]], initials) for initials in (0, 1))
            if not never[key]:
                yield from self._inverted(text, list(zip(starts[i : i + 3], ends[i : i + 3])), [words[n] for n in kinds[i : i + 3]], stops[i : i + 3].tolist())

    def _possible_runs(self, keys: list[int], i: np.ndarray, size: int, kind: np.ndarray, mid: np.ndarray) -> np.ndarray:
        """``_can_be`` of runs with these keys; new ones are weighed together, and remembered."""
        known, words = self._possible, self._known
        new = [n for n, k in enumerate(keys) if k not in known]
        if new:
            x = np.array([self._own(False, 0.0, words[kind[i[n]]], words[kind[i[n] + size]], mid[:, n].tolist()) for n in new])
            able = self.models["own"].predict(x) >= LEAST_OWN if "name" in self.models else np.ones(len(new), bool)
            for n, row, can in zip(new, x, able.tolist()):
                known[keys[n]] = can and self._can_be(row)
        return np.array([known[k] for k in keys], bool)

    def _can_be_inverted(self, family: tuple, given: tuple, initials: int) -> bool:
        key = (1.0, given, family, (initials, 0, 0, 0, 0))
        can = self._possible.get(key)
        if can is None:
            can = self._possible[key] = self._can_be(self._own(False, 1.0, given, family, key[3]))
        return can

    def _inverted(self, text: str, spans: list, words: list, stops: list) -> Iterator[Candidate]:
        """'Family, Given', with an initial after it or without; of the first two or three of some words."""
        start, end = spans[0][0], spans[1][1]
        family, given = words[0], words[1]
        follows = len(spans) > 2 and spans[2] == (end + 1, end + 2) and text[end] == " " and stops[2] and words[2][3] == 2.0
        for initials, stop in [(0, end), *([(1, end + 2)] if follows else [])]:
            if self._can_be_inverted(family, given, initials):
                yield Candidate("name", start, stop, self._own(False, 1.0, given, family, (initials, 0, 0, 0, 0)) + self._context(text, start, stop))

    def candidates(self, text: str) -> list[Candidate]:
        out = [*_email(text), *_numbers(text), *_address(text, self._hits(text)), *self._names(text)]
        return [c for c in out if _RECORD not in text[c.start : c.end] and "\n" not in text[c.start : c.end]]

    def spans(self, texts: Sequence[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """Chosen spans (start, end, kind, probability) of every text, in order and without overlaps."""
        collecting = gc.isenabled()
        gc.disable()  # many short lists and no cycles
        try:
            return self._spans(texts)
        finally:
            if collecting:
                gc.enable()

    def _spans(self, texts: Sequence[str | None]) -> list[list[tuple[int, int, str, float]]]:
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        clean = [(t or "").replace(_RECORD, " ") for t in texts]
        whole = _RECORD.join(clean)
        starts = np.cumsum([0] + [len(t) + 1 for t in clean])
        found: dict[str, list[Candidate]] = {k: [] for k in KINDS}
        for c in self.candidates(whole):
            found[c.kind].append(c)
        chosen = []
        for kind, some in found.items():
            if some and kind in self.models:
                p = self.models[kind].predict(np.array([c.x for c in some]), self.thresholds[kind])
                chosen += [(float(q), c.end - c.start, c.start, c.end, kind) for c, q in zip(some, p.tolist()) if q >= self.thresholds[kind]]
        # the surest first, of equals (to a tenth) the longest; what overlaps a chosen span leaves
        order = np.searchsorted(starts, [c[2] for c in chosen], side="right") - 1 if chosen else []
        by_text: dict[int, list] = {}
        for t, c in zip(order, chosen):
            by_text.setdefault(int(t), []).append(c)
        for t, own in by_text.items():
            taken: list[tuple[int, int, str, float]] = []  # in order, apart from each other
            for p, _, a, b, kind in sorted(own, key=lambda c: (-round(c[0], 1), -c[1], c[2], c[4])):
                i = bisect_left(taken, (b,))  # all from i on begin at b or later
                if not i or taken[i - 1][1] <= a:
                    taken.insert(i, (a, b, kind, p))
            base = int(starts[t])
            out[t] = [(a - base, b - base, kind, p) for a, b, kind, p in taken]
        return out


def redact(text: str | None, spans: Sequence[tuple[int, int, str, float]]) -> str | None:
    """The text with each span replaced by the placeholder of its kind; everything else is unchanged."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end, kind, _ in spans:
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join(out) + text[at:]


# ---------------------------------------------------------------- training
class _Maker:
    """Sentences with marked personal information, and sentences that only look like it.

    Formats are those of public standards; frames, names and places are invented. Half of all items stand among random
    words of the public vocabulary instead of in a frame, so that the trees can't rely on the frames.
    """

    def __init__(self, seed: int, folder: str = DEFAULT_FOLDER) -> None:
        self.r = random.Random(seed)
        self.first = sorted(_first_names())
        self.common = sorted(common_words(folder))
        self.known = [self.company(new=True) for _ in range(400)]

    #: Function words, which texts are full of (fixed values).
    SHORT = "a i the to of in on is it and for my no at by be or as up so we he do if an am me us go you was not der die und ich le la et je de el y en un".split()

    def word(self) -> str:
        k = self.r.random()
        return self.r.choice(self.SHORT) if k < 0.35 else self.r.choice(self.common) if k < 0.93 else self.syllables(1, 3)

    def words(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(least, most)))

    def among(self, item: str) -> tuple[str, int]:
        """``item`` among random words, and where it begins."""
        left = self.words(1, 5) + self.r.choice([" ", " ", " ", ", ", ": "]) if self.r.random() < 0.8 else ""
        if left and self.r.random() < 0.5:
            left = left[0].upper() + left[1:]
        right = self.r.choice([" ", " ", ", "]) + self.words(1, 5) if self.r.random() < 0.7 else ""
        return left + item + right + self.r.choice([".", ".", "", "!", "?"]), len(left)

    def digits(self, pattern: str) -> str:
        """9 stands for a digit, A for a capital letter."""
        return "".join(str(self.r.randrange(10)) if c == "9" else self.r.choice("ABCDEFGHJKLMNPRSTXYZ") if c == "A" else c for c in pattern)

    def syllables(self, least: int = 2, most: int = 3) -> str:
        parts = ["bra", "kel", "mor", "ost", "tas", "vel", "hal", "den", "ron", "sch", "lin", "mar", "go", "fen", "wick", "ber", "gar", "ta", "rin", "do", "mond", "ski", "sen", "vik", "ez", "ov", "ham", "ton", "stein", "le", "ru", "qui", "by", "dale", "ford", "nek", "ker", "son", "mann", "witz", "elli", "ano"]
        return "".join(self.r.choice(parts) for _ in range(self.r.randint(least, most)))

    def surname(self) -> str:
        s = self.syllables().capitalize()
        return f"{s}-{self.syllables(2, 2).capitalize()}" if self.r.random() < 0.03 else s

    def given(self) -> str:
        return self.r.choice(self.first).capitalize() if self.r.random() > 0.4 else self.syllables(1, self.r.choice([2, 3, 5])).capitalize()

    def city(self) -> str:
        s = self.syllables().capitalize()
        return f"{s} {self.r.choice(['Falls', 'Heath', 'Springs', 'Park', 'Bay'])}" if self.r.random() < 0.25 else s

    def name(self) -> str:
        a, b, k = self.given(), self.surname(), self.r.random()
        m = self.r.random()
        if m < 0.12:
            a = f"{a} {self.r.choice('ABCDEFGHJKLMNPRSTW')}" + self.r.choice([".", ".", ""])
        elif m < 0.16:
            a = f"{a} {self.given()}"
        elif m < 0.19:
            b = f"{self.r.choice(['van', 'von', 'de', 'van der', 'de la', 'del', 'di'])} {b}"
        elif m < 0.21:
            a = f"{self.r.choice('ABCDEFGHJKLMNPRSTW')}."
        if k < 0.5:
            return f"{a} {b}"
        if k < 0.6:
            return f"{a} {b}".upper()
        if k < 0.68:
            return f"{a} {b}".lower()
        if k < 0.76 and m >= 0.21 or k < 0.76 and m < 0.12 and not a.endswith("."):
            return f"{b}, {a}"
        title = self.r.choice(["Mr.", "Mrs.", "Ms", "Dr.", "Mr", "Mrs", "Prof.", "Miss", "Herr", "Frau", "Ms.", "Dr", "Mme"])
        return f"{title} {b}" if k < 0.88 and (m < 0.16 or m >= 0.19) else f"{title} {a} {b}"

    def email(self) -> str:
        a, b = self.given().lower(), self.surname().lower()
        local = self.r.choice([f"{a}.{b}", f"{a}_{self.r.randrange(99)}", f"{a[0]}{b}", f"{b}.{a}-{self.r.randrange(99)}", f"{a}+{b}{self.r.randrange(9)}", b])
        tld = self.r.choice(["com", "org", "net", "example", "test", "co.uk", "de", "io", "edu", "fr"])
        host = self.r.choice(["mail", "inbox", "web", "post", self.syllables(1, 2), f"{self.syllables(1, 1)}-office"])
        domain = f"{host}.{self.syllables(1, 2)}.{tld}" if self.r.random() < 0.3 else f"{host}.{tld}"
        k = self.r.random()
        if k < 0.55:
            out = f"{local}@{domain}"
        elif k < 0.68:
            out = f"{local} @ {domain}"
        elif k < 0.8:
            out = f"{local}[at]{domain}"
        elif k < 0.92:
            out = f"{local} (at) " + domain.replace(".", " dot ")
        else:
            out = f"{local} at " + domain.replace(".", " dot ")
        return out.upper() if self.r.random() < 0.08 else out

    def phone(self) -> str:
        kinds = [
            "+1 999 999 9999", "+1 (999) 999-9999", "+1-999-999-9999", "1-999-999-9999", "(999) 999-9999", "999-999-9999", "999.999.9999", "999 999 9999", "9999999999", "19999999999", "1 999 999 9999", "999 9999",
            "+44 99 9999 9999", "+44 999 999 9999", "+44 9999 999999", "+44 9999 999 999", "099 9999 9999", "0999 999 9999", "09999 999999", "09999999999", "0044 999 999 9999",
            "+49 99 99999999", "+49 999 9999999", "+49 99 999 99999", "099 9999999", "0999/9999999", "099/99999999", "0999 9999999", "099 999999", "+499999999999",
            "+33 9 99 99 99 99", "09 99 99 99 99", "09.99.99.99.99", "+34 999 999 999", "999 99 99 99", "+34 999999999", "+61 999 999 999", "+91 99999 99999", "+234 999 999 9999", "+559999999999", "+41 99 999 99 99",
        ]
        if self.r.random() < 0.1:
            words = _DIGIT.split("|")
            return self.digits("999 999 ") + " ".join(self.r.choice(words) for _ in range(4))
        kind = self.r.choice(kinds)
        if kind[0] == "+" and self.r.random() < 0.4:  # the international prefix as dialled
            kind = "00" + kind[1:]
        return self.digits(kind)

    def identity(self) -> str:
        kinds = [
            "999-99-9999", "999 99 9999", "99-9999999", "AA 99 99 99 A", "AA999999A", "99 999 999 999", "99999999999", "99999999A", "99999999-A", "A9999999A", "A-9999999-A", "A99999999", "AAA999999", "A99A99A99", "A99AA9AA9",
            "9 99 99 99 999 999 99", "AA99 9999 9999 9999 99", "AA99 9999 9999 9999 9999 99", "AA99AAAA99999999999999", "AA99 AAAA 9999 9999 9999 99", "AA99999999999999999999", "AA99 9999 9999 9999", "AA99AAAA9999999999", "AA99 9999 9999 9999 9999 9999",
        ]
        return self.digits(self.r.choice(kinds))

    def address(self) -> str:
        s, c, r = self.syllables().capitalize(), self.city(), self.r
        if r.random() < 0.2:
            s = self.r.choice(["Church", "Station", "Park", "Victoria", "Washington", "Lincoln", "Maple", "Cherry", "River", "Highland", "College", "Sunset", "North", "Main", "High"])
        house = lambda: r.randint(1, r.choice([30, 200, 4000]))
        kinds = [
            lambda: f"{house()} {s} {r.choice(['Street', 'Avenue', 'Road', 'Lane', 'St.', 'Ave.', 'Drive', 'Rd.', 'Court', 'Boulevard', 'Place', 'Way', 'Terrace', 'Blvd', 'Parkway', 'Circle'])}, {c}",
            lambda: f"{house()} {s} {r.choice(['Avenue', 'Street', 'Road', 'Drive'])}, {r.choice(['Apt', 'Unit', 'Suite', 'Flat'])} {r.randint(1, 40)}{r.choice(['', 'A', 'B', 'C'])}, {c}",
            lambda: f"{house()}{r.choice(['', '', 'a', 'b'])} {s} {r.choice(['Lane', 'Road', 'Close', 'Crescent', 'Gardens', 'Hill', 'Grove', 'Mews', 'Square'])}, {c} " + self.digits(r.choice(["AA9 9AA", "A99 9AA", "AA99 9AA"])),
            lambda: f"{house()} {s} {r.choice(['Street', 'Avenue', 'Road'])}, {c} " + self.digits(r.choice(["99999", "AA 99999"])),
            lambda: f"{r.choice(['P.O. Box', 'PO Box', 'P O Box', 'Post Office Box', 'Postfach', 'Apartado'])} {r.randint(10, 9999)}, {c}",
            lambda: f"{r.choice(['Calle', 'Avenida', 'Plaza', 'Paseo'])} {s} {r.randint(1, 99)}, {c}",
            lambda: f"{r.choice(['Calle', 'Avenida'])} {s} {r.randint(1, 99)}, {r.randint(1, 9)}º {r.choice('ABC')}, {c}",
            lambda: f"{s}{r.choice(['straße', 'weg', 'platz', 'gasse', 'allee', 'str.', 'ring', 'ufer'])} {r.randint(1, 140)}, " + self.digits(r.choice(["99999 ", ""])) + c,
            lambda: f"{house()}{r.choice(['', ' bis'])} {r.choice(['rue', 'avenue', 'boulevard', 'place', 'chemin', 'quai'])} {r.choice(['', 'de ', 'du '])}{s}, " + self.digits("99999 ") + c,
            lambda: f"{house()} {s} {r.choice(['road', 'street', 'lane', 'avenue', 'drive'])}{r.choice([',', ''])} {c}".lower(),
        ]
        return r.choice(kinds)()

    def company(self, new: bool = False) -> str:
        if not new and self.r.random() < 0.6:
            name = self.r.choice(self.known).split()
            return " ".join(name[:2] if len(name) > 2 and self.r.random() < 0.5 else name)
        s, k = self.syllables().capitalize(), self.r.random()
        tail = self.r.choice(["Systems", "Holdings", "Power", "Motors", "Stores", "Bancorp", "Trust", "Therapeutics", "Group", "Minerals", "Energy", "Partners", "Industries", "Capital", "Foods", "Media", "Technologies", "Airlines", "Steel", "Pharma", "Software", "Financial", "Resources", "Labs", "Brands"])
        if k < 0.35:
            return f"{s} {tail}"
        if k < 0.7:
            return f"{s} {self.r.choice(self.common).capitalize()} {tail}"
        if k < 0.85:
            return f"{s} {self.r.choice(self.common).capitalize()}"
        return f"{s} {self.syllables(1, 2).capitalize()} {tail}"

    FRAMES = {
        "email": ["You can get hold of me via {}.", "Forms have to be returned to {} before the deadline.", "questions? {}", "he uses {} for everything", "unsubscribe by writing to {}", "E-mail: {}", "sent from {}", "The newsletter is run by {} these days.", "copy {} on the reply", "my other account is {}", "support answered from {} after a week", "Kontakt: {}", "contacto: {}", "mon courriel est {}"],
        "phone": ["You may telephone {} on weekdays.", "mobile {}", "Fax: {}", "Our new number: {}", "leave a message on {}", "customer service, {}, keeps you waiting", "he texted from {}", "if urgent, {}", "T: {}", "the line {} is always busy", "they phoned from {} twice", "Telefon {}", "Tel. {}", "tél. {}", "teléfono {}", "handy {}", "my cell is {}"],
        "id_number": ["Social security number: {}", "tax ID {}", "Her passport number is {}.", "Passport {} was stolen.", "transfer the rent to {}", "IBAN: {}", "the form asks for {}", "they verified me with {}", "my national insurance number, {}, was wrong on the payslip", "licence {} expired", "He typed {} into the identity check.", "account number {}", "Steuernummer {}", "Kontonummer {}", "numéro fiscal {}", "mi DNI es {}", "cuenta bancaria {}", "identity card {}"],
        "address": ["Home: {}", "We moved to {} in spring.", "invoices should be posted to {}", "The parcel went to {} by mistake.", "Her brother rents at {}.", "deliver to {}", "come to {} after work", "the house at {} is empty", "Registered office: {}", "{} was on the envelope", "he owns {}", "Anschrift: {}", "adresse : {}", "dirección: {}", "born and raised at {}"],
        "name": ["I am {} and I approve.", "This was written by {}.", "{} called me yesterday about the refund.", "{} told everybody.", "{} resigned.", "Please speak with {} first.", "Yours faithfully, {}", "-- {}", "Best wishes -- {}", "that is all for today -- {}", "you can ask {} for the key", "Kind regards\\n{}", "my sister {} works there", "our neighbour {} sold the house", "The manager, {}, apologised.", "Dear {},", "{} lives next door.", "{} and I went there together.", "a certain {} complained", "met {} in person", "hello {}, how are you", "Hi, I'm {}.", "the nurse {} was kind", "according to {}, nothing happened", "{} has been my broker for years", "the email was from {}", "signed, {}", "Gruß, {}", "Cordialement, {}", "Saludos, {}", "ich heiße {}", "je m'appelle {}", "me llamo {}", "congratulations to {}", "{} owes me money", "say hello to {} from me", "{}, a teacher, won the prize", "thanks to {} for the help", "i know {} from work", "her lawyer is {}", "{} bought the flat"],
    }

    def ordinary(self) -> str:
        r, d = self.r, self.digits
        t = d("AAAA")
        numbers = [
            "999,999", "9,999,999", "$999.99", "99.99", "9999", "99%", "999/999", "99-99-2023", "2024-99-99", "99/99/2023", "9999999999-99-999999", "AA9999999999", "9.99.9", "9.9.99.9", "999.999.99.9", "10.9.99.99", "99999A999", "9999-999999", "AA999999999AA",
            "99999999", "9999999", "999999", "#9999-99-9999", "9999-9999-99", "99999999-9999", "9.999.999", "99:99", "99.9999, 99.9999", "9:9:9", "1999", "Q9 2023", "9A9A-99A9-99", "999-9999-9", "99-9999-A", "9999x9999", "99-cv-99999", "AA 999",
        ]
        kinds = [
            lambda: self.among(d(r.choice(numbers)))[0],
            lambda: self.among(d(r.choice(numbers)))[0],
            lambda: f"{r.choice(['Order', 'Invoice', 'Ticket', 'Reference', 'Case', 'Flight', 'Filing', 'Docket', 'Serial', 'SKU', 'Contract', 'Tracking', 'Ref.', 'ISIN', 'CUSIP', 'Model', 'Release', 'Build', 'Page', 'IP', 'Port'])} {r.choice(['', '', 'no. ', 'number ', '#', 'id '])}{d(r.choice(numbers))} {self.words(1, 4)}.",
            lambda: f"{self.words(1, 3).capitalize()} {r.choice(['volume', 'shares', 'units', 'sales', 'revenue', 'strike', 'price', 'target', 'support'])} {d(r.choice(numbers))} {self.words(1, 3)}.",
            lambda: f"{d('999')} {r.choice(['call', 'put', 'strike', 'lots', 'shares', 'contracts'])}, {d('99')} {self.words(1, 3)}",
            lambda: f"{r.choice(['bid', 'ask', 'in', 'out', 'stop', 'sold', 'long'])}@{d('99.99')}",
            lambda: f"https://{self.syllables()}.example/{self.syllables()}/{d('99999999')}",
            lambda: self.among(self.company())[0],
            lambda: self.among(self.company())[0],
            lambda: self.among(self.company())[0],
            lambda: f"{self.company()} {self.words(2, 6)}.",
            lambda: f"{self.company()} {self.words(2, 6)}.",
            lambda: f"{self.words(1, 4).capitalize()} {self.company()} {r.choice(['fell', 'rose', 'reports', 'earnings', 'shares', 'stock', 'missed', 'beat', 'is cheap', 'at', 'under', 'above'])} {self.words(0, 3)}",
            lambda: f"{r.choice(['Long', 'Short', 'Bought', 'Sold', 'Holding', 'Watching', 'Avoid', 'Hedging'])} {self.company()}, {self.syllables().capitalize()} and {self.company()}.",
            lambda: f"{self.company().upper()} {self.words(1, 3).upper()}",
            lambda: f"{self.words(1, 3)} {self.company().lower()} {self.words(1, 3)}",
            lambda: f"{r.choice(['Thanks', 'Hi', 'Hello', 'Sorry', 'Welcome', 'Dear', 'Ask', 'Regards,', 'Cheers,'])} {self.given()}{r.choice(['.', ',', ' ' + r.choice('ABCDEFG') + '.'])} {self.words(1, 4)}",
            lambda: f"{self.given()} {self.words(2, 5)}.",
            lambda: f"{self.words(1, 3)} {self.given()} {self.words(1, 3)}.",
            lambda: f"{r.choice(['Main Street', 'Wall Street', 'Fleet Street', 'Downing Street', 'High Street', 'Park Avenue', 'Sunset Boulevard'])} {self.words(1, 4)}.",
            lambda: f"{self.words(1, 3).capitalize()} {r.choice(['street', 'road', 'lane', 'court', 'way', 'drive', 'close', 'square', 'place'])} {self.words(1, 3)} {d('99')} {self.words(0, 2)}.",
            lambda: f"{d('99')} {self.words(1, 2)} {r.choice(['in court', 'on the road', 'on the way', 'by the close', 'a place', 'in the lane'])}.",
            lambda: f"the {r.choice(['road', 'way', 'street', 'close'])} {self.words(1, 2)} ${d('999')}",
            lambda: f"{self.city()} {self.words(2, 5)}.",
            lambda: f"{self.city()} and {self.city()} {self.words(1, 4)}.",
            lambda: f"{r.choice(['New', 'North', 'South', 'West', 'East', 'San', 'Saint', 'Lake', 'Mount', 'Port', 'Fort'])} {self.syllables().capitalize()} {self.words(1, 4)}.",
            lambda: f"{r.choice(['Monday', 'Friday', 'March', 'June', 'Christmas', 'Easter', 'Black Friday', 'Labor Day', 'April', 'May'])} {r.choice(['', self.words(1, 1).capitalize()])} {self.words(1, 3)}.",
            lambda: f"{self.words(1, 1).capitalize()} {self.words(1, 1).capitalize()} {self.words(1, 4)}.",
            lambda: " ".join(w.capitalize() for w in self.words(2, 6).split()),
            lambda: self.words(3, 9).upper(),
            lambda: self.among(r.choice([" ", " ", ", ", " and ", "/"]).join(d(r.choice(["AAA", "AAAA", "AAAAA", "AA"])) for _ in range(r.randint(2, 4))))[0],
            lambda: r.choice(self.FRAMES["name"]).format(r.choice([" ", " ", "/", ", "]).join(d(r.choice(["AAA", "AAAA", "AAAAA", "AAAAA", "AA"])) for _ in range(2))),
            lambda: r.choice(self.FRAMES["name"]).format(r.choice(self.known)),
            lambda: r.choice(self.FRAMES["name"]).format(self.given()),
            lambda: r.choice(self.FRAMES["name"]).format(self.words(1, 2)),
            lambda: self.among(r.choice([" ", ", "]).join(self.syllables().upper()[: r.randint(3, 5)] for _ in range(2)))[0],
            lambda: self.words(3, 12) + ".",
            lambda: self.words(3, 12).capitalize() + ".",
            lambda: f"{r.choice(['u/', '@', 'r/', '#'])}{self.syllables()}{r.choice(['', d('99'), '_' + self.syllables(1, 1)])} {self.words(1, 4)}",
            lambda: f"{self.words(1, 4)} {r.choice(['u/', '@', 'r/', '#'])}{self.given().lower()}{self.syllables(1, 2)}",
            lambda: f"{r.choice(['Dr.', 'Mr.', 'Uncle', 'Sir', 'King', 'Saint'])} {self.words(1, 1)} {self.words(1, 3)}.",
            lambda: f"{t} {self.words(1, 4)} ${d('999.99')} {self.words(0, 3)}.",
            lambda: f"{self.words(1, 4).capitalize()} {t}, {d('AAA')} and {self.company()}.",
            lambda: f"{self.syllables().capitalize()}, {self.syllables().capitalize()} and {self.city()} {self.words(1, 3)}.",
            lambda: f"{r.choice(['Die', 'Der', 'Das', 'Eine'])} {self.syllables().capitalize()} {r.choice(['der', 'von', 'und', 'für', 'bei'])} {self.company()} {r.choice(['steigt', 'fällt', 'war gut', 'bleibt'])}.",
            lambda: f"{r.choice(['Las', 'El', 'La', 'Los', 'Le', 'Les', 'Il'])} {self.syllables()} {r.choice(['de', 'del', 'du', 'di'])} {self.company()} {r.choice(['sube', 'monte', 'baja', 'baisse'])}.",
        ]
        return r.choice(kinds)()

    def sample(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A text of one to four sentences with the spans (start, end, kind) of its personal information."""
        text, spans = "", []
        for _ in range(self.r.randint(1, 4)):
            if text:
                text += self.r.choice([" ", " ", "\n"])
            if self.r.random() < 0.5:
                said, k = self.ordinary(), self.r.random()
                text += said.upper() if k < 0.06 else said.lower() if k < 0.16 else said
                continue
            kind = self.r.choice(KINDS)
            value = {"email": self.email, "phone": self.phone, "id_number": self.identity, "address": self.address, "name": self.name}[kind]()
            if self.r.random() < (0.25 if kind == "name" else 0.5):
                said, at = self.among(value)
            else:
                frame = self.r.choice(self.FRAMES[kind])
                said, at = frame.format(value), frame.index("{}")
            spans.append((len(text) + at, len(text) + at + len(value), kind))
            text += said
        return text, spans


def train(folder: str = DEFAULT_FOLDER, size: int = TRAINING, seed: int = 5, companies: Sequence[str] = ()) -> Finder:
    """Boosted trees per kind, fitted on made sentences; thresholds from sentences the trees haven't seen.

    No hand-labelled texts exist for this task, so the labelled sample is made: ``size`` texts from frames, number formats
    and invented names. A candidate is right if it covers a span of its kind almost exactly. ``companies``: names that the finder
    knows as companies; the trees have learned from invented ones what that means.
    """
    finder, maker = Finder(folder), _Maker(seed, folder)
    finder.know(maker.known)
    rows: dict[str, tuple[list, list, list]] = {k: ([], [], []) for k in KINDS}
    samples = [maker.sample() for _ in range(size)]
    starts = np.cumsum([0] + [len(t) + 1 for t, _ in samples])
    for c in finder.candidates(_RECORD.join(t for t, _ in samples)):
        i = int(np.searchsorted(starts, c.start, side="right")) - 1
        start, end, spans = c.start - int(starts[i]), c.end - int(starts[i]), samples[i][1]
        right = any(k == c.kind and abs(a - start) <= 1 and abs(b - end) <= 2 for a, b, k in spans)
        if not right and c.kind == "name":
            # most of a name counts as well: a titled name without its last part, or the other way round
            right = any(k == "name" and a <= start and end <= b and (end - start) >= 0.75 * (b - a) for a, b, k in spans)
        x, y, half = rows[c.kind]
        x.append(c.x)
        y.append(right)
        half.append(i % 2)
    for kind, (x, y, half) in rows.items():
        x, y, half = np.array(x), np.array(y, float), np.array(half, bool)
        used = ~half
        weight = np.ones(len(y))
        if kind == "name":  # wrong runs are many: one in five stands for five
            wrong, some = y == 0, np.arange(len(y)) % 5 == 0
            used, weight = used & (~wrong | some), np.where(wrong, 5.0, 1.0)
        if kind == "name":
            finder.models["own"] = BoostedTrees(trees=80, depth=5, ridge=2.0).fit(x[used][:, :OWN], y[used], weight[used])
        finder.models[kind] = (BoostedTrees(trees=100, depth=4) if kind == "name" else BoostedTrees()).fit(x[used], y[used], weight[used])
        p = finder.models[kind].predict(x[half])
        truth = y[half] > 0.5
        grid = np.linspace(0.2, 0.8, 61)
        quality = np.array([2 * (truth & (p >= g)).sum() / max(1, truth.sum() + (p >= g).sum()) for g in grid])
        best = grid[quality >= quality.max() - 0.004]
        finder.thresholds[kind] = float(best[len(best) // 2])
    finder._possible.clear()  # without models everything was possible
    finder.know(companies)
    return finder


# ---------------------------------------------------------------- tables
@lru_cache(maxsize=2)
def _loaded(model: bytes) -> Finder:
    return pickle.loads(model)


#: Company names read on the driver: a documented bound, a larger table is refused.
MOST_COMPANIES = 500_000


def company_names(universe: DataFrame, column: str = "name") -> list[str]:
    """Company names of a listing (variants apart by ``|``), for ``train``."""
    rows = universe.select(column).where(F.col(column).isNotNull()).limit(MOST_COMPANIES + 1).collect()
    if len(rows) > MOST_COMPANIES:
        raise ValueError(f"more than {MOST_COMPANIES} companies")
    return [v.strip() for r in rows for v in r[0].split("|") if v.strip()]


def find_table(rows: DataFrame, texts: Sequence[str], found: bool = True, redacted: bool = False, finder: Finder | None = None, folder: str = DEFAULT_FOLDER) -> DataFrame:
    """``rows`` with ``kinds`` (array of the kinds in the first of ``texts``) and, if asked for, each of ``texts`` redacted.

    One pass without a shuffle; the models travel with the tasks and fit in 1 MB. Texts of any length are read whole.
    Null stays null, empty stays empty. Columns other than ``texts`` pass through; with ``redacted`` the redacted
    texts take the place of the originals, otherwise the texts are left out. A column named ``kinds`` is replaced.
    """
    model = pickle.dumps(finder or train(folder))
    others = [c for c in rows.columns if c not in texts and not (found and c == "kinds")]
    number = len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(model)
        for batch in batches:
            columns, names = list(batch.columns[number:]), list(others)
            for i, name in enumerate(texts):
                if i and not redacted:
                    break
                values = batch.column(i).to_pylist()
                different = list(dict.fromkeys(values))  # short texts recur
                of = dict(zip(different, own.spans(different)))
                spans = [of[v] for v in values]
                if i == 0 and found:
                    columns.append(pa.array([sorted({s[2] for s in x}) for x in spans], pa.list_(pa.string())))
                    names.append("kinds")
                if redacted:
                    columns.append(pa.array([redact(v, x) for v, x in zip(values, spans)], pa.string()))
                    names.append(name)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    shape = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others]
    shape += ["kinds array<string>"] if found else []
    shape += [f"`{t}` string" for t in texts] if redacted else []
    return rows.select(*texts, *others).mapInArrow(run, ", ".join(shape))


def found_kinds(rows: DataFrame, finder: Finder | None = None) -> DataFrame:
    """(id, kind) of records: every delivered row is searched where it lies, then the newest row of an id counts."""
    kinds = find_table(spread(rows.select("text", "id", "ingested_at")), ["text"], finder=finder)
    newest = latest_records(kinds, "id", "ingested_at", ["kinds"])
    return newest.select("id", F.explode("kinds").alias("kind"))


def redacted_records(rows: DataFrame, finder: Finder | None = None) -> DataFrame:
    """(id, kinds, text, title) of records with placeholders in text and title."""
    newest = latest_records(rows, "id", "ingested_at", ["text", "title"])
    return find_table(newest, ["text", "title"], redacted=True, finder=finder).select("id", "kinds", "text", "title")
