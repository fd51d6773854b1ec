"""Numbers and dates validated, and permuted within their own format by a keyed Feistel network.

A value is permuted until its pseudonym is as valid as it was: on that subset the walk along the cycle
is again a permutation, so that every pseudonym can be inverted, and none of a valid number is invalid.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable
from datetime import date, timedelta

# Check letters of the Spanish identity number, by the number modulo 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
# Country calling codes of one and two digits; all others have three.
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Prefixes of British insurance numbers that are never issued, and letters that stand in none.
NINO_NEVER, NINO_FIRST, NINO_SECOND = frozenset("BG GB KN NK NT TN ZZ".split()), "ABCEGHJKLMNOPRSTWXYZ", "ABCEGHJKLMNPRSTWXYZ"
# Holder types in the fourth letter of an Indian tax number.
PAN_HOLDERS = "ABCFGHJLPTE"
# Month names by number, in English, German, Spanish and French; the first is written.
MONTH_NAMES = [
    "january januar enero janvier jan", "february februar febrero février feb", "march märz marzo mars mar", "april april abril avril apr", "may mai mayo mai may", "june juni junio juin jun",
    "july juli julio juillet jul", "august august agosto août aug", "september september septiembre septembre sep", "october oktober octubre octobre oct", "november november noviembre novembre nov",
    "december dezember diciembre décembre dec",
]
_FIRST_DAY, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def feistel(value: int, size: int, key: bytes, tweak: bytes, rounds: int = 10, decrypt: bool = False) -> int:
    """A keyed permutation of the numbers below size: an unbalanced Feistel network on mixed radices."""
    if size < 2:
        return value
    a = max(1, round(size**0.5))
    while size % a and a > 1:
        a -= 1
    b = size // a
    if a == 1:  # no factors: walk the cycle of the next square
        a = b = round(size**0.5) + 1
        while True:
            value = feistel(value, a * b, key, tweak, rounds, decrypt)
            if value < size:
                return value
    left, right = divmod(value, b)

    def step(i: int, half: int, radix: int) -> int:
        data = tweak + i.to_bytes(1, "big") + size.to_bytes(16, "big") + half.to_bytes(16, "big")
        return int.from_bytes(hmac.digest(key, data, hashlib.sha256)[:12], "big") % radix

    for i in reversed(range(rounds)) if decrypt else range(rounds):
        sign = -1 if decrypt else 1
        if i % 2:
            right = (right + sign * step(i, left, b)) % b
        else:
            left = (left + sign * step(i, right, a)) % a
    return left * b + right


def walked(value: str, turn: Callable[[str], str], alike: Callable[[str], object]) -> str:
    """The next value of the permutation's cycle that is alike."""
    want = alike(value)
    value = turn(value)
    while alike(value) != want:
        value = turn(value)
    return value


def _mod_11_10(digits: str) -> bool:
    product = 10
    for c in digits[:-1]:
        product = (int(c) + product) % 10 or 10
        product = product * 2 % 11
    return (11 - product) % 10 == int(digits[-1])


def _weighted(digits: str, weights: range) -> int:
    rest = sum(int(d) * w for d, w in zip(digits, weights)) * 10 % 11
    return rest % 10


def valid_number(text: str) -> bool:
    """Whether a number of a person's identity passes the test of its kind, told by its shape: check digits or letters, or ranges that are issued.

    Spanish DNI and NIE (letter), US social-security and taxpayer numbers written in groups (ranges),
    British insurance numbers (prefixes), Indian tax numbers (holder type), French NIR (modulo 97),
    German tax numbers (ISO 7064) and Brazilian CPF (two check digits), Australian tax file numbers in
    groups (weights). Numbers without a test of their own, such as passports, and bare nine digits don't pass.
    """
    code = re.sub(r"[\s.-]", "", text).upper()
    if re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", code) and len(code) == 9:
        return code[-1] == DNI_LETTERS[int(code[:-1].translate(str.maketrans("XYZ", "012"))) % 23]
    if re.fullmatch(r"\d{3}([ -])\d\d\1\d{4}", text):
        area, group, serial = code[:3], int(code[3:5]), code[5:]
        if area[0] == "9":
            return group in range(50, 66) or group in range(70, 89) or group in (90, 91, 92) or group >= 94
        return area not in ("000", "666") and group > 0 and serial != "0000"
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", code):
        return code[0] in NINO_FIRST and code[1] in NINO_SECOND and code[:2] not in NINO_NEVER
    if re.fullmatch(r"[A-Z]{5}\d{4}[A-Z]", code):
        return code[3] in PAN_HOLDERS
    if re.fullmatch(r"[12]\d{14}", code):
        return 97 - int(code[:13]) % 97 == int(code[13:])
    if re.fullmatch(r"\d{11}", code):
        if _mod_11_10(code) and code[0] != "0" and 1 < len(set(code[:10])) < 10:
            return True
        return len(set(code)) > 1 and code[9:] == f"{_weighted(code, range(10, 1, -1))}{_weighted(code, range(11, 1, -1))}"
    if re.fullmatch(r"\d{3} \d{3} \d{3}", text):
        return sum(int(d) * w for d, w in zip(code, (1, 4, 3, 7, 5, 8, 6, 9, 10))) % 11 == 0
    return False


def _turned(text: str, places: list[int], key: bytes, tweak: bytes, decrypt: bool) -> str:
    """The text with the digits and letters at the places taken as one number and permuted."""
    radix = [10 if text[i].isdigit() else 26 for i in places]
    value, size = 0, 1
    for i, r in zip(places, radix):
        value, size = value * r + (int(text[i]) if r == 10 else ord(text[i].upper()) - 65), size * r
    value = feistel(value, size, key, tweak, decrypt=decrypt)
    out = list(text)
    for i, r in zip(reversed(places), reversed(radix)):
        value, c = divmod(value, r)
        out[i] = str(c) if r == 10 else chr(c + (65 if text[i].isupper() else 97))
    return "".join(out)


def _standing(text: str) -> bool:
    """Validity whatever the marks: nine digits are tested as those of a social-security number."""
    code = re.sub(r"[\W_]", "", text)
    return valid_number(f"{code[:3]}-{code[3:5]}-{code[5:]}" if re.fullmatch(r"\d{9}", code) else code)


def permuted_number(text: str, key: bytes, decrypt: bool = False) -> str:
    """A number or code with its digits and letters permuted in place; valid numbers become valid ones, others invalid ones."""
    places = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    if not places:
        return text
    # the same number in another notation has the same places filled, so it has the same pseudonym
    tweak = b"number" + "".join("d" if text[i].isdigit() else "a" for i in places).encode()
    return walked(text, lambda t: _turned(t, places, key, tweak, decrypt), _standing)


def national_places(text: str) -> list[int]:
    """Where the digits of a phone's national number stand: behind the country code and the trunk zeros."""
    digits = [i for i, c in enumerate(text) if c.isascii() and c.isdigit()]
    number = "".join(text[i] for i in digits)
    skip = 0
    if text.lstrip().startswith("+") or (number.startswith("00") and not text.lstrip().startswith("(")):
        skip = 0 if "+" in text else 2
        rest = number[skip:]
        skip += next((n for n in (1, 2) if rest[:n] in CALLING_CODES), 3)
    elif len(number) == 11 and number[0] == "1":
        skip = 1
    while skip < len(number) - 1 and number[skip] == "0":
        skip += 1
    return digits[skip:]


def permuted_phone(text: str, key: bytes, decrypt: bool = False) -> str:
    """A phone number with its national part permuted; the country code, trunk zeros and marks stay. All notations of a number give one national part."""
    places = national_places(text)
    alike = lambda t: (national_places(t) == places, re.fullmatch(r"[2-9]\d\d[2-9]\d{6}", "".join(t[i] for i in places)) is not None)
    return walked(text, lambda t: _turned(t, places, key, b"phone" + len(places).to_bytes(2, "big"), decrypt), alike)


_NUMERIC = re.compile(r"(\d{4})-(\d\d)-(\d\d)$|(\d\d?)([./])(\d\d?)\5(\d{4})$")
_MONTH_WORDS = {w: i + 1 for i, line in enumerate(MONTH_NAMES) for w in line.split()}
_WORDY = re.compile(r"(?P<d>\d{1,2})(?P<a>(?:st|nd|rd|th|er|\.)?(?: de)? )(?P<m>[^\W\d_]{3,10})(?P<b>\.?(?: de)? |, )(?P<y>\d{4})$|(?P<m2>[^\W\d_]{3,10})(?P<b2>\.? )(?P<d2>\d{1,2})(?P<a2>(?:st|nd|rd|th)?,? )(?P<y2>\d{4})$")


def read_date(text: str) -> tuple[date, str] | None:
    """A date and the shape it is written in; slashed dates lead with the month only where nothing else is possible."""
    try:
        if m := _NUMERIC.match(text):
            if m[1]:
                return date(int(m[1]), int(m[2]), int(m[3])), "iso"
            one, two, year = int(m[4]), int(m[6]), int(m[7])
            month_first = m[5] == "/" and two > 12
            width = "02" if len(m[4]) == len(m[6]) == 2 else ""
            return date(year, one if month_first else two, two if month_first else one), f"{'m' if month_first else 'd'}{m[5]}{width}"
        if m := _WORDY.match(text):
            word = (m["m"] or m["m2"]).lower()
            return date(int(m["y"] or m["y2"]), _MONTH_WORDS[word], int(m["d"] or m["d2"])), "day" if m["d"] else "month"
    except (ValueError, KeyError):
        pass
    return None


def _written(day: date, shape: str, like: str) -> str:
    if shape == "iso":
        return day.isoformat()
    if shape in ("day", "month"):
        m = _WORDY.match(like)
        word = m["m"] or m["m2"]
        names = [line.split() for line in MONTH_NAMES]
        column = next((line.index(word.lower()) for line in names if word.lower() in line), 0)
        # the same language where it has that many spellings, with the capital of the old name
        name = names[day.month - 1][min(column, len(names[day.month - 1]) - 1)]
        name = name.capitalize() if word[0].isupper() else name
        if shape == "day":
            return f"{day.day}{m['a'] if not re.match('st|nd|rd|th|er', m['a']) else ' '}{name}{m['b']}{day.year}"
        return f"{name}{m['b2']}{day.day}{', ' if ',' in m['a2'] else ' '}{day.year}"
    one, two = (day.month, day.day) if shape[0] == "m" else (day.day, day.month)
    return f"{one:{shape[2:]}}{shape[1]}{two:{shape[2:]}}{shape[1]}{day.year}"


def permuted_date(text: str, key: bytes, decrypt: bool = False) -> str:
    """A date permuted among the days of the years 1900 to 2099, in the shape it is written in; what is no such date stays."""
    known = read_date(text)
    if known is None or not 0 <= (known[0] - _FIRST_DAY).days < _DAYS:
        return text
    day, shape = known
    while True:  # until the date as written reads in the same shape
        day = _FIRST_DAY + timedelta(days=feistel((day - _FIRST_DAY).days, _DAYS, key, b"date", decrypt=decrypt))
        out = _written(day, shape, text)
        if (again := read_date(out)) and again[0] == day and again[1] == shape:
            return out
