"""Personal information in free text: found, listed, and replaced by typed placeholders.

Numbers are validated by the check digits, letters and ranges of their kind: a number that passes counts
wherever it stands, one that does not counts where words announce it. In the text, numbers and dates of
birth are pseudonymised in their own format by a keyed Feistel permutation: digits stay digits, letters
letters, marks stay in place, what was valid is valid again. The national part of a phone number is
permuted, so its notations stay linked. Equal values have equal pseudonyms in all documents, and a
holder of the key can invert every one. Names, addresses and mail addresses get a keyed tag instead.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Set
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweft.llm.pseudonyms import permuted_date, permuted_number, permuted_phone, read_date, valid_number
from jobweft.session import checkpointed, ship

# Given names, as an open list to which the caller can add.
GIVEN_NAMES = """
adam adrian agnes aisha alan albert alejandro alexander ali alice amara amelia amina amir amy ana anders andrea andrew angela anita anna anne antonio arjun astrid
bianca boris brian bruno camila carla carlos carmen caroline catherine chloe chris christian clara claire daniel dario david deepa diana diego dmitri dora edward
elena elias elif elisa emeka emil emily emma eric erik eva fatima felix fernando fiona francesca frank freya gabriel george giulia greta hamza hanna hannah harry
hassan heidi helen henry hiroshi hugo ibrahim igor ines ingrid irene isabel ivan jack jacob james jamal jan jane javier jean jens jessica joan johan john jonas
jorge jose joseph juan julia julian karen karim karl kate katja kenji kevin kofi kwame lars laura lea leila lena leo linda lisa louis lucas lucia lucy luis luka
magnus maja marco marek maria marie mario mark marta martin mary mateo matthew maya mehmet mei michael miguel mina mohammed monica nadia natasha nicole nina noah
noor olga oliver olivia omar oscar owen pablo patricia paul pavel pedro peter philip pierre priya rachel rafael rahul ravi rebecca robert roberto rosa ruth samir
samuel sandra sanjay sara sarah sebastian sergei simon sofia sophie stefan stella susan sven tanja tariq teresa thomas tomas umar ursula vera victor viktor
vincent wei william xavier yara yasmin yuki yusuf zara zoe
""".split()
# Words before a comma that are greetings and closings, not family names.
NOT_FAMILY = set("""
best thanks regards hi hello dear cheers signed sincerely yours kind warm many hey cordialement bonjour merci salut saludos hola gracias atentamente gruß grüße hallo
danke liebe lieber from to cc re the and or with contact name candidate contacto interviewer attn also then so yes no today tomorrow mr mrs ms dr herr frau
""".split())
# Words of roles, departments and organisations, days, months and lettered things, and function words, which stand in no name.
NOT_NAME = NOT_FAMILY | set("""
hiring recruiting recruitment recruiter talent acquisition human resources team teams manager managers management department office support service services customer sales
sir madam all everyone everybody colleague colleagues applicant applicants candidates employer company group inc ltd gmbh llc ag corp corporation limited holding holdings kg
monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december
plan class section annex appendix block option phase level grade type vitamin series schedule exhibit figure table gate terminal unit tier version chapter clause room building
this that these those there here he she we you they it its our their his her my your who what when where which how if as at by in into of on off out up down over under
is are was were be been has have had do does did will would can could may must should not but nor for please then than both each every only just very more most some any
said says wrote writes joined left called asked met sent works worked leads led will asks signed kept
der die das den dem des ein eine einen und oder mit von zu zum zur im am auf für ist sind war hat haben wird werden nicht auch sich wir ihr sie er es bei nach aus über unter als
el los las un una y o con de del para por en es son fue ha han no se su sus que como más al lo
le les une et ou avec du pour par dans sur est sont a ont ne pas ce cette ces qui que il elle nous vous votre notre vos nos au aux
""".split())
# Particles of family names.
NAME_PARTICLES = frozenset("de del la van von der den di da al el bin".split())
# Lines of business and legal forms; words in capitals that end so name a company.
COMPANY_WORDS = frozenset("""
engineering manufacturing robotics construction pharmaceuticals pharma financial finance systems technologies technology software laboratories labs education consulting health healthcare services
energy associates logistics insurance foods hospitality dental media retail solutions partners international industries digital capital ventures bank university hospital school institute foundation
group holding holdings inc ltd llc llp gmbh ag kg plc corp corporation company limited co sarl sas srl spa bv nv
""".split())
# Titles, greetings, closings and labels that a person's name follows.
TITLES = r"(?:[Mm]rs?|MRS?|[Mm]s|MS|[Mm]x|[Mm]iss|[Dd]r|DR|[Pp]rof|[Ff]rau|FRAU|[Hh]errn?|HERRN?|[Ss]ra?|[Ss]eñora?|[Mm]me|[Mm]onsieur|[Mm]adame)\.? "
GREETINGS = r"(?i:dear|hi|hello|hallo|liebe[r]?|bonjour|ch[eè]re?|hola|estimad[oa]|querid[oa]) "
CLOSINGS = r"(?i:regards|best|best wishes|sincerely|truly|faithfully|signed|cheers|thanks|thank you|grüßen|grüße|gruß|cordialement|salutations|saludos?|atentamente),?\s+"
LABELS = r"(?:(?i:from|signed|contact|contact person|interviewer|name|candidate|attn|kontakt|ansprechpartner(?:in)?|contacto|nombre|candidato|nom):\s?|(?m:^)From |(?i:my name is|mein name ist|ich heiße|me llamo|mi nombre es|je m['’]appelle) )"
# Words that make a number before or after them a number of something else.
OTHER_NUMBER = re.compile(r"(?:ticket|order|invoice|isbn|isbn-like|code|version|reference|ref|case|room|extension|floor|article|part|serial|tracking|build|release)(?:[\s-]*(?:code|number|no\.?|nr\.?|id|#))?[\s:#]*$", re.I)
# Words that announce a number of a person's identity.
ID_CUE = re.compile(r"(?:\bids?\b|identi|ausweis|steuer|tax|ssn|social|passport|pasaporte|passeport|reisepass|documento|dni|nie\b|nif\b|pièce|num[eé]ro|número|number|nummer|dossier|record|insurance|checking|enter)(?:[^.;\n]|(?<= [A-Z])\.){0,45}$", re.I)
# Words that announce a date of birth.
BIRTH = r"(?i:born(?: on)?|date of birth|birth ?date|birthday|d\.?o\.?b\.?|geboren(?: am)?|geb\.(?: am)?|geburtsdatum|fecha de nacimiento|nacid[oa](?: el)?|n[ée]e?(?: le)|date de naissance)"
# Kinds of streets, English, German, Spanish and French.
ENGLISH_STREETS = "street|str|st|road|rd|avenue|ave|lane|ln|drive|dr|close|cl|court|ct|boulevard|blvd|place|pl|way|terrace|terr|square|sq|crescent|cres|highway|hwy|parkway|pkwy|circle|cir|row|walk|mews|gardens|grove|hill"
GERMAN_STREETS = "straße|strasse|str\\.|gasse|weg|allee|platz|ring|damm|ufer|chaussee"
SPANISH_STREETS = "calle|c/|avenida|avda\\.?|av\\.|paseo|plaza|camino|ronda|travesía"
FRENCH_STREETS = "rue|avenue|av\\.|boulevard|bd|blvd|impasse|allée|allee|place|chemin|quai|route|cours|square|passage"
_UP, _LOW = "A-ZÀ-ÖØ-ÞŁŚŻČŠŽ", "a-zà-öø-ÿłśżčšžß"
_L = _UP + _LOW

_AT = r"(?:\s?[(\[{<]\s?(?:at|a|arroba)\s?[)\]}>]\s?|\s(?:AT|ARROBA)\s|\s(?:at|arroba)\s(?=[\w-]+(?:\s(?:dot|punto)\s|\s?[(\[{<]\s?dot)))"
_DOT = r"(?:\.|\s?[(\[{<]\s?(?:dot|punto|punkt|point)\s?[)\]}>]\s?|\s(?:DOT|PUNTO|dot|punto)\s)"
EMAIL = re.compile(
    rf"(?<![\w.+%-])[\w](?:[\w.+%-]*[\w+-])?@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[{_L}]{{2,24}}(?![\w-])"
    rf"|(?<![\w.+%-])[\w](?:[\w.+%-]*[\w])?(?:\s?[(\[{{]\s?dot\s?[)\]}}]\s?[\w+-]+|\sDOT\s[\w+-]+)*{_AT}[^\W_](?:[\w-]*[^\W_])?(?:{_DOT}[^\W_](?:[\w-]*[^\W_])?)*{_DOT}[{_L}]{{2,24}}(?![\w-])"
)
_DIGIT = re.compile(r"\d")
_ANY_AT = re.compile(rf"@|{_AT}")  # every address has one
PHONE = re.compile(
    r"(?<![\w+.,/-])(?:"
    r"\+\d{1,3}(?:[ .-]?\(0\))?(?:[ .-]?\(?\d{1,5}\)?){1,6}"
    r"|00\d{1,3}(?:[ .-]\d{1,5}){2,6}"
    r"|\([2-9]\d\d\) ?\d{3}[ .-]\d{4}"
    r"|(?:1[ .-])?[2-9]\d\d[ .-]\d{3}[ .-]\d{4}"
    r"|\(0\d{1,5}\) ?\d{2,8}(?:[ -]\d{2,6}){0,3}"
    r"|0[1-9]\d{0,4}/ ?\d{3,9}(?:[ -]\d{1,5}){0,2}"
    r"|0[1-9]\d{1,4} \d{3,8}(?: \d{2,5}){0,3}"
    r"|0[1-9](?:[ .]\d\d){4}"
    r"|[2-9]\d\d-\d{4}"
    r")(?![\w/-]*\d)(?![\w@])"
)
ID_NUMBER = re.compile(
    r"(?<![\w.,/+-])(?:"
    r"(?P<nino>[A-Za-z]{2} ?\d\d ?\d\d ?\d\d ?[A-Da-d])"
    r"|(?P<pan>[A-Z]{5}\d{4}[A-Z])"
    r"|(?P<dni>\d{8}-?[A-Z])"
    r"|(?P<nie>[XYZ]-?\d{7}-?[A-Z])"
    r"|(?P<passport>[A-Z]{1,2}\d{7,8})"
    r"|(?P<ssn>\d{3}([ -])\d\d\7\d{4})"
    r"|(?P<plain>\d{9}|\d{11}|\d{2} \d{3} \d{3} \d{3}|[12] \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?|\d{3}\.\d{3}\.\d{3}-\d\d)"
    r")(?![\w-])(?![.,]\d)"
)
_STREET_WORD = rf"[{_UP}][{_LOW}'’]+(?:-[{_UP}][{_LOW}]+)?"
ADDRESS = re.compile(
    rf"(?<![\w.,/-])(?:"
    rf"\d{{1,5}}[{_L}]?,? (?:(?:[NSEW]|[NS][EW]|North|South|East|West)\.? )?(?:{_STREET_WORD} ){{1,3}}(?i:{ENGLISH_STREETS})"
    rf"|\d{{1,5}}[A-Z]?,? (?:[NSEW] )?(?:[{_UP}]{{2,}} ){{1,3}}(?:{ENGLISH_STREETS.upper()})"
    rf"|\d{{1,5}}[a-z]?,? (?:[nsew] )?[{_LOW}]{{3,}} (?:{ENGLISH_STREETS})(?=\s*(?:[.,;:)]|$|\n|and\b|confirmed\b|--))"
    rf"|[{_UP}][{_L}-]*?(?i:{GERMAN_STREETS}) ?\d{{1,4}} ?[a-z]?"
    rf"|[{_LOW}]{{3,}}(?:straße|strasse|gasse|allee) \d{{1,4}} ?[a-z]?"
    rf"|[{_UP}]{{3,}}(?:STRASSE|STRAßE|GASSE|ALLEE) \d{{1,4}} ?[A-Za-z]?"
    rf"|(?i:{SPANISH_STREETS}) ?(?:[Dd]e(?: [Ll]a| [Ll]os| [Ll]as|l)? )?[{_L}][{_L}'’-]*(?: {_STREET_WORD}){{0,2}},? (?:[Nn][º°.]? ?)?\d{{1,4}} ?[A-Za-z]?"
    rf"|\d{{1,4}}(?: ?(?:bis|ter|[A-Za-z]))?,? (?i:{FRENCH_STREETS}) (?:(?i:de la|de l['’]|des|du|de|d['’]) ?)?[{_L}][{_L}'’-]*(?:(?: |-){_STREET_WORD}){{0,2}}"
    rf")(?![\w])"
)
_WORDS = re.compile(rf"[{_L}'’]+(?:-[{_L}'’]+)*")
_LOW_WORDS = re.compile(rf"(?<![\w@.+'’-])[{_LOW}'’]+(?![\w@+'’-])")  # not those of mail addresses

_CAPITAL, _INITIALS, _PARTICLES = rf"[{_UP}][{_L}'’]+(?:-[{_UP}][{_L}'’]+)?", rf"(?: [{_UP}]\.)+", r"(?:(?:de|del|la|van|von|der|den|di|da|al|el|bin) ){0,2}"
_FULL = rf"{_CAPITAL}(?: [{_UP}]\.| {_CAPITAL}){{0,3}} {_PARTICLES}{_CAPITAL}"
_END = rf"(?![\w@'’-]| [{_UP}])"
_CLOSED = r"(?=\s*(?:[,;:.!?)(<\n–—]|$))"
#: Behind the first word of a name: initials, particles and a family name, or a comma and the given name.
_NEXT = re.compile(rf"(?P<initials>(?: [{_UP}]\.)*) (?P<family>{_PARTICLES}{_CAPITAL})(?![\w@])")
_TURNED = re.compile(rf", (?P<given>{_CAPITAL})(?P<initials>(?: [{_UP}]\.)*)(?![\w@-]| (?:[{_UP}]\. )*[{_UP}][{_L}]+)")
_LOWER = re.compile(rf"(?P<initials>(?: [{_LOW}]\.)*) (?P<family>{_PARTICLES}[{_LOW}'’]{{2,}}(?:-[{_LOW}'’]{{2,}})?)(?![\w@'’-])")
_FULL_NAME, _FULL_TURNED = re.compile(_FULL + _END), re.compile(rf"{_CAPITAL}, {_CAPITAL}(?: [{_UP}]\.)*{_END}{_CLOSED}")
_AT_END = re.compile(_CLOSED)
_MORE = re.compile(rf"(?: (?:& )?[{_UP}][{_L}'’&-]+)+")
#: What stands right before a name whose place tells it, by kind, and right after.
_CUES = {k: re.compile(rf"(?<![\w@.+-])(?:{p})$") for k, p in (("titled", TITLES), ("greeted", GREETINGS), ("closing", CLOSINGS), ("labelled", LABELS))}
#: Every cue ends in one of these words.
_CUE_WORDS = frozenset("""
mr mrs ms mx miss dr prof frau herr herrn sr sra señor señora mme monsieur madame dear hi hello hallo liebe lieber bonjour chère cher chere hola estimado estimada querido querida
regards best wishes sincerely truly faithfully signed cheers thanks you grüßen grüße gruß cordialement salutations saludo saludos atentamente
from contact person interviewer name candidate attn kontakt ansprechpartner ansprechpartnerin contacto nombre candidato nom is ist heiße llamo es m'appelle m’appelle
""".split())
# Words that join names, and verbs that only persons are said to do.
_JOINING = frozenset("and or und oder y e o et ou with mit con avec".split())
_JOINED = re.compile(r",? (?:(?:and|or|und|oder|y|e|o|et|ou|with|mit|con|avec) )?$|\s?/\s?$")
_SPEAKS = re.compile(r" (?:wrote|said|says|told|replied|emailed|phoned|schrieb|sagte|escribió|dijo|a écrit|a dit)\b")
_NEXT_NUMBER = re.compile(r",? (?:and )?$")
SENDER = re.compile(r"\s?[<(\[]\s?[\w.+%-]+(?:@|\s?[(\[]\s?at)")
_MAIL_PARTS = re.compile(rf"([{_L}]{{2,}})[._-](?:[{_L}][._-])?([{_L}]{{2,}})[\d._-]*$")
_BORN = re.compile(rf"(?<!\w){BIRTH}(?:\s*(?:is|:|=|-|–|\())?\s*(?P<date>\d{{4}}-\d\d-\d\d|\d\d?[./]\d\d?[./]\d{{4}}|\d{{1,2}}(?:st|nd|rd|th|er|\.)?(?: de)? [^\W\d_]{{3,10}}(?:\.?(?: de)? |, )\d{{4}}|[^\W\d_]{{3,10}}\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}})(?!\d)")


def plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    kind: str
    text: str


@dataclass(frozen=True)
class Candidate:
    """A place where a name may stand: ``words`` in the order written, ``kind`` how it was found, ``sure`` where its place alone tells it."""

    start: int
    end: int
    kind: str
    words: tuple[str, ...]
    sure: bool = False


class Finder:
    """Finds all personal information of one text; words of ``given`` are given names."""

    def __init__(self, given: frozenset[str]):
        self.given = given

    def find(self, text: str, common: Set[str] = frozenset(), dates: bool = False) -> list[Found]:
        """Everything found, in order; words of ``common`` are ordinary ones in these texts. Dates of birth are found only if asked for."""
        found: list[Found] = []
        taken: list[tuple[int, int]] = []

        def add(start: int, end: int, kind: str) -> None:
            if all(end <= a or start >= b for a, b in taken):
                taken.append((start, end))
                found.append(Found(start, end, kind, text[start:end]))

        if _ANY_AT.search(text):
            for m in EMAIL.finditer(text):
                add(m.start(), m.end(), "email")
        if _DIGIT.search(text):
            if dates:
                for m in _BORN.finditer(text):
                    if read_date(m["date"]):
                        add(*m.span("date"), "date_of_birth")
            last = 0
            for m in ID_NUMBER.finditer(text):
                # the next number of a list is what the one before it was
                if self._is_id(text, m) or last and _NEXT_NUMBER.match(text[last : m.start()]):
                    add(m.start(), m.end(), "id_number")
                    last = m.end()
            for m in PHONE.finditer(text):
                digits = sum(c.isdigit() for c in m[0])
                if 7 <= digits <= 15 and not OTHER_NUMBER.search(text[max(0, m.start() - 30) : m.start()]):
                    add(m.start(), m.end(), "phone")
            for m in ADDRESS.finditer(text):
                add(m.start(), m.end(), "address")
        candidates = self.candidates(text)
        end = 0
        for c in candidates:  # a given name of the list first, the earlier of two that overlap
            if c.kind in ("given", "turned", "lower") and c.start >= end and not self._ordinary(c, common):
                add(c.start, c.end, "name")
                end = c.end
        for c in candidates:
            if c.kind in ("placed", "placed_turned") and not self._ordinary(c, common):
                add(c.start, c.end, "name")
        for start, end in self._of_mail(text, [f.text for f in found if f.kind == "email"]):
            add(start, end, "name")
        pairs = [c for c in candidates if c.kind == "pair"]
        if pairs:
            ends, starts = {f.end for f in found if f.kind == "name"}, {f.start for f in found if f.kind == "name"}
            for c in pairs + pairs[::-1]:  # names joined to a name, from either end of their row
                if not any(w in common or w in NOT_NAME for w in c.words) and (self._joined(text, c.start, ends) or self._follows(text, c.end, starts)):
                    add(c.start, c.end, "name")
                    ends.add(c.end)
                    starts.add(c.start)
        for name in {f.text for f in found if f.kind == "name" and f.start in {c.start for c in candidates if c.kind in ("placed", "pair")}}:
            at = text.find(name)  # what was a name at one place of the text is one at all others
            while at >= 0:
                if not text[at - 1 : at].isalnum() and not text[at + len(name) : at + len(name) + 1].isalnum() and not self._company(text, at + len(name), ""):
                    add(at, at + len(name), "name")
                at = text.find(name, at + 1)
        return sorted(found, key=lambda f: f.start)

    @staticmethod
    def _joined(text: str, start: int, ends: set[int]) -> bool:
        """Whether a name ends right before, but for a comma or a word that joins."""
        m = _JOINED.search(text[max(0, start - 8) : start])
        return bool(m) and start - len(m[0]) in ends

    @staticmethod
    def _follows(text: str, end: int, starts: set[int]) -> bool:
        """Whether a name begins right behind, but for a comma or a word that joins."""
        return any(s in starts for s in range(end + 1, end + 9)) and any(s in starts and _JOINED.fullmatch(text[end:s]) for s in range(end + 1, end + 9))

    @staticmethod
    def _ordinary(c: Candidate, common: Set[str]) -> bool:
        """Whether a candidate's words are ordinary ones in these texts and its place doesn't tell it."""
        if c.sure:
            return False
        said = [w for w in c.words if w not in NAME_PARTICLES]
        if c.kind == "lower":
            return said[-1] in common
        if c.kind == "placed_turned":
            return said[1] in common
        if c.kind == "placed":
            return all(w in common for w in said) or len(c.words) > len(said) and said[0] in common
        return all(w in common or w in NOT_NAME for w in said)

    def candidates(self, text: str) -> list[Candidate]:
        """All places where a name may stand, each with what tells it; one pass over the words of the text."""
        out: list[Candidate] = []
        last, last_end, given = "", 0, self.given
        for m in _WORDS.finditer(text):
            word, start, end = m[0], m.start(), m.end()
            low = word.lower()
            if word[0].isupper():
                after = text[end : end + 1]
                if (after == " " or after == ",") and len(word) > 1 and not (start and (text[start - 1] in "@.+-'’" or text[start - 1].isalnum() or text[start - 1] == "_")):
                    self._capital(text, start, end, low, after, last, last_end, out)
            elif (low in given or "-" in low and low.split("-")[0] in given) and text[end : end + 1] == " " and not (start and (text[start - 1] in "@.+-'’_" or text[start - 1].isalnum())):
                if word == low and (n := _LOWER.match(text, end)):
                    family = [w for w in _WORDS.findall(n["family"]) if w not in NAME_PARTICLES]
                    if family and NOT_NAME.isdisjoint(family):
                        sure = bool(n["initials"] or self._cue(text, start, last) or SENDER.match(text, n.end()))
                        out.append(Candidate(start, n.end(), "lower", (low, *family), sure))
            last, last_end = low, end
        return out

    @staticmethod
    def _cue(text: str, start: int, last: str) -> str | None:
        """The kind of the cue that ends where a name starts."""
        if last not in _CUE_WORDS:
            return None
        before = text[max(0, start - 60) : start]
        return next((k for k, p in _CUES.items() if p.search(before)), None)

    def _capital(self, text: str, start: int, end: int, low: str, after: str, last: str, last_end: int, out: list[Candidate]) -> None:
        parts = low.split("-")
        listed = parts[0] in self.given and (len(parts) == 1 or parts[1] in self.given)
        cue = self._cue(text, start, last) if start - last_end < 8 else None
        if after == ",":
            if t := _TURNED.match(text, end):
                given = t["given"].lower()
                if given.split("-")[0] in self.given and low not in NOT_FAMILY and low not in self.given and len(low) > 2:
                    out.append(Candidate(start, t.end(), "turned", (low, given), sure=True))
                    return
                if t["initials"] and NOT_NAME.isdisjoint((low, given)):
                    out.append(Candidate(start, t.end(), "placed_turned", (low, given)))
            if cue == "labelled" and (t := _FULL_TURNED.match(text, start)):
                said = tuple(w.lower() for w in _WORDS.findall(t[0]) if len(w) > 1)
                if NOT_NAME.isdisjoint(said):
                    out.append(Candidate(start, t.end(), "placed_turned", said))
            return
        n = _NEXT.match(text, end)
        if n is None:
            return
        if listed:
            family = n["family"].split()[-1].lower()
            stop = n.end()
            if family in self.given and not n["initials"] and (more := _NEXT.match(text, stop)):  # two given names
                family, stop = more["family"].split()[-1].lower(), more.end()
            if len(family) > 2 and family not in NOT_FAMILY and not self._company(text, stop, family):
                # a given name that is an ordinary word too needs a family name that is none
                out.append(Candidate(start, stop, "given", (low, family), sure=bool(n["initials"] or cue)))
        elif not cue and not n["initials"] and (last in _JOINING or text[start - 2 : start] in (", ", "/ ") or text[n.end() : n.end() + 1] in (",", "/", " ")):
            # two words in capitals beside another name, or that say something
            full = _FULL_NAME.match(text, start)
            if full and full.end() == n.end() and not self._company(text, n.end(), n["family"].split()[-1].lower()):
                words = (low, n["family"].split()[-1].lower())
                if _SPEAKS.match(text, n.end()) and NOT_NAME.isdisjoint(words):
                    out.append(Candidate(start, n.end(), "placed", words))
                elif NOT_NAME.isdisjoint(words):
                    out.append(Candidate(start, n.end(), "pair", words))
        if cue or n["initials"]:
            # a title, greeting or label may itself be taken for the first word: then its own candidate fails by NOT_NAME
            full = _FULL_NAME.match(text, start)
            if full and (cue in ("titled", "labelled") or cue and _AT_END.match(text, full.end()) or n["initials"] and not _MORE.match(text, full.end())):
                words = [w.lower() for w in _WORDS.findall(full[0]) if len(w) > 1]
                if NOT_NAME.isdisjoint(w for w in words if w not in NAME_PARTICLES) and not self._company(text, full.end(), words[-1]):
                    # an initial between two words tells a name unless the first is an ordinary word; the particle marks such candidates
                    out.append(Candidate(start, full.end(), "placed", tuple(words) if cue else (*words, "de"), sure=cue == "titled"))

    @staticmethod
    def _company(text: str, end: int, family: str) -> bool:
        """Whether the words in capitals that go on behind a name, or its last word, make it the name of a company."""
        more = _MORE.match(text, end)
        return family in COMPANY_WORDS or more is not None and not COMPANY_WORDS.isdisjoint(w.lower() for w in _WORDS.findall(more[0]))

    @staticmethod
    def _of_mail(text: str, addresses: list[str]) -> Iterator[tuple[int, int]]:
        """Places of the two words that a mail address joins, in either order."""
        for address in dict.fromkeys(addresses):
            parts = _MAIL_PARTS.match(re.split(rf"@|{_AT}", address)[0].strip())
            if not parts or not NOT_NAME.isdisjoint((parts[1].lower(), parts[2].lower())):
                continue
            a, b = plain(parts[1]), plain(parts[2])
            for m in re.finditer(rf"(?<![\w@.+-])(?=([{_L}'’]+)(,?)(?: [{_L}]\.)* ([{_L}'’]+)((?: [{_UP}]\.)*)(?![\w@-]))", text):
                if (x := plain(m[1])) in (a, b) and {x, plain(m[3])} == {a, b} and a != b:
                    yield m.start(), m.end(4) if m[2] else m.end(3)

    def words_at_names(self, text: str) -> tuple[list[str], list[str]]:
        """The words, in lower case, at the places of names, and all other words that are written in lower case."""
        candidates = self.candidates(text)
        low = Counter(_LOW_WORDS.findall(text))
        for c in candidates:
            if c.kind == "lower":
                low.subtract(w for w in c.words[1:])  # beside a given name a word in lower case is no ordinary one
        at = [w for c in candidates for w in (c.words[1:] if c.kind == "lower" else c.words) if w not in NAME_PARTICLES]
        return at, list((+low).elements())

    @staticmethod
    def _is_id(text: str, m: re.Match) -> bool:
        """A number that its own check accepts, or one that words announce; never one that words call something else."""
        before = text[max(0, m.start() - 60) : m.start()]
        if OTHER_NUMBER.search(before[-30:]):
            return False
        # the check digits of a bare row of digits say too little: one in eleven passes
        return bool(not m[0].isdigit() and valid_number(m[0]) or ID_CUE.search(before))


def linked_form(f: Found) -> str:
    """What equal values have in common, however they are written."""
    if f.kind == "name":
        plain = unicodedata.normalize("NFD", f.text.lower())
        return " ".join(sorted(_WORDS.findall("".join(c for c in plain if not unicodedata.combining(c)))))
    if f.kind == "email":
        text = re.sub(_DOT, ".", re.sub(_AT, "@", f.text)).lower()
        return re.sub(r"\s+", "", text)
    return re.sub(r"\W+", " ", f.text.lower()).strip()


def placeholder(f: Found, key: bytes) -> str:
    if f.kind in ("phone", "id_number", "date_of_birth"):
        turn = {"phone": permuted_phone, "id_number": permuted_number, "date_of_birth": permuted_date}[f.kind]
        return f"[{f.kind.upper()} {turn(f.text, key)}]"
    return f"[{f.kind.upper()} {hmac.digest(key, f'{f.kind} {linked_form(f)}'.encode(), hashlib.sha256).hex()[:10]}]"


def redacted(text: str, finder: Finder, key: bytes, common: Set[str] = frozenset()) -> str:
    out, at = [], 0
    for f in finder.find(text, common, dates=True):
        out += [text[at : f.start], placeholder(f, key)]
        at = f.end
    return "".join(out) + text[at:]


def _word_rows(given: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, at_names, low = Finder(given), Counter(), Counter()

        def rows() -> pa.RecordBatch:
            kept = sorted(at_names.keys() | low.keys())
            out = pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([at_names[w] for w in kept], pa.int64()), pa.array([low[w] for w in kept], pa.int64())], ["word", "at_names", "low"])
            at_names.clear()
            low.clear()
            return out

        for batch in batches:
            for text in batch["text"].to_pylist():
                said, words = finder.words_at_names(text)
                at_names.update(said)
                low.update(words)
            if len(low) + len(at_names) > 500_000:
                yield rows()
        yield rows()

    return run


def ordinary_words(texts: DataFrame, given: frozenset[str]) -> DataFrame:
    """(word): words at the places of names that are in lower case more often elsewhere, by counts over all texts (column text)."""
    counts = texts.select("text").mapInArrow(_word_rows(given), "word string, at_names bigint, low bigint")
    counts = counts.groupBy("word").agg(F.sum("at_names").alias("at_names"), F.sum("low").alias("low"))
    return checkpointed(counts.where("at_names > 0 AND low > at_names").select("word"))


def _own_words(given: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(given)
        for batch in batches:
            index, words = [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                own = sorted({w for c in finder.candidates(text) for w in c.words})
                index += [i] * len(own)
                words += own
            if index:
                yield pa.RecordBatch.from_arrays([batch["_row"].take(pa.array(index)), pa.array(words)], ["_row", "word"])

    return run


def with_ordinary_words(source: DataFrame, given: frozenset[str], small: int) -> tuple[DataFrame, frozenset[str]]:
    """The texts (doc_id, text, common) and the ordinary words of all of them.

    Up to ``small`` such words are sent to every task. Beyond, each text gets those among its own words at
    places of names, by a join of those words only, and goes with them.
    """
    read = source.where(F.length("text") > 0)
    ordinary = ordinary_words(read, given)
    if ordinary.count() <= small:
        return source.withColumn("common", F.array().cast("array<string>")), frozenset(r["word"] for r in ordinary.toLocalIterator())
    rows = source.withColumn("_row", F.xxhash64("text"))  # equal texts have equal words
    own = rows.where(F.length("text") > 0).select("_row", "text").mapInArrow(_own_words(given), "_row long, word string").distinct()
    own = own.join(ordinary, "word").groupBy("_row").agg(F.collect_set("word").alias("common"))  # the words of one text
    return rows.join(own, "_row", "left").select("doc_id", "text", F.coalesce("common", F.array().cast("array<string>")).alias("common")), frozenset()


def _found_rows(given: frozenset[str], common: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(given)
        for batch in batches:
            index, kinds, texts = [], [], []
            for i, (text, own) in enumerate(zip(batch["text"].to_pylist(), batch["common"].to_pylist())):
                for kind, value in sorted({(f.kind, f.text) for f in finder.find(text, frozenset(own) if own else common)}):
                    index.append(i)
                    kinds.append(kind)
                    texts.append(value)
            if index:
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(index)), pa.array(kinds), pa.array(texts)], ["doc_id", "pii_type", "pii_text"])

    return run


def _redacted_rows(given: frozenset[str], common: frozenset[str], key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(given)
        for batch in batches:
            texts = [None if t is None else redacted(t, finder, key, frozenset(own) if own else common) for t, own in zip(batch["text"].to_pylist(), batch["common"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


#: Up to so many ordinary words, about 16 MB, are sent to every task.
SMALL_WORDS = 1_000_000


def find_personal(df: DataFrame, *, key: str = "doc_id", text: str = "text", more_given: tuple[str, ...] = (), small_words: int = SMALL_WORDS) -> DataFrame:
    """Rows (doc_id, pii_type, pii_text), distinct: email, phone, id_number, address and name, with the exact text.

    Whole texts are read. Null keys and null or empty texts give no row, repeated rows and repeated
    values one. Types do not overlap: mail addresses go first, then identity numbers, phone numbers,
    addresses, names. An identity number counts where its check digits, letters or ranges are right, or
    where words announce it. ``more_given`` adds given names; other given names are found by their position
    (a title, greeting, closing or label before, an initial between, the same words in a mail address of the
    text). The texts are read twice: counts of words over all of them tell ordinary words at such positions;
    up to ``small_words`` of those are sent to every task, more are joined to the texts. Other columns are not read.
    """
    ship(df.sparkSession)
    source = df.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    given = frozenset(GIVEN_NAMES) | {x.lower() for x in more_given}
    texts, common = with_ordinary_words(source, given, small_words)
    return texts.mapInArrow(_found_rows(given, common), f"doc_id {dict(df.dtypes)[key]}, pii_type string, pii_text string").distinct()


def redact_personal(df: DataFrame, secret: str, *, key: str = "doc_id", text: str = "text", more_given: tuple[str, ...] = (), small_words: int = SMALL_WORDS) -> DataFrame:
    """Rows (doc_id, text), one for each row: the text with typed placeholders, [PHONE +49 30 19274 113] or [NAME 3fa1c09b2e].

    Numbers and dates of birth are keyed pseudonyms in their own format, other values keyed tags; equal
    values of a type have equal ones everywhere, phone numbers in their national part however they are
    written. ``secret`` must be kept: with it every number and date can be restored by permuted_number,
    permuted_phone and permuted_date with decrypt=True. Null texts stay null and empty ones empty; the
    rest of a text is kept as it is.
    """
    ship(df.sparkSession)
    source = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    given = frozenset(GIVEN_NAMES) | {x.lower() for x in more_given}
    texts, common = with_ordinary_words(source, given, small_words)
    return texts.mapInArrow(_redacted_rows(given, common, secret.encode()), f"doc_id {dict(df.dtypes)[key]}, text string")
