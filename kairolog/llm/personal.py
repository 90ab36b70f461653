"""Personal items in free text, found and replaced by typed placeholders (problem 3).

Anchor expansion. Texts are folded first (full-width forms, look-alike letters, marks and invisible characters are undone, with a map
back to the stored code points), a whole chunk at once. One Aho-Corasick automaton then runs over the chunk and finds
anchors: at-signs and their spellings, cues of identity numbers, words of streets, titles, given names,
cues of signatures and forms, verbs of what people do, endings of Russian surnames; runs of digits, counted over the whole chunk, anchor telephones
and numbers with check digits. The local parser of an anchor's kind looks at the stretch around it (``REACH``, more than an
item of that kind is long), expands and checks the boundaries of the item. Stretches of one kind that meet are
parsed once, so the work is linear in the text.

Kinds: EMAIL, PHONE, ID, ADDRESS, NAME. Where two overlap, the one named first in ORDER wins.

Defined results: null and empty texts have no items and stay as they are; text outside the items is kept to the last code point;
a given name alone is no NAME; numbers of orders, shipments, builds and versions are no PHONE or ID; a number without a cue is an ID only
if its check digits are right.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairolog.llm.byte_bpe import _spread, text_buffer
from kairolog.llm.lookalike import Tables

ORDER = ("EMAIL", "ID", "ADDRESS", "PHONE", "NAME")

#: Given names common where the corpus's languages are spoken (fixed values, a parameter of `items`).
GIVEN_NAMES = """
adam aiko akira alan alba alejandro alex alexander alexei alice amara amelia ana anders andrea andrei anna anne antoine antonio astrid
beatriz ben bernd boris bruno carla carlos carmen caroline charlotte chiara chloe christian clara claire daniel david diego dieter
dmitri edith elena elias elif emil emily emma erik eva fatima felix fernando finn francois frank freya gabriel georg greta hana hannah hans
haruto heidi helena henrik hiroshi igor ines ingrid irina isabel ivan ivo jan jana javier jean jens johann john jonas jorge jose juan julia julie
jurgen karin karl kenji klaus kofi lars laura lea leila leo leon lena lina lisa louis luca lucas lucia luis lukas manuel marco marcel marc maria marie
marta martin mateo max mehmet mia michael miguel mika mikhail mira miriam naomi nadia natalia nicolas nina noah noor nora olga oliver olivier omar oskar
oscar pablo paul paula pavel pedro peter petra philipp pierre priya rafael rachel raj renate robert rosa sakura sanna sara sarah sergei silvia simon
sofia sophie stefan stephan susanne sven svetlana takashi tatiana thomas tobias tomas tom ute valentina vera victor viktor vladimir werner william yara yuki yusuf zoe
""".split()

TITLES = r"mrs?|ms|miss|mx|dr|prof|professor|herrn?|frau|sr|sra|srta|senora?|don|dona|monsieur|madame|mme|mlle|signora?"
#: Words that end names of places, products and teams.
PLACES = set("works labs depot board desk suite tracker archive ledger atlas project team street st road rd lane court avenue ave blvd square park bridge station".split())
#: Words after which a name in lower case is none.
COMMON = set("""about above after again ahora also antes aqui archivo avec bien before bitte bring cette como could cuando dans dass desde does donde done dropped each esta este esto estos
first from gestern hacer have heute hier into jetzt just later lista maintenant mais make maybe morgen note nicht notes oder other para pero please plus pour pues quand
really said says shall should since some soon sure tambien than that their then there these they this those today tomorrow under until update using want were what when where which while will with would yesterday your""".split())

#: After these two or three capitalised words are a name, whatever they are; a colon, comma or dash may stand between. In ``FORM_CUES`` a colon must.
NAME_CUES = [
    "signed", "signed by", "regards", "sincerely", "yours", "cheers", "my name is", "name is", "i am", "attn", "attention of", "full name", "first and last name", "contact person", "emergency contact",
    "mit freundlichen grüßen", "viele grüße", "gruß", "gez.", "mein name ist", "ich heiße", "ich bin", "ansprechpartner", "ansprechpartnerin", "cordialement", "je m'appelle", "je suis", "signé", "saludos", "atentamente", "me llamo", "mi nombre es", "firmado", "с уважением", "меня зовут", "подпись",
]
FORM_CUES = ["name", "contact", "customer", "client", "patient", "employee", "recipient", "sender", "author", "from", "to", "cc", "kunde", "patientin", "empfänger", "absender", "nom", "nom complet", "destinataire", "expéditeur", "nombre", "destinatario", "remitente", "фио", "имя", "контакт", "получатель", "отправитель"]
#: What is done to people and what people do: capitalised words after or before are a name (fixed values).
DONE_TO = "met|meet|ask|asked|told|tell|invite|invited|thank|thanked|emailed|phoned|contact|contacted|spoke to|spoke with|talked to|talk to|meeting with|lunch with|introduced by|written by|reviewed by|hired|trifft|traf|fragte|frag bitte|sprach mit|rencontré|demande à|demandé à|parlé avec|pregunta a|pregunté a|hablé con|conocí a|встретил|спроси у".split("|")
DONE_BY = "called|rang|phoned|said|says|wrote|asked|replied|answered|thinks|confirmed|complained|will call|will join|has called|has written|left a message|rief an|hat angerufen|sagte|schrieb|meinte|a appelé|a écrit|a dit|a répondu|llamó|dijo|escribió|respondió".split("|")
#: First words of names that are no person's (fixed values).
NO_PERSON = set("project team company build version port room lake mount new san santa saint sankt north south east west upper lower great the our my your this that monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag".split())
#: Japanese names without a form of address: after a word of a form, or before words of introduction.
KANJI_CUES = ["氏名", "お名前", "名前", "担当者", "担当", "署名", "差出人", "宛名", "連絡先", "申込者"]
KANJI_AFTER = ["と申します", "と言います", "といいます", "より"]
#: Endings of Russian surnames and patronymics, and first words that make no name with them (fixed values).
SURNAMES = "ов ова ову овым овой ев ева еву евым евой ёв ёва ин ина ину иным иной ский ская ского скому ским ской цкий цкая енко чук".split()
PATRONYMICS = "ович овича овичу евич евича евичу ьич ьича ьичу овна овны овне евна евны евне ична ичны ичне".split()
NOT_GIVEN = "проект команда город улица площадь проспект переулок бульвар станция система компания архив отдел фонд парк банк завод институт театр музей мост дом отчёт отчет заказ это как что для или если когда где от для у про сегодня вчера завтра здравствуйте господин госпожа товарищ доктор мистер".split()
#: Verbs that begin a sentence before a surname.
VERB = "звонил|писал|сказал|просил|ответил|спросил|передал|отправил|получил|пришёл|пришел|был|стал|дал|взял|ушёл|ушел"

ID_CUES = [
    "ssn", "social security number", "social security", "my social", "dni", "nie", "nif", "passport", "reisepass", "pasaporte", "passeport", "steuer-id", "steuerid", "steuernummer", "steueridentifikationsnummer", "personalausweis",
    "numéro de sécu", "sécurité sociale", "national id", "national insurance", "nino", "tax id", "tax number", "tin", "itin", "マイナンバー", "個人番号", "パスポート番号", "旅券番号", "ИНН", "СНИЛС", "паспорт", "cpf", "ahv", "codice fiscale", "identity card", "id card",
]
PHONE_CUES = ["tel", "téléphone", "telefon", "teléfono", "phone", "call", "text", "rang", "ring me", "number is", "numéro", "mobile", "handy", "rückruf", "電話", "携帯", "телефон", "звони", "позвони", "whatsapp", "fax", "móvil", "llama", "appel", "sms"]
#: Words of addresses by where they stand; parsers and anchors are made from the same lists (fixed values).
AFTER_NAME = "St Street Road Rd Lane Ln Avenue Ave Blvd Boulevard Court Ct Drive Dr Terrace Close Way Square Place".split()
BEFORE_NAME = "rue avenue boulevard quai chemin place allee impasse".split()
ENDINGS = "straße strasse str. weg gasse allee platz ring damm ufer".split()
BEFORE_NUMBER = "calle avenida plaza paseo camino via viale piazza".split()
BOXES = {"P\\.? ?O\\.? ?Box": "box ", "Postfach": "postfach ", "Apartado(?: de correos)?": "apartado", "BP": "bp ", "boite postale": "boite postale "}
DISTRICTS = "市区町村県都府郡"
RUSSIAN = ["улица", "ул.", "проспект", "просп.", "пр-т", "переулок", "пер.", "площадь", "пл.", "бульвар", "набережная", "наб.", "шоссе", "проезд"]
STREETS = [f" {w}" for w in (*AFTER_NAME, *BEFORE_NAME)] + [f"{w} " for w in (*ENDINGS, *BEFORE_NUMBER)] + [*BOXES.values(), "〒", *DISTRICTS, *RUSSIAN]
#: Spellings of an at-sign, and those of a dot that go with each where no brackets stand.
ATS = {"at": "dot|punkt", "arroba": "dot|punto", "arobase": "dot|point", "chez": "dot|point"}

_LOCAL = r"[\w.%+\-]*[\w%+\-]"
_DOT = r"(?:\.|\s*[\[({]\s*(?:dot|punkt|point|punto)\s*[\])}]\s*|\s+(?:dot|punkt|point|punto)\s+)"
_HOST = rf"[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:{_DOT}[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?)*{_DOT}[a-z][a-z]+"
_SPELLED = r"(?:\.|\s*[\[({]\s*(?:dot|punkt|point|punto)\s*[\])}]\s*|\s+(?:dot|punkt|point|punto)\s+)"
EMAIL = re.compile(rf"(?:mailto:)?(?<![\w.%+\-])[a-z0-9_](?:[a-z0-9_.%+\-]*[a-z0-9_%+\-])?(?:\s?@\s?|\s*[\[({{<]\s*(?:{"|".join(ATS)})\s*[\])}}>]\s*){_HOST}(?![\w@])", re.I | re.A)
EMAIL_AT = [re.compile(rf"(?<![\w.%+\-])[a-z0-9_][a-z0-9_.%+\-]*\s+{at}\s+[a-z0-9\-]+(?:\s+(?:{dot})\s+[a-z0-9\-]+)*\s+(?:{dot})\s+[a-z]{{2,}}(?!\w)", re.I | re.A) for at, dot in ATS.items()]

_CODE = r"[A-Z]{0,3}[ \-]?\d(?:[ \-/.]?[0-9A-Z]){5,17}(?![0-9])"
_LINK = r"(?:\s*(?:number|numero|nummer|no|nr|n[o°º]|is|was|ist|est|es|lautet|:|#|=|は|が|番号|номер)\.?)*[\s:#]*"

PHONE = re.compile(
    r"(?<![A-Za-z0-9_.,/+\-#])(?:"
    r"(?:\+|00 )\d{1,3}(?:[ \-./]?\(?\d{1,5}\)?){2,6}"
    r"|\(\d{2,5}\) ?\d{3,4}[ \-.]?\d{3,4}"
    r"|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4}|1[ \-.]\d{3}[ \-.]\d{3}[ \-.]\d{4}"
    r"|0\d(?:[ .\-]\d\d){4}|0\d{1,4}-\d{1,4}-\d{4}|0\d{2,4}[ /\-]\d{3,5}[ \-]\d{3,5}|0\d{2,4}[ /]\d{5,9}|0\d{9,10}"
    r"|\d{2,4}[ \-]\d{3,5}[ \-]\d{3,5}|\d{3}[ \-.]\d{4}|[679]\d{2}(?: \d{3}){2}|\d{2}(?:[ .]\d\d){4}|\d{2}(?: \d{2,4}){2,4}"
    r")(?:,? ?(?:ext|x|durchwahl|poste|доб)\.? ?\d{1,6})?(?![A-Za-z0-9_])(?![.,/\-]\d)",
    re.I,
)
#: Shapes that are telephone numbers without any cue.
SURE = re.compile(r"(?:\+|00 )|\(\d{2,5}\) ?\d{3,4}[ \-.]?\d{3,4}|\d{3}([\-.])\d{3}\1\d{4}(?!\d)|\d{3} \d{3} \d{4}|0\d(?:[ .\-]\d\d){4}|0\d{1,4}-\d{1,4}-\d{4}|0\d{2,4}[ /]\d{3,5} \d{3,5}")
NOT_PHONE = re.compile(r"(?<![a-z])(?:track(?:ing|ed)?|parcel|shipment|order|invoice|bestell\w*|sendung\w*|commande|pedido|build|version|ran|ping|isbn|issn|serial|lot|batch|part|item|case|ref(?:erence)?|account|iban|ticket|release|range|rows?|id|〒|号)\b[\s:#]*(?:no|nr|number|numero|nummer)?[.:#\s]*$", re.I)
CUE_BEFORE = 40
#: Code points before and after an anchor that its parser looks at.
REACH = {"EMAIL": (330, 330), "ID": (60, 120), "NUMBER": (30, 60), "ADDRESS": (160, 260), "PHONE": (80, 80), "NAME": (160, 160), "CUED": (60, 200), "PEOPLE": (160, 200), "RUSSIAN": (160, 160)}
#: A telephone number or a number with check digits has so many digits within so many code points.
DIGITS, DIGITS_WITHIN = 7, 26

_LATIN = r"A-Za-z\u00c0-\u024f"
_CITY = rf"[A-Z][{_LATIN}'\-]+(?: [A-Z][{_LATIN}'\-]+)?"
_TAIL = rf"(?:,? (?i:apt|apartment|suite|unit|flat|no|#)\.? ?\d+[a-z]?)?(?:,? \d{{1,2}}[oaº°] ?[A-Z]?)?(?:,? \d{{4,6}})?(?:,? {_CITY}(?:,? (?:[A-Z]{{2}} )?\d{{4,6}})?)?"
_CAP = rf"[A-Z][{_LATIN}'\-]+"
_EDGE = rf"(?<![{_LATIN}0-9_.,])"
_END = rf"(?![{_LATIN}0-9_])"
_DIGIT = re.compile(r"\d")
_NUM = r"\d{1,5} ?[a-zA-Z]?(?: ?(?:bis|ter))?"
ADDRESSES = [
    re.compile(rf"(?:(?i:flat|apt|apartment|unit|suite)\.? \d+[a-z]?, )?{_EDGE}\d{{1,5}}[a-zA-Z]?,? (?:[NSEW]\.? )?(?:{_CAP} ){{1,3}}(?:{"|".join(AFTER_NAME)}){_END}\.?{_TAIL}"),
    re.compile(rf"{_EDGE}{_NUM},? (?i:{"|".join(BEFORE_NAME)})(?: (?:du|de la|des|de|d'))? ?{_CAP}{_TAIL}"),
    re.compile(rf"{_EDGE}{_CAP}(?:{"|".join(map(re.escape, ENDINGS))}) \d{{1,4}}(?: ?[a-z])?{_END}{_TAIL}"),
    re.compile(rf"{_EDGE}(?i:{"|".join(BEFORE_NUMBER)}) (?:(?:de|del|la|las|los) ){{0,2}}{_CAP},? (?:n[oº°]\.? ?)?\d{{1,5}}{_TAIL}"),
    re.compile(rf"{_EDGE}(?:{"|".join(BOXES)}) \d{{1,6}}(?!\d)(?:,? (?:\d{{4,6}} )?{_CITY}(?:,? \d{{4,6}})?)?", re.I),
    re.compile(r"〒 ?\d{3}-?\d{4}(?:[\s、,]*[ぁ-ヿ一-鿿々]+[市区町村県都府郡][ぁ-ヿ一-鿿々]*\d*(?:丁目)?[\d\-番地号]*)?"),
    re.compile(r"[一-鿿々]{1,8}[市区町村県都府郡][ぁ-ヿ一-鿿々]{0,8}?\d{1,3}(?:丁目\d{1,3}(?:-\d{1,3})?(?:番地?)?(?:\d{1,3}号)?|番地?(?:\d{1,3}号?)?|(?:-\d{1,3}){1,2})"),
]


#: Identity numbers that can be told without a cue (fixed patterns).
CHECKED = re.compile(r"(?<![\w.,/+\-#])(?:(?P<dni>(?:\d{8}|[XYZ]-?\d{7})-?[A-Z])|(?P<nir>[12] ?\d\d ?(?:0[1-9]|1[0-2]) ?\d[\dAB] ?\d{3} ?\d{3} ?\d\d)|(?P<cpf>\d{3}\.\d{3}\.\d{3}-\d\d))(?![\w])(?![.,/\-]\d)")


def check_digits(m: re.Match[str]) -> bool:
    """Whether the check digits of a match of CHECKED are right."""
    x = re.sub(r"[ .\-]", "", m[0])
    if m["dni"]:
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(x[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == x[-1]
    if m["nir"]:
        body = x[:13].replace("2A", "19").replace("2B", "18")
        return body.isdigit() and 97 - int(body) % 97 == int(x[13:])
    d = list(map(int, x))
    one = sum(a * b for a, b in zip(d[:9], range(10, 1, -1), strict=True)) * 10 % 11 % 10
    two = sum(a * b for a, b in zip(d[:10], range(11, 1, -1), strict=True)) * 10 % 11 % 10
    return d[9:] == [one, two] and len(set(d)) > 1


@lru_cache(maxsize=4)
def _fold_string(s: str) -> str:
    data = np.frombuffer(s.encode(), np.uint8)
    return fold_chunk(data, np.array([len(data)]))[0]


def fold_chunk(data: np.ndarray, ends: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Texts folded, each followed by a line feed: the string, the source position of each code point, starts in string and source."""
    t = Tables()
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    cp_ends = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), ends)
    size = np.diff(np.concatenate([[0], cp_ends]))
    n = t.size[cp].astype(np.int64)
    flat = t.flat[_spread(t.start[cp], n)]
    source = np.repeat(np.arange(len(cp)), n)
    text = np.repeat(np.repeat(np.arange(len(ends)), size), n)
    kept = t.mark[flat] == 0
    flat, source, text = flat[kept], source[kept], text[kept]
    flat = np.where(flat == 10, np.uint32(11), flat)  # a line feed ends a text, a vertical tab stands for those within
    at = np.arange(len(flat)) + text
    out = np.full(len(flat) + len(ends), 10, np.uint32)
    out[at] = flat
    back = np.zeros(len(out), np.int64)
    back[at] = source
    per = np.bincount(text, minlength=len(ends)) if len(text) else np.zeros(len(ends), np.int64)
    starts = np.concatenate([[0], np.cumsum(per + 1)])
    return out.astype("<u4").tobytes().decode("utf-32-le"), back, starts, np.concatenate([[0], cp_ends])


def cased(w: str) -> list[str]:
    """Spellings of a word that fold differently: a capital may look like a Latin one where its small letter does not."""
    return list(dict.fromkeys(_fold_string(x)[:-1] for x in (w, w.capitalize(), w.upper())))


def russian_addresses() -> list[re.Pattern[str]]:
    """Parsers of Russian addresses over folded text, in which letters that Latin has too are Latin."""
    low = lambda words: "|".join(re.escape(x) for w in words for x in cased(w))
    word = r"[^\W\d_](?:[^\W\d_]|-(?=[^\W\d_]))*"
    name = rf"(?-i:(?=[A-ZА-ЯЁ])){word}(?: (?-i:(?=[A-ZА-ЯЁ])){word})?"
    number = rf"\d{{1,4}}(?:/\d{{1,4}})?(?: ?[^\W\d_](?![\w]))?(?:,? (?:{low(['корп.', 'корпус', 'к.', 'стр.', 'строение'])}) ?\d{{1,3}})?(?:,? (?:{low(['кв.', 'квартира', 'оф.', 'офис'])}) ?\d{{1,5}})?(?![\w])"
    house = rf",? (?:(?:{low(['дом', 'д.'])}) ?)?{number}(?:,? \d{{6}}(?!\d))?"
    kind = rf"(?:{low(RUSSIAN)})"
    before = rf"(?:\d{{6}}, ?)?(?:(?:{low(['г.'])}) ?)?(?:(?-i:(?=[A-ZА-ЯЁ])){word}, )?"
    return [re.compile(rf"(?<![\w]){before}{kind} ?{name}{house}", re.I), re.compile(rf"(?<![\w]){before}{name} {kind}{house}", re.I)]


class Finder:
    """The automaton and the parsers that need the given names."""

    def __init__(self, given: tuple[str, ...]):
        import ahocorasick

        f = lambda s: _fold_string(s)[:-1].lower()
        self.auto = ahocorasick.Automaton()
        words: dict[str, set[str]] = {}
        for kind, cues in (("EMAIL", ["@", " at ", *(f"{x}at" for x in "[({<"), *(f"at{x}" for x in "])}>"), *(w for w in ATS if w != "at")]), ("ID", ID_CUES), ("ADDRESS", STREETS)):
            for c in cues:
                words.setdefault(f(c) if c.strip() == c else f"{' ' * c.startswith(' ')}{f(c.strip())}{' ' * c.endswith(' ')}", set()).add(kind)
        for c in given:
            words.setdefault(f(c), set()).add("NAME")
        for c in (*TITLES.replace("?", "").split("|"), "mr", "herr", "senor", "signor"):
            words.setdefault(f"{f(c)} ", set()).add("NAME")
            words.setdefault(f"{f(c)}. ", set()).add("NAME")
        for kind, cues in (("PEOPLE", (*(f"{c} " for c in DONE_TO), *(f" {c}" for c in DONE_BY))), ("CUED", (*NAME_CUES, *(f"{c}{x}" for c in FORM_CUES for x in (":", " :")), *KANJI_CUES, *KANJI_AFTER)), ("RUSSIAN", (*SURNAMES, *PATRONYMICS)), ("ADDRESS", RUSSIAN)):
            for w in {x.lower() for c in cues for x in cased(c)}:
                words.setdefault(w, set()).add(kind)
        for c in ("さん", "様", "先生"):
            words.setdefault(c, set()).add("NAME")
        whole = {f(c) for c in given}
        ending = {x.lower() for c in (*SURNAMES, *PATRONYMICS) for x in cased(c)}
        for w, kinds in words.items():
            self.auto.add_word(w, (kinds, len(w), w in whole and kinds == {"NAME"}, w in ending and kinds == {"RUSSIAN"}))
        self.auto.make_automaton()
        cues = "|".join(sorted((re.escape(f(c)) for c in ID_CUES), key=len, reverse=True))
        self.id_ = re.compile(rf"(?<![a-z0-9])(?:{cues}){_LINK}({_CODE})", re.I)
        self.phone_cue = re.compile("|".join(re.escape(f(c)) for c in PHONE_CUES), re.I)
        self.street = [*ADDRESSES, *russian_addresses()]
        names = "|".join(sorted(map(re.escape, map(f, given)), key=len, reverse=True))
        sur = r"[^\W\d_](?:[^\W\d_]|['\-](?=[^\W\d_]))+"
        self.given_first = re.compile(rf"(?<![\w@.\-])((?:{names})(?:-(?:{names}))?)((?: [a-z]\.)?) ({sur})(?![\w@\-])(?!\.\w)(?: (\w+))?", re.I)
        self.given_last = re.compile(rf"(?<![\w@])({sur}), ((?:{names}))(?: [a-z]\.)?(?![\w@])", re.I)
        self.titled = re.compile(rf"(?<![\w])(?:{TITLES})\.? (?:(?:{TITLES})\.? )?(?:(?:{names}) (?:[a-z]\. )?)?([A-Z](?:[^\W\d_]|['\-])+)(?![\w@])", re.I)
        cap = r"(?-i:(?=[A-ZА-ЯЁ]))[^\W\d_](?:[^\W\d_]|['\-](?=[^\W\d_]))+"
        either = lambda words: "|".join(re.escape(x) for w in words for x in cased(w))
        self.cued = re.compile(rf"(?<![\w])(?:(?:{either(NAME_CUES)})(?:\s*[:,–-]\s*|\s+)|(?:{either(FORM_CUES)}) ?:\s*)({cap}(?: [A-Z]\.)?(?: {cap}){{1,2}})(?![\w@])(?: (\w+))?", re.I)
        self.done_to = re.compile(rf"(?<![\w])(?:{either(DONE_TO)}) ({cap}(?: [A-Z]\.)?(?: {cap}){{1,2}})(?![\w@])(?: (\w+))?", re.I)
        self.done_by = re.compile(rf"(?<![\w@.\-])({cap}(?: [A-Z]\.)? {cap})()(?= (?:{either(DONE_BY)})(?![\w]))", re.I)
        self.russian = re.compile(rf"(?<![\w@.\-])({cap}) (?:(?=[^\W\d_]+(?:{either(PATRONYMICS)})(?![\w])){cap}(?: (?=[^\W\d_]+(?:{either(SURNAMES)})(?![\w])){cap})?|(?=[^\W\d_]+(?:{either(SURNAMES)})(?![\w])){cap})(?![\w@])", re.I)
        self.not_given = re.compile(rf"(?:{either([*NOT_GIVEN, *RUSSIAN, *VERB.split('|')])})", re.I)
        spaced = r"[一-鿿々]{1,4}[ \u3000][一-鿿々ァ-ヺ]{1,4}"
        self.kanji = re.compile(rf"(?:{'|'.join(map(f, KANJI_CUES))})(?:\s*[::は]\s*|\s+)({spaced}|[一-鿿々]{{3,6}})(?![一-鿿々])|(?<![一-鿿々])({spaced}|[一-鿿々]{{3,5}})(?=と申します|と言います|といいます)|(?<![一-鿿々])({spaced})(?=より)")
        self.polite = re.compile(r"(?:[一-鿿]{2,4}|[ァ-ヺ]{2,8}|[A-Z][a-z]{2,})(?: ?[一-鿿ァ-ヺ]{1,4})?(?:さん|様|先生)")

    def anchors(self, folded: str, starts: np.ndarray) -> dict[int, dict[str, list[int]]]:
        """Rows with anchors, and where in the row the anchors of each kind stand."""
        low = folded.lower()
        low = low if len(low) == len(folded) else "".join(c.lower() if len(c.lower()) == 1 else c for c in folded)
        at: list[int] = []
        kinds: list[set[str] | tuple[str, ...]] = []
        letter = str.isalpha
        for end, (found, n, whole, ending) in self.auto.iter(low):
            if (whole or ending) and letter(low[end + 1]):  # inside a longer word
                continue
            if whole and letter(low[end - n]) and end >= n:
                continue
            at.append(end)
            kinds.append(found)
        points = np.frombuffer(folded.encode("utf-32-le"), np.uint32)
        digit = (points >= 48) & (points <= 57)
        count = np.zeros(len(points) + DIGITS_WITHIN + 1, np.int32)
        np.cumsum(digit, out=count[1 : len(points) + 1])
        count[len(points) + 1 :] = count[len(points)]
        first = digit.copy()
        first[1:] &= ~digit[:-1]
        first = np.flatnonzero(first)
        first = first[count[first + DIGITS_WITHIN] - count[first] >= DIGITS]
        at += first.tolist()
        kinds += [("PHONE", "NUMBER")] * len(first)
        out: dict[int, dict[str, list[int]]] = {}
        where = np.array(at, np.int64)
        rows = np.searchsorted(starts, where, side="right") - 1
        for row, pos, found in zip(rows.tolist(), (where - starts[rows]).tolist(), kinds, strict=True):
            of = out.setdefault(row, {})
            for kind in found:
                of.setdefault(kind, []).append(pos)
        return out

    @staticmethod
    def stretches(text: str, kind: str, at: list[int]) -> list[tuple[int, int]]:
        """What the parser of a kind looks at: around each anchor, ended where a word ends; stretches that meet are one."""
        left, right = REACH[kind]
        if len(text) <= left:
            return [(0, len(text))]
        out: list[tuple[int, int]] = []
        for p in sorted(at):
            a, b = max(0, p - left), min(len(text), p + right)
            while b < len(text) and (text[b].isalnum() or text[b] in "-.@_"):
                b += 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def spans(self, text: str, anchors: dict[str, list[int]]) -> list[tuple[int, int, str]]:
        """Items of one folded text that do not overlap, in order."""
        found: list[tuple[int, int, str]] = []
        for kind, at in anchors.items():
            for a, b in self.stretches(text, kind, at):
                found += self.parsed(text, kind, a, b)
        rank = {k: i for i, k in enumerate(ORDER)}
        starts: list[int] = []
        out: list[tuple[int, int, str]] = []
        for a, b, k in sorted(set(found), key=lambda x: (rank[x[2]], x)):
            i = bisect_left(starts, a)
            if (i == 0 or out[i - 1][1] <= a) and (i == len(out) or b <= out[i][0]):
                starts.insert(i, a)
                out.insert(i, (a, b, k))
        return out

    def parsed(self, text: str, kind: str, a: int, b: int) -> list[tuple[int, int, str]]:
        """Items that the parsers of a kind of anchor find between two positions."""
        if kind == "EMAIL":
            return [(m.start(), m.end(), "EMAIL") for p in (EMAIL, *EMAIL_AT) for m in p.finditer(text, a, b)]
        if kind == "ID":
            return [(*m.span(1), "ID") for m in self.id_.finditer(text, a, b) if sum(c.isdigit() for c in m[1]) >= 6]
        if kind == "NUMBER":
            return [(m.start(), m.end(), "ID") for m in CHECKED.finditer(text, a, b) if check_digits(m) and not NOT_PHONE.search(text[max(0, m.start() - CUE_BEFORE) : m.start()])]
        if kind == "ADDRESS":
            return [(m.start(), m.end(), "ADDRESS") for p in self.street for m in p.finditer(text, a, b)] if _DIGIT.search(text, a, b) else []
        if kind == "PHONE":
            return self._phones(text, a, b)
        if kind == "NAME":
            return self._names(text, a, b)
        if kind == "CUED":
            return self._cued(text, a, b)
        if kind == "PEOPLE":
            return [(*m.span(1), "NAME") for p in (self.done_to, self.done_by) for m in p.finditer(text, a, b) if self._person(m[1], m[2] or "")]
        return [(m.start(), m.end(), "NAME") for m in self.russian.finditer(text, a, b) if not self.not_given.fullmatch(m[1])]

    @staticmethod
    def _person(name: str, after: str) -> bool:
        """Whether no word of a name or after it says that it is that of a place, product or team."""
        words = name.lower().split(" ")
        return not PLACES.intersection([*words, after.lower()]) and not COMMON.intersection(words) and words[0] not in NO_PERSON

    def _phones(self, text: str, a: int, b: int) -> list[tuple[int, int, str]]:
        out = []
        for m in PHONE.finditer(text, a, b):
            digits = sum(c.isdigit() for c in re.split(r",? ?(?:ext|x|durchwahl|poste)", m[0], flags=re.I)[0])
            before = text[max(0, m.start() - CUE_BEFORE) : m.start()]
            if NOT_PHONE.search(before) or not 7 <= digits <= 15:
                continue
            cued = self.phone_cue.search(before[-25:]) or re.match(r" (?:rang|called|anrufen|appelle|ist meine nummer)\b", text[m.end() : m.end() + 24], re.I)
            if SURE.match(m[0]) or cued:
                out.append((m.start(), m.end(), "PHONE"))
        return out

    def _names(self, text: str, a: int, b: int) -> list[tuple[int, int, str]]:
        out = []
        for m in self.given_first.finditer(text, a, b):
            given, sur, after = m[1], m[3], m[4] or ""
            low = sur.lower()
            if low in COMMON or low in PLACES or (after[:1].isupper() and after.lower() in PLACES):
                continue
            if given[:1].isupper() and sur[:1].isupper() or (given.islower() and sur.islower() and len(sur) >= 5):
                out.append((m.start(), m.end(3), "NAME"))
        for m in self.given_last.finditer(text, a, b):
            sur = m[1]
            if (sur[:1].isupper() == m[2][:1].isupper()) and len(sur) >= 4 and sur.lower() not in COMMON and sur.lower() not in GREETINGS:
                out.append((m.start(), m.end(), "NAME"))
        for m in self.titled.finditer(text, a, b):
            if m[1].lower() not in PLACES and m[1].lower() not in COMMON and m[1][:1].isupper():
                out.append((m.start(), m.end(), "NAME"))
        out += [(m.start(), m.end(), "NAME") for m in self.polite.finditer(text, a, b) if not re.match(r"皆|奥|お客|神|王|同|多|一|各|仕", m[0])]
        return out

    def _cued(self, text: str, a: int, b: int) -> list[tuple[int, int, str]]:
        """Names that a signature, a form or an introduction shows, whatever the given name."""
        out = []
        for m in self.cued.finditer(text, a, b):
            words = m[1].lower().split(" ")
            if not PLACES.intersection([*words, (m[2] or "").lower()]) and not COMMON.intersection(words):
                out.append((*m.span(1), "NAME"))
        for m in self.kanji.finditer(text, a, b):
            out.append((*m.span(m.lastindex), "NAME"))
        return out


GREETINGS = set("hello thanks thank dear okay ok yes no sure hola hallo bonjour salut merci danke gracias well anyway signed done right".split())


@lru_cache(maxsize=2)
def finder(given: tuple[str, ...]) -> Finder:
    return Finder(given)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with ``[KIND]`` for each span of code points."""
    parts, done = [], 0
    for a, b, kind in spans:
        parts += [text[done:a], f"[{kind}]"]
        done = b
    return "".join([*parts, text[done:]])


def _stored_span(a: int, b: int, back: np.ndarray, text: str, shift: int, marks: np.ndarray) -> tuple[int, int]:
    """Span of a folded text in code points of the stored one; marks that follow the last letter belong to it."""
    x, y = int(back[a]) - shift, int(back[b - 1]) - shift + 1
    while y < len(text) and marks[ord(text[y])]:
        y += 1
    return x, y


def found_in(column: pa.Array, given: tuple[str, ...], chunk_bytes: int = 2_000_000) -> Iterator[tuple[int, str, list[tuple[int, int, str]]]]:
    """Row, text and spans (in stored code points) of each text that has items."""
    f, marks = finder(given), Tables().mark
    data, ends = text_buffer(column)
    row, byte = 0, 0
    while row < len(ends):
        upto = max(row + 1, int(np.searchsorted(ends, byte + chunk_bytes, side="right")))
        folded, back, starts, source = fold_chunk(data[byte : ends[upto - 1]], ends[row:upto] - byte)
        for i, anchors in sorted(f.anchors(folded, starts).items()):
            a, b = int(starts[i]), int(starts[i + 1]) - 1
            spans = f.spans(folded[a:b], anchors)
            if spans:
                text = column[row + i].as_py()
                yield row + i, text, [(*_stored_span(a + x, a + y, back, text, int(source[i]), marks), k) for x, y, k in spans]
        row, byte = upto, int(ends[upto - 1])


def items(rows: DataFrame, keys: list[str], text: str = "text", given: tuple[str, ...] = tuple(GIVEN_NAMES), every: bool = False) -> DataFrame:
    """``keys``, ``kinds`` (distinct) and the text with placeholders, of the rows that have items or of ``every`` row. Narrow: no shuffle."""
    slim = rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("t"))
    heads = ", ".join(f"k{i} {slim.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, texts = [], [], []
            for row, stored, spans in found_in(batch.column(len(keys)), given):
                at.append(row)
                kinds.append(sorted({k for *_, k in spans}))
                texts.append(redact(stored, spans))
            if every:
                whole, which = batch.column(len(keys)).to_pylist(), [[] for _ in range(len(batch))]
                for row, k, t in zip(at, kinds, texts, strict=True):
                    whole[row], which[row] = t, k
                at, kinds, texts = list(range(len(batch))), which, whole
            picked = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*picked, pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], [*(f"k{i}" for i in range(len(keys))), "kinds", "redacted"])

    return slim.mapInArrow(run, f"{heads}, kinds array<string>, redacted string").select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "kinds", "redacted")
