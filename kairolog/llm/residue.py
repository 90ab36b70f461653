"""Template residue, filler and error pages instead of content (problem 7).

Residue: templates are induced by alignment. A place is what may be filled in: a notation of a template, a blank, a default such as
``Lastname``, or, in a record that was filled, a name or a number. Records that share two words on either side of a place, within its
sentence, are aligned there: what they hold at the place is the content of one slot. A slot is unfilled

* if it holds a notation nothing but a template uses (``STRONG``) or a name in braces: such notations are slots of their own;
* if it holds a name in another notation (``$NAME``, ``%NAME%``), a blank or a default, and aligned records hold another such content there, or
  several different names or numbers (for names of the environment such as ``$HOME`` only the former), or a salutation or form of address
  says that a value belongs there.

So ``$HOME`` in a sentence that always has it is no slot. All places of all records are counted, reduced to least and greatest content per
surroundings within a batch before they are exchanged.

Filler: texts all of whose words are of the filler vocabulary, which is induced: the words that stand mostly in texts with a
known filler word. Whole-page templates (errors, notices about scripts, cookies, login, waiting) are matched from end to end, numbers left
open, so a message that talks about such a page is none. Longer ones count at any length: error output by its build, HTML by its title
and headings, a notice if its first sentence is one, its words go on all along and nobody speaks in the first person. Pages that no pattern knows
are found by repetition: texts that open with a word for an error, have nobody who speaks and stand, digits open, in ``REPEATED`` records at least.

The texts are passed over once: that pass finds places, pages and candidates, and writes the few rows that the counts decide about.

Defined results: null and blank texts are no case; every row stands for itself, repeated ones included; case, full-width forms, invisible characters
and look-alike letters make no difference. Rows with a null key have no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairolog.llm.lookalike import canonical_column
from kairolog.session import cut

#: Notations nothing but a template uses (fixed patterns).
STRONG = [
    r"\{\{[#/^&]?[^{}\n]+\}\}", r"<%=?[^%\n]+%>", r"\{%[^%\n]+%\}", r"\[\[[^\]\n]+\]\]", r"<<[A-Za-z_][\w .-]*>>", r"«[A-Za-z_](?:[\w .-]{0,40}|[\w.-]*)»", r"\*\|[A-Z_0-9:]+\|\*", r"@@\w+@@", r"__[A-Z][A-Z_]*__",
    r"\$\{[\w.]+\}", r"#\{[\w.]+\}", r"\$[A-Z][A-Z_]+\$", r"%\([a-z_]\w*\)[sdif]", r"\bX{2}/X{2}/X{2,4}\b", r"\[(?:YOUR|INSERT|ENTER|ADD|FIRST|LAST|FULL|COMPANY|CUSTOMER|RECIPIENT|NAME|DATE|AMOUNT|ADDRESS|TITLE|PLACEHOLDER)[A-Z _']*\]",
    r"\[(?:placeholder|insert|your|enter) [^\]\n]+\]", r"<(?:DATE|NAME|AMOUNT|EMAIL|ADDRESS|TIME|CITY|COMPANY|INSERT [A-Z ]+)>", r"\[object Object\]", r"(?i:\b(?:dear|hello|hi|hallo|bonjour|hola) (?:null|undefined|nan)\b)",
]
#: Names in braces, and names marked in ways that ordinary text has too.
BRACES = [r"\{[A-Za-z_][\w.]*\}", r"\{\d{1,2}\}"]
MARKED = [r"%[A-Z][A-Z_]{2,}%", r"\$[A-Z][A-Z_]{2,}\b"]
WEAK = [*MARKED, *BRACES]
#: What stands where nothing was filled in: blanks, and defaults of forms (fixed patterns).
BLANKS = [r"(?<![\w_])_{3,}(?![\w_])", r"(?<=[^\s.…] )\.{4,}(?= ?[^\s.])", r"\[ {1,}\](?! ?\w+$)", r"\( {2,}\)"]
DEFAULTS = [
    r"\b(?:First|Last|Middle|Full|Given|Family|Sur|User|Customer|Client|Company|Recipient|Sender|Product|Order|Invoice|Account|Street|City|Vor|Nach|Kunden|Firmen|Empf[aä]nger|Bestell|Rechnungs)[ _-]?(?:[Nn]ame|[Nn]umber|[Nn]o|[Ii][Dd]|[Dd]ate|[Aa]ddress|[Aa]mount|[Nn]ummer|[Dd]atum|[Bb]etrag)\b",
    r"\b(?:John|Jane) Doe\b", r"\b(?:Max|Erika) Mustermann\b", r"\b(?:N/A|TBD|undefined|null|NaN)\b", r"\b(?:DD|MM|TT|JJ)[./-](?:MM|DD)[./-](?:YYYY|JJJJ|AAAA|YY)\b", r"\b0{2,}[./-]0{2,}[./-]0{2,}\b",
]
#: Before or after a value.
SALUTATION = re.compile(r"(?:^|[.!?,\n:] ?)(?:dear|hello|hi|hallo|liebe[rs]?|sehr geehrte[rs]?(?: (?:herr|frau))?|guten tag|bonjour|cher|chère|hola|estimad[oa]|querid[oa]|уважаем(?:ый|ая)|здравствуйте,?|attn\.?|name ?:|to ?:|from ?:) ?(?:mr\.? |ms\.? |mrs\.? )?$", re.I)
HONORIFIC = re.compile(r" ?(?:様|さん|殿|先生)")
#: What opens a page or an output that says something failed, and in how many records such a text must stand.
FAILURE = re.compile(r"\W*(?:(?:http|fatal|internal|unexpected|system|unknown) )?(?:errors?|failure|exception)\b|\W*(?:fehler|erreur|errore|erro)\b|\W*(?:ошибка|エラー|サーバーエラー)", re.I)
REPEATED = 3

#: Names of the environment, which are no slots even where they stand once (fixed values).
ENVIRONMENT = "HOME PATH TEMP TMP USER SHELL PWD USERPROFILE APPDATA JAVA_HOME PYTHONPATH LANG EDITOR HOSTNAME SYSTEMROOT PROGRAMFILES WINDIR USERNAME".split()

FILLER_SEEDS = ["lorem", "ipsum"]
#: A word is filler if so many of the texts that hold it also hold a seed, and at least so many do.
SEED_SHARE, SEED_TEXTS = 0.5, 2
FILLER_SHARE = 0.9

_CODE = r"(?:[1-5]\d\d)"
_REASON = r"(?:forbidden|not found|bad gateway|service unavailable|gateway time-?out|too many requests|internal server error|unauthorized|bad request|method not allowed|request timeout|gone|temporarily unavailable)"
_SCRIPTS = r"(?:java ?scripts?|scripts?|cookies)"
_DOING = r"(?:enable|activate|allow|turn on|switch on|aktivieren|activer|activez|active|activa|habilite|habilita|включите|enabled|required|disabled|switched off|deaktiviert|désactivés?|requires?|needs?)"

#: Whole pages, notices and outputs, matched from end to end in lower case (fixed patterns).
PAGES = [
    rf"(?:http )?(?:error|status|fehler|erreur|エラー|ошибка)?:? ?{_CODE}[ :：-]*{_REASON}[.!]?.{{0,60}}",
    rf"(?:error|fehler|erreur|エラー|ошибка|http error) ?{_CODE} ?[:：–-].{{1,80}}", rf"<(?:!doctype )?html.{{0,400}}", r"<noscript>.{0,300}</noscript>", r"<\?xml.{0,200}error.{0,200}",
    r"traceback \(most recent call last\).*", r"\{\s*\"(?:error|errors|message|code|status)\"\s*:.{0,300}\}", r"exception in thread .*", r"(?:fatal error|uncaught \w+|unhandled \w+|segmentation fault|panic):? ?.{0,200}",
    r"oops[!,.…]* ?(?:something|etwas|page).{0,120}", r"something went wrong.{0,120}", r"(?:sorry, )?(?:we can't find|the page|this page|page|the requested url|seite|la page|la página|страница)(?: you (?:requested|are looking for))? ?(?:could not be|was not|cannot be|isn't|not|nicht|n'existe|no|не) ?(?:found|available|gefunden|pas|encontrada|найдена).{0,120}",
    r"(?:erreur interne du serveur|interner serverfehler|error interno del servidor|errore interno del server|erro interno do servidor|внутренняя ошибка сервера|内部サーバーエラー|サーバーエラー|service (?:temporairement )?indisponible|dienst nicht verfügbar|servicio no disponible|сервис недоступен|サービス(?:は)?利用できません)[.!。]?.{0,60}", r"ページが見つかりません.{0,60}", r"request timed out.{0,60}", r"(?:connection|gateway|operation) (?:timed out|refused|reset).{0,60}", r"error establishing a database connection.{0,60}", r"upstream connect error.{0,200}", r"no healthy upstream.{0,60}",
    r"access denied[.!]?(?: you do(?:n't| not) have.{0,100}| reference.{0,100})?", r"(?:you do(?:n't| not) have|keine) (?:permission|berechtigung).{0,100}", r"(?:accès refusé|zugriff verweigert|acceso denegado|доступ запрещ[её]н|アクセスが拒否されました)[.!]?.{0,80}",
    r"(?:this|the requested|requested|dieser|ce|este) (?:content|page|video|article|item|resource|site|inhalt|contenu|contenido)(?: you requested)? (?:is|are|was|has been|could|cannot|can't|ist|n'est|no)(?: be)?(?: not| no longer| nicht mehr| nicht| plus| currently| temporarily| está)? ?(?:available|unavailable|removed|found|deleted|verfügbar|disponible|disponibile|accessible).{0,120}",
    r"(?:your )?session (?:has )?(?:expired|timed out)[.!]?.{0,60}", r"(?:please |you (?:must|need to) (?:be )?)(?:log|sign|logged|signed) ?in.{0,60}", r"(?:bitte (?:melden sie sich an|einloggen)|veuillez vous connecter|inicie sesión|ログインしてください).{0,60}",
    rf"(?:you need to |please |bitte |veuillez |por favor |пожалуйста,? )?{_DOING} (?:sie |los |le |les |el |la |your )?{_SCRIPTS}.{{0,90}}", rf"(?:this|our|the) (?:site|website|page|app|application) (?:requires|needs|uses|works only with).{{0,20}}{_SCRIPTS}.{{0,90}}",
    rf"{_SCRIPTS} (?:is|are|must be|needs? to be|ist|est|sont|está|を|отключ|не)(?: \w+)? ?{_DOING}?.{{0,90}}を?有効.{{0,40}}", rf"{_SCRIPTS} ?を有効にしてください.{{0,40}}", rf"(?:your browser is not supported|ihr browser wird nicht unterstützt|votre navigateur).{{0,120}}", rf"{_SCRIPTS} (?:is|are|must be|needs? to be) (?:disabled|required|switched off|turned off|enabled|blocked).{{0,90}}",
    r"(?:one moment|just a moment|bitte warten|un instant|please wait|un momento)[, ]*(?:please|s'il vous plaît|por favor)?[.…!]*(?: ?(?:checking|loading|verifying|redirecting|we are (?:checking|verifying|redirecting)).{0,100})?", r"checking (?:your browser|if the site|that you).{0,100}", r"(?:verify|prove|confirm) (?:that )?you are (?:a )?human.{0,60}",
    r"(?:this |the |notre |unsere? |le )?(?:site|website|seite|server|service) (?:is |ist |est )?(?:currently |derzeit |actuellement )?(?:down for |under |en |in |wegen )(?:maintenance|wartung|mantenimiento|manutenzione).{0,80}", r"(?:down for|scheduled|under) maintenance.{0,80}", r"en mantenimiento.{0,80}", r"メンテナンス中.{0,60}",
]

#: Filler and stand-ins as whole texts, in lower case (fixed patterns).
FILLERS = [
    r"lorem ipsum\b[^\d]*+",
    r"(?:(?:test|asdf|qwerty|qwer|foo|bar|baz|xxx+|blah?|abc|tbd|tba|nan(?!a)|n/?a|loading|undefined|null|none|dummy|sample|placeholder|untitled)[\s.,…!-]*+){3,}+\d*(?:[\s.,]*+(?:xxx+|test|asdf))*+", r"(?:null|undefined|nan|\[object object\]|<null>|\(null\)|none|nil)[.!]?", r"(?:[.…_*=~#-]{3,}+\s*+)++", r"loading ?(?:\.{3}|…)",
    r"(?:your|the|enter|insert|add|type)(?: your)? (?:own )?(?:text|content|message|title|description|copy)(?: goes)? here[.!]?", r"(?:dein|ihr) text hier[.!]?", r"(?:votre|insérez votre) texte ici[.!]?", r"(?:tu|su|escriba su) texto aquí[.!]?", r"text goes here[.!]?(?: \S+){0,4}", r"ここに(?:本文|テキスト|文章|内容|タイトル)を(?:入力|挿入|記入)してください[。.]?", r"(?:введите|ваш) текст(?: здесь)?[.!]?",
    r"insert .{1,40} (?:description|text|title|name|here)[.!]?", r"(?:this is (?:a )?)?(?:sample|dummy|placeholder|example|filler) (?:paragraph|text|content|copy|sentence)\b ?\d*[.!]?(?: ?(?:please )?(?:replace|change|edit|overwrite).{0,60})?", r"(?:beispieltext|platzhalter(?:text)?|mustertext|blindtext)[,:. ]*(?:bitte )?(?:ersetzen|hier)?[.!]?.{0,30}", r"texte? (?:d'exemple|de ejemplo|ejemplo|exemple|de remplissage)[,:. ]*.{0,40}",
    r"(?:todo|tbd|fixme|xxx)\s*[:：-]?\s*(?:write|add|insert|fill|complete|describe|replace|schreiben|écrire|escribir).{0,90}", r"\[(?:placeholder|insert|todo|tbd|your text|content|image|text)[^\]]{0,60}\]", r"(?:undefined|null|nan)(?:[ ,]++(?:undefined|null|nan))++[.!]?",
]

#: Outputs and pages of any length, told by how they are built (fixed patterns, lower case).
OUTPUTS = [
    r"traceback \(most recent call last\).*", r"<noscript>.*</noscript>", r"<\?xml.{0,2000}error.*", r"\{\s*\"errors?\"\s*:.*\}", rf"\{{\s*\"(?:message|code|status)\"\s*:(?=.*\"(?:errors?|exception|stack\w*|trace\w*)\"\s*:|.*\"(?:code|status\w*)\"\s*:\s*\"?[45]\d\d\b).*\}}",
    r"exception in thread (?:\"|\S+ \S*(?:exception|error)\b).*", r"(?:fatal error|uncaught \w+|unhandled \w+|segmentation fault|panic)(?::| \(| at ).*", r"(?:uncaught )?[\w.$]*(?:error|exception)\b(?=(?:.*? at [\w.$<>/]++ ?\([^()]++\)){2}).*",
]
#: What a title or heading of a long HTML page says if it is an error page; PAGES count too.
HEADINGS = [rf"(?:error |http )?[45]\d\d(?: error)?(?:[ :–|-]+.{{0,40}}(?:{_REASON}|unavailable|denied|time-?out|error).{{0,60}})?", r"attention required.{0,60}", r"(?:sorry, )?you have been blocked.{0,60}"]
#: Words of notices; a long notice has one for so many characters.
NOTICE = r"pages?\b|sites?\b|website|browsers?\b|server|request|\burl|error|java ?script|cookie|reload|refresh|try again|administrator|support|settings|\blog(?:ged)? ?in|\bsign(?:ed)? ?in|password|session|enable|access|permission|security|connection|maintenance|unavailable|available|verif|seite|anmeld|serveur|navigateur|página|navegador|сайт|страниц|браузер|ページ|サイト|ブラウザ"
NOTICE_EVERY = 200
#: The writer speaks, so the text is about a page; headings of pages that ask for the visitor are taken out first.
ASKED = r"(?:why|what|how|when) (?:have|has|did|do|can|should|am|was) i\b[^?]{0,80}\?"
SPEAKER = r"(?<![\w'])(?:i|i'm|i've|i'll|i'd|me|my|mine|ich|mir|mich|mein\w{0,2}|je|moi|mon|j'\w+|yo|mi|я|мне|меня|мой|моя)(?![\w'-])|私|僕|俺"

HAN = r"[\u3040-\u30ff\u3400-\u9fff]"
#: A text with neither of these holds no notation, blank or default. Both are quick to look for.
HINT = re.compile(r"[{}«$%<_*\[@X.(](?:(?<=[{}«$%])|(?<=<)[%<A-Z]|(?<=_)_|(?<=\*)\||(?<=\[)[\[A-Zpiyeo ]|(?<=@)@|(?<=X)X/|(?<=\.)\.\.\.|(?<=\() )")
HINT_WORDS = tuple("null undefined NaN nan N/A TBD Doe Mustermann /YY -YY .YY JJJJ AAAA 00/ 00- 00. First Last Middle Full Given Family Surn User Customer Client Company Recipient Sender Product Order Invoice Account Street City Vorn Nachn Kunden Firmen Empf Bestell Rechnungs".split())
SALUTED = [x for x in STRONG if "dear" in x]
#: What stands for a notation while a text is split, and the tokens of a text.
HOLE, STOP = "\ue000", frozenset(".!?。！？\n")
TOKEN = re.compile(rf"{HOLE}|[A-Za-z\u00c0-\u024f\u0400-\u04ff][\w'’-]*|\d[\d.,:/-]*\d|\d|[\u3040-\u309f]+|[\u30a0-\u30ff]+|[\u3400-\u9fff]+|[^\w\s]|\n|\w+")
SIGIL, OPEN = 1, 2


class Patterns:
    """The patterns compiled, once in a worker."""

    def __init__(self) -> None:
        either = lambda patterns: "|".join(f"(?:{p})" for p in patterns)
        self.strong = re.compile(either([*STRONG, *BRACES]))
        signs = either([*(x for x in STRONG if x not in SALUTED), *BRACES, *MARKED, *BLANKS])
        self.mark = re.compile(rf"(?=[{{<«$%#\[@_*X.(])(?:{signs})|(?=[A-Zbdhnu0])(?:{either([*SALUTED, *DEFAULTS])})|(?i:(?=[dhb])(?:{either(SALUTED)}))")
        self.marked = re.compile(either(MARKED))
        begins = f"(?:{either([*PAGES, *FILLERS, *OUTPUTS])})"
        self.begins, self.page = re.compile(begins, re.S), re.compile(begins + r"\Z", re.S)
        self.heading, self.headings = re.compile(r"<(?:title|h[1-3])\b[^>]*+> ?([^<]*[^< ]) ?</"), re.compile(f"(?:{either([*PAGES, *HEADINGS])})\\Z", re.S)
        self.html = re.compile("<(?:!doctype )?html")
        self.opening = re.compile(rf"(?:{either(PAGES)})(?<=[.!?。！…:])(?<!\d\.)(?: |(?={HAN}))", re.S)
        self.notice, self.asked, self.speaker = re.compile(NOTICE), re.compile(ASKED), re.compile(SPEAKER)

    def is_page(self, low: str) -> bool:
        """Short pages match from end to end. A long one is told by its build, an HTML page by its title and headings, and a long
        notice by an opening sentence that is a page of its own, the words of notices all along and nobody who speaks."""
        if not self.begins.match(low):  # most texts begin like no page
            return False
        if self.page.match(low):
            return True
        if self.html.match(low):
            return any(self.headings.match(h) for h in self.heading.findall(low))
        return bool(self.opening.match(low)) and sum(1 for _ in self.notice.finditer(low)) * NOTICE_EVERY >= len(low) and not self.speaker.search(self.asked.sub("", low))


@lru_cache(maxsize=1)
def patterns() -> Patterns:
    return Patterns()


def places(text: str, p: Patterns) -> tuple[list[tuple[str, str, int]], list[tuple[str, str]]]:
    """Surroundings, content and class of each notation, blank or default (STRONG ones have class 0; -SIGIL and -OPEN: a value belongs there by a
    salutation or form of address), and surroundings and content of each name and number. Places may share words."""
    held: list[str] = []
    cues: list[bool] = []
    if HINT.search(text) or any(w in text for w in HINT_WORDS):
        def hole(m: re.Match) -> str:
            held.append(m[0])
            cues.append(bool(SALUTATION.search(text, max(0, m.start() - 40), m.start()) or HONORIFIC.match(text, m.end())))
            return HOLE

        text = p.mark.sub(hole, text) if HOLE not in text else text
    tokens = TOKEN.findall(text)
    # 0: a word, 1: a name or number, 2: a notation
    kind = [2 if t == HOLE else 1 if t[0].isdigit() or (t[0].isupper() and t[0] < "\u3000") else 0 for t in tokens]
    marks, values, first, k, i, n = [], [], True, 0, 0, len(tokens)
    forms = ["\u25c7" if c else t.lower() for t, c in zip(tokens, kind, strict=True)]
    for i in range(n):  # a capital at the start of a sentence is no name
        if kind[i] == 1 and first and not tokens[i][0].isdigit() and not (i + 1 < n and kind[i + 1] == 1):
            kind[i], forms[i] = 0, tokens[i].lower()
        first = tokens[i] in STOP
    i = 0
    while i < n:
        if not kind[i]:
            i += 1
            continue
        end = i + 1
        while end < n and kind[end]:  # what stands side by side has the same surroundings
            end += 1
        left, right = [], []
        for j in (i - 1, i - 2):
            if j < 0 or tokens[j] in STOP:
                break
            left.append(forms[j])
        for j in (end, end + 1):
            if j >= n:
                break
            right.append(forms[j])
            if tokens[j] in STOP:
                break
        around = " ".join(left[::-1]) + " \u25c7 " + " ".join(right)
        if 2 in kind[i:end]:
            for turn in range(min(kind[i:end].count(2), len(held) - k)):
                what, cue = held[k], cues[k]
                k += 1
                kind_of = 0 if p.strong.fullmatch(what) else SIGIL if p.marked.fullmatch(what) else OPEN
                marks.append((f"{around} {turn}" if turn else around, what, -kind_of if cue else kind_of))
        elif any(f.isalpha() for f in left) or any(f.isalpha() for f in right):  # a word at least
            values.append((around, " ".join(tokens[i:end])))
        i = end
    return marks, values


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x) - (1 << 63)


def scanned(rows: DataFrame, keys: list[str], text: str, folded: bool = False) -> DataFrame:
    """One pass over the texts. ``what`` tells what a row says: ``found`` (a case by itself), ``mark`` (``around``, ``held``, ``n`` its class: to be
    decided), ``repeat`` (``around``: the masked text), ``plain`` (``words`` of a text that filler may be), and without keys
    ``marks`` and ``values`` (``lo``, ``hi``: least and greatest content at ``around`` within a batch)."""
    slim = rows.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("t"))
    slim = slim.where(" and ".join(f"k{i} is not null" for i in range(len(keys))) + r" and t rlike '(?U)\\S'")
    heads = ", ".join(f"k{i} {slim.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keys)))
    names = [*(f"k{i}" for i in range(len(keys))), "what", "around", "held", "n", "lo", "hi", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = patterns()
        for batch in batches:
            at: list[int | None] = []
            out: list[tuple] = []
            seen: tuple[dict[str, list[str]], dict[str, list[str]]] = ({}, {})

            def tell(row: int | None, what: str, around: int | None = None, held: str | None = None, n: int | None = None, lo: int | None = None, hi: int | None = None, words: list[str] | None = None) -> None:
                at.append(row)  # noqa: B023
                out.append((what, around, held, n, lo, hi, words))  # noqa: B023

            column = batch.column(len(keys))
            for row, form in enumerate((column if folded else canonical_column(column)).to_pylist()):
                low = " ".join(form.lower().split())
                marks, values = places(form, p)
                for side, pairs in ((0, [(a, h) for a, h, _ in marks]), (1, values)):
                    for around, held in pairs:
                        have = seen[side].get(around)
                        if have is None:
                            seen[side][around] = [held, held]
                        elif held < have[0]:
                            have[0] = held
                        elif held > have[1]:
                            have[1] = held
                if any(c <= 0 for *_, c in marks) or p.is_page(low):
                    tell(row, "found")
                elif marks:
                    for around, held, c in marks:
                        tell(row, "mark", _hash(around), held, c)
                elif FAILURE.match(low) and not p.speaker.search(low):
                    tell(row, "repeat", _hash(re.sub(r"\d+", "9", low)))
                if PLAIN.match(form):
                    words = sorted(set(WORD.findall(low)))
                    if len(words) > 1 or len(low) > 12:
                        tell(row, "plain", words=words)
            for side, what in ((0, "marks"), (1, "values")):
                for around, (lo, hi) in seen[side].items():
                    tell(None, what, _hash(around), lo=_hash(lo), hi=_hash(hi))
            picked = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([*picked, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return slim.mapInArrow(run, f"{heads}, what string, around bigint, held string, n int, lo bigint, hi bigint, words array<string>")


#: Texts of nothing but small letters, stops and spaces; their words.
PLAIN = re.compile(r"[^\W\d_][^\W\d_A-ZÀ-ÖØ-ÞА-Я]*+(?:[ ,.;\n]++[^\W\d_][^\W\d_A-ZÀ-ÖØ-ÞА-Я]*+){3,}+[ .\n]*+\Z")
WORD = re.compile(r"[^\W\d_]+")


def slots(forms: DataFrame, keys: list[str], text: str = "canonical") -> DataFrame:
    """``keys, around, held`` of each notation, blank or default in texts of canonical form: a hash of the words on either side, and what the place holds."""
    slim = forms.select(*keys, F.col(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, _hash(a), h) for i, t in enumerate(batch.column(len(keys)).to_pylist()) for a, h, _ in places(t or "", patterns())[0]]
            at = pa.array([i for i, *_ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keys))), pa.array([a for _, a, _ in found], pa.int64()), pa.array([h for *_, h in found], pa.string())], [*keys, "around", "held"])

    heads = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys)
    return slim.mapInArrow(run, f"{heads}, around bigint, held string")


def unfilled(scan: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of texts with a notation, blank or default that alignment shows to be a slot."""
    each = lambda what: scan.where(F.col("what") == what).groupBy("around").agg(F.min("lo").alias(f"{what}_lo"), F.max("hi").alias(f"{what}_hi"))
    marks = scan.where("what = 'mark'").select(*keys, "around", "held", "n")
    by = marks.join(each("marks"), "around", "left").join(each("values"), "around", "left")
    environment = (F.col("n") == SIGIL) & F.regexp_extract("held", r"(\w+)", 1).isin(ENVIRONMENT)
    several = lambda what: F.coalesce(F.col(f"{what}_lo") != F.col(f"{what}_hi"), F.lit(False))
    return by.where(several("marks") | (several("values") & ~environment)).select(*keys)


def _filler(plain: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of texts (``keys, words``) that are filler by the induced vocabulary."""
    seeded = F.arrays_overlap("words", F.array(*map(F.lit, FILLER_SEEDS)))
    each = plain.select(*keys, seeded.alias("seeded"), F.size("words").alias("of"), F.explode("words").alias("w"))
    vocabulary = each.groupBy("w").agg(F.count_if("seeded").alias("with_seed"), F.count("*").alias("texts")).where((F.col("with_seed") >= SEED_TEXTS) & (F.col("with_seed") >= SEED_SHARE * F.col("texts"))).select("w")
    held = each.join(vocabulary, "w").groupBy(*keys, "of").agg(F.count("*").alias("n"))
    return held.where(F.col("n") >= FILLER_SHARE * F.col("of")).select(*keys)


def filler_texts(forms: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of texts of canonical form that are filler by the induced vocabulary. Only texts of plain words and stops, the few that can be, are split."""
    ks = [f"k{i}" for i in range(len(keys))]
    found = _filler(scanned(forms, keys, "canonical", True).where("what = 'plain'").select(*ks, "words"), ks)
    return found.select(*[F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)])


def residue(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` of the rows whose text is residue, filler, an error page or a notice."""
    scan = cut(scanned(rows, keys, text))  # small, and read several times
    ks = [f"k{i}" for i in range(len(keys))]
    again = scan.where("what = 'repeat'")
    often = again.groupBy("around").agg(F.count("*").alias("c")).where(F.col("c") >= REPEATED)
    parts = [scan.where("what = 'found'").select(*ks), unfilled(scan, ks), again.join(often, "around", "left_semi").select(*ks), _filler(scan.where("what = 'plain'").select(*ks, "words"), ks)]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()
    return found.select(*[F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)])


def without_residue(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``rows`` without those of :func:`residue`; rows with a null key stay."""
    return rows.join(residue(rows, keys, text), keys, "left_anti")
