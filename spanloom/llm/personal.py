"""Problem 2: personal information inside free text.

Method: anchor expansion. An Aho-Corasick automaton finds at-signs, plus signs, street words and the cues that stand
before phones and identity numbers; deterministic local parsers expand from each anchor and validate what they find.
Names are expanded from given names and initials beside words that are built like surnames.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lookalike import fold
from ..functions.spans import STOPWORDS
from ..session import is_small
from .names import FORMS, NICKNAMES, edits, is_short_form, plain

KINDS = ("email", "phone", "identity_number", "street_address", "person_name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}

# What announces a phone, an identity number, a street; in lower case.
PHONE_CUES = ["tel.", "tel:", "tel ", "telephone", "telefon", "telefone", "teléfono", "téléphone", "phone", "ph.", "mob.", "mobile", "mobil", "cell", "fax", "t:", "t.:", "call ", "dial ", "ring ", "unter ", " au ", "appelez le ", "ligue para ", "llame al ", "拨打", "电话", "致电", "電話", "फ़ोन", "फोन", "الرقم", "هاتف", "ที่", "โทร"]
ID_CUES = ["id no.", "id number", "id card", "ssn", "social security", "tax number", "tax no.", "taxpayer", "tax id", "tin", "passport no.", "passport number", "passport", "national insurance", "nino", "cpf", "rg ", "nif", "dni", "nie", "documento", "pasaporte", "passaporte", "ausweisnr.", "ausweisnummer", "ausweis", "steuer-id", "steuernummer", "passnummer", "pièce d'identité", "carte d'identité", "passeport", "numéro fiscal", "n° de sécurité sociale", "证件号为", "证件号码", "证件号", "身份证号", "护照号", "旅券番号は", "旅券番号", "個人番号", "पासपोर्ट", "आधार", "जवाज", "جواز", "رقم الهوية", "الهوية", "บัตรประชาชน", "หนังสือเดินทาง", "เลขประจำตัว"]
STREETS_EN = ["street", "st.", "avenue", "ave", "road", "rd.", "rd", "lane", "ln.", "drive", "court", "square", "terrace", "close", "boulevard", "blvd", "way", "place", "row", "hill"]
STREETS_DE = ["straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer"]
STREETS_BEFORE = ["rue ", "avenue ", "boulevard ", "place ", "chemin ", "impasse ", "allée ", "quai ", "calle ", "c/ ", "avda. ", "av. ", "avenida ", "plaza ", "paseo ", "rua ", "travessa ", "largo ", "praça ", "alameda ", "estrada "]

L = "A-Za-zÀ-ÖØ-öø-ÿĀ-žƀ-ɏ"
U = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽ"
TOWN = rf"[{U}][{L}'’]+(?:[- ](?![A-Z]{{1,2}}\d)(?:(?:le|la|les|de|do|da|dos|am|an der|sur|del|upon)[- ])?[{U}][{L}'’]+){{0,2}}"
PROPER = rf"[{U}][{L}'’]+(?: [{U}][{L}'’]+)?"

EMAIL_LOCAL = re.compile(r"[A-Za-z0-9À-ž._%+'-]")
EMAIL_HOST = re.compile(r"[A-Za-z0-9À-ž-]+(?:\.[A-Za-z0-9À-ž-]+)+")
AT_WORD = re.compile(r"\s?[\[({]\s?(?:at|arroba|chez|bei)\s?[\])}]\s?", re.I)
SPELT_HOST = re.compile(r"[A-Za-z0-9-]+(?:\s?(?:[\[({]\s?)?(?:dot|punto|ponto|point|punkt)(?:\s?[\])}])?\s?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+", re.I)
PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d+(?:[ .\-/]\(?\d+\)?)*")
ID = re.compile(r"[A-Z]{1,2}(?:[ -]?\d{2}){3}[ -]?[A-Z](?![A-Za-z\d])|\d{2} \d{6} [A-Z] \d{3}(?!\d)|[A-Z]-?\d{7}-?[A-Z](?![A-Za-z\d])|\d{8}-?[A-Z](?![A-Za-z\d])|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{3}[- ]\d{2}[- ]\d{4}(?!\d)|\d \d\d \d\d \d\d \d{3} \d{3} \d\d(?!\d)|[A-Z]\d{1,2}[A-Z]?\d{4,8}(?!\d)|[A-Z]\d{6,9}(?!\d)|\d(?:[ ]?\d){8,17}(?!\d)|\d[\d .\-/]{6,18}\d(?!\d)|[A-Z\d]{8,12}(?![A-Za-z\d])")
ID_SHAPE = re.compile(r"(?:[A-Z]{2}(?: ?\d\d){3} ?[A-Z]|\d{2} \d{6} [A-Z] \d{3}|[A-Z]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{11}|\d{18}|\d{17}X|\d{3}[- ]\d{2}[- ]\d{4}|\d \d\d \d\d \d\d \d{3} \d{3} \d\d|\d{15}|[A-Z]\d{7,9}|[A-Z]\d\d[A-Z]\d{5}|\d{9})(?![\w-])")
PHONE_LINE = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d+(?:[ .\-/]\(?\d+\)?)*$")
BEHIND_PHONE_CUE = re.compile(r"[\s.:]{0,4}(?:(?:on|no\.?|nr\.?)\s)?")
BEHIND_ID_CUE = re.compile(r"[\s:.,]{0,3}(?:(?:no|nr|n|nº|number|is|ist|est|es|é|n\.º|n°)\b[.º:]?\s*){0,2}")
#: Phones in running text without plus or cue: an area code in brackets or with a leading zero, then groups.
BARE_PHONE = re.compile(r"(?<![\w.,/#-])(?:\(\d{2,4}\)[ -]?\d{3,4}[ .-]\d{3,4}|0\d{1,4}[ /-]\d{3,4}(?:[ -]\d{2,4}){0,2})(?![\w/-]|[.,]\d)")
#: "The number", "his number": a number that belongs to somebody, if it is built like one.
OWNER = re.compile(r"\b(?:the|his|her|their|my|your|our|ihre|seine|die|su|sus|el|o|seu|sua|le|son|sa|votre)\s$", re.I)
BEHIND_NUMBER = re.compile(r"[,:]?\s(?:is |was |ist |es |é |est )?")
#: "A caller on", "call us at": a phone, whatever it is built like.
CALLS = re.compile(r"(?:er|ers|s|ed|ing)?\s(?:(?:on|to|at|from|us|me|him|her|them|back)\s){1,2}(?=[\d(+])", re.I)
NUMBERED = re.compile(r"(?:सं|رقم|ล็อต|เลขที่|号|番号|\b(?:no|nr|nos|ref|lot|invoice|order|permit|art|rechnung|factura|fatura|facture)|n\.?[º°o]|#|§)[.:]?\s?$", re.I)
LABEL = re.compile(r"(?:t|tel|telefon|tél|teléfono|mob|mobil|mobile|phone|fax|ph)\s*[.:]*\s*$", re.I)

ADDRESS_EN = re.compile(rf"(?:(?:Flat|Apt\.?|Unit|Suite) \d+[A-Za-z]?, )?\d+[A-Za-z]? {PROPER} (?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Square|Sq\.?|Terrace|Close|Boulevard|Blvd\.?|Way|Place|Pl\.?|Row|Hill)(?:, (?:Apt|Flat|Unit|Suite|No)\.? ?\d+[A-Za-z]?)?,\s{TOWN}(?: [A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}}|,? [A-Z]{{2}} \d{{5}}| \d{{5}}(?:-\d{{4}})?)?")
ADDRESS_DE = re.compile(rf"(?<![{L}])(?:{PROPER}[- ]?)(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|Straße|Weg|Platz|Allee) \d+ ?[a-z]?(?:-\d+)?,\s\d{{5}} {TOWN}|(?<![{L}])(?:{PROPER}[- ]?)(?:straße|strasse|str\.|weg|gasse|allee|platz) \d+ ?[a-z]?,\s{TOWN}")
ADDRESS_FR = re.compile(rf"\d+(?: (?:bis|ter|quater))?,? (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai) (?:(?:de|du|des) |de la |de l')?{PROPER},\s(?:\d{{5}} )?{TOWN}", re.I)
ADDRESS_ES = re.compile(rf"(?:Calle|C/|Avda\.|Av\.|Avenida|Plaza|Paseo) (?:(?:de|del|la|las|los) )*{PROPER},? (?:n\.?º ?)?\d+(?:, \d+\.?[ºª] ?[A-Za-z]?)?(?:, (?:piso|esc\.) [\w.º]+)?,\s(?:\d{{5}} )?{TOWN}")
ADDRESS_PT = re.compile(rf"(?:Rua|Av\.|Avenida|Travessa|Largo|Praça|Alameda|Estrada) (?:(?:do|da|dos|das|de) )?{PROPER},? (?:n\.?º ?)?\d+(?:, (?:apto\.?|ap\.?|bloco|\d+\.º) ?[\w.]*)*,\s(?:\d{{4,5}}-\d{{3}} )?{TOWN}")
ADDRESSES = {"en": (ADDRESS_EN,), "de": (ADDRESS_DE,), "romance": (ADDRESS_FR, ADDRESS_ES, ADDRESS_PT)}

CAPITALS = "A-Z" + "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isupper())
#: Capitalised words: names, given names and initials; whatever stands between two of them is their gap.
WORD = re.compile(rf"(?<![{L}])(?<![{L}]['’-])[{CAPITALS}][{L}]*(?:['’-](?![sS](?![{L}]))[{L}]+)*")
# Words that places rather than people begin with.
PLACE_STARTS = set("san santa santo sao saint bad port porto puerto villa ville mont monte fort lake mount new old los las".split())
NOT_SURNAMES = {plain(w) for w in FORMS}


class Lexicon:
    """Given names with their short forms, and the letter triples of surnames."""

    def __init__(self, given: set[str], triples: set[str]):
        self.given = given | set(NICKNAMES) | {n for names in NICKNAMES.values() for n in names.split() if len(n) > 1}
        self.triples = triples
        self.by_start: dict[str, list[str]] = {}
        for g in self.given:
            self.by_start.setdefault(g[:1], []).append(g)
        self._given: dict[str, bool] = {}
        self._surname: dict[str, bool] = {}

    def given_rank(self, word: str) -> int:
        """3 for a given name as registered, 2 for its start, 1 for another short form or one edit away, 0 for none."""
        got = self._given.get(word)
        if got is None:
            w = plain(word)
            start = len(w) >= 3 and w not in PLACE_STARTS and w not in STOPWORDS["multi"] and any(g.startswith(w) and len(g) >= len(w) + 2 for g in self.by_start.get(w[0], ()))
            got = 3 if w in self.given else 2 if start else 1 if len(w) >= 3 and any(len(g) >= 4 and edits(w, g, 1) <= 1 or g[0] == w[0] and is_short_form(w, g) for g in self.given) else 0
            if len(self._given) < 200_000:
                self._given[word] = got
        return got

    def surname_share(self, word: str) -> float:
        """The share of a word's letter triples that occur in surnames; 0 for short words and those of businesses."""
        got = self._surname.get(word)
        if got is None:
            w = f"^{plain(word)}$"
            n = len(w) - 2
            hits = sum(w[i : i + 3] in self.triples for i in range(n))
            got = hits / n if len(word) >= 4 and plain(word) not in NOT_SURNAMES and hits >= 2 else 0.0
            if len(self._surname) < 200_000:
                self._surname[word] = got
        return got

    def fits(self, given: str, surname: str) -> bool:
        rank = self.given_rank(given)
        return rank > 0 and self.surname_share(surname) >= (0.34 if rank == 3 else 0.5 if rank == 2 else 0.55 if len(given) > 3 else 0.7)

    def is_surname(self, word: str) -> bool:
        return self.surname_share(word) >= 0.5


@lru_cache
def anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, cues in (("email", ["@", "(at)", "[at]", "( at )", "[ at ]", "{at}", "(arroba)", "[arroba]"]), ("phone", [*PHONE_CUES, "+"]), ("identity_number", ID_CUES), ("call", ["call"]), ("number", ["number", "nummer", "número", "numéro"]), ("en", STREETS_EN), ("de", STREETS_DE), ("romance", STREETS_BEFORE)):
        for cue in cues:
            kinds = a.get(cue, ()) if cue in a else ()
            a.add_word(cue, (*kinds[:0], kind, len(cue)))
    a.make_automaton()
    return a


def _email(s: str, start: int, end: int) -> tuple[int, int] | None:
    """An address around an at-sign or its spelling at [start, end)."""
    if s[start] != "@":
        m = AT_WORD.match(s, start - 1 if start and s[start - 1].isspace() else start)
        if not m:
            return None
        start, end = m.span()
    else:
        while start and s[start - 1] == " " and end < len(s) and s[end] == " ":
            start, end = start - 1, end + 1
    first = start
    while first and EMAIL_LOCAL.match(s, first - 1):
        first -= 1
    host = (SPELT_HOST if s[start:end].strip() != "@" or " " in s[start:end] else EMAIL_HOST).match(s, end) or EMAIL_HOST.match(s, end)
    if not host:
        return None
    text = s[first:start].lstrip(".+-'")
    a, b = start - len(text), host.end()
    return (a, b) if text and text[0].isalnum() else None


def _phone(s: str, at: int) -> tuple[int, int] | None:
    m = PHONE.match(s, at)
    if not m:
        return None
    a, b = m.span()
    if s[b - 1] == ")" and s[a:b].count(")") > s[a:b].count("("):
        b -= 1
    if "/" in s[a:b] and "." in s[a:b] or s[b : b + 1] in ("-", "/") and s[b + 1 : b + 2].isalnum():
        return None
    if 7 <= sum(c.isdigit() for c in s[a:b]) <= 15 and not (b < len(s) and (s[b].isalpha() and s[b].isascii())):
        return a, b
    return None


def personal_spans(text: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """[(start, end, kind)] in order, without overlaps."""
    s, at = fold(text)
    low = s.lower()
    if len(low) != len(s):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
    low = low.replace("\n", " ")  # cues run on over wrapped lines
    found: list[tuple[int, int, int, str]] = []  # priority, start, end, kind

    def add(kind: str, span: tuple[int, int] | None, priority: int) -> None:
        if span and span[1] > span[0]:
            found.append((priority, span[0], span[1], kind))

    near_address: list[tuple[int, str]] = []
    seen: dict[str, int] = {}
    for last, (kind, n) in anchors().iter(low):
        a, b = last - n + 1, last + 1
        if kind == "email":
            add("email", _email(s, a, b), 0)
        elif kind in ADDRESSES:
            near_address.append((a, kind))
        elif kind == "call":
            if (m := CALLS.match(s, b)) and not (a and s[a - 1].isalpha()):
                add("phone", _phone(s, m.end()), 2)
        elif kind == "number":
            if (m := BEHIND_NUMBER.match(s, b)) and OWNER.search(s, max(0, a - 8), a):
                if got := ID_SHAPE.match(s, m.end()):
                    add("identity_number", got.span(), 3)
                elif m.end() < len(s) and (s[m.end()].isdigit() or s[m.end()] in "+("):
                    add("phone", _phone(s, m.end()), 3)
        elif kind == "phone":
            if s[a] == "+":
                if b < len(s) and s[b].isdigit() and not (a and (s[a - 1].isalnum() and s[a - 1].isascii())):
                    add("phone", _phone(s, a), 2)
            elif not (a and low[a - 1].isalpha() and low[a].isalpha() and low[a].isascii() and low[a - 1].isascii()):
                if low[a:b] == "ที่" and low[max(0, a - 3) : a] == "เลข":
                    continue
                m = BEHIND_PHONE_CUE.match(s, b)
                p = m.end() if m else b
                if p < len(s) and (s[p].isdigit() or s[p] in "+("):
                    add("phone", _phone(s, p), 2)
        elif not (a and low[a - 1].isalpha() and low[a].isascii() and low[a - 1].isascii()) and (b >= len(s) or not (low[b - 1].isascii() and low[b - 1].isalpha() and low[b].isalpha() and low[b].isascii())):
            m = BEHIND_ID_CUE.match(s, b)
            p = m.end() if m else b
            got = ID.match(s, p)
            if got and sum(c.isdigit() for c in got.group()) >= 6:
                add("identity_number", got.span(), 1)
    for a, group in near_address:
        if a >= seen.get(group, -1):
            # the whole paragraph, however long, and once for each kind of anchor
            low_end = s.rfind("\n\n", 0, a) + 1
            seen[group] = high_end = (s.find("\n\n", a) + 1 or len(s) + 1) - 1
            for pattern in ADDRESSES[group]:
                for m in pattern.finditer(s, low_end, high_end):
                    add("street_address", m.span(), 1)
    # lines that hold nothing else
    place = 0
    for line in s.split("\n"):
        t = line.strip()
        if 7 <= len(t) <= 32 and any(map(str.isdigit, t)):
            a = place + line.index(t)
            if ID_SHAPE.fullmatch(t) and not t.startswith("0") or ID_SHAPE.fullmatch(t) and re.search(r"[.A-Z-]", t):
                add("identity_number", (a, a + len(t)), 3)
            elif PHONE_LINE.fullmatch(t) and 7 <= sum(c.isdigit() for c in t) <= 15 and not re.fullmatch(r"\d{3}-\d{3}-\d{4}-\d|\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}-\d\d-\d\d", t):
                add("phone", (a, a + len(t)), 4)
        place += len(line) + 1
    for m in BARE_PHONE.finditer(s):
        if not NUMBERED.search(s, max(0, m.start() - 12), m.start()):
            add("phone", _phone(s, m.start()), 4)
    # phones that follow an email or stand in brackets with one
    for _, a, b, kind in list(found):
        if kind == "email":
            m = re.compile(r"\s*[;,]\s*").match(s, b)
            if m and m.end() < len(s) and (s[m.end()].isdigit() or s[m.end()] in "+("):
                add("phone", _phone(s, m.end()), 2)
            m = re.search(r"\(?\+?\d[\d ().\-/]{5,20}\s*[;,]\s*$", s[max(0, a - 30) : a])
            if m:
                add("phone", _phone(s, max(0, a - 30) + m.start()), 2)
    for a, b in _names(s, lexicon):
        add("person_name", (a, b), 5)
    found.sort(key=lambda x: (x[0], x[1] - x[2], x[1]))
    taken: list[tuple[int, int, str]] = []  # disjoint, in order
    for _, a, b, kind in found:
        k = bisect_left(taken, (b,))
        if not k or taken[k - 1][1] <= a:
            taken.insert(k, (a, b, kind))
    if at is None:
        return taken
    return [(at[a], at[b - 1] + 1 if at[b - 1] + 1 >= at[b] or s[b - 1].isspace() else _end(text, at, b), k) for a, b, k in taken]


def _end(text: str, at: list[int], b: int) -> int:
    """End in the original of a span whose last character may carry marks."""
    e = at[b - 1] + 1
    while e < at[b] and "̀" <= text[e] <= "ͯ":
        e += 1
    return e


GAP = re.compile(r"[ \n]+")
COMMA = re.compile(r",[ \n]+")
#: What may stand right before an initial.
BEFORE_INITIAL = re.compile(r"(?:^|[^\d/°.&\w-][\s]|[^\w/°.&\d-]|[\u0590-\uffff]|[^\W\d_]{2}[.,]?\s|[\])»”\"?!]\s)$")
# The commonest Chinese surnames; the characters that Japanese surnames are commonly made of.
SURNAMES_ZH = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩邓冯曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常汤康易乔赖文施洪季柳温殷庄章鲁葛俞"
DOUBLE_ZH = "欧阳 司马 诸葛 上官 夏侯 东方 皇甫 尉迟 公孙 慕容 司徒 令狐 端木 南宫".split()
SURNAMES_JA = "高見沢澤田中山川野村木林森井上下本藤原島松石岡橋口崎谷池小大西東南北宮水青赤黒白金吉福安新古平清竹梅杉桜柳橘菅関渡辺邊斎斉佐伊加後近遠工内丸千五十三八永長武土堀河浜浅今秋星桑服部秦神滝横荒馬矢飯富堤岸畑久世片桐榊保宇江戸手塚笠須根津仲児玉相柴稲葉茂菊柏樫熊猪鈴鶴亀鳥鷹鹿牧浦沖波湯泉瀬湊笹篠栗梶榎柿桃花草芦荻萩蓮門辻町大小杉若芳望緒尾沼堺沢嶋嶺庄倉蔵"
#: What stands before and behind a Chinese name: marks, and characters that only join words or speak of what a person does.
BEFORE_ZH = r"(?:(?<![一-鿿㐀-䶿])|(?<=[与和跟由向对给被让请问是及为找致将把说道人员士师生理有天日后前]))"
BEHIND_ZH = r"(?![一-鿿㐀-䶿])|(?=[与和在的于说道问答代低签称认告负女先将已曾是向对从，。])"
GIVEN_ZH = r"[^\W\d_\x00-\u4dff\ua000-\U0010ffff与和在的于说道问是为将已向对从把被了不年月日号元方]"
NAME_ZH = re.compile(rf"{BEFORE_ZH}(?:(?:{'|'.join(DOUBLE_ZH)}){GIVEN_ZH}{{1,2}}|[{SURNAMES_ZH}]{GIVEN_ZH}{{2}})(?:{BEHIND_ZH})")
#: Two characters are a name only between marks or particles of people.
PAIR_ZH = re.compile(rf"(?:(?<=[与和跟由向对给])|(?<![一-鿿]))[{SURNAMES_ZH}]{GIVEN_ZH}(?=与[^。]{{1,12}}在|[说问答道]|代表|低声|签字|的证件|女士|先生|，电话)")
#: A Japanese name: a stretch of Han characters that begins like a surname, up to a particle, a title or a mark.
NAME_JA = re.compile(rf"(?<![一-鿿々ァ-ヿ])[{SURNAMES_JA}々]{{2}}[一-鿿々]{{1,4}}(?<![号社日年月額書会所部課県市町港約件品度分時条量間人者円場的用])(?=[がはとのをにもへさ、。様氏殿」（(]|$)", re.M)
KANA = re.compile(r"[ぁ-ヿ]")


def _han_names(s: str) -> Iterator[tuple[int, int]]:
    """Chinese names by their surname and Japanese ones by how surnames are made, between what may stand around them."""
    if not HAN.search(s):
        return
    if KANA.search(s):
        yield from (m.span() for m in NAME_JA.finditer(s))
    else:
        yield from (m.span() for m in NAME_ZH.finditer(s))
        yield from (m.span() for m in PAIR_ZH.finditer(s))


HAN = re.compile(r"[一-鿿]")


def _names(s: str, lexicon: Lexicon) -> Iterator[tuple[int, int]]:
    """Given name or initials before a surname, a surname before a comma and those, or a surname in capitals before a given name."""
    words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(s)]
    n = len(words)
    used = -1
    french = " a sign" in s or " le " in s and " la " in s and " et " in s

    def gap(i: int, kind: str) -> bool:
        """Whether words i and i+1 are joined: by a blank, by an initial's stop and a blank, or by a comma."""
        if i < 0 or i + 1 >= n:
            return False
        t = s[words[i][1] : words[i + 1][0]]
        if len(t) > 4 or "\n\n" in t:
            return False
        if kind == "blank":
            return GAP.fullmatch(t) is not None
        if kind == "stop":
            return t in (". ", ".\n", ".", " ")
        return COMMA.fullmatch(t) is not None

    def initial(i: int) -> bool:
        return 0 <= i < n and len(words[i][2]) == 1 and words[i][2].isupper() and s[words[i][1] : words[i][1] + 1] == "."

    def capital(i: int) -> bool:
        return 0 <= i < n

    for i in range(n):
        a, b, w = words[i]
        if a < used or len(w) < 4:
            continue
        share = lexicon.surname_share(w)
        if share < 0.34:
            continue
        sure = share >= 0.5
        start, end = a, None
        # surname first, after which a comma or letter case tells that the given name follows
        if sure and gap(i, "comma") and i + 1 < n and not (i and s[a - 2 : a] in ("& ", "+ ")):
            k = i + 1
            if initial(k):
                end = words[k][1] + 1
                while initial(k + 1) and gap(k, "stop"):
                    k += 1
                    end = words[k][1] + 1
                if k + 1 < n and gap(k, "stop") and capital(k + 1) and lexicon.surname_share(words[k + 1][2]) >= 0.75:
                    end = None
            elif capital(k) and lexicon.fits(words[k][2], w):
                end = words[k][1]
                if initial(k + 1) and gap(k, "blank"):
                    end = words[k + 1][1] + 1
                elif k + 1 < n and gap(k, "blank") and capital(k + 1) and lexicon.is_surname(words[k + 1][2]):
                    end = None
            if end and i and s[words[i - 1][1] : a] == " " and capital(i - 1) and (lexicon.fits(words[i - 1][2], w) or lexicon.is_surname(words[i - 1][2])):
                end = None
        elif sure and w.isupper() and gap(i, "blank") and capital(i + 1) and not words[i + 1][2].isupper() and lexicon.fits(words[i + 1][2], w) and not (i and gap(i - 1, "blank") and words[i - 1][2].isupper() and lexicon.fits(words[i - 1][2], w)):
            end = words[i + 1][1]
            if initial(i + 2) and gap(i + 1, "blank"):
                end = words[i + 2][1] + 1
        if end is None:
            j = i - 1
            while initial(j) and gap(j, "stop") and i - j <= 2:
                j -= 1
            had = i - 1 - j
            if capital(j) and len(words[j][2]) > 1 and gap(j, "blank") and lexicon.fits(words[j][2], w) and (not had or len(words[j][2]) > 2):
                start, end = words[j][0], b
            elif had and sure:
                first = j + 1
                if french and had > 1 and words[first][2] == "M":
                    first += 1
                while first < i:
                    p = words[first][0]
                    lead = s[max(0, p - 4) : p]
                    free = lead[-1:] == "\n" or BEFORE_INITIAL.search(lead) and not re.search(r"\d\s$", lead) or "\u0e00" <= s[b : b + 1] <= "\u0e7f"
                    if s[p:a].rstrip() != "S.A." and (free or first > j + 1):
                        start, end = p, b
                        break
                    first += 1 if s[p:a].rstrip() != "S.A." else 2
            if end is not None and s[max(0, start - 2) : start] in ("& ", "+ "):
                end = None
        if end is not None:
            used = end
            yield start, end
    yield from _han_names(s)


def lexicon_of(parties: DataFrame) -> Lexicon:
    """Given names and surname triples of the registered persons; both are read as sets.

    The triples are bounded by the alphabet, the given names by a checked count.
    """
    persons = parties.filter("party_class = 'person' and legal_name is not null").select("legal_name")
    given = persons.select(F.split("legal_name", " ")[0].alias("w")).distinct()
    if not is_small(given):
        raise ValueError("too many distinct given names for a lexicon")

    def cut_triples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = set()
            for name in b.legal_name:
                for part in plain(name).split()[-1:]:
                    w = f"^{part}$"
                    out.update(w[i : i + 3] for i in range(len(w) - 2))
            yield pd.DataFrame({"t": sorted(out)}, dtype=object)

    triples = persons.mapInPandas(cut_triples, "t string").distinct()
    if not is_small(triples):
        raise ValueError("too many letter triples of surnames for a lexicon")
    triples = {r.t for r in triples.collect()}
    return Lexicon({plain(r.w) for r in given.collect()}, triples)


def personal_information(docs: DataFrame, parties: DataFrame, id_col: str = "document_key", text_col: str = "text") -> DataFrame:
    """(document_key, pii_kind, start_pos, end_pos): one row per span; spans of a text don't overlap.

    Null ids and texts and empty texts give no rows, a repeated row gives its spans again; without registered persons no
    names are found but those that script and frame give away; other columns are ignored; an empty table gives an empty
    result. One pass, no shuffle; whole texts are read, whatever their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon_of(parties))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, kind, s, e) for key, text in zip(b.id, b.text) for s, e, kind in personal_spans(text, shared.value)]
            yield pd.DataFrame(rows, columns=["document_key", "pii_kind", "start_pos", "end_pos"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    return rows.mapInPandas(scan, "document_key long, pii_kind string, start_pos int, end_pos int")


def redacted(docs: DataFrame, parties: DataFrame, id_col: str = "document_key", text_col: str = "text") -> DataFrame:
    """(document_key, text, n_spans): every text with its personal information replaced by typed placeholders."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon_of(parties))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b.id, b.text):
                spans = personal_spans(text, shared.value) if text else []
                out, last = [], 0
                for s, e, kind in spans:
                    out += [text[last:s], PLACEHOLDER[kind]]
                    last = e
                rows.append((key, "".join([*out, text[last:]]) if text is not None else None, len(spans)))
            yield pd.DataFrame(rows, columns=["document_key", "text", "n_spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    return rows.mapInPandas(scan, "document_key long, text string, n_spans int")


def found(annotated_docs: DataFrame, parties: DataFrame) -> DataFrame:
    """(document_key, pii_kind, start_pos, end_pos); spans of a text don't overlap, so each is there once."""
    return personal_information(annotated_docs, parties)
