"""Problem 3: sentence boundaries across languages and scripts.

Method: cascading segmentation rule tables. A text is first cut into blocks of lines (headings, list items, table rows,
signatures, contact lines and codes stand alone; wrapped lines are put together), then at each possible boundary the
ordered break and no-break pairs of regular expressions of the text's language are tried, and the first that matches
before and after the place decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lookalike import fold

# Words that a full stop follows without ending the sentence; by language, '' for all.
ABBREVIATIONS = {
    "": "Dr Drs Dra Prof Profa Mr Mrs Ms St Ste Sr Sra Srta Hr Fr Mme Mlle MM Capt Gov Gen Col Lt Sgt Rev Hon Jr no No nos Nos Nr nr núm cf Cf Art art Arts arts Sec sec Fig fig Vol vol pp pág págs Pág p para paras ref Ref Réf réf approx aprox incl vs i.e e.g tel Tel Mob Fax Az al env ca Apt temp ed eds dept Dept n n.º",
    "en": "att attn Pt Messrs Mt Ft Ave Blvd viz resp",
    "de": "att Abs gem bzw vgl Vgl Hrn Str z.B z. d.h d. u.a u. Tsd Mio Mrd evtl ggf inkl zzgl Nrn Ziff lfd",
    "fr": "Me Mgr av bd chap éd env. p.ex",
    "es": "Ud Uds Av Avda Ctra dpto p.ej ej Excmo Ilmo izq dcha",
    "pt": "Exmo Exma Av Lda inc Inc. séc pg cap V.Sa Ilmo",
    "hi": "डॉ सं रु श्री क्र प्रो",
    "ar": "د أ م ص",
}
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Sept Oct Nov Dec"
GERMAN_MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember"
COMPANY = "Firma Gesellschaft Unternehmen Company Messrs Empresa Sociedad Sociedade Société Compagnie"
FORMS = "Ltda Ltd Limited Limitada Incorporated Inc Corporation Corp LLC L.L.C GmbH G.m.b.H Aktiengesellschaft A.G AG Sociedade S.A S/A SA"

END = r"(?:\.{2,}|…+|[.!?؟।。！？]+)"
CLOSE = r"(?:[\"'”“’»)\]]|[   ]»)*"
HAN = re.compile(r"[぀-ヿ㐀-鿿]")
THAI = re.compile(r"[฀-๿]")
NO_CASE = re.compile(r"[؀-ۿऀ-ॿ฀-๿぀-ヿ㐀-鿿]")


def _words(s: str) -> str:
    return "|".join(re.escape(w) for w in sorted(s.split(), key=len, reverse=True))


UPPER = r"A-ZÀ-ÖØ-ÞĀĆĈĊČĎĐĒĔĖĘĚĞĠŁŃŇŌŐŒŘŚŞŠŤŪŮŰŹŻŽ"
#: A capitalised name of a business: a word, perhaps another joined to it, and a last word.
BUSINESS = rf"[{UPPER}]\w+ (?:[&+ey] \w+ )?[{UPPER}]\w+"


def rules(lang: str) -> list[tuple[bool, str, str]]:
    """The ordered table of a language: (break?, what stands before the place, what stands after it); \\A is the start of
    the block. However far back a rule looks, it sees all of the block."""
    short = ABBREVIATIONS[""] + " " + ABBREVIATIONS.get(lang, "")
    spelt = r"(?:S\.A|A\.G|L\.L\.C|G\.m\.b\.H)\."
    table = [
        # an ellipsis ends a unit only before a capital letter
        (False, r"(?:\.{2,}|…)" + CLOSE, rf"\s*(?:[^\W\d_{UPPER}]|[,;:\d(–-])"),
        (True, r"(?:\.{2,}|…)" + CLOSE, r"\s*\S"),
        # a mark inside a word or number
        (False, r"[.!?]" + CLOSE, r"[^\s]"),
        # the frame goes on
        (False, "", r"\s+[,;:]?\s*(?:[a-zß-öø-ÿāćčďđēęěğłńňőœřśşšťūůűźżž]|[α-ω])"),
        (False, r"[.!?]", r"\s*[,;)\]]"),
        # list markers
        (False, r"\A\s*(?:\(?\d{1,3}|\(?[a-z]|[ivx]{1,4})[.)]", ""),
        # titles and other words that a full stop only shortens
        (False, rf"(?<![^\W\d_])(?:{_words(short)})\.", ""),
        (False, rf"(?<![^\W\d_])(?:{_words(MONTHS)})\.", r"\s+\d"),
        (False, r"(?<!\w)M\.", r"\s+\S"),
        (False, r"\.", r"\s+[\u0900-\u097f\u0600-\u06ff]") if lang == "hi" else (False, rf"(?<![^\W\d_])(?:{_words(FORMS)})\.", r"\s+[\u0600-\u06ff]"),
        (True, r"\b[ap]\.\s?m\.[\"”»)]*", r"\s"),
        # a form put before the name (no name stands before it, or a word for a company), then one that ends a sentence
        (False, rf"(?<!')(?:(?<![{UPPER}][\w'’-]{{1,40}}[ \n])|(?<=\b(?:{_words(COMPANY)})\s)){spelt}", rf"\s+{BUSINESS}"),
        (True, spelt, r"\s+\S"),
        # initials, not the last letter of a number
        (False, r"(?:\A|(?<!\d)[\s(\"«„“.¡¿])[^\W\d_]\.", r"\s+[^\W\d_]"),
        (False, r"[\u0590-\uffff][A-Z]\.", r"\s+[^\W\d_]"),
        # a business's shortened kind before its form; a longer word may be a town, and the form the next name's
        (False, r"(?<![^\W\d_])[^\W\d_a-zß-ÿ][^\W\d_]{1,4}\.", rf"\s+(?i:{_words(FORMS)})(?![A-Za-zÀ-ÿ])"),
        (False, r"(?<![^\W\d_])[^\W\d_a-zß-ÿ][^\W\d_]{5,8}\.", rf"\s+(?i:{_words(FORMS)})(?![A-Za-zÀ-ÿ])(?!\.?\s{BUSINESS})"),
    ]
    if lang == "de":
        table[4:4] = [(False, r"(?<!\d)\d{1,2}\.", rf"\s+(?:{_words(GERMAN_MONTHS)})\b"), (False, r"(?:\w{3,}nr|(?<!\w)S)\.", r"\s+[\w(]")]
    return [*table, (True, "", "")]


@lru_cache
def _decision(lang: str) -> regex.Pattern:
    """The table as one alternation behind the marks: the first pair that fits decides; group ``on`` is no break."""
    pairs = [f"(?<={left})(?={right})" + ("" if breaks else "(?P<on>)") for breaks, left, right in rules(lang)]
    return regex.compile(r"(?V0)(?:[。！？]+[”’」』）\"]*(?P<wide>)|(?:\.{2,}|…+|[.!?؟।]+)" + CLOSE + "(?:" + "|".join(pairs) + "))")


MARKER = re.compile(r"\s*(?:[-•*‣▪–]\s|\((?:\d{1,3}|[a-z]|[ivx]{1,4})\)\s|\d{1,3}[.)]\s|(?:[a-z]|[ivx]{2,4})\)\s)")
SIGNATURE = re.compile(r"\s*/s/")
CONTACT = re.compile(r"\s*(?:T|Tel|Mob|Fax|Phone|Ph|Mobile|E|e-?mail|E-?mail|Correo|Courriel)\s?[.:]?\s+\S*[\d@(+]|\s*(?:T|Tel|Mob|E|e-?mail)[.:]?\s+\S+(?:@|\s?[\[(]at[\])])", re.I)
BARE_PHONE = re.compile(r"[\d\s()+./–-]{5,}$")
BARE_MAIL = re.compile(r"\S+(?:@|\s?[\[(]at[\])]\s?)\S+(?:\s(?:dot|punto|ponto|point)\s\S+)*$")
CODE = re.compile(r"\S+$")
CLOSED = re.compile(r"(?:[.!?…。！？؟।]|[:;；])" + CLOSE + r"\s*$")
SHORTENED = re.compile(rf"(?<![^\W\d_])(?:{_words(' '.join(ABBREVIATIONS.values()))}|\w{{3,}}nr)\.\s*$")
NAME = re.compile(r"(?:[^\W\d_]\.|[^\W\d_a-z][^\W\d_'’-]*(?:[-'’][^\W\d_]+)*,?)(?:\s+(?:[^\W\d_]\.|[^\W\d_a-z][^\W\d_'’-]*(?:[-'’][^\W\d_]+)*,?)){1,3}$")
LOWER = re.compile(r"(?<![\w.'’])[a-zà-ÿ]{2,}")
STREET_WORDS = set("rue avenue av bd boulevard place chemin bis ter de do da dos das del la le les des du piso esc".split())


def _is_table(line: str) -> bool:
    return "\t" in line or " | " in line


def _is_code(line: str) -> bool:
    s = line.strip()
    return " " not in s and (len(s) > 30 or any(ch.isdigit() for ch in s)) and not CLOSED.search(s)


def _is_identity(line: str) -> bool:
    s = line.strip()
    return len(s) <= 32 and sum(ch.isdigit() for ch in s) >= 5 and re.fullmatch(r"(?:[A-Z]{0,3}[\d.\-/ ]+[A-Z]{0,2}[\d.\-/ ]*[A-Z]?|[A-Z\d/.-]+)", s) is not None


def _is_address(line: str) -> bool:
    s = line.strip()
    if len(s) > 75 or not any(ch.isdigit() for ch in s) or CLOSED.search(s) and not s.endswith(("B", "A")):
        return False
    return all(w in STREET_WORDS for w in LOWER.findall(s)) and len(s.split()) >= 3 and s[0] not in "(/"


def _is_heading(line: str) -> bool:
    s = line.strip()
    return len(s) <= 34 and len(s.split()) <= 5 and not CLOSED.search(s) and "," not in s and (not s[0].islower())


def _alone(line: str) -> bool:
    return _is_table(line) or SIGNATURE.match(line) is not None or CONTACT.match(line) is not None or _is_code(line) or _is_identity(line) or BARE_PHONE.fullmatch(line.strip()) is not None or BARE_MAIL.fullmatch(line.strip()) is not None


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole): stretches of lines that belong together; ``whole`` ones are units as they stand."""
    lines: list[tuple[int, int]] = []
    at = 0
    for raw in text.split("\n"):
        lines.append((at, at + len(raw)))
        at += len(raw) + 1
    lengths = sorted(len(text[a:b].rstrip()) for a, b in lines if b > a)
    long_lines = [n for n in lengths if n >= 45]
    wrapped = len(long_lines) >= 2 and lengths[-1] <= 130
    width = long_lines[int(len(long_lines) * 0.9) if len(long_lines) > 3 else -1] if wrapped else 0
    out: list[tuple[int, int, bool]] = []
    start = -1
    before = ""
    first = True
    for a, b in lines:
        line = text[a:b]
        if not line.strip():
            start, before = -1, ""
            continue
        if first:
            first = False
            if not CLOSED.search(line) and len(line) <= 60 and any(ch.isdigit() for ch in line):
                out.append((a, b, True))
                start, before = -1, ""
                continue
        marked = MARKER.match(line) is not None
        alone = _alone(line)
        joins = False
        if start >= 0:
            closed = CLOSED.search(before) is not None and not SHORTENED.search(before)
            token = line.split(None, 1)[0]
            full = wrapped and len(before.rstrip()) + 1 + len(token) > width
            if NO_CASE.search(before) and not LOWER.search(before):
                joins = False
            elif MARKER.match(text[start:b]) is not None and out[-1][2]:
                joins = full and not closed and not marked and not alone
            elif marked and (closed or not re.match(r"\s*[\d(]", line)):
                joins = False
            elif _is_table(line) or SIGNATURE.match(line) or CONTACT.match(line) and not before.rstrip().endswith(","):
                joins = False
            elif SHORTENED.search(before):
                joins = True
            elif closed:
                joins = not (alone or NAME.match(line.strip()) or _is_address(line) or (_is_heading(line) and not full))
            else:
                joins = full or not alone or CLOSED.search(line) is not None
        if joins:
            s, _, whole = out[-1]
            out[-1] = (s, b, whole)
            before = line
            continue
        whole = marked or alone
        out.append((a, b, whole))
        single = alone or (not CLOSED.search(line) and (NAME.match(line.strip()) is not None or _is_address(line) or _is_heading(line)))
        if single and not marked:
            out[-1] = (a, b, not NO_CASE.search(line))
            start, before = -1, ""
        else:
            start, before = a, line
    return out


#: How many characters of Thai tell what begins there, and behind a name what goes on.
THAI_KEY, THAI_VERB = 4, 3
#: What begins a line so often, and makes up such a share of its occurrences behind blanks, begins clauses.
THAI_LEAST, THAI_SHARE = 2, 0.04
#: Words that commonly begin a Thai clause; used where no corpus tells.
THAI_WORDS = "เขา เรา ผม ฉัน คุณ ใคร และ แต่ เมื่อ หาก ถ้า เพราะ ดังนั้น การ ผู้ นาย นาง โปรด กรุณา".split()
#: Words that lead on to what follows, so that no clause ends behind them.
THAI_LEADS = re.compile(r"(?:คือ|ชื่อ|ถึง|ที่|โดย|ของ|จาก|และ|หรือ|กับ)$")
LATIN_NAME = re.compile(r"[^\W\d_฀-๿]+, [^\W\d_฀-๿]+\.?|(?:[^\W\d_฀-๿]+\.? )?(?:[^\W\d_]\. )*[^\W\d_฀-๿]+")


def thai_key(s: str, at: int) -> str | None:
    """What tells whether a clause begins at a place: its first Thai characters, or those behind a name after a star."""
    if THAI.match(s, at):
        return s[at : at + THAI_KEY]
    name = LATIN_NAME.match(s, at)
    return "*" + s[name.end() : name.end() + THAI_VERB] if name and THAI.match(s, name.end()) else None


def thai_places(text: str) -> Iterator[tuple[str, bool]]:
    """(key, whether it begins a line) of the beginnings of lines and of what stands behind blanks."""
    for line in text.split("\n"):
        line = line.strip()
        if THAI.search(line):
            if key := thai_key(line, 0):
                yield key, True
            yield from ((key, False) for m in re.finditer(r" +", line) if (key := thai_key(line, m.end())))


def thai_starts(docs: DataFrame, text_col: str = "text") -> frozenset[str]:
    """The keys that begin clauses, told by how often they begin lines in the whole corpus.

    Counts combine before their exchange. What is read to the driver is bounded by the shares: no key has less than
    one in a thousand of the places that count.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: dict[str, list[int]] = {}
            for text in b.text:
                for key, first in thai_places(fold(text)[0]):
                    counts.setdefault(key, [0, 0])[not first] += 1
            yield pd.DataFrame([(k, *n) for k, n in counts.items()], columns=["key", "first", "inner"])

    rows = docs.select(F.col(text_col).alias("text")).filter(F.col("text").rlike("[\u0e00-\u0e7f]")).mapInPandas(scan, "key string, first long, inner long")
    counts = rows.groupBy("key").agg(F.sum("first").alias("first"), F.sum("inner").alias("inner"))
    total = counts.agg(F.sum("first").alias("n")).first()["n"] or 0
    keep = counts.filter((F.col("first") >= max(THAI_LEAST, total / 1000)) & (F.col("first") >= THAI_SHARE * (F.col("first") + F.col("inner"))))
    return frozenset(r.key for r in keep.select("key").collect())


def _thai_breaks(s: str, starts: frozenset[str] | None) -> list[int]:
    """Places after blanks where a new clause begins: before what begins lines elsewhere, a name with what follows it
    included, or before a name that meets another at the end of a clause."""
    out = []
    for m in re.finditer(r" +", s):
        rest = m.end()
        key = thai_key(s, rest)
        begins = key in starts if starts is not None else s.startswith(tuple(THAI_WORDS), rest)
        before = s[: m.start()]
        if key and begins and not THAI_LEADS.search(before):
            if not key.startswith("*") or THAI.match(before[-1:]) or before[-1:] in "?!)" or before[-1:].isdigit():
                out.append(m.start())
            elif "คือ" in (clause := before[out[-1] if out else 0 :]):
                # two names meet: the first belongs to the clause before
                had = clause[clause.rfind("คือ") + 3 :]
                if len(had.split()) >= 2 and not had.endswith("."):
                    out.append(m.start())
    return out


def _places(s: str, lang: str) -> Iterator[int]:
    """Ends of units inside one block."""
    last = len(s.rstrip())
    for m in _decision(lang).finditer(s):
        end = m.end()
        if end >= last:
            return
        if m["wide"] is not None:
            # within closing signs the unit goes on, unless another quotation begins
            if m.group()[-1] in "。！？" or s[end:].lstrip(" ")[:1] in "“「『\n\"":
                yield end
        elif m["on"] is None:
            yield end


def language(text: str, lang: str | None) -> str:
    """The table to use: the language's own, else by script."""
    code = (lang or "").strip().lower()[:2]
    if code in ("en", "de", "fr", "es", "pt", "zh", "ja", "hi", "ar", "th"):
        return code
    for pattern, found in ((THAI, "th"), (re.compile(r"[ऀ-ॿ]"), "hi"), (re.compile(r"[؀-ۿ]"), "ar"), (re.compile(r"[぀-ヿ]"), "ja"), (HAN, "zh")):
        if pattern.search(text):
            return found
    low = f" {text.lower()} "
    scores = {c: sum(low.count(f" {w} ") for w in words.split()) for c, words in {"en": "the of and to in is was for", "de": "der die das und ist nicht wurde von", "fr": "le la les des est et du une", "es": "el los las del que una por con", "pt": "o os uma do da não com em para"}.items()}
    return max(scores, key=scores.get) if any(scores.values()) else "en"


def units(text: str, lang: str | None = None, thai: frozenset[str] | None = None) -> list[tuple[int, int]]:
    """[(start, end)] of the sentences and other units of a text, in order, without outer blanks; ``thai``: what begins
    clauses in Thai, as ``thai_starts`` tells from a corpus."""
    plain, at = fold(text)
    code = language(plain, lang)
    spans: list[tuple[int, int]] = []
    for a, b, whole in blocks(plain):
        s = plain[a:b]
        cuts = []
        if not whole:
            cuts = list(_places(s, code))
            if THAI.search(s):
                cuts = sorted({*cuts, *_thai_breaks(s, thai)})
        begin = 0
        for end in [*cuts, len(s)]:
            piece = s[begin:end]
            left, right = len(piece) - len(piece.lstrip()), len(piece.rstrip())
            if right > left:
                spans.append((a + begin + left, a + begin + right))
            begin = end
    if at is None:
        return spans
    out = []
    for a, b in spans:
        s, e = at[a], at[b - 1] + 1
        e = max(e, at[b]) if b < len(at) and plain[b : b + 1].strip() == "" else e
        while e > s and (text[e - 1].isspace()):
            e -= 1
        out.append((s, e))
    return out


def sentence_spans(docs: DataFrame, id_col: str = "document_key", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(document_key, ordinal, start_pos, end_pos): the ordered units of every text.

    Null ids and null texts give no rows, nor do empty or blank texts; a null or unknown language is told from the
    script and common words; a repeated row gives its units again; other columns are ignored; an empty table gives an
    empty result. One pass without a shuffle; the length of a text never cuts a unit. Thai clauses end without marks, so
    what begins them is first counted over the Thai texts.
    """

    thai = thai_starts(docs, text_col)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, n, s, e) for key, text, lang in zip(b.id, b.text, b.lang) for n, (s, e) in enumerate(units(text, lang, thai))]
            yield pd.DataFrame(rows, columns=["document_key", "ordinal", "start_pos", "end_pos"])

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), lang.alias("lang")).filter("id is not null and text is not null")
    return rows.mapInPandas(scan, "document_key long, ordinal int, start_pos int, end_pos int")


def found(annotated_docs: DataFrame) -> DataFrame:
    """(document_key, start_pos, end_pos) of every unit."""
    return sentence_spans(annotated_docs).select("document_key", "start_pos", "end_pos")
