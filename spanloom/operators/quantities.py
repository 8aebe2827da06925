"""Quantities recorded in different units, brought to one dimension and a common unit.

Method: the distinct unit spellings of all rows go through a character n-gram inverted index over the known names and a
weighted edit distance that verifies each hit; the resulting alias dictionary is joined to all rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from decimal import Context, Decimal, InvalidOperation
from fractions import Fraction
from unicodedata import normalize

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lookalike import fold
from ..session import cut, is_small

# Metric bases (dimension, size in the common unit, symbols, names) and what may stand before them.
# The common units are µg, µm, µL, ms, hundredths of °C and bytes.
BASES = {
    "g": ("mass", 10**6, "g gr", "gram gramme gramo grama Gramm", "μ m k"),
    "m": ("length", 10**6, "m", "metre meter mètre metro", "m c d k"),
    "l": ("volume", 10**6, "l L", "litre liter litro", "m c d"),
    "s": ("duration", 1000, "s sec secs", "second seconde segundo Sekunde", "m"),
    "B": ("data", 1, "B", "byte octet", "k M G T Ki Mi Gi Ti"),
}
PREFIXES = {
    "μ": (Fraction(1, 10**6), "μ u mc", "micro mikro"), "m": (Fraction(1, 1000), "m", "milli mili"), "c": (Fraction(1, 100), "c", "centi zenti"), "d": (Fraction(1, 10), "d", "deci dezi"), "k": (Fraction(1000), "k K", "kilo quilo"),
    "M": (Fraction(10**6), "M", "mega"), "G": (Fraction(10**9), "G", "giga"), "T": (Fraction(10**12), "T", "tera"), "Ki": (Fraction(2**10), "Ki", "kibi"), "Mi": (Fraction(2**20), "Mi", "mebi"), "Gi": (Fraction(2**30), "Gi", "gibi"), "Ti": (Fraction(2**40), "Ti", "tebi"),
}
# The other units (dimension, unit, size, symbols, names); plurals follow by rule.
OTHERS = [
    ("mass", "kg", "1000000000", "kgs", "kilo quilo"),
    ("mass", "t", "1000000000000", "t", "tonne tonelada metric_ton"),
    ("mass", "lb", "453592370", "lb lbs", "pound libra livre Pfund"),
    ("mass", "oz", "28349523.125", "oz", "ounce onza onça once Unze"),
    ("length", "in", "25400", 'in " ″', "inch inche pouce pulgada polegada Zoll"),
    ("length", "ft", "304800", "ft ' ′", "foot feet pied pie pé Fuß"),
    ("length", "yd", "914400", "yd yds", "yard yarda jarda"),
    ("length", "mi", "1609344000", "mi", "mile milla milha Meile"),
    ("volume", "m3", "1000000000", "m³ m3 cbm", "cubic_metre cubic_meter mètre_cube metro_cúbico Kubikmeter"),
    ("volume", "gal", "3785411.784", "gal", "gallon galón galone galão galõe Gallone"),
    ("volume", "floz", "29573.5295625", "fl_oz fl._oz.", "fluid_ounce"),
    ("duration", "min", "60000", "min mins", "minute minuto"),
    ("duration", "h", "3600000", "h hr hrs", "hour heure hora Stunde"),
    ("duration", "d", "86400000", "d", "day jour día Tag"),
    ("duration", "wk", "604800000", "wk wks", "week semaine semana Woche"),
    ("temperature", "C", "100", "°C C", "celsius degree_C degree_Celsius deg_C Grad grado degré grau Grad_Celsius grado_Celsius degré_Celsius grau_Celsius"),
    ("temperature", "F", "0", "°F F", "fahrenheit degree_F degree_Fahrenheit deg_F Grad_Fahrenheit grado_Fahrenheit degré_Fahrenheit grau_Fahrenheit"),
    ("temperature", "K", "100", "K", "kelvin"),
]
# Names in scripts without letter case.
CASELESS = {
    "mg": "毫克 ミリグラム मिलीग्राम มิลลิกรัม مليغرام", "g": "克 グラム ग्राम กรัม غرام", "kg": "千克 公斤 キログラム キロ किलोग्राम किलो กิโลกรัม กิโล كيلوغرام كيلو كيلوجرام", "t": "吨 トン टन ตัน طن",
    "mm": "毫米 ミリメートル मिलीमीटर มิลลิเมตร مليمتر", "cm": "厘米 センチメートル सेंटीमीटर เซนติเมตร سنتيمتر", "m": "米 メートル मीटर เมตร متر", "km": "公里 千米 キロメートル किलोमीटर กิโลเมตร كيلومتر",
    "ml": "毫升 ミリリットル मिलीलीटर มิลลิลิตร مليلتر", "l": "升 リットル लीटर ลิตร لتر", "m3": "立方米 立方メートル", "s": "秒 秒間 सेकंड วินาที ثانية", "min": "分 分钟 分間 मिनट นาที دقيقة", "h": "小时 時間 घंटे घंटा ชั่วโมง ساعة",
    "d": "天 日 日間 दिन วัน يوم", "wk": "周 週間 सप्ताह สัปดาห์ أسبوع", "C": "摄氏度 度 องศา องศาเซลเซียส درجة_مئوية", "F": "华氏度",
    "in": "英寸 インチ इंच นิ้ว بوصة", "ft": "英尺 フィート फुट ฟุต قدم", "mi": "英里 マイル मील ไมล์ ميل", "ms": "毫秒 ミリ秒",
}


def units() -> list[tuple[str, str, str, list[str], list[str]]]:
    """(dimension, unit, size, symbols, names): bases with and without prefixes, the others, the caseless names."""
    out: dict[str, tuple[str, str, str, list[str], list[str]]] = {}

    def add(dimension: str, unit: str, size: str, symbols: list[str], names: list[str]) -> None:
        row = out.setdefault(unit, (dimension, unit, size, [], []))
        row[3].extend(x.replace("_", " ") for x in symbols)
        row[4].extend(x.replace("_", " ") for x in names)

    for base, (dimension, size, symbols, names, allowed) in BASES.items():
        add(dimension, base, str(size), symbols.split(), names.split())
        for p in allowed.split():
            factor, signs, words = PREFIXES[p]
            value = factor * size
            short = [sign + x for sign in signs.split() for x in symbols.split()[: 1 + (base == "l")]]
            add(dimension, p + base, str(Decimal(value.numerator) / Decimal(value.denominator)), short, [w + x for w in words.split() for x in names.split()])
    for dimension, unit, size, symbols, names in OTHERS:
        add(dimension, unit, size, symbols.split(), names.split())
    for unit, names in CASELESS.items():
        out[unit][3].extend(names.replace("_", " ") for names in names.split())
    return list(out.values())


UNITS = units()
EXACT = Context(prec=60)
# Languages that write a decimal comma, multiplying words, number words, words of vague amounts.
DECIMAL_COMMA = {"de", "fr", "es", "pt", "it", "nl"}
MULTIPLES = {"k": 1000, "thousand": 1000, "mil": 1000, "mille": 1000, "tausend": 1000, "tsd": 1000, "million": 10**6, "millions": 10**6, "mn": 10**6, "millones": 10**6, "milhões": 10**6, "millionen": 10**6, "billion": 10**9, "dozen": 12, "万": 10**4, "億": 10**8, "亿": 10**8, "千": 1000, "百万": 10**6}
SMALL_NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = {w: n for n, w in enumerate(SMALL_NUMBERS)} | {w: 10 * n for n, w in enumerate(TENS, 2)}
VAGUE = re.compile(r"\b(?:a few|few|several|some|many|much|less|more|various|unos|unas|algunos|alguns|algumas|quelques|plusieurs|einige|mehrere|wenige)\b|几|数|少し|कुछ|بعض|บาง", re.I)
FRACTIONS = {"½": Fraction(1, 2), "¼": Fraction(1, 4), "¾": Fraction(3, 4), "⅓": Fraction(1, 3), "⅔": Fraction(2, 3), "⅛": Fraction(1, 8)}

NUMBER = re.compile(r"[-−]?(?:\d+ )?\d+/\d+(?!\d)|[-−]?\d+(?:[.,٬٫]\d+|[ '’]\d{3}(?!\d))*(?: ?[½¼¾⅓⅔⅛])?|[½¼¾⅓⅔⅛]")
_ONE = "(?:%s|hundred|thousand|million)" % "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
WORDS_NUMBER = re.compile(rf"\b(?:half an? |(?:a dozen|{_ONE}(?:[ -](?:and )?{_ONE})*)(?: and a half)?\b)", re.I)


def read_number(s: str, comma: bool | None) -> list[Fraction]:
    """The readings of a written number, the likeliest first; ``comma`` says whether the comma is the decimal sign, if known."""
    s = s.strip().replace("−", "-")
    sign = -1 if s.startswith("-") else 1
    s = s.lstrip("-")
    extra = Fraction(0)
    if s and s[-1] in FRACTIONS:
        extra, s = FRACTIONS[s[-1]], s[:-1].strip()
    if m := re.fullmatch(r"(?:(\d+) )?(\d+)/(\d+)", s):
        if int(m[3]) == 0:
            return []
        return [sign * (int(m[1] or 0) + Fraction(int(m[2]), int(m[3])))]
    if not s:
        return [sign * extra]
    s = re.sub(r"[ '’٬]", "", s).replace("٫", "." if not comma else ",")
    plain = lambda t: Fraction(t) + extra
    dots, commas = s.count("."), s.count(",")
    try:
        if dots and commas:
            last = max(s.rfind("."), s.rfind(","))
            out = [plain(re.sub(r"[.,]", "", s[:last]) + "." + s[last + 1 :])]
        elif not dots and not commas:
            out = [plain(s)]
        else:
            mark, n = ("." if dots else ","), dots or commas
            grouped = re.fullmatch(r"[1-9]\d{0,2}(?:[.,]\d{3})+", s) is not None
            whole, decimal = s.replace(mark, ""), s.replace(mark, ".")
            if n > 1:
                out = [plain(whole)]
            elif not grouped:
                out = [plain(decimal)]
            else:
                as_decimal = (mark == ",") == bool(comma)
                out = [plain(decimal if as_decimal else whole)]
                if comma is None:
                    out.append(plain(whole if as_decimal else decimal))
    except (ValueError, ZeroDivisionError):
        return []
    return [sign * x for x in out]


def read_words(s: str) -> Fraction | None:
    """An English number in words: half a, a dozen, two and a half, one hundred and twenty."""
    s = s.lower().strip().replace("-", " ")
    if s in ("half a", "half an"):
        return Fraction(1, 2)
    half = Fraction(0)
    if s.endswith("and a half"):
        half, s = Fraction(1, 2), s[: -len("and a half")].strip()
    if s == "a dozen":
        return 12 + half
    total = part = 0
    seen = False
    for w in s.split():
        if w in NUMBER_WORDS:
            part += NUMBER_WORDS[w]
            seen = True
        elif w == "hundred":
            part = max(1, part) * 100
        elif w in ("thousand", "million"):
            total += max(1, part) * MULTIPLES[w]
            part = 0
    return total + part + half if seen else None


def _spelling(s: str) -> str:
    """A unit as a key of the alias dictionary: marks and blanks in one form, letter case kept."""
    s = re.sub(r"\s+", " ", s).strip(" \t.,;:()[]")
    return s


def _split(s: str, comma: bool | None) -> list[tuple[list[Fraction], str]] | None:
    """[(readings of the number, unit)] of a text such as '3 kg 400 g'; None if it states no number."""
    out: list[tuple[list[Fraction], str]] = []
    marks = [(m.start(), m.end(), read_number(m.group(), comma)) for m in NUMBER.finditer(s)]
    if not marks:
        m = WORDS_NUMBER.search(s)
        value = read_words(m.group()) if m else None
        if value is None:
            return None
        marks = [(m.start(), m.end(), [value])]
    for k, (_, end, value) in enumerate(marks):
        unit = s[end : marks[k + 1][0] if k + 1 < len(marks) else len(s)].strip()
        first, _, rest = unit.partition(" ")
        if first.lower() in MULTIPLES and rest and not (first == "K"):
            value, unit = [v * MULTIPLES[first.lower()] for v in value], rest
        elif unit[:1] in MULTIPLES and unit[:1] > "\x7f" and len(unit) > 1:
            value, unit = [v * MULTIPLES[unit[0]] for v in value], unit[1:]
        if k + 1 < len(marks):
            unit = re.sub(r"\s+(?:and|und|et|y|e)$|\s*,$", "", unit)
        out.append((value, _spelling(unit)))
    return out


def _structured(normalized: str | None) -> tuple[list[tuple[list[Fraction], str]] | None, str | None]:
    """(what ``normalized`` states, its unit) from JSON, a bare number, or a number with a unit."""
    if not normalized:
        return None, None
    s = fold(normalized)[0].strip()
    if s.startswith(("{", "[")):
        try:
            j = json.loads(s)
        except ValueError:
            return None, None
        if isinstance(j, list):
            j = j[0] if j and isinstance(j[0], dict) else {}
        value = next((j[k] for k in ("value", "v", "amount", "number") if k in j), None)
        unit = next((j[k] for k in ("unit", "u", "units") if isinstance(j.get(k), str)), "")
        try:
            exact = Decimal(str(value)) if value is not None and not isinstance(value, bool) else None
            # a number beyond 10^60 fits no unit's bigint and would only take time
            number = [Fraction(exact)] if exact is not None and exact.is_finite() and abs(exact.adjusted()) <= 60 else None
        except (InvalidOperation, ValueError, OverflowError):
            number = None
        return ([(number, _spelling(unit))] if number else None), _spelling(unit) or None
    parts = _split(s, False)
    if not parts or not re.match(r"[-−\d½¼¾]", s):
        return None, None
    return parts, parts[0][1] or None


def read_quantity(text: str | None, normalized: str | None, lang: str | None) -> list[tuple[str, str]]:
    """[(number as 'n/d', unit spelling)]: what the text states, completed from ``normalized``; [] if that is no quantity."""
    s = fold(text)[0].strip() if text else ""
    s = re.sub(r"\s+", " ", s)
    if "%" in s or VAGUE.search(s):
        return []
    code = (lang or "").lower()[:2]
    comma = None if not code else code in DECIMAL_COMMA
    parts = _split(s, comma) if s else None
    stated, unit = _structured(normalized)
    if parts is None:
        if s and not WORD_UNIT.fullmatch(s):
            return []
        if stated is None:
            return []
        parts = [(stated[0][0], _spelling(s))] if s else stated
    pick = []
    for n, (values, own) in enumerate(parts):
        if not values:
            return []
        value = values[0]
        if len(values) > 1 and stated and stated[0][0] and stated[0][0][0] in values:
            value = stated[0][0][0]
        pick.append([value, own])
    if len(pick) == 1 and not pick[0][1]:
        if not unit or "%" in unit:
            return []
        pick[0][1] = unit
    if any(not u for _, u in pick):
        return []
    for before, part in zip(pick, pick[1:]):
        if part[1] in ("m", "M") and before[1].lower() in ("h", "hr", "hrs", "hour", "hours"):
            part[1] = "min"
    return [(f"{v.numerator}/{v.denominator}", u) for v, u in pick]


VOWELS = "aeiouáéíóúâêôãõäöüàè"
WORD_UNIT = re.compile(r"[^\W\d_][\w° .³'\"-]{0,24}|°[CF]|[\"']")


class Aliases:
    """Unit spellings to units: exact, then without case, then by n-grams and a weighted edit distance."""

    def __init__(self) -> None:
        self.exact: dict[str, int] = {}
        self.lower: dict[str, set[int]] = defaultdict(set)
        self.grams: dict[str, set[str]] = defaultdict(set)
        for n, (_, _, _, symbols, names) in enumerate(UNITS):
            for name in symbols:
                self.exact.setdefault(fold(name)[0], n)
                self.lower[self._key(name)].add(n)
            for name in names:
                head, _, rest = self._key(name).partition(" ")
                for ending in ("", "s", "n", "en", "e") if len(head) > 2 else ("", "s"):
                    self.lower[f"{head}{ending} {rest}".strip()].add(n)
                    self.lower[f"{head}{ending} {rest}{ending}".strip()].add(n)
                    if rest:
                        self.lower[f"{head} {rest}{ending}"].add(n)
        self.shape: dict[str, tuple[int, Counter]] = {}
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for name in self.lower:
            if len(name) >= 3:
                for g in self._grams(name):
                    self.grams[g].add(name)
                self.shape[name] = len(self._grams(name)), self._consonants(name)
                self.by_length[len(name)].append(name)

    @staticmethod
    def _key(s: str) -> str:
        """Without letter case and without accents."""
        return normalize("NFC", re.sub("[\u0300-\u036f]", "", normalize("NFD", fold(s)[0].casefold())))

    @staticmethod
    def _grams(s: str) -> set[str]:
        s = f"^{s}$"
        return {s[i : i + 2] for i in range(len(s) - 1)}

    @staticmethod
    def _consonants(s: str) -> Counter:
        return Counter(c for c in s if c not in VOWELS)

    def near(self, s: str) -> list[tuple[float, str]]:
        """(distance, name) of all known names within the distance that a spelling of that length may have.

        An edit costs a half at least and touches three bigrams at most, so a name shares all but six for each point of
        the distance. Where that leaves none to share, the index can't help, and names with nearly the same consonants
        are tried: a point changes two of them at most. Spellings of three or four letters may double or swap letters only.
        """
        if len(s) < 3:
            return []
        most = 0.5 if len(s) < 5 else 1.0 if len(s) < 8 else 2.0
        own = self._grams(s)
        shared: dict[str, int] = defaultdict(int)
        for g in own:
            for name in self.grams.get(g, ()):
                shared[name] += 1
        mine = self._consonants(s)
        out = []
        for length in range(max(3, len(s) - int(2 * most)), len(s) + int(2 * most) + 1):
            for name in self.by_length.get(length, ()):
                grams, consonants = self.shape[name]
                if shared.get(name, 0) < max(len(own), grams) - 6 * most:
                    continue
                if sum(((mine - consonants) + (consonants - mine)).values()) > 2 * most:
                    continue
                d = weighted_distance(s, name, most, VOWELS if len(s) >= 5 else "")
                if d <= most:
                    out.append((d, name))
        return out

    def look_up(self, spelling: str) -> int | None:
        if spelling in self.exact:
            return self.exact[spelling]
        s = self._key(spelling).replace(".", "")
        if len(hit := self.lower.get(s, ())) == 1:
            return next(iter(hit))
        near = self.near(s)
        if not near:
            return None
        best = min(near)[0]
        units = {n for d, name in near if d == best for n in self.lower[name]}
        return next(iter(units)) if len(units) == 1 else None


def weighted_distance(a: str, b: str, most: float, vowels: str = VOWELS) -> float:
    """Edit distance where a doubled letter, a swap or a changed vowel costs half; more than ``most`` may come out as inf."""
    before: list[float] = []
    row = [j * 1.0 for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i * 1.0]
        for j, y in enumerate(b, 1):
            cost = 0.0 if x == y else 0.5 if x in vowels and y in vowels else 1.0
            drop = 0.5 if i > 1 and a[i - 2] == x else 1.0
            add = 0.5 if j > 1 and b[j - 2] == y else 1.0
            d = min(before[j - 1] + cost, before[j] + drop, row[j - 1] + add)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 0.5)
            row.append(d)
        if min(row) > most and min(before) > most:
            return float("inf")
    return row[-1]


def alias_dictionary(spellings: DataFrame, col: str = "spelling") -> DataFrame:
    """(spelling, unit, dimension, size) for the distinct spellings that mean a unit; the others are left out."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Aliases()
        for b in batches:
            got = [(s, known.look_up(s)) for s in b.spelling]
            rows = [(s, UNITS[n][1], UNITS[n][0], Decimal(UNITS[n][2])) for s, n in got if n is not None]
            yield pd.DataFrame(rows, columns=["spelling", "unit", "dimension", "size"])

    distinct = spellings.select(F.col(col).alias("spelling")).dropna().distinct()
    return distinct.mapInPandas(scan, "spelling string, unit string, dimension string, size decimal(23,7)")


@F.pandas_udf(T.DecimalType(38, 10))
def _amount(number: pd.Series, unit: pd.Series, size: pd.Series) -> pd.Series:
    """The number, however many digits it has, in the common unit; cut after ten decimals, so that halves round right."""
    out = []
    for x, u, k in zip(number, unit, size):
        if u is None:
            out.append(None)
            continue
        v = Fraction(x)
        exact = (v - 32) * 500 / 9 if u == "F" else v * Fraction(k) - (27315 if u == "K" else 0)
        whole = abs(exact.numerator) * 10**10 // exact.denominator
        out.append(Decimal(whole if exact >= 0 else -whole).scaleb(-10, EXACT) if whole < 10**38 else None)
    return pd.Series(out, dtype=object)


def common_units(df: DataFrame, id_col: str = "extraction_id", text_col: str = "extraction_text", normalized_col: str = "normalized", lang_col: str = "lang") -> DataFrame:
    """(id, dimension, amount bigint): one row per row of ``df`` that states a measured value with a unit.

    What the text states wins; ``normalized`` supplies only what it lacks. A null language leaves the decimal sign open:
    then the reading that ``normalized`` confirms is taken, else the English one. Null texts count as empty, junk in
    ``normalized`` as nothing. Rows with a null id, vague amounts, percentages, counts and mixed dimensions give no row;
    a repeated id gives one row if all its rows agree on the dimension (their first amount), none otherwise. Numbers are
    exact with all their digits; an amount beyond a bigint gives no row. An empty
    table gives an empty result. Only the distinct spellings meet the n-gram index; the dictionary is broadcast if it is
    small and joined otherwise, and the parts of one quantity are put together without a second pass over the table.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text, norm, lang in zip(b.id, b.text, b.normalized, b.lang):
                rows += [(key, k, number, unit) for k, (number, unit) in enumerate(read_quantity(text, norm, lang))]
            yield pd.DataFrame(rows, columns=["id", "part", "number", "spelling"])

    cols = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(normalized_col).cast("string").alias("normalized"), F.col(lang_col).cast("string").alias("lang")]
    parts = df.select(*cols).filter("id is not null").mapInPandas(scan, "id long, part int, number string, spelling string")
    parts = cut(parts)
    aliases = cut(alias_dictionary(parts))
    if is_small(aliases):
        aliases = F.broadcast(aliases)
    rows = parts.join(aliases, "spelling", "left")
    rows = rows.withColumn("amount", _amount("number", "unit", F.col("size").cast("string")))
    out = rows.groupBy("id").agg(
        F.expr("try_sum(amount)").alias("total"),
        F.count(F.when(F.col("amount").isNull(), 1)).alias("too_large"),
        F.min("dimension").alias("dimension"),
        F.max("dimension").alias("other"),
        F.count(F.when(F.col("dimension").isNull(), 1)).alias("unknown"),
        F.count("*").alias("n_parts"),
        (F.max("part") + 1).alias("n_distinct"),
    )
    amount = F.col("total") / (F.col("n_parts") / F.col("n_distinct")).cast("decimal(10,0)")
    out = out.filter("dimension = other and unknown = 0 and too_large = 0").select("id", "dimension", F.round(amount, 0).try_cast("long").alias("amount"))
    return out.filter("amount is not null")


QUANTITY_CLASSES = ("quantity", "measurement", "measure")


def found(extractions: DataFrame, annotated_docs: DataFrame, classes: tuple[str, ...] = QUANTITY_CLASSES) -> DataFrame:
    """(extraction_id, dimension, amount) over the quantity classes, read in the writing habits of each document's language."""
    rows = extractions.filter(F.col("extraction_class").isin(*classes)).select("extraction_id", "document_key", "extraction_text", "normalized")
    langs = annotated_docs.select("document_key", "lang").filter("document_key is not null").groupBy("document_key").agg(F.max("lang").alias("lang"))
    return common_units(rows.join(langs, "document_key", "left")).withColumnRenamed("id", "extraction_id")
