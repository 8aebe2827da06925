"""Characters that print alike, reduced to one prototype.

``skeleton`` decomposes, replaces every character by its prototype and decomposes again. ``fold`` gives a composed
text in the same alphabet together with the position in the original of each of its characters.

Width, font, ligatures, letters' places in the word, kinds of blanks and what does not print come from the Unicode data
that Python ships; letters of one script that print as letters of another are in no such data and are listed below,
script by script. Told apart, and so not listed: dashes by their length, straight and curved quotes, dotless letters,
small capitals, kana and Han characters by their size, and letters that only resemble each other (Greek gamma and y, Hebrew samekh and o).
"""

from __future__ import annotations

import re
from functools import lru_cache
from unicodedata import category, decomposition, normalize

# Letters that print as a Latin letter, by script.
TWINS = {
    "cyrillic": ("АВЕЅІЈКМНОРСТУХЬаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTYXbaesijopcyxhdqw"),
    "cyrillic, wider": ("ҮүѴѵӀӏԌԚԜӔӕӘәӠӡ", "YyVvIlGQWÆæƏəƷʒ"),
    "greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"),
    "greek, wider": ("νρυϲϹϳͿϜ", "vpucCjJF"),
    "armenian": ("օՕոսՍհցյզգԼՏ", "oOnuUhgjqqLS"),
    "coptic": ("ⲞⲟⲢⲣⲤⲥⲦⲎⲒⲔⲘⲚⲂⲬⲨ", "OoPpCcTHIKMNBXY"),
    "cherokee": ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃᎩ", "ABCDEGHJKLMPRSTVWZY"),
    "lisu": ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
    "latin": ("ɑɡ", "ag"),
    "persian digits": ("۰۱۲۳۷۸۹", "٠١٢٣٧٨٩"),
}
# Other signs that print alike.
SIGNS = {"‐": "-", "⁃": "-", "˗": "-", "ʼ": "’"}
PROTOTYPES: dict[str, str] = {a: b for letters, latin in TWINS.values() for a, b in zip(letters, latin)} | SIGNS
#: Compatibility forms whose difference is only width, a break rule, a ligature or a letter's place in the word.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<square>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>"}
#: Where the first plane of the Unicode data has such forms: up to the CJK signs, and from Yi to the end without Hangul.
FORMS = (range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0xFFFF))


def prototype(ch: str) -> str:
    """The text that stands for one character: '' for what does not print, a blank for any blank."""
    if ch in PROTOTYPES:
        return PROTOTYPES[ch]
    kind = category(ch)
    if kind == "Cf" or "︀" <= ch <= "️" or ch == "͏":
        return ""
    if kind == "Zs":
        return " "
    tag, *codes = decomposition(ch).split() or [""]
    if tag and not codes and kind[0] == "L":
        return chr(int(tag, 16))
    if tag in SAME_LOOK and kind[0] in "LN" or tag == "<noBreak>" or tag == "<compat>" and kind == "So":
        plain = "".join(chr(int(c, 16)) for c in codes)
        if not plain.startswith(" "):
            return "".join(prototype(c) for c in plain)
    return ch


class _Table(dict):
    def __missing__(self, code: int) -> str:
        self[code] = out = prototype(chr(code))
        return out


_TABLE = _Table()
#: A skeleton also joins the one kana whose two forms print alike; folding leaves it.
_SKELETON = _Table({ord("へ"): "ヘ"})


def skeleton(text: str | None) -> str | None:
    """Equal for two texts exactly if they print alike. Null stays null; ASCII text is its own skeleton."""
    if text is None or text.isascii():
        return text
    return normalize("NFD", normalize("NFD", text).translate(_SKELETON))


#: What is left in place by folding though its parts print alike: Thai and Lao vowels that are two signs in one.
WHOLE = "\u0e33\u0eb3"


@lru_cache
def _changes() -> re.Pattern:
    """Any character that folding changes, or a mark that it composes with what stands before. Characters beyond the
    first plane are taken for such without a look, as a class of many ranges there would be slow to search."""
    ranges: list[list[int]] = []
    for code in (c for r in FORMS for c in r if 0x300 <= c <= 0x36F or chr(c) not in WHOLE and prototype(chr(c)) != chr(c)):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + r"\U00010000-\U0010ffff]")


def is_plain(text: str) -> bool:
    """True if folding surely changes nothing, so that the text can be used as it is."""
    return text.isascii() or not _changes().search(text)


def fold(text: str) -> tuple[str, list[int] | None]:
    """(text', at): text' composed and in prototypes; at[i] is the original position of text'[i], at[-1] the length.

    ``at`` is None where nothing changed, so that positions are the same. Stretches without changes are copied whole.
    """
    if is_plain(text):
        return text, None
    out: list[str] = []
    at: list[int] = []
    done, n = 0, len(text)
    for m in _changes().finditer(text):
        start = m.start()
        if start < done:
            continue
        end = start + 1
        if "\u0300" <= text[start] <= "\u036f" and start > done:
            start -= 1
        while end < n and "\u0300" <= text[end] <= "\u036f":
            end += 1
        out.append(text[done:start])
        at.extend(range(done, start))
        made = _TABLE[ord(text[start])] if end - start == 1 else normalize("NFC", "".join(map(prototype, text[start:end])))
        out.append(made)
        at.extend([start] * len(made))
        done = end
    out.append(text[done:])
    at.extend(range(done, n + 1))
    return "".join(out), at
