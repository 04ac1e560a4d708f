"""One form for text that looks alike (problem 5): the confusables skeleton.

``skeleton`` decomposes a text, replaces every character by the prototype of
its look-alike class, drops what cannot be seen and decomposes again.  Two
texts look the same exactly if their skeletons are equal.  ``one_form`` is the
skeleton with accents composed, which is how most clean rows are written.

The look-alike table is read from the public confusables data of Unicode, which
every Spark distribution holds in its ICU library, and from the decompositions
of wide, narrow and mathematical letters, ligatures, Roman numerals and
presentation forms.  Of that data only letters are taken: ASCII characters are
never replaced (``l``, ``I`` and ``1`` or ``0`` and ``O`` stay apart), a letter
like an ASCII one becomes that, and letters of different scripts that look alike
but like no ASCII one become the Latin-1 one of them, else the Greek one, else
the first in Unicode's order.  Marks, quotes, modifier letters, symbols, digits of other scripts and
letters that the data finds alike within one script are left as they are; hyphens
have a list of their own.

What can be seen stays: case, accents, dots and hooks below, lowered digits
and every kind of bracket.  What cannot be seen goes: format controls, soft
hyphens, variation selectors, fillers.  Blanks of any width become one blank,
line breaks and tabs stay themselves.

Null stays null, the empty text stays empty, a text of invisible characters
only becomes empty.
"""

from __future__ import annotations

import logging
import os
import struct
import unicodedata
import zipfile
from pathlib import Path

log = logging.getLogger(__name__)

# Letters of other scripts and the Latin letter each looks like; used where the data file is not found,
# and for the few letters that the data puts elsewhere.
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳνοϲ", "ABEZHIKMNOPTYXCjvoc")
CYRILLIC = ("АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝӏү", "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwly")
ARMENIAN = ("ՍՏՕօսոհց", "USOounhg")
LATIN = ("ɑɡɩʏ", "agiy")
# Dashes that look like the hyphen.
HYPHENS = "‐‑‒–−﹘﹣－⁃˗۔➖Ⲻ֊־᐀᠆"
# Characters that show nothing though their category is not Cf.
FILLERS = "͏ᅟᅠ឴឵ㅤﾠ"
BRAILLE_BLANK = "⠀"
# Brackets of editors, in pairs.
BRACKETS = "()[]{}<>‹›«»˹˺⌈⌉⌊⌋⟨⟩〈〉⸢⸣⸤⸥⟦⟧〈〉《》「」『』【】〔〕❨❩❪❫❬❭❮❯❰❱❲❳❴❵"
LOWERED = ("₀₁₂₃₄₅₆₇₈₉", "0123456789")


#: Code points that may be replaced; beyond them lie ideographs only.
ASSIGNED = (*range(0x20000), *range(0xE0000, 0xE0200))


def confusables(folder: str | None = None) -> dict[str, str]:
    """Character and prototype of the public confusables data in the ICU library of the Spark distribution (of
    ``folder``, or wherever Spark lies); empty, with a warning, where there is none."""
    import pyspark

    places = [folder] if folder else [os.environ.get("SPARK_HOME", ""), os.path.dirname(pyspark.__file__)]
    for jar in (jar for place in places if place for jar in sorted(Path(place, "jars").glob("icu4j-*.jar"))):
        with zipfile.ZipFile(jar) as library:
            name = next((n for n in library.namelist() if n.endswith("/confusables.cfu")), None)
            data = library.read(name) if name else b""
        if data:
            body = data[struct.unpack(">H", data[:2])[0] :]
            keys_at, keys, values_at, values, strings_at, strings = struct.unpack(">6i", body[12:36])
            text = body[strings_at : strings_at + 2 * strings]
            out = {}
            for key, value in zip(struct.unpack(f">{keys}i", body[keys_at : keys_at + 4 * keys]), struct.unpack(f">{values}H", body[values_at : values_at + 2 * values]), strict=True):
                size = (key >> 24 & 255) + 1
                out[chr(key & 0xFFFFFF)] = chr(value) if size == 1 else text[2 * value : 2 * (value + size)].decode("utf-16-be")
            return out
    log.warning("no confusables data below %s: look-alike letters come from the built-in list only", places)
    return {}


def _letters(text: str) -> bool:
    return all(unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo", "Nl") for c in text)


def _decomposed(c: str) -> str | None:
    """What a wide, narrow or mathematical form, a ligature, a Roman numeral or a presentation form stands for."""
    kind, _, parts = unicodedata.decomposition(c).partition(" ")
    named = lambda: unicodedata.name(c, "").startswith(("LATIN SMALL LIGATURE", "ROMAN NUMERAL", "SMALL ROMAN NUMERAL"))
    if kind in ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>") or (kind == "<compat>" and named()):
        return "".join(chr(int(p, 16)) for p in parts.split())
    return None


def _look_alike_letters() -> dict[str, str]:
    """Letter -> the letters it looks like, resolved."""
    data = confusables()
    hand = {a: b for strange, plain in (GREEK, CYRILLIC, ARMENIAN, LATIN) for a, b in zip(strange, plain, strict=True)}
    to = {}
    ascii_of = {}  # prototype -> the ASCII letter of its class, where the prototype is another
    for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        if data.get(c, c) != c and not (data[c].isascii() and len(data[c]) == 1):
            ascii_of[data[c]] = c
    others: dict[str, list[str]] = {}
    for c, looks in data.items():
        if c.isascii() or not _letters(c):
            continue
        looks = ascii_of.get(looks, looks)
        if looks.isascii():
            if looks.isalpha():
                to[c] = "I" if looks == "l" and unicodedata.category(c) == "Lu" and c != "\u04c0" else looks
        elif len(looks) == 1 and _letters(looks):
            others.setdefault(looks, [looks]).append(c)
    script = lambda c: unicodedata.name(c, "").partition(" ")[0]
    for alike in others.values():
        first = min(alike, key=lambda c: (c > "\xff", script(c) != "GREEK", c))
        to.update({c: first for c in alike if script(c) != script(first)})
    to.update(hand)
    for cp in ASSIGNED:
        if found := _decomposed(chr(cp)):
            to[chr(cp)] = found
    out = {}
    for c in to:
        looks = c
        for _ in range(8):  # a prototype may look like another one
            looks = "".join(to.get(x, x) for x in unicodedata.normalize("NFD", looks))
        out[c] = looks
    return out


def _lookalikes() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(c): looks for c, looks in _look_alike_letters().items()}
    for cp in ASSIGNED:
        kind = unicodedata.category(chr(cp))
        if kind == "Cf" or (kind == "Cc" and not chr(cp).isspace()):
            table[cp] = None
        elif kind == "Zs":
            table[cp] = " "
    table.update(dict.fromkeys(map(ord, FILLERS)))
    table.update(dict.fromkeys([*range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))
    table[ord(BRAILLE_BLANK)] = " "
    table.update(dict.fromkeys(map(ord, HYPHENS), "-"))
    table.pop(0x20, None)
    return table


LOOKALIKE = _lookalikes()

#: The same table with what plain words ignore: editors' signs go, lowered digits become digits.
PLAIN = LOOKALIKE | dict.fromkeys(map(ord, BRACKETS + "!?！？")) | {ord(a): b for a, b in zip(*LOWERED, strict=True)}
PLAIN |= {cp: None for cp, to in LOOKALIKE.items() if to and to in BRACKETS}

#: Punctuation that may stand next to a word, by category; scripts beyond U+3040 have it in the wide block, folded above.
PUNCTUATION = "".join(chr(cp) for cp in range(0x21, 0x3040) if unicodedata.category(chr(cp))[0] == "P")

_nfd = "NFD"


def skeleton(text: str) -> str:
    """The decomposed prototype form; equal for texts that look the same."""
    if text.isascii() and text.isprintable():
        return text
    normalize = unicodedata.normalize
    return normalize(_nfd, normalize(_nfd, text).translate(LOOKALIKE))


def one_form(text: str) -> str:
    """The skeleton with accents composed."""
    if text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize(_nfd, text).translate(LOOKALIKE))


def plain_words(text: str | None) -> list[str]:
    """The words of a text between blanks or line breaks, without editors' signs, edge punctuation, case and
    the difference between lowered and other digits.  Null gives no words."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", unicodedata.normalize(_nfd, text).translate(PLAIN))
    else:
        text = text.translate(PLAIN)
    return [w for w in (word.strip(PUNCTUATION) for word in text.lower().split()) if w]
