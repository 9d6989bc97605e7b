"""Prototypes of look-alike characters."""

from __future__ import annotations

import unicodedata

# Characters of other scripts or other code points that look like an ordinary one.
# Left the prototypes, right the characters drawn like them.
_GROUPS = {
    # Latin prototypes, Greek and Cyrillic look-alikes
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ΕЕᎬ", "F": "Ϝ", "G": "Ԍ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "Јᒍ", "K": "ΚК", "L": "Ꮮ",
    "M": "ΜМᎷ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "S": "ЅՏ", "T": "ΤТᎢ", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "αа", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "οоօ", "p": "рρ", "q": "ԛ",
    "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уγү",
    # Arabic prototypes, letters of other languages drawn alike
    "ك": "کڪ", "ي": "یۍ", "ه": "ہە", "ة": "ۃ", "ى": "ے",
    # Arabic-Indic digits, extended forms drawn alike
    "٠": "۰", "١": "۱", "٢": "۲", "٣": "۳", "٧": "۷", "٨": "۸", "٩": "۹", "٤": "۴", "٥": "۵", "٦": "۶",
}
# Lisu, Coptic, phonetic and other letters drawn like Latin ones, and marks drawn like ASCII ones.
_MORE = {
    "A": "ꓮ", "B": "ꓐ", "C": "ꓚⲤ", "D": "ꓓ", "E": "ꓰ", "F": "ꓝ", "G": "ꓖ", "H": "ꓧⲎ", "I": "ꓲⲒ", "J": "ꓙ", "K": "ꓗⲔ", "L": "ꓡ", "M": "ꓟⲘ", "N": "ꓠⲚ", "O": "ꓳⲞ", "P": "ꓑⲢ", "R": "ꓣ",
    "S": "ꓢ", "T": "ꓔⲦ", "U": "ꓴ", "V": "ꓦ", "W": "ꓪ", "X": "ꓫⲬ", "Y": "ꓬ", "Z": "ꓜ",
    "a": "ɑ", "c": "ⲥ", "o": "ⲟ", "p": "ⲣ", "u": "ʋ", "w": "ѡ",
    "-": "−‐‑⁃", ",": "‚", "/": "∕", ":": "׃", "!": "ǃ", "'": "ꞌ",
}
PROTOTYPES = {x: to for groups in (_GROUPS, _MORE) for to, group in groups.items() for x in group}
# by rule: small Cherokee letters are drawn like the capitals, small; small capitals like the small letters of one shape
PROTOTYPES.update({x.lower(): to.lower() for x, to in list(PROTOTYPES.items()) if "Ꭰ" <= x <= "\u13f5"})
PROTOTYPES.update({unicodedata.lookup(f"LATIN LETTER SMALL CAPITAL {to.upper()}"): to for to in "cosuvwz"})
