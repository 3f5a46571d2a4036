"""Patterns shared by the text functions.

Word characters and blanks are spelled out by Unicode category, so that the meaning is
that of Unicode text and does not hang on an engine's reading of ``\\w``, ``\\s``, ``\\b``.
"""

from __future__ import annotations

WORD = r"\p{L}\p{N}_"
BLANK = r"\t-\r\x{1c}-\x{1f} \x{85}\p{Z}"

#: Anything but a blank; the plain range comes first as it settles most characters at once.
SOLID = rf"[!-~[^{BLANK}]]"

#: Maximal run of two or more word characters.
TOKEN = rf"[{WORD}]{{2,}}"
#: A run of word characters, or a run of anything else: together they cover the text.
RUN = rf"[{WORD}]+|[^{WORD}]+"

# ---- fixed values: what a link looks like --------------------------------------------
_LINK_START = r"(?:https?:/|pic\.|www\d{0,3}[.]|[a-z0-9.\-]+[.][a-z]{2,4}/)"
_LINK_CHAR = rf"[^{BLANK}()<>]"
_LINK_LAST = rf"[^{BLANK}`!()\[\]{{}};:'\".,<>?«»“”‘’]"
# ---------------------------------------------------------------------------------------

# A parenthesis, with at most one more level inside; no quantifier is nested in another
# over the same characters, so long texts cost linear time.
_INNER = rf"\({_LINK_CHAR}+\)"
_PAREN = rf"\({_LINK_CHAR}*(?:{_INNER}{_LINK_CHAR}*)*\)"
LINK_BODY = (
    rf"{_LINK_START}(?:{_LINK_CHAR}|{_PAREN}){_LINK_CHAR}*"
    rf"(?:{_PAREN}{_LINK_CHAR}*)*(?:{_PAREN}|{_LINK_LAST})"
)
#: A link at a word boundary, upper or lower case.
LINK = rf"(?i)(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}])){LINK_BODY}"

# ---- fixed values: what the cleaning removes, in its order ----------------------------
MAIL = rf"[{WORD}][{WORD}|.=\-]*@[{WORD}|.\-]*[{WORD}]"
SCHEME = rf"[{WORD}]+://[{WORD}\-]+(?:\.[{WORD}\-]+)*(?:/[^{BLANK}/]*)*"
SYMBOLS = r"[*\[\]=()$\"}{|+&€£/º]+"
BLANKS = rf"(?:[{BLANK}]+|\\n)+"
PUNCTUATION = r"[,|.':;\-–]+"
DIGITS = r"\p{Nd}+[A-Za-z]*"
CHARACTERS = [
    "#", "@", "'", "´", "º", "ª", "°", '"', "{", "}", "<", ">", ";", "=", "_", "-", "`", "~",
    "%", "/", ":", "*", "(", ")", "|", "\\n", "€", "\\", "&", "[", "]", ",", ".", "?", "¿",
    "!", "¡",
]
# ---------------------------------------------------------------------------------------


def _ranges(listed: str) -> str:
    """Hexadecimal code points and ranges as the inside of a character class of Python's patterns."""
    return "".join("-".join(rf"\U{int(x, 16):08x}" for x in item.split("-")) for item in listed.split())


#: Letters, digits and marks which Python knows (Unicode 15.1) and the JVM does not (Unicode 13); but
#: for these, ``\w``, ``\s``, ``\d`` of Python are ``WORD``, ``BLANK``, ``\p{Nd}`` for every character.
NEWER = _ranges("""
61d 870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 1b7d-1b7e 2c2f 2c5f 2e53-2e5d 9ffd-9fff a7c0-a7c1
a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1
105b3-105b9 105bb-105bc 10780-10785 10787-107b0 107b2-107ba 10f70-10f81 10f86-10f89 11071-11072 11075
1123f-11240 116b9 11740-11746 11ab0-11abf 11b00-11b09 11f02 11f04-11f10 11f12-11f33 11f43-11f59 12f90-12ff2
1342f 13441-13446 16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155
1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb
1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 2ebf0-2ee5d 31350-323af
""")


def any_of(items: list[str]) -> str:
    """Pattern of any of the given strings, upper or lower case.

    Longer strings are tried first; the single characters become one class.
    """

    def plain(text: str) -> str:
        return "".join(c if c.isalnum() or not c.isascii() else "\\" + c for c in text)

    longer = sorted((i for i in items if len(i) > 1), key=lambda s: (-len(s), s))
    single = "[" + "".join(plain(i) for i in items if len(i) == 1) + "]"
    return "|".join([*(f"(?i:{plain(i)})" for i in longer), single])
