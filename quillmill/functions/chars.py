"""Character classes as bodies of regular-expression brackets.

Engines differ in the Unicode version behind ``\\p{..}`` and ``\\s``, so classes
that matter are spelled as ranges, derived here from Python's tables. The
bodies work in Java and RE2 alike.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable


def ranges(codes: Iterable[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for code in sorted(codes):
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return [(a, b) for a, b in out]


def body(spans: Iterable[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:04X}}}" if a == b else f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in spans)


def _pick(spans: Iterable[tuple[int, int]], test: Callable[[str], bool]) -> str:
    return body(ranges(c for a, b in spans for c in range(a, b + 1) if test(chr(c))))


# Unicode blocks of Arabic, its presentation forms, and the Latin letters counted as such.
ARABIC_BLOCKS = ((0x0600, 0x06FF), (0x0750, 0x077F), (0x0870, 0x089F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))
PRESENTATION_BLOCKS = ((0xFB50, 0xFDFF), (0xFE70, 0xFEFF))
LATIN_BLOCKS = ((0x0041, 0x005A), (0x0061, 0x007A), (0x00C0, 0x00FF), (0x0100, 0x024F))
BIDI_CONTROLS = (0x061C, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x2066, 0x2067, 0x2068, 0x2069)

AB = body(ARABIC_BLOCKS)
AL = _pick(ARABIC_BLOCKS, lambda c: unicodedata.category(c)[0] == "L")
LA = body(LATIN_BLOCKS)
PF = body(PRESENTATION_BLOCKS)
BC = body(ranges(BIDI_CONTROLS))
#: White space as str.split() sees it, and the line breaks of str.splitlines().
WS = _pick([(0, 0x3000)], str.isspace)
LB = r"\n\x0B\f\r\x{001C}-\x{001E}\x{0085}\x{2028}\x{2029}"
#: Combining marks; the ranges are newer than some engines' tables.
MK = r"\p{M}\x{0898}-\x{089F}\x{08CA}-\x{08D2}"
#: Letters of any script.
LT = r"\p{L}" + AL
#: The same for Java alone, which walks through a class range by range: Arabic blocks met with its own letters, and those that are newer than its tables.
JAVA_AL = f"[\\x{{0600}}-\\x{{FEFF}}&&[{body(sorted(ARABIC_BLOCKS, key=lambda b: b[0] not in (0x0600, 0xFE70)))}]&&[\\p{{L}}{_pick(((0x0870, 0x08FF),), lambda c: unicodedata.category(c)[0] == 'L')}]]"
JAVA_LT = r"\p{L}" + JAVA_AL
#: Latin letters and white space for Java, after a few ranges that most other characters fail.
JAVA_LA = f"[\\x{{0041}}-\\x{{024F}}&&[{LA}]]"
JAVA_WS = f"[[\\x{{0000}}-\\x{{0020}}\\x{{0085}}-\\x{{00A0}}\\x{{1680}}-\\x{{3000}}]&&[{WS}]]"
#: Presentation forms, marks and letters neither Arabic nor Latin, for Java; before that the ranges without any that most characters lie in.
JAVA_SUSPECT = f"[[^\\x{{0000}}-\\x{{00A9}}\\x{{00C0}}-\\x{{024F}}\\x{{0620}}-\\x{{064A}}]&&[{PF}{MK}[\\p{{L}}&&[^{AB}{LA}]]]]"
HARAKAT = body([(0x064B, 0x065F)])
SHADDA = "ّ"
QURANIC = body([(0x06D6, 0x06ED), (0x0670, 0x0670)])
ND = r"\p{Nd}"
#: What str.isdigit() takes besides decimal digits, in the basic plane.
DIGITS = ND + _pick([(0, 0xFFFF)], lambda c: c.isdigit() and unicodedata.category(c) != "Nd")
ARABIC_PUNCTUATION = "،؛؟۔"
#: A block that ends in one of these is complete.
TERMINAL = ".?!…:;،؛؟۔"
#: Punctuation that joins the word before it without a space.
NO_SPACE = r".,;:!?…،؛؟)\]}»›٪"
ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
XML_LEGAL = r"\t\n\r\x{0020}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}"
#: What a text repair looks for: Latin ligatures, presentation forms and control characters.
REPAIRABLE = r"\x{FB00}-\x{FB06}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}"
# Function words that speak for a language.
INDONESIAN = "yang dan dari dengan untuk adalah ini itu tidak dalam pada akan kita mereka saya para oleh juga atau bahwa sebagai".split()
ENGLISH = "the and of in to is that with for as on was are this be from have has".split()
#: Stripped from both ends of a word before it is looked up.
EDGE_PUNCTUATION = "[.,;:!?()\\[\\]\"'‘’“”]+"
#: Neutral characters go to the next run on a change of script; at the text's end to the last run.
_N = f"[^{AL}{LA}]"
SCRIPT_RUN = rf"{_N}*(?:[{AL}](?:{_N}*[{AL}])*|[{LA}](?:{_N}*[{LA}])*)(?:{_N}+\z)?|\A{_N}+\z"
#: The same, but marks stay with the run before them.
_P = f"[^{AL}{LA}{MK}]"
EDITED_RUN = rf"{_N}*(?:[{AL}](?:{_P}*[{AL}{MK}])*|[{LA}](?:{_P}*[{LA}{MK}])*)(?:{_N}+\z)?|\A{_N}+\z"
LIST_MARKER = rf"^(?:[•‣▪◦●○*·]|[-–—]|[0-9]{{1,2}}|[٠-٩]{{1,2}})[.)]?[{WS}]+"
ORDERED_MARKER = rf"^(?:[0-9]{{1,2}}|[٠-٩]{{1,2}})[.)][{WS}]+"
PAGE_NUMBER = rf"^[{WS}\-–—.(\[]*(\d{{1,4}})[{WS}\-–—.)\]]*$"
LABELED_PAGE = rf"(?i)^(?:page|halaman|p)\.?[{WS}]+(\d{{1,4}})$"
FOOTNOTE_MARKER = rf"^\(?(\d{{1,3}})[.)\]]?[{WS}]+[^{WS}]"
NUMBERING = rf"(?i)^(?:(?:bab|bagian|pasal|jilid|chapter)[{WS}]+[^{WS}]+|\d{{1,2}}(?:\.\d{{1,2}})*[.)]?[{WS}]+[^{WS}]+|[IVXLC]{{1,6}}[.)]?[{WS}]+[^{WS}]+)"
CAPTION_WORDS = r"^(gambar|figure|fig\.|الشكل|صورة)"
