"""Text cleaning expressions.

Every step is a built-in ``regexp_replace``/``replace`` so the whole chain is one
projected expression under whole-stage codegen; no Python UDF is involved.

Two modes:

* ``as_written`` (default) reproduces what the reference's patterns really match,
  quirks included (emoticon pattern is a no-op, the t.co pattern lacks the colon,
  ``RT`` is cut inside words, the URL pattern needs a literal capital ``S``).
* ``intended`` applies what the comments describe; URLs are stripped before
  emoticons because the emoticon pattern would otherwise eat ``p:`` in ``http:``.

Java's ``\\w``/``\\s`` are ASCII-only while the reference's are Unicode, so
explicit classes are used.  The same pattern text also runs unchanged in RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (patterns that must agree with the reference's behaviour) ----
# Unicode whitespace as matched by Python's \s on str.
WS = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x1f \x{85}\p{Z}]"
# Unicode word characters as matched by Python's \w on str.
WORD = r"[\p{L}\p{N}_]"
# Code points with the property Emoji in the public Unicode data, version 17.0, without digits, # and * (which are emoji
# in keycaps only): ranges in hexadecimal, ascending.
EMOJI_RANGES = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0
25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653
265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE
26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716
271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07
2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1E6-1F1FF 1F201-1F202
1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5
1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596
1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F
1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D9 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A
1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FAC6 1FAC8 1FACC-1FADD 1FADF-1FAEB 1FAEF-1FAFA
"""
EMOJI_MOD = r"[\x{FE0F}\x{1F3FB}-\x{1F3FF}]"
EMOJI_TAGS = r"(?:[\x{E0020}-\x{E007E}]+\x{E007F})?"
EMOJI_KEYCAP = r"[0-9#*]\x{FE0F}?\x{20E3}"
# Intended emoticon pattern: eyes, optional nose, mouth -- and the mirror image.
EMOTICON = (r"[<>]?[:;=8][-o*']?[)\](\[dDpP/:}{@|\\]"
            r"|[)\](\[dDpP/:}{@|\\][-o*']?[:;=8][<>]?")
MENTION = "@" + WORD + "+"
TCO_AS_WRITTEN = r"http//t[^\n]co/" + NOT_WS + "+"
TCO_INTENDED = r"https?://t\.co/" + NOT_WS + "+"
RT_AS_WRITTEN = "RT" + WS + "+"
RT_INTENDED = r"^RT" + WS + "+"
URL_AS_WRITTEN = r"https?://S+"
URL_INTENDED = r"https?://" + NOT_WS + "+"
# ---------------------------------------------------------------------------------

AS_WRITTEN = "as_written"
INTENDED = "intended"


def emoji_class(ranges: str = EMOJI_RANGES) -> str:
    """A character class of the ranges."""
    ends = [r.split("-") for r in ranges.split()]
    return "[" + "".join(f"\\x{{{r[0]}}}" + (f"-\\x{{{r[1]}}}" if len(r) > 1 else "") for r in ends) + "]"


EMOJI_BASE = emoji_class()
EMOJI_ONE = EMOJI_BASE + EMOJI_MOD + "*" + EMOJI_TAGS
EMOJI_SEQUENCE = EMOJI_ONE + r"(?:\x{200D}" + EMOJI_ONE + ")*"
# Nearly all characters of a text are none of these few ranges, which hold every first code point of a sequence: letters
# of all scripts and common punctuation are below, between or above them.  So the long class is walked for symbols only.
EMOJI_FIRST = r"[\x{A9}\x{AE}\x{203C}-\x{303D}\x{3297}-\x{3299}\x{1F004}-\x{1FAFF}]"
EMOJI = "(?:" + EMOJI_KEYCAP + "|(?=" + EMOJI_FIRST + ")" + EMOJI_SEQUENCE + ")"
# A keycap has this mark.  A text without it has no keycaps, so no character below the first of EMOJI_FIRST matters there,
# which one comparison tells.
KEYCAP_MARK = "\u20e3"
EMOJI_NO_KEYCAP = r"(?=[\x{A9}-\x{1FAFF}])(?=" + EMOJI_FIRST + ")" + EMOJI_SEQUENCE


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _check(mode: str) -> None:
    if mode not in (AS_WRITTEN, INTENDED):
        raise ValueError(f"mode must be {AS_WRITTEN!r} or {INTENDED!r}, got {mode!r}")


def strip_emoji(c) -> Column:
    """Delete emoji sequences (flags, ZWJ families, skin tones, keycaps)."""
    return _strip_emoji(_col(c), lambda c: F.regexp_replace(c, EMOJI, ""))


def _strip_emoji(c: Column, with_keycaps) -> Column:
    """``with_keycaps`` of texts that hold a keycap's mark; of the others no more is looked for than can be there."""
    return F.when(F.contains(c, F.lit(KEYCAP_MARK)), with_keycaps(c)).otherwise(F.regexp_replace(c, EMOJI_NO_KEYCAP, ""))


def strip_emoticon(c, mode: str = AS_WRITTEN) -> Column:
    """As written the pattern never matches ordinary text (identity)."""
    _check(mode)
    c = _col(c)
    return c if mode == AS_WRITTEN else F.regexp_replace(c, EMOTICON, "")


def strip_mention(c) -> Column:
    """Delete ``@`` followed by word characters, anywhere in the text."""
    return F.regexp_replace(_col(c), MENTION, "")


def strip_hash(c) -> Column:
    """T4: delete the ``#`` character only, keeping the tag word."""
    return F.replace(_col(c), F.lit("#"), F.lit(""))


def strip_tco(c, mode: str = AS_WRITTEN) -> Column:
    """T5: as written only the colon-less ``http//t?co/...`` form is cut."""
    _check(mode)
    return F.regexp_replace(_col(c), TCO_AS_WRITTEN if mode == AS_WRITTEN else TCO_INTENDED, "")


def strip_rt(c, mode: str = AS_WRITTEN) -> Column:
    """As written ``RT`` + whitespace is cut anywhere, also inside words."""
    _check(mode)
    return F.regexp_replace(_col(c), RT_AS_WRITTEN if mode == AS_WRITTEN else RT_INTENDED, "")


def strip_url(c, mode: str = AS_WRITTEN) -> Column:
    """As written only ``http(s)://`` followed by capital ``S`` characters is cut."""
    _check(mode)
    return F.regexp_replace(_col(c), URL_AS_WRITTEN if mode == AS_WRITTEN else URL_INTENDED, "")


def sanitize(c, mode: str = AS_WRITTEN) -> Column:
    """The full cleaning chain as one expression.

    Callers in the reference strip emoji and then run the chain, which strips emoji again first.  The first pass leaves
    no emoji code point behind, so all that the second can find are keycaps that close up where an emoji stood between
    their parts; it looks for these alone.
    """
    _check(mode)
    c = _strip_emoji(_col(c), lambda c: F.regexp_replace(F.regexp_replace(c, EMOJI, ""), EMOJI_KEYCAP, ""))
    if mode == AS_WRITTEN:
        c = strip_emoticon(c, mode)
        c = strip_mention(c)
        c = strip_hash(c)
        c = strip_tco(c, mode)
        c = strip_rt(c, mode)
        return strip_url(c, mode)
    c = strip_tco(c, mode)
    c = strip_url(c, mode)
    c = strip_emoticon(c, mode)
    c = strip_mention(c)
    c = strip_hash(c)
    return strip_rt(c, mode)


def decorate(text, doc_id) -> Column:
    """Fixture decoration that makes every cleaning branch fire on plain prose."""
    return F.concat(F.lit("RT @usr_"), _col(doc_id).cast("string"), F.lit(" ART "), _col(text),
                    F.lit(" #tag https://Sabc http//t.co/zz :-) \U0001F600"))
