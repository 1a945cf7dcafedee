"""URLs and escapes: plain functions for the Arrow helpers, and the same as Column functions."""

from __future__ import annotations

import html
import re
import urllib.parse
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schemes that a link may not have, image types that a data URL may have, characters that stay as they are in a URL.
BAD_SCHEMES, GOOD_IMAGES, SAFE = "vbscript|javascript|file|data", "gif|png|jpeg|webp", ";/?:@&=+$,-_.!~*'()#%"
_BAD = re.compile(rf"(?:{BAD_SCHEMES}):(?!(?<=data:)image/(?:{GOOD_IMAGES});)", re.I)
#: Scheme and slashes, user, host, rest.
_PARTS = re.compile(r"((?:https?:|mailto:)(?://)?|//)((?:[^/?#@]*@)?)([^/?#]*)(.*)", re.S | re.I)
UNESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])|&(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")


def to_ascii(host: str) -> str:
    """A host name with its labels beyond ASCII in punycode."""
    return host if host.isascii() else ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in re.split("[.。．｡]", host))


def to_unicode(host: str) -> str:
    """A host name with its punycode labels decoded; labels that are none stay."""

    def label(m: re.Match) -> str:
        try:
            return m[1].encode().decode("punycode")
        except UnicodeError:
            return m[0]

    return re.sub(r"(?<![^.])xn--([A-Za-z0-9-]+)", label, host) if "xn--" in host else host


def normalize_link(url: str) -> str:
    """Percent-encode what may not stand in a URL; host names beyond ASCII by punycode."""
    m = None if url.isascii() else _PARTS.match(url)
    if m:
        url = m[1] + m[2] + to_ascii(m[3]) + m[4]
    return urllib.parse.quote(re.sub(r"%(?![0-9a-fA-F]{2})", "%25", url), safe=SAFE, errors="replace")


def normalize_link_text(url: str) -> str:
    """The URL for a reader: decoded where that gives valid text and hides no reserved character."""

    def decoded(m: re.Match) -> str:
        try:
            text = urllib.parse.unquote(m[0], errors="strict")
        except UnicodeDecodeError:
            return m[0]
        return "".join(f"%{ord(c):02X}" if c in ";/?:@&=+$,#%" or ord(c) < 32 else c for c in text)

    scheme, host, rest = re.match(r"((?:https?:|mailto:)?(?://)?(?:[^/?#@]*@)?)([^/?#]*)(.*)", url, re.S | re.I).groups()
    return re.sub(r"(?:%[0-9a-fA-F]{2})+", decoded, scheme + to_unicode(host) + rest)


def valid_link(url: str) -> bool:
    return not _BAD.match(url.strip())


def label_key(label: str) -> str:
    """Labels that differ in case or inner white space are one."""
    return re.sub(r"\s+", " ", label.strip()).lower().upper()


def entity(name: str) -> str | None:
    """The character of an entity without & and ;: a name, #digits or #xdigits."""
    return html.entities.html5.get(name + ";") if name[0] != "#" else code_point(int(name[2:], 16) if name[1] in "xX" else int(name[1:]))


def valid_code(code: int) -> bool:
    """Whether a number names a character: no surrogate, noncharacter or control."""
    return 0 <= code <= 0x10FFFF and not (0xD800 <= code <= 0xDFFF or 0xFDD0 <= code <= 0xFDEF or code & 0xFFFE == 0xFFFE or code < 9 or code == 0xB or 0xE <= code <= 0x1F or 0x7F <= code <= 0x9F)


def code_point(code: int) -> str:
    return chr(code) if valid_code(code) else "\ufffd"


def unescape(text: str) -> str:
    """Backslash escapes and entities resolved; numbers that name no character stay as they are."""

    def one(m: re.Match) -> str:
        char = m[1] or entity(m[2])
        return m[0] if char in (None, "\ufffd") else char

    return UNESCAPE.sub(one, text) if "\\" in text or "&" in text else text


def _column(of: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(of, na_action="ignore")

    return lambda text: run(text)


#: The same over string columns, in Arrow batches; null gives null.
normalized_link, normalized_link_text, unescaped, host_to_ascii, host_to_unicode = map(_column, (normalize_link, normalize_link_text, unescape, to_ascii, to_unicode))


def is_valid_code(code: Column) -> Column:
    """``valid_code`` of an integer column."""
    bad = code.between(0xD800, 0xDFFF) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE) | (code < 9) | (code == 0xB) | code.between(0xE, 0x1F) | code.between(0x7F, 0x9F)
    return (code <= 0x10FFFF) & ~bad


def from_code(code: Column) -> Column:
    """The character of a code point; U+FFFD where it names none."""
    return F.when(is_valid_code(code), F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")).otherwise("\ufffd")
