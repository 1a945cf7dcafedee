"""Small helpers of the inline scan: bare links, typographic replacements and smart quotes."""

from __future__ import annotations

import re
import unicodedata

# The generic top-level domains that a link without a scheme may end in, besides all of two letters.
TLDS = "biz com edu gov net org pro web xxx aero asia coop info museum name shop рф".split()
_NAME = r"[A-Za-z0-9¡-\U0010ffff]"
_LABELS = rf"(?:{_NAME}(?:(?:{_NAME}|-)*{_NAME})?\.)+"
_END = r"(?![A-Za-z0-9¡-\U0010ffff@-])"
_HOST = rf"{_LABELS}(?:{'|'.join(TLDS)}|[A-Za-z]{{2}}){_END}"
_ANY_HOST = rf"(?:localhost|{_LABELS}{_NAME}(?:(?:{_NAME}|-)*{_NAME})?){_END}"
_PATH = r"(?:[/?#][^\s<>]*)?"
URL = re.compile(r"(?:https?|ftp)://(?=[^\s/?#<>])[^\s<>]+", re.I)
_BARE = re.compile(rf"(?<![\w@./:\\-])(?:(?P<mail>(?:mailto:)?[A-Za-z0-9][\w.+=&$,;-]{{0,255}}@{_HOST})|(?P<url>{URL.pattern})|(?P<host>{_HOST}{_PATH})|(?P<slashes>//{_ANY_HOST}{_PATH}))", re.I)


def trimmed(url: str) -> str:
    """A URL without the punctuation that ends the sentence around it."""
    end, left = len(url), {c: url.count(c) for c in "()[]{}"}
    while end:
        last = url[end - 1]
        if last in ".,:;!?'\"*" or (last in ")]}" and left[last] > left[{")": "(", "]": "[", "}": "{"}[last]]):
            end -= 1
            if last in left:
                left[last] -= 1
        else:
            break
    return url[:end]


def bare_links(text: str) -> list[tuple[int, int, str]]:
    """(start, end, URL) of the links in plain text."""
    found = []
    for m in _BARE.finditer(text) if "." in text or "//" in text else ():
        said = trimmed(m[0])
        if not said:
            continue
        url = said if m["url"] or m["slashes"] else (said if said.lower().startswith("mailto:") else f"mailto:{said}") if m["mail"] else f"http://{said}"
        found.append((m.start(), m.start() + len(said), url))
    return found


# Signs for letters in round brackets.
SIGNS = {"c": "©", "r": "®", "tm": "™"}
_RUNS = re.compile(r"\((?P<sign>c|r|tm)\)|(?P<plus>\+-)|(?P<marks>[?!]+)(?P<after>\.{2,})?|(?P<dots>\.{2,})|(?P<commas>,{2,})|(?P<dashes>-{2,})", re.I)


def replaced(text: str) -> str:
    """Typographic replacements in a text run, run of characters by run: signs, plus-minus, dots, marks, commas and dashes."""

    def run(m: re.Match) -> str:
        kind = m.lastgroup if m.lastgroup != "after" else "marks"
        if kind == "sign":
            return SIGNS[m["sign"].lower()]
        if kind == "plus":
            return "±"
        if kind == "dots":
            return "…"
        if kind == "commas":
            return ","
        if kind == "marks":  # three marks are enough, and two dots after them
            marks = m["marks"]
            return (marks if len(marks) < 4 else marks[-1] * 3) + (".." if m["after"] else "")
        width = len(m[0])
        if width > 3:
            return m[0]
        if width == 3:
            return "—"
        before, behind = text[m.start() - 1 : m.start()].replace("\n", ""), text[m.end() : m.end() + 1].replace("\n", "")
        one_sided = before and behind and before.isspace() != behind.isspace()  # the end of a line goes with either
        return m[0] if one_sided else "–"

    return _RUNS.sub(run, text)


def _kind(c: str) -> str:
    """``" "`` for white space and the ends of a text, ``"."`` for punctuation, ``"a"`` for the rest."""
    if not c or c in "\t\n\x0b\x0c\r":
        return " "
    group = unicodedata.category(c)
    return " " if group == "Zs" else "." if group[0] in "PS" else "a"


#: What a quote between two characters of these kinds may do: open (1), close (2) or both (3).
_SIDES = {"  ": 0, " .": 1, " a": 1, ". ": 2, "a ": 2, "..": 3, ".a": 1, "a.": 2, "aa": 0}


def _role(before: str, mark: str, after: str) -> int:
    if mark == after == '"' and "0" <= before <= "9":
        return 0  # inches
    return _SIDES[_kind(before) + _kind(after)]


def smart_quotes(tokens: list[list], quotes: str | list[str]) -> None:
    """Turn straight quotes in the text tokens to typographic ones, in place.

    Every quote gets a role from its two neighbours and a depth from the tags around it; then the quotes of
    one depth are paired as brackets are; apostrophes are what remains of closing and role-less single ones.
    """
    near = {"text", "text_special", "code_inline", "html_inline"}
    said = [t[4] if t[0] in near else " " if t[0] in ("softbreak", "hardbreak") else "" for t in tokens]
    joined = "".join(said)
    offset = depth = 0
    marks: list[tuple[int, int, str, int, int]] = []  # token, position, character, role, depth
    floors: list[tuple[int, int]] = []  # number of marks seen, depth of each text token
    for k, t in enumerate(tokens):
        depth += min(t[2], 0)
        if t[0] == "text":
            floors.append((len(marks), depth))
            for m in re.finditer("['\"]", t[4]):
                at = offset + m.start()
                marks.append((k, m.start(), m[0], _role(joined[at - 1] if at else "", m[0], joined[at + 1 : at + 2]), depth))
        offset += len(said[k])
        depth += max(t[2], 0)
    signs: dict[tuple[int, int], str] = {}
    waiting: list[tuple[int, int, str, int, int]] = []
    places: dict[tuple[str, int], list[int]] = {}  # of the waiting quotes of a kind and depth

    def leave() -> None:
        left = waiting.pop()
        places[left[2], left[4]].pop()

    floor = 0
    for n, mark in enumerate(marks):
        while floor < len(floors) and floors[floor][0] <= n:  # a text outside of a tag ends the quotes opened in it
            while waiting and waiting[-1][4] > floors[floor][1]:
                leave()
            floor += 1
        k, at, c, role, level = mark
        same = places.setdefault((c, level), [])
        if role & 2 and same:
            partner = same[-1]
            pair = quotes[:2] if c == '"' else quotes[2:4]
            signs[waiting[partner][:2]], signs[k, at] = pair[0], pair[1]
            while len(waiting) > partner:
                leave()
        elif role & 1:
            same.append(len(waiting))
            waiting.append(mark)
        elif c == "'":
            signs[k, at] = "’"
    changed: dict[int, dict[int, str]] = {}
    for (k, at), sign in signs.items():
        changed.setdefault(k, {})[at] = sign
    for k, by in changed.items():
        tokens[k][4] = "".join(by.get(i, c) for i, c in enumerate(tokens[k][4]))

