"""RE2 patterns as Java patterns that match the same lines, or an error where RE2 has one."""

from __future__ import annotations

import re

from lumora.functions.errors import QueryError

_ATOMS = re.compile(
    r"(?P<esc>\\(?:Q(?:.|\n)*?(?:\\E|$)|x\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{2}|[0-7]{3}|[pP](?:\{\^?\w+\}|\w)|(?:.|\n)))"
    r"|(?P<open>\((?:\?(?:P<\w+>|<\w+>|[imsU]*(?:-[imsU]+)?[:)]))?)"
    r"|(?P<class>\[\^?\]?(?:\\(?:[pP]\{\^?\w+\}|(?:.|\n))|\[:\^?\w+:\]|[^\]\\])*\])"
    r"|(?P<repeat>\{\d+(?:,\d*)?\}[?+]?|[*+?][?+*]?)"
    r"|(?P<dollar>\$)|(?P<other>.|\n)"
)
_PERL = {"s": "[\\t\\n\\f\\r ]", "S": "[^\\t\\n\\f\\r ]"}


def _escape(text: str) -> str:
    c = text[1:2]
    if c == "Q":
        body = text[2:-2] if text.endswith("\\E") else text[2:]
        return "".join("\\" + x if not (x.isalnum() or x == "_" or ord(x) > 127) else x for x in body)
    if c in _PERL:
        return _PERL[c]
    if c == "z":
        return "\\z"
    if len(text) == 1 or c in "CEGHKLNORTVWXYZceghklmoquyj" and c not in "W" or c.isdigit() and not re.fullmatch(r"\\[0-7]{3}", text):
        raise QueryError(f"unsupported escape in a pattern: {text}")
    if re.fullmatch(r"\\[0-7]{3}", text):
        return f"\\x{{{int(text[1:], 8):x}}}"
    if c in "pP" and "{^" in text:
        return text.replace("{^", "{").replace("\\p", "\\\0").replace("\\P", "\\p").replace("\\\0", "\\P")
    return text


def _inside(text: str) -> str:
    """A character class: brackets and ampersands in it are plain in RE2."""
    body = text[1:-1]
    out, at = "[", 0
    if body.startswith("^"):
        out, body = "[^", body[1:]
    first = True
    while at < len(body):
        posix = re.match(r"\[:(\^?)(\w+):\]", body[at:])
        if posix:
            name = {"word": "w", "alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "space": "Space", "blank": "Blank", "cntrl": "Cntrl", "graph": "Graph", "print": "Print", "xdigit": "XDigit", "ascii": "ASCII"}.get(posix[2])
            if not name:
                raise QueryError(f"no such class: {posix[0]}")
            out += ("\\W" if posix[1] else "\\w") if name == "w" else f"\\{'P' if posix[1] else 'p'}{{{name}}}"
            at += posix.end()
        elif body[at] == "\\":
            esc = re.match(r"\\(?:x\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{2}|[0-7]{3}|[pP](?:\{\^?\w+\}|\w)|(?:.|\n))", body[at:])
            if not esc:
                raise QueryError(f"a pattern ends in an escape: {text}")
            if esc[0] in ("\\b", "\\B", "\\A", "\\z"):
                raise QueryError(f"unsupported escape in a class: {esc[0]}")
            out += "\\t\\n\\f\\r " if esc[0] == "\\s" else _escape(esc[0])
            at += esc.end()
        else:
            c = body[at]
            out += "\\" + c if c in "[&]" or c == "^" and first and out == "[" else c
            at += 1
        first = False
    return out + "]"


def java_pattern(text: str) -> str:
    """For unanchored search with ``rlike``."""
    out, depth, repeatable = [], 0, False
    multi = [False]
    for m in _ATOMS.finditer(text):
        kind, atom = m.lastgroup, m[0]
        if kind == "repeat":
            if not repeatable:
                if atom[0] == "{":
                    out.append("\\" + atom[:-1] + "\\}" if atom.endswith("}") else "\\" + atom)
                    continue
                raise QueryError(f"nothing to repeat: {text!r}")
            bounds = [int(n) for n in re.findall(r"\d+", atom)]
            if atom[-1:] in "+*" and len(atom) > 1 or any(n > 1000 for n in bounds) or len(bounds) == 2 and bounds[0] > bounds[1]:
                raise QueryError(f"unsupported repetition {atom!r} in {text!r}")
            out.append(atom)
            repeatable = False
            continue
        repeatable = True
        if kind == "esc":
            out.append(_escape(atom))
        elif kind == "open":
            if atom == "(" and text[m.end() : m.end() + 1] == "?":
                raise QueryError(f"unsupported group in {text!r}")
            flags = re.match(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])", atom)
            state = multi[-1]
            if flags:
                on, off, end = flags[1], flags[2] or "", flags[3]
                state = ("m" in on or state) and "m" not in off
                java = on.replace("U", "").replace("i", "iu") + ("-" + off.replace("U", "") if off.replace("U", "") else "")
                out.append(f"(?{java}{end}" if java or end == ":" else "")
                if end == ")":
                    multi[-1] = state
                    repeatable = False
                    continue
            else:
                out.append(atom.replace("(?P<", "(?<").replace("_", "") if atom.startswith("(?") else atom)
            depth += 1
            multi.append(state)
            repeatable = False
        elif kind == "class":
            out.append(_inside(atom))
        elif kind == "dollar":
            out.append("$" if multi[-1] else "\\z")
        elif atom == ")":
            depth -= 1
            if depth < 0:
                raise QueryError(f"unexpected ) in {text!r}")
            multi.pop()
            out.append(atom)
        elif atom == "\\":
            raise QueryError(f"a pattern ends in an escape: {text!r}")
        elif atom == "[":
            raise QueryError(f"a class is not closed in {text!r}")
        elif atom == "|":
            out.append(atom)
            repeatable = False
        else:
            out.append("\\" + atom if atom in "{}]" else atom)
    if depth:
        raise QueryError(f"a group is not closed in {text!r}")
    return "(?d)" + "".join(out)
