"""Declarations of source files, nested as they stand in the text; and the symbols of Go files with their receivers."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

from quern.functions.lexing import LEXERS, Bare, bare

#: Lines that begin so begin a declaration, whether or not what stands before was closed.
_OPENS = re.compile(r"[ \t]*(?:@\w|#\[|(?:export|default|public|protected|private|internal|static|final|abstract|sealed|data|open|override|async|pub|unsafe|func|fun|fn|function|class|interface|struct|enum|trait|impl|type|namespace|module|object|record|const|let|var|val|def|template|extension)\b)")
_MARKS = re.compile(r"[{}()\[\];]|\n")


@dataclass
class Declaration:
    """First and last line (from 1), and what is declared inside."""

    start: int
    end: int
    members: list[Declaration] = field(default_factory=list)


def find(text: str, ext: str) -> list[Declaration] | None:
    """Declarations of a file by its extension; None if the language is unknown, nothing is declared, or the scanner lost its way."""
    ext = ext.lower()
    if ext not in LEXERS:
        return None
    read = bare(text, ext)
    if ext == ".go":  # groups in brackets are blocks as well
        read.text = re.sub(r"^((?:import|type|const|var)[ \t]*)\(([^\n]*\n.*?^)\)", r"\1{\2}", read.text, flags=re.MULTILINE | re.DOTALL)
    found = _indented(text, read) if ext == ".py" else _braced(text, read)
    return found if found and sound(found, 1, text.count("\n") + 1) else None


def sound(found: list[Declaration], first: int, last: int) -> bool:
    """In order, disjoint, and inside what holds them."""
    for d in found:
        if d.start < first or d.end < d.start or d.end > last or not sound(d.members, d.start, d.end):
            return False
        first = d.end + 1
    return True


def _braced(text: str, read: Bare) -> list[Declaration] | None:
    """Blocks in braces of more than a line, each from the start of its statement and the comment above it.

    A statement starts after the last brace or semicolon, after a blank line, or with a line that begins with a declaring word.
    Braces inside other brackets belong to the statement that has the brackets.
    """
    lines, shown = text.split("\n"), read.text.split("\n")
    starts = list(accumulate((len(x) + 1 for x in lines), initial=0))
    own: list[Declaration] = []
    stack: list[tuple[int, int, list[Declaration], int, int]] = []  # line of the brace, first line of the statement, what holds the block, open brackets, where the statement begins
    line, brackets, since, tail = 1, 0, 0, ""
    for m in _MARKS.finditer(read.text):
        c = m[0]
        if c == "\n":
            tail = shown[line - 1].strip() or tail
            blank = not lines[line - 1].strip()
            line += 1
            opens = _OPENS.match(shown[line - 1]) and not (tail.startswith(("@", "#[")) or tail.endswith((",", "=", "&", "|", ":")))
            if brackets == 0 and (blank or opens):
                since = m.end()
        elif c in "([":
            brackets += 1
        elif c in ")]":
            brackets = max(0, brackets - 1)
        elif c == ";":
            since = since if brackets else m.end()
        elif c == "{":
            first = re.compile(r"\S").search(read.text, since)
            stack.append((line, bisect_right(starts, first.start()), own, brackets, since))
            own, brackets, since, tail = [], 0, m.end(), ""
        else:
            if not stack:
                return None
            opened, start, outer, brackets, before = stack.pop()
            members, own, since, tail = own, outer, before if brackets else m.end(), ""
            if line > opened:
                while start > 1 and lines[start - 2].strip() and not shown[start - 2].strip():
                    start -= 1  # a line of nothing but comment
                inner = [x for x in members if x.start > start and x.end < line]
                if own and start <= own[-1].end:  # goes on in the line where the last block ended
                    own[-1].members += [x for x in inner if x.start > own[-1].end]
                    own[-1].end = line
                else:
                    own.append(Declaration(start, line, inner))
    return None if stack else own


def _indented(text: str, read: Bare) -> list[Declaration]:
    """Definitions and classes with their decorators, each to the last line that is indented further."""
    top: list[Declaration] = []
    stack: list[tuple[int, Declaration]] = []  # indent, and what is open
    held, last, depth = 0, 0, 0  # first decorator, last line of a statement, open brackets
    for n, line in enumerate(read.text.split("\n"), 1):
        goes_on = depth > 0 or n in read.inside
        depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
        if goes_on or not line.strip():
            last = n if goes_on and (line.strip() or n in read.inside) else last
            continue
        indent = len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
        while stack and stack[-1][0] >= indent and not held:
            stack.pop()[1].end = last
        word = line.strip()
        if word.startswith("@"):
            held = held or n
        elif re.match(r"(?:async\s+)?def\b|class\b", word):
            new = Declaration(held or n, n)
            (stack[-1][1].members if stack else top).append(new)
            stack.append((indent, new))
            held = 0
        else:
            held = 0
        last = n
    for _, d in stack:
        d.end = max(last, d.start)
    return top


# The words that declare at the top level of a Go file.
_GO_FUNC = re.compile(r"func\s*(?:\(\s*(?:[\w_]+\s+)?(?P<receiver>[^()]*(?:\[[^\]]*\])?)\s*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*(?P<rest>\([^{]*)")
_GO_GROUP = re.compile(r"(?P<word>type|const|var)\b\s*(?P<open>\()?")
_GO_TYPE = re.compile(r"\s*(?P<name>[A-Za-z_]\w*)(?:\s*\[[\w\s,~|.*\[\]]*[A-Za-z_][\w\s,~|.*]*\])?\s*=?\s*(?P<kind>struct|interface)?\b")
_GO_NAMES = re.compile(r"\s*(?P<names>[A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)")


def go_symbols(text: str) -> list[tuple[str, str, int, str, str]]:
    """(name, kind, line, parent, signature) of the functions, methods, types, constants and variables of a Go file; a method's parent is its receiver's type."""
    shown = bare(text, ".go").text.split("\n")
    out: list[tuple[str, str, int, str, str]] = []
    depth, group, base = 0, "", 0
    for n, line in enumerate(shown, 1):
        if depth == 0:
            group = ""
            if m := _GO_FUNC.match(line if ")" in line else " ".join(s.strip() for s in shown[n - 1 : n + 20])):
                parent = re.sub(r"\[.*|.*\.|[*\s]", "", m["receiver"] or "")
                signature = re.sub(r"\s+", " ", m["rest"]).strip()
                out.append((m["name"], "method" if parent else "func", n, parent, f"func {f'({parent}) ' if parent else ''}{m['name']}{signature}"))
            elif m := _GO_GROUP.match(line):
                if m["open"]:
                    group, base = m["word"], 1
                    out += _specs(m["word"], line[m.end() :], n)
                else:
                    out += _specs(m["word"], line[m.end() :], n)
        elif group and depth == base:
            out += _specs(group, line, n)
        depth = max(0, depth + sum(line.count(c) for c in "({[") - sum(line.count(c) for c in ")}]"))
    return out


def _specs(word: str, line: str, n: int) -> Iterator[tuple[str, str, int, str, str]]:
    """What a line of a declaration, or of a group of them, names; the blank name is none."""
    for spec in line.split(";"):
        if word == "type" and (m := _GO_TYPE.match(spec)):
            kind = m["kind"] or "type"
            yield m["name"], kind, n, "", f"{kind} {m['name']}"
        elif word != "type" and (m := _GO_NAMES.match(spec)):
            yield from ((name, word, n, "", f"{word} {name}") for name in re.split(r"\s*,\s*", m["names"]))
