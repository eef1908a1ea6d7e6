"""Source text without what is no structure: strings become ``_``, comments become blanks, and all lines stay."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_SLASHES = r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:\\[\s\S]|[^"\\])*(?:"|\Z)', r"'(?:\\[\s\S]|[^'\\])*(?:'|\Z)"
_LINE_DOUBLE, _LINE_SINGLE = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"
_CHARACTER = r"'(?:\\[^\n']+|[^'\\\n])'"  # and nothing longer: a lone quote marks a lifetime or is part of a number
_TRIPLE = r'"""[\s\S]*?(?:"""|\Z)'
_TEMPLATE = r"`(?:\\[\s\S]|[^`\\])*(?:`|\Z)"
#: A slash after these begins a pattern; after a value it divides.
_PATTERN = r"(?P<before>[(,=:\[!&|?{};+\-*~^<>%]\s*|\b(?:return|typeof|instanceof|in|of|new|delete|void|throw|case|do|else|yield|await)\s+|\A\s*)(?P<pattern>/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/)"
_HEREDOC = r"<<<[ ]*['\"]?(?P<tag>\w+)['\"]?[^\n]*\n[\s\S]*?(?:^[ \t]*(?P=tag)\b|\Z)"

#: By extension: the strings and comments of a language.
_JS = rf"{_SLASHES})|(?P<string>{_TEMPLATE}|{_LINE_DOUBLE}|{_LINE_SINGLE})|{_PATTERN}"
_JVM = rf"{_SLASHES})|(?P<string>{_TRIPLE}|{_LINE_DOUBLE}|{_CHARACTER})"
_LANGUAGES = {
    (".go",): rf"{_SLASHES})|(?P<string>`[^`]*(?:`|\Z)|{_LINE_DOUBLE}|{_CHARACTER})",
    (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"): _JS,
    (".java", ".kt", ".scala", ".swift"): _JVM,
    (".cs",): rf'{_SLASHES})|(?P<string>\$?@\$?"(?:""|[^"])*(?:"|\Z)|{_TRIPLE}|{_LINE_DOUBLE}|{_CHARACTER})',
    (".c", ".h", ".cc", ".cpp", ".hpp"): rf'{_SLASHES}|^[ \t]*\#(?:\\\n|[^\n])*)|(?P<string>R"(?P<raw>[^(\s]*)\([\s\S]*?(?:\)(?P=raw)"|\Z)|{_LINE_DOUBLE}|{_CHARACTER})',
    (".rs",): rf'{_SLASHES})|(?P<string>\bb?r(?P<raw>\#*)"[\s\S]*?(?:"(?P=raw)|\Z)|{_DOUBLE}|{_CHARACTER})',
    (".php",): rf"{_SLASHES}|\#(?!\[)[^\n]*)|(?P<string>{_HEREDOC}|{_DOUBLE}|{_SINGLE})",
    (".py",): rf"(?P<comment>\#[^\n]*)|(?P<string>{_TRIPLE}|'''[\s\S]*?(?:'''|\Z)|{_LINE_DOUBLE}|{_LINE_SINGLE})",
}
LEXERS = {ext: re.compile(pattern, re.MULTILINE) for exts, pattern in _LANGUAGES.items() for ext in exts}


@dataclass
class Bare:
    """Text as long as the source, and the lines (from 1) that begin inside a string or a comment."""

    text: str
    inside: set[int] = field(default_factory=set)


def bare(source: str, ext: str) -> Bare:
    """The source of a language without the words of its strings, patterns and comments."""
    out, at, line = [], 0, 1
    inside: set[int] = set()
    for m in LEXERS[ext].finditer(source):
        kind = "pattern" if m.groupdict().get("pattern") else "comment" if m["comment"] is not None else "string"
        a, b = m.span(kind)
        line += source.count("\n", at, a)
        out.append(source[at:a])
        held = source[a:b]
        out.append(re.sub(r"[^\n]", " " if kind == "comment" else "_", held))
        breaks = held.count("\n")
        inside.update(range(line + 1, line + breaks + 1))
        line, at = line + breaks, b
    out.append(source[at:])
    return Bare("".join(out), inside)
