"""What a walk over a workspace passes over, as predicates on paths."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders of dependencies and of build output, files worth indexing, and what tools have made.
SKIPPED_DIRS = "Pods __pycache__ build bundle deps dist env node_modules out pkg target temp tmp vendor venv".split()
EXTENSIONS = ".c .cpp .cs .css .ejs .el .elm .erb .ex .exs .go .h .hpp .htm .html .java .js .json .jsx .kt .kts .lua .markdown .md .ml .mli .php .py .rb .rdl .rs .scala .sol .swift .tla .toml .ts .tsx .vb .vue .zig".split()
GENERATED_SUFFIXES = ".min.js .min.css .map -lock.json .lock .generated.ts .generated.js .generated.go _generated.go .gen.go .pb.go".split()
GENERATED_NAMES = "package-lock.json yarn.lock pnpm-lock.yaml composer.lock go.sum cargo.lock poetry.lock".split()
MAX_SIZE = 1 << 20
MAX_LINE, MEAN_LINE = 5000, 400


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ignore_regex(pattern: str) -> str:
    """A line of an ignore file as a pattern over whole relative paths: ``/x`` stands at the root, ``x/`` is a folder."""
    rooted, folder = "/" in pattern.rstrip("/"), pattern.endswith("/")
    marks = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(marks.get(p) or re.escape(p) for p in re.split(r"(\*\*/|\*\*|\*|\?)", pattern.strip("/")) if p)
    return ("^" if rooted else "^(?:.*/)?") + body + ("/.*$" if folder else "(?:/.*)?$")


def walked(path: Column, ignore: list[str] = ()) -> Column:
    """Whether a walk reaches a file: no hidden file or folder, no skipped folder, no ignored path above or at it."""
    dirs = "|".join(map(re.escape, SKIPPED_DIRS))
    hidden = path.rlike(r"(?:^|/)\.[^/]")
    return reduce(lambda a, p: a & ~path.rlike(ignore_regex(p)), ignore, ~hidden & ~path.rlike(f"(?:^|/)(?:{dirs})/"))


def indexable(path: Column, size: Column) -> Column:
    """Whether a file is worth indexing by its name and size."""
    low = F.lower(name(path))
    made = reduce(lambda a, s: a | low.endswith(s), GENERATED_SUFFIXES, low.isin(GENERATED_NAMES))
    return (size > 0) & (size <= MAX_SIZE) & F.regexp_extract(low, r"(\.[^.]*)$", 1).isin(EXTENSIONS) & ~made


def written_by_hand(content: Column) -> Column:
    """Whether lines are short enough, each and on the whole, to be searched; in bytes."""
    lines = F.split(content, "\n", -1)
    return (F.floor(F.octet_length(content) / F.size(lines)) <= MEAN_LINE) & (F.array_max(F.transform(lines, lambda x: F.octet_length(x))) <= MAX_LINE)
