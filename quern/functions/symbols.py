"""Declarations in lines of code, by a table of patterns for each language; the first that fits names the line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (languages by extension, kind, pattern, group of the name, group of the kind or 0).
_JS = (".js", ".jsx", ".ts", ".tsx")
_JVM = (".java", ".kt", ".kts", ".cs")
_C = (".c", ".cc", ".cpp", ".h", ".hpp")
MATCHERS = [
    ((".py",), "class", r"^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\b", 1, 0),
    ((".py",), "func", r"^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1, 0),
    (_JS, "class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)\b", 1, 0),
    (_JS, "func", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(", 1, 0),
    (_JS, "interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][A-Za-z0-9_$]*)\b", 1, 0),
    (_JS, "type", r"^\s*(?:export\s+)?type\s+([A-Za-z_$][A-Za-z0-9_$]*)\b", 1, 0),
    (_JS, "enum", r"^\s*(?:export\s+)?enum\s+([A-Za-z_$][A-Za-z0-9_$]*)\b", 1, 0),
    (_JS, "func", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][A-Za-z0-9_$]*)\s*=>", 1, 0),
    (_JVM, "", r"^\s*(?:public|protected|private|abstract|final|static|sealed|data|\s)*\s*(class|interface|enum|record|object)\s+([A-Za-z_][A-Za-z0-9_]*)\b", 2, 1),
    (_JVM, "method", r"^\s*(?:public|protected|private|static|final|abstract|synchronized|native|\s)+[\w<>\[\], ?]+\s+([A-Za-z_][A-Za-z0-9_]*)\s*\([^;]*\)\s*(?:\{|$)", 1, 0),
    ((".rs",), "", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(fn|struct|enum|trait)\s+([A-Za-z_][A-Za-z0-9_]*)\b", 2, 1),
    (_C, "func", r"^\s*(?:[\w:*&<>\[\],]+\s+)+([A-Za-z_][A-Za-z0-9_]*)\s*\([^;]*\)\s*(?:\{|$)", 1, 0),
]


def _java(pattern: str) -> str:
    """The same pattern where ``$`` means only the very end."""
    return pattern.replace("|$)", r"|\z)")


def declaration(line: Column, ext: Column) -> Column:
    """Struct of name and kind of the declaration in a line; null where no pattern of its language fits."""
    found = [F.when(ext.isin(list(exts)) & line.rlike(_java(p)), F.struct(F.regexp_extract(line, _java(p), n).alias("name"), (F.lower(F.regexp_extract(line, _java(p), k)) if k else F.lit(kind)).alias("kind"))) for exts, kind, p, n, k in MATCHERS]
    return F.coalesce(*found)


def declaration_sql(line: str, ext: str) -> tuple[str, str]:
    """The same as SQL: expressions of the name and of the kind."""
    quote = lambda xs: ", ".join(f"'{x}'" for x in xs)
    case = lambda value: "CASE " + " ".join(f"WHEN {ext} IN ({quote(exts)}) AND regexp_matches({line}, '{p}') THEN {value(kind, p, n, k)}" for exts, kind, p, n, k in MATCHERS) + " END"
    return case(lambda kind, p, n, k: f"regexp_extract({line}, '{p}', {n})"), case(lambda kind, p, n, k: f"lower(regexp_extract({line}, '{p}', {k}))" if k else f"'{kind}'")
