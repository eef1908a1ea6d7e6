"""Redaction, fingerprints, buckets and clipping, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in the order in which they are applied, with their marks; later ones see what earlier ones left.
SCRUBS = [
    (r"(?i)([A-Z]:\\Users\\)[^/\\:\s\"']+", "$1_"),
    (r"(/(?:home|Users)/)[^/\\:\s\"']+", "$1_"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[redacted-email]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{16,}", "Bearer [redacted]"),
    (r"(?i)\b(api[_-]?key|access[_-]?token|refresh[_-]?token|id[_-]?token|authorization|secret|password|passwd|pwd|token)\b\s*[:=]\s*(?:Bearer\s+)?[\"']?[^\"'\s,;]+[\"']?", "$1=[redacted]"),
    (r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "[redacted-jwt]"),
    (r"\b(?:sk|rk)-(?:proj-)?[A-Za-z0-9_-]{16,}\b", "[redacted-key]"),
    (r"\b[0-9a-fA-F]{32,}\b", "[redacted-hex]"),
    (r"[A-Za-z0-9+/]{40,}={0,2}", "[redacted-token]"),
    (r"\b[A-Za-z0-9_-]{48,}\b", "[redacted-token]"),
]
#: What a text must hold for a pattern to be tried: one of these in its lower-case form, or a run that a pattern wants.
_RUN = "[A-Za-z0-9+/_-]{32}"
_HELD = [[":\\users\\"], ["/home/", "/users/"], ["@"], ["bearer"], ["key", "token", "authorization", "secret", "passw", "pwd"], ["eyj"], ["sk-", "rk-"], _RUN, _RUN, _RUN]


def let(x: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _ascii_edges(pattern: str) -> str:
    """The pattern with word edges between ASCII letters, digits and ``_`` and all else: the first one begins a word, the others end one."""
    begin, *rest = pattern.split(r"\b")
    if not rest:
        return pattern
    word = "[A-Za-z0-9_]"
    return begin + f"(?<!{word})(?={word})" + f"(?<={word})(?!{word})".join(rest)


def scrub(text: Column) -> Column:
    """Personal data and secrets as marks of their kind. Of a text that no pattern can match only cheap tests are made."""

    def one(t: Column, k: int) -> Column:
        held = t.rlike(_HELD[k]) if isinstance(_HELD[k], str) else let(F.lower(t), lambda low: reduce(lambda a, x: a | F.contains(low, F.lit(x)), _HELD[k], F.lit(False)))
        return F.when(held, F.regexp_replace(t, _ascii_edges(SCRUBS[k][0]), SCRUBS[k][1])).otherwise(t)

    # Each step names what the one before left several times, and computes it once.
    return reduce(lambda t, k: let(t, lambda x: one(x, k)), range(len(SCRUBS)), text)


def scrub_sql(text: str) -> str:
    for pattern, new in SCRUBS:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new.replace('$1', chr(92) + '1')}', 'g')"
    return text


# Forms of secrets that are masked where they stand.
SECRETS = [r"(?:sk|rk)-(?:proj-)?[A-Za-z0-9_-]{12,}", r"gh[pousr]_[A-Za-z0-9_]{20,}", r"github_pat_[A-Za-z0-9_]{20,}", r"xox[baprs]-[A-Za-z0-9-]{16,}", r"(?:AKIA|ASIA)[0-9A-Z]{16}", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"]
SECRET = rf"\b({'|'.join(SECRETS)})\b"
HIDDEN = "****"


def secrets(text: Column) -> Column:
    """Secrets of a known form in a text."""
    return F.regexp_extract_all(text, F.lit(_ascii_edges(SECRET)), F.lit(1))


def mask(secret: Column) -> Column:
    """Stars for all but the first four (of ``sk-`` and ``rk-`` keys six) and the last four characters; of a short one nothing is shown."""
    head = F.when(secret.startswith("sk-") | secret.startswith("rk-"), 6).otherwise(4)
    return F.when(F.length(secret) <= 12, F.lit(HIDDEN)).otherwise(F.concat(F.left(secret, head), F.repeat(F.lit("*"), F.length(secret) - head - 4), F.right(secret, F.lit(4))))


def mask_sql(secret: str) -> str:
    head = f"(CASE WHEN {secret}[1:3] IN ('sk-', 'rk-') THEN 6 ELSE 4 END)"
    return f"CASE WHEN length({secret}) <= 12 THEN '{HIDDEN}' ELSE left({secret}, {head}) || repeat('*', length({secret}) - {head} - 4) || right({secret}, 4) END"


def scrub_credentials(text: Column) -> Column:
    """The stronger form for what leaves the house: secrets named in prose, half masked ones, and opaque runs with a digit or both cases."""
    t = F.regexp_replace(text, _ascii_edges(r"(?i)\b(api[ _-]?key|access[ _-]?key|secret|token|authorization|bearer|credential)s?\b([\"']?\s*[:=]?\s*[\"']?)[A-Za-z0-9._~+/-]{12,}"), f"$1$2{HIDDEN}")
    t = F.regexp_replace(t, r"[A-Za-z0-9._-]*\*{2,}[A-Za-z0-9._-]*", HIDDEN)
    run = "[A-Za-z0-9_-]"
    mixed = f"(?={run}*[0-9])|(?=(?:{run}*[a-z]){run}*[A-Z])|(?=(?:{run}*[A-Z]){run}*[a-z])"
    return F.regexp_replace(t, f"(?<!{run})(?={run}{{16}})(?:{mixed}){run}+", HIDDEN)


# What varies between reports of one fault.
VARIABLES = [(r"https?://[^\s]+", "<url>"), (r"0x[0-9a-fA-F]+", "<addr>"), (r"(/[\w.-]+)+", "<path>"), (r":\d+(:\d+)?", ":<line>"), (r"\d+", "<n>")]


def normalised(text: Column) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), VARIABLES, text)


def normalised_sql(text: str) -> str:
    for pattern, new in VARIABLES:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


def fingerprint(text: Column, lines: int = 6, space: str = "") -> Column:
    """Digest of the first lines with what varies taken out; ``space`` keeps fingerprints of development apart."""
    head = F.array_join(F.slice(F.split(text, "\n", -1), 1, lines), "\n")
    return F.concat(F.lit(space), F.sha2(normalised(head), 256))


def title(text: Column, size: int = 200) -> Column:
    """The first line that is not blank; a bare ``[label]`` takes the next one along."""
    full = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    first = F.coalesce(F.get(full, F.lit(0)), F.lit(""))
    folded = F.when(first.rlike(r"^\[[^\]]*\]$") & (F.size(full) > 1), F.concat_ws(" ", first, F.get(full, F.lit(1)))).otherwise(first)
    return F.left(folded, F.lit(size))


def cache_bucket(hit: Column, miss: Column) -> Column:
    total = hit + miss
    pct = F.when(total > 0, F.floor(hit * 100 / total))
    return F.when(total <= 0, "unknown").when(pct < 1, "0").when(pct < 25, "1_24").when(pct < 50, "25_49").when(pct < 75, "50_74").when(pct < 90, "75_89").otherwise("90_100")


def latency_bucket(ms: Column) -> Column:
    edges = [(1000, "lt_1s"), (5000, "s_1_5"), (15000, "s_5_15"), (60000, "s_15_60"), (300000, "m_1_5"), (900000, "m_5_15")]
    return reduce(lambda rest, e: F.when(ms < e[0], e[1]).otherwise(rest), reversed(edges), F.lit("m_15_plus"))


def safe_bucket(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9_]+", "_")


def snip(text: Column, head: int, tail: int, least_bytes: int = 1024, mark: str = "\n[... omitted ...]\n") -> Column:
    """First and last characters of a long result; short ones and those cut before stay as they are."""
    long = (F.octet_length(text) >= least_bytes) & ~F.contains(text, F.lit(mark.strip())) & (F.length(text) > head + tail)
    return F.when(long, F.concat(F.left(text, F.lit(head)), F.lit(mark), F.right(text, F.lit(tail)))).otherwise(text)


def remote(url: Column) -> Column:
    """A repository address without scheme, user, suffix and trailing slash, in lower case."""
    u = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z+]+://([^@/]*@)?", "")
    u = F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"/+$", "")
    return F.regexp_replace(u, r"\.git$", "")


def is_development(channel: Column, version: Column) -> Column:
    return (F.lower(F.trim(channel)) == "dev") | F.lower(F.trim(version)).startswith("dev")


def is_no_crash(message: Column) -> Column:
    """Notices that browsers and shells raise as errors."""
    observer = F.trim(message).rlike(r"^ResizeObserver loop (?:limit exceeded|completed with undelivered notifications\.?)$")
    return observer | message.rlike(r"Minified React error #520\b") | F.contains(message, F.lit("additional File object is not a file on the disk"))


def is_opaque(kind: Column, message: Column, top_frame: Column) -> Column:
    """Crashes of scripts from elsewhere, of which nothing is told."""
    return (kind == "crash") & (F.trim(message) == "Script error.") & (F.trim(top_frame) == "")
