"""Cutting texts into chunks of whole lines."""

from __future__ import annotations

from collections.abc import Iterator

from quern.functions.declarations import Declaration

# Fixed values.
SIZE, SLACK, LEAST, SHORT = 5000, 1.15, 50, 500
STRUCTURAL, RESIDUE = 2000, 50


def by_size(text: str, size: int = SIZE, slack: float = SLACK, least: int = LEAST, short: int = SHORT) -> list[tuple[int, int, str]]:
    """(first line, last line, text) from 1; whole lines up to ``size`` and some slack, and slices of a line that is longer.

    A chunk is closed before a short line that would not fit; a chunk shorter than ``least`` is dropped.
    """
    limit = int(size * slack)
    out: list[tuple[int, int, str]] = []
    held: list[str] = []
    used, first = 0, 1

    def close(last: int) -> None:
        nonlocal held, used
        joined = "\n".join(held)
        if held and len(joined) >= least:
            out.append((first, last, joined))
        held, used = [], 0

    for number, line in enumerate(text.split("\n"), 1):
        cost = len(line) + 1
        if cost > limit:
            close(number - 1)
            out += [(number, number, line[i : i + limit]) for i in range(0, len(line), limit)]
            continue
        if held and used + cost > limit and len(line) < short:
            close(number - 1)
        if not held:
            first = number
        held.append(line)
        used += cost
        if used >= limit:
            close(number)
    close(text.count("\n") + 1)
    return out


def _spans(lines: list[str], found: list[Declaration], first: int, last: int, cap: int) -> Iterator[tuple[int, int]]:
    """What is not to be cut, in order: declarations that fit, members of those that do not, and what lies between; single lines of what does not fit either."""

    def size(a: int, b: int) -> int:
        return sum(map(len, lines[a - 1 : b])) + b - a + 1

    def between(a: int, b: int) -> Iterator[tuple[int, int]]:
        if a <= b and size(a, b) <= cap:
            yield a, b
        else:
            yield from ((n, n) for n in range(a, b + 1))

    at = first
    for d in found:
        yield from between(at, d.start - 1)
        if size(d.start, d.end) <= cap:
            yield d.start, d.end
        else:
            yield from _spans(lines, d.members, d.start, d.end, cap)
        at = d.end + 1
    yield from between(at, last)


def structural(text: str, found: list[Declaration] | None, cap: int = STRUCTURAL, residue: int = RESIDUE) -> list[tuple[int, int, str]]:
    """(first line, last line, text): pieces filled with whole declarations up to ``cap`` characters.

    A declaration that does not fit is entered, down to its members, and cut by lines only where none of them fits. A piece
    shorter than ``residue`` joins the one before, and the first one the one after. Without declarations the text is cut by size.
    """
    if not found:
        return by_size(text)
    lines = text.split("\n")
    out: list[list[int]] = []  # first line, last line, size
    for a, b in _spans(lines, found, 1, len(lines), cap):
        n = sum(map(len, lines[a - 1 : b])) + b - a + 1
        if out and (out[-1][2] + n <= cap or out[-1][2] < residue and len(out) == 1):
            out[-1][1:] = [b, out[-1][2] + n]
        elif len(out) > 1 and out[-1][2] < residue:
            short = out.pop()
            out[-1][1:] = [short[1], out[-1][2] + short[2]]
            out.append([a, b, n])
        else:
            out.append([a, b, n])
    if len(out) > 1 and out[-1][2] < residue:
        short = out.pop()
        out[-1][1] = short[1]
    return [(a, b, "\n".join(lines[a - 1 : b])) for a, b, _ in out]
