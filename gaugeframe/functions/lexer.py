"""A lexer for proof sources with nested comments, and edits that act on code alone.

Plain functions on strings; ``operators.generate`` and ``operators.identity`` run them over Arrow
batches. What cannot be read (an open comment or string, no declaration, an anonymous example, no
proof delimiter) raises ``LexError``; an edit that finds nothing to change gives None.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, lru_cache, wraps
from itertools import pairwise
from typing import NamedTuple


class LexError(ValueError):
    pass


class Piece(NamedTuple):
    kind: str  # code, string or comment
    start: int
    end: int


#: Texts of up to so many characters are read once while several edits and checks ask for them.
SHORT, RECENT = 1 << 13, 64


def _remembered(f: Callable) -> Callable:
    """f of a text, remembered for the last short texts; errors are not."""
    held = lru_cache(RECENT)(f)

    @wraps(f)
    def run(source: str):
        return held(source) if len(source) <= SHORT else f(source)

    return run


#: Comments without others inside, whole strings, and what else opens a comment or a string.
MARK = re.compile(r'--[^\n]*|/-(?:[^/-]+|(?!/-|-/)[/-])*+-/|"(?:[^"\\]+|\\.)*+"|/-|"', re.DOTALL)
NESTED = re.compile(r"/-|-/")


@_remembered
def _pieces(source: str) -> tuple[Piece, ...]:
    out, at, n = [], 0, len(source)
    while found := MARK.search(source, at):
        start, end = found.span()
        if end == start + 1:
            raise LexError("unterminated string")
        if end == start + 2 and source[start] == "/":
            depth = 1
            while depth:
                mark = NESTED.search(source, end)
                if mark is None:
                    raise LexError("unterminated comment")
                depth += 1 if mark.group() == "/-" else -1
                end = mark.end()
        if start > at:
            out.append(Piece("code", at, start))
        out.append(Piece("string" if source[start] == '"' else "comment", start, end))
        at = end
    if at < n:
        out.append(Piece("code", at, n))
    return tuple(out)


def pieces(source: str) -> list[Piece]:
    """The source cut into code, strings, and comments (``--`` to the line's end, nested ``/- -/``)."""
    return list(_pieces(source))


def starts_name(ch: str) -> bool:
    return ch == "_" or unicodedata.category(ch)[0] == "L"


def continues_name(ch: str) -> bool:
    return ch in "_'" or unicodedata.category(ch)[0] in "LMN"


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """Identifiers (group 1) or digits and what clings to them; tokens of code. The classes are those
    of ``starts_name``, ``continues_name`` and ``str.isdigit``."""
    kinds = "".join(map(unicodedata.category, map(chr, range(sys.maxunicode + 1))))

    def ranges(major: str) -> list[tuple[int, int]]:
        return [(m.start() // 2, m.end() // 2 - 1) for m in re.finditer(f"(?:[{major}].)+", kinds)]

    def among(extra: str, parts: list[tuple[int, int]]) -> str:
        # long lists of characters beyond 16 bits are searched one by one, so others must not come to them
        text = lambda part: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in part)
        low, high = [(a, min(b, 0xFFFF)) for a, b in parts if a <= 0xFFFF], [(max(a, 0x10000), b) for a, b in parts if b > 0xFFFF]
        return rf"(?:[{extra}{text(low)}]|(?=[\U00010000-\U0010ffff])[{text(high)}])"

    start, more = among("_", ranges("L")), among("_'", ranges("LMN"))
    digit = among("", [(c, c) for a, b in ranges("N") for c in range(a, b + 1) if chr(c).isdigit()])
    return re.compile(f"({start}{more}*+)|{digit}{more}*+"), re.compile(rf"{start}{more}*+|{digit}++|\S")


def _spans(source: str) -> Iterator[tuple[int, int]]:
    find = _patterns()[0].finditer
    for kind, start, end in _pieces(source):
        if kind == "code":
            for m in find(source, start, end):
                if m.lastindex:  # digits and what clings to them are no name
                    yield m.span()


@_remembered
def _names(source: str) -> tuple[tuple[int, int], ...]:
    find = _patterns()[0].finditer
    return tuple([m.span() for kind, start, end in _pieces(source) if kind == "code" for m in find(source, start, end) if m.lastindex])


def names(source: str) -> list[tuple[int, int]]:
    """Spans of identifiers in code."""
    return list(_names(source))


@_remembered
def _tokens(source: str) -> tuple[str, ...]:
    find, out = _patterns()[1].findall, []
    for kind, start, end in _pieces(source):
        if kind == "string":
            out.append(source[start:end])
        elif kind == "code":
            out += find(source, start, end)
    return tuple(out)


def tokens(source: str) -> list[str]:
    """Strings as they stand, identifiers, digit runs, and single characters; no comments or space."""
    return list(_tokens(source))


def rename(source: str, names_to: dict[str, str]) -> tuple[str, int]:
    """Whole identifiers replaced in code; (text, how many)."""
    out, at, count = [], 0, 0
    for a, b in _names(source):
        if (new := names_to.get(source[a:b])) is not None:
            out += [source[at:a], new]
            at, count = b, count + 1
    return "".join([*out, source[at:]]), count


@_remembered
def declaration(source: str) -> tuple[str, int, int, int]:
    """(name, start, end, start of the keyword) of the first theorem or lemma."""
    for (a, b), (c, d) in pairwise(_spans(source)):
        word = source[a:b]
        if word == "example":
            raise LexError("anonymous example")
        if word in ("theorem", "lemma"):
            return source[c:d], c, d, a
    raise LexError("no theorem or lemma")


def header_end(source: str, start: int) -> int:
    """Where the statement ends: ``:=`` in code after start, or a line that begins with ``begin``."""
    for p in _pieces(source):
        if p.kind == "code" and p.end > start:
            at = source.find(":=", max(start, p.start), p.end)
            if at >= 0:
                return at
    at = start
    while (at := source.find("\n", at)) >= 0:
        at += 1
        line = source[at:].lstrip(" \t")
        if line.startswith("begin") and not (line[5:6] and continues_name(line[5])):
            return at
    raise LexError("no proof delimiter")


@_remembered
def header(source: str) -> tuple[int, int]:
    """(end of the declaration's name, end of its statement)."""
    d = declaration(source)
    return d[2], header_end(source, d[2])


def code_matches(source: str, pattern: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Spans of a pattern's matches that lie in one piece of code between start and end."""
    end, found = len(source) if end is None else end, re.compile(pattern)
    return [m.span() for p in _pieces(source) if p.kind == "code" for m in found.finditer(source, max(p.start, start), max(max(p.start, start), min(p.end, end)))]


def spliced(source: str, start: int, end: int, new: str) -> str:
    return source[:start] + new + source[end:]


def generator(seed: int, item: str, namespace: str) -> random.Random:
    """A seeded generator from the first 16 bytes of a digest (fixed protocol values)."""
    return random.Random(int.from_bytes(hashlib.sha256(f"{namespace}\0{seed}\0{item}".encode()).digest()[:16], "big"))


def edit_id(item: str, name: str, seed: int, target: str) -> str:
    """Content-addressed name of an edit's result."""
    return f"{item}:{name}:s{seed}:{hashlib.sha256(target.encode()).hexdigest()[:16]}"


def statement_identity(source: str) -> tuple[str, str]:
    """(name, SHA-256 of the statement's tokens as a JSON list) of a source with one theorem or
    lemma; namespaces, qualified or quoted names and further declarations are refused."""
    if not source.strip():
        raise LexError("empty source")
    name, start, end, keyword = declaration(source)
    found = [a for a, b in _names(source) if source[a:b] in ("theorem", "lemma", "example")]
    if found != [keyword]:
        raise LexError("more than one declaration")
    if any(source[a:b] == "namespace" for a, b in names(source[:keyword])):
        raise LexError("namespace")
    statement = tokens(source[end : header_end(source, end)])
    if "«" in source[keyword:start] or (statement and statement[0] in (".", "»")):
        raise LexError("qualified or quoted name")
    if not statement:
        raise LexError("empty statement")
    return name, hashlib.sha256(json.dumps(statement, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def pick(n: int, seed: int, item: str, namespace: str) -> int:
    """A choice among n by the first 8 bytes of a digest (fixed protocol values)."""
    return int.from_bytes(hashlib.sha256(f"{namespace}\0{seed}\0{item}".encode()).digest()[:8], "big") % n


#: What each symbol is exchanged for, and the characters that must not stand before or
#: after it.
RELATIONS = {"≤": "≥", "≥": "≤", "≠": "=", "=": "≠", "<": ">", ">": "<"}
ARITHMETIC = {"+": "-", "-": "+", "*": "/", "/": "*"}
AROUND_RELATIONS = (":<>=!", "=>")
AROUND_ARITHMETIC = (":/+-*", "=/+-*")
#: Words that are never taken for a binder's name, and those that bind anew in a proof.
RESERVED = {"Type", "Prop", "Sort", "theorem", "lemma", "by", "begin", "end", "fun", "let", "in", "_"}
BINDING = ("fun", "let", "have", "intro", "intros", "cases", "rcases")


def _symbols(source: str, table: dict[str, str], low: int, high: int) -> list[tuple[int, int]]:
    """Places of the table's symbols in code, not as part of a longer operator."""
    before, after = AROUND_ARITHMETIC if table is ARITHMETIC else AROUND_RELATIONS
    return [(i, i + 1) for p in _pieces(source) if p.kind == "code" for i in range(max(p.start, low), min(p.end, high)) if source[i] in table and source[i - 1] not in before and (i + 1 >= len(source) or source[i + 1] not in after)]


def _numbers(source: str, low: int, high: int) -> list[tuple[int, int]]:
    """Spans of numbers in code that are no part of a name."""
    spans = []
    for p in _pieces(source):
        i, stop = max(p.start, low), min(p.end, high)
        while p.kind == "code" and i < stop:
            j = i
            while j < stop and (source[j].isdigit() or (j > i and continues_name(source[j])) or (j == i and starts_name(source[j]))):
                j += 1
            if source[i:j].isdigit():
                spans.append((i, j))
            i = max(j, i + 1)
    return spans


def _neighbour(digits: str) -> str | None:
    value = int(digits)
    return next((str(value + x) for x in (1, -1, 2, -2) if value + x >= 0 and len(str(value + x)) == len(digits)), None)


def _flip(source: str, item: str, seed: int, table: dict[str, str], namespace: str) -> str | None:
    """One symbol of the header exchanged; None if there is none."""
    at = _symbols(source, table, *header(source))
    if not at:
        return None
    i = at[pick(len(at), seed, item, namespace)][0]
    return source[:i] + table[source[i]] + source[i + 1 :]


def groups(source: str, opening: str = "({", low: int = 0, high: int | None = None) -> list[tuple[int, int, int]]:
    """(after the bracket, colon, closing bracket) of innermost bracket groups in code that hold a
    colon: typed binders."""
    out, begin, colon = [], -1, -1
    for p in _pieces(source):
        for i in range(max(p.start, low), min(p.end, len(source) if high is None else high)) if p.kind == "code" else ():
            ch = source[i]
            if ch in "({":
                begin, colon = (i + 1 if ch in opening else -1), -1
            elif ch == ":" and begin >= 0 and colon < 0:
                colon = i
            elif ch in ")}":
                if begin >= 0 and colon >= 0:
                    out.append((begin, colon, i))
                begin = -1
    return out


@_remembered
def _binders(source: str) -> tuple[tuple[int, int], ...]:
    found = groups(source, "({", *header(source))
    return tuple((a, b) for a, b in _names(source) if source[a:b] not in RESERVED and any(x <= a and b <= y for x, y, _ in found))


def binders(source: str) -> list[tuple[int, int]]:
    """Spans of the names that the header's typed binders introduce."""
    return list(_binders(source))


def rename_binder(source: str, item: str, seed: int) -> str | None:
    """One typed header binder renamed wherever its name stands in code."""
    found = _binders(source)
    if not found:
        return None
    a, b = found[pick(len(found), seed, item, "binder")]
    old = source[a:b]
    return rename(source, {old: f"renamed_{old}_{hashlib.sha256(f'{seed}{chr(0)}{item}{chr(0)}{old}'.encode()).hexdigest()[:8]}"})[0]


def change_premise(source: str, item: str, seed: int) -> str | None:
    """A relation or a number inside an explicit premise (one line, round brackets) exchanged."""
    spans = []
    for a, _, b in groups(source, "(", *header(source)):
        if "\n" not in source[a:b]:
            spans += _symbols(source, RELATIONS, a, b) + _numbers(source, a, b)
    if not spans:
        return None
    a, b = spans[pick(len(spans), seed, item, "premise")]
    new = RELATIONS.get(source[a:b]) or _neighbour(source[a:b])
    return None if new is None else spliced(source, a, b, new)


def flip_relation(source: str, item: str, seed: int) -> str | None:
    return _flip(source, item, seed, RELATIONS, "relation")


def flip_arithmetic(source: str, item: str, seed: int) -> str | None:
    return _flip(source, item, seed, ARITHMETIC, "arithmetic")


def change_number(source: str, item: str, seed: int) -> str | None:
    """One number of the header exchanged for a neighbour of the same width."""
    spans = _numbers(source, *header(source))
    if not spans:
        return None
    a, b = spans[pick(len(spans), seed, item, "number")]
    new = _neighbour(source[a:b])
    return None if new is None else spliced(source, a, b, new)


def drop_step(source: str, item: str, seed: int) -> str | None:
    """One proof line that is not structural left empty."""
    stop, lines, at = header(source)[1], source.split("\n"), 0
    found = []
    for i, line in enumerate(lines):
        if at > stop and line.strip() and line.strip() not in ("begin", "end", "by") and not line.strip().startswith(("--", "/-")):
            found.append(i)
        at += len(line) + 1
    if not found:
        return None
    lines[found[pick(len(found), seed, item, "step")]] = ""
    return "\n".join(lines)


def respace(source: str, item: str, seed: int) -> str:
    """Trailing spaces and blank lines by hash; tokens stay."""
    text = source.replace("\r\n", "\n").replace("\r", "\n")
    out = [line + " " * (1 + pick(3, seed, f"{item}:{i}", "space")) for i, line in enumerate(text.split("\n"))]
    return "\n".join(out) + "\n" * (1 + pick(3, seed, item, "blank"))


def comment(source: str, item: str, seed: int) -> str:
    """One or two block comments before the declaration."""
    at, n = declaration(source)[3], 1 + pick(2, seed, item, "comments")
    return spliced(source, at, at, "".join(f"/- note {pick(10**6, seed, f'{item}:{i}', 'note')} -/\n" for i in range(n)))


def rename_declaration(source: str, item: str, seed: int) -> str:
    name = declaration(source)[0]
    mark = hashlib.sha256(f"rename\0{seed}\0{item}".encode()).hexdigest()[:10]
    return rename(source, {name: f"renamed_{mark}_{name}"})[0]


#: Preserving and violating edits by name; the registry is the extension point.
PRESERVING = {"respace": respace, "comment": comment, "rename_declaration": rename_declaration, "rename_binder": rename_binder}
VIOLATING = {"flip_relation": flip_relation, "flip_arithmetic": flip_arithmetic, "change_number": change_number, "drop_step": drop_step, "change_premise": change_premise}


def edit(name: str):
    found = (PRESERVING | VIOLATING).get(name)
    if found is None:
        raise KeyError(f"unknown edit {name}; there are {', '.join(sorted(PRESERVING | VIOLATING))}")
    return found


def _round_trip(source: str, target: str, old: str, new: str) -> str:
    """Why renaming new back to old does not give the source's tokens; empty if it does."""
    if new in source and any(source[a:b] == new for a, b in _names(source)):
        return "new name is not fresh"
    back = rename(target, {new: old})[0]
    return "" if back == source or _tokens(back) == _tokens(source) else "tokens differ"


def contract(name: str, source: str, target: str) -> tuple[bool, str]:
    """Whether a preserving edit kept its contract: same tokens, or the same after renaming back."""
    try:
        why = _broken(name, source, target)
    except LexError as e:
        why = str(e)
    return not why, why


def _broken(name: str, source: str, target: str) -> str:
    if name in ("respace", "comment"):
        return "" if _tokens(source) == _tokens(target) else "tokens differ"
    if name == "rename_declaration":
        old, new = declaration(source)[0], declaration(target)[0]
        if sum(source[a:b] == old for a, b in _names(source)) != 1:
            return "name stands more than once"
        return _round_trip(source, target, old, new)
    if name == "rename_binder":
        before, after = _tokens(source), _tokens(target)
        pairs = {(x, y) for x, y in zip(before, after, strict=False) if x != y}
        if len(before) != len(after) or len(pairs) != 1:
            return "not one renaming"
        old, new = pairs.pop()
        if old not in {source[a:b] for a, b in _binders(source)}:
            return "no binder of the header"
        proof = _tokens(source[header(source)[1] :])
        if any((x in BINDING or x == "λ") and y == old for x, y in zip(proof, proof[1:], strict=False)):
            return "may be bound anew"
        return _round_trip(source, target, old, new)
    return "no contract"


def statement_changed(source: str, target: str) -> bool:
    def head(text: str) -> tuple[str, ...]:
        return _tokens(text[: header(text)[1]])

    return head(source) != head(target)
