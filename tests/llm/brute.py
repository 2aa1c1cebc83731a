"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import re
import string

WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def lower(text):
    return (text or "").translate(_LOWER)


def shingles(text):
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_classes(docs, percent=85):
    """{doc_id: (n_shingles, component_id)} by comparing every two documents that share."""
    sets = {i: shingles(t) for i, t in docs}
    holders, root = {}, {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in sorted(sets):
        seen = set()
        for s in sets[i]:
            seen.update(holders.get(s, ()))
            holders.setdefault(s, []).append(i)
        for j in seen:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def _hits(pattern, text, good=lambda m: True):
    return [m.span() for m in re.finditer(pattern, text) if good(m)]


def luhn(digits):
    values = [int(d) for d in digits][::-1]
    return (sum(values[0::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def personal(text):
    """Base matches (start, end, kind number) by the patterns as they are written."""
    text = text or ""
    only = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = [
        _hits(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text),
        _hits(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text,
              lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        _hits(r"[0-9]([\x20-]?[0-9])+", text, lambda m: 14 <= len(only(m)) <= 19 and luhn(only(m))),
        _hits(r"\+[0-9][\x20().0-9-]+[0-9]", text, lambda m: 10 <= len(only(m)) <= 15),
    ]
    return sorted((a, b, k) for k, found in enumerate(kinds) for a, b in found)


def secret(text):
    """Base matches (start, end, kind number) by the patterns as they are written."""
    text = text or ""
    words = "|".join(
        "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
        for w in ("password", "passwd", "secret", "token", "api_?key")
    )
    kinds = [
        _hits("(" + words + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text,
              lambda m: len(m[2]) >= 6),
        _hits("AKIA[A-Z0-9]+", text, lambda m: len(m[0]) >= 20),
        _hits("[0-9a-f]+", text, lambda m: len(m[0]) >= 24),
    ]
    return sorted((a, b, k) for k, found in enumerate(kinds) for a, b in found)


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
    if often is None:
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        often = {w for w, n in seen.items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines, seen_lines, twice = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            twice += line in seen_lines
            seen_lines.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered))
