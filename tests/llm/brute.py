"""Slow, plain versions of the operators, for small inputs."""

from __future__ import annotations

import functools
import re
import unicodedata

from lodestone.llm.op10_minhash import CONTAINMENT, RATIO, SHINGLE

ASCII_SPACE = re.compile(r"[\t\n\x0b\x0c\r\x1c-\x1f ]+")


def words(text: str | None) -> list[str]:
    return [w for w in ASCII_SPACE.split(text or "") if w]


def lines(docs: list[tuple], threshold: int, keep_whole: bool) -> list[str | None]:
    def norm(x):
        return re.sub(r"[ \t\n\x0b\x0c\r]+", " ", x).strip(" ").lower()

    seen: dict[str, set] = {}
    for i, text in docs:
        for x in (text or "").split("\n") if text is not None else []:
            if norm(x):
                seen.setdefault(norm(x), set()).add(i)
    often = {x for x, ids in seen.items() if len(ids) > threshold}
    out = []
    for _, text in docs:
        if text is None:
            out.append(None)
            continue
        kept = [x for x in text.split("\n") if norm(x) not in often]
        if keep_whole and not any(x.strip(" ") for x in kept):
            kept = text.split("\n")
        out.append("\n".join(kept))
    return out


def shingle_set(text: str | None, size: int = SHINGLE) -> frozenset:
    w = ["".join(c.lower() if c.isascii() else c for c in x) for x in words(text)]
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def near_groups(docs: list[tuple], containment: float = CONTAINMENT, ratio: float = RATIO) -> dict[int, int]:
    """doc_id to the lowest id of its group, for groups of two or more."""
    sets: dict[int, set] = {}
    for i, t in docs:
        if i is not None and shingle_set(t):
            sets.setdefault(i, set()).add(shingle_set(t))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and root(a) != root(b):
                for x in sets[a]:
                    for y in sets[b]:
                        small, large = sorted((x, y), key=len)
                        if len(large) <= ratio * len(small) and len(small & large) >= containment * len(small):
                            low, high = sorted((root(a), root(b)))
                            parent[high] = low
    groups: dict[int, list[int]] = {}
    for i in ids:
        groups.setdefault(root(i), []).append(i)
    return {i: g for g, members in groups.items() if len(members) > 1 for i in members}


def edit_distance(a: str, b: str, most: int = 3) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
        if min(row) > most:
            return most + 1
    return row[-1]


def accepted(word: str, lexicon, least: float = 0.0) -> tuple[str, int] | None:
    """The nearest term that the word may be a misspelling of; the first of equally near ones."""
    best = None
    for term in lexicon:
        most = 0 if len(term) <= 4 else 1 if len(term) <= 7 else 2
        while most and least and lexicon[term][most] < least:
            most -= 1
        if abs(len(term) - len(word)) <= most:
            d = edit_distance(word, term, most)
            if d <= most and (best is None or d < best[1]):
                best = (term, d)
    return best


@functools.cache
def squeezed_distance(a: str, b: str) -> float:
    """Edit distance where a letter like the one before it comes or goes for a half, from the ends of both words."""
    if not a and not b:
        return 0.0
    ways = []
    if a:
        ways.append(squeezed_distance(a[:-1], b) + (0.5 if a[-2:-1] == a[-1] else 1.0))
    if b:
        ways.append(squeezed_distance(a, b[:-1]) + (0.5 if b[-2:-1] == b[-1] else 1.0))
    if a and b:
        ways.append(squeezed_distance(a[:-1], b[:-1]) + (a[-1] != b[-1]))
    return min(ways)


def tokens(text: str) -> list[tuple[int, int]]:
    """Runs of letters, marks and digits, and of symbols with one of those on either side."""
    letter = [unicodedata.category(c)[0] in "LMN" for c in text]
    inside = [x or c in "*@$!#" and 0 < i < len(text) - 1 and letter[i - 1] and letter[i + 1] for i, (c, x) in enumerate(zip(text, letter))]
    return [(m.start(), m.end()) for m in re.finditer("x+", "".join("x" if x else " " for x in inside))]


SECOND = "you your yours youre yourself yourselves u ur du dich dir dein deine tu toi ton te eres usted vous votre".split()
SPEECH = "said says say called calls calling call quote quoted quotes quoting word words term terms insult insults slur slurs means meaning meant definition defined reported writes wrote".split()


def surroundings(before: str, after: str, crowded: bool) -> float:
    before, after = before.split("\n")[-1], after.split("\n")[0]
    if sum(c in "\"“”„«»" for c in before) % 2 and any(c in "\"“”„«»" for c in after):
        return 0.2
    near = set(re.findall(r"[^\W_]+", (before + " " + after).replace("'", "")))
    if near & set(SECOND):
        return 1.3 * (1.2 if crowded else 1.0)
    return 0.5 if near & set(SPEECH) else 1.2 if crowded else 1.0


def toxic(texts: list[str | None], lexicon: dict[str, tuple[float, float, float]], allowed: frozenset) -> list[float]:
    """The scores of the texts; lexicon has a term's weight at no, one and two edits."""
    lexicon = {t: w for t, w in lexicon.items() if max(w) >= 0.1}
    known: dict[str, tuple[str, int] | None] = {}
    out = []
    for text in texts:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
        spans, hits, score = tokens(low), [], 0.0
        for k, (a, b) in enumerate(spans):
            word = low[a:b]
            if word not in known:
                hit = accepted(word, lexicon, 0.1)
                if hit and hit[1] and (word in allowed or word.isalpha() and any(squeezed_distance(word, x) <= squeezed_distance(word, hit[0]) for x in allowed)):
                    hit = None
                known[word] = hit
            if known[word]:
                hits.append((k, *known[word]))
        for k, term, d in hits:
            a = spans[k - 9][1] if k >= 9 else 0
            b = spans[k + 9][0] if k + 9 < len(spans) else len(low)
            crowded = any(0 < abs(j - k) <= 8 for j, _, _ in hits)
            score += lexicon[term][d] * surroundings(low[a : spans[k][0]], low[spans[k][1] : b], crowded)
        out.append(round(score / max(1, len(spans) / 1000), 6))
    return out


def repeats(text: str, least: int) -> tuple[int, int]:
    """Characters covered by repeated substrings of `least` or more, and the longest of them."""
    n = len(text)
    covered, longest = [False] * n, 0
    for i in range(n):
        length = least
        while i + length <= n and (text.find(text[i : i + length]) != i or text.find(text[i : i + length], i + 1) >= 0):
            length += 1
        if length > least:
            longest = max(longest, length - 1)
            covered[i : i + length - 1] = [True] * (length - 1)
    return sum(covered), longest


def factors(docs: list[tuple], length: int) -> set[tuple]:
    """Every window that stands earlier: document, place, and the first place."""
    seen, out = {}, set()
    for d, text in sorted((d, t) for d, t in docs if d is not None and t is not None):
        w = words(text)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key not in seen:
                seen[key] = (d, i)
            elif seen[key] != (d, i):
                out.add((d, i, *seen[key]))
    return out


def parse(docs: list[tuple], length: int) -> list[tuple]:
    """The factors of a greedy parse, word by word against every reference block: document, first word, end, and where the block's text stands."""
    blocks: list[tuple[int, int, list[str]]] = []  # document, place of the first word, words
    out = []
    for d, w in sorted({(d, tuple(words(t))) for d, t in docs if d is not None and t is not None}):
        w, at, last = list(w), 0, None
        for at in range(len(w) - length + 1):
            best = max(((_common(w, at, b, i), (r, first + i)) for r, first, b in blocks for i in range(len(b) - length + 1) if b[i] == w[at] and b[i : i + length] == w[at : at + length]), default=None)
            if best is None:  # new here: it goes on the block of the window before it, if that was new
                if blocks and blocks[-1][0] == d and blocks[-1][1] + len(blocks[-1][2]) == at + length - 1:
                    blocks[-1][2].append(w[at + length - 1])
                else:
                    blocks.append((d, at, w[at : at + length]))
                last = None
            elif last is None or at + length > last[2]:  # not within the factor before it
                last = (d, at, at + best[0], *best[1])
                out.append(last)
    return out


def _common(w: list[str], at: int, b: list[str], i: int) -> int:
    n = 0
    while at + n < len(w) and i + n < len(b) and w[at + n] == b[i + n]:
        n += 1
    return n
