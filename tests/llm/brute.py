"""Plain, quadratic versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


BASE = {
    "assign": (re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for k, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        out += [(m.start(), k, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def substring_dedup(docs: list[tuple[int, str | None]], k: int = 20) -> dict[int, tuple[int, int, str]]:
    seen, out = set(), {}
    for i, text in sorted(docs):
        words = BLANK.findall(text or "")
        gone = set()
        for s in range(len(words) - k + 1):
            w = tuple(words[s : s + k])
            if w in seen:
                gone.update(range(s, s + k))
            seen.add(w)
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out[i] = (len(words), len(gone), sha(kept))
    return out


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = BLANK.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def similar(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in docs}
    groups = Groups(sets)
    ids = [i for i in sorted(sets) if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if min(len(sets[a]), len(sets[b])) * 4 < max(len(sets[a]), len(sets[b])) * 3:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], k: int = 13) -> dict[int, tuple]:
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for s in [tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]:
            windows[s].add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (key := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[key]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def line_words(line: str) -> list[str]:
    return [w for w in re.split(r"[\x00-\x60\x7B-\x7F]+", line.lower()) if w]


def edits(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def full_form(line: str) -> str:
    return re.sub(r"[\x00-\x20\x7F]+", " ", line.lower()).strip(" ")


def numbers(full: str) -> str:
    counts = lambda c: unicodedata.category(c) in ("Nd", "Sc", "Sm") or c == "%"
    minus = lambda i: full[i] == "-" and unicodedata.category(full[i + 1 : i + 2] or " ") == "Nd"
    return " ".join("".join(c if counts(c) or minus(i) else " " for i, c in enumerate(full)).split())


def line_dedup(docs: list[tuple[int, str | None]]) -> dict[int, list[int]]:
    """Removed lines where all lines of equal numbers within the edit limit are linked, whatever their hashes and shingles."""
    places = defaultdict(list)
    for i, t in docs:
        for pos, line in enumerate((t or "").split("\n")):
            if line_words(line):
                places[full_form(line)].append((i, pos))
    groups, alike = Groups(places), defaultdict(list)
    for f in sorted(places, key=len):
        alike[numbers(f)].append((f, Counter(f)))
    for lines in alike.values():
        for k, (a, x) in enumerate(lines):
            for b, y in lines[k + 1 :]:
                allowed = len(b) // 10
                if len(b) - len(a) > allowed:
                    break
                if (y - x).total() <= allowed and groups.find(a) != groups.find(b) and edits(a, b) <= allowed:
                    groups.join(a, b)
    together = defaultdict(list)
    for f in places:
        together[groups.find(f)] += places[f]
    gone = {i: [] for i, _ in docs}
    for at in together.values():
        for i, pos in set(at) - {min(at)}:
            gone[i].append(pos)
    return {i: sorted(p) for i, p in gone.items()}


def without_lines(docs: list[tuple[int, str | None]], gone: dict[int, list[int]]) -> dict[int, str | None]:
    return {i: t if not gone.get(i) else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone[i])) for i, t in docs}


def fill(children: list[tuple], budget: float) -> dict:
    """Water level: (name, weight, capacity) to shares; found by cutting the full ones off until none is left."""
    left, out = [c for c in children if c[1] > 0], {c[0]: 0.0 for c in children}
    while left:
        level = budget / sum(w for _, w, _ in left)
        full = [c for c in left if c[2] <= level * c[1]]
        if not full:
            return out | {n: level * w for n, w, _ in left}
        for c in full:
            out[c[0]] = c[2]
            budget -= c[2]
            left.remove(c)
    return out


def mixing(rows: list[tuple], share: float, max_epochs: int, seed: int, weights: dict) -> dict[tuple, int]:
    """rows: (doc_id, domain, lang, source, tokens); (doc_id, epoch) to the tokens taken."""
    capacity = defaultdict(float)
    for _, *leaf, tokens in rows:
        for depth in range(4):
            capacity[tuple(leaf[:depth])] += tokens * max_epochs
    budget = {(): min(capacity[()], share * sum(r[4] for r in rows))}
    for depth, level in enumerate(("domain", "lang", "source")):
        for node in [n for n in budget if len(n) == depth]:
            children = [c for c in capacity if len(c) == depth + 1 and c[:depth] == node]
            budget |= fill([(c, weights.get(level, {}).get(c[-1], 1.0), capacity[c]) for c in children], budget[node])
    taken = {}
    for leaf in {tuple(r[1:4]) for r in rows}:
        own = [(r[0], r[4]) for r in rows if tuple(r[1:4]) == leaf and r[4] > 0]
        quota, epoch = math.floor(budget[leaf] + 1e-6), 0
        while quota > 0 and own:
            for _, i, n in sorted((hashlib.md5(f"{seed}:{epoch}:{i}".encode()).hexdigest(), i, n) for i, n in own):
                if quota > 0:
                    taken[i, epoch] = min(n, quota)
                    quota -= taken[i, epoch]
            epoch += 1
    return taken
