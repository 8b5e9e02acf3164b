"""Plain Python versions of the operators, for small inputs."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def join(rows, k, percent):
    """doc_id -> (shingles, component)."""
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(i for i, s in sets.items() if s)
    comp = {i: i for i in sets}
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                lo, hi = sorted((comp[a], comp[b]))
                comp = {i: lo if c == hi else c for i, c in comp.items()}
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def links(rows, k, percent):
    """doc_id -> number of other documents linked with it."""
    sets = {i: shingles(t, k) for i, t in rows}
    return {i: sum(i != j and 100 * len(x & y) >= percent * len(x | y) for j, y in sets.items()) if x else 0 for i, x in sets.items()}


def substrings(rows, window):
    """doc_id -> (words, removed, kept text)."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    least = {}
    for i, w in words.items():
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = {x for j in range(len(w) - window + 1) if least[tuple(w[j : j + window])] < i for x in range(j, j + window)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def secrets(text):
    """Base spans (start, kind, end) in order."""
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def lines(rows, ratio, repeats, copies=True):
    """(host, text) rows -> kept texts; without copies, distinct texts must say so too."""
    strip = lambda x: x.strip(" \t\r")
    pages, held, texts, told = Counter(), Counter(), Counter(), Counter()
    for h, t in rows:
        pages[h] += 1
        held.update((h, x) for x in {strip(x) for x in (t or "").split("\n")} - {""})
    for h, t in set(rows):
        texts[h] += 1
        told.update((h, x) for x in {strip(x) for x in (t or "").split("\n")} - {""})
    gone = {k for k, n in held.items() if n >= repeats and n > ratio * pages[k[0]] and (copies or (told[k] >= repeats and told[k] > ratio * texts[k[0]]))}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h, strip(x)) not in gone) for h, t in rows]


def segmentations(word):
    """All cuts of a word into pieces."""
    for mask in range(1 << (len(word) - 1)):
        at = [0, *(i + 1 for i in range(len(word) - 1) if mask >> i & 1), len(word)]
        yield [word[a:b] for a, b in zip(at, at[1:], strict=False)]


def dice(unit, template):
    """Dice coefficient of the word bigrams of two texts."""
    norm = lambda t: re.findall("[0-9a-z\u0080-\U0010ffff]+", t.translate(LOWER))
    a, b = ({*zip(w, w[1:], strict=False)} for w in (norm(unit), norm(template)))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


BARE = re.compile("[A-Za-z0-9+/_=-]+")


def values(text):
    """(start, end, value) of the base spans of a text, and of other runs that mix letters and digits outside them."""
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    base = [(m.start(), m.end(), m[1]) for m in assign.finditer(text) if len(m[1]) >= 6]
    base += [(m.start(), m.end(), m[0]) for p, n in (("AKIA[A-Z0-9]+", 20), ("[0-9a-f]+", 24)) for m in re.finditer(p, text) if len(m[0]) >= n]
    other = [(m.start(), m.end(), m[0]) for m in BARE.finditer(text) if len(m[0]) >= 20 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    return base, [x for x in other if not any(a < x[1] and x[0] < b for a, b, _ in base)]


def redacted(rows, k, owners=2, repositories=100):
    """The text of row k of (text, owner, repository) rows with its live values marked."""
    held = {}
    for t, owner, repository in rows:
        for part in values(t):
            for *_, v in part:
                held.setdefault(v, set()).add((owner or "", repository))
    live = {v for v, who in held.items() if len({o for o, _ in who}) <= owners and sum(o == "" for o, _ in who) <= repositories}
    text, base_other = rows[k][0], values(rows[k][0])
    out, at = [], 0
    for a, b, _ in sorted(x for part in base_other for x in part if x[2] in live):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]
