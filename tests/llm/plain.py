"""Brute-force versions of the operators, in plain Python."""

import re
from collections import defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def joined(sets):
    """(id, size, component) of each (id, set): the least id that links of similarity 0.8 reach."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(i)
    out = [None] * len(sets)
    for members in groups.values():
        ids = [sets[i][0] for i in members if sets[i][0] is not None]
        for i in members:
            out[i] = (sets[i][0], len(sets[i][1]), min(ids, default=None))
    return out


def components(rows):
    """Component of each (doc_id, text) by its shingles."""
    return joined([(d, shingles(t)) for d, t in rows])


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def keeps(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == 1:
        return all(int(p) <= 255 for p in match.split("."))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 9 <= len(digits) <= 15


def personal(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if keeps(k, m[0]))


def licensed(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in at}))


def one_edit(a, b):
    """Whether word lists differ by at most one substitution, insertion or deletion."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + (len(a) > len(b)) :] == b[i + (len(b) > len(a)) :]


def deduped(rows, least=1, near=5):
    """(doc_id, text without repeated lines, lines removed), rows in order of doc_id; ids distinct."""
    split = lambda line: re.split("[ \t\r\f\v]+", line.strip(" \t\r\f\v"))
    first = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\f\v") and len(split(line)) >= least:
                first.setdefault(line.strip(" \t\r\f\v"), (d, i))
    seen, gone = defaultdict(list), set()
    for line in sorted(first, key=first.get):
        words = split(line)
        if len(words) >= near:
            if any(one_edit(words, w) for n in (-1, 0, 1) for w in seen[len(words) + n]):
                gone.add(line)
            seen[len(words)].append(words)
    out = []
    for d, t in rows:
        kept, lines = [], (t or "").split("\n")
        for i, line in enumerate(lines):
            s = line.strip(" \t\r\f\v")
            if s not in first or (first[s] == (d, i) and s not in gone):
                kept.append(line)
        out.append((d, "\n".join(kept) if t is not None else None, len(lines) - len(kept) if t is not None else 0))
    return out


def found_items(docs, items):
    """(doc, item) pairs, by number, of which the document holds the item: 11 of 13 consecutive words equal, or of a
    shorter item's words the same share rounded up."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for i, a in enumerate(map(split, docs)):
        for j, b in enumerate(map(split, items)):
            window = min(13, len(b))
            least = -(-11 * window // 13)
            for start in range(-len(b), len(a)):
                equal = [0 <= start + k < len(a) and a[start + k] == w for k, w in enumerate(b)]
                if b and any(sum(equal[k : k + window]) >= least for k in range(len(b) - window + 1)):
                    out.add((i, j))
    return out


def spots(text, anchors, also=lambda word: False, chain=2):
    """Spot signatures as tuples: the anchor, or None for the text's start, and the content words that follow."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    follow = lambda i: tuple([w for w in words[i:] if w not in anchors][:chain])
    found = {(None, *follow(0))} if words else {text} if text else set()
    return found | {(w, *follow(i + 1)) for i, w in enumerate(words) if w in anchors or also(w)}


def kneser_ney(texts, order):
    """p(symbol, context) of an interpolated model over the symbols of texts; each text is a list with its padding."""
    top = defaultdict(int)
    for symbols in texts:
        for i in range(order - 1, len(symbols)):
            top[tuple(symbols[i - order + 1 : i + 1])] += 1
    level = {order: dict(top)}
    for n in range(order - 1, 0, -1):
        ends = defaultdict(set)
        for gram in level[n + 1]:
            ends[gram[1:]].add(gram[0])
        level[n] = {g: len(x) for g, x in ends.items()}
    discount = {n: min(0.95, max(0.1, sum(c == 1 for c in g.values()) / max(1, sum(c == 1 for c in g.values()) + 2 * sum(c == 2 for c in g.values())))) for n, g in level.items()}

    def p(symbol, context, size):
        value = 1 / size
        for n in range(1, order + 1):
            before = tuple(context[len(context) - n + 1 :])
            same = {g: c for g, c in level[n].items() if g[:-1] == before}
            if total := sum(same.values()):
                value = max(same.get((*before, symbol), 0) - discount[n], 0) / total + discount[n] * len(same) / total * value
        return value

    return p
