"""Plain versions of the operators, on lists, for small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard string, slot string, n_lines string, gone string, text_a string, digest string, id string"


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"{rng.choice(['ka', 'lo', 'mi', 'tu'])}{rng.randrange(vocabulary)}{rng.choice(['.', ',', '', '', ''])}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank, one word, repeated rows, ties, a very long text, clashing names."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    copy = prose(rng, 300)
    near = copy.split()
    near[10] = "changed"
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "word"), (4, "word"), (5, "two words"), (6, "TWO words"), (7, long), (8, copy), (9, copy),
            (10, " ".join(near)), (None, copy), (None, "no key here"), (11, "é日本🙂 \x00 \u2028 x"), (12, "l1 a\n" * 400)]
    return [(i, t, None, None if k % 3 else f"s{k}", None, "kept", "a", "b", "c", "d", "e", "f", "g") for k, (i, t) in enumerate(rows)]


def components(sets: list[frozenset], links) -> list[int]:
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and links(sets[a], sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(len(sets))]


def shingles(text, k: int) -> frozenset:
    w = (text or "").encode().lower().split()
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def similar(a: frozenset, b: frozenset) -> bool:
    both = len(a & b)
    return 100 * both >= 80 * (len(a) + len(b) - both)


def near_duplicates(rows: list[tuple], k: int) -> list[tuple]:
    """(key, set size, component, kept) of (key, text) rows."""
    sets = [shingles(t, k) for _, t in rows]
    root = components(sets, similar)
    names = defaultdict(list)
    for (key, _), r in zip(rows, root):
        if key is not None:
            names[r].append(key)
    out = []
    for (key, _), s, r in zip(rows, sets, root):
        name = key if not s else min(names[r], default=None)
        out.append((key, len(s), name, key == name))
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text) -> list[str]:
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def contamination(rows: list[tuple], items: list[tuple], span: int = 13) -> list[tuple]:
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[p : p + n])].add(item)
    out = []
    for key, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for p in range(len(w) - n + 1):
                if g := grams.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= g
        ids = sorted(str(i) for i in found if i is not None)
        out.append((key, len(w), len(hit), len(ids), ",".join(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def quality(text) -> tuple:
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = {p + i for p in range(len(w) - 2) if windows[tuple(w[p : p + 3])] > 1 for i in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


#: The base patterns as they are given.
PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text) -> list[tuple]:
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            out.append((kind, *m.span()))
    return out


def without_repeats(texts: list, size: int = 400) -> list[tuple]:
    """(bytes, removed, spans, sha256 of the rest) of each text."""
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[p : p + size] for r in raws for p in range(len(r) - size + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - size + 1):
            if count[r[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        rest = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    return out


def without_boilerplate(rows: list[tuple], min_sites: int) -> list:
    """Texts of (text, site) rows without lines on `min_sites` sites; whole where no line with a word would be left."""
    sites = defaultdict(set)
    wordy = lambda line: bool(re.search(r"[^\x20\x09-\x0D]", line))
    for text, site in rows:
        for line in (text or "").split("\n"):
            if site is not None and wordy(line):
                sites[line].add(site)
    out = []
    for text, _ in rows:
        if text is None:
            out.append(None)
            continue
        lines = text.split("\n")
        kept = [v for v in lines if len(sites[v]) < min_sites]
        out.append("\n".join(kept) if any(map(wordy, kept)) else text)
    return out
