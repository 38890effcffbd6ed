"""Plain, slow restatements of the operators' contracts, used to judge them."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def chats(rows):
    """rows: (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learned), sha(learned))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = BLANK_WORDS.findall(text)
    lines = [x for x in text.split("\n") if BLANK_WORDS.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def licenses(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    w = WORDS.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


class _Expression:
    """Recursive descent, by precedence."""

    def __init__(self, text):
        self.tokens, self.at = re.findall(r"[()]|[A-Za-z0-9.+:-]+|\S", text), 0

    def peek(self):
        return self.tokens[self.at].lower() if self.at < len(self.tokens) else None

    def level(self, word, below):
        left = below()
        while self.peek() == word:
            self.at += 1
            right = below()
            left = (left[0] | right[0], max(left[1], right[1]), left[2] or right[2]) if word == "or" else (left[0] | right[0], min(left[1], right[1]), left[2] and right[2])
        return left

    def atom(self):
        t = self.peek()
        self.at += 1
        if t == "(":
            inner = self.any()
            if self.peek() != ")":
                raise ValueError
            self.at += 1
            if self.peek() == "with":
                raise ValueError
            return inner
        if t is None or t in ("and", "or", "with", ")") or not re.fullmatch(r"[a-z0-9.+:-]+", t):
            raise ValueError
        known = {"mit": "mit", "apache-2.0": "apache", "gpl-2.0+": "gpl", "isc": "isc", "zlib": "zlib", "cc-by-4.0": "cc-by"}.get(t)
        value = {known or "other"}, 1.0 if known else 0.5, known in ("mit", "apache", "isc", "zlib")
        if self.peek() == "with":
            self.at += 1
            after = self.peek()
            self.at += 1
            if after is None or after in ("and", "or", "with", "(", ")") or self.peek() == "with":
                raise ValueError
            value = value[0] | {"exception"}, *value[1:]
        return value

    def any(self):
        return self.level("or", lambda: self.level("and", self.atom))

    def value(self):
        out = self.any()
        if self.at != len(self.tokens):
            raise ValueError
        return out


def license_verdict(text):
    """labels, score, permissive; tags end their line or a comment."""
    from corelode.llm.license_scan import MORE_PHRASES

    w = " " + " ".join(WORDS.findall(text.translate(LOWER))) + " "
    base = set(filter(None, licenses(text)[4].split(",")))
    more = {v for k, v in MORE_PHRASES.items() if f" {k} " in w}
    values, tagged = [], " spdx license identifier " in w
    for said in re.findall(r"(?i)spdx[ _-]license[ _-]identifier ?[:=](.*)", text):
        try:
            values.append(_Expression(said.replace("*/", "")).value())
        except ValueError:
            pass
    score = max([0.9 if base else 0.7 if more else 0.4 if tagged else 0.0, *(v[1] for v in values)])
    return ",".join(sorted(base | more | {x for v in values for x in v[0]})), score, all(v[2] for v in values) if values else None


def leaks(docs, items):
    """docs: {id: text}; items: [(id, text)] -> {id: (n_words, n_hit, n_items, items_sha256)}."""
    windows = defaultdict(set)
    for i, text in items:
        w = WORDS.findall((text or "").translate(LOWER))
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[a : a + k])].add(str(i))
    sizes = {len(x) for x in windows}
    out = {}
    for d, text in docs.items():
        w = WORDS.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (x := tuple(w[a : a + k])) in windows:
                    hit.update(range(a, a + k))
                    found |= windows[x]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))))
    return out


def fingerprint(text, size=3):
    w = BLANK_WORDS.findall((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    bits = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(shingles))


def components(prints, radius=3):
    """prints: [(id, fingerprint)] -> [(id, fingerprint, smallest id reachable)]; every pair is compared."""
    different = sorted({f for _, f in prints})
    root = {f: f for f in different}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(different):
        for b in different[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        least[find(f)] = min(least.get(find(f), d), d)
    return [(d, f, least[find(f)]) for d, f in prints]


def crc(text):
    return zlib.crc32((text or "").encode())
