"""Plain versions of the operators, one row at a time, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

UPPER = {i: i + 32 for i in range(65, 91)}


def fold(text: str) -> str:
    return text.translate(UPPER)


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def letters(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text or ""))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def contaminated(docs, items):
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    windows = defaultdict(set)
    for item, text in items:
        w = letters(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w, hit, met = letters(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    met |= own
        out.append((key, len(w), len(hit), len(met), sha(",".join(sorted(met))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def language_model_base(docs, held_out):
    """(id, held_out, n_tokens, n_known, train_tokens, base_score) of every row."""
    tokens = [[*spaced(fold(t or "")), None] for _, t in docs]
    counts = Counter(w for t, (k, _) in zip(tokens, docs, strict=True) if not held_out(k) for w in t)
    n, v = sum(counts.values()), len(counts)
    return [(k, held_out(k), len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in t)) for t, (k, _) in zip(tokens, docs, strict=True)]


class LanguageModel:
    """Interpolated absolute discounting, unquantised: counts of all n-grams in dictionaries."""

    def __init__(self, docs, held_out, order):
        self.order = order
        self.grams = [Counter() for _ in range(order + 1)]
        for k, t in docs:
            if not held_out(k):
                words = [None, *spaced(fold(t or "")), None]
                for n in range(1, order + 1):
                    self.grams[n].update(tuple(words[i - n + 1 : i + 1]) for i in range(max(1, n - 1), len(words)))
        self.discounts = [0.0, 0.5]
        for n in range(2, order + 1):
            once, twice = (sum(c == x for c in self.grams[n].values()) for x in (1, 2))
            self.discounts.append(once / (once + 2 * twice) if once and twice else 0.5)
        self.below = [defaultdict(list) for _ in range(order + 1)]
        for n in range(2, order + 1):
            for g, c in self.grams[n].items():
                self.below[n][g[:-1]].append(c)

    def p(self, context, word):
        n, v = sum(self.grams[1].values()), len(self.grams[1])
        out = max(self.grams[1][word,] - 0.5, 0) / max(n, 1) + (0.5 * v / n if n else 1.0) / (v + 1)
        for k in range(2, self.order + 1):
            own = self.below[k].get(tuple(context[len(context) - k + 1 :])) if len(context) >= k - 1 else None
            if own:
                d = self.discounts[k]
                out = max(self.grams[k][(*context[len(context) - k + 1 :], word)] - d, 0) / sum(own) + d * len(own) / sum(own) * out
        return out

    def score(self, text):
        words = [None, *spaced(fold(text or "")), None]
        return sum(math.log10(self.p(words[max(0, i - self.order + 1) : i], words[i])) for i in range(1, len(words)))


def held(by: int, rest: int):
    return lambda k: k is not None and zlib.crc32(str(k).encode()) % by == rest


def without_repeats(docs, window=35):
    """(id, n_words, n_removed, kept text) of every row."""
    words = [spaced(t) for _, t in docs]
    starts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(docs, words, strict=True):
        gone = {p for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((key, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def groups(docs, percent=85):
    """(id, n_shingles, component_id, kept) of every row; ids may repeat, null is never the smallest."""
    sets = []
    for _, text in docs:
        w = spaced(fold(text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    keys = defaultdict(list)
    for i, (key, _) in enumerate(docs):
        keys[root(i)].append(key)
    out = []
    for i, (key, _) in enumerate(docs):
        least = min((k for k in keys[root(i)] if k is not None), default=None)
        out.append((key, len(sets[i]), least, least == key))
    return out
