"""Plain versions of the corpus operators, and awkward documents."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}

BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def varied(seed: int, n: int) -> str:
    state, out = seed * 7919 + 13, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(BASE[state >> 8 & 15] + str(state >> 16 & 63))
    return " ".join(out)


def awkward() -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, ties, repeats, copies, long and non-ASCII texts."""
    passage, common = varied(1, 60), varied(2, 40)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (6, "Word  two"), (None, varied(3, 50)), (None, None)]
    rows += [(10, varied(4, 200)), (11, varied(4, 200)), (11, varied(4, 200)), (12, varied(4, 200) + " end"), (13, varied(4, 200).replace(" ", "\n")), (14, varied(4, 200).upper())]
    rows += [(20 + i, varied(20 + i, 30 + i) + " " + passage + " " + varied(40 + i, 20)) for i in range(8)]
    rows += [(30 + i, common + " " + varied(60 + i, 5 * i)) for i in range(6)]
    rows += [(40, "äöü ßé 日本語 \U0001f600 " * 30), (41, "a " * 5000), (42, "x" * 20000), (43, passage), (44, " ".join(passage.split()[:34])), (45, varied(5, 3000) + "\x0b" + passage)]
    near = varied(6, 100).split()
    for i in range(12):  # near copies with single words changed
        own = list(near)
        for k in range(i % 4):
            own[7 * k + i] = f"new{i}"
        rows.append((50 + i, " ".join(own)))
    return rows


def cut(rows, window):
    """(doc_id, words, removed, kept text)"""
    seen = Counter()
    for _, text in rows:
        w = words(text)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for key, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((key, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingles(text, width=5):
    w = words(text, True)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def near(rows, p, q, width=5):
    """(doc_id, set size, component, kept)"""
    sets = [(k, shingles(t, width)) for k, t in rows]
    parent = {k: k for k, _ in sets if k is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if None not in (a, b) and s and t and q * len(s & t) >= p * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(k, len(s), None if k is None else find(k), k is not None and find(k) == k) for k, s in sets]


def leaks(rows, items, p=8, q=10):
    out = {}
    bodies = [(item, words(body, True)) for item, body in items]
    for key, text in rows:
        w = words(text, True)
        grams = {n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for n in {min(5, len(v)) for _, v in bodies}}
        for item, v in bodies:
            k = min(5, len(v))
            if not any(tuple(v[i : i + k]) in grams[k] for i in range(len(v) - k + 1)):
                continue
            own = Counter(tuple(v[i : i + k]) for i in range(len(v) - k + 1)) if v else Counter()
            best = None
            m = min(len(v), len(w))  # words of a window
            for s in range(len(w) - m + 1 if v and m >= k else 0):
                n, whole = m - k + 1, len(v) - k + 1
                common = sum((own & Counter(tuple(w[s + i : s + i + k]) for i in range(n))).values())
                if q * common >= p * (n + whole - common) and (best is None or common > best[0]):
                    best = (common, s, n + whole)
            if best:
                out[key, item] = (best[1], m, best[0] / (best[2] - best[0]))
    return out


class KneserNey:
    """Interpolated Kneser-Ney over characters, with dicts: discounted counts at the highest order, below it by how many characters come before."""

    def __init__(self, texts, order=4):
        self.order = order
        counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            s = self.normal(text)
            for i in range(order - 1, len(s)):
                for n in range(1, order + 1):
                    counts[n][s[i - n + 1 : i + 1]] += 1
        for n in range(order - 1, 0, -1):
            before = Counter(g[1:] for g in counts[n + 1])
            counts[n] = Counter({g: max(before[g], 1) for g in counts[n]})
        self.vocabulary = len(counts[1]) + 1
        self.p, self.left = [{"": 1 / self.vocabulary}], {}
        for n in range(1, order + 1):
            ones, twos = (sum(c == k for c in counts[n].values()) for k in (1, 2))
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))
            total, kinds = Counter(), Counter()
            for g, c in counts[n].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.left |= {g: discount * kinds[g] / total[g] for g in total}
            self.p.append({g: max(c - discount, 0) / total[g[:-1]] + self.left[g[:-1]] * self.p[n - 1][g[1:]] for g, c in counts[n].items()})

    def normal(self, text):
        low = "".join(c.lower() if c.isalpha() else " " for c in text)
        return " " * (self.order - 1) + re.sub(" +", " ", low).lstrip() + " "

    def probability(self, gram):
        if gram in self.p[len(gram)]:
            return self.p[len(gram)][gram]
        return self.left.get(gram[:-1], 1.0) * self.probability(gram[1:]) if gram else 1 / self.vocabulary

    def entropy(self, text):
        from math import log

        s = self.normal(text)
        each = [-log(self.probability(s[i - self.order + 1 : i + 1])) for i in range(self.order - 1, len(s))]
        return sum(each) / len(each)


def licensed(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = [(i, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def license_labels(text, base, notices):
    """Labels and score: k-grams by diagonal, neighbouring diagonals merged, words of spans compared."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    labels, score = set(), 0.0

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for t in (*base, *notices):
        n = len(t.words)
        k = max(1, min(3, n - 1 if n > 2 else n))
        votes = defaultdict(set)
        for i in range(len(w) - k + 1):
            for j in range(n - k + 1):
                if w[i : i + k] == list(t.words[j : j + k]):
                    votes[i - j].add(j)
        if t.exact:
            if any(len(v) == n - k + 1 for v in votes.values()):
                labels.add(t.label)
                score = 1.0
            continue
        groups = []
        for d in sorted(votes):
            if not groups or d - groups[-1][-1] > 3:
                groups.append([])
            groups[-1].append(d)
        for g in groups:
            if len(set().union(*(votes[d] for d in g))) / (n - k + 1) >= 0.6:
                start = max(g[0], 0)
                share = common(w[start : n + g[-1]], t.words) / n
                if share >= 0.6:
                    labels.add(t.label)
                    score = max(score, share)
    return ",".join(sorted(labels)), score


def clause_patterns(text, insults=frozenset()):
    """The patterns of a text, clause by clause; insults: (length, hash) of learned beginnings."""
    from veilgraph.llm import toxicity as tox

    symbol = {w: s for s, ws in {**tox.SEEDS, tox.INSULT: tox.INSULTS}.items() for w in ws.split()}

    def begins(w):
        raw, total = w.encode(), 0
        for n in range(1, min(len(raw), 12) + 1):
            total = (total + (raw[n - 1] + 1) * pow(tox.W.BYTE_BASE, n - 1, 1 << 64)) % (1 << 64)
            if (n == len(raw) or raw[n] & 0xC0 != 0x80) and (n, int(tox.W.mix(tox.np.array([(total + n) % (1 << 64)], tox.W.U64))[0])) in insults:
                return True
        return False

    found = set()
    for clause in re.split(r"[.!?;:\n\r]", (text or "").translate(LOWER)):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", clause)
        s = [symbol.get(x) or (tox.INSULT if insults and begins(x) else None) for x in w]
        for i, kind in enumerate(s):
            if kind in (tox.INSULT, tox.THREAT):
                how = "negated " if tox.NEGATION in s[max(0, i - 3) : i] else "reported " if tox.REPORT in s[:i] else "aimed " if tox.TARGET in s else ""
                found.add(how + ("insult" if kind == tox.INSULT else "threat"))
    return found


def top(vectors, k, every):
    """For each distinct (key, vector) of the query rows, the k best (vector, score)."""
    import math

    held = lambda n, limit, least: max(min(n, limit), least)
    valid = [(i, tuple(held(math.floor(256 * x), 1 << 62, -(1 << 62)) for x in v)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, v in dict.fromkeys(valid):
        if i % every == 0:
            scores = sorted((-held(sum(a * b for a, b in zip(v, w)), (1 << 63) - 1, -(1 << 63)), j) for j, w in valid if j != i and len(w) == len(v))
            out[i, v] = [(j, -s) for s, j in scores[:k]]
    return out


def mixed(rows, weights, repeats):
    """source sizes and targets"""
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > repeats * sizes[s]}
        for s in over or open_:
            target[s] = repeats * sizes[s] if over else share * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    return dict(sizes), target
