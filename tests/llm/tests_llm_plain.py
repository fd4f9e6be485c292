"""Plain single-process versions that the tests compare with."""

import math
import re
from collections import Counter, defaultdict

import numpy as np

from postkit.llm import decontam, minhash


def connected(texts, idf, threshold=0.8):
    """Smallest id of each document's class, by comparing all pairs that share a shingle."""
    sets = {i: minhash.weighted_set((t or "").encode(), 5, idf) for i, t in texts.items()}
    holders, pairs = defaultdict(list), set()
    for i, (found, _) in sets.items():
        for x in found.tolist():
            holders[x].append(i)
    for ids in holders.values():
        pairs.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1:])
    label = {i: i for i in texts}
    near = [(a, b) for a, b in pairs if minhash.weighted_jaccard(sets[a], sets[b]) >= threshold]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def plain_near(texts, idf):
    label = connected(texts, idf)
    return sorted(set(label.values()))


def plain_contaminated(docs, items, window=13):
    tables = defaultdict(set)
    for _, text in items:
        w = decontam.split_words((text or "").encode())
        for i in range(max(1, len(w) - window + 1) if w else 0):
            tables[min(window, len(w))].add(tuple(w[i:i + window]))
    bad = set()
    for d, text in docs:
        w = decontam.split_words((text or "").encode())
        hit = {p for k, ps in tables.items() for i in range(len(w) - k + 1) if tuple(w[i:i + k]) in ps for p in range(i, i + k)}
        if hit and 20 * len(hit) >= len(w):
            bad.add(d)
    return bad


def plain_lines(docs, similarity=0.8, depth=3):
    """{id: (text without recurring lines, dropped any)}, templates found leaf by leaf."""
    def normal(line):
        plain = re.sub("[ \t\f\r\x0b]+", " ", line).strip(" ")
        masked = re.sub("[^ ]*[0-9][^ ]*", "<*>", plain)
        return masked if 2 * masked.count("<*>") < len(masked.split(" ")) else plain

    leaves = defaultdict(set)
    forms = {i: [normal(x) for x in t.split("\n")] for i, t in docs}
    for lines in forms.values():
        for s in filter(None, lines):
            w = s.split(" ")
            leaves[len(w), *w[:depth]].add(s)
    template = {}
    for leaf, lines in leaves.items():
        words = [s.split(" ") for s in lines]
        common = [min(Counter(col).items(), key=lambda x: (-x[1], x[0].encode()))[0] for col in zip(*words)]
        for s in lines:
            same = sum(a == b for a, b in zip(s.split(" "), common))
            template[s] = ("leaf", leaf) if len(lines) > 1 and same >= similarity * leaf[0] else ("line", s)
        rest = [s.split(" ") for s in lines if template[s][0] == "line"]
        support = Counter((k, t) for w in rest for k, t in enumerate(w))
        forms_of = {}
        for w in rest:
            own = sorted((support[k, t] for k, t in enumerate(w)), reverse=True)[math.ceil(similarity * len(w)) - 1]
            if own > 1:
                forms_of[" ".join(w)] = tuple(t if support[k, t] >= own else None for k, t in enumerate(w))
        shared = Counter(forms_of.values())
        template.update({s: ("family", leaf, f) for s, f in forms_of.items() if shared[f] > 1})
    first, holders = {}, defaultdict(set)
    for i in sorted(forms):
        for k, s in enumerate(forms[i]):
            if s:
                t = template[s]
                first.setdefault(t, (i, k))
                holders[t].add(i)
    out = {}
    for i, text in docs:
        keep = [x for k, (x, s) in enumerate(zip(text.split("\n"), forms[i]))
                if not s or len(holders[template[s]]) < 2 or first[template[s]] == (i, k)]
        out[i] = ("\n".join(keep), len(keep) < len(forms[i]))
    return out


def brute_links(vectors, threshold=0.9):
    x = np.array([v for _, v in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array([i for i, _ in vectors])
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(label))])
        if (new == label).all():
            break
        label = new
    return [(i, int(n), int(c), i == c) for (i, _), n, c in zip(vectors, near.sum(1), label)]
