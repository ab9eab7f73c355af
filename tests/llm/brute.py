"""Plain Python versions of the contracts, for small inputs."""

import hashlib
import re
from collections import Counter
from itertools import pairwise  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    n = Counter(x[3] for x in out)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out)))


def chat(turns):
    """turns: (role, text) in order -> n_turns, turns_sha256, loss_chars, loss_sha256"""
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def mix_targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: {source: words} -> {source: target}"""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        t = {s: most * sizes[s] if s in capped else rest * w[s] / free for s in names}
        over = {s for s in names if s not in capped and t[s] > most * sizes[s]}
        if not over:
            return t
        capped |= over


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    repeat = len({j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)})
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat, failed


def licenses(text, sentences, rules, longest_lead):
    """n_sentences, licenses: word by word, without the operator's regexes."""
    plain = lambda t: re.sub(r"[^a-z0-9]+", " ", t.lower()).split()
    words, edges = [], {0}
    for line in re.split(r"[\r\n]+", text):
        for piece in re.split(r"(?<=[.!?:;])[ \t]+(?=[A-Z])", line):
            words += plain(piece)
            edges.add(len(words))
    known = {}
    for name, s in sentences:
        key = tuple(w for part in re.split("(<[^>]*>)", s) for w in (["*"] if part.startswith("<") else plain(part)))
        known.setdefault(key, name)

    def ends(key, at, first=True):
        """Where the sentence may end if it begins at this word."""
        if not key:
            return {at}
        if key[0] == "*":
            some = (k for k in range(1, len(words) - at + 1) if not first or k <= longest_lead or not any(e in edges for e in range(at + 1, at + k)))
            return set().union(*(ends(key[1:], at + k, False) for k in some), set())
        return ends(key[1:], at + 1, False) if at < len(words) and words[at] == key[0] else set()

    found, at = [], 0
    order = sorted(known, key=lambda k: (-len(" ".join(k)), " ".join(k)))
    while at < len(words):
        best = next(((known[k], min(e)) for k in order if at in edges and (e := ends(k, at) & edges)), None)
        if best:
            found.append(best[0])
        at = best[1] if best else at + 1
    taken, named = [None] * len(found), []
    for spdx, names in sorted(rules, key=lambda r: -len(r[1])):
        i = 0
        while i + len(names) <= len(found):
            if not any(taken[i : i + len(names)]) and tuple(found[i : i + len(names)]) == names:
                taken[i : i + len(names)] = [True] * len(names)
                named.append((i, spdx))
                i += len(names)
            else:
                i += 1
    return len(found), [x for _, x in sorted(named)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def components(texts):
    """{doc_id: text} -> {doc_id: component_id}"""
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    where = {}
    for d in ids:
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    for a in ids:
        shared = Counter(b for s in sets[a] for b in where[s] if b < a)
        for b, n in shared.items():
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}
