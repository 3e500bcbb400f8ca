"""Plain versions of the operators' contracts, for small inputs: rows are (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 63


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order(doc_id):
    return LAST if doc_id is None else doc_id


def license_base(text):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    w, places, labels = ALNUM.findall(low(text)), [], set()
    for p, label in phrases.items():
        k = p.split()
        hits = [i for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k]
        places += hits
        labels |= {label} if hits else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def pii_base(text):
    text, spans = text or "", []
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    for rank, (kind, pattern) in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(digits))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn or kind == "phone" and 10 <= len(digits) <= 15:
                spans.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)]


def shingles(text, n):
    w = SPACE.findall(low(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def join(rows, n, num):
    """Per row (shingles, component)."""
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    shared = defaultdict(int)
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            for j in holders[g]:
                shared[j, i] += 1
            holders[g].append(i)
    for (i, j), c in shared.items():
        if 100 * c >= num * (len(sets[i]) + len(sets[j]) - c):
            up[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[root(i)] = min(best.get(root(i), LAST), order(d))
    return [(len(sets[i]), best[root(i)] if sets[i] else order(rows[i][0])) for i in range(len(rows))]


def rules(text):
    text = text or ""
    w = SPACE.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, cover, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            cover |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def line_dedup(rows, t=3):
    first, docs = {}, []
    for d, text in sorted(rows, key=lambda r: order(r[0])):
        lines = (text or "").split("\n")
        some = [k for k, line in enumerate(lines) if SPACE.search(line)]
        for s in range(len(some) - t + 1):
            first.setdefault(tuple(lines[k] for k in some[s : s + t]), (order(d), s))
    for d, text in rows:
        lines = (text or "").split("\n")
        some, gone = [k for k, line in enumerate(lines) if SPACE.search(line)], set()
        for s in range(len(some) - t + 1):
            if first[tuple(lines[k] for k in some[s : s + t])] < (order(d), s):
                gone |= set(some[s : s + t])
        docs.append((d, None if text is None else "\n".join(line for k, line in enumerate(lines) if k not in gone), len(gone)))
    return docs


def decontaminate(rows, items, length=10):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(low(text))
        if w and item is not None:
            n = min(length, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(str(item))
    out = []
    for d, text in rows:
        w, hit, found = ALNUM.findall(low(text)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def substring(rows, n=13):
    first, out = {}, []
    for d, text in rows:
        w = SPACE.findall(text or "")
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, LAST), order(d))
    for d, text in rows:
        w, gone = SPACE.findall(text or ""), set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < order(d):
                gone |= set(range(i, i + n))
        out.append((d, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def chat(turns):
    """Of one conversation's (role, text), in order."""
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def pack(pieces, capacity):
    """(bin, offset) of pieces(length, source, cluster) in their order: a linear scan for the tightest bin without a conflict, the oldest of equal ones."""
    bins, out = [], []
    for n, source, cluster in pieces:
        fits = [(capacity - b["full"] - n, k) for k, b in enumerate(bins) if capacity - b["full"] >= n and (source is None or source not in b["sources"]) and cluster not in b["clusters"]]
        k = min(fits)[1] if fits else len(bins)
        if k == len(bins):
            bins.append({"full": 0, "sources": set(), "clusters": set()})
        out.append((k, bins[k]["full"]))
        bins[k]["full"] += n
        bins[k]["sources"].add(source)
        bins[k]["clusters"].add(cluster)
    return out


def posterior(votes, kinds, false_alarm, rounds=100):
    """Probability of good quality of each document by expectation-maximisation, document by document: votes are tuples of -1, 0, 1."""
    import math

    n, classes = len(votes), 1 + kinds
    post = []
    for v in votes:
        bad = [x < 0 for x in v]
        share = 0.9 if any(bad) else 0.1
        total = sum(b + 0.02 for b in bad)
        post.append([1 - share, *((b + 0.02) / total * share for b in bad)])
    for _ in range(rounds):
        table = [[[1.0] * 3 for _ in range(kinds)] for _ in range(classes)]
        for r in range(kinds):
            table[1 + r][r][0] = 20.0
        for v, p in zip(votes, post, strict=True):
            for c in range(classes):
                for r in range(kinds):
                    table[c][r][v[r] + 1] += p[c]
        for c in range(classes):
            for r in range(kinds):
                total = sum(table[c][r])
                table[c][r] = [x / total for x in table[c][r]]
        for r in range(kinds):
            table[0][r][0] = min(table[0][r][0], false_alarm)
        prior = [(sum(p[c] for p in post) + 1) / (n + classes) for c in range(classes)]
        after = []
        for v in votes:
            odds = [math.log(prior[c]) + sum(math.log(table[c][r][v[r] + 1]) for r in range(kinds)) for c in range(classes)]
            top = max(odds)
            e = [math.exp(o - top) for o in odds]
            after.append([x / sum(e) for x in e])
        moved = max(abs(a - b) for x, y in zip(after, post, strict=True) for a, b in zip(x, y, strict=True))
        post = after
        if moved < 1e-9:
            break
    return [p[0] for p in post]


def proximity(words, terms, keys, slop):
    """Starts at which the rarest term stands in its place and the other key terms within slop of theirs: keys are (term, offset), rarest first."""
    starts = [p - keys[0][1] for p, w in enumerate(words) if w == keys[0][0]]
    near = lambda s, k: any(0 <= s + k[1] + d < len(words) and words[s + k[1] + d] == k[0] for d in range(-slop, slop + 1))
    return [s for s in starts if all(near(s, k) for k in keys[1:])]
