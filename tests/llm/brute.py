"""Plain versions of the operators' results, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Sets:
    """Union of nodes under their smallest member."""

    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_components(docs):
    s = {}
    for i, t in docs:
        s.setdefault(i, shingles(t))
    c = Sets(s)
    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(s[a] & s[b])
            if n and 100 * n >= 75 * (len(s[a]) + len(s[b]) - n):
                c.join(a, b)
    return {i: (len(s[i]), c.find(i)) for i in ids}


def within(a, b, t):
    if abs(len(a) - len(b)) > t:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if not a or not b:
        return max(len(a), len(b)) <= t
    return t > 0 and (within(a[1:], b, t - 1) or within(a, b[1:], t - 1) or within(a[1:], b[1:], t - 1))


def line_removals(docs, t, least):
    spots = [(i, n, x) for i, text in docs if text is not None for n, x in enumerate(text.split("\n")) if len(x) >= least and WORD.search(x)]
    lines = sorted({x for _, _, x in spots})
    c = Sets(lines)
    for k, a in enumerate(lines):
        for b in lines[k + 1 :]:
            if abs(len(a) - len(b)) <= t and c.find(a) != c.find(b) and within(a, b, t):
                c.join(a, b)
    seen, gone = set(), {}
    for i, n, x in sorted(spots, key=lambda s: s[:2]):
        k = c.find(x)
        if k in seen:
            gone.setdefault(i, set()).add(n)
        seen.add(k)
    return gone
