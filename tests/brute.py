"""Slow, plain versions of what the operators compute."""


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def ratio(a, b):
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = sorted((a, b), key=len)
    pairs = [(short, long)] + ([(long, short)] if len(a) == len(b) else [])
    best = 0.0
    for s, t in pairs:
        m, n = len(s), len(t)
        windows = [t[:i] for i in range(1, m)] + [t[i : i + m] for i in range(n - m + 1)] + [t[i:] for i in range(n - m + 1, n)]
        best = max([best, *(ratio(s, w) for w in windows)])
    return best


def assign_loop(assets, purchases, threshold=50):
    """assets: (id, item, vendor, text); purchases: (id, item, vendor, text, stock). One asset after the other."""
    left = {p[0]: p[4] or 0 for p in purchases}
    out = {}
    for a in assets:
        text = " ".join(a[1:])
        open_lines = [p for p in purchases if left[p[0]] > 0]
        exact = [p for p in open_lines if p[1:3] == a[1:3]]
        if exact:
            choice, kind = exact[0][0], "exact"
        else:
            scored = [(ratio(" ".join(p[1:4]), text), -i, p[0]) for i, p in enumerate(open_lines)]
            scored = [s for s in scored if s[0] > threshold]
            if not scored:
                continue
            choice, kind = max(scored)[2], "fuzzy"
        left[choice] -= 1
        out[a[0]] = (choice, kind)
    return out
