"""Plain versions of clusterings, over all pairs."""

import numpy as np


def hdbscan(ids, x, least, neighbours):
    """(cluster by smallest id or -1, probability) of each id."""
    n, d = len(x), np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(neighbours, n - 1)]
    w = np.maximum(np.maximum(d, core[:, None]), core[None])
    order = sorted((w[i, j], min(ids[i], ids[j]), max(ids[i], ids[j]), i, j) for i in range(n) for j in range(i))
    members, of, node = {i: [i] for i in range(n)}, list(range(n)), dict.fromkeys(range(n))
    children, birth, entry = {}, {}, {}
    for weight, _, _, i, j in order:
        p, q = of[i], of[j]
        if p == q:
            continue
        both, now = members[p] + members[q], None
        if len(both) >= least:
            old = [c for c in (node[p], node[q]) if c is not None]
            if len(old) == 1:
                now = old[0]
            else:
                now = len(birth)
                birth[now], children[now] = weight, old
            for v in (p, q):
                if node[v] is None:
                    entry.update({m: (weight, now) for m in members[v]})
        for m in members[q]:
            of[m] = p
        members[p], node[p] = both, now
    up = {c: a for a, cs in children.items() for c in cs}
    inverse = lambda v: 1 / max(v, 1e-9)

    def within(c):
        return [m for m, (_, b) in entry.items() if b == c] + [m for k in children[c] for m in within(k)]

    def best(c):
        end = inverse(birth[up[c]]) if c in up else 0
        stays = sum(inverse(v) - end for v, b in entry.values() if b == c) + sum(len(within(k)) for k in children[c]) * (inverse(birth[c]) - end)
        below = [best(k) for k in children[c]]
        total = sum(v for v, _ in below)
        if c in up and (not below or stays >= total):
            return stays, [c]
        return total, [y for _, ys in below for y in ys]

    out = {i: (-1, 0.0) for i in ids}
    for top in [c for c in birth if c not in up]:
        for c in best(top)[1]:
            own = within(c)
            most, name = max(inverse(entry[m][0]) for m in own), min(ids[m] for m in own)
            out.update({ids[m]: (name, inverse(entry[m][0]) / most) for m in own})
    return out


def average_linkage(ids, x, k):
    """Cluster by smallest id of each id: cosine distances of all pairs, the closest clusters merge (Lance and Williams)."""
    order = np.argsort(ids)
    names, u = [ids[i] for i in order], (x / np.linalg.norm(x, axis=1, keepdims=True))[order]
    d, size, of = 1 - u @ u.T, np.ones(len(u)), np.arange(len(u))
    np.fill_diagonal(d, np.inf)
    for _ in range(len(u) - k):
        i, j = sorted(np.unravel_index(np.round(d, 12).argmin(), d.shape))
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[j] = d[:, j] = d[i, i] = np.inf
        size[i] += size[j]
        of[of == j] = i
    return {names[r]: names[c] for r, c in enumerate(of)}
