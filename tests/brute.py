"""Plain Python versions of the pairwise rules, for small fixtures."""

from __future__ import annotations

import re


def jaro_winkler(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [ch for j, ch in enumerate(b) if taken[j]]
    t = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    score = (m / len(a) + m / len(b) + (m - t) / m) / 3
    if score > 0.7:
        prefix = 0
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            prefix += 1
        score += 0.1 * prefix * (1 - score)
    return score


def similarity(a: str, b: str, aliases=()) -> float:
    def canon(name: str) -> str:
        for trigger, target in aliases:
            if trigger and trigger in name.lower():
                name = target
                break
        return "".join(c.lower() if c.isascii() else c for c in " ".join(name.split()))

    a, b = canon(a), canon(b)
    ta, tb = ([t.lower() for t in re.split(r"[^\w]+|_", x) if len(t.encode()) >= 2] for x in (a, b))
    share = 0.0
    if ta and tb:
        small, big = (ta, tb) if len(ta) <= len(tb) else (tb, ta)
        share = sum(t in big for t in small) / len(small)
    return max(jaro_winkler(a, b), share)


def reconcile(charges, journals, p, aliases=()):
    """charges: (id, reference, merchant, amount, currency, date); journals: (id, date, amount,
    currency, merchant, external_id). Returns {charge id: (outcome, journal id)} and unmatched ids."""
    taken, out, asks = set(), {}, {}

    def verdict(c, j):
        return ("confirmed" if abs(c[3] - j[2]) <= p.amount_tolerance else "mismatch", j[0])

    by_id = {j[0]: j for j in journals}
    for c in sorted(charges):
        for j in sorted(journals):
            if j[0] not in taken and j[5] == f"bpstmt:{c[1]}":
                taken.add(j[0])
                out[c[0]] = verdict(c, j)
                break
    free = [j for j in journals if j[0] not in taken]

    def near(c, pool):
        found = []
        for j in pool:
            if j[3] == c[4] and abs((c[5] - j[1]).days) <= p.date_window_days:
                s = similarity(c[2], j[4], aliases)
                if s >= p.merchant_gray:
                    found.append((-s, j[0]))
        return sorted(found)

    claims = {}
    for c in charges:
        if c[0] in out:
            continue
        found = near(c, free)
        if not found:
            out[c[0]] = ("book_new", None)
        elif -found[0][0] < p.merchant_threshold:
            out[c[0]] = ("review", None)
        elif len(found) > 1 and -found[1][0] >= p.merchant_threshold and found[1][0] - found[0][0] < p.score_epsilon:
            out[c[0]] = ("review", None)
        else:
            claims.setdefault(found[0][1], []).append(c)
    for jid, group in claims.items():
        j = by_id[jid]
        ranked = sorted((abs(c[3] - j[2]), c[0]) for c in group)
        if len(group) == 1:
            winner = group[0][0]
        elif ranked[0][0] * 2 < ranked[1][0] and j[2] > 0 and ranked[0][0] * 100 <= j[2] * 15:
            winner = ranked[0][1]
        else:
            winner = None
        for c in group:
            if c[0] == winner:
                taken.add(jid)
                out[c[0]] = verdict(c, j)
            elif winner is None:
                out[c[0]] = ("review", None)
            else:
                others = [f for f in near(c, journals) if f[1] != jid]
                out[c[0]] = ("review", None) if others else ("book_new", None)
    return out, {j[0] for j in journals} - taken


def group_runs(runs, tolerance=2.5):
    rows = []
    for x, y, n, t in sorted(runs, key=lambda r: (-r[1], r[0], r[2])):
        if not rows or rows[-1][0] - y > tolerance:
            rows.append((y, []))
        rows[-1][1].append(t)
    return rows
