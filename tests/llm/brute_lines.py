"""The line rule by brute force: templates of a leaf from the support of its places."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

FLOORS = {"short": 20, "plain": 5, "long": 2}


def tokens(line: str) -> tuple[str, ...]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", lowered))


def expected(docs: list[tuple[int | None, str | None]]) -> Counter:
    """(doc_id, n_lines, n_dropped, text) of all documents; identifiers differ, except in exact copies of a row."""
    key = lambda i: -1 if i is None else i
    having, support = defaultdict(set), Counter()
    for i, text in docs:
        for x in (text or "").split("\n"):
            if tokens(x):
                having[tokens(x)].add((key(i), text))
    texts = {w: {t for _, t in who} for w, who in having.items()}
    for w in texts:
        for p in range(2, len(w)):
            support[len(w), w[:2], p, w[p]] += len(texts[w])

    def template(w):
        need = -(-60 * (len(w) - 2) // 100)
        words = sorted((-support[len(w), w[:2], p, w[p]], p) for p in range(2, len(w)) if w[p] != "<*>")
        return (len(w), w[:2], *sorted((p, w[p]) for _, p in words[:need])) if len(w) >= 4 and len(words) >= need else None

    general = defaultdict(set)
    for w, who in having.items():
        if template(w):
            general[template(w)] |= who

    def owners(w):
        t = template(w)
        if t and len({x for _, x in general[t]}) >= FLOORS["plain"]:
            yield min(general[t])[0]
        floor = FLOORS["short" if len(w) < 4 else "long" if len(w) >= 50 else "plain"]
        if (t is None or len(w) >= 50) and len(texts[w]) >= floor:
            yield min(having[w])[0]

    out = Counter()
    for i, text in docs:
        lines = text.split("\n") if text else []
        kept = [x for x in lines if not tokens(x) or all(o == key(i) for o in owners(tokens(x)))]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept) if len(kept) < len(lines) else text] += 1
    return out
