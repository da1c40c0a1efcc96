"""Small fixtures with every awkward row, and plain reference versions."""

import re

CLASH = "row same starts raw between described found one gone result range group space _row _lines _raw _between _key".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, path string, key long, size string, " + ", ".join(f"{c} string" for c in CLASH)


def documents(spark, texts, ids=None):
    """documents with extra columns whose names clash with those the operators use inside."""
    rows = [(ids[k] if ids else k, t, None if k % 3 == 0 else "en", "s", len(t) if t is not None else None, "p", k, "x", *CLASH) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_components(texts):
    """Smallest index reachable by links of similarity 0.75 or more."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]
