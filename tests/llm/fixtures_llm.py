"""Small tables with awkward rows, and plain re-computations."""

import random
from collections import defaultdict

WORDS = [f"w{i}" for i in range(400)]


def words(seed, n):
    pick = random.Random(f"{seed}")
    return " ".join(pick.choice(WORDS) for _ in range(n))


LONG = words("long", 30_000)

#: doc_id, text: nulls, blanks, ties, repeated rows, copies, very long.
AWKWARD = [
    (5, words(1, 60)),
    (3, words(1, 60)),
    (3, words(1, 60)),
    (9, words(1, 60).replace(" ", "  \t")),
    (7, None),
    (8, ""),
    (11, "   "),
    (None, words(1, 60)),
    (None, None),
    (12, "one two"),
    (13, "One Two"),
    (14, LONG),
    (15, LONG + " end"),
    (16, "ünï côdé 😀 " + words(2, 30)),
]

#: Names that operators use for columns of their own.
CLASHES = ["digest", "rep", "band", "n", "start", "row", "c0", "_id", "hash", "keep_id", "kept", "source", "score", "bucket", "a", "s"]


def frame(spark, rows, key="doc_id"):
    schema = f"{key} long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *("x" for _ in CLASHES)) for r in rows], schema)


def empty(spark, key="doc_id"):
    return frame(spark, [], key)


def bag(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def read(folder, table):
    import duckdb

    return duckdb.sql(f"select * from '{folder}/{table}.parquet' order by 1").fetchall()


def shingles(text, k=5):
    ws = (text or "").encode().lower().split()
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)])


def near_components(sets):
    """Smallest key reachable over links of similarity 0.75 and more."""
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posting, common = defaultdict(list), defaultdict(int)
    for i, found in sets.items():
        for s in found:
            posting[s].append(i)
    for ids in posting.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                common[a, b] += 1
    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {i: root(i) for i in sets}


def without_repeats(docs, k=20):
    """{doc_id: kept words} of (doc_id, text) in order."""
    seen, kept = set(), {}
    for i, text in docs:
        ws = (text or "").encode().split()
        keep = [True] * len(ws)
        for p in range(len(ws) - k + 1):
            window = tuple(ws[p : p + k])
            if window in seen:
                keep[p : p + k] = [False] * k
            seen.add(window)
        kept[i] = [w for w, x in zip(ws, keep) if x]
    return kept
