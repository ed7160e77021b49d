"""Small tables with the awkward cases, and brute-force versions of the operators."""

import hashlib
import re
from collections import defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"

EDGE = [
    (1, None), (2, ""), (3, " \t\n "), (4, "a"), (5, "a " * 700), (6, "a " * 700 + "b"), (7, "é" * 150), (8, "x" + "é" * 150),
    (None, "a " * 300), (None, None), (9, "the quick brown fox " * 40), (9, "the quick brown fox " * 40), (10, LINE), (11, LINE),
    (12, "Before it: " + LINE + " and more after."), (13, LINE.upper()), (14, " ".join(f"w{i}" for i in range(3000))),
    (15, "zz " + " ".join(f"w{i}" for i in range(100)) + " yy"), (16, "\x00\x7f ́ 𝔘 ▁ �"), (17, "x" * 5000),
    (18, "password=abcdefgh1 " + "AKIAABCDEFGHIJKL12 " + "0af" * 20), (19, "mail a.b@c.de, 10.0.0.1, +1 (456) 555-2186, 4111 1111 1111 1111"),
]
SCHEMA = "doc_id long, text string"
CLASHING = "keep string, spans string, hits string, ids string, n_words string, comp string, node long, key long, _key long, id long, votes string"


def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


def clashing(spark):
    """The same rows with extra columns named like columns that operators add."""
    names = [c.split()[0] for c in CLASHING.split(", ")]
    blank = [None if "long" in c else "x" for c in CLASHING.split(", ")]
    return spark.createDataFrame([(*r, *blank) for r in EDGE], SCHEMA + ", " + CLASHING), names


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def substring(docs, size=13):
    """n_words, n_removed, kept hash by comparing all windows."""
    top = 10 ** 18
    texts = [(i, SPACE.findall(x or "")) for i, x in docs]
    least = {}
    for i, w in texts:
        for k in range(len(w) - size + 1):
            t = tuple(w[k:k + size])
            least[t] = min(least.get(t, top + 1), top if i is None else i)
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - size + 1):
            if least[tuple(w[k:k + size])] < (top if i is None else i):
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def suffixes(docs, size=200):
    """n_bytes, n_removed, n_spans, kept hash by counting all windows."""
    count = defaultdict(int)
    raw = [(i, (x or "").encode()) for i, x in docs]
    for _, x in raw:
        for k in range(len(x) - size + 1):
            count[x[k:k + size]] += 1
    out = []
    for i, x in raw:
        gone = [False] * len(x)
        for k in range(len(x) - size + 1):
            if count[x[k:k + size]] > 1:
                gone[k:k + size] = [True] * size
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(x), sum(gone), spans, sha(bytes(b for b, g in zip(x, gone) if not g))))
    return out


def shingles(text, n=4):
    w = SPACE.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard(docs, n=4, percent=85):
    """n_shingles and the smallest id reachable, by comparing all pairs."""
    s = [shingles(x, n) for _, x in docs]
    up = list(range(len(docs)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if s[a] and s[b]:
                both = len(s[a] & s[b])
                if 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                    up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            r = find(k)
            least[r] = min(i, least.get(r, i))
    return [(i, len(s[k]), least.get(find(k))) for k, (i, _) in enumerate(docs)]


def contaminated(docs, bench, size=10):
    """n_words, n_hit, n_items, item hash, flag by comparing all windows."""
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    pats = defaultdict(set)
    for i, x in bench:
        w = words(x)
        if i is not None and w:
            for k in range(max(1, len(w) - size + 1)):
                pats[tuple(w[k:k + size])].add(str(i))
    out = []
    for i, x in docs:
        w, hit, items = words(x), set(), set()
        for n in {len(p) for p in pats}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in pats:
                    hit.update(range(k, k + n))
                    items |= pats[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return out


SECRETS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
           ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]


def secrets(docs):
    out = []
    for i, x in docs:
        found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, g, least) in enumerate(SECRETS)
                 for m in p.finditer(x or "") if len(m.group(g)) >= least]
        out.append((i, *[sum(f[1] == k for f in found) for k in range(3)], sha(",".join(f[2] for f in sorted(found)))))
    return out


def luhn(d):
    d = [int(c) for c in reversed(d)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


PII = [("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s, d: True),
       ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s, d: all(int(p) <= 255 for p in s.split("."))),
       ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s, d: 13 <= len(d) <= 19 and luhn(d)),
       ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s, d: 9 <= len(d) <= 15)]


def pii_spans(text):
    return [(k, *m.span()) for k, (_, p, ok) in enumerate(PII) for m in p.finditer(text or "")
            if ok(m.group(), re.sub("[^0-9]", "", m.group()))]
