"""Small tables with the awkward cases, and brute-force versions."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: columns that the operators use inside, as extra columns of the input
CLASH = ["__row", "m", "n_words", "n_lines", "key", "spans", "kept", "x", "label", "h", "doc", "bytes", "w", "N_WORDS_2"]
DOC_DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def texts(seed=7, n=60):
    """Texts with copies, near copies, shared lines and passages."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abdeiklmnorst") for _ in range(r.randint(2, 7))) for _ in range(400)]
    sent = lambda k: " ".join(r.choice(vocab) for _ in range(k)).capitalize() + "."
    shared, passage = sent(9), sent(90)
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and i > 6:
            t = r.choice(out)
        elif kind == 2 and i > 6:
            w = r.choice(out).split(" ")
            w[r.randrange(len(w))] = "edited"
            t = " ".join(w)
        elif kind == 3:
            t = "\n".join([shared, sent(40), shared, sent(30)])
        elif kind == 4:
            t = sent(20) + " " + passage + " Ünder " + sent(15)
        else:
            t = "\n".join(sent(r.randint(20, 60)) for _ in range(3))
        out.append(t)
    return out


ODD = [None, "", " \t\n ", "word", "É É é\u00a0x", "a\nb\n\nb\na", "x" * 5000, "ab " * 3000, "%s <|endoftext|> %s" % ("one", "two")]


def rows(ids=True):
    t = texts() + ODD
    out = [(i, x, ["en", "de", None][i % 3], None if i % 7 == 3 else f"s{i % 11}", None if x is None else len(x))
           for i, x in enumerate(t)]
    out += [out[0], out[0], (None, t[5], "en", "s1", 1), (None, None, None, None, None)]
    return out


def docs(spark, clash=False, data=None):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows() if data is None else data, DOC_DDL)
    if clash:
        df = df.withColumns({c: F.lit(f"extra {c}") for c in CLASH})
    return df


def measures(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    seen, hit = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i:i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(p for i in at for p in range(i, i + 5))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(lines))


def contamination(t, bench):
    w = BENCH_WORD.findall(low(t or ""))
    hit, items = set(), set()
    for item, b in bench:
        bw = BENCH_WORD.findall(low(b or ""))
        k = min(10, len(bw))
        grams = {tuple(bw[i:i + k]) for i in range(len(bw) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i:i + k]) in grams:
                hit.update(range(i, i + k))
                items.add(item)
    ids = ",".join(sorted(map(str, items)))
    return len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest()


def repeats(all_texts, length):
    """(kept, removed, runs) of each text."""
    data = [(t or "").encode() for t in all_texts]
    count = {}
    for b in data:
        for i in range(len(b) - length + 1):
            count[b[i:i + length]] = count.get(b[i:i + length], 0) + 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((bytes(c for c, g in zip(b, gone) if not g), sum(gone), runs))
    return out


def shingles(t, n):
    w = WORD.findall(low(t or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def components(all_texts, n, percent):
    """The index of the first member of each text's component."""
    sets = [shingles(t, n) for t in all_texts]
    top = list(range(len(sets)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                top[y] = x
    return [root(i) for i in range(len(sets))], [len(s) for s in sets]


def dedup_lines(data, min_sites, min_words):
    """Per row of (doc_id, text, source): (text, removed)."""
    trim = lambda x: x.strip(" \t\n\x0b\x0c\r")
    sites, first = {}, {}
    for i, t, s in data:
        for k, x in enumerate((t or "").split("\n")):
            if len(WORD.findall(x)) >= min_words:
                x = trim(x)
                sites.setdefault(x, set())
                if s is not None:
                    sites[x].add(s)
                at = (-1 if i is None else i, hashlib.md5((t or "").encode()).hexdigest(), k)
                first[x] = min(first.get(x, at), at)
    out = []
    for i, t, s in data:
        keep, gone = [], 0
        for k, x in enumerate((t or "").split("\n")):
            key = trim(x)
            at = (-1 if i is None else i, hashlib.md5((t or "").encode()).hexdigest(), k)
            if len(WORD.findall(x)) >= min_words and len(sites[key]) >= min_sites and first[key] != at:
                gone += 1
            else:
                keep.append(x)
        out.append((t if not gone else "\n".join(keep), gone))
    return out
