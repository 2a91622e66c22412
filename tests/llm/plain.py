"""Plain Python versions of what the operators compute, and a table with every awkward kind of row."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; a table may have such columns too.
CLASHING = ["key", "node", "part", "border", "rate", "copy", "place", "n", "n_words", "start", "band", "component", "kept", "content", "cell", "own"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    stop = ["the", "of", "and", "to", "in", "la", "de", "und"]
    return " ".join(r.choice(stop) if r.random() < 0.3 else f"w{r.randrange(vocabulary)}x{r.choice('abcé日')}" for _ in range(n))


def edited(text, seed, share):
    r, w = random.Random(seed), text.split(" ")
    for i in range(len(w)):
        if r.random() < share:
            w[i] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def awkward():
    """Rows of DOCS: nulls in any column, empty and very long texts, ties, repeated rows, near and exact copies, shared passages."""
    passage = prose("p", 60)
    base = prose("b", 120)
    texts = [None, "", "   \n\t ", "one", "One TWO", "a b c d e", "A b C d E", prose(1, 30000, 5000), base, base, passage, passage + " end",
             "\n".join(["same line here"] * 40), "x" * 3000, "☃ é 日本 \U0001F600 " * 60, "<|endoftext|> a  b\t c <|endoftext|>x ", "ab " * 400]
    texts += [edited(base, s, 0.01 * s) for s in range(1, 9)]
    texts += [prose(f"d{s}", 80) + " " + passage + "\n" + prose(f"e{s}", 40) for s in range(12)]
    texts += [prose(f"u{s}", 20 + 7 * s) for s in range(25)]
    rows = [(i, t, ["en", "de", None][i % 3] if i % 11 == 0 else "en", [None, "a", "b"][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, "a text without a key " * 20, None, None, None), rows[8], rows[12], rows[2]]
    return rows


def with_clashes(df):
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit("other").alias(c) for c in CLASHING])


def shingles(text):
    w = words(lower(text))
    return frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_components(docs):
    """doc_id -> (set size, component, kept); docs: (doc_id, text), no null keys; a key's rows hang together."""
    root = {k: k for k, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(k, shingles(t)) for k, t in docs]
    at = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            at[x].append(i)
    for i, (k, s) in enumerate(sets):
        for j in {j for x in s for j in at[x] if j < i}:
            other = sets[j][1]
            if 100 * len(s & other) >= 75 * len(s | other):
                a, b = find(k), find(sets[j][0])
                root[max(a, b)] = min(a, b)
    return {(k, len(s), find(k), find(k) == k) for k, s in sets}


def without_repeats(docs):
    """(doc_id, n_bytes, n_removed, n_spans, kept bytes) by looking up every window; docs in order of their keys, keys differ."""
    seen, out = set(), []
    for k, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s: s + 100] in seen:
                gone[s: s + 100] = b"\x01" * 100
            else:
                seen.add(b[s: s + 100])
        out.append((k, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def stats(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    count = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if count[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / (1 << 52)


def poisson(rate, u):
    p = upto = math.exp(-rate)
    n = 0
    for k in range(1, 61):
        n += upto <= u
        p = p * rate / k
        upto += p
    return n
