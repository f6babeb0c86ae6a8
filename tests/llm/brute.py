"""Plain versions of the operators, for small inputs."""

import hashlib
import random

WHITE = b" \t\n\x0b\x0c\r"


def raw(text):
    return b"" if text is None else text.encode()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def removed_bytes(docs, width):
    """docs: list of (doc_id, text) -> (n_bytes, n_removed, n_spans, sha) per row."""
    least = {}
    for doc_id, text in docs:
        t = raw(text)
        for i in range(len(t) - width + 1):
            s = t[i : i + width]
            least[s] = min(least.get(s, order(doc_id)), order(doc_id))
    out = []
    for doc_id, text in docs:
        t = raw(text)
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if least[t[i : i + width]] < order(doc_id):
                gone[i : i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, sha(kept)))
    return out


def removed_words(docs, width):
    """(n_words, n_removed, sha) per row; rows sharing an id do not touch one another."""
    least = {}
    for doc_id, text in docs:
        w = raw(text).split()
        for i in range(len(w) - width + 1):
            s = tuple(w[i : i + width])
            least[s] = min(least.get(s, order(doc_id)), order(doc_id))
    out = []
    for doc_id, text in docs:
        w = raw(text).split()
        gone, seen = [False] * len(w), set()
        for i in range(len(w) - width + 1):
            s = tuple(w[i : i + width])
            if least[s] < order(doc_id) or s in seen:
                gone[i : i + width] = [True] * width
            seen.add(s)
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), sha(b" ".join(kept))))
    return out


def lower(data):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in data)


def shingles(text):
    w = lower(raw(text)).split()
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def roots(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def invented(seed, n, copies=True):
    """Documents that share passages, have near and exact copies, and odd cases."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passages = [say(40) for _ in range(4)]
    docs = []
    for i in range(n):
        kind = rng.random()
        text = say(rng.randint(1, 150))
        if kind < 0.25:
            text = text + rng.choice([" ", "\n", "\t "]) + rng.choice(passages) + "\n" + say(rng.randint(0, 30))
        elif copies and kind < 0.5 and docs:
            words = (docs[rng.randrange(len(docs))][1] or "").split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
            text = " ".join(words)
        docs.append((i, text))
    docs += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, ("wort " * 200).strip())]
    docs += [(3, docs[3][1]), (3, "another text " + docs[4][1]), (n + 5, docs[0][1] + " " + docs[0][1])]
    docs += [(None, docs[1][1]), (n + 6, "é" * 120), (n + 7, "x" + "é" * 120)]
    return docs
