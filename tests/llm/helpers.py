"""Small documents with every awkward case, and brute-force models."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, size string, uid int"
SPACE = "[ \t\n\x0b\x0c\r]"


def documents(spark, n=60, seed=3):
    """Copies, near copies, null and empty texts, a long text, repeated rows, null ids; columns with clashing names."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = [sentence(rng.randint(8, 60)) for _ in range(n)]
    base = sentence(80).split()
    for _ in range(20):  # near copies with one to six words changed
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary) + "x"
        texts.append(" ".join(words))
    shared = sentence(55)
    texts += [sentence(rng.randint(10, 60)) + " " + shared for _ in range(20)]  # a passage in common
    texts += [texts[0], texts[0] + "  ", texts[0].replace(" ", "\n"), texts[1].upper(), None, "", " \t", "x", "one two", "one  two", sentence(6000), "été ça où 日本語"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None, None, "s", 1) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[3], None, "s0", 1, True, None, None), (None, "a null id " * 6, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return [w for w in re.split(SPACE + "+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(sets, links):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(sets))]
