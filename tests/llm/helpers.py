import random
import re

WORDS = "".join(chr(97 + i) for i in range(26))


def words(text):
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", raw)


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def changed(rng, text, n):
    """``n`` words replaced."""
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=1, clean=40):
    """(doc_id, text): clean texts, exact and near copies, and every odd text."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(20, 200)) for _ in range(clean)]
    base = prose(rng, 120)
    texts += [base, base, base.upper(), changed(rng, base, 1), changed(rng, base, 2), changed(rng, base, 5), changed(rng, base, 30)]
    short = "one two three"
    texts += [short, "One two\tthree", "one two", "solo", "solo", None, None, "", "   \n", "\u00a0", base + " tail", "a b c d e f", "a b c d e f g", prose(rng, 30_000)]
    return list(enumerate(texts))


def frame(spark, rows, clash=True):
    out = spark.createDataFrame(rows, "doc_id long, text string")
    if clash:  # names that operators use themselves
        for name in ("setid", "key", "n", "component_id", "score", "h", "lang"):
            out = out.selectExpr("*", f"'other' AS {name}")
    return out
