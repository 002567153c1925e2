"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton on folded text.

Folding decomposes compatibility forms (full-width letters, ligatures), drops marks and invisible characters,
undoes look-alike letters and the digits and signs that stand for letters, joins words that are spelled out
letter by letter, and leaves the words of a text separated by single spaces. The lexicon has whole words, and
stems of STEM letters or more that words extend: a general list of insults, and what labelled rows add. A term
is added if the share of texts that hold it differs so much between the labels that chance does not explain
it; near copies among the labelled texts count once, and a term's weight is bounded by the number of texts that
show it. A word inside an exception phrase does not count. A text's matches, normalised by its length, become a score by a logistic function fitted on
the same rows.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm import _text as T
from lumora.llm._shared import columns, small_batches, trimmed
from lumora.llm._text import plain

#: Look-alike letters of other scripts, and digits and signs that stand for letters.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁӏԛԝһɡɑɩοαβεικνρτυχγωłøđßæœıℓ", "abekmhopctyxijsdlqwhgaioabeikvptuxywlodsaoil", strict=True))
SUBSTITUTES = dict(zip("0134578@$!|", "oieastbasil", strict=True))
_MARKS = {c: None for c in range(0x300, 0x370)} | {c: None for c in (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF)}
_FOLD = _MARKS | {ord(k): v for k, v in LOOKALIKES.items()}
#: Before a letter all substitutes stand for letters, after one those that do not end sentences.
_LEET = re.compile(r"[0134578@$!|]+(?=[a-z])|(?<=[a-z])[013457$@]+(?![a-z0-9@])")
_LEET_TABLE = str.maketrans(SUBSTITUTES)
_ASCII = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\W_]+")
_SPELLED = re.compile(r"(?: [a-z]){4,}(?= )")
#: Phrases in which a term is meant otherwise.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bins", "trash bag", "trash bags", "trash collection", "trash pickup", "the trash out", "out the trash", "trash folder", "clown fish", "clown school", "circus clown", "rodeo clown",
    "birthday clown", "class clown", "loser bracket", "losers bracket", "sore loser bracket", "loser of the match", "winner and loser", "winners and losers", "pond scum", "soap scum", "scum layer", "jackass penguin", "donkey and jackass",
    "stupid simple", "pig farm", "garbage can", "garbage collection", "garbage collector", "garbage truck", "fool proof", "april fool", "april fools", "fool s gold", "crazy horse", "dumb bell", "dumb waiter", "deaf and dumb",
)
#: The general lexicon: plain insults, and words that are insults as a rule.
DEFAULT_TERMS = {w: 4.0 for w in (
    "idiot idiots idiotic moron morons moronic imbecile imbeciles stupid scum scumbag scumbags loser losers pathetic worthless disgusting dumbass dumbasses jackass asshole assholes bastard bastards bitch bitches "
    "cretin cretins degenerate degenerates dimwit dimwits dipshit halfwit halfwits lowlife lowlifes nitwit nitwits shithead shitheads sleazebag sleazeball subhuman twat twats wanker wankers douchebag douchebags "
    "dumbfuck fuckface fuckwit motherfucker motherfuckers arsehole arseholes numbskull numbskulls "
    "arschloch vollidiot trottel dummkopf missgeburt drecksau wichser connard connasse salaud salope abruti imbecil gilipollas cabron pendejo subnormal"
).split()} | {w: 2.0 for w in "dumb fool fools trash garbage clown clowns vermin filth filthy vile repulsive despicable contemptible jerk jerks creep creeps swine".split()}
#: Most labelled rows a lexicon is learnt from.
TRAIN_ROWS = 24_000
#: A learnt word: least toxic texts that hold it, and least gain in log-likelihood (nats) over one rate for both labels.
LEAST_TEXTS, LEAST_GAIN = 4, 12.0
#: Letters of a stem: fewer open too many words, and what is longer has such a beginning, too.
STEM, LONGEST_STEM = 6, 16


def fold(text: str) -> str:
    """The words of a folded text, each between single spaces."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).lower().translate(_FOLD)
    text = _LEET.sub(lambda m: m[0].translate(_LEET_TABLE), text)
    if text.isascii():
        words = text.encode().translate(_ASCII).decode().split()
    else:
        words = _WORD.findall(text)
    folded = f" {' '.join(words)} " if words else " "
    return _SPELLED.sub(lambda m: " " + m[0].replace(" ", ""), folded)


@dataclass
class Lexicon:
    """Terms start with a space; a term that also ends with one is a whole word, else a stem, which a word must extend."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -4.0
    slopes: tuple[float, ...] = (1.5, 1.0, 0.0)
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t, w in self.weights.items():
                a.add_word(t, (len(t), w))
            for phrase in self.exceptions:
                p = fold(phrase)
                if p.strip():
                    a.add_word(p, (len(p), None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def matched(self, folded: str) -> tuple[float, int]:
        """Sum of the weights of the words hit (the largest term a word), and their number."""
        if not self.weights:
            return 0.0, 0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in self.automaton().iter(folded):
            at = end - n + 1
            if w is None:
                spared.append((at, end))
            elif w > best.get(at, 0.0) and (folded[end] == " " or folded[end + 1] != " "):
                best[at] = w
        for a, b in spared:
            for at in [x for x in best if a <= x < b]:
                del best[at]
        return sum(best.values()), len(best)

    def features(self, text: str) -> tuple[float, ...]:
        folded = fold(text)
        total, hits = self.matched(folded)
        n = folded.count(" ")
        return total / np.sqrt(n + 1), 100 * hits / (n + 8), np.log1p(hits)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.bias + x @ np.array(self.slopes), -40, 40)
        return 1 / (1 + np.exp(-z))


def _terms(text: str) -> set[str]:
    """The terms that a text holds, without their first space."""
    words = set(fold(text).split())
    return {f"{w} " for w in words} | {w[:k] for w in words for k in range(STEM, min(LONGEST_STEM, len(w) - 1) + 1)}


def _count_terms(batches):
    """Per portion and term: texts of either label that hold it; the empty term stands for all texts."""
    held: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(plain(batch.column(0)).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for t in {"", *_terms(text)}:
                row = held.get(t)
                if row is None:
                    row = held[t] = [0, 0]
                row[toxic] += 1
            if len(held) > 150_000:
                yield _counted(held)
                held = {}
    if held:
        yield _counted(held)


def _counted(held: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), *(pa.array([r[i] for r in held.values()], pa.int64()) for i in (0, 1))], ["term", "clean", "toxic"])


def _learnt(rows: DataFrame, clean: int, toxic: int) -> dict[str, float]:
    """Weights of the terms that tell the labels apart. ``rows``: term, clean, toxic (texts)."""
    a, b = (F.col("toxic") + 0.5) / (toxic + 1), (F.col("clean") + 0.5) / (clean + 1)
    mean = (F.col("toxic") + F.col("clean")) / (toxic + clean)
    likely = lambda n, of, rate: n * F.log(rate) + F.when(of > n, (of - n) * F.log(F.greatest(1 - rate, F.lit(1e-12)))).otherwise(0.0)
    gain = likely(F.col("toxic"), F.lit(toxic), a) + likely(F.col("clean"), F.lit(clean), b) - likely(F.col("toxic"), F.lit(toxic), mean) - likely(F.col("clean"), F.lit(clean), mean)
    found = rows.where((F.col("term") != "") & (F.col("toxic") >= LEAST_TEXTS) & (a > 4 * b)).select("term", "toxic", F.log(a / b).alias("lift"), gain.alias("gain")).where(F.col("gain") >= LEAST_GAIN)
    # few texts show little: the weight is at most the log of one more than their number
    return {r["term"]: float(min(r["lift"], np.log1p(r["toxic"]), 6.0)) for r in found.orderBy("term").collect()}


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-3) -> tuple[float, tuple[float, ...]]:
    """Logistic regression by Newton's method."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), tuple(float(v) for v in w[1:])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _sketches(batches):
    """Text, label and the least hashes of two kinds of its 5-word shingles, which near copies mostly share."""
    for batch in batches:
        column = plain(batch.column(0))
        out = [[], []]
        for a, b in T.slices(column):
            for s in T.shingle_sets(T.words(column.slice(a, b - a)))[0]:
                out[0].append(int(s[0]) >> 1 if len(s) else 0)
                out[1].append(int(T.mix(s ^ np.uint64(1)).min()) >> 1 if len(s) else 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in out)], ["text", "toxic", "one", "two"])


def learn(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from ``labels(doc_id, toxic)`` of rows that are not held out; about ``train_rows`` of them at most.

    Rows with null ids, labels or texts are left out, an id with both labels counts as toxic, and of near copies
    one is taken. Without rows of both labels it is DEFAULT_TERMS with a fixed logistic function.
    """
    marked = columns(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.where(~held_out(F.col("doc_id"))).withColumnRenamed("doc_id", "d")
    seed = lambda c: F.pmod(F.xxhash64(c, F.lit(17)), F.lit(1 << 30))
    n = marked.count()
    if n > train_rows:
        marked = marked.where(seed("d") < int(train_rows / n * (1 << 30)))
    texts = columns(documents, "doc_id", "text").where("text is not null")
    # about train_rows ids go to every task; texts travel only once their number is bounded, too
    rows = texts.join(F.broadcast(marked), F.col("doc_id") == F.col("d")).select("text", "toxic").mapInArrow(trimmed(_sketches), "text string, toxic int, one long, two long")
    n = rows.agg(F.count_distinct("one")).first()[0]
    if n > train_rows:
        rows = rows.where(seed("one") < int(train_rows / n * (1 << 30)))
    first = F.min_by("text", F.xxhash64("text")).alias("text")
    rows = rows.groupBy("one", "toxic").agg(first, F.min("two").alias("two")).groupBy("two", "toxic").agg(first).select("text", "toxic").persist()
    counts = rows.mapInArrow(trimmed(_count_terms), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    clean, toxic = next(((r["clean"], r["toxic"]) for r in counts.where("term = ''").collect()), (0, 0))
    lexicon = Lexicon({f" {w} ": v for w, v in DEFAULT_TERMS.items()}, exceptions)
    if not clean or not toxic:
        rows.unpersist()
        counts.unpersist()
        return lexicon
    lexicon.weights |= {f" {t}": v for t, v in _learnt(counts, clean, toxic).items()}
    counts.unpersist()

    def measure(batches, lexicon=lexicon):
        for batch in batches:
            x = np.array([lexicon.features(t) for t in plain(batch.column(0)).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(1)], ["a", "b", "c", "toxic"])

    table = rows.mapInArrow(trimmed(measure), "a double, b double, c double, toxic int").toPandas()
    rows.unpersist()
    lexicon.bias, lexicon.slopes = _fit(table[["a", "b", "c"]].to_numpy(), table["toxic"].to_numpy().astype(float))
    return lexicon


def _scores(lexicon: Lexicon, at: int):
    def run(batches):
        for batch in batches:
            texts = plain(batch.column(at)).to_pylist()
            x = np.array([lexicon.features(t) for t in texts]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lexicon.score(x))], [*batch.schema.names, "score"])
    return run


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id, held_out, score, predicted.

    Null and empty texts have the score of a text without matches; a null doc_id stays null and is not held
    out. Repeated rows are scored each, alike. Texts are taken whole. Other columns are not read. An empty
    table gives no rows; empty labels give the general lexicon.
    """
    small_batches(documents.sparkSession)
    lexicon = learn(documents, labels)
    rows = columns(documents, "doc_id", "text")
    scored = rows.mapInArrow(trimmed(_scores(lexicon, 1)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that score below ``limit``, with all their columns.

    Rows without text stay; repeated rows stay or go alike; an empty table stays empty.
    """
    small_batches(documents.sparkSession)
    lexicon = learn(documents, labels)
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            x = np.array([lexicon.features(t) for t in plain(batch.column(at)).to_pylist()]).reshape(-1, 3)
            yield batch.filter(pa.array(lexicon.score(x) < limit))

    return documents.mapInArrow(trimmed(run), documents.schema)
