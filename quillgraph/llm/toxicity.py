"""Toxicity: a learned lexicon, misspellings by Levenshtein automata, quotation by context.

The lexicon has whole words and stems (any ending) that toxic documents use in
many different surroundings and others hardly use; copies of one document share
their surroundings and so count once. A word is matched by intersecting its
Levenshtein automaton with the lexicon's trie. Each match is weighed by the
words around it: inside quotation marks or after a word of reporting it speaks
of abuse rather than being it. A logistic curve over both kinds of evidence,
fitted on the labelled sample, gives the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.langid import bounded_sample, fold

SAMPLE = 2000  # labelled documents of each label that are learned from, about
SUPPORT = 4, 0.01  # different surroundings that a word needs: a number, and a share of the toxic sample; a stem needs twice as many
RARER = 0.02  # how much of its rate in toxic documents a term may have in others
LONGEST_STEM = 64  # letters; whole words may be longer
STEM, FUZZY = 4, 5  # letters of the shortest stem, and of the shortest entry that may be misspelled
WINDOW = 5  # words on either side
CACHED = 400_000  # words remembered in each worker
THRESHOLD = 0.7

TOKENS = re.compile(r"\w+|[\"“”„«»]")
WORD = re.compile(r"\w+")
#: Words that report speech in the corpus languages.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes word term dit disait écrit appelé mot terme sagte sagt schrieb nannte wort begriff dijo dice escribió llamó palabra término".split())
QUOTES = frozenset("\"“”„«»")


class Automaton:
    """Accepts what is within ``radius`` edits of ``word``; states are sets of (place, edits)."""

    def __init__(self, word: str, radius: int):
        self.word, self.radius = word, radius

    def closed(self, states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        out = set()
        for place, edits in states:
            while edits <= self.radius and place <= len(self.word):
                out.add((place, edits))
                place, edits = place + 1, edits + 1  # a letter of the word is skipped
        return frozenset(out)

    def start(self) -> frozenset[tuple[int, int]]:
        return self.closed({(0, 0)})

    def step(self, states: frozenset[tuple[int, int]], letter: str) -> frozenset[tuple[int, int]]:
        new = set()
        for place, edits in states:
            if place < len(self.word) and self.word[place] == letter:
                new.add((place + 1, edits))
            elif edits < self.radius:
                new |= {(place + 1, edits + 1), (place, edits + 1)} if place < len(self.word) else {(place, edits + 1)}
        return self.closed(new)

    def edits(self, states: frozenset[tuple[int, int]], whole: bool) -> int | None:
        """Least edits so far; with ``whole`` only if the word is used up."""
        return min((e for p, e in states if not whole or p == len(self.word)), default=None)


class Lexicon:
    """Words and stems in a trie, with the words that merely look like one of them."""

    def __init__(self, words: list[str], stems: list[str], exempt: frozenset[str] = frozenset()):
        self.words, self.stems, self.exempt = sorted(words), sorted(stems), exempt
        self.exact, self.roots = frozenset(words), frozenset(stems)
        self.lengths = sorted({len(s) for s in stems})
        self.trie: dict = {}
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        self.ends: set[tuple[int, int]] = set()
        for entry, whole in [(w, True) for w in self.words] + [(s, False) for s in self.stems]:
            if len(entry) < FUZZY:
                continue
            node = self.trie
            for letter in entry:
                node = node.setdefault(letter, {})
            node[""] = node.get("", True) and whole  # a stem accepts any ending
            half = len(entry) // 2
            self.heads.setdefault(half, set()).add(entry[:half])
            self.tails.setdefault(len(entry) - half, set()).add(entry[half:])
            self.ends |= {(len(entry) - half, half + shift) for shift in (-1, 0, 1)}
        self.seen: set[str] = set()
        self.hits: dict[str, int] = {}

    def matches(self, words: set[str]) -> set[str]:
        """Those of the words that match; ``hits`` has their edits. Each word is matched once while it is remembered."""
        if len(self.seen) > CACHED:
            self.seen.clear()
            self.hits.clear()
        new = words - self.seen
        for word in new:
            edits = self.match(word)
            if edits is not None:
                self.hits[word] = edits
        self.seen |= new
        return words & self.hits.keys()

    def match(self, word: str) -> int | None:
        """Edits to the nearest entry, 0 or 1; None if there is none."""
        if word in self.exact or any(word[:n] in self.roots for n in self.lengths):
            return 0
        if len(word) < FUZZY - 1 or word in self.exempt or not self._halves(word):
            return None
        automaton, best = Automaton(word, 1), None
        stack = [(self.trie, automaton.start())]
        while stack:
            node, states = stack.pop()
            for letter, child in node.items():
                if letter == "":
                    e = automaton.edits(states, child)
                    best = e if best is None or e is not None and e < best else best
                elif after := automaton.step(states, letter):
                    stack.append((child, after))
        return best

    def _halves(self, word: str) -> bool:
        """One edit leaves one half of an entry whole; that half is in its place or one off."""
        for n, heads in self.heads.items():
            if word[:n] in heads:
                return True
        for n, at in self.ends:
            if word[at : at + n] in self.tails[n]:
                return True
        return False

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Weights of abusive and of quoted matches in a whole text; a misspelling weighs half."""
        text = (text or "").lower()
        hits = self.matches(set(WORD.findall(text)))
        if not hits:
            return 0.0, 0.0
        tokens = TOKENS.findall(text)
        abuse = quoted = 0.0
        open_ = 0
        for at, token in enumerate(tokens):
            if token in QUOTES:
                open_ += 1
            elif token in hits:
                weight = 0.5 ** self.hits[token]
                around = tokens[max(0, at - WINDOW) : at + WINDOW + 1]
                marked = open_ % 2 == 1 and any(t in QUOTES for t in tokens[at + 1 : at + 1 + 4 * WINDOW])
                if marked or any(t in REPORTING for t in around):
                    quoted += weight
                else:
                    abuse += weight
        return abuse, quoted


def _usages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of each labelled text once, with a number for the words beside it."""
    for batch in batches:
        words, beside, labels = [], [], []
        for label, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            own = WORD.findall((text or "").lower())
            seen = {w: (a, b) for a, w, b in zip(["", *own[:-1]], own, [*own[1:], ""], strict=True)}
            words += seen
            beside += [zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass")) for a, b in seen.values()]
            labels += [label] * len(seen)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(beside, pa.int64()), pa.array(labels, pa.int32())], names=["word", "beside", "label"])


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of (1, abuse, quoted), by Newton steps. The prior: abuse counts, quotation hardly."""
    prior, strength = np.array([-3.0, 4.0, 0.5]), np.array([0.01, 0.5, 5.0])
    x, w = np.c_[np.ones(len(x)), np.log2(1 + x)], prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - prior)
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(strength), gradient)
    return w


def _score(w: np.ndarray, abuse: Column, quoted: Column) -> Column:
    z = F.lit(float(w[0])) + F.lit(max(float(w[1]), 0.0)) * F.log2(1 + abuse) + F.lit(float(w[2])) * F.log2(1 + quoted)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def train(rows: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """From ``(id, text, label)`` rows with labels 0 and 1: the lexicon and the curve."""
    used = rows.select(F.col("label").cast("int"), "text").mapInArrow(_usages, "word string, beside long, label int")
    stats = used.groupBy("word").agg(F.countDistinct(F.when(F.col("label") == 1, F.col("beside"))).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    totals = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    rate = RARER * totals.get(0, 1) / max(1, totals.get(1, 0))
    support = max(SUPPORT[0], SUPPORT[1] * totals.get(1, 0))
    best = lambda df, key: [r[0] for r in df.orderBy(F.desc("pos"), key).collect()]
    words = best(stats.where((F.col("pos") >= support) & (F.col("neg") <= rate * F.col("pos"))), "word")
    prefixes = stats.select("word", "pos", "neg", F.explode(F.sequence(F.lit(STEM), F.greatest(F.least(F.length("word"), F.lit(LONGEST_STEM)), F.lit(STEM)))).alias("n")).where(F.length("word") >= F.col("n"))
    stems = prefixes.groupBy(F.expr("substring(word, 1, n)").alias("stem")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count("*").alias("n"))
    stems = [(r[0], r[1]) for r in stems.where((F.col("pos") >= 2 * support) & (F.col("neg") <= rate * F.col("pos")) & (F.col("n") >= 3)).orderBy(F.desc("pos"), "stem").collect()]
    weight = dict(stems)
    # The longest stem that loses hardly any support to its extensions stands for them.
    top = [s for s in weight if not any(s[:n] in weight for n in range(STEM, len(s)))]
    roots = []
    for s in top:
        while longer := [t for t in weight if len(t) == len(s) + 1 and t.startswith(s) and weight[t] >= 0.95 * weight[s]]:
            s = longer[0]
        roots.append(s)
    lexicon = Lexicon([w for w in words if not any(w.startswith(r) for r in roots)], roots)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w for w in batch.column(0).to_pylist() if lexicon.match(w) == 1]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["word"])

    exempt = stats.where(F.col("neg") > rate * F.col("pos")).select("word").mapInArrow(near, "word string")
    lexicon = Lexicon(lexicon.words, lexicon.stems, frozenset(r[0] for r in exempt.collect()))
    found = np.array([tuple(r) for r in with_evidence(rows.select("text", "label"), lexicon, ["label"]).collect()], float).reshape(-1, 3)
    return lexicon, _fit(found[:, 1:], found[:, 0])


def with_evidence(df: DataFrame, lexicon: Lexicon, carry: list[str], text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.evidence(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=[*carry, "abuse", "quoted"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    return df.select(F.col(text_col).cast("string").alias("__text"), *carry).mapInArrow(run, f"{kinds}, abuse double, quoted double")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> DataFrame:
    """``(id, text, label)`` for about ``most`` labelled documents of each label outside the held-out fold.

    Only ids of the sample are joined. Their number is bounded: an id counts once
    with each of its labels, and of documents that share an id the least text.
    """
    known = labels.where((fold(id_col) != 1) & F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).alias("label")).distinct()
    chosen = bounded_sample(known, "label", "id", most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    return rows.groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label")


def scores(docs: DataFrame, lexicon: Lexicon, curve: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds to each row's id the score, the prediction and the evidence.

    Null and empty texts have no evidence and get the least score of that kind.
    """
    rows = with_evidence(docs, lexicon, [id_col], text_col).withColumn("score", _score(curve, F.col("abuse"), F.col("quoted")))
    return rows.select(id_col, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "abuse", "quoted")
