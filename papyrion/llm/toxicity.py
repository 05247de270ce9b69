"""Toxicity by a weighted finite-state pattern grammar.

Words are read by lexical transducers, tries over characters, one each for insults, threats,
targets, negations and reported speech; their union gives every word its symbol. Clauses of symbols run through
a composition of five transducers: negation scope, reported-speech scope, target nearness, insults
and threats, which match alone or with a target near them, before or after. Compositions are made
as far as they are used. Each clause that holds an insult or threat is matched as a whole; its matches carry the weight of
their pattern. A text's evidence is the likelihood ratio of its weighted matches against its
length, for the family of terms that fits best; a logistic curve turns it into a score.

Terms, rates and the curve are learned from at most ``max_rows`` labelled documents (default
4000 of at most 64 KiB, by hash of doc_id) whose crc32(doc_id as text) mod 5 is not 0. Terms are word
beginnings that are far more frequent in toxic documents, joined into families by the documents they
share; a family that holds a known threat is one of threats. The listed threats, targets, negations
and reporting words are fixed; what a listed threat is worth is learned like the rest.

Defined edge cases: null and empty texts have no match and get the score of a text without
evidence; without labels the built-in terms and curve hold; a null label is not learned from;
repeated rows are scored each for itself; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, learnable, tidy

MAX_ROWS = 4000

# Fixed word lists.
SEED_INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "trash", "disgusting", "dumb", "imbecile", "vermin", "filth")
THREATS = ("kill", "murder", "strangle", "behead", "lynch", "umbringen", "töten", "tuer", "matar")
TARGETS = frozenset("you your yours yourself u he she they him them her his their du dich dir euch ihr sie tu te toi vous il elle ils usted ustedes tú ti él ella ellos".split())
NEGATIONS = frozenset("not no never none neither nor cannot isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals pas jamais aucun aucune nunca jamás ningún ninguna".split())
REPORTS = frozenset("said says say quoted quotes called wrote reported claimed alleged sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split())

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END = range(7)
MARKED = ("plain", "negated", "reported", "negated reported")
#: Weight of a match by pattern: (kind, with target) and by its mark.
PATTERN_WEIGHT = {("insult", False): 1.0, ("insult", True): 1.25, ("threat", False): 0.25, ("threat", True): 1.5}
MARK_WEIGHT = {"plain": 1.0, "negated": 0.5, "reported": 0.5, "negated reported": 0.25}
SCOPE, NEAR = 3, 4
#: Words whose symbols a matcher remembers.
KNOWN_WORDS = 50_000


class Transducer:
    """A deterministic finite-state transducer: ``step`` maps (state, symbol) to (state, outputs); steps are remembered."""

    def __init__(self, start, step):
        self.start, self.step, self.table = start, step, {}

    def at(self, state, symbol):
        key = state, symbol
        if key not in self.table:
            self.table[key] = self.step(state, symbol)
        return self.table[key]

    def __call__(self, symbols):
        state, out = self.start, []
        for s in symbols:
            state, more = self.at(state, s)
            out += more
        return out


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that feeds the outputs of ``a`` to ``b``."""

    def step(state, symbol):
        p, q = state
        p, mid = a.at(p, symbol)
        out = []
        for m in mid:
            q, more = b.at(q, m)
            out += more
        return (p, q), out

    return Transducer((a.start, b.start), step)


def lexicon(entries: dict[str, object], whole: bool) -> Transducer:
    """Characters of a word, then "" -> what its longest listed beginning stands for, or with ``whole`` the word itself; nothing if it is not listed."""
    trie: list[dict[str, int]] = [{}]
    means: list[object] = [None]
    for word, meaning in entries.items():
        at = 0
        for c in word:
            if c not in trie[at]:
                trie[at][c] = len(trie)
                trie.append({})
                means.append(None)
            at = trie[at][c]
        means[at] = meaning

    def step(state, c):
        # a state is a place in the trie (None: outside of it) and the last meaning passed
        at, last = state
        if c == "":
            meaning = last if not whole else means[at] if at is not None else None
            return (0, None), [] if meaning is None else [meaning]
        at = trie[at].get(c) if at is not None else None
        return (at, means[at] if at is not None and means[at] is not None else last), []

    return Transducer((0, None), step)


def union(parts: list[Transducer]) -> Transducer:
    """Reads with all of ``parts``; of what several give at once, the first part's output counts."""

    def step(state, symbol):
        steps = [p.at(q, symbol) for p, q in zip(parts, state)]
        return tuple(q for q, _ in steps), next((out for _, out in steps if out), [])

    return Transducer(tuple(p.start for p in parts), step)


def negation(scope: int = SCOPE) -> Transducer:
    """symbol -> (symbol, whether a negation is within ``scope`` words before it)."""
    return Transducer(0, lambda k, s: (scope if s == NEGATION else 0 if s == END else max(0, k - 1), [(s, k > 0)]))


def reported() -> Transducer:
    """(symbol, negated) -> (symbol, mark); reported speech holds to the end of the clause."""
    return Transducer(False, lambda r, m: ((r or m[0] == REPORT) and m[0] != END, [(m[0], MARKED[m[1] + 2 * r])]))


def nearness(near: int = NEAR) -> Transducer:
    """(symbol, mark) -> (symbol, mark, whether a target is less than ``near`` words before it)."""
    return Transducer(near, lambda since, m: (0 if m[0] == TARGET else near if m[0] == END else min(near, since + 1), [(*m, since < near)]))


def matches_of(symbol: int, kind: str, near: int = NEAR) -> Transducer:
    """Passes (symbol, mark, near) on, with a match (kind, with target, mark) after it for every ``symbol`` once it is known whether a target is near.

    A match waits ``near`` words for a target, to the end of the clause or the next insult or threat at most.
    """

    def step(waiting, m):
        if isinstance(m[0], str):
            return waiting, [m]
        s, mark, target = m
        out, nxt = [m], None
        if waiting:
            held, left = waiting
            if s == TARGET:
                out.append((kind, True, held))
            elif s == END or left == 1 or s in (INSULT, THREAT):
                out.append((kind, False, held))
            else:
                nxt = (held, left - 1)
        if s == symbol:
            if target:
                out.append((kind, True, mark))
            else:
                nxt = (mark, near)
        return nxt, out

    return Transducer(None, step)


def grammar():
    """Symbols of a clause, with END -> matched patterns (kind, with target, mark)."""
    only = Transducer(None, lambda q, m: (q, [m] if isinstance(m[0], str) else []))
    machine = negation()
    for part in (reported(), nearness(), matches_of(INSULT, "insult"), matches_of(THREAT, "threat"), only):
        machine = compose(machine, part)
    return machine


def lowered(text: str) -> str:
    """The text in lower case, character by character, so that places in it stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Matcher:
    """Finds weighted matches, by family of terms, in a text."""

    def __init__(self, families: list[list[str]], threats: list[int] | tuple = ()):
        learned = {stem: k for k, own in enumerate(families) for stem in own}
        insults = {stem: (INSULT, k) for stem, k in learned.items() if k not in threats}
        dangers = {w: (THREAT, -1) for w in THREATS} | {stem: (THREAT, k) for stem, k in learned.items() if k in threats}
        same = lambda words, symbol: dict.fromkeys(words, (symbol, None))
        self.words = union([
            lexicon(insults, False), lexicon(dangers, False), lexicon(same(TARGETS, TARGET), True), lexicon(same(NEGATIONS, NEGATION), True), lexicon(same(REPORTS, REPORT), True),
        ])
        stems = sorted({*insults, *dangers}, key=lambda s: (-len(s), s))
        self.trigger = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, stems)) + ")")
        self.cut, self.word = re.compile(r"[.!?;:,\n]"), re.compile(r"[\w']+")
        self.machine, self.known = grammar(), {}

    def symbol(self, word: str) -> tuple[int, int | None]:
        """The symbol of a word and its family; words that were met are remembered."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > KNOWN_WORDS:
                self.known, self.words.table = {}, {}
            found = self.known[word] = next(iter(self.words([*word, ""])), (OTHER, None))
        return found

    def clauses(self, text: str) -> Iterator[tuple[int, int]]:
        """Bounds of the clauses that hold an insult or threat."""
        done = -1
        for m in self.trigger.finditer(text) if self.trigger else ():
            at = m.start()
            if at < done:
                continue
            begin = max(text.rfind(c, max(done, 0), at) for c in ".!?;:,\n") + 1
            begin = max(begin, done, 0)
            end = self.cut.search(text, at)
            done = end.start() if end else len(text)
            yield begin, done

    def matches(self, text: str) -> tuple[dict[int, float], int, list]:
        """Weighted matches by family (-1: threats), the number of words, and the matched clauses."""
        low = lowered(text)
        out, found = defaultdict(float), []
        for begin, end in self.clauses(low):
            symbols = [self.symbol(w) for w in self.word.findall(low[begin:end])]
            got = self.machine([*(s for s, _ in symbols), END])
            own_of = {"insult": iter([k for s, k in symbols if s == INSULT]), "threat": iter([k for s, k in symbols if s == THREAT])}
            weight = 0.0
            for kind, target, mark in got:
                own = next(own_of[kind])
                value = PATTERN_WEIGHT[kind, target] * MARK_WEIGHT[mark]
                out[own] += value
                weight += value
            found.append((begin, end, weight))
        return out, len(low.split()), found


def evidence(hits: dict[int, float], words: int, rates: dict[int, tuple[float, float, float]]) -> float:
    """The largest log-likelihood ratio of toxic against clean rates, over the families; 0 at least without hits."""
    best = None
    for family, (clean, low, high) in rates.items():
        k = hits.get(family, 0.0)
        if not k:
            continue
        rate = min(max(k / max(words, 1), low), high)
        value = k * math.log(rate / clean) - words * (rate - clean)
        best = value if best is None else max(best, value)
    return -4.0 if best is None else max(min(best, 30.0), -30.0)


DEFAULT = {"families": [list(SEED_INSULTS)], "threats": [], "rates": {"0": (1e-6, 2e-3, 0.05), "-1": (1e-5, 2e-3, 0.05)}, "slope": 1.0, "offset": -1.0}


def learn(rows: list[tuple[int, str]], least_ratio: float = 6.0, least_gain: float = 25.0, shortest: int = 3, longest: int = 8) -> dict:
    """Terms, families, rates and curve from (label, text) rows.

    Near copies count once: of the rows of a label that share one of three smallest hashes of three words, one is used.
    """
    met, once = set(), []
    for label, text in sorted(rows, key=lambda r: (r[1], r[0])):
        words = re.findall(r"[\w']+", text.lower())
        if words:
            runs = {" ".join(words[i : i + 3]).encode() for i in range(max(1, len(words) - 2))}
            keys = [(label, k, min(zlib.crc32(x, k) for x in runs)) for k in range(3)]
            if not met.intersection(keys):
                once.append((label, text, words))
            met.update(keys)
    rows = once
    toxic, clean = [r for r in rows if r[0] == 1], [r for r in rows if r[0] == 0]
    if len(toxic) < 5 or len(clean) < 5:
        return DEFAULT
    seen, where, host = {1: Counter(), 0: Counter()}, defaultdict(set), Counter()
    for k, (label, _, words) in enumerate(rows):
        own = Counter()
        for w, n in Counter(words).items():
            for length in range(shortest, min(longest, len(w)) + 1):
                own[w[:length]] += n
        seen[label].update(own)
        if label == 1:
            for stem in own:
                where[stem].add(k)
        else:
            host.update(own.keys())
    t, c = sum(len(r[2]) for r in toxic), sum(len(r[2]) for r in clean)

    def gain(stem):
        """Twice the log-likelihood that the stem's documents gain from the label."""
        a, b = len(where[stem]), host[stem]
        p = (a + b) / (len(toxic) + len(clean))
        cell = lambda k, n: (k * math.log(k / n / p) if k else 0) + ((n - k) * math.log((1 - k / n) / (1 - p)) if k < n and p < 1 else 0)
        return 2 * (cell(a, len(toxic)) + cell(b, len(clean)))

    good = [
        s for s, docs in where.items()
        if len(docs) >= 4 and seen[1][s] / t >= least_ratio * (seen[0][s] + 0.5) / c
        and len(docs) / len(toxic) >= 3 * host[s] / len(clean) and gain(s) >= least_gain
    ]
    # of the beginnings of a word, the one whose occurrences tell most
    tells = {s: seen[1][s] * math.log(seen[1][s] / t * c / (seen[0][s] + 0.5)) for s in good}
    terms: list[str] = []
    for s in sorted(good, key=lambda s: (-tells[s], -len(s), s)):
        if not any(s.startswith(x) or x.startswith(s) for x in terms):
            terms.append(s)
    # families: terms whose toxic documents overlap
    parent = {s: s for s in terms}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(terms):
        for b in terms[:i]:
            if len(where[a] & where[b]) >= 0.4 * min(len(where[a]), len(where[b])):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for s in terms:
        groups[root(s)].append(s)
    families = sorted(groups.values())
    if not families:
        return DEFAULT
    threats = [k for k, own in enumerate(families) if any(s.startswith(t) or t.startswith(s) for s in own for t in THREATS)]
    matcher = Matcher(families, threats)
    got = [(label, *matcher.matches(text)[:2]) for label, text, _ in rows]
    rates = {}
    for k in range(-1, len(families)):
        hit = [(h.get(k, 0.0), n) for label, h, n in got if label == 1 and h.get(k)]
        # clean texts of the same kind: those that hold the family at all; else all of them
        host = [(h.get(k, 0.0), n) for label, h, n in got if label == 0 and h.get(k)]
        share = sorted(h / max(n, 1) for h, n in hit)
        base = sum(h for h, _ in host) / sum(n for _, n in host) if host else 0.5 / c
        low = max(share[len(share) // 10] if share else 2e-3, 2 * base)
        rates[k] = (base, low, max(share[-1 - len(share) // 20] if share else 0.05, low))
    x = np.array([evidence(h, n, rates) for _, h, n in got])
    y = np.array([label for label, *_ in got], float)
    a, b = 0.5, -1.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, w = p - y, p * (1 - p) + 1e-6
        g = np.array([(r * x).sum() + 0.01 * a, r.sum() + 0.01 * b])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
    return {"families": families, "threats": threats, "rates": {str(k): v for k, v in rates.items()}, "slope": float(a), "offset": float(b)}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """The learned model; learning runs in one Python task over the bounded sample."""
    sample = labelled_sample(docs, labels.where(learnable()), max_rows, ["toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(a, b) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if b]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(learn(rows))])], ["model"])

    got = sample.select("toxic", "text").repartition(1).mapInArrow(tidy(run), "model string").collect()
    return json.loads(got[0]["model"]) if got else DEFAULT


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, predicted, the evidence and the matched clauses (code point spans, weights) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model["families"], model["threats"])
        rates = {int(k): v for k, v in model["rates"].items()}
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))
        for batch in batches:
            value, spans = [], []
            for text in batch.column(1):
                hits, words, found = matcher.matches(text.as_py() or "")
                value.append(evidence(hits, words, rates))
                spans.append([{"start": s, "end": e, "weight": w} for s, e, w in found])
            x = np.asarray(value, float)
            p = 1 / (1 + np.exp(-np.clip(model["slope"] * x + model["offset"], -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(x), pa.array(spans, kind)],
                ["doc_id", "score", "predicted", "evidence", "clauses"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, score double, predicted int, evidence double, clauses array<struct<start:int,end:int,weight:double>>")


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Learn from the labelled rows and score every text: doc_id, held_out, score, predicted, evidence, clauses."""
    return score(docs, fit(docs, labels, max_rows)).select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence", "clauses")
