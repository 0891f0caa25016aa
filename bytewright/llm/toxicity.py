"""Toxicity scores: a lexicon trie intersected with Levenshtein automata, weighed by context."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .common import discard, settle
from .textkit import slices

# Terms of abuse that are known without any label.
SEED_TERMS = ("idiot", "moron", "imbecile", "stupid", "loser", "scum", "pathetic", "worthless", "disgusting", "bastard", "asshole", "dumbass", "retard", "whore")
# Words that report speech, and words that address the reader.
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes reported reports claimed claims sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
ADDRESS = frozenset("you your you're youre u ur du dich dein ihr sie tu te toi vous votre tú usted ustedes".split())
QUOTES = frozenset("\"“”„«»")
_CORE = re.compile(r"^[\W_]+|[\W_]+$")
_LETTERS = re.compile(r"[^\W\d_]+")
FEATURES = 6


@dataclass(frozen=True)
class ToxicityParams:
    """``fit_rows`` bounds the labelled rows that are fitted (those first in hash order), ``lexicon_size`` the
    learnt terms.  A term needs ``support`` toxic documents and a lower bound of ``ratio`` on how much more often
    toxic documents hold it.  Terms of ``fuzzy_length`` characters or more match within one edit."""

    fit_rows: int = 20_000
    lexicon_size: int = 500
    support: int = 4
    ratio: float = 4.0
    fuzzy_length: int = 5
    stem_lengths: tuple[int, ...] = (4, 5, 6, 7)
    window: int = 6
    threshold: float = 0.7


class FuzzyTrie:
    """The product of a trie with the Levenshtein automata of its terms, made deterministic as words are read.

    A state is the set of (node, edits, awaited letter) reached; an awaited letter stands for the second half of a
    transposition.  Most words reach the empty state after a few letters.
    """

    def __init__(self, terms: dict[str, tuple[float, bool]], fuzzy_length: int):
        self.children: list[dict[str, int]] = [{}]
        self.final: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.reach = [0]
        for term, (_, is_stem) in sorted(terms.items()):
            allowed = 0 if is_stem or len(term) < fuzzy_length else 1
            node = 0
            self.reach[0] = max(self.reach[0], allowed)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.final.append(None)
                    self.stem.append(None)
                    self.reach.append(0)
                node = self.children[node][letter]
                self.reach[node] = max(self.reach[node], allowed)
            (self.stem if is_stem else self.final)[node] = term
        self.allowed = {t: 0 if s or len(t) < fuzzy_length else 1 for t, (_, s) in terms.items()}
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accept: list[tuple[str, int] | None] = []
        self.prefix: list[str | None] = []
        self.dead = self._state(set())
        self.start = self._state({(0, 0, "")})

    def _state(self, raw: set[tuple[int, int, str]]) -> int:
        todo, seen = list(raw), {}
        while todo:
            node, edits, wait = todo.pop()
            if edits > self.reach[node] or seen.get((node, wait), 9) <= edits:
                continue
            seen[(node, wait)] = edits
            if not wait:
                todo.extend((child, edits + 1, "") for child in self.children[node].values())
        key = frozenset((n, e, w) for (n, w), e in seen.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = sorted((e, self.final[n]) for n, e, w in key if not w and self.final[n] and e <= self.allowed[self.final[n]])
            self.accept.append((ends[0][1], ends[0][0]) if ends else None)
            stems = sorted(self.stem[n] for n, e, w in key if not w and e == 0 and self.stem[n])
            self.prefix.append(stems[-1] if stems else None)
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        out: set[tuple[int, int, str]] = set()
        for node, edits, wait in self.sets[state]:
            if wait:
                if letter == wait:
                    out.add((node, edits, ""))
                continue
            out.add((node, edits + 1, ""))
            for other, child in self.children[node].items():
                out.add((child, edits + (other != letter), ""))
                if other != letter and letter in self.children[child]:
                    out.add((self.children[child][letter], edits + 1, other))
        nxt = self.steps[state][letter] = self._state(out)
        return nxt

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that ``word`` is, and in how many edits; or the stem it begins with, in none."""
        state, stem = self.start, None
        for letter in word:
            nxt = self.steps[state].get(letter)
            state = self._step(state, letter) if nxt is None else nxt
            if state == self.dead:
                break
            stem = self.prefix[state] or stem
        found = self.accept[state]
        if found and (found[1] == 0 or stem is None):
            return found
        return (stem, 0) if stem else None


class Scorer:
    """Context features of whole texts, by Arrow batches; words are matched once and remembered."""

    def __init__(self, terms: dict[str, tuple[float, bool]], p: ToxicityParams):
        self.terms, self.p = terms, p
        self.trie = FuzzyTrie(terms, p.fuzzy_length)
        self.known: dict[str, int] = {}
        self.hits: list[tuple[str, int] | None] = [None]

    def _hit(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            match = self._match(_CORE.sub("", word).lower())
            found = 0
            if match:
                found = len(self.hits)
                self.hits.append(match)
            self.known[word] = found
        return found

    def _match(self, core: str) -> tuple[str, int] | None:
        """The term that a word of any length is; else the nearest one that a run of letters in it is."""
        match = self.trie.match(core)
        if match or core.isalpha():
            return match
        inner = [m for m in map(self.trie.match, _LETTERS.findall(core)) if m]
        return min(inner, key=lambda m: m[1], default=None)

    def _context(self, words: list[str], k: int) -> tuple[float, bool]:
        """How much of the weight of word ``k`` counts, and whether it stands in a quotation."""
        w = self.p.window
        before, after = words[max(0, k - w) : k], words[k + 1 : k + 1 + w]
        own = words[k]
        opened = own[:1] in QUOTES or any(x[:1] in QUOTES and x[-1:] not in QUOTES for x in before)
        closed = own[-1:] in QUOTES or own[-2:-1] in QUOTES or any(x[-1:] in QUOTES or x[-2:-1] in QUOTES for x in after)
        cores = [_CORE.sub("", x).lower() for x in [*before, *after]]
        reported = any(x in REPORTING for x in cores[: len(before)])
        addressed = any(x in ADDRESS for x in cores)
        quoted = opened and closed
        return min(1.0, (0.4 if quoted else 1.0) * (0.6 if reported else 1.0) + (0.3 if addressed else 0.0)), quoted

    def features(self, texts: pa.Array) -> np.ndarray:
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        # Only between batches: the codes below point into ``hits``.
        if len(self.known) + len(words) > 250_000:
            self.known.clear()
            self.hits = [None]
        codes = np.fromiter((self._hit(w) for w in words), dtype=np.int64, count=len(words))
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        index = coded.indices.to_numpy()
        places = np.flatnonzero(codes[index])
        out = np.zeros((len(texts), FEATURES))
        out[:, 0] = 1.0
        rows = np.searchsorted(at, places, side="right") - 1
        sums = np.zeros((len(texts), 5))
        for place, row in zip(places.tolist(), rows.tolist()):
            lo, hi = max(int(at[row]), place - self.p.window), min(int(at[row + 1]), place + self.p.window + 1)
            near = [words[i] for i in index[lo:hi]]
            term, edits = self.hits[codes[index[place]]]
            factor, quoted = self._context(near, place - lo)
            weight = self.terms[term][0] * factor
            sums[row, 1 if edits else 0] += weight
            sums[row, 2] = max(sums[row, 2], 0.0 if edits else weight)
            sums[row, 3] += quoted
            sums[row, 4] += not edits
        count = np.maximum(np.diff(at), 1)
        out[:, 1], out[:, 2], out[:, 3] = np.log1p(sums[:, 0]), np.log1p(sums[:, 1]), sums[:, 2]
        out[:, 4], out[:, 5] = np.log1p(sums[:, 3]), np.log1p(100.0 * sums[:, 4] / count)
        return out


def _class_counts(p: ToxicityParams):
    """Per batch, in how many documents of each class a word or a word beginning occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen = set(_LETTERS.findall((text or "").lower()))
                terms = {(w, False) for w in seen if len(w) >= 3} | {(w[:k], True) for w in seen for k in p.stem_lengths if len(w) > k}
                counts.update((t, s, toxic) for t, s in terms)
            # A term no toxic document holds cannot be learnt, but one batch does not know that.
            rows = list(counts.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0][0] for r in rows], pa.string()), pa.array([r[0][1] for r in rows], pa.bool_()), pa.array([r[0][2] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())],
                names=["term", "stem", "toxic", "n"],
            )

    return run


def learn_lexicon(train: DataFrame, p: ToxicityParams) -> dict[str, tuple[float, bool]]:
    """Terms and word stems that mark the toxic rows of ``train(doc_id, text, toxic)``: weight, and whether a stem.

    At most ``lexicon_size`` rows come to the driver.
    """
    totals = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    terms: dict[str, tuple[float, bool]] = {t: (0.6, False) for t in SEED_TERMS}
    if not bad or not good:
        return terms
    counted = map_arrow(train, _class_counts(p), "term string, stem boolean, toxic int, n long")
    sums = counted.groupBy("term", "stem").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    low = (F.col("a") - 1.5 * F.sqrt("a")) / bad
    high = (F.col("b") + 1.5 * F.sqrt("b") + 2.0) / good
    chosen = sums.where((F.col("a") >= p.support) & (low >= p.ratio * high)).orderBy(F.desc("a"), "term", "stem").limit(p.lexicon_size)
    rows = chosen.collect()
    weight = lambda r: min(1.0, math.log(((r["a"] + 0.5) / bad) / ((r["b"] + 0.5) / good)) / 6.0)
    whole = {r["term"]: r for r in rows if not r["stem"]}
    stems = {r["term"]: r for r in rows if r["stem"]}
    kept: dict[str, tuple[float, bool]] = {}
    for stem, r in sorted(stems.items(), key=lambda x: len(x[0])):
        longer = [s for s in stems if len(s) == len(stem) + 1 and s.startswith(stem)]
        words = [w for w in whole if w.startswith(stem)]
        if any(stems[s]["a"] >= 0.9 * r["a"] for s in longer) or any(whole[w]["a"] >= 0.9 * r["a"] for w in words):
            continue
        if not any(stem.startswith(k) for k in kept):
            kept[stem] = (weight(r), True)
    # Words that a stem covers stay as well: within one edit only whole words match.
    return terms | {w: (weight(r), False) for w, r in whole.items()} | kept


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Weights by iteratively reweighted least squares with a ridge penalty."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(len(x), 1) ** 0.5)
    penalty[0] = 1e-6
    for _ in range(rounds):
        m = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(m * (1 - m), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(penalty), x.T @ (y - m) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Without labels of both classes: any exact term in plain use passes the threshold.
DEFAULT_WEIGHTS = np.array([-3.0, 4.0, 0.5, 4.0, -0.5, 0.2])


@dataclass(frozen=True)
class ToxicityModel:
    terms: dict[str, tuple[float, bool]]
    weights: np.ndarray
    params: ToxicityParams


def _numbers(terms, p: ToxicityParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms, p)
        for batch in batches:
            for i, j in slices(batch.column(1)):
                x = scorer.features(batch.column(1).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, j - i).cast(pa.int32()), *(pa.array(x[:, c]) for c in range(FEATURES))], names=["toxic", *(f"f{c}" for c in range(FEATURES))])

    return run


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Learn lexicon and weights from the labelled rows that are not held out, at most ``fit_rows`` of them.

    Of an id that is repeated with several texts the least text is fitted; a label that is stated twice counts as 1 if
    either does.
    """
    p = params
    sample = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = sample.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.fit_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # fit_rows bounds the broadcast side.
    train = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    train = settle(train.select("doc_id", "text", "toxic"), "tox-train")
    terms = learn_lexicon(train, p)
    schema = "toxic int, " + ", ".join(f"f{c} double" for c in range(FEATURES))
    table = map_arrow(train, _numbers(terms, p), schema).toArrow()
    discard(train)
    y = table.column("toxic").to_numpy().astype(float)
    x = np.stack([table.column(f"f{c}").to_numpy() for c in range(FEATURES)], axis=1) if len(y) else np.zeros((0, FEATURES))
    weights = fit_logistic(x, y) if len(y) >= 50 and 0 < y.sum() < len(y) else DEFAULT_WEIGHTS
    return ToxicityModel(terms, weights, p)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from the threshold on) to ``docs(text, ...)``.

    A term is matched whole or within one edit, a stem at the beginning of a word; a hit counts less inside a
    quotation or after a reporting word and more beside words of address.  Only the text is read.  Null and empty
    texts get the score of a text without hits; repeated rows each get theirs; words and texts of any length are read
    whole; of equally near terms (ties) the first in order counts; an empty table gives no rows; other columns pass
    through, but for ``score`` and ``predicted``, which are replaced.
    """
    terms, weights, p = model.terms, model.weights, model.params
    for name in ("score", "predicted"):
        docs = docs.drop(name)
    at = docs.columns.index("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms, p)
        for batch in batches:
            for i, j in slices(batch.column(at)):
                part = batch.slice(i, j - i)
                score = 1.0 / (1.0 + np.exp(-np.clip(scorer.features(part.column(at)) @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= p.threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return map_arrow(docs, run, schema)
