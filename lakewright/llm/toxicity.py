"""Toxicity by a linear-chain conditional random field over words.

Labels mark documents, so words are labelled first: in toxic documents of the sample, words whose
form or beginning (4 to 6 letters) is found more often in toxic documents than chance allows.  The
field has two states; a word's emission is the sum of the weights of its form, its beginnings and of the words before and after it,
and neighbours are tied by transition weights.  Chains are runs of at most CHAIN words of a document.
It is trained by stochastic gradient on forward-backward marginals; half-way the words of toxic documents are labelled anew by
the field's own marginals, so that a word may be toxic in one context and not in another.  A document's score is a logistic
function of its marginals (their sum, its logarithm and the largest), fitted on the same sample.

Scoring covers every word of every text.  An emission is a sum of what each of three words adds, so a worker
computes each distinct word once; forward and backward passes run over all chains of a piece at once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import materialise
from lakewright.llm.text import ALNUM, LOWER, Piece, hash_ranges, mix, pieces
from lakewright.llm.worker import kept as kept_by_worker
from lakewright.llm.worker import releasing

#: The classifier is fitted on a bounded sample: at most SAMPLE labelled documents of either label, by hash order, and SAMPLE_BYTES of text, half for each.
SAMPLE, SAMPLE_BYTES = 3000, 24 << 20
CHAIN = 64
#: How much more frequent in toxic documents a toxic name is at least, and in how many of them it is met.
RATIO, MET = 4, 3
#: Texts that a word is in before it counts as a context: rarer ones would learn single texts by heart.
COMMON = 20
#: Chains in a step of the training, and the fewest steps of its halves.
BATCH, STEPS = 256, 30
DIMENSIONS = 1 << 20
THRESHOLD = 0.7
WORDS = 1_500_000  # distinct words a worker keeps

_MEMBER = ALNUM.copy()
_MEMBER[0x41:0x5B] = True


def _features(word: str) -> list[int]:
    word = word.lower()
    names = [f"={word}", *(f"{k}{word[:k]}" for k in range(4, 7) if len(word) > k)]
    return [zlib.crc32(n.encode("utf-8", "replace")) % DIMENSIONS for n in names]


def _context(word: str) -> list[int]:
    """The features that a word gives to the word after it and to the word before it."""
    word = word.lower()
    return [zlib.crc32(f"{side}{word}".encode("utf-8", "replace")) % DIMENSIONS for side in "<>"]


def _words(text: str) -> list[str]:
    """The words that scoring sees, A-Z apart: runs of letters and digits of ASCII and of anything beyond it."""
    return re.findall("[0-9A-Za-z\\x80-\\U0010ffff]+", text)


class Field:
    """The trained model: word weights, transitions (2 x 2), and the document's logistic function."""

    def __init__(self):
        self.weights = np.zeros(DIMENSIONS, np.float32)
        self.bias = -4.0
        self.transitions = np.zeros((2, 2))
        self.document = np.array([-6.0, 0.0, 0.0, 0.0])

    def parts(self, word: str) -> tuple[float, float, float]:
        """What a word adds to its own emission, to that of the word after it and to that of the word before it."""
        after, before = _context(word)
        return self.bias + float(sum(self.weights[i] for i in _features(word))), float(self.weights[after]), float(self.weights[before])

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray, pairs: bool = False):
        """P(toxic) of every word; emissions: chains x CHAIN, of which lengths count.  With pairs also the expected transitions."""
        t = np.exp(self.transitions)
        steps = emissions.shape[1]
        e = np.exp(np.clip(emissions, -30, 30))
        forward = np.empty((steps, 2, len(emissions)))
        backward = np.ones((steps, 2, len(emissions)))
        now = np.stack([np.ones(len(e)), e[:, 0]])
        forward[0] = now / now.sum(axis=0)
        for k in range(1, steps):
            now = t.T @ forward[k - 1]
            now[1] *= e[:, k]
            forward[k] = now / now.sum(axis=0)
        for k in range(steps - 2, -1, -1):
            now = backward[k + 1].copy()
            now[1] *= e[:, k + 1]
            now = t @ now
            now /= now.sum(axis=0)
            backward[k] = np.where(k + 1 < lengths, now, 1.0)
        both = forward * backward
        p = (both[:, 1] / both.sum(axis=1)).T
        if not pairs:
            return p, None
        inside = np.arange(1, steps)[:, None] < lengths[None, :]
        joint = np.empty((2, 2, steps - 1, len(e)))
        for a in (0, 1):
            for b in (0, 1):
                joint[a, b] = forward[:-1, a] * t[a, b] * (e.T[1:] if b else 1.0) * backward[1:, b]
        joint /= joint.sum(axis=(0, 1))
        return p, (joint * inside).sum(axis=(2, 3))

    def score(self, total: np.ndarray, largest: np.ndarray) -> np.ndarray:
        z = np.stack([np.ones(len(total)), np.log1p(total), largest, np.minimum(total, 3.0)]).T @ self.document
        return 1 / (1 + np.exp(-z))


def _names(words: list[str]) -> np.ndarray:
    """Word number -> the numbers of its form and beginnings, or -1."""
    numbers: dict[str, int] = {}
    out = np.full((len(words), 4), -1, np.int64)
    for i, w in enumerate(words):
        own = (f"={w}", *(w[:k] for k in range(4, 7) if len(w) > k))
        out[i, : len(own)] = [numbers.setdefault(n, len(numbers)) for n in own]
    return out


def _label(docs: list[np.ndarray], toxic: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Word number -> whether it is taken for toxic where it stands in a toxic document."""
    seen = np.zeros((2, int(names.max()) + 1 if names.size else 0), np.int64)
    for ids, y in zip(docs, toxic, strict=True):
        own = np.unique(names[np.unique(ids)])
        seen[int(y), own[own >= 0]] += 1
    b, a = seen
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    share, tried = n1 / (n1 + n0), int(np.count_nonzero((a > 0) & (a + b >= MET)))
    # beyond chance among all names that are met: a binomial tail bound below 1 / tried
    found = a / np.maximum(1, a + b)
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = (a + b) * (found * np.log(found / share) + np.where(b > 0, (1 - found) * np.log((1 - found) / (1 - share)), 0.0))
    strong = (a >= MET) & (a / n1 >= RATIO * b / n0) & (np.nan_to_num(tail) > math.log(tried + 1) + 1)
    return ((names >= 0) & strong[names]).any(axis=1) if len(strong) else np.zeros(len(names), bool)


def _distinct(docs: list[np.ndarray]) -> list[int]:
    """Places of the texts that are no near copy of an earlier one: copies would count one author's words many times.

    Near: three of twelve minima of hashed word pairs are equal.
    """
    seen: list[dict[int, list[int]]] = [{} for _ in range(12)]
    salts = np.arange(1, 13, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keep = []
    for d, ids in enumerate(docs):
        left, right = (ids[:-1], ids[1:]) if len(ids) > 1 else (ids, ids)
        pairs = mix(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) if len(ids) else np.array([d + 2**63], np.uint64)
        low = [int(mix(pairs + salt).min()) for salt in salts]
        near = Counter(other for slot, x in zip(seen, low, strict=True) for other in slot.get(x, ()))
        if not near or max(near.values()) < 3:
            keep.append(d)
            for slot, x in zip(seen, low, strict=True):
                slot.setdefault(x, []).append(d)
    return keep


class _Chains:
    """The chains of the sample: words by number, flat, with those before and after; `none` stands for no word."""

    def __init__(self, docs: list[np.ndarray], table: np.ndarray):
        self.table, none = table, len(table) - 1
        self.words = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        sizes = np.array([len(d) for d in docs])
        ends = np.cumsum(sizes)
        self.doc = np.repeat(np.arange(len(docs)), sizes)
        self.before, self.after = np.r_[none, self.words[:-1]], np.r_[self.words[1:], none]
        self.before[(ends - sizes)[sizes > 0]] = none
        self.after[ends[sizes > 0] - 1] = none
        place = np.arange(len(self.words)) - (ends - sizes)[self.doc]
        self.begin = np.flatnonzero(place % CHAIN == 0)
        self.length = np.diff(np.r_[self.begin, len(self.words)])

    def features(self, chains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features (chains x CHAIN x 6, -1 for none), which places count, and where these are in the flat arrays."""
        inside = np.arange(CHAIN)[None, :] < self.length[chains][:, None]
        at = np.where(inside, self.begin[chains][:, None] + np.arange(CHAIN)[None, :], 0)
        out = np.concatenate([self.table[self.words[at], :4], self.table[self.before[at], 4:5], self.table[self.after[at], 5:6]], axis=2)
        out[~inside] = -1
        return out, inside, at

    def marginals(self, field: Field) -> np.ndarray:
        """P(toxic) of every word."""
        out = np.zeros(len(self.words), np.float32)
        for lo in range(0, len(self.begin), 4096):
            part = np.arange(lo, min(lo + 4096, len(self.begin)))
            feature, inside, at = self.features(part)
            value = np.where(feature >= 0, field.weights[feature], 0).sum(axis=2) + field.bias
            out[at[inside]] = field.marginals(value, self.length[part])[0][inside]
        return out


def _train(field: Field, chains: _Chains, truth: np.ndarray, epochs: int, random: np.random.Generator, squares: list) -> None:
    # every chain with a toxic word, others by chance, and those others that look most toxic
    holds = np.maximum.reduceat(truth, chains.begin)
    positive, negative = np.flatnonzero(holds), np.flatnonzero(~holds)
    # small samples go round more often: STEPS at least
    for _ in range(max(epochs, -(-STEPS // (1 + len(chains.begin) // BATCH)))):
        own = chains.table[:, :4]
        look = np.maximum.reduceat(np.where(own >= 0, field.weights[own], 0).sum(axis=1).astype(np.float32)[chains.words], chains.begin)[negative]
        hard = negative[np.argsort(-look, kind="stable")[: max(2000, len(positive))]]
        order = random.permutation(np.unique(np.concatenate([positive, random.permutation(negative)[: max(2000, len(positive))], hard])))
        for lo in range(0, len(order), BATCH):
            batch = order[lo : lo + BATCH]
            feature, inside, at = chains.features(batch)
            y = np.where(inside, truth[at], False).astype(float)
            value = np.where(feature >= 0, field.weights[feature], 0).sum(axis=2) + field.bias
            p, pairs = field.marginals(value, chains.length[batch], True)
            error = np.where(inside, y - p, 0)
            on = feature >= 0
            flat = feature[on]
            touched, back = np.unique(flat, return_inverse=True)
            change = np.bincount(back, np.broadcast_to(error[:, :, None], feature.shape)[on], len(touched)).astype(np.float32)
            step = change - 1e-3 * field.weights[touched]
            squares[0][touched] += step**2
            field.weights[touched] += 0.4 * step / np.sqrt(squares[0][touched])
            b = float(error.sum())
            squares[1] += b * b
            field.bias += 0.2 * b / math.sqrt(squares[1])
            first, second = y[:, :-1].astype(int), y[:, 1:].astype(int)
            seen = np.array([[np.sum((first == a) & (second == c) & inside[:, 1:]) for c in (0, 1)] for a in (0, 1)])
            step2 = seen - pairs
            squares[2] += step2**2
            field.transitions += 0.1 * step2 / np.sqrt(squares[2])


def fit(texts: list[str], labels: list[int], epochs: int = 12, seed: int = 0) -> Field:
    """A model from whole labelled texts; without either label it scores every text near 0."""
    field = Field()
    toxic = np.array(labels, bool)
    if not toxic.any() or toxic.all():
        return field
    numbers: dict[str, int] = {}
    docs = [np.array([numbers.setdefault(w.lower(), len(numbers)) for w in _words(t)], np.int32) for t in texts]
    keep = _distinct(docs)
    docs, toxic = [docs[i] for i in keep], toxic[keep]
    if not toxic.any() or toxic.all() or not numbers:
        return field
    words = list(numbers)
    table = np.full((len(words) + 1, 6), -1, np.int32)
    often = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=len(words)) >= COMMON
    for i, w in enumerate(words):
        own = _features(w)
        table[i, : len(own)] = own
        if often[i]:
            table[i, 4:] = _context(w)
    marks = _label(docs, toxic, _names(words))
    chains = _Chains(docs, table)
    truth = marks[chains.words] & toxic[chains.doc]
    if not truth.any():
        return field
    random, squares = np.random.default_rng(seed), [np.full(DIMENSIONS, 1e-6, np.float32), 1e-6, np.full((2, 2), 1e-6)]
    _train(field, chains, truth, epochs // 2, random, squares)
    p = chains.marginals(field)
    again = (p >= 0.5) & toxic[chains.doc]
    found = np.bincount(chains.doc, again, len(docs)) > 0
    truth = np.where(found[chains.doc], again, truth)
    _train(field, chains, truth, epochs - epochs // 2, random, squares)
    p = chains.marginals(field)
    total, largest = np.bincount(chains.doc, p, len(docs)), np.zeros(len(docs))
    np.maximum.at(largest, chains.doc, p)
    x = np.stack([np.ones(len(total)), np.log1p(total), largest, np.minimum(total, 3.0)]).T
    w = np.zeros(4)
    for _ in range(60):  # Newton steps of a ridge-penalised logistic regression
        q = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (toxic - q) - w
        w += np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + np.eye(4), gradient)
    field.document = w
    return field


class Scorer:
    """Scores the texts of a worker; keeps the emissions of the distinct words it has met."""

    def __init__(self, field: Field):
        self.field = field
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros((0, 3), np.float32)

    def _emissions(self, piece: Piece, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
        unique, at, back = np.unique(hash_ranges(LOWER[piece.data], starts, ends), return_index=True, return_inverse=True)
        where = np.searchsorted(self.hashes, unique)
        where[where == len(self.hashes)] = 0
        old = self.hashes[where] == unique if len(self.hashes) else np.zeros(len(unique), bool)
        values = np.zeros((len(unique), 3), np.float32)
        values[old] = self.values[where[old]]
        raw = piece.data.tobytes()
        fresh = np.flatnonzero(~old)
        if len(fresh):
            values[fresh] = [self.field.parts(raw[a:b].decode("utf-8", "replace")) for a, b in zip(starts[at[fresh]].tolist(), ends[at[fresh]].tolist(), strict=True)]
        if len(self.hashes) + len(fresh) > WORDS:
            self.hashes, self.values = unique, values
        elif len(fresh):
            hashes = np.concatenate([self.hashes, unique[fresh]])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.values = hashes[order], np.concatenate([self.values, values[fresh]])[order]
        out, near = values[back, 0], doc[1:] == doc[:-1]
        out[1:] += np.where(near, values[back[:-1], 1], 0)
        out[:-1] += np.where(near, values[back[1:], 2], 0)
        return out

    def run(self, column: pa.Array) -> tuple[np.ndarray, list[str]]:
        """Score and toxic spans (start:end in code points, comma-joined) of every text."""
        scores, spans = [], []
        for piece in pieces(column):
            starts, ends, first = piece.words(_MEMBER, False)
            n, counts = len(piece), np.diff(first)
            chains = -(-counts // CHAIN)
            doc = np.repeat(np.arange(n), counts)
            emissions = self._emissions(piece, starts, ends, doc)
            pos = np.arange(len(starts)) - first[doc]
            chain = (np.cumsum(chains) - chains)[doc] + pos // CHAIN
            value = np.zeros((int(chains.sum()), CHAIN))
            value[chain, pos % CHAIN] = emissions
            lengths = np.bincount(chain, minlength=len(value))
            p = self.field.marginals(value, lengths)[0][chain, pos % CHAIN] if len(value) else np.zeros(0)
            largest = np.zeros(n)
            np.maximum.at(largest, doc, p)
            scores.append(self.field.score(np.bincount(doc, p, n), largest))
            own: list[list[str]] = [[] for _ in range(n)]
            hot = np.flatnonzero(p >= 0.5)
            if len(hot):
                points = np.r_[0, np.cumsum((piece.data & 0xC0) != 0x80)]
                begin = np.flatnonzero(np.r_[True, (hot[1:] != hot[:-1] + 1) | (doc[hot[1:]] != doc[hot[:-1]])])
                for i, j in zip(hot[begin], hot[np.r_[begin[1:], len(hot)] - 1], strict=True):
                    base = points[piece.offsets[doc[i]]]
                    own[doc[i]].append(f"{points[starts[i]] - base}:{points[ends[j]] - base}")
            spans += [",".join(s) for s in own]
        return (np.concatenate(scores) if scores else np.zeros(0)), spans


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """At most `sample` labelled documents of either label that are not held out, in the order of a hash of doc_id.

    A label that has texts is in the sample, or this fails: a field fitted without it would find nothing.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    order = F.xxhash64("doc_id")
    ids = known.where("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(sample))
    rows = materialise(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id"))  # 2 * sample ids at most
    # either label has half of the characters; a text that does not fit is passed over, and those of more than a 64th come last, so no text costs others their place
    texts, marks, room = [], [], {0: sample_bytes // 2, 1: sample_bytes // 2}
    fit_in = rows.where(F.length("text") <= sample_bytes // 2)
    for row in fit_in.orderBy(F.length("text") > sample_bytes // 64, F.xxhash64("doc_id"), "doc_id", "text").toLocalIterator():
        if len(row.text) <= room[row.toxic]:
            room[row.toxic] -= len(row.text)
            texts.append(row.text)
            marks.append(row.toxic)
    for toxic in {0, 1} - set(marks):
        if rows.where(F.col("toxic") == toxic).head(1):
            raise ValueError(f"every text labelled {toxic} is longer than the sample's {sample_bytes // 2} characters a label")
    return texts, marks


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """docs with score and spans.  Every row is scored alone; null and empty texts get the score of a text without toxic words.

    Columns of docs that are named score or spans are replaced.
    """
    import uuid

    sent, key = docs.sparkSession.sparkContext.broadcast(field), uuid.uuid4().hex
    kept = [c for c in docs.columns if c not in ("score", "spans")]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    text = kept.index("text")

    @releasing
    def run(batches):
        scorer = kept_by_worker(key, lambda: Scorer(sent.value))
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.slice(lo, 2000)
                scores, spans = scorer.run(part.column(text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array(spans, pa.string())], [*kept, "score", "spans"])

    return docs.select(*kept).mapInArrow(run, ", ".join([*(f"`{c}` {fields[c]}" for c in kept), "score double", "spans string"]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, score, predicted, spans.

    Labels of held-out documents, and any column but text, never reach the model.  A document with several labels
    is toxic if one of them says so; labels without a document, null labels and null ids are ignored.
    """
    field = fit(*labelled_sample(docs, labels))
    out = scored(docs.select("doc_id", "text"), field)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def not_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with the columns of docs."""
    field = fit(*labelled_sample(docs, labels))
    return scored(docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns if c in ("score", "spans")}), field).where(F.col("score") < threshold).drop("score", "spans").withColumnsRenamed({f"_{c}": c for c in docs.columns if c in ("score", "spans")}).select(*docs.columns)
