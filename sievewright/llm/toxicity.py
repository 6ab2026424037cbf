"""Toxic spans by a linear-chain conditional random field that learns from labels of whole documents.

The field has two states, other and toxic. A token's features are its word, beginnings and ending, its shape, and the
words beside it; transitions join neighbours. Which tokens are toxic is hidden: a document labelled 0 has none, one
labelled 1 has at least one, and the field is fitted to the likelihood of that. Forward-backward messages give every
token's marginal, also to words never seen, and the probability that a document has a toxic token; together they are the
features of a logistic regression that gives the document its score. Tokens are runs of characters between white space
and ASCII punctuation.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import held_out, label_sample, one_each

#: Labelled documents of each class that the model may be fitted on.
PER_CLASS = 3000
#: A feature is used if it stands in so many toxic documents of the sample, in as many surroundings, and is so much likelier there.
SUPPORT = 4
ODDS = 5.0
#: Bytes of the beginnings and endings of words.
BEGINNINGS = (4, 5, 6, 8)
ENDINGS = (4,)
#: Passes over the sample, about how many tokens a step takes, the step's length, and the penalty on squared weights.
EPOCHS = 6
STEP_TOKENS = 60_000
RATE = 0.15
PENALTY = 1e-4
#: The penalty on transitions: documents' labels alone would also be met by runs of toxic tokens as long as the text.
STICKY = 5e-3
#: Tokens of a piece for the recursions; any length gives the same marginals.
PIECE = 64
#: Marginals of at least this are offending tokens.
SPAN = 0.5
#: Words whose weights each worker keeps between batches.
KEPT = 300_000
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: bytes.translate table: every ASCII byte outside 0-9 A-Z a-z is a space; UTF-8 bytes of other characters stay.
BREAKS = bytes(b if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass
class Field:
    """features: number of each feature; weights: of state toxic for each, the last one of every token; move[a, b]: weight of
    state b after a, move[0, 0] being 0; first: of state toxic at the start; head: of the document's features."""

    features: dict[bytes, int]
    weights: np.ndarray
    move: np.ndarray
    first: float
    head: np.ndarray


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(BREAKS).split()


def own_features(token: bytes) -> list[bytes]:
    """What a token has by itself: its word in lower case, beginnings, endings, and shape."""
    word = token.lower()
    kinds = (b"A" if token.isupper() else b"Aa" if token[:1].isupper() else b"a") + (b"0" if any(48 <= c <= 57 for c in token) else b"") + (b"+" if any(c > 127 for c in token) else b"")
    return [b"w:" + word, b"s:" + kinds, *(b"b:" + word[:n] for n in BEGINNINGS if len(word) > n), *(b"e:" + word[-n:] for n in ENDINGS if len(word) > n)]


def after(token: bytes) -> bytes:
    """The feature that a token gives to the next one."""
    return b"<:" + token.lower()


def before(token: bytes) -> bytes:
    return b">:" + token.lower()


class Words(dict):
    """A number for each different token, in the order of their coming."""

    def __missing__(self, token: bytes) -> int:
        k = self[token] = len(self)
        return k

    def ids(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))


class Lexicon:
    """The features of numbered tokens, as lists that lie end to end; -1 where there is no such feature."""

    def __init__(self, features: dict[bytes, int], found: list[bytes]):
        own = [[k for f in own_features(t) if (k := features.get(f, -1)) >= 0] for t in found]
        self.word = np.repeat(np.arange(len(found)), [len(x) for x in own])
        self.own = np.array([k for x in own for k in x], np.int64)
        self.left = np.array([features.get(after(t), -1) for t in found], np.int64)
        self.right = np.array([features.get(before(t), -1) for t in found], np.int64)

    def sums(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: the weight of its own features, and those that it gives to the next and to the previous one."""
        padded = np.append(weights[:-1], 0.0)
        return np.bincount(self.word, weights[self.own], len(self.left)), padded[self.left], padded[self.right]


def potentials(bias: float, sums: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Weight of state toxic of each token of texts that lie end to end; nothing reaches across their borders. starts: first tokens."""
    own, left, right = sums
    z = own[ids] + bias
    if len(ids):
        z[1:] += left[ids[:-1]]
        z[:-1] += right[ids[1:]]
        inner = starts[starts > 0]
        z[inner] -= left[ids[inner - 1]]
        z[inner - 1] -= right[ids[inner]]
    return np.clip(z, -40, 40)


def messages(field: Field, z: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward odds of state toxic before each token (0 at a text's start), backward odds at each token, and its weight exp(z).

    Every text is cut into pieces. The products of a piece's transition matrices, all pieces at once, carry messages from
    piece to piece; then those inside all pieces follow at once. This is exact. sizes: of texts with tokens.
    """
    n, (_, m01, m10, m11) = len(z), np.exp(field.move).ravel()
    ends = np.cumsum(sizes)
    starts, pieces = ends - sizes, -(-sizes // PIECE)
    first = np.cumsum(pieces) - pieces
    total = int(pieces.sum())
    text = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(n) - starts[text]
    place = (within % PIECE) * total + first[text] + within // PIECE
    e = np.exp(z)
    # state 0 goes before a text, so that its first token has the weight of `first` in the place of move[0, 1]
    ratio = e.copy()
    ratio[starts] *= np.exp(field.first) / m01
    weight, real = np.zeros(PIECE * total), np.zeros(PIECE * total, bool)
    weight[place], real[place] = ratio, True
    weight, real = weight.reshape(PIECE, total), real.reshape(PIECE, total)
    whole = real.all(1)
    p00, p01, p10, p11 = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
    for w, r, every in zip(weight, real, whole):
        q00, q01, q10, q11 = p00 + p01 * m10, (p00 * m01 + p01 * m11) * w, p10 + p11 * m10, (p10 * m01 + p11 * m11) * w
        scale = 1 / (q00 + q01 + q10 + q11)
        new = q00 * scale, q01 * scale, q10 * scale, q11 * scale
        p00, p01, p10, p11 = new if every else (np.where(r, x, y) for x, y in zip(new, (p00, p01, p10, p11)))
    last = first + pieces - 1
    ahead, behind = np.zeros(total), np.ones(total)
    for k in range(1, int(pieces.max(initial=0))):
        r = first[pieces > k] + k
        ahead[r] = (p01[r - 1] + ahead[r - 1] * p11[r - 1]) / (p00[r - 1] + ahead[r - 1] * p10[r - 1])
        r = last[pieces > k] - k
        behind[r] = (p10[r + 1] + p11[r + 1] * behind[r + 1]) / (p00[r + 1] + p01[r + 1] * behind[r + 1])
    forward, backward = np.empty((PIECE, total)), np.empty((PIECE, total))
    now = ahead
    for t in range(PIECE):
        forward[t] = now
        now = weight[t] * (m01 + now * m11) / (1 + now * m10)
    now = behind
    for t in range(PIECE - 1, -1, -1):
        backward[t] = now
        new = (m10 + m11 * weight[t] * now) / (1 + m01 * weight[t] * now)
        now = new if whole[t] else np.where(real[t], new, now)
    return forward.ravel()[place], backward.ravel()[place], ratio


def marginals(field: Field, z: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each token, P(state a before it, state b) as [a, b], and of each text the log of the probability that no token is toxic."""
    full = sizes[sizes > 0]
    if not len(full):
        return np.zeros(0), np.zeros((2, 2, 0)), np.zeros(len(sizes))
    (_, m01, m10, m11), (forward, backward, ratio) = np.exp(field.move).ravel(), messages(field, z, full)
    both = np.stack([np.stack([np.ones(len(z)), m01 * ratio * backward]), np.stack([forward * m10, forward * m11 * ratio * backward])])
    both /= both.sum((0, 1))
    none = np.zeros(len(sizes))
    none[sizes > 0] = -np.add.reduceat(np.log1p(m01 * ratio * backward), np.cumsum(full) - full)
    return both[0, 1] + both[1, 1], both, none


def features(p: np.ndarray, none: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text: the probability of a toxic token, the largest marginal, the log of 1 + their sum, the share of expected toxic tokens, and a one."""
    out = np.zeros((len(sizes), 5))
    out[:, 0], out[:, 4] = -np.expm1(none), 1
    full = np.nonzero(sizes)[0]
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        total = np.add.reduceat(p, starts)
        out[full, 1] = np.maximum.reduceat(p, starts)
        out[full, 2] = np.log1p(total)
        out[full, 3] = total / sizes[full]
    return out


def given(token: bytes) -> list[bytes]:
    """All features that a token gives: to itself, to the next and to the previous one."""
    return [*own_features(token), after(token), before(token)]


def chosen_features(texts: list[list[bytes]], labels: np.ndarray) -> dict[bytes, float]:
    """The features that mark toxic texts, with the log of how much likelier they are there.

    Surroundings count besides texts, since near copies repeat a feature in the same ones: the tokens on either side and,
    for a feature that several tokens give, the token.
    """
    inside, outside = Counter(), Counter()
    known: dict[bytes, list[bytes]] = {}
    for found, y in zip(texts, labels):
        different = {t: None for t in found}
        for t in different:
            if t not in known:
                known[t] = given(t)
        (inside if y else outside).update({f for t in different for f in known[t]})
    few, many = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    able = {f: float(np.log(odds)) for f, n in inside.items() if n >= SUPPORT and (odds := (n / few) / ((outside[f] + 0.5) / many)) >= ODDS}
    marked = {t: own for t, own in ((t, [f for f in own if f in able]) for t, own in known.items()) if own}
    around: dict[bytes, set] = defaultdict(set)
    for found, y in zip(texts, labels):
        if y:
            for i, t in enumerate(found):
                for f in marked.get(t, ()):
                    if len(around[f]) < SUPPORT:
                        around[f].add((t, found[i - 1] if i else b"", found[i + 1] if i + 1 < len(found) else b""))
    return {f: able[f] for f in sorted(able) if len(around[f]) >= SUPPORT}


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + l2 * np.eye(x.shape[1])
        beta = beta + np.linalg.solve(h, x.T @ (w * (y - p)) - l2 * beta)
    return beta


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray | None = None) -> Field:
    """A field and its head from texts with labels 0 and 1; equal texts of one label count once for the field."""
    pairs = sorted({(t, int(y)) for t, y in zip(texts, labels)})
    found, y = [tokens(t) for t, _ in pairs], np.array([y for _, y in pairs], int)
    mean = np.mean([len(x) for x in found]) if found else 1.0
    chosen = chosen_features(found, y) if 0 < y.sum() < len(y) else {}
    # at first, a text of usual length has a toxic token with a chance of about a tenth, and a marked one, with two or three features, more likely than not
    # by its own features; what stands beside it counts as far as it is learnt
    odds = np.array([0.0 if f[:2] in (b"<:", b">:") else v for f, v in chosen.items()])
    start = np.append(odds / np.log(ODDS) * np.log(10 * max(1.0, mean)) / 3, -np.log(10 * max(1.0, mean)))
    field = Field({f: k for k, f in enumerate(chosen)}, start, np.zeros((2, 2)), 0.0, np.zeros(5))
    words = Words()
    ids = [words.ids(x) for x in found]
    lexicon = Lexicon(field.features, list(words))
    if field.features:
        train_chain(field, lexicon, ids, y)
    known, sums = {t: k for k, (t, _) in enumerate(pairs)}, lexicon.sums(field.weights)
    x = np.concatenate([document_features(field, sums, ids[i : i + 200]) for i in range(0, len(ids), 200)]) if ids else np.zeros((0, 5))
    if len(labels) and 0 < labels.mean() < 1:
        field.head = logistic(x[[known[t] for t in texts]], labels.astype(float), np.ones(len(labels)) if weights is None else weights)
    else:
        field.head = np.array([0, 0, 0, 0, 2.0 if len(labels) and labels.all() else -2.0])
    return field


def document_features(field: Field, sums: tuple, ids: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    full = sizes[sizes > 0]
    p, _, none = marginals(field, potentials(field.weights[-1], sums, flat, np.cumsum(full) - full), sizes)
    return features(p, none, sizes)


def train_chain(field: Field, lexicon: Lexicon, ids: list[np.ndarray], labels: np.ndarray) -> None:
    """Steps up the gradient of the log likelihood of the texts' labels: expected counts given the label minus expected counts.

    Given label 0 no token is toxic. Given label 1 the paths with a toxic token share the probability of those without,
    so expected counts grow by none / (1 - none).
    """
    k, rng = len(field.weights), np.random.default_rng(0)
    theta = np.r_[field.weights, 0.0, 0.0, 0.0, 0.0]  # weights, move 01, 10 and 11, first
    fast, slow, step = np.zeros_like(theta), np.zeros_like(theta), 0
    texts = np.array([i for i, x in enumerate(ids) if len(x)])
    sizes = np.array([len(x) for x in ids], np.int64)
    for epoch in range(EPOCHS):
        order = rng.permutation(texts)
        group = np.cumsum(sizes[order]) // STEP_TOKENS
        for part in np.split(order, np.nonzero(np.diff(group))[0] + 1):
            field.weights, field.first = theta[:k], float(theta[-1])
            field.move = np.array([[0.0, theta[-4]], [theta[-3], theta[-2]]])
            flat, n = np.concatenate([ids[i] for i in part]), sizes[part]
            starts = np.cumsum(n) - n
            p, both, none = marginals(field, potentials(theta[k - 1], lexicon.sums(field.weights), flat, starts), n)
            positive = np.exp(none) / np.maximum(-np.expm1(none), 1e-12)
            share = np.where(labels[part] == 1, positive, -1.0)
            g = np.repeat(share, n)
            residual = p * g
            inner = np.ones(len(flat), bool)
            inner[starts] = False
            left, right = np.zeros(len(lexicon.left)), np.zeros(len(lexicon.left))
            np.add.at(left, flat[:-1][inner[1:]], residual[1:][inner[1:]])
            np.add.at(right, flat[1:][inner[1:]], residual[:-1][inner[1:]])
            gradient = np.zeros(len(theta))
            gradient[: k - 1] = (
                np.bincount(lexicon.own, np.bincount(flat, residual, len(left))[lexicon.word], k - 1)
                + np.bincount(lexicon.left[lexicon.left >= 0], left[lexicon.left >= 0], k - 1) + np.bincount(lexicon.right[lexicon.right >= 0], right[lexicon.right >= 0], k - 1)
            )
            gradient[k - 1] = residual.sum()
            gradient[-4:-1] = [(both[a, b] * g)[inner].sum() for a, b in ((0, 1), (1, 0), (1, 1))]
            gradient[-1] = residual[starts].sum()
            gradient = gradient / len(part) - np.r_[PENALTY * theta[: k - 1], 0, STICKY * theta[k:]]
            step += 1
            fast, slow = 0.9 * fast + 0.1 * gradient, 0.99 * slow + 0.01 * gradient * gradient
            theta = theta + RATE * (1 - epoch / EPOCHS) * (fast / (1 - 0.9**step)) / (np.sqrt(slow / (1 - 0.99**step)) + 1e-4)
    field.weights, field.first = theta[:k], float(theta[-1])
    field.move = np.array([[0.0, theta[-4]], [theta[-3], theta[-2]]])


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", per_class: int = PER_CLASS) -> Field:
    """A field of labels.<column> from at most per_class whole labelled documents of each class outside the held-out fold.

    Of rows that share an id, one counts, so what the driver gets is bounded by per_class texts of each class.
    """
    sample = label_sample(labels, column, per_class)
    rows = one_each(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).orderBy("doc_id").collect()
    totals = {r["_label"]: r["count"] for r in labels.where(F.col(column).isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col(column).cast("int").alias("_label")).count().collect()}
    y = np.array([r["_label"] for r in rows], int)
    taken = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    w = np.array([totals.get(int(v), 1) / taken[int(v)] for v in y])
    return fit([r["text"] or "" for r in rows], y, w / w.mean() if len(y) else None)


def offsets(text: str, marks: np.ndarray, p: np.ndarray) -> list[dict]:
    """Offending runs of tokens as character offsets, with their largest marginal."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in TOKEN.finditer(raw)]
    out: list[dict] = []
    for k in np.nonzero(marks)[0].tolist():
        if out and out[-1]["_last"] == k - 1:
            out[-1] |= {"end": places[k][1], "p": max(out[-1]["p"], float(p[k])), "_last": k}
        else:
            out.append({"start": places[k][0], "end": places[k][1], "p": float(p[k]), "_last": k})
    # characters before each byte: those bytes that don't go on with a character
    before_byte = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
    return [{"start": int(before_byte[x["start"]]), "end": int(before_byte[x["end"]]), "p": x["p"]} for x in out]


#: Tokens that the recursions take at a time.
RUN_TOKENS = 300_000


class Tagger:
    """Weights of tokens as they come, and what the field says of texts; one for each task."""

    def __init__(self, field: Field):
        self.field, self.words, self.plain = field, Words(), {}
        self.sums = tuple(np.zeros(0) for _ in range(3))

    def ids(self, text: str | None) -> np.ndarray:
        return self.words.ids(tokens(text))

    def run(self, ids: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """The marginals of each text's tokens, and the scores of all texts."""
        known = len(self.sums[0])
        if len(self.words) > known:
            more = Lexicon(self.field.features, list(self.words)[known:]).sums(self.field.weights)
            self.sums = tuple(np.concatenate(x) for x in zip(self.sums, more))
        sizes = np.array([len(x) for x in ids], np.int64)
        # texts of one length without any feature have the same marginals: they are worked on once
        some = self.sums[0] != 0
        for more in self.sums[1:]:
            some |= more != 0
        plain = np.array([not some[x].any() for x in ids], bool)
        new = sorted({int(n) for n in sizes[plain]} - self.plain.keys())
        todo = [*np.nonzero(~plain)[0].tolist()]
        zeros = [np.zeros(n, np.int32) for n in new]
        n = np.array([*sizes[~plain], *new], np.int64)
        own, full = tuple(np.append(x, 0.0) for x in self.sums), n[n > 0]
        flat = np.concatenate([*[ids[k] for k in todo], *[z + len(self.sums[0]) for z in zeros], np.zeros(0, np.int32)])
        p, _, none = marginals(self.field, potentials(self.field.weights[-1], own, flat, np.cumsum(full) - full), n)
        found = features(p, none, n)
        ends = np.cumsum(n)
        self.plain |= {size: (found[len(todo) + k], p[ends[len(todo) + k] - size : ends[len(todo) + k]]) for k, size in enumerate(new)}
        x, each = np.zeros((len(ids), 5)), [np.zeros(0)] * len(ids)
        for row, k in enumerate(todo):
            x[k], each[k] = found[row], p[ends[row] - n[row] : ends[row]]
        for k in np.nonzero(plain)[0].tolist():
            x[k], each[k] = self.plain[int(sizes[k])]
        scores = 1 / (1 + np.exp(-np.clip(x @ self.field.head, -30, 30)))
        if sum(map(len, (v for _, v in self.plain.values()))) > KEPT * 10:
            self.plain = {}
        if len(self.words) > KEPT:
            self.words, self.sums = Words(), tuple(np.zeros(0) for _ in range(3))
        return each, scores


def tagged(docs: DataFrame, field: Field, spans: bool = True) -> DataFrame:
    """(doc_id, score, spans) for each row of docs: spans are character offsets of runs of toxic tokens in the text.

    Null and empty texts have no spans and the score of no toxic token.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(sent.value)
        for batch in batches:
            scores, found, texts, ids, count = [], [], [], [], 0
            for k in range(batch.num_rows):
                texts.append(batch.column(1)[k].as_py() or "")
                ids.append(tagger.ids(texts[-1]))
                count += len(ids[-1])
                if count >= RUN_TOKENS or k == batch.num_rows - 1:
                    each, own = tagger.run(ids)
                    scores.append(own)
                    found += [offsets(t, p >= SPAN, p) if spans and p.max(initial=0) >= SPAN else [] for t, p in zip(texts, each)]
                    texts, ids, count = [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(found, kind)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long, p: double>>")


def scored(docs: DataFrame, field: Field, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for each row of docs."""
    rows = tagged(docs, field)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
