"""Language identification by a linear-chain conditional random field over words.

A word's features are its character 2-, 3- and 4-grams with both ends marked (so the anchored ones
are its affixes) and, if it is in the lexicon of the sample, itself; hashed to ``SLOTS``. Emission
weights, transitions and start weights are learnt together by stochastic gradient ascent on the
likelihood of label sequences. Training sequences join segments of one to three labelled documents, so switches
are seen. Every word of every whole text is labelled by forward-backward; a document's language is
the label of most posterior mass over its words with letters, its score that mass's share.

The sample is bounded: per language at most ``SAMPLE`` labelled documents of least hash (about), two segments of ``SEGMENT``
words each at hash-chosen places. Null texts, and texts without letters, are ``und`` with
score 0; so are all if nothing is labelled. Rows are independent, so repeated rows agree; an empty table gives an
empty one; lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, table, tidy

SAMPLE, SEGMENT, SLOTS = 400, 48, 1 << 18
EPOCHS, BATCH, RATE = 6, 64, 0.6
#: Words whose emissions a worker keeps; words labelled at a time.
CACHE, WORDS = 500_000, 400_000
UND = "und"


def norm(word: str) -> str:
    """Lower case, without what isn't a letter at both ends."""
    if word.isalpha():
        return word.lower()
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b].lower()


def features(words: list[str], lexicon: set[str] | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word number, slot, value) arrays by kind of feature; a kind's values of a word sum to 1."""
    n = len(words)
    cp = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", errors="surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n) + 2
    word = np.repeat(np.arange(n), lengths)
    out = []
    for k in (2, 3, 4):
        h = np.zeros(max(0, len(cp) - k + 1), np.uint64)
        for i in range(k):
            h = (h + cp[i : len(cp) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            h ^= h >> np.uint64(29)
        same = word[: len(h)] == word[k - 1 : k - 1 + len(h)]
        at = word[: len(h)][same]
        count = np.bincount(at, minlength=n)
        out.append((at, (h[same] >> np.uint64(40)).astype(np.int64) % SLOTS, 1.0 / count[at]))
    known = np.array([i for i, w in enumerate(words) if lexicon is None or w in lexicon], np.int64)
    slot = np.fromiter((zlib.crc32(words[i].encode(errors="replace")) % SLOTS for i in known.tolist()), np.int64, len(known))
    return [*out, (known, slot, np.ones(len(known)))]


def forward_backward(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pi: np.ndarray, a: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Posteriors of the labels of each word. Sequences lie one after another in x (emission factors), longest first."""
    alpha, beta = np.empty_like(x), np.empty_like(x)
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")  # sequences longer than t
    prev = None
    for t in range(longest):
        k = alive[t]
        rows = starts[:k] + t
        cur = x[rows] * (pi if t == 0 else prev[:k] @ a)
        cur /= cur.sum(axis=1, keepdims=True)
        alpha[rows] = prev = cur
    at = a.T.copy()
    nxt = np.empty((0, x.shape[1]))
    for t in range(longest - 1, -1, -1):
        k, known = alive[t], len(nxt)
        rows = starts[:k] + t
        cur = np.full((k, x.shape[1]), 1.0 / x.shape[1])
        if known:
            ahead = x[starts[:known] + t + 1] * nxt
            back = ahead @ at
            cur[:known] = back / back.sum(axis=1, keepdims=True)
            if pairs is not None:
                joint = alpha[rows[:known]][:, :, None] * a * ahead[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[rows] = nxt = cur
    post = alpha * beta
    return post / post.sum(axis=1, keepdims=True)


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, pi: np.ndarray, a: np.ndarray, lexicon: set[str]):
        self.labels, self.weights, self.pi, self.a, self.lexicon = labels, weights, pi, a, lexicon

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)))
        for word, slot, value in features(words, self.lexicon):
            for j in range(out.shape[1]):
                out[:, j] += np.bincount(word, self.weights[slot, j] * value, minlength=len(words))
        return out


def train(segments: list[tuple[str, list[str]]], seed: int = 7) -> Model | None:
    """segments: label and words. The model, or None without any."""
    segments = [(lang, [w for w in map(norm, words) if w]) for lang, words in segments]
    segments = sorted((lang, words) for lang, words in segments if words)
    labels = sorted({lang for lang, _ in segments})
    if not labels:
        return None
    number, rng, n_labels = {x: i for i, x in enumerate(labels)}, np.random.default_rng(seed), len(labels)
    counts: dict[str, int] = {}
    for _, words in segments:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    lexicon = {w for w, c in counts.items() if c > 1}
    vocabulary = sorted(counts)
    place = {w: i for i, w in enumerate(vocabulary)}
    kinds = features(vocabulary, lexicon)
    # each word's features as a run of rows
    word, slot, value = (np.concatenate(x) for x in zip(*kinds, strict=True))
    order = np.argsort(word, kind="stable")
    word, slot, value = word[order], slot[order], value[order]
    first = np.searchsorted(word, np.arange(len(vocabulary) + 1))
    weights, squares = np.zeros((SLOTS, n_labels)), np.full((SLOTS, n_labels), 1e-2)
    start, trans = np.zeros(n_labels), np.zeros((n_labels, n_labels))
    start2, trans2 = np.full(n_labels, 1.0), np.full((n_labels, n_labels), 1.0)
    coded = [(number[lang], np.array([place[w] for w in words])) for lang, words in segments]
    for _ in range(EPOCHS):
        mixed = rng.permutation(len(coded))
        sequences, i = [], 0
        while i < len(mixed):
            k = int(rng.integers(1, 4))
            some = [coded[j] for j in mixed[i : i + k]]
            # within a sequence segments are cut short, so that switches come at any distance
            some = [(y, w[: int(rng.integers(4, len(w) + 1))] if len(some) > 1 and len(w) > 4 else w) for y, w in some]
            sequences.append((np.concatenate([np.full(len(w), y) for y, w in some]), np.concatenate([w for _, w in some])))
            i += k
        for b in range(0, len(sequences), BATCH):
            part = sorted(sequences[b : b + BATCH], key=lambda s: -len(s[0]))
            lengths = np.array([len(y) for y, _ in part])
            starts = np.cumsum(lengths) - lengths
            y, w = np.concatenate([s[0] for s in part]), np.concatenate([s[1] for s in part])
            used, inverse = np.unique(w, return_inverse=True)
            rows = np.concatenate([np.arange(first[u], first[u + 1]) for u in used])
            owner = np.repeat(np.arange(len(used)), first[used + 1] - first[used])
            e = np.stack([np.bincount(owner, weights[slot[rows], j] * value[rows], minlength=len(used)) for j in range(n_labels)], axis=1)[inverse]
            pairs = np.zeros_like(trans)
            post = forward_backward(np.exp(e - e.max(axis=1, keepdims=True)), starts, lengths, np.exp(start - start.max()), np.exp(trans - trans.max()), pairs)
            g = -post
            g[np.arange(len(y)), y] += 1
            inner = np.ones(len(y), bool)
            inner[starts] = False
            seen = np.zeros_like(trans)
            np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
            by_word = np.stack([np.bincount(inverse, g[:, j], minlength=len(used)) for j in range(n_labels)], axis=1)
            touched, where = np.unique(slot[rows], return_inverse=True)
            grad = np.stack([np.bincount(where, by_word[owner, j] * value[rows], minlength=len(touched)) for j in range(n_labels)], axis=1) / len(part) - 1e-5 * weights[touched]
            squares[touched] += grad**2
            weights[touched] += RATE * grad / np.sqrt(squares[touched])
            step = (seen - pairs) / len(part) - 1e-3 * trans
            trans2 += step**2
            trans += RATE * step / np.sqrt(trans2)
            step = (np.eye(n_labels)[y[starts]] - post[starts]).sum(axis=0) / len(part)
            start2 += step**2
            start += RATE * step / np.sqrt(start2)
    return Model(labels, weights.astype(np.float32), np.exp(start - start.max()), np.exp(trans - trans.max()), lexicon)


class Labeller:
    """Labels words; emissions of words met are kept."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        self.rows = np.empty((1024, len(model.labels)))
        self.letters = np.empty(1024, bool)

    def learn(self, words: set[str]) -> None:
        if len(self.place) + len(words) > CACHE:
            self.place.clear()
        words, n = sorted(words), len(self.place)
        if n + len(words) > len(self.rows):
            size = max(2 * len(self.rows), n + len(words))
            rows, letters = np.empty((size, self.rows.shape[1])), np.empty(size, bool)
            rows[:n], letters[:n] = self.rows[:n], self.letters[:n]
            self.rows, self.letters = rows, letters
        plain = [norm(w) for w in words]
        some = np.array([bool(p) for p in plain], bool)
        e = np.zeros((len(words), self.rows.shape[1]))
        if some.any():
            e[some] = self.model.emissions([p for p in plain if p])
        self.rows[n : n + len(words)] = np.exp(e - e.max(axis=1, keepdims=True)) + 1e-12
        self.letters[n : n + len(words)] = some
        self.place.update(zip(words, range(n, n + len(words)), strict=True))

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Row numbers of each text's words; they hold until the next call."""
        words = [t.split() for t in texts]
        found = list(map(self.place.get, chain.from_iterable(words)))
        if None in found:
            new = {w for w, x in zip(chain.from_iterable(words), found, strict=True) if x is None}
            if len(self.place) + len(new) > CACHE:
                self.place.clear()
                new = set(chain.from_iterable(words))
            self.learn(new)
            found = list(map(self.place.__getitem__, chain.from_iterable(words)))
        ends = np.cumsum([len(w) for w in words])[:-1]
        return np.split(np.array(found, np.int64), ends)

    def posteriors(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text's number, posteriors of its words, whether each has letters), for texts with words; longest first."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            some, held = [], 0
            while at < len(order) and (not some or held + len(texts[order[at]]) <= 6 * WORDS):
                some.append(order[at])
                held += len(texts[order[at]])
                at += 1
            rows = self.numbers([texts[i] for i in some])
            ranked = sorted((k for k in range(len(some)) if len(rows[k])), key=lambda k: -len(rows[k]))
            if not ranked:
                continue
            lengths = np.array([len(rows[k]) for k in ranked])
            starts = np.cumsum(lengths) - lengths
            flat = np.concatenate([rows[k] for k in ranked])
            post, letters = forward_backward(self.rows[flat], starts, lengths, self.model.pi, self.model.a), self.letters[flat]
            for k, a, n in zip(ranked, starts.tolist(), lengths.tolist(), strict=True):
                yield some[k], post[a : a + n], letters[a : a + n]


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame) -> Model | None:
    """Learns from text and lang of documents that aren't held out."""
    known = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("text", "lang", F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)).alias("h"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    below = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(int((1 << 30) * min(1.0, SAMPLE / n)))) for lang, n in sorted(counts.items())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for text, lang, h in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), batch["h"].to_pylist(), strict=True):
                words = text.split()
                for k in range(2):
                    room = max(1, len(words) - SEGMENT + 1)
                    a = (h * (2 * k + 1) * 2654435761 >> 7) % room
                    langs.append(lang)
                    parts.append(words[a : a + SEGMENT])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.list_(pa.string()))], names=["lang", "words"])

    # bounded: about SAMPLE documents a language, two short segments each
    rows = known.filter(F.col("h") < below).mapInArrow(cut, "lang string, words array<string>").collect()
    return train([(r["lang"], list(r["words"])) for r in rows])


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """lang_pred, score and switches (changes of the likeliest label between words) beside the columns to keep."""
    fields = [docs.schema[c] for c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of SLOTS weights a language and a lexicon of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("language",), None)
        worker = Labeller(shared.value) if shared.value else None
        for batch in batches:
            texts = [t or "" for t in batch["__text"].to_pylist()]
            lang, score, switches = [UND] * len(texts), [0.0] * len(texts), [0] * len(texts)
            for i, post, letters in worker.posteriors(texts) if worker else ():
                if letters.any():
                    mass = post[letters].sum(axis=0)
                    best = post[letters].argmax(axis=1)
                    lang[i], score[i] = worker.model.labels[int(mass.argmax())], float(mass.max() / mass.sum())
                    switches[i] = int((best[1:] != best[:-1]).sum())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(lang), pa.array(score), pa.array(switches, pa.int64())], names=[*keep, "lang_pred", "score", "switches"])

    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("switches", T.LongType())])
    return docs.select(*keep, docs["text"].alias("__text")).mapInArrow(tidy(run), schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "switches")
