"""Language of words and documents by a linear-chain conditional random field.

Words are runs of letters and of the marks on them (categories L and M), lower-cased. A word's features are its affixes of one to three letters, its letter bigrams
and trigrams and its whole form (the learned lexicon), all hashed into one weight table; transitions between languages
are learned with them from sequences that change language, and words are labelled by forward-backward.

``predict`` gives one row per document: the language with the largest share of letters, weighting each word by its
posterior. Null texts and texts without a letter get ``und`` and score 0. Ties go to the language that sorts first.
Repeated rows give repeated results, empty tables empty ones, and other columns are ignored. If no labelled row is
left to learn from, every document is ``und``. Texts of any length are labelled whole, as one sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import mix
from .shared import text_slices

UNKNOWN = "und"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Words whose scores a Python worker keeps.
CACHE_WORDS = 300_000
_SEED = {"prefix": 11, "suffix": 12, "gram": 13, "word": 14}


def _bucket(codes: np.ndarray, kind: str, n: int, size: int) -> np.ndarray:
    return (mix(codes * np.uint64(64) + np.uint64(_SEED[kind] * 4 + n)) % np.uint64(size)).astype(np.int64)


def word_features(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of distinct words: word index and bucket of each."""
    chars = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass") + b" \0\0\0", np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    index = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(index)) - np.repeat(np.cumsum(lengths) - lengths, lengths)  # place in its word
    here = start[index] + at
    left = lengths[index] - at
    padded = np.concatenate((chars, np.zeros(3, np.uint64)))
    owner, bucket = [], []
    code = np.zeros(len(here), np.uint64)
    for n in (1, 2, 3):
        code = (code << np.uint64(21)) | padded[here + n - 1]
        whole = left >= n
        for kind, chosen in (("prefix", whole & (at == 0)), ("suffix", left == n), ("gram", whole & (n > 1))):
            owner.append(index[chosen])
            bucket.append(_bucket(code[chosen], kind, n, size))
    total = np.bincount(index, minlength=len(words)).astype(np.uint64)
    np.add.at(total, index, mix(padded[here] + (at.astype(np.uint64) << np.uint64(32))))
    owner.append(np.arange(len(words)))
    bucket.append(_bucket(total, "word", 0, size))
    return np.concatenate(owner), np.concatenate(bucket)


@dataclass
class Crf:
    langs: list[str]
    weight: np.ndarray  # buckets x languages
    transition: np.ndarray  # from x to
    initial: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        owner, bucket = word_features(words, len(self.weight))
        return np.stack([np.bincount(owner, self.weight[bucket, k], len(words)) for k in range(len(self.langs))], 1)


def forward_backward(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, initial: np.ndarray, block: int = 128) -> np.ndarray:
    """Posteriors of the labels of all words of many sequences laid end to end; ``first`` marks where each begins.

    The recursions are products of small matrices, so blocks of words are multiplied side by side, then chained:
    the work doesn't depend on how the words are divided into sequences.
    """
    n, k = emission.shape
    if not n:
        return emission
    rows = -(-n // block)
    e = np.ones((rows * block, k), np.float32)
    e[:n] = np.exp(emission - emission.max(1, keepdims=True))
    begins = np.zeros(rows * block, bool)
    begins[:n] = first
    begins[n:] = True
    e = np.ascontiguousarray(e.reshape(rows, block, k).swapaxes(0, 1))
    fresh = [np.flatnonzero(column) for column in begins.reshape(rows, block).T]
    step, start = np.exp(transition).astype(np.float32), np.exp(initial).astype(np.float32)
    step_back = np.ascontiguousarray(step.T)

    def scaled(v: np.ndarray, t: int) -> np.ndarray:
        return v / np.maximum(v.max((1, 2), keepdims=True), np.float32(1e-30)) if t % 8 == 0 else v

    def ahead(v: np.ndarray, t: int) -> np.ndarray:
        """v (rows x m x k) over word t: a new sequence forgets what came before."""
        moved = (v.reshape(-1, k) @ step).reshape(v.shape)
        moved[fresh[t]] = v[fresh[t]].sum(2, keepdims=True) * start
        moved *= e[t][:, None]
        return scaled(moved, t)

    def back(v: np.ndarray, t: int) -> np.ndarray:
        """What follows word t - 1, from what follows word t; v is rows x m x k."""
        v = v * e[t][:, None]
        moved = (v.reshape(-1, k) @ step_back).reshape(v.shape)
        moved[fresh[t]] = v[fresh[t]] @ start[:, None]
        return scaled(moved, t)

    whole = whole_back = np.ascontiguousarray(np.broadcast_to(np.eye(k, dtype=np.float32), (rows, k, k)))
    for t in range(block):
        whole = ahead(whole, t)
        whole_back = back(whole_back, block - 1 - t)
    alpha, beta = np.empty((rows, 1, k), np.float32), np.empty((rows, 1, k), np.float32)
    v, w = np.full(k, 1 / k, np.float32), np.ones(k, np.float32)
    for i in range(rows):
        alpha[i, 0], beta[rows - 1 - i, 0] = v, w
        v = v @ whole[i]
        v /= v.sum()
        w = w @ whole_back[rows - 1 - i]
        w /= w.max()
    posterior = np.empty((block, rows, k), np.float32)
    for t in range(block):
        alpha = ahead(alpha, t)
        posterior[t] = alpha[:, 0] / alpha[:, 0].sum(1, keepdims=True)
    for t in range(block - 1, -1, -1):
        posterior[t] *= beta[:, 0]
        beta = back(beta, t)
    posterior = posterior.swapaxes(0, 1).reshape(-1, k)[:n].astype(np.float64)
    return posterior / np.maximum(posterior.sum(1, keepdims=True), 1e-300)


def _batch_gradient(crf: Crf, emission: np.ndarray, gold: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the log-likelihood of sequences: by word and label, of transitions, of initials.

    Places that aren't ``real`` are no words: what is known passes through them unchanged. The first place is real.
    """
    rows, length, k = emission.shape
    e = np.exp(emission - emission.max(2, keepdims=True))
    step, start = np.exp(crf.transition), np.exp(crf.initial)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    for t in range(length):
        now = (start if t == 0 else alpha[:, t - 1] @ step) * e[:, t]
        now /= now.sum(1, keepdims=True)
        alpha[:, t] = now if t == 0 else np.where(real[:, t, None], now, alpha[:, t - 1])
    for t in range(length - 2, -1, -1):
        now = (beta[:, t + 1] * e[:, t + 1]) @ step.T
        now /= now.max(1, keepdims=True)
        beta[:, t] = np.where(real[:, t + 1, None], now, beta[:, t + 1])
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    pair = alpha[:, :-1, :, None] * step * (beta[:, 1:] * e[:, 1:])[:, :, None, :]
    pair *= (real[:, 1:] / pair.sum((2, 3)))[:, :, None, None]
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1)
    unit = np.eye(k)
    return (unit[gold] - p) * real[:, :, None], seen - pair.sum((0, 1)), unit[gold[:, 0]].sum(0) - p[:, 0].sum(0)


def fit(texts: list[str], labels: list[str], buckets: int = 1 << 16, length: int = 32, epochs: int = 4, batch: int = 256, rate: float = 0.3, seed: int = 7) -> Crf:
    """Learn from labelled texts. Sequences of up to ``length`` words are cut from the whole texts; half of them join pieces of texts of two languages."""
    langs = sorted(set(labels))
    k = len(langs)
    crf = Crf(langs, np.zeros((buckets, k)), np.zeros((k, k)), np.zeros(k))
    vocabulary: dict[str, int] = {}
    rows, gold = [], []
    for text, label in zip(texts, labels, strict=True):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(text.lower())]
        rows += [ids[i : i + length] for i in range(0, len(ids), length)]
        gold += [langs.index(label)] * (len(rows) - len(gold))
    if not rows:
        return crf
    rng = np.random.default_rng(seed)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    held = np.arange(length) < sizes[:, None]
    plain, tag = np.zeros(held.shape, np.int64), np.repeat(np.array(gold)[:, None], length, 1)
    plain[held] = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
    other = rng.permutation(len(plain))
    cut = rng.integers(1, np.maximum(sizes, 2))[:, None]
    before = np.arange(length) < np.where(rng.random(len(plain))[:, None] < 0.5, length, cut)
    words, tags, real = (np.where(before, x, x[other]) for x in (plain, tag, held))
    owner, bucket = word_features(list(vocabulary), buckets)
    order = np.argsort(owner, kind="stable")
    bucket = bucket[order]
    first = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(vocabulary)))))
    squares, squares_t = np.full((buckets, k), 1e-4), np.full((k, k), 1e-4)
    for _ in range(epochs):
        shuffled = rng.permutation(len(words))
        for at in range(0, len(words), batch):
            chosen = shuffled[at : at + batch]
            distinct, place = np.unique(words[chosen], return_inverse=True)
            counts = first[distinct + 1] - first[distinct]
            mine = np.repeat(first[distinct] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            owners = np.repeat(np.arange(len(distinct)), counts)
            used, slot = np.unique(bucket[mine], return_inverse=True)
            emission = np.stack([np.bincount(owners, crf.weight[bucket[mine], j], len(distinct)) for j in range(k)], 1)
            place = place.reshape(words[chosen].shape)
            by_word, by_pair, by_first = _batch_gradient(crf, emission[place], tags[chosen], real[chosen])
            g_word = np.stack([np.bincount(place.ravel(), by_word[..., j].ravel(), len(distinct)) for j in range(k)], 1)
            g = np.stack([np.bincount(slot, g_word[owners, j], len(used)) for j in range(k)], 1) / len(chosen)
            squares[used] += g**2
            crf.weight[used] += rate * 0.2 * g / np.sqrt(squares[used])
            g_t = by_pair / len(chosen)
            squares_t += g_t**2
            crf.transition += rate * g_t / np.sqrt(squares_t)
            crf.initial += rate * 0.1 * by_first / len(chosen)
    crf.weight = crf.weight.astype(np.float32)
    return crf


def train(docs: DataFrame, learn: Column, per_language: int = 250, most_chars: int = 20_000) -> Crf:
    """Fit on about ``per_language`` labelled texts of each language for which ``learn`` (of doc_id) holds, chosen by a hash.

    Of a text of over ``most_chars`` a slice of that size is taken to learn from, from a place that a hash gives; both
    bounds keep the sample at a fixed size. The languages come to the driver: the model has a column for each.
    """
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    spare = F.length("text") - most_chars
    part = F.when(spare <= 0, F.col("text")).otherwise(F.substring("text", (F.pmod(F.xxhash64("doc_id", "text"), spare + 1) + 1).cast("int"), F.lit(most_chars)))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Crf([], np.zeros((1, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    cut = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 20, per_language * (1 << 20) // n + 1))))
    rows = usable.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < cut[F.col("lang")]).limit(2 * per_language * len(counts)).select(part.alias("text"), "lang").collect()
    rows = sorted((r["text"], r["lang"]) for r in rows)
    return fit([r[0] for r in rows], [r[1] for r in rows])


def label_texts(crf: Crf, texts: list[str], cache: dict[str, int], table: list[np.ndarray]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Words of each text; text of each word; posteriors of each word. cache and table keep the scores of words."""
    words = [WORD.findall(t.lower()) for t in texts]
    new = sorted(set().union(*words) - cache.keys())
    if new:
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            table.clear()
            new = sorted(set().union(*words))
        first = len(cache)
        cache.update(zip(new, range(first, first + len(new)), strict=True))
        table.append(crf.emissions(new))
        table[:] = [np.concatenate(table)]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter(map(cache.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
    doc = np.repeat(np.arange(len(texts)), counts)
    first = np.zeros(len(doc), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    emission = table[0][ids] if table else np.zeros((0, len(crf.langs)))
    return words, doc, forward_backward(emission, first, crf.transition, crf.initial)


def _decide(crf: Crf, texts: list[str], cache: dict[str, int], table: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language of each text (len(crf.langs): unknown), its share of letters, and how often the language changes."""
    k = len(crf.langs)
    if not k:
        return np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    words, doc, posterior = label_texts(crf, texts, cache, table)
    letters = np.fromiter(map(len, chain.from_iterable(words)), np.float64, len(doc))
    mass = np.stack([np.bincount(doc, posterior[:, j] * letters, len(texts)) for j in range(k)], 1)
    total = mass.sum(1)
    tag = posterior.argmax(1)
    switches = np.bincount(doc[1:], (tag[1:] != tag[:-1]) & (doc[1:] == doc[:-1]), len(texts)).astype(np.int64)
    return np.where(total > 0, mass.argmax(1), k), np.clip(mass.max(1) / np.maximum(total, 1e-300), 0, 1), switches


def predict(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, lang_pred, score (the posterior share of letters in that language), n_switches between words of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf, cache, table = shared.value, {}, []
        names = np.array([*crf.langs, UNKNOWN], object)
        for part, texts in text_slices(batches, "text"):
            best, share, switches = _decide(crf, texts, cache, table)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(share), pa.array(switches)], ["doc_id", "lang_pred", "score", "n_switches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_switches long")


def keep_known(docs: DataFrame, crf: Crf, least: float = 0.4) -> DataFrame:
    """The rows, with all columns, whose language is known: some letters, and a share of at least ``least`` in one language."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf, cache, table = shared.value, {}, []
        for part, texts in text_slices(batches, "text"):
            best, share, _ = _decide(crf, texts, cache, table)
            yield part.filter(pa.array((best < len(crf.langs)) & (share >= least)))

    return docs.mapInArrow(run, docs.schema)


def label_words(docs: DataFrame, crf: Crf) -> DataFrame:
    """One row per word: doc_id, place, word (lower-cased), lang, probability."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf, cache, table = shared.value, {}, []
        for part, texts in text_slices(batches, "text", 1 << 18):
            words, doc, posterior = label_texts(crf, texts, cache, table)
            if len(doc):
                place = np.concatenate([np.arange(len(ws)) for ws in words])
                names = np.array(crf.langs, object)[posterior.argmax(1)]
                columns = [part.column(0).take(pa.array(doc)), pa.array(place), pa.array([w for ws in words for w in ws]), pa.array(names, pa.string()), pa.array(posterior.max(1))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "word", "lang", "probability"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, place long, word string, lang string, probability double")
