"""Language ID of code-switched text by a linear-chain conditional random field over words.

A word's label scores come from its letters: hashed 2- and 3-grams (with its borders), 3-letter
affixes, and lexicons of words that one language has nearly alone. Label transitions are learned too.
Forward-backward over all words of a text gives each word's label probabilities; a document gets the
label of the largest sum. Words are runs of letters, in lower case.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulselake.llm.common import claim, columns, record_batch, slices, trim, utf8, write_table

#: Label of texts without letters.
UNKNOWN = "und"

#: Bounds of the sample a model is fitted on: distinct texts of each language, characters of a text
#: (longer ones are taken only where a language has no others), and characters of all texts.
SAMPLE_TEXTS, SAMPLE_CHARS, TOTAL_CHARS = 160, 20_000, 8_000_000

#: Hashed letter features (a power of two).
BUCKETS = 1 << 17

#: A word tells at most so much against a label (in logarithms).
LEAST_EVIDENCE = -25.0

_POWER = np.uint64(0x9E3779B97F4A7C15)
_NONE: dict = {}
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _bucket(kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), kind, np.uint64)
    for p in parts:
        h = (h + p) * _POWER
        h ^= h >> np.uint64(29)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int32)


@dataclass
class Words:
    """Words of some texts: word i has the letters from ``first[i]`` on; ``grams`` are two features of
    each letter, ``affixes`` two of each word (or -1), ``hashes`` are those of whole words."""

    first: np.ndarray
    n_letters: int
    grams: np.ndarray
    affixes: np.ndarray
    hashes: np.ndarray
    text_of: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.append(self.first[1:], self.n_letters)


def words_of(texts: list[str]) -> Words:
    low = [t.lower() for t in texts]
    joined = "\0\0\0" + "\0\0\0".join(low) + "\0\0\0"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    letter = _letters()[c.astype(np.int64)]
    c[~letter] = 0
    at = np.flatnonzero(letter)
    starts = letter[at - 1] == 0 if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(starts)
    last = at[np.append(first[1:], len(at)) - 1] if len(first) else at[:0]
    begin = at[first]
    grams = np.stack([_bucket(1, c[at - 1], c[at]), _bucket(2, c[at - 1], c[at], c[at + 1])], 1)
    long = last - begin >= 2
    head, tail = _bucket(3, c[begin], c[begin + 1], c[np.minimum(begin + 2, len(c) - 1)]), _bucket(4, c[last - 2], c[last - 1], c[last])
    affixes = np.where(long[:, None], np.stack([head, tail], 1), -1)
    place = np.arange(len(at)) - first[np.cumsum(starts) - 1] if len(at) else at
    powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, _POWER))
    hashes = np.add.reduceat((c[at] + np.uint64(1)) * powers[place], first) if len(first) else np.zeros(0, np.uint64)
    text_starts = 3 + np.concatenate([[0], np.cumsum([len(t) + 3 for t in low])]).astype(np.int64)
    return Words(first, len(at), grams, affixes, hashes, np.searchsorted(text_starts, begin, "right") - 1)


@dataclass
class Model:
    """Weights of a fitted field; ``lexicon`` are sorted word hashes and ``entry`` their languages."""

    languages: list[str]
    gram: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    in_lexicon: np.ndarray
    lexicon: np.ndarray
    entry: np.ndarray

    def entries(self, w: Words) -> np.ndarray:
        """Lexicon language of each word, -1: none."""
        if not len(self.lexicon):
            return np.full(len(w.first), -1)
        i = np.minimum(np.searchsorted(self.lexicon, w.hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[i] == w.hashes, self.entry[i], -1)

    def scores(self, w: Words) -> np.ndarray:
        """(words, languages): score of each label."""
        n = len(w.first)
        if not n:
            return np.zeros((0, len(self.languages)))
        each = self.gram[w.grams[:, 0]] + self.gram[w.grams[:, 1]]
        out = np.add.reduceat(each, w.first, axis=0).astype(np.float64)
        for k in range(2):
            have = w.affixes[:, k] >= 0
            out[have] += self.gram[w.affixes[have, k]]
        entry = self.entries(w)
        out[entry >= 0] += self.in_lexicon[entry[entry >= 0]]
        return out


def marginals(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of each word by forward-backward, for chains of ``lengths`` words that lie
    one after another in ``scores``.

    Chains are handled side by side, the longest first: step t takes the t-th words of all chains
    that have one.
    """
    n, k = scores.shape
    order = np.argsort(-lengths, kind="stable")
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    longest = int(lengths.max(initial=0))
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), "right")
    at = np.concatenate([[0], np.cumsum(active)])
    place = np.empty(n, np.int64)  # by step, then chain: the word
    for t in range(longest):
        place[at[t] : at[t + 1]] = begin[: active[t]] + t
    e = np.exp(np.maximum(scores - scores.max(1, keepdims=True), LEAST_EVIDENCE))[place]
    step, out = np.exp(transition - transition.max()), np.empty((n, k))
    a = e[: at[1]] * np.exp(start - start.max()) if longest else e
    for t in range(longest):
        if t:
            a = (a[: active[t]] @ step) * e[at[t] : at[t + 1]]
        if t % 8 == 7:  # in between, nothing can underflow
            a /= a.sum(1, keepdims=True)
        out[at[t] : at[t + 1]] = a
    back = step.T.copy()
    b = np.ones((active[0] if longest else 0, k))
    for t in range(longest - 1, -1, -1):
        if t + 1 < longest:
            m = active[t + 1]
            x = (e[at[t + 1] : at[t + 2]] * b[:m]) @ back
            b[:m] = x / x.sum(1, keepdims=True) if t % 8 == 7 else x
        out[at[t] : at[t + 1]] *= b[: active[t]]
    result = np.empty_like(out)
    result[place] = out / out.sum(1, keepdims=True)
    return result


def fit(texts: list[str], languages: list[str], epochs: int = 6, chain: int = 40, seed: int = 7) -> Model:
    """Fits a field on texts of known language.

    Chains mix: texts are cut into spans of 3 to 24 words, and half of the spans are shuffled over
    all texts, so that chains switch language as code-switched text does.
    """
    names = sorted(set(languages))
    k = len(names)
    w = words_of(texts)
    label = np.array([names.index(x) for x in languages], np.int64)[w.text_of] if len(w.first) else np.zeros(0, np.int64)
    lexicon, entry = _lexicon(w, label, k)
    model = Model(names, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(k), np.zeros((k, k)), lexicon, entry)
    if k < 2 or len(w.first) < chain:
        return model
    rng = np.random.default_rng(seed)
    in_lexicon = model.entries(w)
    ends = w.ends
    squares = [np.full(x.shape, 1e-3) for x in (model.gram, model.transition, model.start, model.in_lexicon)]
    for _ in range(epochs):
        order = _mixed(w.text_of, rng)
        chains = order[: len(order) // chain * chain].reshape(-1, chain)
        for part in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // 256)):
            tokens = chains[part].ravel()
            gram_at = _ranges(w.first[tokens], ends[tokens])
            sizes = ends[tokens] - w.first[tokens]
            own = Words(np.concatenate([[0], np.cumsum(sizes)[:-1]]), len(gram_at), w.grams[gram_at], w.affixes[tokens], w.hashes[tokens], w.text_of[tokens])
            p, pairs = _expected(model.scores(own).reshape(len(part), chain, k), model)
            y = label[tokens]
            g = -p.reshape(-1, k)
            g[np.arange(len(y)), y] += 1
            seen = np.zeros((k, k))
            ys = y.reshape(len(part), chain)
            np.add.at(seen, (ys[:, :-1].ravel(), ys[:, 1:].ravel()), 1)
            first = np.bincount(ys[:, 0], minlength=k) - p[:, 0].sum(0)
            lex = np.zeros((k, k))
            hit = in_lexicon[tokens] >= 0
            np.add.at(lex, in_lexicon[tokens][hit], g[hit])
            letters = np.repeat(g, sizes, axis=0)
            where = np.concatenate([own.grams[:, 0], own.grams[:, 1], *(own.affixes[own.affixes[:, j] >= 0, j] for j in range(2))])
            what = np.concatenate([letters, letters, *(g[own.affixes[:, j] >= 0] for j in range(2))])
            gram = np.stack([np.bincount(where, what[:, j], BUCKETS) for j in range(k)], 1)
            n = len(tokens)
            for x, s, d, decay in zip((model.gram, model.transition, model.start, model.in_lexicon), squares, (gram, seen - pairs, first, lex), (1e-5, 1e-4, 1e-4, 1e-4), strict=True):
                d = d / n - decay * x
                s += d * d
                x += (0.2 * d / np.sqrt(s)).astype(x.dtype)
    return model


def _lexicon(w: Words, label: np.ndarray, k: int, least: int = 5, share: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Words seen ``least`` times or more of which one language has the ``share`` or more."""
    words, at = np.unique(w.hashes, return_inverse=True)
    counts = np.bincount(at * k + label, minlength=len(words) * k).reshape(-1, k) if k else np.zeros((0, 1))
    keep = (counts.sum(1) >= least) & (counts.max(1, initial=0) >= share * counts.sum(1))
    return words[keep], counts[keep].argmax(1) if keep.any() else np.zeros(0, np.int64)


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = b - a
    return np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _mixed(text_of: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    cuts = np.cumsum(rng.integers(3, 25, size=len(text_of) // 3 + 1))
    spans = np.split(np.arange(len(text_of)), cuts[cuts < len(text_of)])
    move = np.flatnonzero(rng.random(len(spans)) < 0.5)
    to = rng.permutation(move)
    mixed = list(spans)
    for i, j in zip(move, to, strict=True):
        mixed[i] = spans[j]
    return np.concatenate(mixed)


def _expected(scores: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (chains, words, labels) and expected transitions of chains of one length."""
    n, length, k = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    step, start = np.exp(model.transition - model.transition.max()), np.exp(model.start - model.start.max())
    a = np.empty_like(e)
    for t in range(length):
        x = e[:, t] * start if t == 0 else (a[:, t - 1] @ step) * e[:, t]
        a[:, t] = x / x.sum(1, keepdims=True)
    b = np.ones((n, k))
    p, pairs = np.empty_like(e), np.zeros((k, k))
    for t in range(length - 1, -1, -1):
        x = a[:, t] * b
        p[:, t] = x / x.sum(1, keepdims=True)
        if t:
            y = e[:, t] * b
            z = ((a[:, t - 1] @ step) * y).sum(1, keepdims=True)
            pairs += (a[:, t - 1] / z).T @ y * step
            b = y @ step.T
            b /= b.sum(1, keepdims=True)
    return p, pairs


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, by 5 without remainder."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> Model:
    """A model from text and lang of documents that aren't held out, with every language among them.

    The sample of labelled rows is bounded: of each language the ``sample_texts`` distinct texts with
    the smallest hashes, those of at most ``sample_chars`` characters before longer ones. Where these
    have more than ``total_chars`` characters together, each language takes as many of its own as fit
    its even share, one at least. Rows with a null text or lang teach nothing.
    """
    usable = docs.where(~held_out()).select("lang", F.xxhash64("text").alias("h"), "text").where("lang is not null and text is not null")
    size = F.length("text")
    distinct = usable.select("lang", "h", (size > sample_chars).cast("int").alias("long"), size.cast("long").alias("size")).distinct()
    parts = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("long", "h")  # a language of most rows is ranked by many tasks
    ranked = distinct.withColumn("n", F.row_number().over(parts)).where(F.col("n") <= sample_texts).drop("n")
    order = Window.partitionBy("lang").orderBy("long", "h")
    ranked = ranked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_texts)
    ranked = ranked.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("long") == 0) | (F.col("n") == 1))
    chosen, _ = write_table(ranked.select("lang", "h", "n", "upto"), "language-sample")
    languages = chosen.select("lang").distinct().count()
    if not languages:
        return fit([], [])
    chosen = chosen.where((F.col("n") == 1) | (F.col("upto") <= total_chars // languages)).select("lang", "h")
    rows = usable.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.max("text").alias("text")).collect()  # bounded as above
    rows.sort(key=lambda r: (r["lang"], r["h"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score (mean probability of that language over the words), n_words and spans
    (lang, start, n_words: runs of words of the same most probable language) to doc_id and text_hash.

    Null texts and texts without letters: ``und``, score 0, no spans. A model that learned no language
    gives that too. Ties go to the first language by name. Repeated rows each give a row; other columns are ignored; an empty table gives no
    rows. One pass without a shuffle; long texts are handled whole.
    """
    src = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), utf8().alias("text"))
    span = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("n_words", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_NONE)
        for batch in slices(batches, "text", 3 << 20):
            found = label_texts([t.decode("utf-8", "replace") for t in columns(batch, "text")[0]], model)
            schema = pa.schema([batch.schema.field(0), batch.schema.field(1), pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("n_words", pa.int64()), pa.field("spans", pa.list_(span))])
            yield record_batch(schema, [batch.column(0), batch.column(1), *found])
        trim()

    ddl = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash long, lang_pred string, score double, n_words long, spans array<struct<lang:string,start:long,n_words:long>>"
    return src.mapInArrow(run, ddl)


def _pieces(texts: list, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts (or of their bytes) of about ``size`` together."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size or i == len(texts) - 1:
            yield start, i + 1
            start, total = i + 1, 0


def label_texts(texts: list[str], model: Model) -> tuple[list[str], list[float], list[int], list[list[dict]]]:
    """(language, score, words, spans) of each text."""
    n, names = len(texts), model.languages
    scores, text_of = [], []
    for a, b in _pieces(texts):  # letters take much more memory than scores
        w = words_of(texts[a:b])
        scores.append(model.scores(w))
        text_of.append(w.text_of + a)
    text_of = np.concatenate([np.zeros(0, np.int64), *text_of])
    lengths = np.bincount(text_of, minlength=n).astype(np.int64)
    if not names or not len(text_of):
        return [UNKNOWN] * n, [0.0] * n, lengths.tolist(), [[] for _ in range(n)]
    p = marginals(np.concatenate(scores), lengths, model.transition, model.start)
    sums = np.stack([np.bincount(text_of, p[:, j], n) for j in range(len(names))], 1)
    best = sums.argmax(1)
    score = np.clip(sums[np.arange(n), best] / np.maximum(lengths, 1), 0.0, 1.0)
    word_label = p.argmax(1)
    turns = np.flatnonzero(np.concatenate([[True], (text_of[1:] != text_of[:-1]) | (word_label[1:] != word_label[:-1])]))
    sizes = np.diff(np.append(turns, len(word_label)))
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    spans: list[list[dict]] = [[] for _ in range(n)]
    for t, size in zip(turns.tolist(), sizes.tolist(), strict=True):
        d = int(text_of[t])
        spans[d].append({"lang": names[word_label[t]], "start": t - int(begin[d]), "n_words": size})
    some = lengths > 0
    return [names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0).tolist(), lengths.tolist(), spans


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learns from the documents that aren't held out and predicts all: see ``train``, ``identify``.
    Inputs of a prediction are texts alone."""
    return identify(docs, train(docs)).withColumn("held_out", held_out())


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """Documents, with all their columns, whose language is told with a score of ``least`` or more:
    texts without letters go, and those of which no language has that share of the words. Where no
    document has a language to learn, only those without letters go. Null and empty texts go; very long
    ones are read whole; repeated rows are told each; columns of any other name stay as they are; an empty
    table gives no rows."""
    model = train(docs)

    @F.arrow_udf("boolean")
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim(_NONE)
        for batch in batches:
            texts, out = batch.to_pylist(), []
            for a, b in _pieces(texts, 1 << 20):
                names, scores, *_ = label_texts([t.decode("utf-8", "replace") for t in texts[a:b]], model)
                out += [name != UNKNOWN and s >= least for name, s in zip(names, scores, strict=True)]
            yield pa.array(out, pa.bool_())
        trim()

    return docs.where(identified(utf8()) if model.languages else F.col("text").rlike(r"\p{L}"))
