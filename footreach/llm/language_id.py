"""Language ID by interpolated Kneser-Ney character models.

One model of `order` per language over lower-cased words (runs of letters) with a boundary mark on both sides.
Grams are 64-bit hashes; each order of each language is a pair of arrays sorted by hash: the interpolated log2
probability of each gram, and the back-off weight of each context. The language with the lowest cross-entropy
per character wins; ties go to the name that sorts first.

A letter is a character of the Unicode categories L; a word may also hold numbers that are no decimal digits.

Training. Rows with a language and a text are labelled rows. A value of `lang` is a language if at least
`LEAST_ROWS` of them carry it, or as many as the commonest value if that has fewer, however large the corpus; there is no
other bound on the number of languages, and the models grow with it. The models learn from a bounded sample, at most about `sample_docs` whole documents a language, chosen by a
hash of the id; gram counts are summed by Spark and their number is bounded by the sample. A tenth of the sample is held back for calibration: it fixes the
slope that turns the lead of the best language over the second into a score, and, for each length class, a limit
of cross-entropy: half way between what texts reach in their own language and what they reach when it is left out.

Prediction is one pass over the documents without a shuffle. Words repeat, so each task keeps the scores of
words it has seen (bounded; it only saves time), and scores new ones together with numpy.

Defined cases: null text, or a text without letters, is `und` with score 0 and is rejected. A text whose
cross-entropy is above its length class's limit is rejected but still gets its best language. Without labelled
rows everything is `und`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footreach.llm.common import held, mix, scratch, slices, text_function

WORD = re.compile(r"[^\W\d_]+")
ORDER = 5
MARK = 2  # stands before and after a word; no letter has this code
NEW = ("lang_pred", "score", "entropy", "rejected")
LEAST_ROWS = 3  # labelled rows that make a language


def words_of(text: str | None) -> Counter:
    found = Counter(WORD.findall((text or "").lower()))
    for word in [w for w in found if not w.isalpha() and not any(map(str.isalpha, w))]:  # such as "½²"
        del found[word]
    return found


def gram_hashes(words: list[str], order: int = ORDER) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each predicted character of the padded words: hashes of its gram and its context by length; word index.

    grams[n - 1] covers the last n characters up to the predicted one, contexts[n - 1] the n - 1 before it. Grams
    that would reach beyond the front padding are those of order - 1 marks, so all lengths are full.
    """
    pad = chr(MARK) * (order - 1)
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    codes = np.frombuffer((pad + (chr(MARK) + pad).join(words) + chr(MARK)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) if words else np.zeros(0, np.uint64)
    which = np.repeat(np.arange(len(words)), lengths)
    starts = np.concatenate(([0], np.cumsum(lengths + order - 1)))[:-1] + order - 1
    at = np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    grams, contexts = [], []
    with np.errstate(over="ignore"):
        context = np.zeros(len(at), np.uint64)
        for n in range(1, order + 1):
            contexts.append(mix(context + np.uint64(n)))
            # the gram is its context with the predicted character
            grams.append(mix(contexts[-1] * np.uint64(0x9E3779B97F4A7C15) + codes[at]))
            if n < order:
                context = context * np.uint64(0x100000001B3) + codes[at - n] + np.uint64(1)
    return grams, contexts, which


class Language:
    """Sorted hash arrays of one language."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], alphabet: int):
        """counts[n - 1]: gram hash, context hash, hash of the gram without its first character, count; of length n."""
        order = len(counts)
        self.base = 1.0 / alphabet
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        below = None
        for n in range(1, order + 1):
            gram, context, shorter, count = counts[n - 1]
            if n < order:  # lower orders count the different characters that stand before a gram
                _, _, longer_shorter, _ = counts[n]
                seen, types = np.unique(longer_shorter, return_counts=True)
                at = np.minimum(np.searchsorted(seen, gram), len(seen) - 1)
                count = np.where(seen[at] == gram, types[at], 1)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
            names, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, weights=count)
            kinds = np.bincount(inverse)
            weight = discount * kinds / total
            lower = np.full(len(gram), self.base) if below is None else below(shorter)
            p = np.maximum(count - discount, 0) / total[inverse] + weight[inverse] * lower
            by = np.argsort(gram)
            self.tables.append((gram[by], p[by].astype(np.float64), names, weight))

            def below(hashes, keys=gram[by], values=p[by]):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                return np.where(keys[at] == hashes, values[at], self.base)

    def log2(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(grams[0]), self.base)
        for (keys, values, names, weight), gram, context in zip(self.tables, grams, contexts, strict=True):
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(names, context), len(names) - 1)
            p = np.where(names[at] == context, weight[at], 1.0) * p
            at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            p = np.where(keys[at] == gram, values[at], p)
        return np.log2(p)


class Models:
    """All languages, the calibration, and the scores of words seen lately.

    For scoring, the languages' arrays are laid side by side: for each order one array of hashes, sorted, with a
    row of the languages' interpolated probabilities for each gram, and one with a row of back-off weights for each
    context. The longest gram that any language knows then needs one search for all of them.
    """

    CACHE = 60_000

    def __init__(self, languages: dict[str, Language]):
        self.names = sorted(languages)
        own = [languages[k] for k in self.names]
        self.base = np.log2([m.base for m in own])
        self.tables = []
        for n in range(len(own[0].tables)):
            weights = [(m.tables[n][2], m.tables[n][3]) for m in own]
            contexts = np.unique(np.concatenate([c for c, _ in weights]))
            rows = np.zeros((len(contexts), len(own)), np.float32)  # log2 of 1: a context a language has not seen
            for k, (names, weight) in enumerate(weights):
                rows[np.searchsorted(contexts, names), k] = np.log2(weight)
            self.tables.append([None, None, contexts, rows])
        self.slope, self.limits = 20.0, np.full(32, np.inf)
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(own)))

    def fill(self, grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]], languages: dict[str, Language]) -> None:
        """grams[n - 1]: gram, context and shorter-gram hashes of all languages' grams of length n, without repeats."""
        own = [languages[k] for k in self.names]
        below = None
        for n, (names, contexts, shorter) in enumerate(grams):
            by = np.argsort(names)
            names, contexts, shorter = names[by], contexts[by], shorter[by]
            lower = np.tile(self.base, (len(names), 1)) if below is None else below(shorter)
            rows = lower + self._rows(self.tables[n][2], self.tables[n][3], contexts)[0]
            for k, m in enumerate(own):
                keys, values = m.tables[n][:2]
                rows[np.searchsorted(names, keys), k] = np.log2(values)
            self.tables[n][0], self.tables[n][1] = names, rows.astype(np.float32)

            def below(hashes, names=names, rows=rows):
                found, hit = self._rows(names, rows, hashes)
                return np.where(hit[:, None], found, self.base)

    @staticmethod
    def _rows(keys: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the hashes among the keys (zeros where there is none), and which are there."""
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hit = keys[at] == hashes
        return np.where(hit[:, None], rows[at], 0), hit

    def __getstate__(self):
        return self.__dict__ | {"index": {}, "scores": self.scores[:0]}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Sum of log2 probabilities of each word's characters, by language."""
        grams, contexts, which = gram_hashes(words)
        out = np.zeros((len(which), len(self.names)), np.float32)
        left = np.arange(len(which))
        for n in range(len(self.tables) - 1, -1, -1):
            names, rows, known, weights = self.tables[n]
            found, hit = self._rows(names, rows, grams[n][left])
            out[left] += found
            left = left[~hit]
            if not len(left):
                break
            out[left] += self._rows(known, weights, contexts[n][left])[0]
        out[left] += self.base.astype(np.float32)
        ends = np.flatnonzero(np.append(which[1:] != which[:-1], True))
        return np.diff(np.cumsum(out, axis=0, dtype=np.float64)[ends], axis=0, prepend=0)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits a character of each text under each language, and the characters that count."""
        counts = [words_of(t) for t in texts]
        new = list(set().union(*counts) - self.index.keys())
        if len(self.index) + len(new) > self.CACHE:
            self.index, self.scores = {}, self.scores[:0]
            new = list(set().union(*counts))
        if new:
            self.index.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
            parts = [self.word_scores(new[i : i + 5_000]) for i in range(0, len(new), 5_000)]
            self.scores = np.concatenate([self.scores, *parts])
        rows, sizes = np.zeros((len(texts), len(self.names))), np.zeros(len(texts))
        for i, own in enumerate(counts):
            if own:
                at = np.fromiter(map(self.index.__getitem__, own), np.int64, len(own))
                times = np.fromiter(own.values(), np.float64, len(own))
                sizes[i] = times @ np.fromiter(map(len, own), np.float64, len(own)) + times.sum()
                rows[i] = -(times @ self.scores[at]) / sizes[i]
        return rows, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, lowest entropy and whether it is rejected, by text."""
        rows, sizes = self.entropies(texts)
        best = rows.argmin(axis=1)  # the first of equal ones: names are sorted
        low = rows.min(axis=1)
        with np.errstate(over="ignore"):
            share = 1 / np.exp2(-np.minimum(1000, self.slope * (rows - low[:, None]))).sum(axis=1)
        empty = sizes == 0
        rejected = empty | (low > self.limits[length_class(sizes)])
        names = ["und" if e else self.names[k] for e, k in zip(empty, best, strict=True)]
        return names, np.where(empty, 0.0, share), low, rejected


def length_class(sizes: np.ndarray) -> np.ndarray:
    return np.minimum(31, np.log2(np.maximum(1, sizes)).astype(np.int64))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is left out of all training: crc32 of the id as text, modulo 4, is 2. A null id never is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, sample_docs: int) -> DataFrame:
    """(lang, text, calibrates): about sample_docs labelled rows of each language, chosen by a hash of the id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = held(known.groupBy("lang").agg(F.count("*").alias("n")))
    most = counts.agg(F.max("n")).first()[0]
    sizes = {r[0]: r[1] for r in counts.where(F.col("n") >= min(most or 0, LEAST_ROWS)).collect()}
    counts.unpersist()
    if not sizes:
        return known.select("lang", "text", F.lit(False).alias("calibrates")).where("false")
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1_000_000)) / 1e6
    return known.where(F.col("lang").isin(*sizes) & (draw < share[F.col("lang")])).select("lang", "text", (F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id").cast("string")), F.lit(10)) == 0).alias("calibrates"))


def gram_counts(sample: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, n, gram, context, shorter, count) over the sample."""
    out = "lang string, n int, gram long, context long, shorter long, count long, char long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            by: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, Counter()).update(words_of(text))
            for lang, words in by.items():
                if not words:
                    continue
                grams, contexts, which = gram_hashes(list(words), order)
                times = np.fromiter(words.values(), np.int64, len(words))[which]
                chars = np.frombuffer((chr(MARK).join(words) + chr(MARK)).encode("utf-32-le", "surrogatepass"), np.uint32)
                for n in range(1, order + 1):
                    names, first, inverse = np.unique(grams[n - 1], return_index=True, return_inverse=True)
                    sums = np.bincount(inverse, weights=times).astype(np.int64)
                    shorter = grams[n - 2][first] if n > 1 else np.zeros(len(names), np.uint64)
                    columns = [names.view(np.int64), contexts[n - 1][first].view(np.int64), shorter.view(np.int64), sums, chars[first].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names)), pa.array(np.full(len(names), n, np.int32)), *map(pa.array, columns)], names=["lang", "n", "gram", "context", "shorter", "count", "char"])

    parts = sample.select("lang", "text").mapInArrow(rows, out)
    return parts.groupBy("lang", "n", "gram").agg(F.first("context").alias("context"), F.first("shorter").alias("shorter"), F.sum("count").alias("count"), F.first("char").alias("char"))


def train(docs: DataFrame, sample_docs: int = 600, quantile: float = 0.999) -> Models | None:
    """Models and calibration from labelled rows of docs that are not held out; None without any."""
    sample = held(training_sample(docs, sample_docs))
    counts = gram_counts(sample.where("not calibrates")).toPandas()  # bounded by the sample
    if counts.empty:
        return None
    alphabet = counts.loc[counts.n == 1, "char"].nunique() + 1
    languages = {}
    for lang, own in counts.groupby("lang"):
        parts = [own[own.n == n] for n in range(1, ORDER + 1)]
        languages[lang] = Language([(*(p[c].to_numpy().view(np.uint64) for c in ("gram", "context", "shorter")), p["count"].to_numpy()) for p in parts], alphabet)
    models = Models(languages)
    whole = [counts[counts.n == n].drop_duplicates("gram") for n in range(1, ORDER + 1)]
    models.fill([tuple(p[c].to_numpy().view(np.uint64) for c in ("gram", "context", "shorter")) for p in whole], languages)
    tests = sample.where("calibrates").select("lang", "text")
    sent = docs.sparkSession.sparkContext.broadcast(models)
    calibrate(models, [tuple(r) for r in scored(tests, sent).collect()], quantile)
    sent.destroy()
    sample.unpersist()
    return models


def scored(rows: DataFrame, sent) -> DataFrame:
    """(size, low, lead, right, out) of the calibration rows, scored by Spark: out is the lowest entropy without the row's language."""

    def score(batches):
        own = sent.value
        for batch in slices(batches, "text"):
            entropies, sizes = own.entropies(batch.column(1).to_pylist())
            order = np.sort(entropies, axis=1)
            lead = order[:, 1] - order[:, 0] if order.shape[1] > 1 else np.ones(len(order))
            langs = np.array(batch.column(0).to_pylist())
            right = np.array([own.names[k] for k in entropies.argmin(axis=1)]) == langs
            out = np.where(langs[:, None] == np.array(own.names)[None, :], np.inf, entropies).min(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(order[:, 0]), pa.array(lead), pa.array(right), pa.array(out)], names=["size", "low", "lead", "right", "out"])

    return rows.mapInArrow(score, "size double, low double, lead double, right boolean, out double")


def calibrate(models: Models, rows: list[tuple], quantile: float, least: int = 20) -> None:
    """Slope: the one under which the scores of the calibration rows are most likely. Limits, from the rows of a length
    class and the ones around it, `least` rows if there are as many: half way from a high quantile of the entropy to the
    low one of the same texts when their language is left out. Where the two overlap, or nothing can be left out, the
    high quantile and a tenth of its distance from the median."""
    rows = [r for r in rows if r[0] > 0]
    if not rows:
        return
    size, low, lead, right, out = (np.array(x) for x in zip(*rows, strict=True))
    slopes = np.exp2(np.arange(0, 9, 0.5))
    p = 1 / (1 + np.exp2(-np.minimum(60, slopes[:, None] * lead)))
    models.slope = float(slopes[np.where(right, np.log(p), np.log(np.maximum(1e-9, 1 - p))).mean(axis=1).argmax()])
    classes = length_class(size)
    for k in range(32):
        near = np.abs(classes - k)
        own = near <= max(1, near.min(), np.sort(near)[min(least, len(near)) - 1])
        top, foreign = np.quantile(low[own], quantile), np.quantile(out[own], 1 - quantile)
        models.limits[k] = (top + foreign) / 2 if top < foreign < np.inf else top + (top - np.median(low[own])) / 10


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """docs with held_out, lang_pred, score (0 to 1), entropy (bits a character) and rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the training sample

    def make():
        own = sent.value

        def each(texts: list[str | None]) -> pa.Array:
            n = len(texts)
            names, score, low, rejected = own.predict(texts) if own is not None else (["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool))
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], list(NEW))

        return each

    found = scratch(docs, "found")
    judged = docs.withColumn(found, text_function(make, "struct<lang_pred: string, score: double, entropy: double, rejected: boolean>")(F.col("text").cast("string")))
    own = [c for c in docs.columns if c not in ("held_out", *NEW)]
    return judged.select(*own, held_out().alias("held_out"), *(F.col(f"{found}.{c}").alias(c) for c in NEW))
