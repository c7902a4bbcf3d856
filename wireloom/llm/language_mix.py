"""Language identification as inference of a mixture.

Each language is a distribution over byte n-grams (with the blanks between words), counted over all its texts. A text is a
mixture of languages word by word: expectation-maximisation estimates its proportions from the words' n-gram
likelihoods. Starting from all languages, the one of the least proportion is dropped for as long as the likelihood
minus a penalty for each language left rises; the proportions of the best set are the answer.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing could be
learned. Texts with a null language, or a null key, teach nothing. Ties go to the language that sorts first. Repeated
rows count each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, U64, extend, flat, joined_words, prepare, slices

#: Bins that n-grams fall into, and the most cells of the model: many languages share fewer bins.
BINS, MOST_CELLS = 1 << 15, 1 << 24
ORDER = 4
ROUNDS = 8
#: What each further language must add to the log-likelihood, in units of log(words) / 2.
PENALTY = 4.0
UNKNOWN = "und"


def bins_for(languages: int) -> int:
    """A power of two, at least 256, so that the model stays within ``MOST_CELLS`` as far as that goes."""
    most = max(256, MOST_CELLS // max(languages, 1))
    return min(BINS, 1 << (most.bit_length() - 1))


def gram_bins(data: np.ndarray, offsets: np.ndarray, n_bins: int = BINS):
    """The bin of the n-gram at each byte of the joined words; starts of words; first words; each text's bytes."""
    buffer, places, firsts = joined_words(data, offsets)
    padded = np.append(buffer, np.zeros(8, np.uint8))
    packed = np.ndarray((len(buffer),), "<u8", buffer=padded, strides=(1,)) & U64((1 << (8 * ORDER)) - 1)
    bins = (packed * U64(0x9E3779B97F4A7C15) >> U64(64 - n_bins.bit_length() + 1)).astype(np.int32)
    zeros = np.flatnonzero(buffer == 0)  # no word has a zero byte, so each one begins a text
    return bins, places, firsts, np.diff(np.append(zeros, len(buffer)))


def count_grams(docs: DataFrame, text: str, lang: str, n_bins: int) -> DataFrame:
    """lang, bin, n over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in slices(batches, text):
            bins, _, _, sizes = gram_bins(*flat(part.column(text)), n_bins)
            coded = part.column(lang).dictionary_encode()
            names, row = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            cells, counts = np.unique(np.repeat(row, sizes).astype(np.int64) * n_bins + bins, return_counts=True)
            for k, name in enumerate(names):
                own = slice(*np.searchsorted(cells, [k * n_bins, (k + 1) * n_bins]))
                held = totals.setdefault(name, np.zeros(n_bins, np.int64))
                held[cells[own] - k * n_bins] += counts[own]
        for name, held in totals.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(held[at])], names=["lang", "bin", "n"]
            )

    counted = docs.select(text, lang).mapInArrow(run, "lang string, bin int, n long")
    return counted.groupBy("lang", "bin").agg(F.sum("n").alias("n"))


class LanguageModel:
    def __init__(self, langs: list[str], logs: np.ndarray):
        self.langs, self.logs = langs, logs  # logs: languages x bins

    def mixtures(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Proportions of each text (languages x texts); zero for languages left out, and for texts without words."""
        bins, places, firsts, _ = gram_bins(data, offsets, self.logs.shape[1])
        words = np.diff(firsts)
        full = np.flatnonzero(words)
        out = np.zeros((len(self.langs), len(words)))
        if not len(full):
            return out
        scores = np.stack([np.add.reduceat(logs[bins], places - 1) for logs in self.logs])
        top = scores.max(axis=0)
        likely = np.exp(np.maximum(scores - top, -60.0))
        out[:, full] = choose(likely, words[full])
        return out


def settle(likely: np.ndarray, words: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions after some rounds of expectation-maximisation, each text's log-likelihood, and by how much at most the
    best proportions would exceed it: the likelihood is concave in them, so its slope bounds what is left to gain."""
    begins = np.cumsum(words) - words
    for _ in range(ROUNDS):
        joint = likely * np.repeat(shares, words, axis=1)
        joint /= joint.sum(axis=0)
        shares = np.add.reduceat(joint, begins, axis=1) / words
    total = np.maximum((likely * np.repeat(shares, words, axis=1)).sum(axis=0), 1e-30)
    slope = np.add.reduceat(likely / total, begins, axis=1).max(axis=0) - words
    return shares, np.add.reduceat(np.log(total).astype(float), begins), np.maximum(slope, 0).astype(float)


def choose(likely: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Proportions in the best set of languages of each text; ``likely`` is languages x words of all texts."""
    n = len(likely)
    price = PENALTY * 0.5 * np.log(words + 1.0)
    start = np.full((n, len(words)), 1.0 / n, likely.dtype)
    shares, fit, more = settle(likely, words, start)
    begins, top = np.cumsum(words) - words, shares.argmax(axis=0)
    alone = np.log(np.maximum(likely[np.repeat(top, words), np.arange(likely.shape[1])], 1e-30)).astype(float)
    alone = np.add.reduceat(alone, begins) - price
    best = np.zeros(shares.shape)
    best[top, np.arange(len(words))] = 1.0
    # no set of two or more can be worth more than the best fit of all languages less the price of two
    mixed = np.flatnonzero(alone < fit + more - 2 * price)
    if not len(mixed) or n == 1:
        return best
    keep = np.zeros(len(words), bool)
    keep[mixed] = True
    likely, words, price = likely[:, np.repeat(keep, words)], words[mixed], price[mixed]
    shares, rows = shares[:, mixed], np.arange(len(mixed))
    found, found_worth = shares.astype(float), fit[mixed] - price * n
    for left in range(n - 1, 0, -1):
        least = np.where(shares > 0, shares, np.inf).argmin(axis=0)
        shares = np.where(shares > 0, np.maximum(shares, 1e-6), 0).astype(likely.dtype)
        shares[least, rows] = 0
        shares /= shares.sum(axis=0)
        shares, fit, _ = settle(np.maximum(likely, 1e-26), words, shares)
        better = fit - price * left > found_worth
        found = np.where(better, shares, found)
        found_worth = np.maximum(fit - price * left, found_worth)
    best[:, mixed] = found
    return best


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model of all texts that have a language; add-half smoothing over the bins."""
    prepare(docs.sparkSession)
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    n_bins = bins_for(known.agg(F.count_distinct(lang).alias("n")).first()["n"])
    table = count_grams(known, text, lang, n_bins).toArrow()  # at most MOST_CELLS rows, or 256 for each language
    langs = sorted(set(table.column("lang").unique().to_pylist()))
    held = np.full((len(langs), n_bins), 0.5)
    totals = np.zeros(len(langs))
    if table.num_rows:
        coded = table.column("lang").combine_chunks().dictionary_encode()
        place = np.array([langs.index(x) for x in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
        n = table.column("n").to_numpy()
        held[place, table.column("bin").to_numpy()] += n
        totals = np.bincount(place, n, len(langs))
    return LanguageModel(langs, np.log(held / (totals + 0.5 * n_bins)[:, None]).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, lang_pred, score and languages (each of the text's set with its proportion, largest first).

    Columns of ``keep`` with the name of one of these are replaced.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score", "languages")]
    held = prepare(docs.sparkSession).sparkContext.broadcast(model)
    chunk = max(CHUNK * 4 // max(len(model.langs), 4), 1 << 14)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part in slices(batches, text, chunk):
            lettered = [bool(t) and any(map(str.isalpha, t)) for t in part.column(text).to_pylist()]
            preds, scores, mixes = [], [], []
            if model.langs:
                shares = model.mixtures(*flat(part.column(text)))
            for i, has in enumerate(lettered):
                if not has or not model.langs:
                    preds.append(UNKNOWN), scores.append(0.0), mixes.append([])
                    continue
                order = np.argsort(-shares[:, i], kind="stable")
                preds.append(model.langs[order[0]])
                scores.append(min(1.0, float(shares[order[0], i])))
                mixes.append([{"lang": model.langs[k], "share": float(shares[k, i])} for k in order.tolist() if shares[k, i] > 0])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, kind)],
                names=[*keep, "lang_pred", "score", "languages"],
            )

    schema = extend(docs, keep, "lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
