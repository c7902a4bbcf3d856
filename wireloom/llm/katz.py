"""An n-gram language model with Katz backoff over words, of order ``ORDER`` unless told otherwise.

Counts of words and of word sequences over all training texts are discounted by Good-Turing estimates for counts up to
``K``, order by order; the mass this frees goes to what was not seen: for words to one unknown word, for a history to
the words that never followed it, in proportion to their score after the shorter history, so that each distribution sums
to one. A token is scored by its longest history if the sequence was seen, else by that history's backoff weight times
the score after the shorter one, and so on down to the single word. Sequences of all histories are counted, however
rare; only a history that was never learned backs off wholly (weight one). A history does not reach over the start of
a text.

Texts are packed in batches (see ``batches``), as distinct words and numbers of these. Each batch asks for the counts of its distinct words, then of its
distinct sequences, a round for each order; buckets add up what all batches hold, keep the counts as tables, and
answer. A table's row has the form of a question, so ``KatzModel.score`` lets the tables ask along with the batches of
any other documents, and those are scored without training. Sequences of a frequent history are dealt over several
buckets and their sums added up.

Defined cases: null counts as the empty text, whose only token is the end. Rows that may not be learned from, such as
those of null key, are scored all the same. If nothing was learned, every token is the unknown word, of probability
one. Repeated rows count each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.session import store

from . import batches
from .batches import pack_array, unpack_array
from .common import BLANK, U64, distinct, flat, grouped, mix, prepare, word_hashes

#: Counts above this are not discounted.
K = 5
#: Words of the longest sequence that is counted.
ORDER = 3
#: Histories of more than a bucket's share of tokens are split; no more shares than this are told apart.
MOST_SHARES = 25_000
END = U64(0x454E44454E44454E)  # stands for the end of a text among word hashes
START = U64(1 << 62)  # the number of a first token's history


def discounts(n: list[int]) -> np.ndarray:
    """d[r], the share of a count r that is kept; ``n`` are how many have count 1, 2, ... K + 1."""
    d = np.ones(K + 1)
    if min(n[: K + 1]) > 0:
        common = (K + 1) * n[K] / n[0]
        if common < 1:
            for r in range(1, K + 1):
                d[r] = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
    r = np.arange(1, K + 1)
    if not ((d[1:] > 0) & (d[1:] < 1)).all():  # too few counts for the estimate: take a constant off
        off = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        d[1:] = (r - off) / r
    return d


def kept(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts after discounting."""
    return np.where(count <= K, d[np.minimum(count, K)], 1.0) * count


@dataclass
class Words:
    """The distribution of single words, by count."""

    tokens: int
    types: int
    counts: list[int]

    def __post_init__(self):
        self.d = discounts(self.counts)
        self.missing, self.scale = 1.0, 0.0
        if self.tokens:
            freed = sum((1 - self.d[r]) * r * self.counts[r - 1] for r in range(1, K + 1)) / self.tokens
            self.missing = max(freed, 0.5 / (self.tokens + 0.5 * (self.types + 1)))
            self.scale = (1 - self.missing) / (1 - freed)

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.scale * kept(count, self.d) / max(self.tokens, 1), self.missing)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def backoff(seen: np.ndarray, total: np.ndarray, covered: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor of seen shares, and weight of the rest, for histories: ``seen`` are their sequences of count 1..K, a row each."""
    total = np.maximum(total, 1).astype(float)
    freed = sum((1 - d[r]) * r * seen[r - 1] for r in range(1, K + 1)) / total
    missing = np.maximum(freed, 1 / (total + 1))
    return (1 - missing) / (1 - freed), missing / np.maximum(1 - covered, 1e-12)


def encode(key: str, text: str):
    def run(held: list[pa.RecordBatch]) -> bytes:
        """A batch without its texts: its rows, the hashes of its words, frequent ones first, and each token's word."""
        tokens, sizes = [], []
        for part in held:
            hashes, firsts = word_hashes(*flat(part.column(text)), BLANK)
            tokens.append(np.insert(hashes, firsts[1:], END))
            sizes.append(np.diff(firsts) + 1)
        coded = pa.array(np.concatenate(tokens)).dictionary_encode()
        words, word = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        order = np.argsort(-np.bincount(word), kind="stable")
        place = np.empty(len(order), "<u4")
        place[order] = np.arange(len(order))
        rows = pa.Table.from_batches(held).select([key, "held_out", "train"]).append_column("n_tokens", pa.array(np.concatenate(sizes)))
        parts = [batches.whole(rows.to_batches()), pack_array(words[order].astype("<u8")), pack_array(place[word])]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts)

    return run


class Batch:
    """The tokens of one packed batch."""

    def __init__(self, blob: bytes, key: str):
        parts, at = [], 0
        while at < len(blob):
            end = at + 8 + int.from_bytes(blob[at : at + 8], "little")
            parts.append(blob[at + 8 : end])
            at = end
        rows = pa.Table.from_batches(batches.unpack(parts[0]))
        self.keys, self.held = rows.column(key), rows.column("held_out")
        self.sizes, self.train = rows.column("n_tokens").to_numpy(), rows.column("train").to_numpy().astype(bool)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.words, self.word = unpack_array(parts[1], "<u8"), unpack_array(parts[2], "<u4")

    def learned(self) -> np.ndarray:
        """Which tokens training sees."""
        return np.repeat(self.train, self.sizes)

    def word_questions(self, n: int):
        return batches.by_bucket((self.words % U64(n)).astype(np.int64), n)

    def set_words(self, answers: list[dict], n: int) -> None:
        """Numbers and counts of the batch's words, from the buckets' answers."""
        order, present, _ = self.word_questions(n)
        answers = sorted(answers, key=lambda a: a["bucket"])
        assert [a["bucket"] for a in answers] == present.tolist()
        self.ids, self.count = np.zeros(len(self.words), U64), np.zeros(len(self.words), np.int64)
        local = [unpack_array(a["a"], "<u8") for a in answers]
        self.ids[order] = np.concatenate(local) * U64(n) + np.repeat(present, [len(x) for x in local]).astype(U64)
        self.count[order] = np.concatenate([unpack_array(a["b"], "<i8") for a in answers])
        self.ids, rise, _ = grouped(self.ids)  # words in order of their numbers
        place = np.empty(len(rise), np.int64)
        place[rise] = np.arange(len(rise))
        self.word, self.count = place[self.word], self.count[rise]


class Grams:
    """The sequences of one order in a batch: each token's history is one of ``numbers``, training saw it ``seen`` times.

    ``numbers`` tell histories apart, ``at`` is the place of each token's. ``asked`` are the tokens whose history was
    learned, ``lower`` are the counts of the tokens' sequences without their first word. A history's number holds the bucket
    that numbered it, and there its sequences go; those of a frequent history go to other buckets as well.
    """

    def __init__(self, batch: Batch, numbers: np.ndarray, seen: np.ndarray, at: np.ndarray, asked: np.ndarray, lower: np.ndarray, n: int, tokens: int):
        self.batch, self.n, self.lower, self.asked = batch, n, lower, np.flatnonzero(asked)
        mine = at[self.asked]
        used = np.zeros(len(numbers), bool)
        used[mine] = True
        used = np.flatnonzero(used)
        self.histories, rise, _ = grouped(numbers[used])
        used = used[rise]
        place = np.empty(len(numbers), np.int64)
        place[used] = np.arange(len(used))
        self.history = place[mine]
        known = lower[self.asked] > 0
        self.open = np.zeros(len(used), bool)  # a token here backs off, whatever the answers
        self.open[self.history[~known]] = True
        known = np.flatnonzero(known)
        #: Tokens in order of their sequences, and where each sequence begins among them.
        self.token = self.asked[known]
        bits = len(batch.ids).bit_length()
        pairs, order, self.begins = grouped(self.history[known].astype(U64) << U64(bits) | batch.word[self.token].astype(U64))
        self.token = self.token[order]
        self.gram = np.full(len(at), -1)
        self.gram[self.token] = np.repeat(np.arange(len(pairs)), np.diff(self.begins, append=len(order)))
        self.head, self.tail = (pairs >> U64(bits)).astype(np.int64), (pairs & U64((1 << bits) - 1)).astype(np.int64)
        self.seen = seen[used]
        shares = np.maximum(1, -(-self.seen * min(n, MOST_SHARES) * 4 // max(tokens, 1)))
        self.split = shares > 1
        del mine, place, known, order, pairs
        self.deal(shares)

    def deal(self, shares: np.ndarray) -> None:
        """Which bucket each sequence goes to: ``order`` are the sequences by bucket, ``heads`` the histories asked about there.

        A history that isn't split is asked about even if none of its sequences are. Inside a bucket histories rise, and
        sequences rise by history, then by last word; ``runs`` are how many follow each history there.
        """
        home = self.histories - self.histories // U64(self.n) * U64(self.n)
        of = np.bincount(self.head, minlength=len(self.histories))
        bucket = np.repeat(home, of)
        dealt = np.flatnonzero(np.repeat(self.split, of))
        share = mix(self.batch.ids[self.tail[dealt]] + U64(1)) % shares[self.head[dealt]].astype(U64)
        bucket[dealt] = (self.histories[self.head[dealt]] + mix(share)) % U64(self.n)
        self.order = grouped(bucket)[1]
        bits, whole = U64(len(self.histories).bit_length()), np.flatnonzero(~self.split)
        parts, _, begins = grouped(bucket[dealt] << bits | self.head[dealt].astype(U64))
        places, rise, _ = grouped(np.append(home[whole] << bits | whole.astype(U64), parts))
        self.runs = np.append(of[whole], np.diff(begins, append=len(dealt)))[rise]
        self.heads = (places & ((U64(1) << bits) - U64(1))).astype(np.int64)
        places >>= bits
        begins = np.flatnonzero(np.append(True, places[1:] != places[:-1])[: len(places)])
        self.buckets = places[begins].astype(np.int64)
        #: Bounds of the buckets among ``heads``, and among the sequences.
        self.bounds = np.append(begins, len(places))
        self.gram_bounds = np.append(0, np.cumsum(self.runs))[self.bounds]

    def questions(self, number: int) -> pa.RecordBatch:
        own, first = self.batch.learned()[self.token].astype(np.int64), self.token[self.begins]
        own, lower, tails = np.add.reduceat(own, self.begins)[self.order], self.lower[first][self.order], self.batch.ids[self.tail][self.order]
        histories, backs_off, split = self.histories[self.heads], self.open[self.heads], self.split[self.heads]
        rows = []
        for k, bucket in enumerate(self.buckets.tolist()):
            at, of = slice(*self.bounds[k : k + 2]), slice(*self.gram_bounds[k : k + 2])
            rows.append((number, bucket, *gram_columns(histories[at], backs_off[at], split[at], self.runs[at], tails[of], own[of], lower[of], self.n)))
        return questions(rows)

    def take(self, answers: list[dict]) -> None:
        """Counts and numbers of the sequences, and what the backoff of each history needs, from the buckets' answers.

        A history seen once has one sequence, of count one; what its sequences cover is told where a token backs off.
        """
        answers = sorted(answers, key=lambda a: a["bucket"])
        assert [a["bucket"] for a in answers] == self.buckets.tolist()
        self.count, self.number = np.zeros(len(self.head), np.int64), np.zeros(len(self.head), U64)
        if not answers:
            self.sums = np.zeros((K + 1, len(self.histories)))
            return
        self.count[self.order] = count = np.concatenate([unpack_array(a["a"], "<i8") for a in answers])
        if answers[0]["b"] is not None:
            self.sums, backs_off = np.zeros((K + 1, len(self.histories))), self.open.copy()
            backs_off[self.head[self.order[count == 0]]] = True  # all sequences of an unsplit history are here
            whole, once = self.heads[~self.split[self.heads]], self.seen == 1
            self.sums[0, whole[once[whole]]] = 1
            told = whole[~once[whole]]
            for r, of in enumerate(np.concatenate([unpack_array(a["b"], "<u8").reshape(K, -1) for a in answers], axis=1)):
                self.sums[r, told] = of
            self.sums[K, whole[backs_off[whole]]] = np.concatenate([unpack_few(a["c"]) for a in answers])
        if answers[0]["d"] is not None:
            numbers = [np.cumsum(unpack_array(a["d"], "<u8")) * U64(self.n) + U64(a["bucket"]) for a in answers]
            self.number[self.order] = np.concatenate(numbers)
        del self.token, self.begins, self.tail, self.lower, self.order, self.heads, self.runs  # were for asking

    def counts(self) -> np.ndarray:
        """How often training held the sequence that ends at each token."""
        return np.where(self.gram >= 0, np.append(self.count, 0)[self.gram], 0)

    def longer(self, n: int, tokens: int) -> Grams:
        """The sequences of one word more."""
        counts, asked, at = self.counts(), np.zeros(len(self.gram), bool), np.zeros(len(self.gram), np.int64)
        asked[1:] = counts[:-1] > 0
        asked[self.batch.begins] = False  # no history reaches over the start
        at[1:] = np.maximum(self.gram[:-1], 0)
        return Grams(self.batch, np.append(self.number, U64(0)), np.append(self.count, 0), at, asked, counts, n, tokens)


def pairs_of(batch: Batch, n: int, words: Words, texts: int) -> Grams:
    numbers, seen, at = np.append(batch.ids, START), np.append(batch.count, texts), np.empty(len(batch.word), np.int64)
    at[1:] = batch.word[:-1]
    at[batch.begins] = len(batch.ids)
    return Grams(batch, numbers, seen, at, (seen > 0)[at], batch.count[batch.word], n, words.tokens)


QUESTION = "batch long, bucket int, a binary, b binary, c binary, d binary"
ANSWER = QUESTION + ", s array<long>"
ANSWER_SCHEMA = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in "abcd"), ("s", pa.list_(pa.int64()))])
#: In place of a batch: a bucket's table of counts, which has the form of a question, and its shares of split histories.
TABLE, SHARES = -1, -2


def gram_columns(histories, backs_off, split, runs, tails, counts, lower, n: int) -> tuple[bytes, ...]:
    """Sequences as columns of a question: rising histories with two marks, and their runs of last words with both counts."""
    marks = backs_off.astype(U64) << U64(1) | split.astype(U64)
    high = histories // U64(n)  # numpy divides several times as fast as it takes remainders
    heads = np.concatenate([np.diff(high, prepend=U64(0)), histories - high * U64(n) << U64(2) | marks])
    numbers = np.concatenate([counts, lower]).astype("<u8")
    return pack_array(heads), pack_array(runs.astype("<u4")), pack_array(tails.astype("<u8")), pack_array(numbers)


def unpack_heads(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Histories of a question, as twice their number and one more if split, and which surely back off."""
    steps, rest = unpack_array(packed, "<u8").reshape(2, -1)
    return (np.cumsum(steps) * U64(n) + (rest >> U64(2))) << U64(1) | rest & U64(1), rest & U64(2) > 0


def pack_few(x: np.ndarray) -> bytes:
    """Numbers of which many are equal, as their distinct values and which of these each is."""
    coded = pa.array(x, pa.float64()).dictionary_encode()
    values, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    size = len(values).to_bytes(4, "little")
    return size + values.astype("<f8").tobytes() + pack_array(at.astype("<u4"))


def unpack_few(packed: bytes) -> np.ndarray:
    end = 4 + 8 * int.from_bytes(packed[:4], "little")
    return np.frombuffer(packed[4:end], "<f8")[unpack_array(packed[end:], "<u4")]


def counts_of_counts(total: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist()


def add_words(keep: bool):
    """``keep``: the table holds the words, not their sums alone."""

    def run(group: pa.Table) -> pa.Table:
        """One bucket: counts of its words over all batches; an answer for each batch, and the table."""
        asked = group.to_pylist()
        bucket = asked[0]["bucket"]
        words = [unpack_array(q["a"], "<u8") for q in asked]
        counts = np.concatenate([unpack_array(q["b"], "<u8") for q in asked])
        found, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, counts, len(found)).astype(np.int64)
        seen = total > 0
        number = np.empty(len(found), np.int64)  # frequent words get low ones, which take less room
        number[np.argsort(-total, kind="stable")] = np.arange(len(found))
        rows, done = [], 0
        for q, mine in zip(asked, words):
            local = at[done : done + len(mine)]
            done += len(mine)
            if q["batch"] != TABLE:
                rows.append({"batch": q["batch"], "bucket": bucket, "a": pack_array(number[local].astype("<u4")), "b": pack_array(total[local].astype("<u8"))})
        table = {"a": pack_array(found[seen].astype("<u8")), "b": pack_array(total[seen].astype("<u8"))} if keep else {}
        rows.append({"batch": TABLE, "bucket": bucket, **table, "s": [int(total.sum()), int(seen.sum()), *counts_of_counts(total)]})
        return pa.Table.from_pylist(rows, ANSWER_SCHEMA)

    return run


def add_grams(d: np.ndarray, n: int, numbered: bool, keep: bool):
    """``d`` are the discounts of one order less, ``n`` is the number of buckets; numbers are for longer sequences.

    ``keep``: the table holds the sequences, not their counts of counts alone.
    """

    def run(group: pa.Table) -> pa.Table:
        """One bucket: counts of its sequences over all batches, and what each history's backoff weight needs."""
        asked = group.to_pylist()
        bucket = asked[0]["bucket"]
        marked, backs_off = zip(*(unpack_heads(q["a"], n) for q in asked))
        runs = [unpack_array(q["b"], "<u4") for q in asked]
        tails = [unpack_array(q["c"], "<u8") for q in asked]
        numbers = [unpack_array(q["d"], "<u8") for q in asked]
        history, _, head = distinct(np.concatenate(marked))
        split = history & U64(1) == 1
        lengths, tail = np.concatenate(runs), np.concatenate(tails)
        bits, tail_ids = int(tail.max(initial=0)).bit_length(), None
        if bits + len(history).bit_length() + len(tail).bit_length() > 64:  # no room for last words as they are
            tail_ids, _, tail = distinct(tail)
            bits, tail = len(tail_ids).bit_length(), tail.astype(U64)
        grams, order, begins = grouped(np.repeat(head, lengths).astype(U64) << U64(bits) | tail)
        sizes = np.diff(begins, append=len(order))
        total = np.add.reduceat(np.concatenate([x[: len(x) // 2] for x in numbers])[order], begins).astype(np.int64)
        lower = np.concatenate([x[len(x) // 2 :] for x in numbers])[order[begins]].astype(np.int64)
        h, seen = (grams >> U64(bits)).astype(np.int64), total > 0
        # how many sequences of count 1..K each history has, what all cover, and if training saw it once: its only one has count one then
        cells = np.bincount(np.minimum(total, K + 1) * len(history) + h, minlength=(K + 2) * len(history)).reshape(K + 2, -1)[1 : K + 1]
        cover = np.bincount(h[seen], kept(lower[seen], d), len(history))
        once = np.bincount(h, total, len(history)) == 1
        count = np.empty(len(order), U64)
        count[order] = np.repeat(total, sizes)
        if numbered:
            number = np.empty(len(order), np.int64)
            number[order] = np.repeat(np.maximum(np.cumsum(seen) - 1, 0), sizes)  # those that weren't learned need none
        needs = np.concatenate(backs_off)
        needs[np.repeat(np.arange(len(head)), lengths)[count == 0]] = True
        # the counts of a split history are not whole here
        tells, covers = np.flatnonzero(~(split | once)[head]), np.flatnonzero(~split[head] & needs)
        told, covered = cells[:, head[tells]], cover[head[covers]]
        heads, ends = (np.append(0, np.cumsum([len(x) for x in xs])) for xs in (backs_off, tails))
        rows = []
        for k, q in enumerate(asked):
            if q["batch"] != TABLE:
                mine = slice(*ends[k : k + 2])
                tell, covering = (slice(*np.searchsorted(x, heads[k : k + 2])) for x in (tells, covers))
                rows.append(
                    {
                        "batch": q["batch"], "bucket": bucket, "a": pack_array(count[mine]),
                        "b": pack_array(told[:, tell].astype("<u8").ravel()), "c": pack_few(covered[covering]),
                        "d": pack_array(np.diff(number[mine], prepend=0).astype("<u8")) if numbered else None,
                    }
                )
        table = {}
        if keep:
            of = np.bincount(h[seen], minlength=len(history))
            has, last = of > 0, grams[seen] & U64((1 << bits) - 1)
            last = last if tail_ids is None else tail_ids[last.astype(np.int64)]
            table = dict(zip("abcd", gram_columns(history[has] >> U64(1), np.zeros(has.sum(), bool), split[has], of[has], last, total[seen], lower[seen], n)))
        rows.append({"batch": TABLE, "bucket": bucket, **table, "s": counts_of_counts(total)})
        rows.append(
            {
                "batch": SHARES, "bucket": bucket, "a": pack_array((history[split] >> U64(1)).astype("<u8")),
                "b": pack_array(cells[:, split].astype("<u8").ravel()), "c": pack_few(cover[split]),
            }
        )
        return pa.Table.from_pylist(rows, ANSWER_SCHEMA)

    return run


def sums_of(answers: DataFrame, n: int) -> list[int]:
    columns = [F.coalesce(F.sum(F.get("s", F.lit(i))), F.lit(0)) for i in range(n)]
    return list(answers.filter(F.col("batch") == TABLE).agg(*columns).first())


def questions(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ANSWER_SCHEMA)], names=ANSWER_SCHEMA.names[:6])


def shares_of(table: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the split histories, each frequent enough that their number is bounded."""
    shares: dict[int, np.ndarray] = {}
    for row in table.filter(F.col("batch") == SHARES).select("a", "b", "c").toLocalIterator():
        whole = unpack_array(row["b"], "<u8").reshape(K, -1).T.astype(float)
        for h, sums in zip(unpack_array(row["a"], "<u8").tolist(), np.column_stack([whole, unpack_few(row["c"])])):
            shares[h] = shares.get(h, 0) + sums
    return shares


@dataclass
class KatzModel:
    """Tables of counts, a row for each bucket: of words, then of sequences of two words and more.

    ``counts`` are the counts of counts of each order from two on, ``n`` is the number of buckets.
    """

    words: Words
    texts: int
    n: int
    tables: list[DataFrame]
    counts: list[list[int]]

    def score(self, docs: DataFrame, held_out: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
        """What ``train_and_score`` returns, for documents that the model need not have seen."""
        marked = mark(docs, F.lit(False), F.lit(True) if held_out is None else held_out, key, text)
        return _run(marked, len(self.tables), self, key, text, False)[1]


def mark(docs: DataFrame, train: Column, held_out: Column, key: str, text: str) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(key, text, F.coalesce(train, F.lit(False)).alias("train"), held_out.alias("held_out"))


def train_and_score(docs: DataFrame, train: Column, held_out: Column, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """``key``, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``.

    The model learns from the rows where ``train``.
    """
    return _run(mark(docs, train, held_out, key, text), order, None, key, text, False)[1]


def learn(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER) -> KatzModel:
    """The model of the rows where ``train``."""
    return _run(mark(docs.filter(train), F.lit(True), F.lit(False), key, text), order, None, key, text, True)[0]


def _run(marked: DataFrame, order: int, known: KatzModel | None, key: str, text: str, keep: bool) -> tuple[KatzModel, DataFrame]:
    """The model of the rows marked ``train`` and the scores of all; ``known`` is a model that is used as it is.

    ``keep``: the model will score other documents, so its tables are written as well.
    """
    if order < 1:
        raise ValueError("order counts the words of the longest sequence, from one on")
    packed, n_batches = batches.pack(marked, [key, "train", "held_out", text], text, encode(key, text))
    n = known.n if known else batches.n_buckets(packed, n_batches)

    def ask_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for row in part.to_pylist():
                batch = Batch(row["blob"], key)
                order, present, bounds = batch.word_questions(n)
                counts = np.bincount(batch.word[batch.learned()], minlength=len(batch.words))
                words, counts = batch.words[order], counts[order].astype("<u8")
                yield questions(
                    [(row["batch"], b, pack_array(words[i:j]), pack_array(counts[i:j]), b"", b"")
                     for b, i, j in zip(present.tolist(), bounds, bounds[1:])]
                )

    def add(asked: DataFrame, adder, name: str, level: int) -> DataFrame:
        if known:
            asked = asked.unionByName(known.tables[level].filter(F.col("batch") == TABLE).select(*asked.columns))
        return store(asked.groupBy("bucket").applyInArrow(adder, ANSWER), name, tidy=True).table

    tables = [add(packed.mapInArrow(ask_words, QUESTION), add_words(keep), "word-counts", 0)]
    tokens, types, *counts = sums_of(tables[0], K + 3)
    words = Words(tokens, types, counts)
    texts = known.texts if known else marked.filter("train").count()

    def levels(row: dict, told: list[dict], upto: int, answered: int) -> tuple[Batch, list[Grams]]:
        """The batch, and its sequences of orders from two to ``upto``, with the answers to those up to ``answered``."""
        batch, grams = Batch(row["blob"], key), []
        batch.set_words([t for t in told if t["level"] == 0], n)
        for level in range(1, upto):
            grams.append(grams[-1].longer(n, tokens) if grams else pairs_of(batch, n, words, texts))
            if level < answered:
                grams[-1].take([t for t in told if t["level"] == level])
        return batch, grams

    def ask_grams(upto: int):
        def run(rows: pa.Table, told: pa.Table) -> pa.Table:
            told = told.to_pylist()
            out = [levels(row, told, upto, upto - 1)[1][-1].questions(row["batch"]) for row in rows.to_pylist()]
            return pa.Table.from_batches(out, questions([]).schema)

        return run

    def answers(*sums: str) -> DataFrame:
        """Words' answers whole, and those of sequences with the columns ``sums`` if asked for."""
        each = [
            t.filter(F.col("batch") >= 0).select(
                "batch", "bucket", "a", *(c if i == 0 or c in sums else F.lit(None).cast("binary").alias(c) for c in "bc"), "d", F.lit(i).alias("level")
            )
            for i, t in enumerate(tables)
        ]
        return reduce(DataFrame.unionByName, each)

    lower, of_order = words.d, []
    for upto in range(2, order + 1):
        asked = packed.groupBy("batch").cogroup(answers().groupBy("batch")).applyInArrow(ask_grams(upto), QUESTION)
        tables.append(add(asked, add_grams(lower, n, upto < order, keep), "gram-counts", upto - 1))
        of_order.append(sums_of(tables[-1], K + 1))
        lower = discounts(of_order[-1])
    model = KatzModel(words, texts, n, known.tables if known else tables, of_order)

    kept_of = [discounts(c) for c in of_order]
    split = packed.sparkSession.sparkContext.broadcast([shares_of(t) for t in tables[1:]])  # 4 * MOST_SHARES histories an order

    def score(rows: pa.Table, told: pa.Table) -> pa.Table:
        out, told = [], told.to_pylist()
        for row in rows.to_pylist():
            batch, grams = levels(row, told, order, order)
            of_word = batch.count[batch.word]
            logs = np.log10(words.probability(batch.count))[batch.word]  # after no history
            factor = np.full(len(logs), words.scale / max(words.tokens, 1))  # probability for each count kept
            for level, d, shares in zip(grams, kept_of, split.value):
                for h in np.flatnonzero(level.split).tolist():
                    level.sums[:, h] = shares.get(int(level.histories[h]), level.sums[:, h])
                asked, after = level.asked, np.empty(len(level.histories), np.int64)
                after[level.history] = asked  # a token after each history
                scale, weight = backoff(level.sums[:K], level.seen, level.sums[K] * factor[after], d)
                share = scale / level.seen
                direct = np.log10(np.maximum(share[level.head] * kept(level.count, d), 1e-300))
                direct[level.count == 0] = -np.inf  # not seen
                direct = np.append(direct, -np.inf)[level.gram[asked]]
                factor[asked] = share[level.history]
                logs[asked] = np.where(direct == -np.inf, logs[asked] + np.log10(weight)[level.history], direct)
            total = lambda x: np.add.reduceat(x, batch.begins)  # noqa: B023, E731
            out.append(
                pa.table(
                    {
                        key: batch.keys, "held_out": batch.held, "n_tokens": batch.sizes.astype(np.int64),
                        "n_known": total((of_word > 0).astype(np.int64)), "train_tokens": np.full(len(batch.sizes), train_tokens),
                        "base_score": total(words.base(batch.count)[batch.word]), "score": total(logs),
                    }
                )
            )
        return pa.concat_tables(out) if out else empty

    train_tokens, kind = int(tokens), pa.int64()
    empty = pa.schema(
        [(key, kind), ("held_out", pa.bool_()), ("n_tokens", kind), ("n_known", kind), ("train_tokens", kind), ("base_score", pa.float64()), ("score", pa.float64())]
    ).empty_table()
    schema = f"{key} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return model, packed.groupBy("batch").cogroup(answers("b", "c").groupBy("batch")).applyInArrow(score, schema)
