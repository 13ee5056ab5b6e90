"""Class-based n-gram scoring: exchange clustering assigns words to classes; class transitions and word emissions
give a smoothed probability of every text.

    P(w_i | w_{i-1}) = P(class_i | class_{i-1}) * P(w_i | class_i)

Clustering has two stages, and its vocabulary grows with the data. First the ``TOP_WORDS`` most frequent words, the end
token and groups of all other words by their last ``SUFFIX`` bytes (``SYMBOLS`` symbols) are exchanged one at a time.
Then every other word with at least ``LEAST_COUNT`` occurrences leaves its group and is moved, a hashed half of the words
a round, to the class that raises the likelihood of the class bigrams most, until a round adds less than ``ENOUGH`` of
what all rounds have. Rarer and unseen words keep the class of their group. Counts cover all training documents.

Scale: word counts and their vocabulary live in a table. Words above a count that at most ``HEAD_WORDS`` reach are sent
to the tasks as a dictionary (that bound holds at any size); rarer words of each document are joined by shuffle.
The bigrams of the words of the second stage stay in a table of packed buckets; none of these words has more than
1/TOP_WORDS of the tokens. Sent to all tasks are their classes (a byte a word) and, for those outside the head, sorted
hashes (8 bytes a word); there are at most tokens / LEAST_COUNT of them. The symbol matrices have SYMBOLS^2 cells.

Edge cases: null or empty text is the end token alone; without training documents every token is unknown and both
scores use N = V = 0; repeated rows are counted and scored each for itself; a null id is the empty text for the split;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, id_crc, mix64, small_batches, text_or_empty

TOP_WORDS, SYMBOLS, CLASSES, SUFFIX = 768, 1024, 64, 3
LEAST_COUNT = 100
GROUPS = SYMBOLS - TOP_WORDS - 1
END = SYMBOLS - 1
HEAD_WORDS = 1 << 17
SWEEPS = 12
ENOUGH = 0.01
ENTRIES, BUCKET_TOKENS, BUCKETS = 1_000_000, 2_000_000, 64
FLUSH, MET = 300_000, 100_000
SPLIT_MOD, HELD_OUT = 7, 2


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange_classes(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every symbol; the last symbol (the end token) keeps class 0 for itself.

    Greedy exchange on the class bigram likelihood sum f(n(c,d)) - sum f(n(c,.)) - sum f(n(.,d)), f(x) = x log x.
    """
    n = len(bigrams)
    b = bigrams.astype(np.float64)
    rank = np.empty(n, np.int64)
    rank[np.argsort(-(b.sum(0) + b.sum(1)), kind="stable")] = np.arange(n)
    own = 1 + rank % (classes - 1)
    own[n - 1] = 0
    member = np.eye(classes)[own]
    right, left = b @ member, b.T @ member  # n(w, class), n(class, w)
    table = member.T @ right
    out, into = b.sum(1), b.sum(0)
    for _ in range(sweeps):
        moved = 0
        for w in range(n - 1):
            if not out[w] + into[w]:
                continue
            g, r, l, s = own[w], right[w].copy(), left[w].copy(), b[w, w]
            # without w: its own pairs leave class g
            table[g, :] -= r
            table[:, g] -= l
            table[g, g] += s
            r[g] -= s
            l[g] -= s
            rows, cols = table.sum(1), table.sum(0)
            gain = (_xlogx(table + r) - _xlogx(table)).sum(1) + (_xlogx(table.T + l) - _xlogx(table.T)).sum(1)
            d = np.diag(table)
            gain += _xlogx(d + r + l + s) - _xlogx(d + r) - _xlogx(d + l) + _xlogx(d)
            gain -= _xlogx(rows + out[w]) - _xlogx(rows) + _xlogx(cols + into[w]) - _xlogx(cols)
            gain[0] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] <= gain[g] + 1e-9:
                k = g
            r[k] += s
            l[k] += s
            table[k, :] += r
            table[:, k] += l
            table[k, k] -= s
            if k != g:
                moved += 1
                own[w] = k
                right[:, g] -= b[:, w]
                right[:, k] += b[:, w]
                left[:, g] -= b[w, :]
                left[:, k] += b[w, :]
        if not moved:
            break
    return own


def likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def best_classes(table: np.ndarray, right: np.ndarray, left: np.ndarray, itself: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The step of ``exchange_classes`` for many words, each against the same class bigrams: n(w, class), n(class, w), n(w, w)."""
    out = own.copy()
    for start in range(0, len(own), 256):
        cut = slice(start, start + 256)
        g, r, l, s = own[cut], right[cut].copy(), left[cut].copy(), itself[cut].astype(np.float64)
        at = np.arange(len(g))
        t = np.repeat(table[None].astype(np.float64), len(g), 0)
        t[at, g, :] -= r
        t[at, :, g] -= l
        t[at, g, g] += s
        n_out, n_in = r.sum(1, keepdims=True), l.sum(1, keepdims=True)
        r[at, g] -= s
        l[at, g] -= s
        rows, cols, d, s = t.sum(2) + l, t.sum(1) + r, np.einsum("nkk->nk", t), s[:, None]
        gain = (_xlogx(t + r[:, None, :]) - _xlogx(t)).sum(2) + (_xlogx(t + l[:, :, None]) - _xlogx(t)).sum(1)
        gain += _xlogx(d + r + l + s) - _xlogx(d + r) - _xlogx(d + l) + _xlogx(d)
        gain -= _xlogx(rows + n_out) - _xlogx(rows) + _xlogx(cols + n_in) - _xlogx(cols)
        gain[:, 0] = -np.inf
        k = np.argmax(gain, 1)
        out[cut] = np.where(gain[at, k] > gain[at, g] + 1e-9, k, g)
    return out


def group_of(word: bytes) -> int:
    """First-stage symbol of a word that is not among the most frequent."""
    return TOP_WORDS + zlib.crc32(word[-SUFFIX:]) % GROUPS


@dataclass
class Counts:
    """What the corpus gives: a table of all word counts, and the bounded parts that the driver holds."""

    table: DataFrame  # word binary, c long
    tokens: int
    distinct: int
    documents: int
    head: dict[bytes, int]  # the most frequent words, by falling count
    head_counts: np.ndarray
    least: int  # words of that count or more are in the head
    n_head: int  # so many of the head are clustered, the first of it
    tail: np.ndarray  # sorted hashes of the clustered words outside the head
    group_sizes: np.ndarray  # words outside the clustered ones, per first-stage symbol

    @property
    def clustered(self) -> int:
        return self.n_head + len(self.tail)


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(rows: DataFrame, scratch: Scratch) -> Counts:
    """rows (text binary) of the training documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        frame = lambda: pd.DataFrame({"word": list(held.keys()), "c": np.fromiter(held.values(), np.int64, len(held))})
        documents = 0
        for pdf in batches:
            documents += len(pdf)
            for text in pdf.text:
                held.update(tokens_of(bytes(text)))
                if len(held) > FLUSH:
                    yield frame()
                    held.clear()
        yield frame()
        yield pd.DataFrame({"word": [None], "c": [documents]})

    summed = rows.mapInPandas(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    table = scratch.save(summed, "words")
    documents = (table.where("word is null").agg(F.sum("c")).first() or [0])[0] or 0
    words = table.where("word is not null")
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # counts of counts in eighth octaves: at most 512 rows, enough to find the head's least count
    octave = F.floor(F.log2("c") * 8)
    levels = sorted(((int(r.o), int(r.n), int(r.least)) for r in words.groupBy(octave.alias("o")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()), reverse=True)
    room = HEAD_WORDS
    least = max([lv[2] for lv in levels], default=0) * 2 + 1
    for octave_no, n, lowest in levels:
        room -= n
        if room < 0:
            # within the octave that doesn't fit whole: the least count that does (counts of counts, of so narrow a band)
            exact = words.where(octave == octave_no).groupBy("c").agg(F.count("*").alias("n"))
            running = F.sum("n").over(W.orderBy(F.desc("c")))
            least = exact.withColumn("n", running).where(F.col("n") <= room + n).agg(F.min("c")).first()[0] or least
            break
        least = lowest
    head = sorted(((bytes(r.word), int(r.c)) for r in words.where(F.col("c") >= least).collect()), key=lambda x: (-x[1], x[0]))
    head_counts = np.array([c for _, c in head], np.int64)
    n_head = max(min(TOP_WORDS, len(head)), int((head_counts >= LEAST_COUNT).sum()))
    between = words.where((F.col("c") >= LEAST_COUNT) & (F.col("c") < least)) if least > LEAST_COUNT else None
    hashed = F.conv(F.substring(F.md5("word"), 1, 15), 16, 10).cast("long")
    tail = np.sort(between.select(hashed.alias("h")).toPandas().h.to_numpy(np.int64)) if between else np.zeros(0, np.int64)
    sizes = np.zeros(SYMBOLS, np.int64)
    suffix = F.when(F.length("word") > SUFFIX, F.expr(f"substring(word, length(word) - {SUFFIX - 1}, {SUFFIX})")).otherwise(F.col("word"))
    for r in words.where(F.col("c") < LEAST_COUNT).groupBy((F.crc32(suffix) % GROUPS).alias("g")).agg(F.count("*").alias("n")).collect():
        sizes[TOP_WORDS + int(r.g)] = int(r.n)
    for w, c in head[:n_head]:
        if c < LEAST_COUNT:
            sizes[group_of(w)] -= 1
    return Counts(words, int(totals.n) + documents, int(totals.v) + (documents > 0), int(documents), {w: i for i, (w, _) in enumerate(head)}, head_counts, least, n_head, tail, sizes)


def word_hash(word: bytes) -> int:
    return int(hashlib.md5(word).hexdigest()[:15], 16)


class Coder:
    """Symbols of words: clustered words by their place, then the tail by hash, then first-stage groups and the end token."""

    def __init__(self, head: dict[bytes, int], n_head: int, tail: np.ndarray):
        self.head, self.n_head, self.tail, self.clustered = head, n_head, tail, n_head + len(tail)
        self.end = self.clustered + GROUPS
        self.size = self.end + 1
        self.of_head = np.arange(len(head))
        for w, i in head.items():
            if i >= n_head:
                self.of_head[i] = self.group(w)
        self.met: dict[bytes, int] = {}

    def group(self, word: bytes) -> int:
        return self.clustered + group_of(word) - TOP_WORDS

    def other(self, word: bytes) -> int:
        """Symbol of a word outside the head."""
        p = self.met.get(word)
        if p is None:
            p = self.group(word)
            if len(self.tail):
                h = word_hash(word)
                i = int(np.searchsorted(self.tail, h))
                if i < len(self.tail) and self.tail[i] == h:
                    p = self.n_head + i
            if len(self.met) > MET:
                self.met.clear()
            self.met[word] = p
        return p

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the head (or -1), and symbols."""
        get = self.head.get
        places = np.array([get(w, -1) for w in words], np.int64)
        out = self.of_head[places] if len(self.of_head) else np.zeros(len(words), np.int64)
        for i in np.flatnonzero(places < 0):
            out[i] = self.other(words[i])
        return places, out

    def first_stage(self, groups: np.ndarray) -> np.ndarray:
        """First-stage symbol of every symbol; ``groups`` has that of each clustered word."""
        out = np.r_[groups, TOP_WORDS + np.arange(GROUPS), END].astype(np.int64)
        n = min(TOP_WORDS, self.n_head)
        out[:n] = np.arange(n)
        return out


def clustered_groups(counts: Counts) -> np.ndarray:
    """Suffix group of every clustered word."""
    out = np.zeros(counts.clustered, np.int64)
    for w, i in counts.head.items():
        if i < counts.n_head:
            out[i] = group_of(w)
    if len(counts.tail):
        suffix = F.when(F.length("word") > SUFFIX, F.expr(f"substring(word, length(word) - {SUFFIX - 1}, {SUFFIX})")).otherwise(F.col("word"))
        hashed = F.conv(F.substring(F.md5("word"), 1, 15), 16, 10).cast("long")
        got = counts.table.where((F.col("c") >= LEAST_COUNT) & (F.col("c") < counts.least)).select(hashed.alias("h"), (F.crc32(suffix) % GROUPS).alias("g")).toPandas()
        out[counts.n_head + np.searchsorted(counts.tail, got.h.to_numpy(np.int64))] = TOP_WORDS + got.g.to_numpy(np.int64)
    return out


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def pair_counts(rows: DataFrame, coder, groups: np.ndarray, tokens: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """First-stage bigrams of all pairs; those of pairs without a second-stage word; and a table (bucket, codes, counts) of the
    pairs of each second-stage word w: code = (w * size + other) * 2 + side, side 0 where w comes first."""
    buckets = max(BUCKETS, tokens // BUCKET_TOKENS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = coder.value
        size, to = code.size, code.first_stage(groups)
        low, high = min(TOP_WORDS, code.n_head), code.clustered
        squares = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
        held: list[np.ndarray] = []
        n_held = 0

        def packed() -> pd.DataFrame:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            bucket = (mix64((codes // (2 * size)).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, codes, n = bucket[order], codes[order], n[order].astype(np.int64)
            cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            return pd.DataFrame({"key": [bucket[a] for a, _ in spans], "codes": [codes[a:b].tobytes() for a, b in spans], "counts": [n[a:b].tobytes() for a, b in spans]})

        for pdf in batches:
            lines = []
            for text in pdf.text:
                lines += [[code.end], code(tokens_of(bytes(text)))[1], [code.end, -1]]  # -1: no pair across documents
            if not lines:
                continue
            s = np.concatenate(lines).astype(np.int64)
            a, b = s[:-1], s[1:]
            own = (a >= 0) & (b >= 0)
            a, b = a[own], b[own]
            first, second = (a >= low) & (a < high), (b >= low) & (b < high)
            square = to[a] * SYMBOLS + to[b]
            squares[0] += np.bincount(square, minlength=SYMBOLS * SYMBOLS)
            squares[1] += np.bincount(square[~(first | second)], minlength=SYMBOLS * SYMBOLS)
            held += [(a[first] * size + b[first]) * 2, (b[second] * size + a[second]) * 2 + 1]
            n_held += int(first.sum() + second.sum())
            if n_held > ENTRIES:
                yield packed()
                held.clear()
                n_held = 0
        if n_held:
            yield packed()
        for i, square in enumerate(squares.reshape(2, SYMBOLS, SYMBOLS)):
            used = np.flatnonzero(square.any(1))
            yield pd.DataFrame({"key": -1 - (used + i * SYMBOLS), "codes": [b""] * len(used), "counts": [square[j].tobytes() for j in used]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.key.iloc[0] < 0:
            total, codes = np.sum([np.frombuffer(x, np.int64) for x in pdf.counts], axis=0), np.zeros(0, np.int64)
        else:
            codes, total = summed(np.frombuffer(b"".join(pdf.codes), np.int64), np.frombuffer(b"".join(pdf.counts), np.int64))
        return pd.DataFrame({"key": pdf.key[:1], "codes": [codes.tobytes()], "counts": [total.tobytes()]})

    schema = "key long, codes binary, counts binary"
    table = scratch.save(rows.mapInPandas(count, schema).groupBy("key").applyInPandas(add, schema), "pairs")
    out = np.zeros((2 * SYMBOLS, SYMBOLS), np.int64)
    for r in table.where("key < 0").select("key", "counts").collect():
        out[-1 - r.key] = np.frombuffer(r.counts, np.int64)
    return out[:SYMBOLS], out[SYMBOLS:], table.where("key >= 0")


def class_pairs(table: DataFrame, own: np.ndarray, low: int, high: int, rest: np.ndarray, classes: int) -> np.ndarray:
    """Class bigrams of all pairs: ``rest`` plus those of the packed table, each pair once."""
    size = len(own)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(classes * classes)
        for pdf in batches:
            for codes, n in zip(pdf.codes, pdf.counts, strict=True):
                codes, n = np.frombuffer(codes, np.int64), np.frombuffer(n, np.int64)
                w, other, side = codes // (2 * size), codes // 2 % size, codes % 2
                once = (side == 0) | (other < low) | (other >= high)  # a pair of two such words is held by both
                x, y = own[w].astype(np.int64), own[other].astype(np.int64)
                total += np.bincount(np.where(side == 0, x * classes + y, y * classes + x)[once], n[once], classes * classes)
        yield pd.DataFrame({"t": [total.astype(np.int64).tobytes()]})

    with small_batches(table.sparkSession):
        got = table.select("codes", "counts").mapInPandas(count, "t binary").collect()
    return rest + sum(np.frombuffer(r.t, np.int64).reshape(classes, classes) for r in got)


def moved(table: DataFrame, own: np.ndarray, pairs: np.ndarray, half: int, classes: int) -> np.ndarray:
    """Classes after one round: the words of one hashed half go where the likelihood gains most."""
    size = len(own)

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for codes, n in zip(pdf.codes, pdf.counts, strict=True):
                codes, n = np.frombuffer(codes, np.int64), np.frombuffer(n, np.int64)
                mine = mix64((codes // (2 * size) + size).astype(np.uint64)) % np.uint64(2) == half
                codes, n = codes[mine], n[mine]
                words, at = np.unique(codes // (2 * size), return_inverse=True)
                other, side = codes // 2 % size, codes % 2
                seen = np.bincount((at * 2 + side) * classes + own[other], n, len(words) * 2 * classes).reshape(len(words), 2, classes)
                same = (other == words[at]) & (side == 0)
                itself = np.bincount(at[same], n[same], len(words))
                ids.append(words)
                to.append(best_classes(pairs, seen[:, 0], seen[:, 1], itself, own[words].astype(np.int64)))
            yield pd.DataFrame({"ids": [np.concatenate(ids).tobytes()], "to": [np.concatenate(to).astype(np.uint8).tobytes()]})

    out = own.copy()
    with small_batches(table.sparkSession):
        got = table.select("codes", "counts").mapInPandas(move, "ids binary, to binary").collect()
    for r in got:
        out[np.frombuffer(r.ids, np.int64)] = np.frombuffer(r.to, np.uint8)
    return out


def cluster(training: DataFrame, counts: Counts, coder, scratch: Scratch, classes: int = CLASSES, sweeps: int = SWEEPS) -> ClassModel:
    """Both stages; the model's classes are those of the coder's symbols."""
    code, groups = coder.value, clustered_groups(counts)
    bigrams, rest, table = pair_counts(training, coder, groups, counts.tokens, scratch)
    first = exchange_classes(bigrams, classes, sweeps)
    own = first[code.first_stage(groups)].astype(np.uint8)
    member = np.eye(classes, dtype=np.int64)[first]
    rest = member.T @ rest @ member
    low, high = min(TOP_WORDS, code.n_head), code.clustered
    pairs = member.T @ bigrams @ member
    if high > low:
        start = best = likelihood(pairs)
        for step in range(2 * sweeps):
            new = moved(table, own, pairs, step % 2, classes)
            new_pairs = class_pairs(table, new, low, high, rest, classes)
            now = likelihood(new_pairs)
            if now <= best:
                break
            gained, own, pairs, best = now - best, new, new_pairs, now
            if step % 2 and gained < ENOUGH * (best - start):
                break
    sizes = np.bincount(own, np.r_[np.ones(high, np.int64), counts.group_sizes[TOP_WORDS:END], 1], classes).astype(np.int64)
    return ClassModel.of(own.astype(np.int64), pairs, sizes)


@dataclass
class ClassModel:
    """Class of each symbol, log10 transitions, and log10 of the emission denominators."""

    own: np.ndarray
    transition: np.ndarray
    emission: np.ndarray

    @staticmethod
    def fit(bigrams: np.ndarray, group_sizes: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> ClassModel:
        own = exchange_classes(bigrams, classes, sweeps)
        member = np.eye(classes, dtype=np.int64)[own]
        return ClassModel.of(own, member.T @ bigrams @ member, member.T @ group_sizes)

    @staticmethod
    def of(own: np.ndarray, pairs: np.ndarray, sizes: np.ndarray) -> ClassModel:
        """From class bigrams and the number of distinct words of each class."""
        classes, seen = len(pairs), pairs.sum(0)
        prior = (seen + 1) / (seen.sum() + classes)
        transition = (pairs + classes * prior) / (pairs.sum(1, keepdims=True) + classes)
        return ClassModel(own, np.log10(transition), np.log10(seen + sizes + 1))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"), (id_crc(id_col) % SPLIT_MOD == HELD_OUT).alias("held_out"))
    training = rows.where(~F.col("held_out")).select("text")
    counts = word_counts(training, scratch)
    coder = spark.sparkContext.broadcast(Coder(counts.head, counts.n_head, counts.tail))  # at most HEAD_WORDS words, and 8 bytes each of the tail
    model = cluster(training, counts, coder, scratch)
    logs = np.log10(counts.head_counts + 1.0)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = coder.value
        for pdf in batches:
            out = []
            for key, text in zip(pdf.key, pdf.text, strict=True):
                words = tokens_of(bytes(text))
                places, symbols = code(words)
                line = model.own[np.r_[code.end, symbols, code.end].astype(np.int64)]
                found = places[places >= 0]
                rare = Counter(words[i] for i in np.flatnonzero(places < 0))
                terms = model.transition[line[:-1], line[1:]].sum() - model.emission[line[1:]].sum()
                out.append((key, len(words) + 1, len(found), float(logs[found].sum()), float(terms), list(rare.keys()), list(rare.values())))
            done = pd.DataFrame(out, columns=["key", "n_tokens", "found", "logs", "terms", "rare", "times"])
            done.insert(1, "id", pdf.id.array)
            done.insert(2, "held_out", pdf.held_out.array)
            yield done

    kind = dict(rows.dtypes)["id"]
    keyed = rows.withColumn("key", F.monotonically_increasing_id()).withColumn("id", F.col("id").cast("string"))  # a null among numbers would make pandas round them
    scored = keyed.mapInPandas(
        score, "key long, id string, held_out boolean, n_tokens long, found long, logs double, terms double, rare array<binary>, times array<long>"
    )
    scored = scratch.save(scored.withColumn("id", F.col("id").cast(kind)), "scored")
    rare = scored.select("key", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("key", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    tail = counts.table.where(F.col("c") < counts.least)
    met = rare.join(tail, "word").groupBy("key").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    whole = scored.drop("rare", "times").join(met, "key", "left")
    logs_sum = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(float(np.log10(counts.documents + 1.0)))
    denominator = float(np.log10(counts.tokens + counts.distinct + 1.0))
    known = F.col("found") + F.coalesce("more", F.lit(0)) + F.lit(1 if counts.documents else 0)
    return whole.select(
        "id", "held_out", "n_tokens", known.alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (logs_sum - F.col("n_tokens") * denominator).alias("base_score"), (logs_sum + F.col("terms")).alias("score"),
    )
