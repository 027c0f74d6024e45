"""Language model scores: a log-bilinear neural model trained by noise-contrastive estimation in numpy.

Tokens fall into classes: the most frequent words have one each, the others share classes by their last three bytes. The
number of classes grows with the square root of the number of distinct words, so the model grows with its corpus. The
model predicts the class of a token from its context: the sum of the embeddings of the last words, each through the
matrix of its place, and of the mean embedding of the last BAG words, through another. Classes lie in groups of about
equal shares of the tokens, as many as the root of the number of classes; a class has the probability of its group, by
the soft-max over all groups, times its own within the group, by the soft-max over the group's classes. Both come from
matrix products for a batch of tokens and sum up to 1, and a token costs the root of the number of classes.
Within a class a word has (c + 1) / (N_k + V_k + 1), from its count and the class's tokens and types in training, which
leaves one part for unknown words. So the probabilities of all words and of the unknown ones of all classes sum up to 1.

All counts are over all training rows. Training goes through all of them too, and every token is a target once, whatever
the size of the corpus: the rounds share the rows out among them. In each round every task starts from the same
parameters and trains on its own rows, for classes and groups alike against noise drawn from their frequencies, and the
parameters are averaged, weighted by tokens. So scores depend a little on how rows fall into tasks; the order of rows
and the files of a table decide that, and the same files give the same scores.

Contract for odd input: null and empty texts consist of their end token alone. Rows are scored as often as they occur.
Null ids count as the empty text for the split. Without training rows all words are unknown and every class is as
likely. Texts may be of any length; only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.common import bound_batches, held_out, settle_worker, stage_table

#: Classes of single words and of suffixes that every corpus gets; larger vocabularies get more, see class_numbers.
OWN, SHARED, DIM, CONTEXT, BAG = 256, 192, 16, 4, 32
#: Rounds of training; targets of a step; classes and groups drawn as noise for a step; step width.
ROUNDS, BATCH, NOISE, GROUP_NOISE, RATE = 2, 512, 64, 32, 0.4
#: Words whose counts every task holds; the counts of rarer ones are joined. Parameters in a block; tasks averaged at once.
HEAD, COUNTER_LIMIT, CHUNK, BLOCK, TASKS = 200_000, 400_000, 8192, 4096, 64
END = b"\n"  # no word: words hold no white space


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts (binary) in a row, and where each text's begin; last their number."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    words, starts = lists.values, lists.offsets.to_numpy()
    # White space at the ends of a text leaves empty pieces.
    filled = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return words.filter(filled).view(pa.binary()), before[starts]


class Groups:
    """Classes by falling frequency in groups of about equal shares of the tokens, as many as the root of their number at most."""

    def __init__(self, unigram: np.ndarray):
        order = np.argsort(-unigram, kind="stable")
        share = (np.cumsum(unigram[order]) - unigram[order]) / unigram.sum()
        _, found = np.unique((share * math.ceil(math.sqrt(len(unigram)))).astype(int), return_inverse=True)
        self.count = int(found.max()) + 1
        self.of = np.empty(len(unigram), np.int64)
        self.of[order] = found
        self.members = [order[found == g] for g in range(self.count)]
        self.place = np.empty(len(unigram), np.int64)
        for m in self.members:
            self.place[m] = np.arange(len(m))


class Parameters:
    """Embeddings e of context classes (one more for places before the text), q of predicted classes and their biases b, the
    same of groups (gq, gb), matrices c of places and m of the mean."""

    NAMES = ("e", "q", "b", "gq", "gb", "c", "m")

    def __init__(self, unigram: np.ndarray, seed: int = 7):
        g, classes = np.random.default_rng(seed), len(unigram)
        self.groups = Groups(unigram)
        self.e = (g.standard_normal((classes + 1, DIM)) * 0.3).astype(np.float32)
        self.q = (g.standard_normal((classes, DIM)) * 0.05).astype(np.float32)
        self.b = np.log(unigram).astype(np.float32)
        self.gq = (g.standard_normal((self.groups.count, DIM)) * 0.05).astype(np.float32)
        self.gb = np.log(np.bincount(self.groups.of, unigram)).astype(np.float32)
        self.c = np.stack([np.eye(DIM, dtype=np.float32) * (0.5 / (i + 1)) for i in range(CONTEXT)])
        self.m = np.eye(DIM, dtype=np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, values: np.ndarray) -> Parameters:
        at = 0
        for n in self.NAMES:
            x = getattr(self, n)
            setattr(self, n, values[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return self


def _items(x: np.ndarray) -> np.ndarray:
    """The rows of x as single items."""
    return x.view(f"V{x.shape[1] * x.itemsize}")[:, 0]


def contexts(e: np.ndarray, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every token of docs in a row: its class, the classes before it (CONTEXT columns), the mean row of e of the BAG before."""
    lengths = np.array([len(d) for d in docs])
    ids = np.concatenate(docs).astype(np.int64)
    at = np.arange(len(ids))
    place = at - np.repeat(np.cumsum(lengths) - lengths, lengths)
    before = np.empty((len(ids), CONTEXT), np.int64)
    for i in range(CONTEXT):
        before[i + 1 :, i] = ids[: max(len(ids) - i - 1, 0)]
    early = np.flatnonzero(place < CONTEXT)
    before[early] = np.where(place[early, None] <= np.arange(CONTEXT), len(e) - 1, before[early])
    total = np.zeros((len(ids) + 1, e.shape[1]), np.float32)
    # Two numbers at a time, as a complex one.
    np.cumsum(_items(e).take(ids).view(np.complex64).reshape(len(ids), -1), axis=0, out=total[1:].view(np.complex64))
    span = np.minimum(place, BAG)
    bag = _items(total).take(at - span).view(np.float32).reshape(len(ids), -1)
    np.subtract(total[:-1], bag, out=bag)
    bag *= (np.float32(1.0) / np.maximum(span, 1).astype(np.float32))[:, None]
    return ids, before, bag


def _log_sum(x: np.ndarray, small: bool) -> np.ndarray:
    """Log of the sum of exponentials of each row; overwrites x. Small values, below 60 in size, need no shift."""
    ones = np.ones(x.shape[1], np.float32)
    if small:
        np.exp(x, out=x)
        return np.log(x @ ones)
    top = x.max(axis=1)
    x -= top[:, None]
    np.exp(x, out=x)
    return top + np.log(x @ ones)


class Scorer:
    """Log probabilities under fixed parameters: the matrices of places are applied to all classes once. The first place adds a
    one for the biases, and a zero to make the number of columns even. A class that is alone in its group has no score of its own."""

    def __init__(self, p: Parameters):
        self.p, wide = p, DIM + 2
        self.bag = np.ascontiguousarray(p.e @ p.m)
        self.places = np.zeros((CONTEXT, len(p.e), wide), np.float32)
        self.places[:, :, :DIM] = p.e @ p.c
        self.places[0, :, DIM] = 1
        self.outer = [np.zeros((len(x), wide), np.float32) for x in (p.q, p.gq)]
        for x, q, b in zip(self.outer, (p.q, p.gq), (p.b, p.gb), strict=True):
            x[:, :DIM], x[:, DIM] = q, b
        self.q = [np.ascontiguousarray(self.outer[0][m].T) for m in p.groups.members]
        self.gq = np.ascontiguousarray(self.outer[1].T)
        self.outer[0][np.concatenate([m for m in p.groups.members if len(m) == 1] or [[]]).astype(int)] = 0
        longest = lambda q: float(np.sqrt((q * q).sum(axis=1)).max())
        self.reach, self.bias = max(longest(p.q), longest(p.gq)), max(float(np.abs(p.b).max()), float(np.abs(p.gb).max()))

    def log_probabilities(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each token's class, all docs in a row."""
        ids, before, bag = contexts(self.bag, docs)
        rows = lambda x, at: _items(x).take(at).view(np.float32).reshape(len(at), -1)
        r = rows(self.places[0], before[:, 0])
        for i in range(1, CONTEXT):
            r += rows(self.places[i], before[:, i])
        r[:, :DIM] += bag
        small = float(np.sqrt(np.einsum("ij,ij->i", r, r).max(initial=0))) * self.reach + self.bias < 60
        groups = self.p.groups
        mine = groups.of[ids]
        # All of a group's tokens in a row.
        order = np.argsort(mine.astype(np.uint16), kind="stable")
        r, ids, mine = rows(r, order), ids[order], mine[order]
        sums = _log_sum(r @ self.gq, small)
        ends = np.searchsorted(mine, np.arange(groups.count + 1))
        for g in np.flatnonzero(np.diff(ends)):
            if len(groups.members[g]) > 1:
                some = slice(ends[g], ends[g + 1])
                sums[some] += _log_sum(r[some] @ self.q[g], small)
        out = np.empty(len(ids), np.float32)
        out[order] = np.einsum("ij,ij->i", r, rows(self.outer[0], ids) + rows(self.outer[1], mine)) - sums
        return out


class Trainer:
    """Noise-contrastive estimation with Adagrad steps. A step costs nothing for the rows of parameters that it doesn't touch,
    and its larger arrays are kept from step to step, as fresh memory costs more than the arithmetic in it. Classes and groups
    lie in one table, with biases as products with a one; WIDE is even, so that numbers are summed in pairs, as complex ones."""

    WIDE = DIM + 2

    def __init__(self, p: Parameters, unigram: np.ndarray, seed: int):
        self.p, self.g, classes = p, np.random.default_rng(seed), len(unigram)
        levels = unigram, np.bincount(p.groups.of, unigram)
        self.draw = [np.cumsum(x) / np.sum(x) for x in levels]
        self.log_noise = np.concatenate([np.log(x / x.sum() * n) for x, n in zip(levels, (NOISE, GROUP_NOISE), strict=True)]).astype(np.float32)
        self.group = p.groups.of + classes
        # From here on p's arrays are parts of these three, whose rows are also seen as single items, to be copied in one go.
        outer = np.zeros((len(self.log_noise), self.WIDE), np.float32)
        outer[:, :DIM], outer[:, DIM] = np.concatenate([p.q, p.gq]), np.concatenate([p.b, p.gb])
        p.q, p.gq, p.b, p.gb = outer[:classes, :DIM], outer[classes:, :DIM], outer[:classes, DIM], outer[classes:, DIM]
        self.matrix = np.concatenate([p.c.reshape(-1, DIM), p.m])
        p.c, p.m = self.matrix[:-DIM].reshape(p.c.shape), self.matrix[-DIM:]
        self.matrix_sums = np.full_like(self.matrix, 0.1)
        self.rows = {n: (_items(x), _items(np.full_like(x, 0.1))) for n, x in (("e", p.e), ("outer", outer))}
        size = max(len(p.e), len(outer))
        self.where = np.zeros(size, np.int64)
        self.pairs = {n: _items(np.arange(size * n // 2).reshape(size, n // 2)) for n in (DIM, self.WIDE)}
        self.kept: dict[str, np.ndarray] = {}

    def _space(self, name: str, rows: int, columns: int, kind: type = np.float32) -> np.ndarray:
        a = self.kept.get(name)
        if a is None or a.shape[0] < rows:
            a = self.kept[name] = np.empty((rows, columns), kind)
        return a[:rows]

    def _taken(self, name: str, items: np.ndarray, rows: np.ndarray, columns: int, kind: type = np.float32) -> np.ndarray:
        out = self._space(name, len(rows), columns, kind)
        items.take(rows, out=_items(out), mode="clip")
        return out

    def _step(self, name: str, index: np.ndarray, values: np.ndarray) -> None:
        """A step by the sums of the rows of values for each distinct value of index."""
        wide, (x, sums) = values.shape[1], self.rows[name]
        rows = np.bincount(index).nonzero()[0]
        n = len(rows)
        self.where[rows] = np.arange(n)
        pairs = self._taken(f"pairs {name}", self.pairs[wide], self.where.take(index), wide // 2, np.int64)
        gradient = np.zeros(n * wide // 2, np.complex64)
        np.add.at(gradient, pairs.ravel(), values.view(np.complex64).ravel())
        gradient = gradient.view(np.float32).reshape(n, wide)
        s = self._space(f"squares {name}", n, wide)
        np.multiply(gradient, gradient, out=s)
        s += self._taken(f"rows {name}", sums, rows, wide)
        sums[rows] = _items(s)
        np.sqrt(s, out=s)
        np.divide(gradient, s, out=s)
        s *= np.float32(RATE)
        s += self._taken(f"rows {name}", x, rows, wide)
        x[rows] = _items(s)

    def _contrast(self, r: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Steps classes and groups against fresh noise; returns the gradient of r, whose last columns are one and zero."""
        n, k, table = len(target), NOISE + GROUP_NOISE, self.rows["outer"][0]
        classes = len(self.group)
        noise = [d.searchsorted(self.g.random(m), side="right") for d, m in zip(self.draw, (NOISE, GROUP_NOISE), strict=True)]
        index = np.concatenate([target, self.group[target], noise[0], noise[1] + classes])
        scores = self._taken("scores", table, index, self.WIDE)
        scores[:, DIM] -= self.log_noise.take(index)
        mine, others = scores[: 2 * n].reshape(2, n, self.WIDE), scores[2 * n :]
        pull = np.einsum("ij,kij->ki", r, mine)
        np.minimum(pull, 30, out=pull)
        np.exp(pull, out=pull)
        pull += 1
        np.divide(np.float32(1 / n), pull, out=pull)
        # The logistic function of x is (1 + tanh(x / 2)) / 2.
        others *= np.float32(0.5)
        push = np.matmul(r, others.T, out=self._space("push", n, k))
        np.tanh(push, out=push)
        push += 1
        back = push @ (others * np.float32(-1 / n))
        back += np.einsum("ki,kij->ij", pull, mine)
        values = self._space("values", 2 * n + k, self.WIDE)
        np.multiply(pull[:, :, None], r, out=values[: 2 * n].reshape(2, n, self.WIDE))
        np.matmul(push.T, r, out=values[2 * n :])
        values[2 * n :] *= np.float32(-0.5 / n)
        self._step("outer", index, values)
        return back[:, :DIM]

    def batch(self, target: np.ndarray, before: np.ndarray, bag: np.ndarray) -> None:
        n, matrix, before = len(target), self.matrix, before.ravel()
        x = self._taken("x", self.rows["e"][0], before, DIM).reshape(n, -1)
        r = self._space("r", n, self.WIDE)
        r[:, :DIM] = bag @ matrix[-DIM:]
        r[:, :DIM] += x @ matrix[:-DIM]
        r[:, DIM], r[:, DIM + 1] = 1, 0
        back = self._contrast(r, target)
        gradient = np.concatenate([x.T @ back, bag.T @ back])
        e = np.matmul(back, matrix[:-DIM].T, out=self._space("e", n, CONTEXT * DIM))
        self._step("e", before, e.reshape(-1, DIM))
        self.matrix_sums += gradient * gradient
        matrix += np.float32(RATE) * gradient / np.sqrt(self.matrix_sums)

    def train(self, docs: list[np.ndarray]) -> None:
        target, before, bag = contexts(self.p.e, docs)
        before, bag = _items(before), _items(bag)
        order = self.g.permutation(len(target))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            self.batch(target.take(some), before.take(some).view(np.int64).reshape(-1, CONTEXT), bag.take(some).view(np.float32).reshape(-1, DIM))


class Vocabulary:
    """Classes and counts of the head words, classes of suffixes, sizes of classes; bounded by HEAD words."""

    def __init__(self, head: list[tuple[bytes, int]], shared: list[tuple[bytes, int, int]], total: int, types: int, own: int):
        """head: words by falling count; shared: (suffix, tokens, types) of words without a class of their own, the classes first, then one row for the rest."""
        self.total, self.types = total, types
        self.suffix = {s: own + 1 + i for i, (s, _, _) in enumerate(shared[:-1])}
        self.other = own + len(shared)
        self.classes = self.other + 1
        sizes = [1.0] * (own + 1) + [float(n + v + 1) for _, n, v in shared]
        self.log_size = np.log10(sizes)
        # Class own is the end token, which is in every training text.
        self.words = {w: i for i, (w, _) in enumerate(head)}
        # The last entry stands for words that aren't in the head.
        self.word_class = np.array([i if i < own else self.suffix.get(w[-3:], self.other) for i, (w, _) in enumerate(head)] + [self.other], np.int64)
        self.word_log = np.append(np.log10(np.array([c for _, c in head], float) + 1.0), 0.0)
        self.own = own


def _added(counts: pa.Table) -> pa.Table:
    """One row a word."""
    return counts.group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])


def _counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) over all rows of docs (text). A task's counter is sent on before it grows too large."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        for batch in batches:
            words, _ = words_of(batch.column(0))
            found = words.value_counts()
            ends = pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([batch.num_rows], pa.int64())})
            seen = pa.concat_tables([seen, pa.table({"word": found.field(0), "n": found.field(1)}), ends])
            if seen.num_rows > 2 * COUNTER_LIMIT:
                seen = _added(seen)
                if seen.num_rows > COUNTER_LIMIT:
                    yield from seen.to_batches()
                    seen = seen.slice(0, 0)
        yield from _added(seen).to_batches()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_numbers(types: int) -> tuple[int, int]:
    """How many words have classes of their own and how many suffixes have one: together twice the root of types, three to one."""
    root = math.isqrt(types)
    return max(OWN, root * 3 // 2), max(SHARED, root // 2)


def vocabulary(counts: DataFrame, own: int | None = None, shared: int | None = None, head: int = HEAD) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the classes' token counts. At most head words and shared suffixes reach the driver;
    without own and shared the corpus's number of types decides."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    grown = class_numbers(sums.v)
    own, shared = grown[0] if own is None else own, grown[1] if shared is None else shared
    # The least count of a head word, from a histogram of counts by eighths of octaves: a few hundred rows, no sort.
    step = F.floor(F.log2("n") * 8)
    least, room = None, head
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        if r.n > room:
            break
        least, room = r.step, room - r.n
    frequent = counts.where((F.col("word") != F.lit(END)) & (step >= least)) if least is not None else counts.limit(0)
    words = sorted(((bytes(r.word), r.n) for r in frequent.select("word", "n").collect()), key=lambda x: (-x[1], x[0]))
    ends = [r.n for r in counts.where(F.col("word") == F.lit(END)).collect()]
    own = min(own, len(words))
    chosen = [w for w, _ in words[:own]]
    rest = counts.where(~F.col("word").isin([END, *chosen]))
    suffixes = rest.groupBy(F.substring("word", -3, 3).alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    top = [(bytes(r.s), r.n, r.v) for r in suffixes.orderBy(F.desc("n"), "s").limit(shared).collect()]
    rest_sums = rest.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    other = (b"", rest_sums.n - sum(n for _, n, _ in top), rest_sums.v - sum(v for _, _, v in top))
    voc = Vocabulary(words, [*top, other], sums.n, sums.v, own)
    tokens = np.array([n for _, n in words[:own]] + [sum(ends)] + [n for _, n, _ in top] + [other[1]], float)
    return voc, tokens


def _encoded(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """docs (rid, doc_id, held_out, text) -> classes as bytes, and what needs no context: sums over the head words, sizes of
    classes, and hashes of the words whose counts are to be joined."""
    shared = docs.sparkSession.sparkContext.broadcast(voc)
    kind = class_type(voc.classes)
    fields = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "head", "sizes", "ids", "tail"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        get, suffix, other, absent = v.words.get, v.suffix.get, v.other, len(v.words)
        known_end = int(v.total > 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            words, starts = words_of(batch.column(3))
            # Each word of the batch is looked up once.
            coded = words.dictionary_encode()
            types = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            at = np.fromiter(map(get, types, repeat(absent)), np.int64, len(types))
            kinds, rare = v.word_class[at], np.flatnonzero(at == absent)
            tail = [types[i] for i in rare]
            kinds[rare] = [suffix(w[-3:], other) for w in tail]
            hashes = np.zeros(len(types), np.int64)
            hashes[rare] = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in tail), np.uint64, len(tail)).view(np.int64)
            # One more type for the end token, which closes every text.
            kinds, logs = np.append(kinds, v.own), np.append(v.word_log[at], 0.0)
            tokens = np.insert(coded.indices.to_numpy(), starts[1:], len(types))
            begins = starts + np.arange(len(starts))
            totals = lambda x, tokens=tokens, begins=begins: np.add.reduceat(x[tokens], begins[:-1])
            is_rare = np.append(at == absent, False)
            tails = np.concatenate([[0], np.cumsum(totals(is_rare.astype(np.int64)))])
            n = np.diff(begins)
            head = np.column_stack([totals(logs), totals(np.where(kinds > v.own, logs, 0.0))])
            ids = kinds.astype(kind)[tokens]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array(n, pa.int64()), pa.array(n - np.diff(tails) - 1 + known_end, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * 2, pa.int32()), pa.array(head.ravel())), pa.array(totals(v.log_size[kinds])),
                    pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((begins * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)]),
                    pa.ListArray.from_arrays(pa.array(tails, pa.int32()), pa.array(hashes[tokens[is_rare[tokens]]])),
                ],
                fields,
            )

    return docs.select("rid", "doc_id", "held_out", "text").mapInArrow(encode, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, head array<double>, sizes double, ids binary, tail array<long>")


def class_type(classes: int) -> type:
    return np.uint16 if classes <= 1 << 16 else np.uint32


def _grouped(batches: Iterator[pa.RecordBatch], column: int, limit: int, kind: type) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    """Runs of rows with about limit tokens: (batch, first row, their classes); a longer text is a run of its own."""
    for batch in batches:
        first, size, run = 0, 0, []
        for i, ids in enumerate(batch.column(column)):
            a = np.frombuffer(ids.as_py(), kind)
            if run and size + len(a) > limit:
                yield batch, first, run
                first, size, run = i, 0, []
            run.append(a)
            size += len(a)
        if run:
            yield batch, first, run


SENT = "i int, part int, v binary, n long"


def _average(rows: pa.Table) -> pa.Table:
    """The mean of v, float32 arrays, weighted by n."""
    total, n = 0.0, 0
    for v, w in zip(rows["v"], rows["n"].to_pylist(), strict=True):
        total, n = total + np.frombuffer(v.as_py(), np.float32).astype(np.float64) * w, n + w
    return pa.table({"i": rows["i"][:1], "part": rows["part"][:1], "v": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})


def train(encoded: DataFrame, tokens: np.ndarray, *, rounds: int = ROUNDS) -> Parameters:
    """Parameters after rounds over encoded (rid, ids); a round takes the rows whose rid leaves its number. Each task sends its
    parameters in blocks; a block is averaged by tokens, first over every TASKS tasks, then over what these give."""
    unigram = (tokens + 1.0) / (tokens.sum() + len(tokens))
    kind = class_type(len(tokens))
    p = Parameters(unigram)
    for r in range(rounds):
        start = p.flat()

        def work(batches: Iterator[pa.RecordBatch], r: int = r, start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            settle_worker()
            own = Parameters(unigram).load(start)
            trainer, seen = Trainer(own, unigram, 100 + r), 0
            for _, _, docs in _grouped(batches, 0, 8 * CHUNK, kind):
                trainer.train(docs)
                seen += sum(map(len, docs))
            if seen:
                values = own.flat()
                blocks = [values[i : i + BLOCK].tobytes() for i in range(0, len(values), BLOCK)]
                part = TaskContext.get().partitionId() // TASKS
                yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.binary()), pa.array([seen] * len(blocks), pa.int64())], ["i", "part", "v", "n"])

        sent = encoded.where(F.pmod("rid", F.lit(rounds)) == r).select("ids").mapInArrow(work, SENT)
        near = sent.groupBy("i", "part").applyInArrow(_average, SENT)
        mean = sorted((x.i, bytes(x.v)) for x in near.groupBy("i").applyInArrow(_average, SENT).select("i", "v").collect())  # the model
        if mean:
            p.load(np.frombuffer(b"".join(v for _, v in mean), np.float32))
    return p


def score_documents(docs: DataFrame, *, modulus: int = 7, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", modulus).alias("held_out"), F.col("text").cast("binary").alias("text"))
    counts = stage_table(_counts(rows.where("not held_out")), "lm-counts")
    voc, tokens = vocabulary(counts)
    encoded = stage_table(_encoded(rows.withColumn("rid", F.monotonically_increasing_id()), voc), "lm-encoded")
    model = train(encoded.where("not held_out"), tokens, rounds=rounds)
    base = float(np.log10(voc.total + voc.types + 1.0))
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), class_type(voc.classes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle_worker()
        p = Scorer(shared.value)
        for batch, first, run in _grouped(batches, 1, CHUNK, kind):
            lengths = np.array([len(d) for d in run])
            out = []
            if len(run) == 1 and lengths[0] > CHUNK:  # a long text in pieces that overlap by what the model looks back
                text, total = run[0], 0.0
                for i in range(0, len(text), CHUNK):
                    back = min(i, BAG)
                    total += float(p.log_probabilities([text[i - back : i + CHUNK]])[back:].sum())
                out.append(total)
            else:
                logs = p.log_probabilities(run).astype(np.float64)
                out = np.add.reduceat(logs, np.cumsum(lengths) - lengths).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(run)), pa.array(np.array(out) / np.log(10.0))], ["rid", "neural"])

    neural = encoded.select("rid", "ids").mapInArrow(score, "rid long, neural double")
    rare = counts.select(F.xxhash64("word").alias("h"), F.log10(F.col("n") + 1.0).alias("log_count"))
    tails = encoded.select("rid", F.explode("tail").alias("h")).join(rare, "h").groupBy("rid").agg(F.sum("log_count").alias("t_log"), F.count("*").alias("t_known"))
    out = encoded.drop("ids", "tail").join(neural, "rid").join(tails, "rid", "left")
    rest = F.coalesce("t_log", F.lit(0.0))
    end = float(np.log10(tokens[voc.own] + 1.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("t_known", F.lit(0))).alias("n_known"), F.lit(voc.total).cast("long").alias("train_tokens"),
        (F.col("head")[0] + rest + end - F.col("n_tokens") * base).alias("base_score"), (F.col("neural") + F.col("head")[1] + rest - F.col("sizes")).alias("score"),
    )
