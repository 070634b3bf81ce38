"""Language-model scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax.

P(w | h) = P(class of w | h) P(member | class, h), both softmaxes over hashed features of
the words before. The members of a class are its most frequent words and one that stands
for all others, its rest. The rest of a class is a tree with sixteen branches at each node, by digits of the
word's hash, as deep as the vocabulary needs: P(digit | node, h) is a softmax of the same kind, and the words of a
leaf share its probability by their training counts, smoothed. So every word has weights that
depend on the words before it, and the probabilities of all words, unknown ones included, add up to 1.

Tokens are known by a 64-bit hash. Counts cover all training tokens. Gradients are taken on
the executors. Texts are dealt to the rounds by a hash of their ids, so that each is learned from
once in all; in a round each partition goes through its texts of that round from the weights of the round before, and the
weights are then averaged over the partitions, by how often each row was used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from textloom.llm._bytes import PLAIN, U64, Words, mix, release, slices
from textloom.llm._spark import written

CLASSES = 32
#: Members of a class with weights of their own; one more stands for the rest.
MEMBERS = 47
#: Branches of a node of a class's rest, four bits of the hash, and the deepest tree: its leaves, two million with all classes, are broadcast.
BRANCHES = 16
DEEPEST = 4
#: Words of a leaf from which a tree is deeper.
LEAF_WORDS = 64
PAIRS = (CLASSES + 1) ** 2
BATCH = 8192
RATE = 0.2
ROUNDS = 2
#: Tokens of a round that are planned for one task, and the tasks of a round at least: each sends a model of changes.
TASK_TOKENS = 1 << 22
LEAST_TASKS = 12
#: Weight rows travel in packs of so many.
PACK = 1024
_SLOT_BITS = 18
#: The most frequent tokens whose counts are broadcast (16 bytes each); all others' counts are joined.
BROADCAST_TOKENS = 1 << 19
END = U64(0xE0D0E0D0E0D0E0D0)
_BEGIN = U64(0xB0B0B0B0B0B0B0B0)
_SPREAD = U64(0xD6E8FEB86659FD93)
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(b".,;:!?")] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += U64(32)


class Tokens:
    """Token hashes and classes of a slice of texts, each text followed by its end token."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        words = Words(data, offs, PLAIN)
        n = len(offs) - 1
        self.bounds = words.bounds + np.arange(n + 1)
        place = np.arange(len(words.starts)) + words.document()
        self.hash = np.full(len(words.starts) + n, END, U64)
        self.cls = np.zeros(len(self.hash), np.int64)
        if len(place):
            self.hash[place] = words.hashes()
            # The class is a hash of the word's last three bytes before a closing mark.
            stop = words.ends - (_PUNCTUATION[data[words.ends - 1]] & (words.ends - words.starts > 1))
            tail = np.zeros(len(stop), U64)
            for back in (1, 2, 3):
                at = stop - back
                tail = (tail << U64(8)) | np.where(at >= words.starts, _LOWER[data[np.maximum(at, 0)]], U64(0))
            self.cls[place] = (mix(tail) >> U64(40)).astype(np.int64) % CLASSES
        self.at = np.arange(len(self.hash)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))

    def before(self, values: np.ndarray, k: int, begin) -> np.ndarray:
        out = np.full(len(values), begin, values.dtype)
        out[k:] = values[: len(values) - k] if k < len(values) else values[:0]
        out[self.at < k] = begin
        return out


def depth_for(distinct: int) -> int:
    """The depth of the trees for a vocabulary."""
    depth = 0
    while depth < DEEPEST and distinct > CLASSES * BRANCHES**depth * LEAF_WORDS:
        depth += 1
    return depth


def bits_for(distinct: int) -> int:
    """Bits of the rows of hashed features for a vocabulary; a partition's rows are what travels in a round."""
    return min(14, max(12, distinct.bit_length() - 4))


#: Tables of weights: five for the class, three for the member, one hashed for all trees, and one of nodes for each of their levels.
CLASS_TABLES, MEMBER_TABLES, TREE_TABLE = range(0, 5), range(5, 8), 8


class Model:
    """Weights, the words that are members, and what the leaves of the rest count.

    head: sorted hashes of the members, with their class and count. leaf_n, leaf_v: tokens and
    distinct words of each leaf, class by class, without the members.
    """

    def __init__(self, head: np.ndarray, head_cls: np.ndarray, head_n: np.ndarray, leaf_n: np.ndarray, leaf_v: np.ndarray, bits: int):
        self.head, self.bits = head, bits
        self.depth = round(np.log2(len(leaf_n) // CLASSES)) // 4
        self.member = np.full(len(head) + 1, MEMBERS, np.int64)
        self.head_n = head_n
        # Heads by the first bits of their hashes: those of one slot stand in one table after the other.
        self.known = np.append(head, U64(0))
        slot = (head >> U64(64 - _SLOT_BITS)).astype(np.int64)
        turn = np.arange(len(head)) - np.searchsorted(slot, slot)
        self.slots = [np.full(1 << _SLOT_BITS, len(head), np.int32) for _ in range(int(turn.max(initial=0)) + 1)]
        for k, table in enumerate(self.slots):
            table[slot[turn == k]] = np.flatnonzero(turn == k)
        self.leaf = leaf_n + 0.1 * (leaf_v + 1)
        masses = [self.leaf]  # of the nodes, level by level, from the leaves up
        for _ in range(self.depth):
            masses.append(masses[-1].reshape(-1, BRANCHES).sum(axis=1))
        masses.reverse()
        rest, mass = masses[0], np.zeros((CLASSES, MEMBERS + 1))
        for c in range(CLASSES):
            own = np.flatnonzero(head_cls == c)
            own = own[np.lexsort((head[own], -head_n[own]))]
            self.member[own] = np.arange(len(own))
            mass[c, : len(own)] = head_n[own]
        mass[:, MEMBERS] = rest
        total = mass.sum(axis=1)
        with np.errstate(divide="ignore"):
            prior = np.maximum(np.log(mass / total[:, None]), -1e4).astype(np.float32)
        zeros = lambda rows, width: np.zeros((rows, width), np.float32)
        rows = 1 << bits
        # Tables that every token has one row of begin with the logarithms of the shares.
        self.tables = [zeros(rows, CLASSES), zeros(rows, CLASSES), zeros(rows, CLASSES), np.tile(np.log(total / total.sum()).astype(np.float32), (PAIRS, 1)), zeros(PAIRS, CLASSES)]
        self.tables += [zeros(2 * rows, MEMBERS + 1), np.repeat(prior, CLASSES + 1, axis=0), zeros(CLASSES * (CLASSES + 1), MEMBERS + 1)]
        self.tables.append(zeros(4 * rows, BRANCHES))
        for level in range(self.depth):
            self.tables.append((np.log(masses[level + 1].reshape(-1, BRANCHES)) - np.log(masses[level])[:, None]).astype(np.float32))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each token among the heads; the number of heads for all other words."""
        slot = (hashes >> U64(64 - _SLOT_BITS)).astype(np.int64)
        out = self.slots[0].take(slot)
        for more in self.slots[1:]:
            again = np.flatnonzero(self.known.take(out) != hashes)
            out[again] = more.take(slot[again])
        out[self.known.take(out) != hashes] = len(self.head)
        return out

    def members(self, hashes: np.ndarray) -> np.ndarray:
        """The member of each token in its class; the last stands for all other words."""
        return self.member.take(self.places(hashes))

    def leaves(self, hashes: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """The leaf of each token, were it of the rest."""
        return (cls << 4 * self.depth) + leaf_digits(hashes, self.depth)


def leaf_digits(hashes: np.ndarray, depth: int) -> np.ndarray:
    return ((hashes >> U64(8)) & U64((1 << 4 * depth) - 1)).astype(np.int64)


#: (table, row of each token) of one feature; (features, target of each token) of one softmax.
Feature = tuple[int, np.ndarray]


class Softmaxes:
    """What a slice's tokens ask of a model: features and targets of the class, the member, and each level of the rest's tree for the tokens there."""

    def __init__(self, model: Model, t: Tokens):
        w1, w2 = t.before(t.hash, 1, _BEGIN), t.before(t.hash, 2, _BEGIN)
        c1, c2, c3, c4 = (t.before(t.cls, k, CLASSES) for k in (1, 2, 3, 4))
        # Hashes go in, so that a product's first bits are as good as any.
        row = lambda x, extra=0: ((x * _SPREAD) >> U64(64 - model.bits - extra)).astype(np.int64)
        own, third = w1 + t.cls.astype(U64) * U64(0x9E3779B97F4A7C15), w1 * U64(3) + w2
        of_class = [(0, row(w1)), (1, row(w2)), (2, row(third)), (3, c1 * (CLASSES + 1) + c2), (4, c3 * (CLASSES + 1) + c4)]
        of_member = [(5, row(own, 1)), (6, t.cls * (CLASSES + 1) + c1), (7, t.cls * (CLASSES + 1) + c2)]
        self.place = model.places(t.hash)
        self.member = model.member.take(self.place)
        self.parts: list[tuple[list[Feature], np.ndarray, np.ndarray | None]] = [(of_class, t.cls, None), (of_member, self.member, None)]
        self.rest = np.flatnonzero(self.member == MEMBERS)
        self.leaf = model.leaves(t.hash[self.rest], t.cls[self.rest])
        w1, c1 = w1[self.rest], c1[self.rest].astype(U64)
        for level in range(model.depth):
            below = 4 * (model.depth - level)
            node = self.leaf >> below
            key = mix(node.astype(U64) + U64((level + 1) << 48))
            features = [(TREE_TABLE, row(key + w1, 2)), (TREE_TABLE, row(key * U64(5) + c1, 2)), (TREE_TABLE + 1 + level, node)]
            self.parts.append((features, self.leaf >> below - 4 & BRANCHES - 1, self.rest))


def _exponentials(tables: list[np.ndarray], features: list[Feature], a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits, exponentials, their sums) of tokens a to b. Logits begin at the logarithms of shares and stay near; a row that leaves the range of floats is moved back."""
    x = tables[features[0][0]].take(features[0][1][a:b], axis=0)
    for k, rows in features[1:]:
        x += tables[k].take(rows[a:b], axis=0)
    with np.errstate(over="ignore"):
        e = np.exp(x)
    total = e @ np.ones(e.shape[1], np.float32)
    far = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))
    if len(far):
        x[far] -= x[far].max(axis=1, keepdims=True)
        e[far] = np.exp(x[far])
        total[far] = e[far].sum(axis=1)
    return x, e, total


def log_probabilities(model: Model, t: Tokens) -> tuple[np.ndarray, Softmaxes]:
    """Natural logarithms of the tokens' probabilities, without the share within a leaf."""
    s, out = Softmaxes(model, t), np.zeros(len(t.hash))
    for features, target, where in s.parts:
        for a in range(0, len(target), BATCH):
            b = min(a + BATCH, len(target))
            x, _, total = _exponentials(model.tables, features, a, b)
            got = x[np.arange(b - a), target[a:b]] - np.log(total)
            if where is None:
                out[a:b] += got
            else:
                out[where[a:b]] += got
    return out, s


class Trainer:
    """Gradient steps on a partition's own copy of the weights, with a step size for each row."""

    def __init__(self, model: Model, rate: float = RATE):
        self.model, self.rate = model, rate
        self.tables = [x.copy() for x in model.tables]
        self.seen = [np.full(len(x), 1e-6, np.float32) for x in model.tables]
        self.used = [np.zeros(len(x), np.int64) for x in model.tables]

    def _apply(self, k: int, rows: np.ndarray, grad: np.ndarray) -> None:
        small = len(self.tables[k]) <= 1 << 16
        order = np.argsort(rows.astype(np.uint16), kind="stable") if small else np.argsort(rows)  # the first is a radix sort
        ordered = rows[order]
        start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        row, n = ordered[start], np.diff(np.append(start, len(rows)))
        total = grad.take(order[start], axis=0)
        often = n > 1
        if often.any():
            own = grad.take(order[np.repeat(often, n)], axis=0)
            # Pairs of floats are added as one number each.
            total[often] = np.add.reduceat(own.view(np.complex64), np.cumsum(n[often]) - n[often], axis=0).view(np.float32)
        seen = self.seen[k][row] + np.einsum("ij,ij->i", total, total) / total.shape[1]
        self.seen[k][row] = seen
        self.used[k][row] += n
        total *= (-self.rate / np.sqrt(seen))[:, None]
        total += self.tables[k].take(row, axis=0)
        self.tables[k][row] = total

    def learn(self, t: Tokens) -> None:
        for features, target, _ in Softmaxes(self.model, t).parts:
            for a in range(0, len(target), BATCH):
                b = min(a + BATCH, len(target))
                _, grad, total = _exponentials(self.tables, features, a, b)
                grad *= (1 / total)[:, None]
                grad[np.arange(b - a), target[a:b]] -= 1
                for k, rows in features:
                    self._apply(k, rows[a:b], grad)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, cls, n of the tokens of a partition; folded whenever many are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        token, cls = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(token)
        token = token[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        n = np.diff(np.append(first, len(token)))
        return pa.RecordBatch.from_arrays([pa.array(token[first].view(np.int64)), pa.array(cls[order[first]].astype(np.int32)), pa.array(n)], names=["token", "cls", "n"])

    for batch in batches:
        for _, _, data, offs in slices(batch.column(0)):
            t = Tokens(data, offs)
            held.append((t.hash, t.cls.astype(np.uint8)))
            size += len(t.hash)
            if size >= 6_000_000:
                yield flush()
                size = 0
    if held:
        yield flush()


_PACKS = "part int, pack int, rows binary, used binary, weights binary"
_PACK_TYPE = pa.schema([("part", pa.int32()), ("pack", pa.int32()), ("rows", pa.binary()), ("used", pa.binary()), ("weights", pa.binary())])


def _round(shared, rate: float):
    """The changes of the rows that a partition uses, as packs; half precision is enough for a change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        trainer = Trainer(model, rate)
        for batch in batches:
            for _, _, data, offs in slices(batch.column(0)):
                trainer.learn(Tokens(data, offs))
        for k, (new, old, used) in enumerate(zip(trainer.tables, model.tables, trainer.used, strict=True)):
            rows = np.flatnonzero(used)
            for own in np.split(rows, np.flatnonzero(np.diff(rows // PACK)) + 1) if len(rows) else ():
                values = (k, int(own[0]) // PACK, (own % PACK).astype(np.int16).tobytes(), used[own].tobytes(), (new[own] - old[own]).astype(np.float16).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _PACK_TYPE.types, strict=True)], schema=_PACK_TYPE)
        del trainer
        release()

    return run


def _average(width: dict[int, int]):
    """Means of each row's change over the partitions that used it; only the sums of the packs at hand are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                key = r["part"], r["pack"]
                if key not in sums:
                    sums[key] = np.zeros((PACK, width[r["part"]])), np.zeros(PACK, np.int64)
                total, times = sums[key]
                rows, used = np.frombuffer(r["rows"], np.int16), np.frombuffer(r["used"], np.int64)
                total[rows] += used[:, None] * np.frombuffer(r["weights"], np.float16).reshape(len(rows), -1)
                times[rows] += used
        for (part, pack), (total, times) in sums.items():
            rows = np.flatnonzero(times)
            values = (part, pack, rows.astype(np.int16).tobytes(), b"", (total[rows] / times[rows, None]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _PACK_TYPE.types, strict=True)], schema=_PACK_TYPE)

    return run


class Lookup:
    """Counts of the broadcast tokens by hash: entries in order of their hashes, entered at the hash's first 22 bits."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.index: np.ndarray | None = None

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The count of each token, 0 where it is not held."""
        if self.index is None:
            self.index = np.searchsorted(self.hashes, np.arange((1 << 22) + 1, dtype=U64) << U64(42)).astype(np.int32)
            self.index[-1] = len(self.hashes)
        out = np.zeros(len(wanted), np.int64)
        top = (wanted >> U64(42)).astype(np.int64)
        at, end = self.index[top], self.index[top + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.hashes[here] == wanted[left]
            out[left[hit]] = self.counts[here[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


_SCORED = "row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<token:long,times:long>>"
_RARE = pa.list_(pa.struct([("token", pa.int64()), ("times", pa.int64())]))


def _score(shared, lookup, base_total: float):
    log_base = np.log10(base_total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = shared.value, lookup.value
        log_leaf, log_head = np.log10(model.leaf), np.append(np.log10(model.head_n + 0.1), 0.0)
        next_row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, end, data, offs in slices(batch.column(1)):
                t = Tokens(data, offs)
                score, s = log_probabilities(model, t)
                # log10(count + 0.1) of the tokens that are not in the lookup is added by the join.
                n = counts.find(t.hash[s.rest])
                own = np.where(n > 0, np.log10(n + 0.1), 0.0)
                share, known = log_head.take(s.place), np.ones(len(score), dtype=bool)
                share[s.rest], known[s.rest] = own, n > 0
                score /= np.log(10)
                score[s.rest] += own - log_leaf[s.leaf]
                sums = [np.add.reduceat(x, t.bounds[:-1]) for x in (share - log_base, score, known.astype(np.int64))]
                rare = []
                unknown = np.flatnonzero(~known)
                edges = np.searchsorted(unknown, t.bounds)
                for d in range(end - first):
                    token, times = np.unique(t.hash[unknown[edges[d] : edges[d + 1]]].view(np.int64), return_counts=True)
                    rare.append((token, times))
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate([x for x, _ in rare]), pa.int64()), pa.array(np.concatenate([x for _, x in rare]).astype(np.int64), pa.int64())], names=["token", "times"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) for x, _ in rare)]), pa.int32()), flat)
                rows = np.arange(next_row, next_row + end - first)
                next_row += end - first
                yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0).slice(first, end - first), pa.array(np.diff(t.bounds)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1]), lists], names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "rare"])

    return run


def train(texts: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> tuple[Model, DataFrame, Lookup, int, int, int]:
    """(model, counts, lookup, tokens, distinct tokens, count from which tokens are in the lookup) of rows (key, text)."""
    spark = texts.sparkSession
    counted = texts.select("text").mapInArrow(_count, "token long, cls int, n long").groupBy("token").agg(F.sum("n").alias("n"), F.min("cls").alias("cls"))
    counts = written(counted.withColumn("size", F.floor(F.log2("n") * 8).cast("int")), "counts")
    by_size = counts.groupBy("size").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).orderBy(F.desc("size")).collect()
    total, distinct = sum(r["n"] for r in by_size), sum(r["k"] for r in by_size)
    held, least = 0, 1 << 30
    for r in by_size:
        if held + r["k"] > BROADCAST_TOKENS:
            break
        held, least = held + r["k"], r["size"]
    # BROADCAST_TOKENS rows of numbers at most.
    top = counts.where(F.col("size") >= least).select("token", "cls", "n").toArrow()
    token, cls, n = (top.column(i).to_numpy() for i in range(3))
    lookup = Lookup(token.view(U64), n)
    place = np.lexsort((token, -n, cls))
    token, cls, n = token[place], cls[place], n[place]
    rank = np.arange(len(cls)) - np.searchsorted(cls, cls)
    token, cls, n = token[rank < MEMBERS], cls[rank < MEMBERS], n[rank < MEMBERS]
    depth = depth_for(distinct)
    leaf = F.shiftleft(F.col("cls").cast("long"), 4 * depth) + F.shiftrightunsigned("token", 8).bitwiseAND(F.lit((1 << 4 * depth) - 1))
    # A row a leaf: CLASSES * BRANCHES ** DEEPEST at most.
    leaves = counts.groupBy(leaf.alias("leaf")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).toArrow()
    leaf_n, leaf_v = np.zeros(CLASSES << 4 * depth), np.zeros(CLASSES << 4 * depth)
    at, leaf_counts, leaf_words = (leaves.column(i).to_numpy() for i in range(3))
    leaf_n[at], leaf_v[at] = leaf_counts, leaf_words
    own = (cls.astype(np.int64) << 4 * depth) + leaf_digits(token.view(U64), depth)
    np.subtract.at(leaf_n, own, n)
    np.subtract.at(leaf_v, own, 1)
    order = np.argsort(token.view(U64))
    model = Model(token.view(U64)[order], cls[order], n[order], leaf_n, leaf_v, bits_for(distinct))
    width = {k: x.shape[1] for k, x in enumerate(model.tables)}
    tasks = max(LEAST_TASKS, -(-total // (rounds * TASK_TOKENS)))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        steps = texts.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(rounds)) == r).select("text").coalesce(tasks).mapInArrow(_round(shared, rate), _PACKS)
        for x in steps.repartition("part", "pack").mapInArrow(_average(width), _PACKS).toLocalIterator():  # the model's rows
            rows = x["pack"] * PACK + np.frombuffer(x["rows"], np.int16).astype(np.int64)
            model.tables[x["part"]][rows] += np.frombuffer(x["weights"], np.float32).reshape(len(rows), -1)
        shared.unpersist()
    return model, counts, lookup, total, distinct, least


def score(docs: DataFrame, learn, rounds: int = ROUNDS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row; a null text is empty and has its end token alone.

    learn: the condition of the rows that are learned from. With none, every token is unknown.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("long").alias("key"), F.col(text).cast("string").alias("text"), learn.alias("learn"))
    model, counts, lookup, total, distinct, least = train(rows.where("learn").select("key", "text"), rounds)
    scored = rows.select("key", "text").mapInArrow(_score(spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(lookup), total + 0.1 * (distinct + 1)), _SCORED)
    scored = written(scored, "scored")
    # Tokens outside the lookup: their counts meet them by a shuffle.
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.times")
    met = rare.join(counts.where(F.col("size") < least).select("token", "n"), "token", "left")
    more = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    both = scored.join(more, "row", "left")
    extra, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return both.select("doc_id", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("score") + extra).alias("score"))
