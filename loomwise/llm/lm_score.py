"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

The probability of a token is that of its class, given features of the tokens
before it, times that of the token in its class, given the token before it. Both
factors are maximum-entropy models. Class weights are one row per hashed feature
(the last word, the words two and three back as skips, and the last pair), added
up and put through a softmax; a class holds the words with one ending, so that
unseen words have a class too. Inside a class the weights are one per distinct
pair of last word and word, on top of the words' smoothed shares; the sum over
the class needs only the pairs met in training, so it is exact. The commonest
``head`` words (a bound on what is broadcast) are units of their own, the others
of a class are one unit, in which words have their smoothed shares.

What is learned grows with the corpus. Each token is an event that is dealt to a
shard by the word before it; there is a shard for every SHARD training tokens,
with weight rows of its own, so that rows and pairs grow with the tokens. Words
so common that they would fill a shard are dealt to several, by the documents. A shard is one task: it makes AdaGrad steps on sparse rows in numpy over
its training events, then diagonal Newton steps on its pairs, and then scores
all its events. Only sums by document leave it. Events travel as packed blocks
of a few bytes each; no task holds more than a shard.

Counts cover all training documents and stay distributed: head words are scored
where the text is read, all rarer ones by a join of their counts.

Base score: sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))).

Defined results. A null or empty text is one end token. A null doc_id is neither
held out nor learned from. Rows that repeat are scored each. Without training
documents every base probability is 1 and classes are equally likely.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwise.llm.common import row_key, slices, written

#: Stands for the end of a text; no word holds a space.
END = b" "
HEAD = 200_000
CLASSES = 32  # 256 at most
#: Weight rows of a shard, and the training tokens that a shard is meant for.
DIM, SHARD = 1 << 16, 2_000_000
#: Texts taken at once, and their bytes.
ROWS, SIZE = 512, 2 << 20
CACHE = 300_000
#: Tokens of one gradient step.
STEP = 4096
#: Events and documents that a task collects before it packs them.
EVENTS, DOCS = 1 << 20, 1 << 13
#: Bits of a packed unit; a document's number, and the bit that keeps its events from training, have the rest of 32.
UNIT, HELD = 18, DOCS
#: Variance of the prior of the pairs' weights, and steps to find them.
PRIOR, NEWTON = 4.0, 8
LN10 = float(np.log(10))
#: The feature hashes' multipliers, and what stands for a place before the text.
ODD = (0x9E3779B1, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)
BEFORE = (1, 2, 3)


def tokens_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; ``bytes`` methods know ASCII letters and white space only."""
    return text.encode("utf-8").lower().split() if text else []


def count_tokens(docs: DataFrame) -> DataFrame:
    """token and its count c over all documents, each with an end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])
            seen.clear()
            return batch

        for b in batches:
            for part in slices(b, ROWS, SIZE):
                for t in part.column("text").to_pylist():
                    seen.update(tokens_of(t))
                seen[END] += part.num_rows
                if len(seen) > CACHE:
                    yield out()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


def ending(token: Column) -> Column:
    return F.substring(token, -2, 2)


class Classes:
    """Classes by ending: the end token, the commonest endings one by one, all others by a hash."""

    def __init__(self, endings: list[str], n: int = CLASSES):
        self.n, self.of = n, {e: k + 1 for k, e in enumerate(endings)}
        self.first = len(endings) + 1
        self.short = {e.encode("utf-8"): k for e, k in self.of.items() if e.isascii() and len(e) == 2}

    @staticmethod
    def learn(counts: DataFrame, n: int = CLASSES) -> Classes:
        top = counts.where(F.col("token") != " ").groupBy(ending(F.col("token")).alias("e")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "e").limit(n * 3 // 4)
        return Classes([r["e"] for r in top.collect()], n)

    def __call__(self, token: bytes) -> int:
        k = self.short.get(token[-2:])  # two ASCII bytes are the last two characters
        if k is not None:
            return k
        if token == END:
            return 0
        e = token.decode("utf-8")[-2:]
        return self.of.get(e) or self.first + crc32(e.encode("utf-8")) % (self.n - self.first)

    def column(self, token: Column) -> Column:
        e = ending(token)
        rest = F.lit(self.first) + F.pmod(F.crc32(F.encode(e, "utf-8")), F.lit(self.n - self.first))
        known = F.create_map(*[F.lit(x) for pair in self.of.items() for x in pair]) if self.of else None
        return F.when(token == " ", 0).otherwise(F.coalesce(F.try_element_at(known, e), rest) if self.of else rest).cast("int")


class Model:
    """What tasks need: classes and head counts; of fixed size whatever the corpus."""

    def __init__(self, classes: Classes, head: dict[bytes, int], n: int, v: int, class_n: np.ndarray, class_v: np.ndarray, shard: int = SHARD):
        if len(head) + classes.n > 1 << UNIT:
            raise ValueError(f"the head and the classes are more than {1 << UNIT} units")
        self.classes, self.n, self.v, self.class_n, self.class_v = classes, n, v, class_n, class_v
        self.total = class_n + 0.1 * (class_v + 1)
        self.bias = np.log(self.total / self.total.sum()).astype(np.float32)
        self.unit = {w: k for k, w in enumerate(head)}
        self.count = np.fromiter(head.values(), np.int64, len(head))
        self.shards = max(1, -(-n // shard))
        # the classes of all units, and their shares in them; the last units hold the other words of a class
        self.cls = np.concatenate([np.fromiter(map(classes, head), np.int64, len(head)), np.arange(classes.n)])
        known = np.bincount(self.cls[: len(head)], self.count + 0.1, classes.n)
        self.rest = np.maximum(self.total - known, 0.1)
        self.share = np.concatenate([self.count + 0.1, self.rest]) / self.total[self.cls]
        # of how many shards the events after a word are
        self.spread = np.maximum(1, -(-4 * self.count // shard)).astype(np.int64) if n else self.count
        self.first_spread = int(self.spread[self.unit[END]]) if END in self.unit else 1  # as many texts begin as end

    def unit_of(self, w: bytes) -> int:
        k = self.unit.get(w)
        return len(self.unit) + self.classes(w) if k is None else k


class _Codes(dict):
    """A number for each token, with its hash and unit."""

    def __init__(self, m: Model):
        super().__init__()
        self.m = m
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.names: list[bytes] = []
        self.hash, self.unit = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        assert self[END] == 0

    def __missing__(self, w: bytes) -> int:
        self[w] = k = len(self.names)
        self.names.append(w)
        return k

    def complete(self) -> None:
        """Fill the arrays for the tokens that came since the last time."""
        new = self.names[len(self.hash) :]
        add = lambda a, values: np.concatenate([a, np.fromiter(values, a.dtype, len(new))])
        self.hash, self.unit = add(self.hash, map(crc32, new)), add(self.unit, map(self.m.unit_of, new))


def _spread(x: np.ndarray, odd: int, dim: int) -> np.ndarray:
    """Hashes to weight rows."""
    return ((x ^ (x >> np.uint32(15))) * np.uint32(odd)) >> np.uint32(33 - int(dim).bit_length())


def _before(h: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """The hashes of the tokens one, two and three back; place are the positions in their texts."""
    return [np.where(place >= k, np.concatenate([np.zeros(min(k, len(h)), np.uint32), h[:-k]]), np.uint32(k)) for k in BEFORE]


def _pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return one * np.uint32(0x85EBCA6B) + two


def _encode(codes: _Codes, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens of some texts, the text of each, and its position there."""
    if len(codes) > CACHE:
        codes.restart()
    flat, sizes = [], []
    for t in texts:
        toks = [codes[w] for w in tokens_of(t)]
        flat += toks
        flat.append(0)
        sizes.append(len(toks) + 1)
    codes.complete()
    doc = np.repeat(np.arange(len(texts)), sizes)
    start = np.cumsum([0, *sizes[:-1]])
    return np.array(flat, np.int64), doc, np.arange(len(flat)) - start[doc]


def _softmax(bias: np.ndarray, weights: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, their exponentials and the sums of those, a row for each token."""
    z = weights.take(f[0], 0)
    for row in f[1:]:
        z += weights.take(row, 0)
    z += bias
    if z.max(initial=0) > 60:  # exp would come near the end of float32
        z -= z.max(1, keepdims=True)
    e = np.exp(z)
    return z, e, e @ np.ones(e.shape[1], np.float32)


def _segment_sums(g: np.ndarray, of: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of g's rows ``of``, from each place in ``first`` up to the next; most are of a row or two, which need no reduction."""
    size = np.diff(first, append=len(of))
    out = g.take(of[first], 0)
    two = np.nonzero((size > 1) & (size <= 3))[0]
    out[two] += g.take(of[first[two] + 1], 0)
    three = two[size[two] == 3]
    out[three] += g.take(of[first[three] + 2], 0)
    long = np.nonzero(size > 3)[0]
    if len(long):
        n = size[long]
        start = np.cumsum(n) - n
        out[long] = np.add.reduceat(g.take(of[np.repeat(first[long] - start, n) + np.arange(n.sum())], 0), start)
    return out


def class_weights(bias: np.ndarray, f: np.ndarray, cls: np.ndarray, rate: float, dim: int = DIM) -> np.ndarray:
    """Weights of the classes, from AdaGrad steps over tokens with the feature rows f and the classes cls."""
    w, square = np.zeros((dim, len(bias)), np.float32), np.full(dim, 1e-2, np.float32)
    for s in range(0, f.shape[1], STEP):
        part = f[:, s : s + STEP].astype(np.int64)
        _, g, total = _softmax(bias, w, part)
        g *= (-1 / total)[:, None]
        g[np.arange(len(g)), cls[s : s + STEP]] += 1
        rows = part.reshape(-1)
        order = np.argsort(rows.astype(np.uint16) if dim <= 1 << 16 else rows, kind="stable")
        rows = rows[order]
        first = np.nonzero(np.diff(rows, prepend=-1))[0]
        step = _segment_sums(g, order % len(g), first)
        rows = rows[first]
        square[rows] += np.einsum("ij,ij->i", step, step) / step.shape[1]
        step *= (rate / np.sqrt(square[rows]))[:, None]
        w[rows] += step
    return w


def pair_weights(n: np.ndarray, share: np.ndarray, group: np.ndarray, prior: float = PRIOR, steps: int = NEWTON) -> tuple[np.ndarray, np.ndarray]:
    """Weights of pairs (last word, unit) met n times, and the log of each group's sum over its class.

    A group is a last word with a class. Its units have their shares where they were
    not met, so its sum is 1 plus what the met ones add. The log likelihood under a
    normal prior is concave; each step moves all pairs along its gradient over the
    diagonal of its curvature.
    """
    w = np.zeros(len(n))
    size = int(group.max(initial=-1)) + 1
    met = np.bincount(group, n, size)[group]
    total = lambda: np.maximum(1 + np.bincount(group, share * np.expm1(w), size), 1e-9)
    for _ in range(steps):
        p = np.minimum(share * np.exp(w) / total()[group], 1.0)
        w += np.clip((n - met * p - w / prior) / (met * p * (1 - p) + 1 / prior), -1.5, 1.5)
        np.clip(w, -20, 20, out=w)
    return w, np.log(total())


def _pack(last: np.ndarray, rows: list[np.ndarray], unit: np.ndarray, doc: np.ndarray) -> bytes:
    """Events in the order of their last words: a last word once for a run of up to 255 events, with their number."""
    first = np.nonzero(np.diff(last, prepend=np.uint32(~last[0])))[0]
    times = np.diff(first, append=len(last))
    runs = -(-times // 255)
    lasts, sizes = np.repeat(last[first], runs), np.full(int(runs.sum()), 255, np.uint8)
    sizes[np.cumsum(runs) - 1] = times - 255 * (runs - 1)
    head = np.array([len(last), len(lasts)], np.uint32)
    # the first bytes of all numbers, then the second ones and so on: these compress, the numbers themselves hardly
    planes = [a.view(np.uint8).reshape(len(a), -1).T.tobytes() for a in [lasts, unit.astype(np.uint32) | doc.astype(np.uint32) << np.uint32(UNIT), *rows, sizes]]
    return head.tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    n, m = (int(x) for x in np.frombuffer(data, np.uint32, 2))
    planes, at, out = zstandard.ZstdDecompressor().decompress(data[8:]), 0, []
    for kind, size in ((np.uint32, m), (np.uint32, n), *[(np.uint16, n)] * 3, (np.uint8, m)):
        width = np.dtype(kind).itemsize
        flat = np.frombuffer(planes, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(flat.T).reshape(-1).view(kind))
        at += size * width
    last, both, *rows, sizes = out
    return np.repeat(last, sizes), rows, (both & np.uint32((1 << UNIT) - 1)).astype(np.int32), (both >> np.uint32(UNIT)).astype(np.uint16)


def _deal_task(m):
    """Texts to packed events by shard; the keys of a block's documents go to a shard below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = m.value
        codes, held, keys, block = _Codes(model), [], [], 0
        spread = np.concatenate([model.spread, np.ones(model.classes.n, np.int64)])

        def out() -> pa.RecordBatch:
            nonlocal block
            mine = TaskContext.get().partitionId() << 24 | block
            block += 1
            shard, last, r2, r3, rp, unit, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(shard.astype(np.uint64) << np.uint64(32) | last, kind="stable")
            shard, last, r2, r3, rp, unit, doc = (x[order] for x in (shard, last, r2, r3, rp, unit, doc))
            ends = np.concatenate([[0], np.nonzero(np.diff(shard))[0] + 1, [len(shard)]])
            data = [_pack(last[a:b], [r2[a:b], r3[a:b], rp[a:b]], unit[a:b], doc[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            ids = [int(x) for x in shard[ends[:-1]]] + [-1 - mine % model.shards]
            data.append(np.array(keys, np.int64).tobytes())
            held.clear(), keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([mine] * len(ids), pa.int64()), pa.array(data, pa.binary())], ["shard", "block", "data"])

        for whole in batches:
            for part in slices(whole, ROWS, SIZE):
                token, doc, place = _encode(codes, part.column("text").to_pylist())
                h = codes.hash[token]
                one, two, three = _before(h, place)
                times = np.concatenate([[1], spread[codes.unit[token]][:-1]])
                times[place == 0] = model.first_spread
                # a common word's events are dealt by their documents, so that no context, as of a line in most texts, is one task
                of_doc = _spread(part.column("key").to_numpy().astype(np.uint64).astype(np.uint32), ODD[2], 1 << 31).astype(np.int64)
                shard = (_spread(one, ODD[3], 1 << 31).astype(np.int64) + of_doc[doc] % times) % model.shards
                number = (doc + len(keys)).astype(np.uint16)
                number[part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)[doc]] |= np.uint16(HELD)
                rows = [_spread(x, o, DIM).astype(np.uint16) for x, o in ((two, ODD[1]), (three, ODD[2]), (_pair(one, two), ODD[3]))]
                held.append((shard.astype(np.int32), one, *rows, codes.unit[token].astype(np.uint32), number))
                keys.extend(part.column("key").to_pylist())
                if sum(len(x[0]) for x in held) >= EVENTS or len(keys) > DOCS - ROWS:
                    yield out()
        if keys:
            yield out()

    return run


def _ordered(last: np.ndarray, rows: list[np.ndarray], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of events that doesn't depend on how they came; the distinct pairs (last word, unit), and each event's pair."""
    rest = (rows[0].astype(np.uint32) * np.uint32(ODD[0]) + rows[1].astype(np.uint32) * np.uint32(ODD[1]) + rows[2].astype(np.uint32) * np.uint32(ODD[2])) >> np.uint32(UNIT)
    key = last.astype(np.uint64) << np.uint64(32) | unit.astype(np.uint64) << np.uint64(32 - UNIT) | rest.astype(np.uint64)
    order = np.argsort(key).astype(np.int32)
    pair = key[order] >> np.uint64(32 - UNIT)
    new = np.ones(len(pair), bool)
    new[1:] = pair[1:] != pair[:-1]
    of = np.empty(len(pair), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return order, pair[new], of


def _inside(pair: np.ndarray, n: np.ndarray, model: Model) -> np.ndarray:
    """Log probabilities of units in their classes, by pair (last word, unit) learned from n events.

    A pair without events has the weight 0, so it has its share of what its group's
    sum leaves; a group without learned pairs has the sum 1.
    """
    unit = (pair & np.uint64((1 << UNIT) - 1)).astype(np.int64)
    groups, group = np.unique((pair >> np.uint64(UNIT)) << np.uint64(16) | model.cls[unit].astype(np.uint64), return_inverse=True)
    met, v, log_sum = n > 0, np.zeros(len(pair)), np.zeros(len(groups))
    if met.any():
        v[met], known = pair_weights(n[met].astype(float), model.share[unit[met]], group[met])
        log_sum[: len(known)] = known
    return np.log(model.share[unit]) + v - log_sum[group]


def _shard_task(m, rate: float):
    """A shard's events to its weights, and from these to the log10 probabilities of its documents' events, by block."""
    schema = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("sums", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        model = m.value
        t = t.sort_by("block")
        blocks, data = t.column("block").to_pylist(), t.column("data").to_pylist()
        if t.column("shard")[0].as_py() < 0:
            return pa.table([blocks, data, [None] * len(blocks), [None] * len(blocks)], schema=schema)
        lasts, rows, units, docs = zip(*map(_unpack, data), strict=True)
        sizes = [len(x) for x in lasts]
        last, unit, doc = (np.concatenate(x) for x in (lasts, units, docs))
        f = np.stack([_spread(last, ODD[0], DIM).astype(np.uint16), *(np.concatenate(x) for x in zip(*rows, strict=True))])
        cls = model.cls[unit].astype(np.uint8)
        del t, data, lasts, rows, units, docs
        # what is learned, its order too, comes from the learned events alone
        order, pair, of = _ordered(last, f[1:], unit)
        canon = order[doc[order] < HELD]
        n = np.bincount(of[canon], minlength=len(pair))
        mixed = canon[np.random.default_rng(len(canon)).permutation(len(canon))]
        del last, unit, order, canon
        w = class_weights(model.bias, f[:, mixed], cls[mixed], rate)
        p = _inside(pair, n, model)[of]
        del mixed, of, pair, n
        for s in range(0, len(p), STEP):
            z, _, total = _softmax(model.bias, w, f[:, s : s + STEP].astype(np.int64))
            p[s : s + STEP] += z[np.arange(len(z)), cls[s : s + STEP]] - np.log(total)
        doc, found, sums = doc & np.uint16(HELD - 1), [], []
        for end, size in zip(np.cumsum(sizes), sizes, strict=True):
            at = doc[end - size : end]
            each = np.unique(at)
            found.append(each.tobytes())
            sums.append(np.bincount(at, p[end - size : end])[each].astype(np.float32).tobytes())
        return pa.table([blocks, [None] * len(blocks), found, sums], schema=schema)

    return run


def _block_task(t: pa.Table) -> pa.Table:
    """The documents of a block with the sums of all shards."""
    keys = next(np.frombuffer(k, np.int64) for k in t.column("keys").to_pylist() if k is not None)
    total = np.zeros(len(keys))
    for docs, sums in zip(t.column("docs").to_pylist(), t.column("sums").to_pylist(), strict=True):
        if docs is not None:
            total[np.frombuffer(docs, np.uint16)] += np.frombuffer(sums, np.float32)
    return pa.table({"key": keys, "unit_score": total / LN10})


def train(spark: SparkSession, docs: DataFrame, head: int = HEAD, shard: int = SHARD) -> tuple[Model, DataFrame]:
    """What the factors share and the table of counts (token, c, cls), from all of docs (text)."""
    counts = written(spark, count_tokens(docs), "counts")
    classes = Classes.learn(counts)
    counts = counts.withColumn("cls", classes.column(F.col("token")))
    per_class = {r["cls"]: r for r in counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n_k, v_k = (np.array([per_class[k][x] if k in per_class else 0 for k in range(classes.n)], float) for x in ("n", "v"))
    # a histogram of counts in narrow bins says which of them the head can hold
    bin_ = F.floor(F.log2("c") * 16)
    cut, held = 1 << 30, 0
    for r in sorted(counts.groupBy(bin_.alias("b")).count().collect(), reverse=True):
        held += r["count"]
        if held > head:
            break
        cut = r["b"]
    top = counts.where(bin_ >= cut).select("token", "c").toPandas()  # at most ``head`` rows
    words = {t.encode("utf-8"): int(c) for t, c in sorted(zip(top["token"], top["c"], strict=True))}
    return Model(classes, words, int(n_k.sum()), int(v_k.sum()), n_k, v_k, shard), counts


def _base_task(m):
    """Per document: tokens, what of the base score head words give, and the other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = m.value
        codes = _Codes(model)
        base = np.log10(model.n + 0.1 * (model.v + 1))
        log_c = np.log10(np.concatenate([model.count, np.zeros(model.classes.n)]) + 0.1)
        for whole in batches:
            for part in slices(whole, ROWS, SIZE):
                token, doc, _ = _encode(codes, part.column("text").to_pylist())
                n, unit = part.num_rows, codes.unit[token]
                known = unit < len(model.unit)
                rare = np.nonzero(~known)[0]
                each, tf = np.unique(doc[rare] * len(codes.names) + token[rare], return_counts=True)
                rare_doc, rare_token = np.divmod(each, len(codes.names))
                names = pa.array([codes.names[k] for k in rare_token.tolist()], pa.binary()).cast(pa.string())
                ends = np.searchsorted(rare_doc, np.arange(n + 1)).astype(np.int32)
                cols = [
                    *[part.column(c) for c in ("key", "doc_id", "held_out")],
                    pa.array(np.bincount(doc, minlength=n)),
                    pa.array(np.bincount(doc[known], minlength=n)),
                    pa.array(np.bincount(doc, np.where(known, log_c[unit] - base, 0.0), n)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([names, pa.array(tf, pa.int64())], ["token", "tf"])),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "rare"])

    return run


def score(spark: SparkSession, docs: DataFrame, m: Model, counts: DataFrame, rate: float = 0.25) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of docs (doc_id, held_out, text).

    The factors learn from the rows with a doc_id that aren't held out.
    """
    now = spark.sparkContext.broadcast(m)
    keyed = docs.select(F.xxhash64("doc_id", row_key(F.col("text"))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    unlearned = keyed.select("key", (F.col("held_out") | F.col("doc_id").isNull()).alias("held_out"), "text")
    dealt = unlearned.mapInArrow(_deal_task(now), "shard int, block long, data binary")
    sums = dealt.groupBy("shard").applyInArrow(_shard_task(now, rate), "block long, keys binary, docs binary, sums binary")
    of_key = sums.groupBy("block").applyInArrow(_block_task, "key long, unit_score double").groupBy("key").agg(F.max("unit_score").alias("unit_score"))
    units = written(spark, of_key, "units")

    out = "key long, doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, rare array<struct<token: string, tf: long>>"
    # the row number is drawn once, when the table is written
    each = written(spark, keyed.mapInArrow(_base_task(now), out).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = each.select("row", F.inline("rare"))
    joined = rare.join(counts.select("token", "c"), "token", "left").withColumn("cls", m.classes.column(F.col("token")))
    rest = F.array(*[F.lit(float(x)) for x in np.log10(m.rest)])
    log_c = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))
    base = F.lit(float(np.log10(m.n + 0.1 * (m.v + 1))))
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("tf") * (log_c - base)).alias("base"),
        F.sum(F.col("tf") * (log_c - F.get(rest, F.col("cls")))).alias("score"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return each.drop("rare").join(sums, "row", "left").join(units, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + zero("known")).alias("n_known"),
        F.lit(m.n).cast("long").alias("train_tokens"),
        (F.col("head_base") + zero("base")).alias("base_score"),
        (F.col("unit_score") + zero("score")).alias("score"),
    )


def op5_lm_score(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10))
    model, counts = train(spark, docs.where(part != 0))
    return score(spark, docs.withColumn("held_out", F.coalesce(part == 0, F.lit(False))), model, counts)
