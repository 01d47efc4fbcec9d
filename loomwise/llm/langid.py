"""Language ID by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces has one probability per language for each
piece. The probability of a word in a language is the sum over all ways to cut
it into pieces of the product of the pieces' probabilities, from the forward
algorithm; a text's log-probability is the sum over its words, and the score is
the posterior of the best language with the languages' shares as priors.

Probabilities are learned by expectation maximisation (forward and backward) on
the words of a bounded sample: at most ``docs_per_language`` training documents
of each language, those with the smallest hash of doc_id. Shares and prediction
cover all documents, whole texts.

Words are runs of letters, lower-cased, with a start mark. Defined results: a
null text or one without letters gives ``und`` with score 0. A document without
doc_id or lang is never learned from. Languages are told apart as they are
written, ``en`` from ``EN``. Ties go to the language that sorts first. Without
any training document every text is ``und``. Rows repeat as they come; other
columns pass through, but for those with the names of the new ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwise.llm.common import broadcast_if_small, forget, held, others, slices, written

WORD = re.compile(r"[^\W\d_]+")
START = "▁"
#: Words up to this length go through the vectorised forward pass; longer ones alone, with rescaling or in logarithms.
LONG = 40
#: Numbers held by a pass over the words of a length, or by each of the two over a long word.
CELLS = 1_000_000
#: Bytes of words and their log-probabilities that a task keeps, and what a word takes besides its numbers.
CACHE, WORD_BYTES = 48 << 20, 200
#: Text that is scored at once.
ROWS, SIZE = 1024, 2 << 20


class Pieces:
    """The letter pieces of a vocabulary as a trie in one table, states by rows and characters by columns."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        body = re.compile(rf"{START}?[^\W\d_]+|{START}")
        names = [p for p in (sp.id_to_piece(i) for i in range(sp.get_piece_size())) if body.fullmatch(p) and p == p.lower()]
        self.n = len(names) + 1  # the last stands for any other single character
        chars = sorted(set(chain.from_iterable(names)))
        self.code = {c: k + 1 for k, c in enumerate(chars)}
        rows: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for k, p in enumerate(names):
            state = 0
            for c in p:
                if self.code[c] not in rows[state]:
                    rows[state][self.code[c]] = len(rows)
                    rows.append({})
                state = rows[state][self.code[c]]
            ends[state] = k
        inner = [s for s, r in enumerate(rows) if r]  # only states with successors need a row
        row_of = {s: k for k, s in enumerate(inner)}
        wide = sorted({c for s in inner[1:] for c in rows[s]})  # characters that continue a piece
        column = {c: k + 1 for k, c in enumerate(wide)}
        self.column = np.zeros(len(chars) + 1, np.int32)
        for c, k in column.items():
            self.column[c] = k
        self.go = np.full((len(inner), len(wide) + 1), -1, np.int32)
        for s in inner[1:]:
            for c, t in rows[s].items():
                self.go[row_of[s], column[c]] = t
        self.first = np.full(len(chars) + 1, -1, np.int32)
        for c, t in rows[0].items():
            self.first[c] = t
        self.row = np.full(len(rows), -1, np.int32)
        for s, k in row_of.items():
            self.row[s] = k
        self.piece = np.full(len(rows), -1, np.int32)
        for s, k in ends.items():
            self.piece[s] = k
        self.longest = max(map(len, names))

    def codes(self, word: str) -> list[int]:
        get = self.code.get
        return [self.code[START], *[get(c, 0) for c in word]]

    def spans(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, length, words, pieces): for words of one length as rows of codes, where pieces start and end."""
        width = x.shape[1]
        other = self.n - 1
        for i in range(width):
            state = self.first[x[:, i]]
            piece = np.where(state >= 0, self.piece[state], -1)
            piece[piece < 0] = other  # every single character can stand alone
            alive = np.arange(len(x))
            yield i, 1, alive, piece
            for k in range(2, min(self.longest, width - i) + 1):
                row = np.where(state >= 0, self.row[state], -1)
                on = row >= 0
                if not on.any():
                    break
                alive, row = alive[on], row[on]
                state = self.go[row, self.column[x[alive, i + k - 1]]]
                on = state >= 0
                alive, state = alive[on], state[on]
                piece = self.piece[state]
                hit = piece >= 0
                if hit.any():
                    yield i, k, alive[hit], piece[hit]

    def log_forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability in each language; p has a row for each piece."""
        out = np.zeros((len(words), p.shape[1]))
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for size, which in by.items():
            if size > LONG:
                for k in which:
                    out[k] = self._log_forward_long(words[k], p)
                continue
            for some in self._blocks(which, size, p.shape[1]):
                x = np.array([self.codes(words[k]) for k in some], np.int32)
                alpha = np.zeros((size + 2, len(some), p.shape[1]))
                alpha[0] = 1
                for i, k, at, piece in self.spans(x):
                    alpha[i + k, at] += alpha[i, at] * p[piece]
                out[some] = np.log(alpha[-1])
        return out

    @staticmethod
    def _blocks(which: list[int], size: int, width: int) -> Iterator[list[int]]:
        """Words of one length, so many at a time that a pass stays within CELLS."""
        step = max(1, CELLS // ((size + 2) * width))
        return (which[at : at + step] for at in range(0, len(which), step))

    def _log_forward_long(self, word: str, p: np.ndarray) -> np.ndarray:
        x = np.array([self.codes(word)], np.int32)
        n = x.shape[1]
        ring = np.zeros((self.longest + 1, p.shape[1]))
        ring[0] = 1
        scale, now = np.zeros(p.shape[1]), 0
        for i, k, _, piece in self.spans(x):
            if i != now:
                # what is behind position i is not needed again; keep the front near 1
                ring = np.roll(ring, -1, axis=0)
                ring[-1] = 0
                top = ring.max(axis=0)
                ring /= top
                scale += np.log(top)
                now = i
            ring[k] += ring[0] * p[piece[0]]
        return scale + np.log(ring[n - now])

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language; counts has a row for each word."""
        out = np.zeros(p.shape)
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for size, which in by.items():
            if size > LONG:
                for k in which:
                    self._expected_long(words[k], counts[k], p, out)
                continue
            for some in self._blocks(which, size, p.shape[1]):
                x = np.array([self.codes(words[k]) for k in some], np.int32)
                alpha, beta = np.zeros((2, size + 2, len(some), p.shape[1]))
                alpha[0] = beta[-1] = 1
                spans = list(self.spans(x))
                for i, k, at, piece in spans:
                    alpha[i + k, at] += alpha[i, at] * p[piece]
                weight = counts[some] / alpha[-1]
                for i, k, at, piece in reversed(spans):
                    use = beta[i + k, at] * p[piece]
                    beta[i, at] += use
                    use = use * alpha[i, at] * weight[at]
                    for lang in range(p.shape[1]):
                        out[:, lang] += np.bincount(piece, use[:, lang], self.n)
        return out

    def _expected_long(self, word: str, count: np.ndarray, p: np.ndarray, out: np.ndarray) -> None:
        """Add one long word's expected uses to out, in logarithms; a few languages at a time, for memory."""
        x = np.array([self.codes(word)], np.int32)
        n = x.shape[1]
        met = np.nonzero(count)[0]
        width = max(1, CELLS // (n + 1))
        spans = [(i, k, piece[0]) for i, k, _, piece in self.spans(x)]
        for at in range(0, len(met), width):
            langs = met[at : at + width]
            logs = np.log(p[:, langs])
            alpha, beta = np.full((2, n + 1, len(langs)), -np.inf)
            alpha[0] = beta[n] = 0
            for i, k, piece in spans:
                alpha[i + k] = np.logaddexp(alpha[i + k], alpha[i] + logs[piece])
            for i, k, piece in reversed(spans):
                rest = beta[i + k] + logs[piece]
                beta[i] = np.logaddexp(beta[i], rest)
                out[piece, langs] += count[langs] * np.exp(alpha[i] + rest - alpha[n])


def _load(path: str | None, vocabulary: str) -> Pieces:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(vocabulary)
    return held(("pieces", path), lambda: Pieces(path))


class LanguageModel:
    """Languages, log priors and piece probabilities: bounded by vocabulary times languages."""

    def __init__(self, languages: list[str], priors: np.ndarray, p: np.ndarray, path: str | None, vocabulary: str):
        self.languages, self.priors, self.p, self.path, self.vocabulary = languages, priors, p, path, vocabulary

    def predict(self, docs: DataFrame, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
        """docs (any columns, one of them text) with the language and its score added under ``names``."""
        model = docs.sparkSession.sparkContext.broadcast(self)
        keep = others(docs.columns, *names)
        schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = _Scorer(model.value)
            for whole in batches:
                for part in slices(whole, ROWS, SIZE):
                    langs, scores = scorer(part.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(scores)], names=schema.names)

        return docs.mapInArrow(run, schema)


class _Scorer:
    """Scores texts; keeps the log-probabilities of words up to CACHE bytes."""

    def __init__(self, m: LanguageModel):
        self.m = m
        self.pieces = _load(m.path, m.vocabulary)
        self.index: dict[str, int] = {}
        self.logp = np.zeros((1024, len(m.languages)))
        self.room = CACHE // (WORD_BYTES + 8 * len(m.languages))

    def _add(self, new: list[str]) -> None:
        at, end = len(self.index), len(self.index) + len(new)
        if end > len(self.logp):
            grown = np.zeros((max(end, min(2 * len(self.logp), self.room)), self.logp.shape[1]))
            grown[:at] = self.logp[:at]
            self.logp = grown
        self.logp[at:end] = self.pieces.log_forward(new, self.m.p)
        self.index.update(zip(new, range(at, end), strict=True))

    def __call__(self, texts: list) -> tuple[list[str], np.ndarray]:
        words = [WORD.findall(t.lower()) if isinstance(t, str) else [] for t in texts]
        if not self.m.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        sizes = [len(w) for w in words]
        doc = np.repeat(np.arange(len(texts)), sizes)
        flat = list(chain.from_iterable(words))
        total = np.tile(self.m.priors, (len(texts), 1))
        # words beyond LONG are seldom met again: they are scored where they stand
        for k in [k for k, w in enumerate(flat) if len(w) > LONG]:
            total[doc[k]] += self.pieces.log_forward([flat[k]], self.m.p)[0]
        short = [k for k, w in enumerate(flat) if len(w) <= LONG]
        if len(short) < len(flat):
            flat, doc = [flat[k] for k in short], doc[short]
        new = list({w: 0 for w in flat if w not in self.index})
        if len(self.index) + len(new) > self.room:
            self.index, self.logp = {}, self.logp[:1024]
            new = list(dict.fromkeys(flat))
        if new:
            self._add(new)
        at = np.fromiter([self.index[w] for w in flat], np.int64, len(flat))
        for k in range(total.shape[1]):
            total[:, k] += np.bincount(doc, self.logp[at, k], len(texts))
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        none = np.array(sizes) == 0
        return [("und" if z else self.m.languages[b]) for z, b in zip(none, best, strict=True)], np.where(none, 0.0, score)


def train(
    spark: SparkSession,
    labelled: DataFrame,
    docs_per_language: int = 1500,
    rounds: int = 3,
    max_languages: int | None = None,
    vocabulary: str = "piece_bpe_32k.model",
    path: str | None = None,
) -> LanguageModel:
    """Learn from labelled documents (doc_id, text, lang). All languages are learned, or the max_languages most frequent."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    share = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    share = sorted((r["lang"], r["count"]) for r in (share if max_languages is None else share.limit(max_languages)).collect())
    languages = [x for x, _ in share]
    pieces = _load(path, vocabulary)
    n, width = pieces.n, max(1, len(languages))
    rank = np.arange(n) + 1000.0
    p = np.repeat((1 / rank / (1 / rank).sum())[:, None], width, 1)
    if not languages:
        return LanguageModel([], np.zeros(1), p, path, vocabulary)
    # hashes below a bound hold twice the documents wanted of a language, however common it is; only those are ranked
    by_lang = lambda values: F.try_element_at(F.create_map(*[F.lit(x) for pair in zip(languages, values, strict=True) for x in pair]), F.col("lang"))
    bound = by_lang([min(1.0, 2 * docs_per_language / c) for _, c in share])
    few = Window.partitionBy("lang").orderBy("o", "doc_id")
    hashed = labelled.select("doc_id", "lang", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("o"))
    chosen = hashed.where(F.col("o") / F.lit(2.0**63) <= bound).withColumn("r", F.row_number().over(few)).where(F.col("r") <= docs_per_language)
    sample = written(spark, chosen.select("doc_id", "lang"), "sample")
    text = labelled.join(broadcast_if_small(sample), ["doc_id", "lang"], "left_semi")
    uses = text.select(by_lang(list(range(len(languages)))).alias("k"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w"))
    words = written(spark, uses.groupBy("w", "k").count().groupBy("w").agg(F.collect_list("k").alias("ks"), F.collect_list("count").alias("ns")), "words")

    for _ in range(rounds):
        now = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            pieces, total = _load(path, vocabulary), np.zeros(now.value.shape)
            step = max(1, CELLS // total.shape[1])
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    counts = np.zeros((b.num_rows, total.shape[1]))
                    row = np.repeat(np.arange(b.num_rows), b.column("ks").value_lengths().to_numpy())
                    counts[row, b.column("ks").flatten().to_numpy()] = b.column("ns").flatten().to_numpy()
                    total += pieces.expected(b.column("w").to_pylist(), counts, now.value)
            used = np.nonzero(total.sum(1))[0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * total.shape[1]), pa.array(total[used].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), lists], ["piece", "uses"])

        each = words.mapInArrow(expect, "piece long, uses array<double>")
        summed = each.groupBy("piece").agg(*[F.sum(F.get("uses", F.lit(k))).alias(f"u{k}") for k in range(width)])
        got = summed.toPandas()  # a row for each piece of the vocabulary at most
        counts = np.zeros((n, width))
        counts[got["piece"].to_numpy(int)] = got.drop(columns="piece").to_numpy(float)
        p = (counts + 0.05) / (counts + 0.05).sum(0)
        now.unpersist()
    forget(sample, words)
    priors = np.log(np.array([c for _, c in share], float) / sum(c for _, c in share))
    return LanguageModel(languages, priors, p, path, vocabulary)


def _part(n: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)), F.lit(-1))


def op2_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(spark, docs.select("doc_id", "text", "lang").where((_part(4) != 2) & F.col("doc_id").isNotNull()))
    return model.predict(docs.select("doc_id", (_part(4) == 2).alias("held_out"), "text")).select("doc_id", "held_out", "lang_pred", "score")
