"""Alignment of two tokenizers' tokens by the bytes that they cover.

Each text is encoded twice: with a byte-level BPE vocabulary (A) and with a
sentence-piece vocabulary (B); words between single spaces, over which no token
goes on, once for all texts of an Arrow batch. Tokens are intervals of bytes. Where a token of A
and one of B end at the same byte both sequences are cut, and what lies between
two cuts is a group; all tokens of A in a group are linked with all of B.

DuckDB works on the token tables of an Arrow batch inside the task: a join of the
ends gives the cuts, a window numbers them, an ASOF join finds each token's group,
a join by group gives a word's linked pairs, and one by word a document's. Each batch also gives the
number of its documents that hold a pair; Spark merges these partial counts. The
counts come back to the documents in two ways: the ``head`` commonest pairs, a
bound on what is broadcast, where the pairs are read; all rarer ones, which no
key makes hot, by a join.

Defined results. Null and empty texts, and texts whose tokens' bytes don't give
the text back (white space or characters that B changes), have no tokens: zeros
and an empty ``groups``. Special tokens' strings are plain text. Rows that repeat
count as documents each. In a table without rows nothing is counted. Columns that
the operator adds replace columns of the same name; all others pass through. One
text makes a batch of its own if it is longer than SIZE bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwise.llm.common import fresh, held, others, slices, written

#: Pairs up to which counts are broadcast.
HEAD = 200_000
#: Texts taken at once, and their bytes.
ROWS, SIZE = 1024, 2 << 20
#: What splits text before the merges of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that B encodes at once.
SHORT = 4
#: A space at an end of the text or beside other white space.
BESIDE = re.compile(r"^ | $| \s|\s ")
#: A code holds a pair in its low bits and a number above them.
LOW, MOST = 32, (1 << 31) - 1
SPACE = "\N{LOWER ONE EIGHTH BLOCK}"
ADDED = ["n_a", "n_b", "n_groups", "n_links", "groups"]


class _Numbers(dict):
    """A number for each string, in the order in which they come."""

    def __missing__(self, s: str) -> int:
        self[s] = k = len(self)
        return k


class Pair:
    """Two vocabularies, the bytes of their entries and a database for token tables."""

    def __init__(self, a_path: str, b_path: str):
        import duckdb
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
        entries = {i: bytes([byte_of[c] for c in t]) for t, i in vocab.items()}
        self.a_bytes = pa.array([entries.get(i, b"") for i in range(max(entries) + 1)], pa.large_binary())
        self.a_path, self.slow = a_path, None
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in entries.items()}, special_tokens={})

        self.sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.b_bytes = pa.array([bytes([int(s[3:5], 16)]) if self.sp.is_byte(i) else s.replace(SPACE, " ").encode("utf-8") for i, s in enumerate(names)], pa.large_binary())
        self.by_word = not any(SPACE in s.lstrip(SPACE) for s in names)
        self.n_b = len(names)
        if len(self.a_bytes) * self.n_b > 1 << LOW:
            raise ValueError("the vocabularies have too many pairs for a code")
        self.a_size, self.b_size = (pc.binary_length(e).to_numpy().astype(np.int64) for e in (self.a_bytes, self.b_bytes))
        width = max(len(self.a_bytes), self.n_b)
        self.width, self.shown = width, pa.array([f"{i}{end}" for end in (",", "|", ";", "") for i in range(width)])
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        self.db.execute("SET temp_directory = ''")

    def _encode_a(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except ValueError:  # a run of white space too long for its pattern matcher; the other library has another one
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.a_path)
                self.slow.encode_special_tokens = True
                self.slow.no_truncation()
                self.slow.no_padding()
            return self.slow.encode(text, add_special_tokens=False).ids

    def _both(self, words: list[str], ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Ids of A and of B of words with a space before each, and how many end up to each of ``ends``; None if the bytes of either aren't the words'."""
        text = "".join([" " + w for w in words])
        own, out = text.encode("utf-8"), []
        # B adds the space before a text itself, and takes less time for short texts
        few = self.sp.encode([" ".join(words[i : i + SHORT]) for i in range(0, len(words), SHORT)], num_threads=1)
        for ids, table, size in ((self._encode_a(text), self.a_bytes, self.a_size), (list(chain.from_iterable(few)), self.b_bytes, self.b_size)):
            ids = np.array(ids, np.int32)
            if table.take(pa.array(ids)).buffers()[2].to_pybytes() != own:
                return None
            last = np.cumsum(size[ids])
            at = np.searchsorted(last, ends)
            if (last[at] != ends).any():
                return None
            out.append((ids, np.diff(at + 1, prepend=0)))
        return out

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list]]:
        """The text and the word of all words of some texts, and for A and for B the tokens of each distinct word.

        A text whose spaces stand alone between other characters falls into words at
        its spaces, as no token of either vocabulary goes on over one; each distinct
        word is encoded once. Any other text is one word. A word has no tokens, and
        its text no words, if the tokens' bytes aren't its own.
        """
        at, odd, words, number = _Numbers(), [], [], []
        for t in texts:
            if t and self.by_word and SPACE not in t and not BESIDE.search(t):
                own = [at[w] for w in t.split(" ")]
            else:
                own = [-1 - len(odd)] if t else []
                odd += [t] if t else []
            words += own
            number.append(len(own))
        sides: list[list] = [[[], []], [[], []]]

        def add(part: list | None, n: int) -> None:
            for k in (0, 1):
                ids, count = part[k] if part else (np.zeros(0, np.int32), np.zeros(n, np.int64))
                sides[k][0].append(ids)
                sides[k][1].append(count)

        single = list(at)
        size = 1 + np.array([len(w) if w.isascii() else len(w.encode("utf-8")) for w in single], np.int64)
        if single and (found := self._both(single, np.cumsum(size))):
            add(found, len(single))
        else:
            for w, n in zip(single, size, strict=True):
                add(self._both([w], np.array([n])), 1)
        for t in odd:
            add(self._both([t], np.array([len(t.encode("utf-8")) + 1])), 1)
        flat = [[np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.int64), *n])] for ids, n in sides]
        words = np.array(words, np.int64)
        words[words < 0] = len(at) - words[words < 0] - 1
        text = np.repeat(np.arange(len(texts)), np.array(number, np.int64))
        good = np.ones(len(texts), bool)
        good[text[flat[0][1][words] == 0]] = False
        return text[good[text]], words[good[text]], flat

    def _groups(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, word_end: np.ndarray, text: np.ndarray, words: np.ndarray) -> tuple:
        """Groups of all tokens of A and of B; the word of each group; (w, n) links of words; (d, pair, n) of the texts."""
        db = self.db
        for name, table in (("a", {"id": a, "e": a_end}), ("b", {"id": b, "e": b_end}), ("words", {"w": np.arange(len(word_end)), "e": word_end}), ("held", {"d": text, "w": words})):
            db.register(name, pa.table(table))
        db.execute("""CREATE OR REPLACE TEMP TABLE cuts AS
            SELECT s.e, words.w, row_number() OVER (ORDER BY s.e) - 1 AS g
            FROM (SELECT a.e FROM a JOIN b USING (e)) s ASOF JOIN words ON s.e <= words.e""")
        for side in "ab":
            db.execute(f"CREATE OR REPLACE TEMP TABLE in_{side} AS SELECT t.e, t.id, cuts.w, cuts.g FROM {side} t ASOF JOIN cuts ON t.e <= cuts.e")
        # of a group's tokens with one id only the number is joined, so a long group is no square of its length
        db.execute(f"""CREATE OR REPLACE TEMP TABLE links AS
            WITH x AS (SELECT w, g, id, count(*) AS n FROM in_a GROUP BY w, g, id),
                 y AS (SELECT g, id, count(*) AS n FROM in_b GROUP BY g, id)
            SELECT x.w, x.id::BIGINT * {self.n_b} + y.id AS pair, sum(x.n * y.n)::BIGINT AS n FROM x JOIN y USING (g) GROUP BY ALL""")
        pairs = db.execute("""
            WITH t AS (SELECT d, w, count(*) AS times FROM held GROUP BY d, w)
            SELECT t.d, links.pair, sum(t.times * links.n)::BIGINT AS n FROM t JOIN links USING (w) GROUP BY ALL ORDER BY ALL""").fetchnumpy()
        a_group, b_group = (db.execute(f"SELECT g FROM in_{side} ORDER BY e").fetchnumpy()["g"] for side in "ab")
        return a_group, b_group, db.execute("SELECT w FROM cuts").fetchnumpy()["w"], pairs

    def align(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """The added columns of some texts; ``codes`` are a text's pairs with their links, ``seen`` all pairs with their texts."""
        n = len(texts)
        text, words, ((a, n_a), (b, n_b)) = self._words(texts)
        zeros = pa.array(np.zeros(n, np.int64))
        if not len(text):
            return dict.fromkeys(ADDED[:4], zeros) | {"groups": pa.array([""] * n, pa.string()), "codes": pa.array([[]] * n, pa.list_(pa.int64())), "seen": np.zeros(0, np.int64)}
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        full = np.nonzero(n_a)[0]
        rank = np.cumsum(n_a > 0) - 1
        a_last, b_last = np.cumsum(n_a)[full], np.cumsum(n_b)[full]
        ga, gb, cut, pairs = self._groups(a, a_end, b, b_end, a_end[a_last - 1], text, rank[words])
        words = rank[words]

        # a group's tokens of A stand before those of B; the sign after a token says what follows
        place_a, place_b = np.arange(len(a)) + np.searchsorted(gb, ga), np.arange(len(b)) + np.searchsorted(ga, gb, "right")
        order = np.empty(len(a) + len(b), np.int64)
        order[place_a] = a + self.width * np.diff(ga, append=-1).astype(bool)
        sign = np.where(np.diff(gb, append=-1) != 0, 2, 0)
        sign[b_last - 1] = 3
        order[place_b] = b + self.width * sign
        parts = _runs(self.shown.take(pa.array(order)), np.cumsum(n_a[full] + n_b[full]))
        parts = pa.concat_arrays([parts, pc.binary_join_element_wise(";", parts, "")])
        first = np.diff(text, prepend=-1) != 0
        groups = _runs(parts.take(pa.array(np.where(first, words, words + len(full)))), np.cumsum(np.bincount(text, minlength=n)))

        d, pair, links = pairs["d"], pairs["pair"], pairs["n"]
        times = -(-links // MOST)
        part = np.repeat(np.minimum(links, MOST), times)
        if (times > 1).any():
            part[np.cumsum(times) - 1] = links - MOST * (times - 1)
        codes = np.repeat(pair, times) | part << LOW
        offsets = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(d, times), minlength=n))]).astype(np.int32)
        every, held = np.unique(pair, return_counts=True)
        total = lambda at, each: _sums(at, each, n)
        return {
            "n_a": total(text, n_a[full][words]),
            "n_b": total(text, n_b[full][words]),
            "n_groups": total(text, np.bincount(cut, minlength=len(full))[words]),
            "n_links": total(d, links),
            "groups": groups,
            "codes": pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes)),
            "seen": every | held << LOW,
        }


def _runs(strings: pa.Array, ends: np.ndarray) -> pa.Array:
    """Strings joined from the last end to the next."""
    at = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(at[np.concatenate([[0], ends])].astype(np.int32)), strings.buffers()[2])


def _sums(at: np.ndarray, each: np.ndarray, n: int) -> pa.Array:
    """Exact sums of integers by place, which ascends."""
    total = np.concatenate([[0], np.cumsum(each)])
    ends = np.cumsum(np.bincount(at, minlength=n))
    return pa.array(np.diff(total[ends], prepend=0))


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def intervals(docs: DataFrame, a: str, b: str, codes: str = "codes", partial: str = "partial") -> DataFrame:
    """The documents with n_a, n_b, n_groups, n_links, groups (string) and codes, and a row for each batch's counts.

    A code has a pair in its low 32 bits and above them its links in the document;
    in the rows with ``partial`` the number of the batch's documents that hold it.
    Vocabularies are opened where the task runs.
    """
    new = [T.StructField(c, T.LongType()) for c in ADDED[:4]] + [T.StructField("groups", T.StringType()), T.StructField(codes, T.ArrayType(T.LongType())), T.StructField(partial, T.BooleanType())]
    keep = others(docs.columns, *[f.name for f in new])
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep] + new)
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = held(("align", a, b), lambda: Pair(_path(a), _path(b)))
        for whole in batches:
            for part in slices(whole, ROWS, SIZE):
                got = pair.align(part.column("text").to_pylist())
                seen = got.pop("seen")
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [*got.values(), pa.array([False] * n)], names=schema.names)
                if len(seen):
                    blank = [pa.nulls(1, part.schema.field(c).type) for c in keep] + [pa.nulls(1, got[c].type) for c in ADDED]
                    yield pa.RecordBatch.from_arrays([*blank, pa.array([seen], lists), pa.array([True])], names=schema.names)

    return docs.mapInArrow(run, schema)


def pair_counts(codes: DataFrame, n_b: int) -> DataFrame:
    """pair, its number of documents c, and whether no pair of its token of A has more (best), from partial codes."""
    each = codes.select(F.explode("codes").alias("x"))
    counts = each.groupBy((F.col("x").bitwiseAND((1 << LOW) - 1)).alias("pair")).agg(F.sum(F.shiftright("x", LOW)).alias("c"))
    counts = written(codes.sparkSession, counts, "pairs")
    a = F.expr(f"pair div {n_b}")
    # a token of A meets at most the entries of B
    top = counts.groupBy(a.alias("a")).agg(F.max("c").alias("top"))
    return counts.withColumn("a", a).join(top, "a").select("pair", "c", (F.col("c") == F.col("top")).alias("best"))


def _head(counts: DataFrame, most: int) -> DataFrame:
    """The commonest pairs, at most ``most``: those above a bin of a histogram of the counts."""
    bin_ = F.floor(F.log2("c") * 16)
    cut, got = 1 << 30, 0
    for r in sorted(counts.groupBy(bin_.alias("b")).count().collect(), reverse=True):  # at most 1,024 bins
        got += r["count"]
        if got > most:
            break
        cut = r["b"]
    return counts.where(bin_ >= cut)


def align_documents(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", head: int = HEAD, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """The documents with n_a, n_b, n_groups, n_links, groups, n_best and count_sum; and the table of pairs (a_id, b_id, c, best).

    With ``digest`` there is groups_sha256 in place of groups, so that the strings aren't stored.
    """
    import sentencepiece

    spark = docs.sparkSession
    n_b = sentencepiece.SentencePieceProcessor(model_file=_path(b)).get_piece_size()
    docs = docs.select(*[docs[c] for c in others(docs.columns, "n_best", "count_sum", *(["groups_sha256"] if digest else []))])
    row, codes, partial = fresh([*docs.columns, *ADDED, "n", "x", "pair", "c", "best"], "row", "codes", "partial")
    rows = intervals(docs, a, b, codes, partial)
    if digest:
        sha = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
        rows = rows.withColumn("groups", sha).withColumnRenamed("groups", "groups_sha256")
    # the row number is drawn once, when the table is written
    rows = written(spark, rows.withColumn(row, F.monotonically_increasing_id()), "intervals")
    counts = written(spark, pair_counts(rows.where(F.col(partial)).select(F.col(codes).alias("codes")), n_b), "counts")
    common = F.broadcast(_head(counts, head))
    each = rows.where(~F.col(partial)).select(row, F.explode(codes).alias("x"))
    each = each.select(row, F.col("x").bitwiseAND((1 << LOW) - 1).alias("pair"), F.shiftright("x", LOW).alias("n"))
    both = each.join(common, "pair", "left")
    found = [both.where("c IS NOT NULL"), both.where("c IS NULL").select(row, "pair", "n").join(counts, "pair")]
    sums = [x.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("c")).alias("count_sum")) for x in found]
    sums = sums[0].unionByName(sums[1]).groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    plain = rows.where(~F.col(partial)).drop(codes, partial)
    out = plain.join(sums, row, "left").select(*[c for c in plain.columns if c != row], zero("n_best"), zero("count_sum"))
    return out, counts.select(F.expr(f"pair div {n_b}").alias("a_id"), (F.col("pair") % n_b).alias("b_id"), "c", "best")


def op11_token_alignment(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, _ = align_documents(docs.select("doc_id", "text"), digest=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
