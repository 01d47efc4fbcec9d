"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can end its BPE encoding. An
automaton of the vocabulary reports the tokens that end at each position; of
these the one is stored whose pairing with the stored last token of the prefix
before it is what BPE itself would leave apart. Following the stored tokens back
from the end of the word gives the exact ids, in time linear in the word however
long it is.

Whether two tokens can stand side by side is decided from the merge ranks: the
pieces next to the border are taken apart in reverse order of their making, and
the pair fails if any two pieces that ever met there merge earlier than either
was used up. Results are memoised.

Defined results. A null or empty text has no tokens and decodes to an empty
text. The strings of special tokens in a text become special tokens, as the
vocabulary's library does. Decoding joins the tokens' strings by one space, as
the library does for a vocabulary without a decoder. Rows repeat as they come;
other columns pass through :func:`encode_documents`, but for those with the
names of the new ones. Caches are cleared when they reach their bound.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwise.llm.common import held, others, slices

#: Entries of each worker's caches.
CACHE = 150_000
#: Rows of an output batch, and bytes of their texts.
ROWS, SIZE = 256, 2 << 20
#: A symbol that ends a word is moved by this much; byte symbols are below it.
END = 1000
NEVER = 1 << 30


def _byte_symbols() -> list[str]:
    """A printable character for each byte, as byte-level vocabularies use: printable bytes stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class _Memo(dict):
    """Results of a function by short string; emptied when it has CACHE entries."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, s: str) -> tuple[int, ...]:
        out = self.f(s)
        if len(s) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[s] = out
        return out


class WordBpe:
    """A word-level BPE vocabulary with an end-of-word suffix, from its tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # white space as the library's regular expressions have it
        self.word = regex.compile(pattern.replace(r"[^\s", r"[^\t-\r \x85\xA0  -     　"))
        self.bytes = _byte_symbols()

        vocab = model["vocab"]
        self.rank = dict.fromkeys(vocab.values(), -1)
        self.left, self.right, self.pair = {}, {}, {}
        for k, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pair.setdefault((x, y), k)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = k, x, y
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        made: dict[int, bool] = {}
        for t in sorted(self.rank, key=self.rank.get):
            x, y = self.left.get(t), self.right.get(t)
            made[t] = x is None or (made[x] and made[y] and self._apart(x, y, self.rank[t]))
            if made[t]:
                s = self._symbols_of_name(self.names[t])
                self.automaton.add_word(s, (t, len(s)))
        self.automaton.make_automaton()
        self.words, self.chunks = _Memo(self.encode_word), _Memo(self._encode_chunk)

    def _symbols_of_name(self, name: str) -> str:
        if name.endswith(self.suffix):
            name = name[: -len(self.suffix)]
            return name[:-1] + chr(ord(name[-1]) + END)
        return name

    def _apart(self, x: int, y: int, until: int) -> bool:
        """Whether no two pieces at the border of tokens x and y merge before rank ``until``."""
        rank, pair = self.rank, self.pair
        x_used = y_used = until
        while True:
            m = pair.get((x, y), NEVER)
            # of merges of one rank the left one comes first
            if m < x_used and (m < y_used or m == y_used != until):
                return False
            if rank[x] > rank[y]:
                x_used, x = rank[x], self.right[x]
            elif rank[y] >= 0:
                y_used, y = rank[y], self.left[y]
            else:
                return True

    def side_by_side(self, x: int, y: int) -> bool:
        known = self.fits.get((x, y))
        if known is None:
            if len(self.fits) >= 4 * CACHE:
                self.fits.clear()
            known = self.fits[x, y] = self._apart(x, y, NEVER)
        return known

    def encode_word(self, word: str) -> tuple[int, ...]:
        # printable ASCII stands for itself
        s = word if word.isascii() and word.isprintable() else "".join([self.bytes[b] for b in word.encode("utf-8")])
        s = s[:-1] + chr(ord(s[-1]) + END)
        last: list[tuple[int, int] | None] = [None] * (len(s) + 1)
        known = self.fits.get
        for end, (token, size) in self.automaton.iter(s):
            end += 1
            if last[end] is None:
                start = end - size
                if start:
                    pair = (last[start][0], token)
                    fits = known(pair)
                    if not (self.side_by_side(*pair) if fits is None else fits):
                        continue
                last[end] = (token, start)
        ids, end = [], len(s)
        while end:
            token, end = last[end]
            ids.append(token)
        return tuple(reversed(ids))

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        # capital sigma: never the final form
        text = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return tuple(chain.from_iterable([self.words[w] for w in self.word.findall(text)]))

    def encode(self, text: str) -> list[int]:
        if self.split_special and "<" in text and self.split_special.search(text):
            parts = self.split_special.split(text)
            return [i for k, p in enumerate(parts) for i in ([self.special[p]] if k % 2 else self.encode_plain(p))]
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> list[int]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split alone
            return list(self._encode_chunk(text))
        known = self.chunks
        return list(chain.from_iterable([known[c] for c in text.split()]))

    def decode(self, ids: list[int]) -> str:
        names = self.names
        return " ".join([names[i] for i in ids])


def _load(path: str) -> WordBpe:
    return held(("bpe", path), lambda: WordBpe(path))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizers package keeps a vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", path: str | None = None, decode: bool = True) -> DataFrame:
    """The documents with ids (array of int) and, unless ``decode`` is false, decoded (what the ids decode to) added.

    The vocabulary is opened where the task runs: ``path``, or ``vocabulary`` in the public tokenizers package.
    """
    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())][: 1 + decode]
    keep = others(docs.columns, *[f.name for f in new])
    schema = T.StructType([docs.schema[c] for c in keep] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(path or vocabulary_path(vocabulary))
        for whole in batches:
            for part in slices(whole, ROWS, SIZE):
                texts = part.column("text").to_pylist()
                ids = [bpe.encode(t) if t else [] for t in texts]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                arrays = [part.column(c) for c in keep] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if decode:
                    arrays.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(run, schema)


def op3_bpe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
