"""Encoding a whole corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.lexicon import Lexicon, compile_lexicon, packed
from weftline.session import shared_dir

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed values of the tokenizer: how a text is cut before merging, and what its \s means (Unicode's White_Space,
# without the four separators that Python adds).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The same for ASCII texts in the faster re.
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

#: The lexicon holds at most so many words, of at most so many characters, each met at least so often.
MAX_WORDS, MAX_CHARS, MIN_COUNT = 65_536, 48, 8
#: Characters that are cut and encoded together, and words whose merges a task remembers.
CHUNK, REMEMBERED = 1_000_000, 200_000
#: Texts beyond so many characters are encoded piece by piece.
LONG = 4_000_000
#: No word crosses a single blank or line end between two characters that aren't white space.
SAFE = re.compile(r"(?<=\S)[ \n](?=\S)")

_of_process: dict = {}


def _splitter():
    if "split" not in _of_process:
        import regex

        pattern = PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        whole = regex.compile(pattern)
        _of_process["split"] = lambda text: ASCII_PATTERN.findall(text) if text.isascii() else whole.findall(text)
    return _of_process["split"]


def publish_vocabulary(spark: SparkSession, tokenizers: str) -> None:
    """Give the vocabulary file to all executors, for those whose machine doesn't have the folder."""
    spark.sparkContext.addFile(f"{tokenizers}/{VOCABULARY}")


def _merger(path: str):
    """Exact merging of one word that is already cut."""
    if path not in _of_process:
        import tiktoken

        here = f"{path}/{VOCABULARY}"
        with open(here if os.path.exists(here) else SparkFiles.get(VOCABULARY), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _of_process[path] = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _of_process[path]


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about CHUNK characters that no word crosses; a longer stretch without white space stays whole."""
    at = 0
    while len(text) - at > LONG and (cut := SAFE.search(text, at + CHUNK)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _chunks(texts: list[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if text and len(text) > LONG:  # by itself
            if held:
                yield held
            yield [text]
            held, size = [], 0
            continue
        held.append(text or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    split, counts = _splitter(), Counter()
    for pdf in batches:
        for text in pdf["text"]:
            for piece in _pieces(text or ""):
                counts.update(split(piece))
        if len(counts) > REMEMBERED:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
            counts = Counter()
    yield pd.DataFrame({"word": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})


def frequent_words(documents: DataFrame, text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """The most frequent words over all documents: at most ``max_words``, by count and then by word."""
    counted = documents.select(F.col(text).alias("text")).mapInPandas(_count_words, "word string, n long")
    total = counted.where(F.length("word") <= MAX_CHARS).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    return total.orderBy(F.col("n").desc(), "word").limit(max_words)


def publish_lexicon(documents: DataFrame, text: str = "text", tokenizers: str = TOKENIZERS, max_words: int = MAX_WORDS) -> str:
    """Compile the corpus's frequent words and give the file to all executors; its name.

    At most ``max_words`` words of at most ``MAX_CHARS`` characters reach the driver.
    """
    spark = documents.sparkSession
    publish_vocabulary(spark, tokenizers)
    merge = _merger(tokenizers)
    words = [r.word for r in frequent_words(documents, text, max_words).select("word").toLocalIterator()]
    name = f"lexicon-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(packed(compile_lexicon({w.encode(): merge(w) for w in words})))
    out.close()
    spark.sparkContext.addFile(at.toString())
    return name


class _Encoder:
    """Encodes chunks of texts: words of the lexicon by the transducer, others by merging."""

    def __init__(self, tokenizers: str, lexicon: str | None) -> None:
        self.split, self.merge = _splitter(), _merger(tokenizers)
        self.lexicon = Lexicon(SparkFiles.get(lexicon)) if lexicon else None
        self.known: dict[str, list[int]] = {}

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]], np.ndarray, np.ndarray]:
        """Words per text; codes of all words; of each distinct word its length and place in the two kinds of ids."""
        cut = [self.split(t) if t else [] for t in texts]
        per_text = np.fromiter(map(len, cut), np.int64, len(cut))
        # A dictionary, as pandas' factorize takes strings to end at a NUL.
        names = list(dict.fromkeys(w for words in cut for w in words))
        number = dict(zip(names, range(len(names)), strict=True))
        codes = np.fromiter((number[w] for words in cut for w in words), np.int64, int(per_text.sum()))
        ranks = self.lexicon.ranks([w.encode() for w in names]) if self.lexicon else np.full(len(names), -1, np.int64)
        merged, known = [], self.known
        for i in np.flatnonzero(ranks < 0).tolist():
            word = names[i]
            ids = known.get(word)
            if ids is None:
                ids = self.merge(word)
                if len(known) < REMEMBERED and len(word) <= MAX_CHARS:
                    known[word] = ids
            merged.append(ids)
        lengths = np.zeros(len(names), np.int64)
        lengths[ranks < 0] = [len(x) for x in merged]
        if self.lexicon:
            there = ranks >= 0
            lengths[there] = self.lexicon.offsets[ranks[there] + 1] - self.lexicon.offsets[ranks[there]]
        return per_text, codes, ranks, merged, lengths, names

    def encode(self, texts: list[str]) -> pa.Array:
        if len(texts) == 1 and len(pieces := list(_pieces(texts[0]))) > 1:
            values = pa.concat_arrays([self.encode([p]).values for p in pieces])
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        per_text, codes, ranks, merged, lengths, _ = self.words(texts)
        # The ids of all distinct words, one behind the other, then those of all words by gathering.
        pool = np.zeros(int(lengths.sum()), np.int32)
        starts = np.cumsum(lengths) - lengths
        missing = ranks < 0
        for start, ids in zip(starts[missing].tolist(), merged, strict=True):
            pool[start : start + len(ids)] = ids
        if self.lexicon:
            there = np.flatnonzero(~missing)
            pool[_spans(starts[there], lengths[there])] = self.lexicon.ids[_spans(self.lexicon.offsets[ranks[there]], lengths[there])]
        sizes = lengths[codes]
        values = pool[_spans(starts[codes], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(per_text)])]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, pa.int32()))


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of spans, one span behind the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, max_words: int = MAX_WORDS) -> DataFrame:
    """``doc_id`` and ``ids`` (list of integers) of every document by byte_bpe_50k.

    No special tokens are added, and their strings in a text are ordinary text;
    empty and null texts give an empty list; blank and very long texts are
    encoded whole. One row per row of ``documents``, so repeated and null
    ``doc_id`` stay as they are; an empty table gives no rows; other columns are
    ignored, whatever their names.

    A first pass counts the words of all documents; the frequent ones are
    compiled with their ids into a minimal acyclic transducer, which executors
    memory-map. The second pass cuts texts into words, sends the distinct words
    of about a million characters through the transducer together, and merges
    the unseen ones exactly. Documents aren't shuffled.
    """
    lexicon = publish_lexicon(documents, text, tokenizers, max_words)
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(tokenizers, lexicon)
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), encoder.encode(texts)], names=["doc_id", "ids"])
                at += len(texts)

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


class _Counts(dict):
    """Tokens of words: of short ones as often as REMEMBERED allows, of others each time."""

    def __init__(self, merge) -> None:
        self.merge = merge

    def __missing__(self, word: str) -> int:
        n = len(self.merge(word))
        if len(word) <= MAX_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def _counter(tokenizers: str):
    split, counts = _splitter(), _Counts(_merger(tokenizers))
    return lambda text: sum(sum(map(counts.__getitem__, split(piece))) for piece in _pieces(text)) if text else 0


def with_token_counts(documents: DataFrame, text: str = "text", out: str = "n_tokens", tokenizers: str = TOKENIZERS) -> DataFrame:
    """``documents`` with the number of byte_bpe_50k tokens of ``text``; 0 for empty and null texts.

    Counting needs no ids and so no lexicon: each task remembers how many tokens a word has.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(tokenizers)
        for texts in batches:
            yield pd.Series(map(counter, texts), dtype="int64")

    publish_vocabulary(documents.sparkSession, tokenizers)
    # Called nondeterministic, as the optimizer would evaluate it again for a filter on the count.
    return documents.withColumn(out, count.asNondeterministic()(F.col(text)))
