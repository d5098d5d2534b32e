"""Token counts of documents under a sentencepiece model of the byte-pair kind, without encoding any document.

Pieces of such a model stand inside pre-tokens: a blank joins only what follows it, and a line end joins nothing. `token_counts` works out
each document's frequencies of pre-tokens, brings equal pre-tokens of the whole corpus together, counts the pieces of each once, and
adds frequency times pieces up by document. No ids are made for any text.

Frequencies travel packed: a task's documents are numbered, and of every bucket of pre-tokens it sends the distinct ones, sorted and
compressed, with the numbers and frequencies of their documents (`frequencies`). What comes back is the sum of each document that a
bucket touches (`sums`), again by number; the numbers become ids in a last, streaming step (`token_counts`). A pre-token that many of a task's
documents have goes to a bucket that depends on the task, too, so that the commonest ones are spread over all tasks.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows come back as often as they went in; a null id is an id
like any other; columns of the input other than id and text, whatever their names, are not read; an empty table gives an empty table; a text
of any length only leaves its distinct pre-tokens behind. The frequencies are a written table, so that numbers mean the same to
all later steps, whatever is computed again after a loss.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import bounded_batches, read_table, text_of, written

#: The mark that sentencepiece writes for a blank; in a text it stands for a blank, too.
BLANK = "▁"
#: A character that must not be part of any piece but its own: it parts a pre-token from the blank which the library puts in front.
STOP = "\n"
#: Blanks and what follows them, or blanks that nothing follows. Line ends are counted one by one.
PRE_TOKEN = re.compile(f"[ {BLANK}]*[^ {BLANK}{STOP}]+|[ {BLANK}]+")
#: A blank after something else: where a text may be cut. Characters of a text that are cut into pre-tokens at once, about.
_BORDER, CUT = re.compile(f"(?<=[^ {BLANK}])[ {BLANK}]"), 1 << 20
#: A task sends off what it has at so many pre-tokens; documents are numbered in 16 bits.
BUFFER, NUMBERS = 6_000_000, 1 << 16
#: Buckets for each partition of a shuffle, and the pre-tokens whose pieces a task keeps in mind.
BUCKETS, KNOWN = 4, 1_000_000
#: A pre-token that so great a part of a buffer's documents has is spread over buckets; not in buffers of a few documents.
COMMON, FEW = 1 / 16, 64


@dataclass
class Tokenizer:
    """A sentencepiece model as bytes, which travel to the tasks; the file is needed at the driver only."""

    model: bytes

    @classmethod
    def read(cls, path: str) -> Tokenizer:
        with open(path, "rb") as f:
            own = cls(f.read())
        own.check()
        return own

    def load(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def check(self) -> None:
        """Whether the model's pieces stay inside pre-tokens, and its normaliser leaves characters as they are."""
        sp = self.load()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and len(piece) > 1 and (BLANK in piece.lstrip(BLANK) or STOP in piece):
                raise ValueError(f"piece {piece!r} reaches over pre-tokens")
        if [len(sp.encode(x)) for x in (STOP, f"  {STOP}  ")] != [2, 3] or sp.encode("ﬁ", out_type=str)[-1] != "ﬁ":
            raise ValueError("the model changes blanks, line ends or other characters before it encodes")


def slices(text: str, cut: int = CUT) -> Iterator[str]:
    """A text that isn't empty, with the blank which the library puts in front of it, in parts that begin with a pre-token each."""
    text, at = f" {text}", 0
    while at < len(text):
        border = _BORDER.search(text, at + cut)
        end = border.start() if border else len(text)
        yield text[at:end]
        at = end


def pre_tokens(part: str) -> list[str]:
    """The pre-tokens of a part of a text. A line end is an empty string."""
    return PRE_TOKEN.findall(part) + [""] * part.count(STOP)


def piece_counts(sp, words: list[str]) -> list[int]:
    """The pieces of each pre-token. The line end in front makes two tokens, the library's blank and itself, and keeps both apart from what follows."""
    return [len(x) - 2 for x in sp.encode([STOP + (w or STOP) for w in words], num_threads=1)]


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Buffer:
    """The documents of a task so far: their pre-tokens as numbers of `words`."""

    def __init__(self) -> None:
        self.words: dict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.parts: list[np.ndarray] = []
        self.ids: list[pa.Array] = []
        self.sizes: list[pa.Array] = []
        self.n = self.docs = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        self.ids.append(ids)
        self.sizes.append(pc.cast(pc.binary_length(texts), pa.int64()))
        for text in texts.to_pylist():
            for part in slices(text) if text else ():
                words = pre_tokens(part)
                numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
                self.parts.append(numbers << 16 | self.docs)
                self.n += len(words)
            self.docs += 1

    def buckets(self, own: int, count: int, few: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, packed words, packed numbers and frequencies) of each bucket."""
        cell, n = np.unique(np.concatenate(self.parts), return_counts=True)
        word, doc = cell >> 16, (cell & 0xFFFF).astype(np.uint16)
        ends = np.searchsorted(word, np.arange(len(self.words) + 1))
        words = list(self.words)
        common = np.diff(ends) >= max(few, COMMON * self.docs)
        bucket = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
        bucket = (bucket + np.where(common, zlib.crc32(str(own).encode()), 0)) % count
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        first = np.searchsorted(bucket[order], np.arange(count + 1))
        for b in np.flatnonzero(np.diff(first)):
            some = order[first[b] : first[b + 1]]
            size = ends[some + 1] - ends[some]
            at = np.repeat(ends[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            yield int(b), packed(STOP.join([words[i] for i in some.tolist()]).encode()), packed(size.astype(np.uint32).tobytes() + doc[at].tobytes() + n[at].astype(np.uint32).tobytes())


def frequencies(docs: DataFrame, buckets: int, key: str = "doc_id", text: str = "text", buffer: int = BUFFER, few: int = FEW) -> DataFrame:
    """buffer, bucket, words, cells, ids, sizes: of each buffer a row for each of its buckets, and one without a bucket that has its documents' ids and bytes."""
    kind = docs.schema[key].dataType
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sent, now = TaskContext.get().partitionId() << 24, 0, Buffer()

        def rows() -> Iterator[pa.RecordBatch]:
            if now.docs:
                ids, sizes = pa.concat_arrays(now.ids), pa.concat_arrays(now.sizes)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array([own + sent]), pa.array([None], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), one(ids), one(sizes)], names=names)
            if now.n:
                for b, words, cells in now.buckets(own + sent, buckets, few):
                    yield pa.RecordBatch.from_arrays([pa.array([own + sent]), pa.array([b], pa.int32()), pa.array([words], pa.binary()), pa.array([cells], pa.binary()), pa.nulls(1, pa.list_(id_type)), pa.nulls(1, pa.list_(pa.int64()))], names=names)

        names = ["buffer", "bucket", "words", "cells", "ids", "sizes"]
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                if now.n >= buffer or now.docs + part.num_rows > NUMBERS:
                    yield from rows()
                    sent, now = sent + 1, Buffer()
                now.add(part.column(0), part.column(1))
        yield from rows()

    rows = docs.select(F.col(f"`{key}`").alias("id"), text_of(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"buffer long, bucket int, words binary, cells binary, ids array<{kind.simpleString()}>, sizes array<long>")


def sums(packs: DataFrame, tokenizer: Tokenizer, keep: int = KNOWN) -> DataFrame:
    """buffer, cells: tokens of the documents of each buffer, as far as the buckets of one task hold their pre-tokens (packed numbers, then sums)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, known = tokenizer.load(), {}
        at, total = None, np.zeros(NUMBERS, np.int64)

        def row() -> pa.RecordBatch:
            some = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([packed(some.astype(np.uint16).tobytes() + total[some].tobytes())], pa.binary())], names=["buffer", "cells"])

        for batch in batches:
            for own, words, cells in zip(*[batch.column(c).to_pylist() for c in ("buffer", "words", "cells")], strict=True):
                if own != at:
                    if at is not None:
                        yield row()
                    at, total = own, np.zeros(NUMBERS, np.int64)
                words, cells = unpacked(words).decode().split(STOP), unpacked(cells)
                new = [w for w in words if w not in known]
                if len(known) + len(new) > keep:
                    known, new = {}, words
                known.update(zip(new, piece_counts(sp, new), strict=True))
                size = np.frombuffer(cells, np.uint32, len(words))
                n = int(size.sum())
                doc = np.frombuffer(cells, np.uint16, n, 4 * len(words))
                times = np.frombuffer(cells, np.uint8, 4 * n, 4 * len(words) + 2 * n).view(np.uint32)
                pieces = np.repeat(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), size)
                np.add.at(total, doc, pieces * times)
        if at is not None:
            yield row()

    rows = packs.filter("bucket IS NOT NULL").select("bucket", "buffer", "words", "cells")
    return rows.repartition("bucket").sortWithinPartitions("buffer", "bucket").drop("bucket").mapInArrow(run, "buffer long, cells binary")


def token_counts(docs: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text", buffer: int = BUFFER, keep: int = KNOWN, few: int = FEW) -> DataFrame:
    """key, n_bytes, n_tokens: one row for each row of docs."""
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packs = written(frequencies(docs, buckets, key, text, buffer, few), "pre-tokens")
    heads = packs.filter("bucket IS NULL").select("buffer", F.lit(None).cast("binary").alias("cells"), "ids", "sizes")
    kind = docs.schema[key].dataType.simpleString()
    parts = sums(packs, tokenizer, keep).select("buffer", "cells", F.lit(None).cast(f"array<{kind}>").alias("ids"), F.lit(None).cast("array<long>").alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, total = None, np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            ids, sizes = head.column("ids").flatten(), head.column("sizes").flatten()
            return pa.RecordBatch.from_arrays([ids, sizes, pa.array(total[: len(ids)])], names=[key, "n_bytes", "n_tokens"])

        for batch in batches:
            cells = batch.column("cells")
            for k in range(batch.num_rows):
                if not cells[k].is_valid:  # a buffer's ids stand in front of its sums
                    if head is not None:
                        yield rows()
                    head, total = batch.slice(k, 1), np.zeros(NUMBERS, np.int64)
                    continue
                data = unpacked(cells[k].as_py())
                n = len(data) // 10
                total[np.frombuffer(data, np.uint16, n)] += np.frombuffer(data, np.uint8, 8 * n, 2 * n).view(np.int64)
        if head is not None:
            yield rows()

    both = heads.unionByName(parts).repartition("buffer").sortWithinPartitions("buffer", F.col("cells").isNotNull())
    return both.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long")


#: The vocabulary file of the query, and the tokens above which it marks a document.
MODEL = "piece_bpe_32k.model"
LIMIT = 4096


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has over 4,096 tokens."""
    import public_tokenizers

    out = token_counts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), Tokenizer.read(public_tokenizers.path(MODEL)))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
