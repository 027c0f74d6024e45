"""Packing documents into token sequences along a space-filling curve.

Each document becomes a hashed bag of its tokens, projected to a few dimensions by a fixed Gaussian matrix. The cell
in which it falls gives its place on a Hilbert curve, so documents with like words lie near each other on the curve.
All documents, in curve order, form one stream of tokens, cut every seq_len tokens: only the last sequence has padding.

Contract for odd input: a null or empty text is its end token alone. Documents of one place are ordered by id, nulls
first. Rows that agree in id and tokens are packed one after the other, as often as they occur. An empty table gives no
sequence. Texts of any length are cut freely. Only the id and text columns are read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.llm.common import bound_batches, running_total, stage_table

SEQ_LEN, END_ID, DIMS, BITS, BUCKET_BITS, SEED = 2048, 1, 3, 16, 10, 20240101
_SPREAD = 2654435769  # 2**32 over the golden ratio: scatters token ids over the buckets
#: Words that a Python worker remembers, and their greatest length.
CACHE_WORDS, CACHE_CHARS = 300_000, 64
_SIGNS = b"!#$%&()*+,-./:;<=>?@[]^_`{|}~\"\\"  # all ASCII signs but the apostrophe, which the tokenizer splits in its own way
_LATIN_END = "\u0250"
#: The characters by which a byte-level vocabulary writes the bytes that aren't printable in Latin-1.
_BYTE_CHARS = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173]) if b > 127}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of integer cells (n rows of coordinates below 2**bits).

    Works on all rows at once: from the highest bit down, undo the reflections and swaps that the curve applies to the
    lower bits, then Gray-decode across the coordinates and interleave.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            flip = (x[i] & top) != 0
            x[0] = np.where(flip, x[0] ^ low, x[0])
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= swap
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        carry = np.where((x[-1] >> level) & 1 == 1, carry ^ ((1 << level) - 1), carry)
    x ^= carry
    key = np.zeros_like(carry)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


class Encoder:
    """Token ids of texts as little-endian bytes, word by word: the tokenizer drops white space before it merges, so a
    text's ids are those of its words.

    The vocabulary's control strings, such as an end mark in a text, are their own ids, as the tokenizer has it; what stands
    between them is encoded as a text of its own. Words are remembered until a limit, others are encoded again. Words of letters alone are encoded many at once and told
    apart by the ids that end a word.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        controls = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.tokenizer.encode_special_tokens = True  # for words: the texts' own control strings are taken out before
        # The merges alone, for words that are one run of letters: cheaper, as nothing is normalised or split.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.controls = {c: np.array([i], self.width).tobytes() for c, i in controls.items()}
        self.control = re.compile(b"(" + b"|".join(map(re.escape, sorted(controls, reverse=True))) + b")") if controls else None
        self.known: dict[bytes, bytes] = {}

    def _merge(self, words: list[bytes], texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(word, ids) for words that are one run of Latin letters, with their texts in the vocabulary's characters."""
        for i in range(0, len(words), 2048):
            ids = np.array(self.merges.encode_batch_fast([" ".join(texts[i : i + 2048])], add_special_tokens=False)[0].ids, self.width)
            stops, whole = ((np.flatnonzero(self.ends[ids]) + 1) * self.width.itemsize).tolist(), ids.tobytes()
            yield from zip(words[i : i + 2048], [whole[x:y] for x, y in zip([0, *stops], stops, strict=False)], strict=True)

    def _encode(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(word, ids) for each of words, which are in lower case as far as A-Z goes."""
        plain = [w for w in words if w.isalpha()]  # ASCII letters alone
        yield from self._merge(plain, b" ".join(plain).decode().split(" "))
        other = [w for w in words if not w.isalpha()]
        texts = unicodedata.normalize("NFC", b" ".join(other).decode("utf-8")).lower().split(" ")
        latin = [len(texts) == len(other) and t.isalpha() and max(t) < _LATIN_END for t in texts]
        if some := [w for w, good in zip(other, latin, strict=False) if good]:
            yield from self._merge(some, " ".join([t for t, good in zip(texts, latin, strict=True) if good]).encode().decode("latin-1").translate(_BYTE_CHARS).split(" "))
        rest = [w for w, good in zip(other, latin, strict=True) if not good] if len(texts) == len(other) else other
        for i in range(0, len(rest), 2048):
            for w, e in zip(rest[i : i + 2048], self.tokenizer.encode_batch([w.decode("utf-8") for w in rest[i : i + 2048]], add_special_tokens=False), strict=True):
                yield w, np.array(e.ids, self.width).tobytes()

    def _rare(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that aren't remembered; short ones are, until the memory is full: frequent words come early."""
        stems: dict[bytes, tuple[bytes, bytes]] = {}
        parts: dict[bytes, None] = {}
        for w in words:
            stem = w.rstrip(_SIGNS)
            # A run of signs after a Latin letter or a digit is split off.
            if len(stem) < len(w) and stem and (stem[-1:].isalnum() or stem[-1] > 127 and (c := unicodedata.normalize("NFC", stem.decode("utf-8")).lower()[-1]).isalpha() and c < _LATIN_END):
                stems[w] = stem, w[len(stem) :]
                parts[stem] = parts[w[len(stem) :]] = None
            else:
                parts[w] = None
        found = dict(self._encode(list(parts)))
        found.update({w: found[x] + found[y] for w, (x, y) in stems.items()})
        if len(self.known) < CACHE_WORDS:
            self.known.update((w, ids) for w, ids in found.items() if len(w) <= CACHE_CHARS)
        return found

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text."""
        parts = [self.control.split(t) if self.control and self.control.search(t) else [t] for t in texts]
        made = self._plain([p for split in parts for p in split[::2]])  # every other part is a control string
        for split in parts:
            yield b"".join(self.controls[p] if k % 2 else next(made) for k, p in enumerate(split))

    def _plain(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of texts without control strings. Upper case is dropped first, as the tokenizer would."""
        split = [t.lower().split() for t in texts]
        found = [list(map(self.known.get, words)) for words in split]
        gaps: list[list[int]] = []
        for ids in found:
            at, here = -1, []
            try:
                while True:
                    at = ids.index(None, at + 1)
                    here.append(at)
            except ValueError:
                gaps.append(here)
        missing = {words[i]: None for words, here in zip(split, gaps, strict=True) for i in here}
        rare = self._rare(list(missing)) if missing else {}
        for words, ids, here in zip(split, found, gaps, strict=True):
            for i in here:
                ids[i] = rare[words[i]]
            yield b"".join(ids)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One for each Python worker, so that tasks share what it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, *, end_id: int = END_ID, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """Rows (doc_id, key, n, crc, ids): a document's place on the curve and its token ids with the end id, as bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        project = np.random.default_rng(SEED).standard_normal((1 << BUCKET_BITS, dims))
        end = np.array([end_id], encoder.width).tobytes()
        names = ["doc_id", "key", "n", "crc", "ids"]
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                ids, at = [], np.zeros((part.num_rows, dims))
                for row, made in enumerate(encoder.ids([t or b"" for t in part.column(1).to_pylist()])):
                    ids.append(made + end)
                    if made:
                        v = np.log1p(np.bincount(np.frombuffer(made, encoder.width) * np.uint32(_SPREAD) >> np.uint32(32 - BUCKET_BITS), minlength=1 << BUCKET_BITS))
                        at[row] = v @ project / np.sqrt(v @ v)
                cells = np.clip((at + 4.0) / 8.0 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(hilbert_key(cells, bits)), pa.array([len(x) // encoder.width.itemsize for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(encode, "doc_id long, key long, n long, crc long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, *, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of a document: see PIECES."""
    bound_batches(docs.sparkSession)
    encoded = stage_table(encode_documents(docs, tokenizer_path, end_id=end_id), "pack-ids")
    names = ["key", "doc_id", "crc", "n"]
    groups = encoded.groupBy(*names).agg(F.count("*").alias("copies")).withColumn("span", F.col("n") * F.col("copies"))
    placed = running_total(groups, "pack-order", [], names, "span", "first").select(*(F.col(x).alias(f"p_{x}") for x in names), "first", "copies")
    same = (F.col("key") == F.col("p_key")) & F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("crc") == F.col("p_crc")) & (F.col("n") == F.col("p_n"))
    joined = encoded.join(placed, same)
    copy = F.row_number().over(Window.partitionBy(*names).orderBy("first")) - 1
    at = joined.withColumn("at", F.col("first") + copy * F.col("n")).select("doc_id", "at", "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, place, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    seq, offset = divmod(place + start, seq_len)
                    length = min(seq_len - offset, n - start)
                    out.append((doc_id, start, length, zlib.crc32(wide[start : start + length]), n, seq, offset))
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], [x.split()[0] for x in PIECES.split(", ")])

    return at.mapInArrow(cut, PIECES)
