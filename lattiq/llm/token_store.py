"""Token ids in binary shards: one wavelet matrix file per shard.

Texts are encoded with the tokenizers library.  The vocabulary's pre-tokenizer
never joins characters across ASCII white space, so the library encodes each
distinct white-space word once and the ids are laid out with numpy; the ids are
those of encoding the whole text.  Where a text has Latin letters and printable
ASCII only, for which lower case and character classes are the same in every
library, it is lower-cased and cut at the pre-tokenizer's own pattern (read from
the vocabulary file) first, which leaves far fewer distinct words.

A shard file holds the ids of consecutive documents in ascending doc_id order,
each closed by ``end_id``: the sorted alphabet of ids that occur, a wavelet
matrix over their ranks (a bit plane per level, as it is, beside the number of
set bits before each 512 of its bits), the documents' ids, and how many end ids
each document holds.  A file gives access, rank, select, count and occurrences
where it lies, without expanding planes or tokens; where documents begin and end
is what select says of the end id.

Shard files are bounded by ``tokens_per_shard`` (a longer document has a file of
its own), and travel as binary rows of a Parquet table, so any file system that
Spark can write serves.

Defined results: a null text is empty and has only the end id; null doc_ids come
first; rows with equal doc_id are ordered by their text's checksum; an empty
table gives no shard.  Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, bounded, input_bytes, shuffle_partitions, slices
from .pieces import WordStore, per_text

MAGIC = b"WMX2"
PROBES = 256  # tokens of a shard that reading it checks by access


BLOCK = 8  # words of 64 bits that share an entry of the rank directory


class WaveletMatrix:
    """Rank/select over a sequence of integers, a bit plane per level and a directory of ranks for each."""

    def __init__(self, alphabet: np.ndarray, n: int, planes: list[np.ndarray], before: list[np.ndarray] | None = None):
        self.alphabet, self.n = alphabet, n
        self.bits = planes  # packed, little bit order, padded to whole blocks, of which the last is empty or not full
        self.before = before or [directory(p) for p in planes]  # set bits before each block, and all
        self.zeros = [n - int(b[-1]) for b in self.before]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        alphabet = np.unique(ids)
        ranks = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint32)
        ranks[alphabet] = np.arange(len(alphabet))
        codes = ranks[ids]
        levels = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 1
        codes = codes.astype(np.uint16 if levels <= 16 else np.uint32)
        planes = []
        for level in range(levels):
            bit = ((codes >> (levels - 1 - level)) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(8 * BLOCK - len(packed) % (8 * BLOCK), np.uint8)]))
            codes = np.concatenate([codes[~bit], codes[bit]])
        return cls(alphabet.astype(np.uint32), len(ids), planes)

    def _rank1(self, level: int, i):
        """Set bits among the first i of a plane."""
        i = np.asarray(i, np.int64)
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        words = self.bits[level].view("<u8")
        out = self.before[level][word // BLOCK].astype(np.int64) + np.bitwise_count(words[word] & ((np.uint64(1) << rest) - np.uint64(1)))
        for k in range(BLOCK - 1):  # whole words of the block
            at = word // BLOCK * BLOCK + k
            out = out + np.where(at < word, np.bitwise_count(words[at]), 0)
        return out

    def _bit(self, level: int, i):
        return (self.bits[level][i >> 3] >> (i & 7).astype(np.uint8)) & 1

    def access(self, positions) -> np.ndarray:
        """Ids at the positions."""
        i = np.asarray(positions, np.int64)
        code = np.zeros(i.shape, np.int64)
        for level in range(len(self.bits)):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            code = code * 2 + bit
            i = np.where(bit == 1, self.zeros[level] + ones, i - ones)
        return self.alphabet[code]

    def _range(self, token: int, end: int) -> tuple[int, int] | None:
        """Where the token's first occurrences before ``end`` stand below the last level."""
        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return None
        low, high = 0, end
        for level in range(len(self.bits)):
            a, b = self._rank1(level, np.array([low, high]))
            if (code >> (len(self.bits) - 1 - level)) & 1:
                low, high = self.zeros[level] + int(a), self.zeros[level] + int(b)
            else:
                low, high = low - int(a), high - int(b)
        return low, high

    def rank(self, token: int, end: int) -> int:
        """Occurrences of the token among the first ``end`` positions."""
        found = self._range(token, end)
        return 0 if found is None else found[1] - found[0]

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, level: int, value: int, k):
        """Position of the k-th bit (0-based) that equals value."""
        ones = self.before[level].astype(np.int64)
        before = ones if value else np.arange(len(ones)) * (64 * BLOCK) - ones
        block = np.minimum(np.searchsorted(before, k, side="right"), len(before) - 1) - 1
        left = k - before[block]
        held = np.bitwise_count(self.bits[level].view("<u8").reshape(-1, BLOCK)[block]).astype(np.int64)
        upto = np.cumsum(held if value else 64 - held, axis=-1)
        inner = np.argmax(upto > left[:, None], axis=-1)
        left = left - np.where(inner > 0, upto[np.arange(len(inner)), inner - 1], 0)
        word = block * BLOCK + inner
        bits = np.unpackbits(self.bits[level].reshape(-1, 8)[word], axis=-1, bitorder="little") == value
        return word * 64 + np.argmax(np.cumsum(bits, axis=-1) > left[:, None], axis=-1)

    def select(self, token: int, k) -> np.ndarray:
        """Positions of the k-th occurrences (0-based) of the token."""
        k = np.atleast_1d(np.asarray(k, np.int64))
        found = self._range(token, self.n)
        if found is None or (k >= found[1] - found[0]).any() or (k < 0).any():
            raise IndexError(token)
        code, i = int(np.searchsorted(self.alphabet, token)), found[0] + k
        for level in reversed(range(len(self.bits))):
            bit = (code >> (len(self.bits) - 1 - level)) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> np.ndarray:
        return self.select(token, np.arange(self.count(token)))

    def decode(self) -> np.ndarray:
        """All ids in order."""
        codes = np.zeros(self.n, np.uint16 if len(self.bits) <= 16 else np.uint32)
        for level in reversed(range(len(self.bits))):
            bit = np.unpackbits(self.bits[level], count=self.n, bitorder="little").astype(bool)
            above = np.empty_like(codes)
            above[~bit] = codes[: self.zeros[level]]
            above[bit] = codes[self.zeros[level] :] | codes.dtype.type(1 << (len(self.bits) - 1 - level))
            codes = above
        return self.alphabet[codes] if self.n else np.zeros(0, np.uint32)


def directory(plane: np.ndarray) -> np.ndarray:
    """Set bits before each block of a plane, and in all of it."""
    ones = np.bitwise_count(plane.view("<u8")).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(ones)]).astype("<u4")


class Shard:
    """A shard file: documents' ids, how many end ids each holds, and the wavelet matrix of all their tokens."""

    def __init__(self, doc_ids: list, marks: np.ndarray, end_id: int, matrix: WaveletMatrix):
        self.doc_ids, self.marks, self.end_id, self.matrix = doc_ids, marks, end_id, matrix

    def ends(self) -> np.ndarray:
        """Where each document ends, its end id included: selected from the matrix."""
        out = [self.matrix.select(self.end_id, k) + 1 for k in np.array_split(np.cumsum(self.marks) - 1, max(1, len(self.marks) >> 14))]
        return np.concatenate(out)

    def to_bytes(self) -> bytes:
        press = zstandard.ZstdCompressor(level=1).compress
        known = np.array([x is not None for x in self.doc_ids], np.uint8)
        ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        m = self.matrix
        parts = [press(ids.tobytes()), press(known.tobytes()), press(self.marks.astype("<u4").tobytes()), m.alphabet.astype("<u4").tobytes()]
        for bits, before in zip(m.bits, m.before):
            parts += [before.tobytes(), bits.tobytes()]
        parts = [p + bytes(-len(p) % 8) for p in parts]
        head = MAGIC + struct.pack("<IQQII", self.end_id, len(ids), m.n, len(m.alphabet), len(m.bits))
        head += struct.pack(f"<{len(parts)}Q", *map(len, parts))
        return head + bytes(-len(head) % 8) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix shard")
        end_id, docs, n, sigma, levels = struct.unpack_from("<IQQII", data, 4)
        at = 4 + struct.calcsize("<IQQII")
        sizes = struct.unpack_from(f"<{4 + 2 * levels}Q", data, at)
        at += 8 * len(sizes)
        at += -at % 8
        parts, view = [], memoryview(data)
        for s in sizes:
            parts.append(view[at : at + s])
            at += s
        loose = [zstandard.ZstdDecompressor().decompressobj().decompress(p) for p in parts[:3]]
        known = np.frombuffer(loose[1], np.uint8)
        ids = [int(x) if k else None for x, k in zip(np.frombuffer(loose[0], "<i8"), known)]
        before = [np.frombuffer(p, "<u4", count=len(p) // 4)[: len(q) // (8 * BLOCK) + 1] for p, q in zip(parts[4::2], parts[5::2])]
        matrix = WaveletMatrix(np.frombuffer(parts[3], "<u4", count=sigma), n, [np.frombuffer(p, np.uint8) for p in parts[5::2]], before)
        return cls(ids, np.frombuffer(loose[2], "<u4").astype(np.int64), end_id, matrix)


#: Characters whose case mapping, composition and classes do not depend on the library or its Unicode version.
PLAIN = re.compile(r"[\t\n\r\x0b\x0c\x20-\x7e\u00c0-\u024f]*")
PLAIN_CLASSES = {r"\p{L}": "a-zA-Z" + "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha()), r"\p{N}": "0-9"}


class Encoder:
    """The library's encoder of a vocabulary file, by distinct words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pattern, self.marks, self.closing = _plain_pattern(path)
        self.store = WordStore(self._encode, pa.string(), limit=600_000)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, end to end, and the number of each word's ids.

        Words that the pre-tokenizer leaves whole are encoded many at a time, as
        a text, in which each word's last id is a piece with the end-of-word
        suffix; a group where the number of those differs is encoded word by word.
        """
        whole = [self.pattern is not None and self.pattern.fullmatch(w) is not None and PLAIN.fullmatch(w) is not None and w not in self.marks for w in words]
        joined = [w for w, ok in zip(words, whole) if ok]
        groups = [joined[k : k + 512] for k in range(0, len(joined), 512)]
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            flat = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.closing[flat]) + 1
            if len(ends) != len(group):
                own = [x.ids for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                flat, ends = np.array(list(chain.from_iterable(own)), np.uint32), np.cumsum([len(x) for x in own])
            ids.append(flat)
            counts.append(np.diff(ends, prepend=0))
        if len(joined) == len(words):
            return np.concatenate(ids), np.concatenate(counts)
        flat, size = np.concatenate(ids), np.concatenate(counts)
        parts = iter(np.split(flat, np.cumsum(size)[:-1]) if len(size) else [])
        others = iter(np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([w for w, ok in zip(words, whole) if not ok], add_special_tokens=False))
        out = [next(parts) if ok else next(others) for ok in whole]
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def words(self, text: str) -> list[str]:
        """Parts of a text whose ids, end to end, are the text's."""
        if self.pattern is not None and PLAIN.fullmatch(text) and not any(m in text for m in self.marks):
            return self.pattern.findall(text.lower())
        return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]  # ASCII white space


def _plain_pattern(path: str):
    """The pre-tokenizer's pattern, if the file lower-cases, drops what lies between matches and marks ends of words; its special tokens; and which ids end a word."""
    spec = json.loads(open(path, encoding="utf-8").read())
    marks = [t["content"] for t in spec.get("added_tokens", [])]
    lowers = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    suffix = spec["model"].get("end_of_word_suffix")
    closing = np.zeros(max(spec["model"]["vocab"].values(), default=0) + 1 + len(marks), bool)
    if suffix:
        closing[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
    if lowers and suffix and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
        pattern = first["pattern"]["Regex"]
        for name, members in PLAIN_CLASSES.items():
            pattern = pattern.replace(name, members)
        if "\\p" not in pattern:
            return re.compile(pattern), marks, closing
    return None, marks, closing


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(texts: list[str | None], path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, end to end, and the number of each text's ids; each ends with end_id unless that is None."""
    split = encoder(path).words
    parts = [split(t or "") for t in texts]
    flat, sizes = encoder(path).store(list(chain.from_iterable(parts)))
    counts = per_text(sizes, [len(p) for p in parts])
    if end_id is None:
        return flat, counts
    out = np.full(len(flat) + len(counts), end_id, np.uint32)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(counts + 1) - 1] = False
    out[inner] = flat
    return out, counts + 1


def write_shards(docs: DataFrame, path: str, end_id: int = 1, tokens_per_shard: int = 1 << 22) -> DataFrame:
    """part, seq, n_docs, n_tokens, data: the shard files in ascending order of (part, seq)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held: list = [[], []]  # doc ids, ids
        size = 0

        def shard():
            nonlocal seq, size
            marks = np.array([np.count_nonzero(x == end_id) for x in held[1]], np.int64)
            out = Shard(held[0], marks, end_id, WaveletMatrix.build(np.concatenate(held[1]))).to_bytes()
            batch = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(held[0])], pa.int64()), pa.array([size], pa.int64()), pa.array([out], pa.binary())], names=["part", "seq", "n_docs", "n_tokens", "data"])
            held[:] = [[], []]
            seq, size = seq + 1, 0
            return batch

        for batch in slices(batches, 2048):
            flat, counts = encode_texts(batch.column("text").to_pylist(), path, end_id)
            at = 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), counts.tolist()):
                if size and size + n > tokens_per_shard:
                    yield shard()
                held[0].append(doc)
                held[1].append(flat[at : at + n])
                size += n
                at += n
        if held[0]:
            yield shard()

    parts = max(shuffle_partitions(spark), input_bytes(docs) >> 26)
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32(F.col("text").cast("binary")), F.octet_length("text"))
    assert kind.simpleString() in ("bigint", "int"), kind
    return ordered.mapInArrow(run, "part int, seq int, n_docs long, n_tokens long, data binary")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shard files: bounds by select, ids by decoding the planes."""
    # tokens before a file: in its part, and in the parts before, of which there are as many as tasks wrote
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    files = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside"))
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    starts = files.join(parts, "part").select("part", "seq", (F.col("inside") + F.col("before")).alias("base"))

    def run(batches):
        for batch in slices(batches, 4):
            for base, data in zip(batch.column("base").to_pylist(), batch.column("data").to_pylist()):
                shard = Shard.from_bytes(data)
                ends = shard.ends()
                lengths = np.diff(ends, prepend=0)
                ids = shard.matrix.decode().astype("<u4")
                probe = np.linspace(0, len(ids) - 1, min(PROBES, len(ids))).astype(np.int64)
                if not np.array_equal(shard.matrix.access(probe), ids[probe]):
                    raise ValueError("a shard's planes and rank directory do not agree")
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(base + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(bounded(starts), ["part", "seq"]).select("base", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_of_documents(docs: DataFrame, path: str) -> DataFrame:
    """The contract's rows; the shard files are written to the shared folder and read back."""
    space = Workspace(docs.sparkSession, "tokens")
    return read_shards(space.write(write_shards(docs, path), "shards", codec="uncompressed"))
