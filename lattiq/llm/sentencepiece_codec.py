"""SentencePiece encoding and decoding by batched Viterbi in numpy.

White space becomes U+2581 and a text splits into words that no piece crosses
(what pieces may cross is read from the model's pieces).
Distinct words of equal length advance together, a character at a time: hashes
of all substrings that end there probe the sorted keys of the pieces, and the
best predecessor of each word is a vectorised maximum whose argument is stored
as the backpointer.  Unknown characters become byte pieces.

For a unigram model the best path maximises the sum of scores.  For a BPE model
that path is in general not what the model's merges give.  There an edge counts
only if its piece and the piece before it are what merging their concatenation
gives; along such edges each position has one predecessor, and the path is the
merge result.  The pair test is memoised in each worker.

Defined results: null and empty texts have no ids and decode to the empty text;
decoding gives the text back with U+2581 read as a space.  Repeated rows get
equal results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices
from .pieces import WordStore, per_text, runs

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNKNOWN_PENALTY = 10.0
PAIR_BITS = 21
FILTER_BITS = 20
CELLS = 1 << 18  # characters that advance together
LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
MARKS = "!-/:-@\\[-`{-~"
MIXED = re.compile(f"[{LETTERS}][{MARKS}]|[{MARKS}][{LETTERS}]")


class PieceModel:
    """Pieces, scores and the sorted hash keys of a SentencePiece model file."""

    def __init__(self, path: str | None = None, *, pieces: list[tuple[str, float]] | None = None, bpe: bool = False):
        self.bytes_of: dict[int, int] = {}  # byte -> id
        self.dummy_prefix = True
        if path is not None:
            from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

            proto = sentencepiece_model_pb2.ModelProto()
            proto.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
            norm = proto.normalizer_spec
            if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
                raise ValueError("only models with identity normalisation are supported")
            self.dummy_prefix = norm.add_dummy_prefix
            bpe = proto.trainer_spec.model_type == 2
            self.pieces = [p.piece for p in proto.pieces]
            self.scores = np.array([p.score for p in proto.pieces])
            usable = [i for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
            self.bytes_of = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
            self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        else:
            self.pieces = ["<unk>", *(p for p, _ in pieces)]
            self.scores = np.array([0.0, *(s for _, s in pieces)])
            usable, self.unknown = list(range(1, len(self.pieces))), 0
        self.bpe = bpe
        self.id_of = {self.pieces[i]: i for i in usable}
        self.longest = max(map(len, self.id_of), default=1)
        keys = np.array([_hash(p) for p in self.id_of], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(self.id_of.values()), np.int64)[order]
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have one hash")
        joined = {c for p in self.id_of if len(p) > 1 for c in p}
        whole = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in joined)
        word = f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")
        if not whole and not any(MIXED.search(p) for p in self.id_of):
            # no piece joins a Latin letter and a mark, so runs of either part the words further
            after = f"(?![^{LETTERS}{MARKS}{SPACE}{alone}])"
            word = f"{SPACE}*+[{LETTERS}]++{after}|{SPACE}*+[{MARKS}]++{after}|" + word
        self.words = re.compile("(?s).+" if whole else word)
        self.floor = float(self.scores[usable].min()) - UNKNOWN_PENALTY if usable else -UNKNOWN_PENALTY
        self.powers = BASE ** np.arange(self.longest + 1, dtype=np.uint64)
        self.pairs, self.answers = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.filter = np.zeros(1 << FILTER_BITS, bool)  # most substrings are no piece: told by their keys' first bits
        self.filter[self.keys >> np.uint64(64 - FILTER_BITS)] = True
        raw = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.bytes_of.items():
            raw[i] = bytes([b])
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
        self.raw_start, self.spaced = np.cumsum(self.raw_size) - self.raw_size, np.array([r[:1] == b" " for r in raw], np.int64)
        self.store = WordStore(self.encode_words, pa.string(), limit=300_000)

    # ----- merges, for the pair test of BPE models

    def merge(self, text: str) -> list[str]:
        """Merge the best-scored adjacent pair, leftmost first, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the concatenation of two pieces gives back the two.

        Answers stay in a table of fixed size, in which a pair has one place.
        """
        size = len(self.pieces) + 1
        pairs = left * size + right
        place = ((pairs.astype(np.uint64) * BASE) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.answers[place]
        missing = np.flatnonzero(self.pairs[place] != pairs)
        if len(missing):
            new, back = np.unique(pairs[missing], return_inverse=True)
            found = np.empty(len(new), bool)
            for k, pair in enumerate(new.tolist()):
                a, b = divmod(pair, size)
                found[k] = size - 1 in (a, b) or self.merge(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
            out[missing] = found[back]
            place = ((new.astype(np.uint64) * BASE) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
            # of new pairs with one place the last stays, in both arrays
            keep = len(place) - 1 - np.unique(place[::-1], return_index=True)[1]
            self.pairs[place[keep]], self.answers[place[keep]] = new[keep], found[keep]
        return out

    # ----- Viterbi

    def _edges(self, codes: np.ndarray):
        """All substrings of words of one length that are pieces: (end, length, word, piece), in order of end and length.

        A single character that is no piece gives the piece len(pieces).
        """
        n, length = codes.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * BASE + (codes[:, j].astype(np.uint64) + np.uint64(1))
        found = []
        for k in range(1, min(length, self.longest) + 1):
            key = (prefix[k:] - prefix[: length + 1 - k] * self.powers[k]).ravel()
            place = np.arange(len(key)) if k == 1 else np.flatnonzero(self.filter[key >> np.uint64(64 - FILTER_BITS)])
            at = np.minimum(np.searchsorted(self.keys, key[place]), len(self.keys) - 1)
            hit = self.keys[at] == key[place]
            if k == 1:
                ids = np.where(hit, self.ids[at], len(self.pieces))
            else:
                place, ids = place[hit], self.ids[at[hit]]
            found.append((place // n + k, np.full(len(place), k), place % n, ids))
        end, size, word, ids = (np.concatenate(x) for x in zip(*found))
        by = np.argsort(end, kind="stable")
        return end[by], size[by], word[by], ids[by]

    def _viterbi(self, codes: np.ndarray) -> np.ndarray:
        """Piece that ends at each character of the best path, else -1; len(pieces) stands for an unknown character."""
        n, length = codes.shape
        stranger = len(self.pieces)
        end, size, word, ids = self._edges(codes)
        gain = np.where(ids == stranger, self.floor, self.scores[np.minimum(ids, stranger - 1)])
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        last, back = np.full((length + 1, n), -1, np.int64), np.zeros((length + 1, n), np.int32)
        bounds = np.searchsorted(end, np.arange(1, length + 2))
        for j in range(1, length + 1):
            edge = slice(bounds[j - 1], bounds[j])
            k, row, piece = size[edge], word[edge], ids[edge]
            score = best[j - k, row] + gain[edge]
            ok = np.isfinite(score)
            if self.bpe:
                inner = np.flatnonzero(ok & (k < j))
                ok[inner] = self._fits(last[j - k[inner], row[inner]], piece[inner])
            k, row, piece, score = k[ok], row[ok], piece[ok], score[ok]
            np.maximum.at(best[j], row, score)
            top = np.flatnonzero(score == best[j, row])[::-1]  # of equal scores the shortest piece, stored last, stays
            last[j, row[top]], back[j, row[top]] = piece[top], k[top]
        out = np.full((n, length), -1, np.int64)
        at, rows = np.full(n, length), np.arange(n)
        while len(rows):
            out[rows, at[rows] - 1] = last[at[rows], rows]
            at[rows] -= back[at[rows], rows]
            rows = rows[at[rows] > 0]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, end to end, and the number of each word's ids."""
        lengths = np.array([len(w) for w in words])
        order = np.argsort(lengths, kind="stable")
        ordered = lengths[order]
        flats, counts, at = [], [], 0
        while at < len(order):
            length = int(ordered[at])
            end = min(int(np.searchsorted(ordered, length, side="right")), at + max(1, CELLS // length))
            group = order[at:end]
            codes = np.frombuffer("".join([words[i] for i in group.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(group), length)
            path = self._viterbi(codes)
            used, strange = path >= 0, np.flatnonzero((path == len(self.pieces)).any(axis=1))
            flat, count = path[used], used.sum(axis=1)
            if len(strange):  # unknown characters are spelled out, word by word
                parts = np.split(flat, np.cumsum(count)[:-1])
                for i in strange.tolist():
                    parts[i] = self._spell(words[group[i]], path[i])
                flat, count = np.concatenate(parts), np.array([len(x) for x in parts])
            flats.append(flat)
            counts.append(count)
            at = end
        flat, count = np.concatenate(flats), np.concatenate(counts).astype(np.int64)
        starts, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts[order], sizes[order] = np.cumsum(count) - count, count
        return flat[runs(starts, sizes)].astype(np.uint32), sizes

    def _spell(self, word: str, row: np.ndarray) -> np.ndarray:
        """Replace unknown characters by byte pieces, or by the unknown id where the model has no byte pieces."""
        out: list[int] = []
        for c, i in zip(word, row.tolist()):
            if i == len(self.pieces):
                out += [self.bytes_of[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes_of else [self.unknown]
            elif i >= 0:
                out.append(i)
        return np.array(out, np.int64)

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", SPACE)
        return self.words.findall(SPACE + text if self.dummy_prefix else text)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the number of each text's ids."""
        words, words_of = [], []
        for t in texts:
            own = self.split(t)
            words += own
            words_of.append(len(own))
        flat, sizes = self.store(words)
        return flat, per_text(sizes, words_of)

    def decode(self, ids: list[int]) -> str:
        flat = np.asarray(ids, np.int64)
        return self.decode_all(flat, np.array([len(flat)]))[0]

    def decode_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The pieces' bytes of all texts, end to end, without a text's leading space, and where each text ends."""
        ids = ids.astype(np.int64)
        skip = np.zeros(len(ids), np.int64)
        if self.dummy_prefix:
            first = (np.cumsum(counts) - counts)[counts > 0]
            skip[first] = self.spaced[ids[first]]
        sizes = self.raw_size[ids] - skip
        out = self.raw[runs(self.raw_start[ids] + skip, sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return out.tobytes(), total[np.cumsum(counts)]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are no UTF-8 become U+FFFD."""
        data, ends = self.decode_bytes(ids, counts)
        starts = np.concatenate([[0], ends[:-1]]).tolist() if len(ends) else []
        return [data[s:e].decode("utf-8", "replace") for s, e in zip(starts, ends.tolist())]


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The worker's model of a file; kept from task to task."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(df: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The named columns and ids array<int> of each whole text."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in slices(batches, 512):
            flat, counts = model(path).encode(batch.column("text").to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids], names=[*keep, "ids"])

    return df.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{kinds}, ids array<int>")


def decode(df: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The named columns and decoded, the text of each ids array."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in slices(batches, 512):
            ids = batch.column("ids")
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = model(path).decode_all(ids.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return df.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(run, f"{kinds}, decoded string")


def pieces_of_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip: whether decoding gives the text back (U+2581 read as a space).

    Texts are encoded, and their ids decoded and compared, in one pass.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, 512):
            texts = batch.column("text").to_pylist()
            flat, counts = model(path).encode(texts)
            data, ends = model(path).decode_bytes(flat, counts)
            want = [(t or "").replace(SPACE, " ").encode("utf-8", "surrogatepass") for t in texts]
            same, at = [], 0
            for w, e in zip(want, ends.tolist()):
                same.append(data[at:e] == w)
                at = e
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), ids, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")
