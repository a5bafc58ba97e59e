"""Repeated passages by enhanced suffix arrays and their common-prefix intervals.

A byte goes if a string of ``window`` bytes that covers it also starts earlier,
in a smaller doc_id or earlier in the same document.  The strings of the corpus
are split so that equal ones meet:

1.  Each window is owned by its minimiser, the window's GRAM-byte string with the
    least hash.  Neighbouring windows with one minimiser form a piece, so every
    window lies in exactly one piece and equal windows lie in pieces that share
    the minimiser.  Of equal pieces, compared byte by byte, a task sends the first
    with their number; the others are whole repeats.  Pieces travel in compressed
    blocks to buckets by minimiser.  Minimisers of very many different pieces,
    measured on a sample, are split: first by the bytes next to the minimiser on
    the side where all the piece's windows have them, then by whole windows.  The
    sample decides where strings meet, never what is found.
2.  In a bucket, distinct pieces are strings with a list of occurrences each, the
    leaves' multiplicities.  Those that share a minimiser get an enhanced suffix
    array over their window starts (a single one is a tree of one leaf, as no two
    windows of a piece are equal).  A stack scan of the common prefixes yields the
    intervals of the prefix tree; an interval or leaf of several occurrences that
    are preceded by different bytes is a maximal repeat, reported with all its
    occurrences.  All but the first occurrence are covered bytes.
3.  Covered spans gather by document and join the documents, which are cut.

A bucket holds pieces of about BUCKET_BYTES of text.

Defined results: a null text is empty; a text shorter than the window loses
nothing; rows with a null doc_id come before all others; rows with equal doc_id
are ordered by a hash of their text, and rows equal in both are one document,
each of which gets its result.  Other columns pass through ``deduplicate``.
Cutting bytes can split a UTF-8 character; the text form drops broken ones.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, hash_share, input_bytes, release, shuffle_partitions, slices
from .pieces import runs

WINDOW = 100
GRAM = 24
BUCKET_BYTES = 2 << 20
FLUSH_BYTES = 6 << 20
PART_BYTES = 1 << 20
BATCH_BYTES = 2 << 20
STRETCH_BYTES = 1 << 18
#: Different pieces of a minimiser beyond which it is split; the sample that tells: its least bytes and share, and how many it names at most.
HOT_PIECES, SAMPLE_BYTES, SAMPLE_SHARE, HOT_KEYS = 50_000, 32 << 20, 1 / 256, 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


def _window_hashes(data: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hashes of all strings of the given lengths, from those of doubled lengths.

    Values at places where no string of the length fits mean nothing.
    """
    level, size, power = data.astype(U), 1, BASE
    level += U(1)
    hashed: dict[int, tuple] = {n: (None, 0) for n in lengths}
    while size <= max(lengths):
        for n in lengths:
            if n & size:  # append the next ``size`` bytes to what is hashed so far
                h, done = hashed[n]
                if h is None:
                    hashed[n] = level.copy(), size
                else:
                    h *= power
                    h[: len(level) - done] += level[done:]
                    hashed[n] = h, done + size
        wide = level * power
        wide[: max(len(level) - size, 0)] += level[size:]
        with np.errstate(over="ignore"):
            level, power = wide, power * power
        size *= 2
    return [hashed[n][0] for n in lengths]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values; the last width - 1 results are cut off."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def pieces(data: np.ndarray, doc_ends: np.ndarray, window: int = WINDOW, gram: int = GRAM, hot: tuple = ()):
    """Pieces of concatenated documents: first and last window start, key, content hash and, for ``hot_keys``, the key if split.

    data: under 2**24 bytes.  hot: sorted keys of minimisers that are split by the
    bytes beside them, and of such splits that are split into windows.
    """
    n = len(data)
    empty = tuple(np.zeros(0, d) for d in (np.int64, np.int64, U, U, U))
    if n < window:
        return empty
    reach = (window - gram) // 2  # bytes beside the minimiser that all windows of a side hold
    grams, windows, beside = _window_hashes(data, (gram, window, reach))
    place = np.arange(n, dtype=U)
    ranked = ((_mix(grams) >> U(24)) << U(24)) | place
    owner = (_sliding_min(ranked, window - gram + 1)[: n - window + 1] & U((1 << 24) - 1)).astype(np.int64)
    left = np.repeat(doc_ends, np.diff(np.concatenate([[0], doc_ends]))) - np.arange(n)
    starts = np.flatnonzero(left[: n - window + 1] >= window)
    if not len(starts):
        return empty
    new = np.concatenate([[True], (np.diff(starts) > 1) | (np.diff(owner[starts]) != 0) | (left[starts[1:]] > left[starts[:-1]])])
    first = starts[new]
    last = starts[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]
    at = owner[first]
    key = _mix(grams[at])

    def sided(key, at, first):
        """The key with the bytes on the side that the windows hold: after the minimiser if it stands in their first half."""
        after = at - first <= reach
        return _mix(key * U(7) + beside[np.where(after, np.minimum(at + gram, n - 1), np.maximum(at - reach, 0))] * U(11) + after.astype(U))

    if len(hot) and len(hot[0]):
        split = np.isin(key, hot[0])
        f, t, a, k = first[split], last[split], at[split], key[split]
        edge = a - reach  # the first window that holds the bytes after the minimiser
        lo, hi = f < edge, t >= edge
        f2, t2, a2 = np.concatenate([f[lo], np.maximum(f, edge)[hi]]), np.concatenate([np.minimum(t, edge - 1)[lo], t[hi]]), np.concatenate([a[lo], a[hi]])
        k2 = sided(np.concatenate([k[lo], k[hi]]), a2, f2)
        if len(hot[1]):
            single = np.isin(k2, hot[1])
            at_ = runs(f2[single], (t2 - f2 + 1)[single])
            k3 = _mix(windows[at_] * U(13) + U(1))
            f2, t2, a2, k2 = np.concatenate([f2[~single], at_]), np.concatenate([t2[~single], at_]), np.concatenate([a2[~single], at_]), np.concatenate([k2[~single], k3])
        first, last, at, key = np.concatenate([first[~split], f2]), np.concatenate([last[~split], t2]), np.concatenate([at[~split], a2]), np.concatenate([key[~split], k2])
    content = _mix(windows[first] * U(3) + windows[last] * U(5) + (last - first).astype(U) * BASE + (at - first).astype(U))
    return first, last, key, content, sided(key, at, first)


def equal_to_heads(text: bytes, begin: np.ndarray, size: np.ndarray, head: np.ndarray) -> np.ndarray:
    """``head`` (the number of the first row that has this row's hashes), with rows whose bytes differ from that row's as heads of their own."""
    head = head.copy()
    own = np.flatnonzero(head != np.arange(len(head)))
    b, n, h = begin[own].tolist(), size[own].tolist(), head[own]
    hb, hn = begin[h].tolist(), size[h].tolist()
    differ = [k for k in range(len(own)) if n[k] != hn[k] or text[b[k] : b[k] + n[k]] != text[hb[k] : hb[k] + n[k]]]
    head[own[differ]] = own[differ]
    return head


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Spans joined into maximal runs within each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    shift = np.int64(end.max() + 1)
    reach = np.maximum.accumulate(doc * shift + end)  # documents are numbered, so one scan serves all
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (doc[1:] * shift + start[1:] > reach[:-1])])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)


# ----- enhanced suffix array of a bucket


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U)
    out = padded[: len(data)].copy()
    for k in range(1, 8):
        out = (out << U(8)) | padded[k : k + len(data)]
    return out


def suffix_array(data: np.ndarray, group: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (sorted by group already) in lexicographic order inside their groups.

    A suffix is data[at:end].  Returns the order and, for each place, the length
    of the common prefix with the suffix before it (0 where a group begins).
    Only suffixes still tied after 8t bytes look at bytes 8t to 8t + 8.
    """
    n = len(at)
    words = _words(data)
    order, common = np.arange(n), np.zeros(n, np.int64)
    segment = np.searchsorted(group, group, side="left")  # a segment is named by its first place
    size = end - at
    active = np.arange(n)
    active = active[(np.searchsorted(group, group, side="right") - segment > 1)]
    depth = 0
    while len(active):
        rows = order[active]
        room = size[rows] - depth
        w = np.where(room > 0, words[np.minimum(at[rows] + depth, len(words) - 1)], U(0))
        w = np.where((room > 0) & (room < 8), w & ~((U(1) << (U(8) * (U(8) - np.clip(room, 0, 7).astype(U)))) - U(1)), w)
        by = np.lexsort((w, segment[active]))
        w, rows = w[by], rows[by]
        order[active] = rows
        own = segment[active]
        starts = np.concatenate([[True], own[1:] != own[:-1]])
        split = ~starts & np.concatenate([[False], w[1:] != w[:-1]])
        x = w[1:] ^ w[:-1]
        same = np.zeros(len(w), np.int64)
        for k in range(1, 8):
            same[1:] += x < (U(1) << U(64 - 8 * k))
        common[active[split]] = depth + same[split]
        first = np.where(starts | split, np.arange(len(active)), 0)
        segment[active] = active[np.maximum.accumulate(first)]
        depth += 8
        run = np.concatenate([np.flatnonzero(starts | split), [len(active)]])
        big = np.repeat(np.diff(run) > 1, np.diff(run))
        # a run all of whose suffixes have ended agrees up to the shorter of two neighbours
        longest = np.repeat(np.maximum.reduceat(size[rows], run[:-1]), np.diff(run)) if len(active) else size[:0]
        ended = big & (longest <= depth)
        inner = ended & ~(starts | split)
        common[active[inner]] = depth
        active = active[big & ~ended]
    short = np.minimum(size[order], np.concatenate([[0], size[order][:-1]])) if n else common
    return order, np.minimum(common, short)


def maximal_repeats(order: np.ndarray, common: np.ndarray, before: np.ndarray, least: int, whole: np.ndarray | None = None):
    """Maximal repeats of at least ``least`` bytes: (first place, last place, length) in the suffix array.

    ``before`` is the byte before each suffix (by place), or a number of its own
    where there is none.  The stack holds the open intervals of the common-prefix
    tree as [start, length, byte before all of them or None].  Stretches whose
    suffixes all have one byte before them hold no maximal repeat and are skipped.
    ``whole`` gives, by place, the length of a leaf that is a repeat by itself,
    being several equal strings in one, and 0 for any other.
    """
    if whole is not None:
        for k in np.flatnonzero(whole >= least).tolist():
            yield k, k, int(whole[k])
    deep = common >= least
    if not deep.any():
        return
    edge = np.flatnonzero(np.diff(np.concatenate([[0], deep.astype(np.int8), [0]])))
    for start, stop in zip(edge[::2] - 1, edge[1::2]):  # places start .. stop - 1 share at least ``least`` bytes
        own = before[start:stop]
        if (own == own[0]).all():
            continue
        stack: list[list] = []
        lengths, marks = common[start + 1 : stop].tolist() + [0], own.tolist()
        for k, length in enumerate(lengths):
            mark, left = marks[k], k
            while stack and stack[-1][1] > length:
                left, size, one = stack.pop()
                if one is not None and one != mark:
                    one = None
                if one is None:
                    yield start + left, start + k, size
                mark = one
            if length < least:
                continue
            if stack and stack[-1][1] == length:
                if stack[-1][2] != mark:
                    stack[-1][2] = None
            else:
                stack.append([left, length, mark])


def repeats_in_bucket(data: np.ndarray, key: np.ndarray, size: np.ndarray, offset: np.ndarray, copies: np.ndarray, window: int = WINDOW):
    """Maximal repeats among distinct pieces of one bucket.

    Piece k is data[offset[k] : offset[k] + size[k]] and stands for copies[k]
    equal ones.  Yields for each repeat its length and its occurrences as
    (piece, start in the piece); each counts for all copies of the piece.  Keys in
    order of size; pieces alone in their key are trees of one leaf.
    """
    by = np.argsort(key, kind="stable")
    key, size, offset, copies = key[by], size[by], offset[by], copies[by]
    start = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    many = np.diff(np.append(np.flatnonzero(start), len(key)))
    alone = np.repeat(many == 1, many)
    for k in np.flatnonzero(alone & (copies > 1)).tolist():
        yield int(size[k]), by[k : k + 1], np.zeros(1, np.int64)
    by, key, size, offset, copies = (x[~alone] for x in (by, key, size, offset, copies))
    low = 0
    while low < len(key):  # minimisers in chunks of bounded size
        high = min(low + (1 << 14), len(key))
        while high < len(key) and key[high] == key[high - 1]:
            high += 1
        x = slice(low, high)
        n = size[x]
        ends = np.cumsum(n)
        own = data[runs(offset[x], n)]
        count = n - window + 1
        piece = np.repeat(np.arange(len(n)), count)
        step = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        at = (ends - n)[piece] + step
        order, common = suffix_array(own, key[x][piece], at, ends[piece])
        before = np.where(step > 0, own[np.maximum(at - 1, 0)].astype(np.int64), -1 - np.arange(len(at)))[order]
        whole = np.where((step == 0) & (copies[x][piece] > 1), n[piece], 0)[order]
        of, at_step = by[x][piece][order], step[order]
        for a, b, length in maximal_repeats(order, common, before, window, whole):
            yield length, of[a : b + 1], at_step[a : b + 1]
        low = high


# ----- Spark


def _pack(sections: list[np.ndarray], text: bytes, press) -> bytes:
    head = struct.pack(f"<{len(sections)}Q", *(len(s) for s in sections))
    return press(head + b"".join(s.tobytes() for s in sections) + text)


_KINDS = ("<i8", "<i8", "u1", "<u4", "<u8", "<u4", "<u4", "u1", "<u4", "<u4", "<u4", "<u4")


_SPAN_KINDS = ("<i8", "<i8", "u1", "<u4", "<u4", "<u4")


def _unpack(blob: bytes, kinds: tuple[str, ...] = _KINDS):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = struct.unpack_from(f"<{len(kinds)}Q", raw)
    at, out = 8 * len(kinds), []
    for kind, n in zip(kinds, sizes):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out, np.frombuffer(raw, np.uint8, offset=at)


def _order_docs(doc: np.ndarray, mark: np.ndarray, known: np.ndarray):
    """Number the documents by (null first, doc_id, mark); equal ones share a number."""
    by = np.lexsort((mark, doc, known))
    new = np.concatenate([[0], np.cumsum((doc[by][1:] != doc[by][:-1]) | (mark[by][1:] != mark[by][:-1]) | (known[by][1:] != known[by][:-1]))]) if len(by) else by
    rank = np.empty(len(by), np.int64)
    rank[by] = new
    return rank, by[np.concatenate([[True], np.diff(new) > 0])] if len(by) else by


def _blocks(batches, buckets: int, hot: tuple = ()):
    """Stage 1: compressed blocks (bucket, block) of pieces and of local spans."""
    press = zstandard.ZstdCompressor(level=5).compress

    def flush(docs: list, raws: list[bytes]):
        data = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum([len(r) for r in raws]).astype(np.int64)
        base = np.concatenate([[0], ends[:-1]])
        found, low = [], 0  # in stretches that stay in the processor's cache
        while low < len(ends):
            high = int(np.searchsorted(ends, base[low] + STRETCH_BYTES, side="right"))
            high = max(high, low + 1)
            f, t, k, c, _ = pieces(data[base[low] : ends[high - 1]], ends[low:high] - base[low], hot=hot)
            found.append((f + base[low], t + base[low], k, c))
            low = high
        first, last, key, content = (np.concatenate([f[k] for f in found]) for k in range(4))
        found = None
        known = np.array([d[0] is not None for d in docs], np.uint8)
        doc = np.array([d[0] or 0 for d in docs], np.int64)
        mark = np.array([d[1] for d in docs], np.int64)
        rank, _ = _order_docs(doc, mark, known)
        of = np.searchsorted(ends, first, side="right")
        place = first - base[of] + np.array([d[2] for d in docs], np.int64)[of]
        buf = data.tobytes()
        # of equal pieces the first is passed on with their number; the others are repeats as a whole
        by = np.lexsort((place, rank[of], content, key))
        k, c, r, p = key[by], content[by], rank[of][by], place[by]
        lead = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(by) else np.zeros(0, bool)
        head = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(by) else np.zeros(0, np.int64)
        head = equal_to_heads(buf, first[by], (last - first)[by] + WINDOW, head)
        lead = head == np.arange(len(by))
        same = (r == r[head]) & (p == p[head])  # a repeated row, not a repeat
        late = by[~same]
        copies = 1 + np.bincount(head[~same], minlength=len(by))[lead]
        sd, ss, se = merge_spans(of[late], place[late], place[late] + (last - first)[late] + WINDOW)
        sent = by[lead]
        to_piece, to_span = (key[sent] % U(buckets)).astype(np.int64), (mark[sd] ^ doc[sd]) % buckets
        order_p, order_s = np.argsort(to_piece, kind="stable"), np.argsort(to_span, kind="stable")
        sent, copies, sd, ss, se = sent[order_p], copies[order_p], sd[order_s], ss[order_s], se[order_s]
        targets = np.unique(np.concatenate([to_piece, to_span]))
        ids, blobs, packed = [], [], 0
        tp, tsn = to_piece[order_p], to_span[order_s]
        for b in targets.tolist():
            own = slice(np.searchsorted(tp, b), np.searchsorted(tp, b, side="right"))
            x = sent[own]
            lo, hi = np.searchsorted(tsn, b), np.searchsorted(tsn, b, side="right")
            used, local = np.unique(np.concatenate([of[x], sd[lo:hi]]), return_inverse=True)
            text = b"".join([buf[s:e] for s, e in zip(first[x].tolist(), (last[x] + WINDOW).tolist())])
            sections = [doc[used].astype("<i8"), mark[used].astype("<i8"), known[used], (key[x] >> U(32)).astype("<u4"), content[x].astype("<u8"), local[: len(x)].astype("<u4"), place[x].astype("<u4"), (last - first)[x].astype("u1"), local[len(x) :].astype("<u4"), ss[lo:hi].astype("<u4"), se[lo:hi].astype("<u4"), copies[own].astype("<u4")]
            ids.append(b)
            blobs.append(_pack(sections, text, press))
            packed += len(blobs[-1])
            if packed > BATCH_BYTES or b == targets[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "block"])
                ids, blobs, packed = [], [], 0

    docs, raws, size = [], [], 0
    for batch in slices(batches, 2048):
        for d, m, t in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), batch.column("text").to_pylist()):
            raw = (t or "").encode("utf-8", "surrogatepass")
            for k in range(0, len(raw) - WINDOW + 1, PART_BYTES):  # parts of a very long text share no window start
                part = raw[k : k + PART_BYTES + WINDOW - 1]
                if size and size + len(part) > FLUSH_BYTES:
                    yield from flush(docs, raws)
                    docs, raws, size = [], [], 0
                docs.append((d, m, k))
                raws.append(part)
                size += len(part)
    if docs:
        yield from flush(docs, raws)


def _spans_of_bucket(table: pa.Table, buckets: int) -> pa.Table:
    """Stage 2: covered spans found in one bucket, in blocks by the documents' own bucket."""
    parts = [_unpack(b) for b in table.column("block").to_pylist()]
    sizes = [len(p[0][0]) for p in parts]
    base = np.cumsum([0, *sizes])
    doc, mark, known = (np.concatenate([p[0][k] for p in parts]) for k in range(3))
    rank, lead = _order_docs(doc, mark, known)
    key, content = (np.concatenate([p[0][k] for p in parts]) for k in (3, 4))
    of = rank[np.concatenate([p[0][5].astype(np.int64) + b for p, b in zip(parts, base)])]
    place = np.concatenate([p[0][6] for p in parts]).astype(np.int64)
    more = np.concatenate([p[0][7] for p in parts]).astype(np.int64)
    data = np.concatenate([p[1] for p in parts])
    offset = np.cumsum(more + WINDOW) - (more + WINDOW)
    spans = [(rank[np.concatenate([p[0][8].astype(np.int64) + b for p, b in zip(parts, base)])], *(np.concatenate([p[0][k] for p in parts]).astype(np.int64) for k in (9, 10)))]
    copies = np.concatenate([p[0][11] for p in parts]).astype(np.int64)
    parts = None  # the unpacked blocks go before the tree is built
    # distinct pieces, each with its occurrences (those of one task being one with their number)
    by = np.lexsort((place, of, content, key))
    key, content, of, place, more, offset, copies = (x[by] for x in (key, content, of, place, more, offset, copies))
    if len(by):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])])
        head = equal_to_heads(data.tobytes(), offset, more + WINDOW, np.flatnonzero(new)[np.cumsum(new) - 1])
        heads, group = np.unique(head, return_inverse=True)
        again = (head == np.arange(len(head))) | (of != of[head]) | (place != place[head])  # else a repeated row, not a repeat
        number = np.bincount(group, weights=np.where(again, copies, copies - 1), minlength=len(heads)).astype(np.int64)
        members = np.argsort(group, kind="stable")  # of each piece its occurrences, the first first
        first_member = np.searchsorted(group[members], np.arange(len(heads) + 1))
        found = list(repeats_in_bucket(data, key[heads], more[heads] + WINDOW, offset[heads], number))
        # an interval's occurrences are all of its pieces'; beyond each piece's first they lie in the piece's own leaf
        leaf = np.array([x[0] for _, x, _ in found if len(x) == 1], np.int64)
        own = members[runs(first_member[leaf] + 1, first_member[leaf + 1] - first_member[leaf] - 1)]
        own = own[again[own]]
        spans.append((of[own], place[own], place[own] + more[own] + WINDOW))
        found = [x for x in found if len(x[1]) > 1]
        if found:
            size = np.array([len(x) for _, x, _ in found])
            where = heads[np.concatenate([x for _, x, _ in found])]
            d, s = of[where], place[where] + np.concatenate([x for _, _, x in found])
            e = s + np.repeat([n for n, _, _ in found], size)
            interval = np.repeat(np.arange(len(found)), size)
            o = np.lexsort((s, d, interval))
            late = o[np.concatenate([[False], interval[o][1:] == interval[o][:-1]])]
            spans.append((d[late], s[late], e[late]))
    d, s, e = (np.concatenate([x[k] for x in spans]) for k in range(3))
    d, s, e = merge_spans(d, s, e)
    press = zstandard.ZstdCompressor(level=1).compress
    who, local = np.unique(d, return_inverse=True)
    who = lead[who]
    to = ((mark[who] ^ doc[who]) % buckets)[local]
    by = np.argsort(to, kind="stable")
    targets, first = np.unique(to[by], return_index=True)
    out = []
    for x in np.split(by, first[1:]):
        used, own = np.unique(local[x], return_inverse=True)
        w = who[used]
        out.append(_pack([doc[w].astype("<i8"), mark[w].astype("<i8"), known[w], own.astype("<u4"), s[x].astype("<u4"), e[x].astype("<u4")], b"", press))
    return pa.table({"bucket": pa.array(targets, pa.int64()), "block": pa.array(out[: len(targets)], pa.binary())})


def _spans_of_documents(table: pa.Table) -> pa.Table:
    """Stage 3: the blocks of one bucket of documents, as a row (s_id, s_mark, spans) for each document."""
    parts = [_unpack(b, _SPAN_KINDS)[0] for b in table.column("block").to_pylist()]
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    doc, mark, known = (np.concatenate([p[k] for p in parts]) for k in range(3))
    rank, lead = _order_docs(doc, mark, known)
    d = rank[np.concatenate([p[3].astype(np.int64) + b for p, b in zip(parts, base)])]
    d, s, e = merge_spans(d, *(np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (4, 5)))
    if not len(d):
        return _SPANS.empty_table()
    edge = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    flat = np.column_stack([s, e]).ravel()
    offsets = pa.array(np.concatenate([edge, [len(d)]]) * 2, pa.int32())
    who = lead[d[edge]]
    ids = pa.array(doc[who], pa.int64(), mask=known[who] == 0)
    return pa.Table.from_arrays([ids, pa.array(mark[who], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))], schema=_SPANS)


_SPANS = pa.schema([("s_id", pa.int64()), ("s_mark", pa.int64()), ("spans", pa.list_(pa.int32()))])


def hot_keys(docs: DataFrame, pieces_of_key: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of minimisers, and of their splits, that have more than about ``pieces_of_key`` different pieces.

    Counted on a sample of the documents that grows with them; at most HOT_KEYS
    keys of each kind, the most frequent.
    """
    most = pieces_of_key or HOT_PIECES
    size = input_bytes(docs)
    share = min(1.0, max(SAMPLE_BYTES / size, SAMPLE_SHARE)) if size else 1.0

    def count(batches):
        for batch in slices(batches, 1024):
            raws = [r for r in ((t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()) if len(r) >= WINDOW]
            for part in _stretches(raws):
                data = np.frombuffer(b"".join(part), np.uint8)
                _, _, key, content, split = pieces(data, np.cumsum([len(r) for r in part]))
                _, one = np.unique(content, return_index=True)
                for level, k in enumerate((key[one], split[one])):
                    names, n = np.unique(k, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), level), pa.int32()), pa.array(names.view(np.int64)), pa.array(n, pa.int64())], names=["level", "key", "n"])

    rows = docs.where(hash_share(F.xxhash64("doc_id", "text"), share)).select("text").mapInArrow(count, "level int, key long, n long")
    hot = rows.groupBy("level", "key").agg(F.sum("n").alias("n")).where(F.col("n") > max(most * share / 2, 8))
    found = hot.orderBy(F.col("n").desc()).limit(2 * HOT_KEYS).collect()
    return tuple(np.sort(np.array([r["key"] for r in found if r["level"] == level], np.int64).view(U)) for level in (0, 1))


def _stretches(raws: list[bytes]):
    """Lists of texts of about STRETCH_BYTES; a longer text comes in parts that share all windows but none twice."""
    part, size = [], 0
    for r in raws:
        for k in range(0, len(r) - WINDOW + 1, PART_BYTES):
            piece = r[k : k + PART_BYTES + WINDOW - 1]
            if part and size + len(piece) > STRETCH_BYTES:
                yield part
                part, size = [], 0
            part.append(piece)
            size += len(piece)
    if part:
        yield part


def _found_spans(docs: DataFrame) -> DataFrame:
    buckets = max(shuffle_partitions(docs.sparkSession), input_bytes(docs) // BUCKET_BYTES)
    hot = hot_keys(docs)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    blocks = marked.mapInArrow(lambda it: _blocks(it, buckets, hot), "bucket long, block binary")
    spans = blocks.groupBy("bucket").applyInArrow(lambda t: _spans_of_bucket(t, buckets), "bucket long, block binary")
    return spans.groupBy("bucket").applyInArrow(_spans_of_documents, "s_id long, s_mark long, spans array<int>")


def covered_spans(docs: DataFrame, space: Workspace) -> DataFrame:
    """s_id, s_mark, spans: the covered spans of each document that has any, as pairs of start and end."""
    spans = space.write(_found_spans(docs), "spans")
    release(docs.sparkSession)  # nothing refers to the blocks any more
    return spans


def cut(raw: bytes, spans: list[int] | None) -> tuple[bytes, int, int]:
    """What is left of the bytes, how many went, and in how many runs."""
    if not spans:
        return raw, 0, 0
    pairs = np.asarray(spans, np.int64).reshape(-1, 2)
    _, start, end = merge_spans(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
    keep, at = [], 0
    for s, e in zip(start.tolist(), end.tolist()):
        keep.append(raw[at:s])
        at = e
    keep.append(raw[at:])
    return b"".join(keep), int((end - start).sum()), len(start)


def deduplicate(docs: DataFrame, names: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """The named columns of the documents, as one column ``row``, with kept, n_bytes, n_removed and n_spans.

    kept is binary, or with ``as_text`` the string without broken characters.
    """
    names = docs.columns if names is None else names
    space = Workspace(docs.sparkSession, "suffix")
    spans = covered_spans(docs, space)
    row = F.struct(*(F.col(f"`{c}`") for c in names if c != "text"))
    wide = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"), "text")
    # spans grow with the documents, so the join is a merge at every size
    joined = wide.join(spans.hint("merge"), F.col("id").eqNullSafe(F.col("s_id")) & (F.col("mark") == F.col("s_mark")), "left").select("row", "text", "spans")
    kept = T.StringType() if as_text else T.BinaryType()
    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("kept", kept), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))])

    def run(batches):
        for batch in slices(batches, 2048):
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            done = [cut(r, p) for r, p in zip(raws, batch.column("spans").to_pylist())]
            text = batch.column("text") if as_text else pa.nulls(batch.num_rows, pa.string())
            cols = [pa.array([d[0].decode("utf-8", "ignore") for d in done], pa.string()) if as_text else pa.array([d[0] for d in done], pa.binary()), pa.array([len(r) for r in raws], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), text, *cols], names=["row", "text", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(run, schema)


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = deduplicate(docs.select("doc_id", "text"), ["doc_id"])
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their own columns and their texts cut; n_chars, if there is one, follows the text.

    Documents of which nothing is left go, unless they were empty before.
    """
    out = deduplicate(docs, as_text=True)
    less = F.col("n_removed") > 0
    out = out.where(~less | (F.length("kept") > 0))

    def column(c: str):
        if c == "text":
            return F.when(less, F.col("kept")).otherwise(F.col("text"))
        own = F.col("row").getField(c)
        return F.when(less, F.length("kept").cast(docs.schema[c].dataType)).otherwise(own) if c == "n_chars" else own

    return out.select(*(column(c).alias(c) for c in docs.columns))
