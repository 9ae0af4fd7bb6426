"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the corpus itself, indexed in blocks. An anchor is the smallest of
the ``ANCHOR``-word hashes in a window of ``window`` words; equal windows have equal
anchors at equal places, so a document shares a window only with the block that
its anchor's hash selects. Every document is cut into pieces at its anchors: a piece
holds the windows of one anchor, with all words that those windows reach. In a
block the pieces with one anchor are indexed in document order, and each piece is
factored greedily against the earlier ones: a factor is the longest run of
consecutive windows that all start earlier in the reference. Pieces overlap by
``window - 1`` words, so a window that straddles a factor or piece boundary is
checked in exactly one piece. Factors that touch form one duplicate span.

A piece travels with ``DIGEST`` bytes of hash for each of its windows; two windows
are equal if they agree on the 64-bit anchor, its place in the window and these.

Hot anchors (found on a sample of the documents, which only chooses how rows
travel) are sent window by window, and each task sends a repeated piece once (of those
it remembers): a passage in a third of all documents is spread over all blocks.

Nulls and texts shorter than a window have no spans. Ids are numbers. Rows with a null
or repeated id are told apart by their text and come first, in an order of their own;
rows with the same id and text are one document, and a window is no copy of itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelight.llm import text as T

#: Words in an anchor.
ANCHOR = 6
#: One document in this many shows which anchors are hot.
SAMPLED = 64
#: Pieces whose first place a task remembers, 24 bytes each.
MET = 2_000_000
#: Bytes of hash for a window.
DIGEST = 8
PIECE = "anchor long, doc_id long, place long, digests binary"


def _anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of one document: hash and place of its anchor, the leftmost smallest."""
    grams = T.shingles(hashes, ANCHOR)
    span = window - ANCHOR + 1
    n = len(grams) - span + 1
    best, place = grams[:n].copy(), np.arange(n)
    for k in range(1, span):
        other = grams[k : k + n]
        less = other < best
        best[less] = other[less]
        place[less] = np.flatnonzero(less) + k
    return best, place


class Met:
    """Pieces a task has sent, by key, each with its earliest document and place; no more than ``MET`` are remembered."""

    def __init__(self):
        self.key, self.owner, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def earlier(self, key: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which pieces were sent for an earlier document, or an earlier place of the same one."""
        if not len(self.key):
            return np.zeros(len(key), bool)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return (self.key[i] == key) & ((self.owner[i] < owner) | ((self.owner[i] == owner) & (self.at[i] < at)))

    def add(self, key: np.ndarray, owner: np.ndarray, at: np.ndarray) -> None:
        if len(self.key) >= MET:
            return
        key, owner, at = (np.concatenate(x) for x in zip((self.key, self.owner, self.at), (key, owner, at), strict=True))
        order = np.lexsort((at, owner, key))
        k = key[order]
        order = order[np.concatenate([[True], k[1:] != k[:-1]])]
        self.key, self.owner, self.at = key[order], owner[order], at[order]


def _pieces(window: int, hot: np.ndarray):
    """Pieces of whole texts; a piece that the task has met earlier in the order of documents comes without digests, as a copy.

    ``place`` holds the anchor's place in words, then in 12 bits each the words from
    the piece's last and first window start to the anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            parts, owner, size = [], [], 0
            for first, data, offsets in T.slices(batch.column(1)):
                starts, ends, rows = T.words(data, offsets, T.SPACE)
                hashes = T.word_hashes(data, starts, ends)
                edges = np.searchsorted(rows, np.arange(len(offsets)))
                every = T.shingles(hashes, window)
                for row in np.flatnonzero(np.diff(edges) >= window):
                    a, b = edges[row], edges[row + 1]
                    best, place = _anchors(hashes[a:b], window)
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
                    stops = np.concatenate([cuts[1:], [len(place)]])
                    parts.append((best[cuts], place[cuts], cuts, stops, cuts + size, every[a : b - window + 1]))
                    size += len(place)
                    owner.append(np.full(len(cuts), ids[first + row]))
            if parts:
                anchor, at, cuts, stops, flat, every = (np.concatenate([p[i] for p in parts]) for i in range(6))
                yield emit(met, anchor, np.concatenate(owner), at, cuts, stops - cuts, flat, every)

    def emit(met, anchor, owner, at, start, n, flat, every) -> pa.RecordBatch:
        """Pieces of ``n`` windows from ``start``, whose hashes stand in ``every`` from ``flat``."""
        if len(hot) and (is_hot := np.isin(anchor, hot)).any():
            many = n[is_hot]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            one = np.repeat(flat[is_hot], many) + step
            r = np.repeat(at[is_hot] - start[is_hot], many) - step
            fine = (T.mixed(every[one] + r.astype(np.uint64)), np.repeat(owner[is_hot], many), np.repeat(at[is_hot], many),
                    np.repeat(start[is_hot], many) + step, np.ones(len(one), np.int64), one)
            rest = [x[~is_hot] for x in (anchor, owner, at, start, n, flat)]
            anchor, owner, at, start, n, flat = (np.concatenate(x) for x in zip(rest, fine, strict=True))
        high, low = at - start, at - start - n + 1
        whole = T.range_hash(every, flat, flat + n, T.STEP)
        key = T.mixed(anchor ^ T.mixed(whole + (low << 12 | high).astype(np.uint64)))
        order = np.lexsort((at, owner, key))
        k = key[order]
        head = np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), np.arange(len(k)), 0))
        # Not the first of equal pieces in this batch or before it, nor at the place of the first.
        copy = np.zeros(len(k), bool)
        copy[order] = (owner[order] != owner[order[head]]) | (at[order] != at[order[head]])
        copy |= met.earlier(key, owner, at)
        first = order[head == np.arange(len(k))]
        met.add(key[first], owner[first], at[first])
        # A copy needs no partner any more: it goes with a key of its own, to any block.
        anchor = np.where(copy, T.mixed(owner.astype(np.uint64) * np.uint64(31) + at.astype(np.uint64)), anchor)
        sent = np.where(copy, 0, n)
        index = np.repeat(flat - (np.cumsum(sent) - sent), sent) + np.arange(sent.sum())
        digests = every[index].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :DIGEST]
        offsets = np.concatenate([[0], np.cumsum(sent) * DIGEST]).astype(np.int32)
        valid = np.packbits(~copy, bitorder="little")
        packed = pa.Array.from_buffers(pa.binary(), len(k), [pa.py_buffer(valid), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(digests))])
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor.astype(np.int64)), pa.array(owner), pa.array(at << 24 | low << 12 | high), packed], names=["anchor", "doc_id", "place", "digests"]
        )

    return run


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers as their lowest bytes, then the next ones ...: high bytes are mostly zeros, which compress to nothing."""
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, wide).T).tobytes()


def _packed(blocks: int):
    """Pieces (``PIECE``) as one row for each batch and target block: (block, body). Copies have no digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, doc, place = (batch.column(c).to_numpy() for c in ("anchor", "doc_id", "place"))
            digests = batch.column("digests")
            sent = np.array(pc.is_valid(digests))
            offsets = np.frombuffer(digests.buffers()[1], np.int32)[digests.offset : digests.offset + len(digests) + 1].astype(np.int64)
            data = np.frombuffer(digests.buffers()[2], np.uint8) if digests.buffers()[2] is not None else np.zeros(0, np.uint8)
            size = np.diff(offsets)
            block = (T.mixed(anchor.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            order = np.lexsort((place, doc, block))
            cuts = np.searchsorted(block[order], np.arange(blocks + 1))
            bodies, used = [], np.flatnonzero(np.diff(cuts))
            for b in used:
                rows = order[cuts[b] : cuts[b + 1]]
                docs, which = np.unique(doc[rows], return_inverse=True)
                n = size[rows]
                index = np.repeat(offsets[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                head = np.array([len(rows), len(docs)], np.int64).tobytes()
                bodies.append(b"".join([
                    head, docs.tobytes(), np.ascontiguousarray(anchor[rows]).tobytes(), _planes(which, "<u4"), _planes(place[rows] >> 24, "<u8"),
                    _planes(place[rows] >> 12 & 4095, "<u2"), _planes(place[rows] & 4095, "<u2"), sent[rows].astype(np.uint8).tobytes(), data[index].tobytes(),
                ]))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(bodies, pa.binary())], names=["block", "body"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of packed rows."""
    for batch in batches:
        for body in batch.column("body"):
            raw = np.frombuffer(body.as_buffer(), np.uint8)
            n, many = (int(x) for x in raw[:16].view(np.int64))
            at = 16

            def take(wide: int, count: int, planes: bool = True) -> np.ndarray:
                nonlocal at
                part = raw[at : at + wide * count]
                at += wide * count
                return np.ascontiguousarray(part.reshape(wide, count).T if planes else part).view(f"<u{wide}").ravel()

            docs = take(8, many, False).astype(np.int64)
            anchor, which = take(8, n, False).astype(np.int64), take(4, n)
            start, low, high = take(8, n).astype(np.int64), take(2, n).astype(np.int64), take(2, n).astype(np.int64)
            sent = take(1, n, False).astype(bool)
            ends = np.cumsum(np.where(sent, (high - low + 1) * DIGEST, 0))
            column = pa.Array.from_buffers(
                pa.binary(), n, [pa.py_buffer(np.packbits(sent, bitorder="little")), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(raw[at:].tobytes())]
            )
            place = start << 24 | low << 12 | high
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(docs[which]), pa.array(place), column], names=["anchor", "doc_id", "place", "digests"])


def _factors(window: int):
    """Factors (doc_id, start, length in words) of the pieces of a block, which come sorted by anchor, document and place."""

    def record(doc, start, length) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))], names=["doc_id", "start", "length"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            copies = batch.filter(pc.is_null(batch.column("digests")))
            if copies.num_rows:
                doc, place = copies.column("doc_id").to_numpy(), copies.column("place").to_numpy()
                low, high = place >> 12 & 4095, place & 4095
                yield record(doc, (place >> 24) - high, window + high - low)
            rest = batch.filter(pc.is_valid(batch.column("digests")))
            if not rest.num_rows:
                continue
            keys = rest.column("anchor").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (held and held[0].column("anchor")[0].as_py() != keys[0]):
                yield from parse([*held, rest.slice(0, cut)])
                held = []
            held.append(rest.slice(cut))  # the last anchor may go on in the next batch
        yield from parse(held)

    def parse(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index all windows of each anchor and factor every piece against the earlier ones."""
        table = pa.Table.from_batches(held).combine_chunks() if held else None
        if table is None or not table.num_rows:
            return
        anchor = table.column("anchor").to_numpy()
        shared = np.zeros(len(anchor), bool)
        shared[1:] |= anchor[1:] == anchor[:-1]
        shared[:-1] |= anchor[:-1] == anchor[1:]
        if not shared.any():
            return
        table = table.filter(pa.array(shared)).combine_chunks()
        anchor, doc, place = (table.column(n).to_numpy() for n in ("anchor", "doc_id", "place"))
        at, low, high = place >> 24, place >> 12 & 4095, place & 4095
        raw = np.frombuffer(b"".join(table.column("digests").to_pylist()), np.uint8).reshape(-1, DIGEST)
        n = high - low + 1
        piece = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        group = np.cumsum(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        digest = np.zeros((len(raw), 8), np.uint8)
        digest[:, :DIGEST] = raw
        key = T.mixed(digest.view("<u8").ravel() ^ T.mixed((group[piece] << 12 | (high[piece] - step)).astype(np.uint64)))
        order = np.argsort(key, kind="stable")  # equal windows stay in document order
        k, rows = key[order], piece[order]
        head = np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), np.arange(len(k)), 0))
        found = np.zeros(len(k), bool)
        found[order] = (doc[rows] != doc[rows[head]]) | (at[rows] != at[rows[head]])
        # Greedy factors: maximal runs of found windows inside a piece.
        opens = found & np.concatenate([[True], ~found[:-1] | (piece[1:] != piece[:-1])])
        closes = found & np.concatenate([~found[1:] | (piece[1:] != piece[:-1]), [True]])
        first, last = np.flatnonzero(opens), np.flatnonzero(closes)
        yield record(doc[piece[first]], at[piece[first]] - high[piece[first]] + step[first], window + last - first)

    return run


def duplicate_spans(texts: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, spans): by document the factors (start, length) in words that occur earlier, in order of start.

    ``texts``: doc_id, a key for each document, and text, without nulls.
    """
    texts = texts.select("doc_id", "text")
    spark = T.tuned(texts.sparkSession)
    n = T.partitions(spark)
    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)
    counts = sample.mapInArrow(T.lean(_pieces(window, np.zeros(0, np.uint64))), PIECE).groupBy("anchor").agg(F.countDistinct("doc_id").alias("n"))
    # The hottest only, so the list stays bounded; any choice gives the same result.
    hottest = counts.filter("n >= 16").orderBy(F.desc("n"), "anchor").limit(4 * n).collect()
    hot = np.array([r.anchor for r in hottest], np.int64).astype(np.uint64)
    pack, cut = _packed(n), _pieces(window, hot)
    # Pieces travel packed, many in a row for each block; the block they lie in is that of their anchor.
    packed = texts.mapInArrow(T.lean(lambda batches: pack(cut(batches))), "block int, body binary").repartitionById(n, "block")
    pieces = packed.mapInArrow(_unpacked, PIECE).sortWithinPartitions("anchor", "doc_id", "place")
    factors = pieces.mapInArrow(T.lean(_factors(window)), "doc_id long, start int, length int")
    return factors.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))


def covered(n: int, spans) -> np.ndarray:
    """Which of ``n`` words lie in a span."""
    step = np.zeros(n + 1, np.int32)
    for start, length in spans or []:
        if start < n:
            step[start] += 1
            step[min(n, start + length)] -= 1
    return np.cumsum(step[:n]) > 0


def without_copies(docs: DataFrame, window: int = 20) -> DataFrame:
    """Rows of ``docs`` as a struct ``given``, with n_words, n_removed, kept_text and kept_sha256.

    ``kept_text`` is the text without the words of duplicate spans (null where there
    are none); what is kept keeps its own white space, and one space stands for what
    went. ``kept_sha256`` is of the kept words joined by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept, digest = [], [], [], []
            spans = batch.column("spans").to_pylist()
            for first, data, offsets in T.slices(batch.column("text")):
                starts, ends, rows = T.words(data, offsets, T.SPACE)
                edges = np.searchsorted(rows, np.arange(len(offsets)))
                raw = data.tobytes()
                for row in range(len(offsets) - 1):
                    a, b = edges[row], edges[row + 1]
                    left = ~covered(b - a, [(s["start"], s["length"]) for s in spans[first + row] or []])
                    words = np.flatnonzero(left) + a
                    joined = b" ".join([raw[i:j] for i, j in zip(starts[words].tolist(), ends[words].tolist(), strict=True)])
                    n.append(b - a)
                    gone.append(int(b - a - len(words)))
                    digest.append(hashlib.sha256(joined).hexdigest())
                    runs = np.flatnonzero(np.diff(np.concatenate([[False], left, [False]]).astype(np.int8))).reshape(-1, 2) + a
                    parts = b" ".join([raw[starts[i] : ends[j - 1]] for i, j in runs.tolist()])
                    kept.append(parts.decode("utf-8", "replace") if gone[-1] else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("given"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())],
                names=["given", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    keyed = T.separated(docs, F.struct("*").alias("given"))[0]
    # The text travels inside ``given`` alone. Equal rows share a key: their spans are a set.
    text = F.coalesce(F.col("given.text"), F.lit("")).alias("text")
    rows = keyed.select("given", "doc_id").join(duplicate_spans(keyed, window), "doc_id", "left").select("given", text, "spans")
    schema = StructType([rows.schema["given"]]).add("n_words", "long").add("n_removed", "long").add("kept_text", "string").add("kept_sha256", "string")
    return rows.mapInArrow(T.lean(run), schema)
