"""Alignment of two tokenizers on the same texts, by pointer jumping.

A text is encoded whole by both. Tokens are byte ranges of a space and the text; two
tokens of different sides overlap if their ranges do. Every token points to the
overlapping token that reaches farthest to the right (a token whose end is also an end
of the other side is final, on the first side). Successors are doubled for all tokens of
a run of texts at once until nothing moves: then each token points to the final token
of its component, which is its group. Groups are what lies between the offsets where
both sides end a token.

A pair of ids is linked where tokens of these ids overlap; its count is the number of
documents that hold it. Each task counts its documents' pairs before anything is
shuffled. Tables of at most ``SENT_PAIRS`` pairs go to every task; larger ones are
joined with the documents' pairs, frequent pairs in slices.

Null and empty texts, and texts whose tokens' bytes are not the text's (such as a text
with U+2581, which the second vocabulary writes for a space), have no tokens and zeros
everywhere. Every row is a document of its own, also where ids are null or repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm import text as T
from tracelight.llm.tokens import ChunkedEncoder, TextEncoder, byte_letters, default_vocabulary
from tracelight.operators.joins import spread_join
from tracelight.session import cut_lineage

#: Pairs of ids that may be sent to every task, 17 bytes each.
SENT_PAIRS = 1_000_000
#: Pairs that a task holds before it sends on what it has counted.
HELD_PAIRS = 2_000_000
#: Chunks of text whose ids a worker keeps for each vocabulary.
KEPT = 250_000
#: What stands for a space in pieces.
BLANK = "▁"
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


class PieceEncoder(ChunkedEncoder):
    """Ids of texts under a piece vocabulary that puts a space before each text.

    Where no piece holds a space after another sign, nor a line break, words never share
    a piece, so their ids are kept like those of ``TextEncoder``.
    """

    def __init__(self, path: str, kept: int = KEPT):
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_file=path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.lone = self.pieces.piece_to_id(BLANK)
        apart = all(BLANK not in n.lstrip(BLANK) and "\n" not in n for n in names)
        plain = self._encode(["\n"])[0][:1] == [self.lone] and self._encode(["x  x "])[0][-1:] == [self.lone]
        super().__init__(apart and plain, True, ("\0", BLANK), kept)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return self._encode(texts)  # the vocabulary puts the space

    def _learn(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # After a line break there is no space: the one the vocabulary puts before the chunk is taken off.
        texts = chunks.to_pylist()
        lists = [ids[1:] if c[:1] == "\n" else ids for c, ids in zip(texts, self._encode(texts), strict=True)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))
        size[pc.binary_length(chunks).to_numpy() == 0] = -1
        return flat, size

    def token_bytes(self) -> list[bytes]:
        p = self.pieces
        names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        return [bytes([int(n[3:5], 16)]) if p.is_byte(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(names)]


class SpacedTextEncoder(TextEncoder):
    """Ids of a space and the text; strings of added tokens are plain text."""

    def __init__(self, path: str, kept: int = KEPT):
        super().__init__(path, spaced=True, kept=kept)

    def token_bytes(self) -> list[bytes]:
        back = {c: b for b, c in byte_letters().items()}
        names = [self.whole.id_to_token(i) or "" for i in range(self.whole.get_vocab_size())]
        # A token with a sign beyond the alphabet is an added one, which plain text never becomes.
        return [bytes(back[c] for c in n) if all(c in back for c in n) else n.encode() for n in names]


@dataclass
class Side:
    """An encoder with its tokens' bytes and decimal ids, laid out for lookups of many at once."""

    encoder: ChunkedEncoder
    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray
    digits: np.ndarray
    n_digits: np.ndarray

    @classmethod
    def of(cls, encoder: ChunkedEncoder) -> Side:
        parts = encoder.token_bytes()
        size = np.array([len(p) for p in parts], np.int64)
        names = [str(i).encode() for i in range(len(parts))]
        wide = max(map(len, names))
        digits = np.frombuffer(b"".join(n.ljust(wide, b"\0") for n in names), np.uint8).reshape(len(names), wide)
        return cls(encoder, np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size, digits, np.array([len(n) for n in names]))

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.flat[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def sides(first: str, second: str) -> tuple[Side, Side]:
    """The worker's sides for two vocabulary files, made once."""
    kept = T.worker_state().setdefault("alignment", {})
    if (first, second) not in kept:
        kept[first, second] = Side.of(SpacedTextEncoder(first)), Side.of(PieceEncoder(second))
    return kept[first, second]


def successors(ends_a: np.ndarray, ends_b: np.ndarray, reach: int) -> np.ndarray:
    """For each token (all of the first side, then all of the second): the overlapping one that ends last.

    ``ends`` are ascending ends of tokens that fill the same ``reach`` bytes.
    """
    counts = []
    for ends in (ends_a, ends_b):
        is_end = np.zeros(reach + 1, np.int64)
        is_end[ends] = 1
        counts.append(np.cumsum(is_end) - is_end)  # ends before each offset
    to_b, to_a = counts[1][ends_a], counts[0][ends_b]
    own = np.arange(len(ends_a))
    return np.concatenate([np.where(ends_b[to_b] == ends_a, own, len(ends_a) + to_b), to_a])


def terminals(succ: np.ndarray) -> np.ndarray:
    """The last token of each token's chain, by doubling."""
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            return succ
        succ = further


def _same_bytes(side: Side, ids: np.ndarray, at: np.ndarray, whole: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which texts (bytes whole[edges[i] : edges[i + 1]]) their tokens spell."""
    n = np.concatenate([[0], np.cumsum(side.size[ids])])[at]
    good = np.diff(n) == np.diff(edges)
    spelt = side.bytes_of(ids)
    if not good.all():  # the others' bytes do not lie in the same places
        keep = np.repeat(good, np.diff(n))
        wanted = np.repeat(good, np.diff(edges))
        differs = spelt[keep] != whole[wanted]
        owner = np.repeat(np.flatnonzero(good), np.diff(edges)[good])
    else:
        differs = spelt != whole
        owner = None
    bad = np.flatnonzero(differs)
    if len(bad):
        good[np.searchsorted(edges, bad, "right") - 1 if owner is None else owner[bad]] = False
    return good


def _only(ids: np.ndarray, at: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at)
    return ids[np.repeat(good, n)], np.concatenate([[0], np.cumsum(np.where(good, n, 0))])


def aligned_run(texts: pa.Array, a: Side, b: Side) -> dict[str, list | np.ndarray]:
    """Columns n_a .. times for a run of texts without nulls."""
    count = len(texts)
    (ids_a, at_a), (ids_b, at_b) = a.encoder.encode(texts), b.encoder.encode(texts)
    raw = texts.cast(pa.large_string())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + count + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    edges = offsets + np.arange(count + 1)
    whole = np.insert(data, offsets[:-1], 0x20)
    good = _same_bytes(a, ids_a, at_a, whole, edges) & _same_bytes(b, ids_b, at_b, whole, edges) & (np.diff(offsets) > 0)
    (ids_a, at_a), (ids_b, at_b) = _only(ids_a, at_a, good), _only(ids_b, at_b, good)
    reach = np.concatenate([[0], np.cumsum(np.where(good, np.diff(edges), 0))])
    ends_a, ends_b, total = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b]), int(reach[-1])
    out = {"n_a": np.diff(at_a), "n_b": np.diff(at_b)}

    last = terminals(successors(ends_a, ends_b, total))
    final = last[: len(ids_a)] == np.arange(len(ids_a))  # on the first side
    number = np.cumsum(final) - 1
    group = number[last]
    group_a, group_b = group[: len(ids_a)], group[len(ids_a) :]
    out["n_groups"] = np.diff(np.concatenate([[0], np.cumsum(final)])[at_a])
    out["groups_sha256"] = _digests(a, b, ids_a, ids_b, group_a, group_b, at_a, at_b)

    # Between two neighbouring ends of either side lies one overlapping pair.
    marks_a, marks_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    marks_a[ends_a], marks_b[ends_b] = True, True
    cut = np.flatnonzero(marks_a | marks_b)
    of_a, of_b = (np.cumsum(m[cut]) - m[cut] for m in (marks_a, marks_b))
    pair = ids_a[of_a].astype(np.int64) * len(b.size) + ids_b[of_b]
    doc = np.searchsorted(reach, cut - 1, "right") - 1
    out["n_links"] = np.bincount(doc, minlength=count)[:count]
    wide = len(a.size) * len(b.size)
    both, times = np.unique(doc * wide + pair, return_counts=True)
    at = np.searchsorted(both, np.arange(count + 1) * wide) if len(both) else np.zeros(count + 1, np.int64)
    pairs = (both % wide).astype(_pair_type(wide))
    out["pairs"] = [pairs[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
    out["times"] = [times[i:j].astype("<u4").tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
    return out


def _pair_type(wide: int) -> str:
    return "<u4" if wide <= 1 << 32 else "<i8"


def _digests(a: Side, b: Side, ids_a, ids_b, group_a, group_b, at_a, at_b) -> list[str]:
    """Hex digests of ``a1,a2|b1;a3|b2,b3``; '' for a text without tokens."""
    n = len(ids_a) + len(ids_b)
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    many_a, many_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    # A group's first side comes before its second.
    place_a = np.arange(len(ids_a)) + (np.cumsum(many_b) - many_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(many_a)[group_b]
    wide = max(a.digits.shape[1], b.digits.shape[1])
    cells, size = np.zeros((n, wide + 1), np.uint8), np.zeros(n, np.int64)
    for side, ids, place, group, sign in ((a, ids_a, place_a, group_a, b"|"), (b, ids_b, place_b, group_b, b";")):
        cells[place, : side.digits.shape[1]] = side.digits[ids]
        size[place] = side.n_digits[ids]
        ends = np.ones(len(ids), bool)
        ends[:-1] = group[1:] != group[:-1]
        cells[place, side.n_digits[ids]] = np.where(ends, sign[0], ord(","))
    size += 1
    docs = at_a + at_b
    closing = docs[1:][np.diff(docs) > 0] - 1
    size[closing] -= 1  # nothing follows a text's last group
    line = cells[np.arange(wide + 1)[None, :] < size[:, None]].tobytes()
    at = np.concatenate([[0], np.cumsum(size)])[docs]
    return [hashlib.sha256(line[i:j]).hexdigest() if j > i else "" for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def aligned(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """A written table, one row for each document: ``ALIGNED``; pairs and times list its pairs and how often each occurs."""
    import public_tokenizers

    first, second = first or default_vocabulary(), second or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(first, second)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            for at, _, offsets in T.slices(texts):
                n = len(offsets) - 1
                got = aligned_run(texts.slice(at, n), a, b)
                own = [batch.column(c).slice(at, n) for c in ("row", "doc_id")]
                names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(own + [pa.array(got[c], k) for c, k in zip(names, kinds, strict=True)], names=["row", "doc_id", *names])

    T.tuned(docs.sparkSession)
    rows = T.keyed_texts(docs).withColumn("row", F.monotonically_increasing_id())
    return cut_lineage(rows.mapInArrow(run, ALIGNED))


def pair_counts(found: DataFrame, wide: int, second: int) -> DataFrame:
    """(pair, docs, best): documents of each pair of ids, and whether its first id has no pair with more."""
    kind = _pair_type(wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        record = lambda p, c: pa.RecordBatch.from_arrays([pa.array(p), pa.array(c)], names=["pair", "docs"])
        for batch in batches:
            pairs, n = np.unique(_joined(batch.column("pairs"), kind).astype(np.int64), return_counts=True)
            both, at = np.unique(np.concatenate([held, pairs]), return_inverse=True)
            held, counts = both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
            if len(held) > HELD_PAIRS:
                yield record(held, counts)
                held, counts = held[:0], counts[:0]
        yield record(held, counts)

    counted = found.select("pairs").mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counted = cut_lineage(counted)
    id_a = F.expr(f"pair div {second}L")
    most = counted.groupBy(id_a.alias("id_a")).agg(F.max("docs").alias("most"))
    joined = counted.withColumn("id_a", id_a).join(most, "id_a")
    return cut_lineage(joined.select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))


def _joined(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers of all cells of a binary column, one after the other."""
    if not len(column):
        return np.zeros(0, kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None else np.zeros(0, kind)


def _scored(found: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """Rows of ``found`` with n_best and count_sum, from a table of counts that fits every task."""
    table = counts.toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    known, docs, best = (table.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "docs", "best"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = _joined(batch.column("times"), "<u4").astype(np.int64)
            at = np.searchsorted(known, _joined(batch.column("pairs"), kind).astype(np.int64))
            edges = np.concatenate([[0], np.cumsum(np.array(pc.binary_length(batch.column("times"))) // 4)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[at] * times)])[edges]) for x in (best, docs)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(s) for s in sums], names=[*names, "n_best", "count_sum"])

    return found.select(*names, "pairs", "times").mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    )


def _joined_scores(found: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """The same by a join, for tables of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array(pc.binary_length(batch.column("times"))) // 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("row").to_numpy(), n)), pa.array(_joined(batch.column("pairs"), kind).astype(np.int64)),
                 pa.array(_joined(batch.column("times"), "<u4").astype(np.int64))], names=["row", "pair", "times"])

    each = found.select("row", "pairs", "times").mapInArrow(run, "row long, pair long, times long")
    met = spread_join(each, counts.withColumn("rows", F.col("docs")), ["pair"], "inner", rows="rows")
    times = F.col("times")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(F.col("docs") * times).alias("count_sum"))
    return found.drop("pairs", "times").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])


def alignment(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import public_tokenizers

    first, second = first or default_vocabulary(), second or public_tokenizers.path("piece_bpe_32k.model")
    found = aligned(docs, first, second)
    a, b = sides(first, second)
    wide = len(a.size) * len(b.size)
    counts = pair_counts(found, wide, len(b.size))
    scored = (_scored if counts.count() <= SENT_PAIRS else _joined_scores)(found, counts, _pair_type(wide))
    return scored.select(T.given_id(), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
