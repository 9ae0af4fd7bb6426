"""Document likelihood under a unigram model of subwords, summed over all segmentations.

The vocabulary is a given one: the pieces of a sentencepiece file, its single bytes
included. Pieces never cross a word, so a document's probability is the product
over its words of the word's marginal probability, and each distinct word of the
corpus passes the lattice once. The lattice holds every piece at every place of the
word (written with a leading space, in UTF-8 bytes); the forward recursion adds the
paths into each place in log space. The file's scores order the pieces; they
become log probabilities by expected piece counts on the training documents
(forward-backward, ``ROUNDS`` rounds over all training words, from a Zipf start).

The most frequent words (at most ``HEAD``, sent to every task) are scored where the
document is read; the others meet the table of words in a join.

Words are runs of other than white space, with A-Z in lower case; one end token
closes each text. Null text is empty. Rows that repeat an id are scored one by one.
A null id belongs to the training part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm import text as T
from tracelight.session import cut_lineage

HEAD = 300_000
ROUNDS = 2
#: Words that pass the lattice together; a word longer than ``LONG`` bytes passes alone.
TOGETHER, LONG = 4096, 96
#: Share of the Zipf start in the estimate.
PRIOR = 1e-4
#: Rows of word counts that a task holds before it sends them.
COUNTED = 600_000


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (the word mark as a space) and their log probabilities by Zipf's law on the file's order of scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i)
        raw = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        pieces[raw] = max(pieces.get(raw, -np.inf), 0.0 if len(raw) == 1 else model.get_score(i))
    for b in range(256):
        pieces.setdefault(bytes([b]), min(pieces.values()))
    names = sorted(pieces)
    rank = np.argsort(np.argsort([-pieces[p] for p in names], kind="stable"))
    weight = 1.0 / (rank + 3.0)
    return names, np.log(weight / weight.sum())


class Trie:
    """Pieces as a table of steps; node 0 is dead, node 1 the root, ``piece`` of a node is -1 inside a piece."""

    def __init__(self, pieces: list[bytes]):
        used = sorted({b for p in pieces for b in p})
        self.sign = np.zeros(256, np.int64)
        self.sign[used] = np.arange(len(used))
        rows: list[dict[int, int]] = [{}, {}]
        ends = [-1, -1]
        for i, piece in enumerate(pieces):
            node = 1
            for b in piece:
                if b not in rows[node]:
                    rows[node][b] = len(rows)
                    rows.append({})
                    ends.append(-1)
                node = rows[node][b]
            ends[node] = i
        self.step = np.zeros((len(rows), len(used)), np.int32)
        for node, out in enumerate(rows):
            for b, to in out.items():
                self.step[node, self.sign[b]] = to
        self.piece = np.array(ends, np.int64)

    def edges(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, stop, rows, pieces) of the lattice over words of one length, by start and stop."""
        signs = self.sign[words]
        for a in range(words.shape[1]):
            rows = np.arange(len(words))
            node = np.ones(len(words), np.int64)
            for b in range(a, words.shape[1]):
                node = self.step[node, signs[rows, b]]
                alive = node > 0
                rows, node = rows[alive], node[alive]
                if not len(rows):
                    break
                piece = self.piece[node]
                ends = piece >= 0
                if ends.any():
                    yield a, b + 1, rows[ends], piece[ends]


def forward(trie: Trie, words: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Log probability of all beginnings of each word: the last column is the word's."""
    alpha = np.full((words.shape[1] + 1, len(words)), -np.inf)
    alpha[0] = 0.0
    for a, b, rows, piece in trie.edges(words):
        alpha[b, rows] = np.logaddexp(alpha[b, rows], alpha[a, rows] + score[piece])
    return alpha


def expected(trie: Trie, words: np.ndarray, score: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts over all segmentations of the words, each word counted ``weight`` times."""
    alpha = forward(trie, words, score)
    beta = np.full_like(alpha, -np.inf)
    beta[-1] = 0.0
    edges = list(trie.edges(words))
    for a, b, rows, piece in reversed(edges):
        beta[a, rows] = np.logaddexp(beta[a, rows], score[piece] + beta[b, rows])
    count = np.zeros(len(score))
    for a, b, rows, piece in edges:
        share = np.exp(alpha[a, rows] + score[piece] + beta[b, rows] - alpha[-1, rows]) * weight[rows]
        count += np.bincount(piece, share, len(score))
    return count


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of bytes with a leading space) of words of equal length, some thousand together."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for rows in np.split(order, cuts):
        n = int(size[rows[0]]) if len(rows) else 0
        together = TOGETHER if n <= LONG else 1
        for a in range(0, len(rows), together):
            part = rows[a : a + together]
            matrix = np.full((len(part), n + 1), 0x20, np.uint8)
            matrix[:, 1:] = data[offsets[part][:, None] + np.arange(n)]
            yield part, matrix


def _trie(pieces: list[bytes]) -> Trie:
    kept = T.worker_state()
    if kept.get("pieces") != pieces:
        kept["pieces"], kept["trie"] = pieces, Trie(pieces)
    return kept["trie"]


def word_scores(words: pa.Array, pieces: list[bytes], score: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability, all segmentations summed."""
    out, trie = np.zeros(len(words)), _trie(pieces)
    for rows, matrix in _by_length(words):
        if matrix.shape[1] <= LONG + 1:
            out[rows] = forward(trie, matrix, score)[-1]
        else:
            out[rows[0]] = _long_word(trie, matrix[0], score)
    return out


def _long_word(trie: Trie, word: np.ndarray, score: np.ndarray) -> float:
    """The same recursion for one long word, in memory that does not grow with pieces times length."""
    alpha = np.full(len(word) + 1, -np.inf)
    alpha[0] = 0.0
    signs, step, piece = trie.sign[word].tolist(), trie.step, trie.piece
    for a in range(len(word)):
        node = 1
        for b in range(a, len(word)):
            node = step[node, signs[b]]
            if not node:
                break
            if piece[node] >= 0:
                alpha[b + 1] = np.logaddexp(alpha[b + 1], alpha[a] + score[piece[node]])
    return float(alpha[-1])


def _long_expected(trie: Trie, word: np.ndarray, score: np.ndarray, weight: float) -> np.ndarray:
    """Expected counts of one long word from its forward and backward sums."""
    n = len(word)
    alpha, beta, count = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf), np.zeros(len(score))
    alpha[0], beta[n] = 0.0, 0.0
    signs, step, piece = trie.sign[word].tolist(), trie.step, trie.piece

    def ends(a: int):
        node = 1
        for b in range(a, n):
            node = step[node, signs[b]]
            if not node:
                return
            if piece[node] >= 0:
                yield b + 1, piece[node]

    for a in range(n):
        for b, p in ends(a):
            alpha[b] = np.logaddexp(alpha[b], alpha[a] + score[p])
    for a in reversed(range(n)):
        for b, p in ends(a):
            beta[a] = np.logaddexp(beta[a], score[p] + beta[b])
            count[p] += weight * np.exp(alpha[a] + score[p] + beta[b] - alpha[n])
    return count


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words in lower case, row of each)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    flat, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.not_equal(flat, "")
    return flat.filter(full), row[full.to_numpy(zero_copy_only=False)]


def _held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([i != T.NO_ID and zlib.crc32(str(i).encode()) % 5 == 1 for i in ids.tolist()], bool)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, in training, in all) of a task, summed before they travel; the empty word counts the ends."""
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        t = pa.concat_tables(held).group_by("word").aggregate([("train", "sum"), ("total", "sum")])
        return t.rename_columns(["word", "train", "total"])

    for batch in batches:
        words, row = _split(batch.column(1))
        train = ~_held_out(batch.column(0).to_numpy())
        coded = words.dictionary_encode()
        index, n = coded.indices.to_numpy(), len(coded.dictionary)
        total = np.bincount(index, minlength=n)
        seen = np.bincount(index[train[row]], minlength=n)
        names = pa.concat_arrays([coded.dictionary, pa.array([""], pa.large_string())])
        columns = [names, pa.array(np.append(seen, train.sum())), pa.array(np.append(total, len(train)))]
        held.append(pa.table(columns, names=["word", "train", "total"]))
        if sum(t.num_rows for t in held) > COUNTED:
            held = [summed()]
            if held[0].num_rows > COUNTED // 2:
                yield from held[0].to_batches()
                held = []
    if held:
        yield from summed().to_batches()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, train, total) of ``docs`` (doc_id, text without nulls); the empty word stands for the end token."""
    counts = docs.mapInArrow(_counts, "word string, train long, total long")
    return counts.groupBy("word").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


def fit(counts: DataFrame, pieces: list[bytes], start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(log probability of each piece, of the end) from the training words: expected counts, ``rounds`` times."""
    ends = counts.filter("word = ''").agg(F.sum("train")).first()[0] or 0
    score = start
    end = 0.0
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], score=score) -> Iterator[pa.RecordBatch]:
            total, trie = np.zeros(len(score)), _trie(pieces)
            for batch in batches:
                weight = batch.column(1).to_numpy().astype(float)
                for rows, matrix in _by_length(batch.column(0)):
                    if matrix.shape[1] <= LONG + 1:
                        total += expected(trie, matrix, score, weight[rows])
                    else:
                        total += _long_expected(trie, matrix[0], score, weight[rows[0]])
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "n"])

        words = counts.filter("train > 0 and word <> ''").select("word", "train")
        found = words.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        count = np.zeros(len(pieces))
        for row in found.collect():  # at most one row for each piece of the vocabulary
            count[row.piece] = row.n
        count += (count.sum() + 1) * PRIOR * np.exp(start)
        whole = count.sum() + ends + 1
        score, end = np.log(count / whole), float(np.log((ends + 1) / whole))
    return score, end


def _least_count(table: DataFrame) -> int:
    """Least count at which at most ``HEAD`` words are left, from a histogram over powers of the eighth root of two."""
    step = F.floor(F.log2("total") * 8).cast("long").alias("step")
    left, least = 0, 2**62
    for step, n in sorted(((r.step, r.n) for r in table.groupBy(step).agg(F.count("*").alias("n")).collect()), reverse=True):
        left += n
        if left > HEAD:
            break
        least = int(np.ceil(2 ** (step / 8) - 1e-9))
    return least


def score_documents(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = T.tuned(docs.sparkSession)
    texts = T.keyed_texts(docs)
    pieces, start = vocabulary(path or default_pieces())
    counts = cut_lineage(word_counts(texts))
    n, v = counts.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count(F.when(F.col("train") > 0, 1))).first()
    score, end = fit(counts, pieces, start, rounds)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = word_scores(batch.column(0), pieces, score)
            value = np.where(np.array(pc.equal(batch.column(0), "")), end, value) / np.log(10)
            base = np.log10((batch.column(1).to_numpy() + 0.5) / (n + 0.5 * (v + 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(base), pa.array(value)], names=["word", "train", "total", "base", "value"])

    table = cut_lineage(counts.select("word", "train", "total").mapInArrow(weigh, "word string, train long, total long, base double, value double"))
    least = _least_count(table)
    top = table.filter(F.col("total") >= least).select("word", "train", "base", "value").toArrow().combine_chunks()
    # The end token's entry is needed for every text.
    close = table.filter("word = ''").select("train", "base", "value").first() or (0, 0.0, 0.0)
    head = top.column("word").cast(pa.large_string()).combine_chunks() if top.num_rows else pa.array([], pa.large_string())
    known = np.append(top.column("train").to_numpy() > 0, False)
    base, value = np.append(top.column("base").to_numpy(), 0.0), np.append(top.column("value").to_numpy(), 0.0)
    end_known, end_base, end_value = close[0] > 0, close[1], close[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0).to_numpy()
            words, row = _split(batch.column(1))
            coded = words.dictionary_encode()
            index = coded.indices.to_numpy().astype(np.int64)
            at = pc.fill_null(pc.index_in(coded.dictionary, head), len(head)).to_numpy()
            size = len(ids)
            sums = pa.StructArray.from_arrays(
                [
                    pa.array(ids), pa.array(_held_out(ids)), pa.array(np.bincount(row, minlength=size) + 1),
                    pa.array((np.bincount(row, known[at][index], size) + end_known).astype(np.int64)),
                    pa.array(np.bincount(row, base[at][index], size) + end_base), pa.array(np.bincount(row, value[at][index], size) + end_value),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score"],
            )
            tail = (at == len(head))[index]
            pair, times = np.unique(row[tail] * len(coded.dictionary) + index[tail], return_counts=True)
            rare = coded.dictionary.take(pa.array(pair % max(1, len(coded.dictionary)))).cast(pa.string())
            # A document's own row joins nothing: no word holds a space.
            own = pc.binary_join_element_wise(" ", pa.array(row_id + np.arange(size)).cast(pa.string()), "")
            keys = [pa.array(row_id + np.arange(size)), pa.array(row_id + pair // max(1, len(coded.dictionary)))]
            yield pa.RecordBatch.from_arrays([keys[0], own, pa.array(np.zeros(size, np.int64)), sums], names=["row", "word", "times", "head"])
            yield pa.RecordBatch.from_arrays([keys[1], rare, pa.array(times), pa.nulls(len(pair), sums.type)], names=["row", "word", "times", "head"])
            row_id += size

    kind = "row long, word string, times long, head struct<doc_id:long,held_out:boolean,n_tokens:long,n_known:long,base:double,score:double>"
    each = texts.mapInArrow(run, kind).join(table.select("word", (F.col("train") > 0).alias("known"), "base", "value"), "word", "left")
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    known_ = F.sum(F.when(F.col("known"), F.col("times")).otherwise(0))
    out = each.groupBy("row").agg(
        F.max("head").alias("h"), known_.alias("known"), total(F.col("times") * F.col("base")).alias("base"), total(F.col("times") * F.col("value")).alias("value"))
    return out.select(
        F.col("h.doc_id").alias("doc_id"), "h.held_out", "h.n_tokens", (F.col("h.n_known") + F.col("known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("h.base") + F.col("base")).alias("base_score"), (F.col("h.score") + F.col("value")).alias("score"),
    ).withColumn("doc_id", T.given_id())
