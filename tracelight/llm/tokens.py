"""Token ids of whole texts, by a tokenizers file, and their binary form on disk.

``TextEncoder`` returns what the tokenizers library returns for the whole text. For
byte-level vocabularies a text falls into chunks that never share a token: a word
with the space or the line break before it. Chunks repeat, so a worker keeps the
ids of those it has met (up to a fixed number). A text with other white space than
single spaces and line breaks between words, or with an added token of the vocabulary
file (``<|endoftext|>``), is encoded whole.
"""

from __future__ import annotations

import gc
import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm import text as T
from tracelight.session import cut_lineage, shared_path

#: Chunks whose ids a worker keeps (some 40 MB together).
KEPT = 600_000
#: Text that is encoded together, in bytes.
ENCODED_BYTES = 1 << 22

#: Unknown chunks that are encoded as one text, in bytes.
JOINED_BYTES = 1 << 20

# What ends a word inside a chunk (white space, and more than a vocabulary may call so), and the sign where a text begins.
INSIDE = "[\\x00\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte."""
    alphabet = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in alphabet]
    return {b: chr(b) for b in alphabet} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkedEncoder:
    """Ids of texts by those of their chunks; a subclass says what a chunk's ids are.

    ``spaced`` encodes a space and the text. ``signs`` send a text that holds one to the whole-text path.
    """

    def __init__(self, chunked: bool, spaced: bool, signs: tuple[str, ...], kept: int):
        self.chunked, self.spaced, self.signs, self.kept = chunked, spaced, signs, kept
        # An Arrow column, not a dict of strings: a tenth of the memory, and a run's chunks are looked up at once.
        self.chunks = pa.array([], pa.large_string())
        # The chunks' ids lie in ``flat``, chunk i in flat[start[i] : start[i] + length[i]]; there is room for more behind ``used``.
        self.flat, self.start, self.length, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, as they are."""
        raise NotImplementedError

    def _learn(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, how many each chunk has); -1 marks a chunk without ids of its own."""
        raise NotImplementedError

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return self._encode([" " + t for t in texts] if self.spaced else texts)

    def _places(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start, length) for these distinct chunks; length -1 marks one without ids of its own."""
        known = len(self.chunks)
        at = pc.fill_null(pc.index_in(chunks, value_set=self.chunks), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return self.flat, self.start[at], self.length[at]
        new = chunks.take(pa.array(missing))
        ids, size = self._learn(new)
        ends = self.used + np.cumsum(np.maximum(size, 0))
        n, total = known + len(new), int(ends[-1])
        self.flat = _roomy(self.flat, self.used, total)
        self.start, self.length = _roomy(self.start, known, n), _roomy(self.length, known, n)
        self.flat[self.used : total] = ids
        self.start[known:n], self.length[known:n] = ends - np.maximum(size, 0), size
        at[missing] = known + np.arange(len(new))
        # What is beyond the limit is overwritten by the next call.
        more = min(len(new), self.kept - known)
        if more > 0:
            self.chunks = pa.concat_arrays([self.chunks, new.slice(0, more)])
            self.used = int(ends[more - 1])
        return self.flat, self.start[at], self.length[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of the texts; nulls are empty."""
        # Millions of short lists and no cycles: the collector would only walk over them.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encoded(texts)
        finally:
            if collecting:
                gc.enable()

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        big = pa.large_string()
        texts = pc.fill_null(texts, "").cast(big)
        if not self.chunked:
            return _flat([np.array(x, np.uint32) for x in self._whole(texts.to_pylist())])
        spread = texts if self.spaced else pc.binary_join_element_wise(pa.scalar("\0", big), texts, pa.scalar("", big))
        lists = pc.split_pattern(pc.replace_substring(spread, "\n", " \n"), " ")
        coded = lists.values.dictionary_encode() if lists.offset == 0 else pa.concat_arrays([lists.flatten()]).dictionary_encode()
        flat, start, length = self._places(coded.dictionary)
        index = coded.indices.to_numpy()
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        bad_chunk = length < 0
        bad_text = np.add.reduceat(bad_chunk[index], edges[:-1].astype(np.int64)) > 0 if len(index) else np.zeros(0, bool)
        for sign in self.signs:
            bad_text |= np.array(pc.match_substring(texts, sign))
        bad_text &= self.spaced | (np.array(pc.binary_length(texts)) > 0)
        sizes = np.maximum(length, 0)[index]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(start[index] - (ends - sizes), sizes)
        ids = flat[source]
        offsets = np.concatenate([[0], ends])[edges]
        if not bad_text.any():
            return ids, offsets
        parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        rows = np.flatnonzero(bad_text)
        for row, got in zip(rows, self._whole(texts.take(pa.array(rows)).to_pylist()), strict=True):
            parts[row] = np.array(got, np.uint32)
        return _flat(parts)


def _roomy(row: np.ndarray, used: int, need: int) -> np.ndarray:
    """``row`` with room for ``need`` entries; its first ``used`` stay."""
    if need <= len(row):
        return row
    out = np.zeros(max(need, 2 * len(row), 1 << 16), row.dtype)
    out[:used] = row[:used]
    return out


class TextEncoder(ChunkedEncoder):
    """Ids of texts under one vocabulary file, with what it has encoded before at hand.

    ``spaced``: of a space and the text, in which the strings of added tokens are plain text.
    """

    def __init__(self, path: str, spaced: bool = False, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = spaced
        kind = json.loads(self.whole.to_str())
        # The library looks for these in the whole text, before it is split into words.
        added = () if spaced else tuple(sorted({t["content"] for t in kind["added_tokens"]} - {""}))
        pre = kind["pre_tokenizer"] or {}
        chunked = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not kind["normalizer"]
        super().__init__(bool(chunked), spaced, ("\0", *added), kept)
        # The same words without added tokens, whose strings are plain text in a chunk.
        self.plain = Tokenizer(self.whole.model)
        if self.whole.pre_tokenizer is not None:
            self.plain.pre_tokenizer = self.whole.pre_tokenizer
        back = {c: b for b, c in byte_letters().items()}
        names = [self.whole.id_to_token(i) or "" for i in range(self.whole.get_vocab_size())]
        self.size = np.array([len(n) if all(c in back for c in n) else 0 for n in names], np.int64)  # bytes of each id

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, each of which ends where a token ends; a chunk that is empty or holds white space has none of its own."""
        broken, first = (pc.starts_with(chunks, sign).to_numpy(zero_copy_only=False) for sign in ("\n", "\0"))
        body = pc.if_else(pa.array(broken | first), pc.utf8_slice_codeunits(chunks, 1), chunks)
        bare = ~pc.match_substring_regex(body, INSIDE).to_numpy(zero_copy_only=False) & (pc.binary_length(body).to_numpy() > 0)
        # Chunks stand as in a text: behind a space or a line break, which is taken off again where a text begins.
        spelled = pc.binary_join_element_wise(pc.if_else(pa.array(broken | first), "\n", " ").cast(pa.large_string()), body, pa.scalar("", pa.large_string()))
        spelled = spelled.filter(pa.array(bare))
        ids, size = self._joined(spelled)
        if first.any():
            head = first[bare]
            lead = len(self._encode(["\n"])[0])
            begin = (np.cumsum(size) - size)[head]
            keep = np.ones(len(ids), bool)
            keep[(begin[:, None] + np.arange(lead)).ravel()] = False
            ids, size = ids[keep], size - lead * head
        sizes = np.full(len(chunks), -1)
        sizes[bare] = size
        return ids, sizes

    def _joined(self, spelled: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, how many each chunk has) of chunks that stand one behind the other, some at a time."""
        parts, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for first, data, offsets in T.slices(spelled, JOINED_BYTES):
            n = len(offsets) - 1
            ids = np.array(self.plain.encode_batch_fast([data.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.size[ids])
            last = np.searchsorted(ends, offsets[1:], "left")
            # Only where every chunk ends with a token, and no byte is missing, are these the chunks' own ids.
            if len(ids) and ends[-1] == offsets[-1] and (ends[last] == offsets[1:]).all():
                parts.append(ids)
                sizes.append(np.diff(last, prepend=-1))
            else:
                lists = [e.ids for e in self.plain.encode_batch_fast(spelled.slice(first, n).to_pylist(), add_special_tokens=False)]
                parts.append(np.fromiter(chain.from_iterable(lists), np.uint32))
                sizes.append(np.fromiter(map(len, lists), np.int64, n))
        return np.concatenate(parts), np.concatenate(sizes)


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)).astype(np.uint32), offsets


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a vocabulary file, made once."""
    kept = T.worker_state().setdefault("encoders", {})
    if path not in kept:
        kept[path] = TextEncoder(path)
    return kept[path]


def encoded(path: str, texts: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, offsets) of runs of texts, each text closed by ``end``."""
    texts = texts.cast(pa.large_string())
    for first, _, offsets in T.slices(texts, ENCODED_BYTES):
        n = len(offsets) - 1
        ids, at = encoder(path).encode(texts.slice(first, n))
        yield first, np.insert(ids, at[1:], end), at + np.arange(n + 1)


def write_token_files(docs: DataFrame, path: str, end: int, folder: str) -> DataFrame:
    """Write all documents in ascending id order as token files under ``folder``; return their manifest.

    Shard k is three flat files: ids of type ``dtype`` (k.bin), n + 1 offsets of 64
    bits into them (k.idx), and n document ids of 64 bits (k.doc). The manifest
    (shard, documents, tokens, base, dtype) is a table in the same folder; ``base``,
    the tokens of all earlier shards, comes from prefix sums over the shards' counts.

    Null text is empty (the end id alone), null ids sort first and are stored as
    -2**63; rows that repeat an id stay, ordered by text. A shard is written under a
    name of its attempt and then renamed, so a lost task leaves no half file.
    """
    spark = T.tuned(docs.sparkSession)
    texts = T.keyed_texts(docs)
    ordered = texts.repartitionByRange(T.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, root = _store(folder)
        names = [f"{root}/{shard:06d}.{kind}" for kind in ("bin", "idx", "doc")]
        parts = [store.open_output_stream(f"{root}/.{shard:06d}-{attempt}-{kind}") for kind in range(3)]
        tokens = documents = 0
        kind = np.uint16 if encoder(path).whole.get_vocab_size() <= 1 << 16 and end < 1 << 16 else np.uint32
        parts[1].write(np.zeros(1, np.uint64).tobytes())
        for batch in batches:
            parts[2].write(batch.column(0).to_numpy().astype("<i8").tobytes())
            for _, ids, offsets in encoded(path, batch.column(1), end):
                parts[0].write(ids.astype(np.dtype(kind).newbyteorder("<")).tobytes())
                parts[1].write((offsets[1:] + tokens).astype("<u8").tobytes())
                tokens += len(ids)
                documents += len(offsets) - 1
        for k, part in enumerate(parts):
            part.close()
            store.move(f"{root}/.{shard:06d}-{attempt}-{k}", names[k])
        yield pa.RecordBatch.from_pydict({"shard": [shard], "documents": [documents], "tokens": [tokens], "dtype": [np.dtype(kind).name]})

    _store(folder)[0].create_dir(_store(folder)[1], recursive=True)
    counts = cut_lineage(ordered.mapInArrow(T.lean(run, "encoders"), "shard long, documents long, tokens long, dtype string"))
    # One small row for each shard: the sums are made on the driver.
    rows, base, manifest = sorted(counts.collect()), 0, []
    for shard, documents, tokens, dtype in rows:
        manifest.append((shard, documents, tokens, base, dtype))
        base += tokens
    frame = spark.createDataFrame(manifest, "shard long, documents long, tokens long, base long, dtype string")
    frame.write.mode("overwrite").parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def _store(folder: str):
    """File system and path of a folder that all executors share."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def open_shard(folder: str, shard: int, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, document ids) of a shard, memory-mapped where the folder is a mounted one."""
    store, root = _store(folder)
    out = []
    for kind, form in (("bin", np.dtype(dtype).newbyteorder("<")), ("idx", "<u8"), ("doc", "<i8")):
        name = f"{root}/{shard:06d}.{kind}"
        if not store.get_file_info(name).size:
            out.append(np.zeros(0, form))
        elif type(store).__name__ == "LocalFileSystem":
            out.append(np.memmap(name, form, "r"))
        else:
            out.append(np.frombuffer(store.open_input_file(name).read(), form))
    return tuple(out)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = read_manifest(spark, folder).filter("documents > 0").select("shard", "base", "dtype")
    shards = shards.repartition(T.partitions(spark), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base, dtype in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, offsets, docs = open_shard(folder, shard, dtype)
                for a in range(0, len(docs), 4096):
                    at = offsets[a : a + 4097].astype(np.int64)
                    block = np.asarray(ids[at[0] : at[-1]]).astype("<u4")
                    crc = [zlib.crc32(block[i:j]) for i, j in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[a : a + 4096].astype(np.int64)), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    read = shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read.select(T.given_id(), "start", "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None, end: int = 2) -> DataFrame:
    """Write the token files of ``docs`` in the session's shared folder and read every document back from them."""
    spark = docs.sparkSession
    folder = shared_path(spark, "tokens")
    write_token_files(docs, path or default_vocabulary(), end, folder)
    return read_documents(spark, folder)
