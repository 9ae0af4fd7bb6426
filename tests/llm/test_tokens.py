"""Token files, packing and lattice scores: exact round trips and brute-force versions."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import corpus
from tracelight.llm import lattice, packing, tokens
from tracelight.llm import text as T
from tracelight.session import shared_path

ODD = ["", " ", "a", " a", "a  b", "a \nb", "a\n b", "\n", "a\n\nb", "it's don't", "x\x00y", "\x00", "word,\nNext", "é è", "日本語 テスト", "tab\tx y", "end ",
       "12 34.5 abc123 !!!", "<|endoftext|> hi", "Ünï ſ ɐɐ ǅ", None, "a" * 300, " \n \n x", "A!! B!!\nC%%% D&&&", "b\u00a0c \u2003 d", "...\n-- x"]


def whole(path, text):
    return tokens.encoder(path).whole.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    path = tokens.default_vocabulary()
    texts = ODD + [t for _, t in corpus()]
    for some in (texts, texts[::-1], texts):
        ids, at = tokens.encoder(path).encode(pa.array(some, pa.string()))
        assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:])] == [whole(path, t) for t in some]


def test_added_tokens_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    fresh = Tokenizer.from_file(path)
    texts = ["<|endoftext|> hi", "a<|endoftext|>b", "a <|endoftext|>", "<|endoftext|>!\n<|endoftext|> <|endoftext|", *ODD, *[t for _, t in corpus()]]
    want = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0] == [50256, 23105]
    for _ in range(2):
        ids, at = tokens.encoder(path).encode(pa.array(texts, pa.string()))
        assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:])] == want
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = tokens.token_files(frame).orderBy("start").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in found] == [(len(w) + 1, zlib.crc32(np.array([*w, 2], "<u4").tobytes())) for w in want]
    first = {r.doc_id: r.ids_crc32 for r in packing.pack(frame).filter("piece = 0").collect()}
    assert all(first[i] == zlib.crc32(np.array([*w, 2], "<u4").tobytes()) for i, w in enumerate(want) if len(w) < 1024)


@pytest.mark.parametrize("seed", range(3))
def test_encoder_on_random_signs(seed):
    rng = np.random.default_rng(seed)
    alphabet = list("ab  \n\n.,'!s1é日\t\u00a0")
    texts = ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(0, 30, 400)]
    path = tokens.default_vocabulary()
    ids, at = tokens.encoder(path).encode(pa.array(texts, pa.string()))
    assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:])] == [whole(path, t) for t in texts]


def test_kept_chunks_take_little_memory_and_change_no_id():
    """Not a Python object for each chunk and word: the worker's store is a few long arrays."""
    import tracemalloc

    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(2000)) + "," for _ in range(10)]
    encoder = tokens.TextEncoder(tokens.default_vocabulary())
    tracemalloc.start()
    ids, at = encoder.encode(pa.array(texts))
    del ids, at
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(encoder.chunks) > 19_000 and held < 100 * len(encoder.chunks)
    again, at = encoder.encode(pa.array(texts[::-1]))
    assert [again[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [encoder._encode([t])[0] for t in texts[::-1]]


def test_a_worker_gives_back_all_but_what_an_operator_keeps():
    state = T.worker_state()
    was = dict(state)
    state.update(encoders={"x": 1}, alignment={"y": 2})
    assert list(T.lean(lambda batches: (list(state) for _ in batches), "encoders")([1])) == [["encoders"]]
    assert list(state) == ["encoders"]
    T.forget()
    assert not state
    state.update(was)


def test_files_hold_every_document(spark, docs):
    path, folder = tokens.default_vocabulary(), shared_path(spark, "tokens")
    manifest = tokens.write_token_files(docs, path, 2, folder).orderBy("shard").collect()
    found = tokens.read_documents(spark, folder).orderBy("start").collect()
    order = sorted(corpus(), key=lambda x: (x[0] is not None, x[0] or 0))
    want, start = [], 0
    for i, t in order:
        ids = np.array([*whole(path, t), 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in found] == want
    assert [r.base for r in manifest] == [sum(x.tokens for x in manifest[:k]) for k in range(len(manifest))]
    ids, offsets, _ = tokens.open_shard(folder, manifest[0].shard, manifest[0].dtype)
    assert isinstance(ids, np.memmap) and ids.dtype == np.uint16 and len(ids) == offsets[-1]


def test_sequences_are_gapless_and_few(spark, docs):
    out = packing.pack(docs).collect()
    path = tokens.default_vocabulary()
    size = {}
    for r in out:
        size.setdefault((r.doc_id, r.sequence_id if r.doc_id == 7 else 0), []).append(r)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in places.values():
        rows.sort()
        assert [o for o, _ in rows] == list(np.cumsum([0, *[n for _, n in rows][:-1]])) and sum(n for _, n in rows) <= 1024
    for i, t in corpus():
        ids = np.array([*whole(path, t), 2], "<u4")
        rows = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
        rows = rows if i != 7 else rows[:1]
        assert sum(r.length for r in rows) == len(ids) and all(r.length == 1024 for r in rows[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)
    total = sum(r.length for r in out)
    assert len(places) == -(-total // 1024)


def test_genetic_packing_beats_or_meets_best_fit(spark):
    rng = np.random.default_rng(2)
    sizes = rng.integers(150, 700, 9000)
    frame = spark.createDataFrame([(int(s),) for s in sizes], "length long")
    bins = packing.packed(frame).select("sequence_id").distinct().count()
    plain = packing.Grouping(sizes, 1024)
    plain.fit(np.arange(len(sizes)))
    assert -(-sizes.sum() // 1024) <= bins <= plain.bins() + 1


def test_lattice_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b" ab", b"ba"]
    score = np.log(np.arange(1, 8) / 28)

    def brute(word):
        if not word:
            return 1.0
        return sum(np.exp(score[i]) * brute(word[len(p) :]) for i, p in enumerate(pieces) if word.startswith(p))

    words = ["a", "ab", "abab", "bba", "b" * 7]
    got = lattice.word_scores(pa.array(words), pieces, score)
    assert np.allclose(np.exp(got), [brute(b" " + w.encode()) for w in words])
    trie = lattice.Trie(pieces)
    for w in words:
        row = np.frombuffer(b" " + w.encode(), np.uint8)
        assert np.isclose(lattice._long_word(trie, row, score), np.log(brute(b" " + w.encode())))
        e = lattice.expected(trie, row[None, :], score, np.ones(1))
        assert np.allclose(e, lattice._long_expected(trie, row, score, 1.0))
        assert np.isclose((e * [len(p) for p in pieces]).sum(), len(row))  # every segmentation spells the word


def test_document_scores(spark, docs):
    out = lattice.score_documents(docs).collect()
    import collections
    import re

    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = collections.Counter()
    for i, t in corpus():
        if not held(i):
            counts.update([*split(t), None])
    n, v = sum(counts.values()), len(counts)
    want = collections.defaultdict(list)
    for i, t in corpus():
        all_ = [*split(t), None]
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in all_)
        want[i].append((held(i), len(all_), sum(counts[w] > 0 for w in all_), n, round(base, 6)))
    got = collections.defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)))
        assert np.isfinite(r.score) and r.score < 0
    assert got == want


def test_tail_words_score_as_head_words(spark, docs, monkeypatch):
    first = {(r.doc_id, r.n_tokens): r for r in lattice.score_documents(docs).collect()}
    monkeypatch.setattr(lattice, "HEAD", 3)
    for r in lattice.score_documents(docs).collect():
        other = first[r.doc_id, r.n_tokens]
        assert np.isclose(r.score, other.score) and np.isclose(r.base_score, other.base_score) and r.n_known == other.n_known


def test_empty_tables(spark, empty):
    assert tokens.token_files(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert lattice.score_documents(empty).count() == 0
