"""Token alignment against the libraries and plain loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelight.llm import alignment

FOLDER = "/root/testdata/sf0.001"
ODD = [
    (None, None), (1, ""), (2, " "), (3, "one"), (3, "one"), (3, "one two"), (4, "  two  spaces \n\n and\nlines \r\n\t tabs "), (5, "<|endoftext|> and <s> </s> <unk> <0x0A>"),
    (6, "a ▁ piece▁sign"), (7, "日本語 テキスト 🙂🙂 ünï cödé   x"), (8, "nul \0 sign"), (None, "word " * 3000), (9, "x" * 5000), (10, "\n"), (11, "\n\nstart"), (12, "é ﬁ Å"),
    (13, "don't can't 12345 3.14 ++--"), (14, "the\n"), (15, "the " * 40),
]


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in alphabet]
    back = {chr(b): b for b in alphabet} | {chr(256 + i): b for i, b in enumerate(rest)}

    def tokens(text):
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text, num_threads=1)
        name = lambda i: second.id_to_piece(i)
        bytes_b = [bytes([int(name(i)[3:5], 16)]) if second.is_byte(i) else name(i).replace("▁", " ").encode() for i in b]
        return a, [bytes(back[c] for c in first.id_to_token(i)) for i in a], b, bytes_b

    return tokens


def brute(rows):
    tokens, found, held = libraries(), [], defaultdict(int)
    for doc, text in rows:
        a, bytes_a, b, bytes_b = tokens(text) if text else ([], [], [], [])
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            found.append((doc, 0, 0, "", [], 0))
            continue
        ranges = []
        for parts in (bytes_a, bytes_b):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            ranges.append(list(zip([0, *ends[:-1]], ends, strict=True)))
        common = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        lists, i, j = [], 0, 0
        for edge in common:
            one, two = [], []
            while i < len(a) and ranges[0][i][1] <= edge:
                one.append(str(a[i]))
                i += 1
            while j < len(b) and ranges[1][j][1] <= edge:
                two.append(str(b[j]))
                j += 1
            lists.append(f"{','.join(one)}|{','.join(two)}")
        links, j = [], 0
        for i, (start, end) in enumerate(ranges[0]):
            while ranges[1][j][1] <= start:
                j += 1
            k = j
            while k < len(b) and ranges[1][k][0] < end:
                links.append((a[i], b[k]))
                k += 1
        for pair in set(links):
            held[pair] += 1
        found.append((doc, len(a), len(b), hashlib.sha256(";".join(lists).encode()).hexdigest(), links, len(lists)))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return sorted(
        ((doc, n_a, n_b, groups, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), sha) for doc, n_a, n_b, sha, links, groups in found), key=repr
    )


def rows_of(frame):
    return sorted((tuple(r) for r in alignment.alignment(frame).collect()), key=repr)


def test_alignment_is_that_of_plain_loops(spark):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(120).collect()]
    rows = ODD + given
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "pairs": F.lit("p"), "docs": F.lit(2), "best": F.lit(3)})
    assert rows_of(frame.repartition(5)) == brute(rows)


def test_beyond_the_pairs_that_are_sent(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SENT_PAIRS", 0)
    assert rows_of(spark.createDataFrame(ODD, "doc_id long, text string")) == brute(ODD)


def test_empty_table(spark, empty):
    assert alignment.alignment(empty).count() == 0


def test_doubling_reaches_the_last_token_of_each_component():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(2, 300))
        ends = [np.sort(rng.choice(np.arange(1, n + 1), rng.integers(1, n + 1), replace=False)) for _ in range(2)]
        ends = [np.unique(np.append(e, n)) for e in ends]
        got = alignment.terminals(alignment.successors(*ends, n))
        common = np.intersect1d(*ends)
        expected = [np.searchsorted(ends[0], common[np.searchsorted(common, e)]) for e in ends]
        assert np.array_equal(got, np.concatenate(expected))


@pytest.mark.parametrize("kind", [alignment.SpacedTextEncoder, alignment.PieceEncoder])
def test_kept_chunks_give_the_ids_of_whole_texts(spark, kind):
    path = public_tokenizers.path("byte_bpe_50k.json" if kind is alignment.SpacedTextEncoder else "piece_bpe_32k.model")
    texts = [t or "" for _, t in ODD] + [r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    for kept in (0, 50, 100_000):
        encoder = kind(path, kept)
        assert encoder.chunked
        for part in np.array_split(np.arange(len(texts)), 4):
            own = [texts[i] for i in part]
            ids, at = encoder.encode(pa.array(own))
            whole = encoder._whole(own)
            assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == [list(w) for w in whole]
        assert len(encoder.chunks) <= kept


def test_counts_are_of_documents(spark):
    rows = [(i, "alpha beta") for i in range(4)] + [(9, "alpha alpha alpha")]
    found = alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string"))
    a, b = alignment.sides(alignment.default_vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))
    counts = alignment.pair_counts(found, len(a.size) * len(b.size), len(b.size)).collect()
    assert max(r.docs for r in counts) == 5 and Counter(r.docs for r in counts)[5] >= 1 and all(r.best for r in counts if r.docs == 5)
