import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from quillgraph.llm import bpe, packing, token_counts


@pytest.fixture(scope="module")
def piece():
    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts_of(*frames):
    return [(r.doc_id, r.text) for f in frames for r in f.select("doc_id", "text").collect()]


def noise(n, seed=5):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "a", "the", "ing", "'s", "'", "!", "1", "é", "ß", "日", "🙂", " ", " ", "▁", "T", "<s>", "don't", "word", "\r\n", "́"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_token_counts_are_the_librarys(odd_docs, sf_docs, piece):
    for frame in (odd_docs, sf_docs):
        want = sorted(((i, len((t or "").encode()), n := len(piece.encode(t or "")), n > 4096) for i, t in texts_of(frame)), key=str)
        assert sorted(map(tuple, token_counts.count_tokens(frame, P.path("piece_bpe_32k.model")).collect()), key=str) == want


def test_transducer_on_noise(piece):
    t = token_counts.from_model(P.path("piece_bpe_32k.model"))
    for text in noise(3000):
        assert t.count(text) == len(piece.encode(text)), repr(text)


def test_chunk_maps_compose(piece, monkeypatch):
    t = token_counts.from_model(P.path("piece_bpe_32k.model"))
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        for text in noise(300, size):
            assert t.count(text) == len(piece.encode(text)), (size, text)


def test_bounded_transducer(piece, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 50)
    monkeypatch.setattr(token_counts, "WORDS", 5)
    t = token_counts.Transducer(token_counts.from_model(P.path("piece_bpe_32k.model")).scores)
    for text in noise(300):
        assert t.count(text) == len(piece.encode(text))


def test_byte_bpe_is_the_librarys(odd_docs, sf_docs, tik):
    for frame in (odd_docs, sf_docs):
        want = []
        for i, t in texts_of(frame):
            ids = tik.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        got = bpe.encode_documents(frame, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("chunk,overlap", [(16, 4), (40, 8), (7, 3)])
def test_chunks_stitch(tik, monkeypatch, chunk, overlap):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "OVERLAP", overlap)
    coder = bpe.from_ranks(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text in noise(1500, chunk):
        assert coder.pre_tokens(text) == coder.pattern.findall(text)
        ids = coder.encode(text)
        assert ids.tolist() == tik.encode_ordinary(text)
        assert coder.decode(ids).decode() == text


def test_long_pieces(tik):
    coder = bpe.from_ranks(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(2)
    for n in (257, 1000, 20000):
        word = "".join(rng.choice("abcde") for _ in range(n))
        assert coder.encode(word).tolist() == tik.encode_ordinary(word)


def check_packing(frame, rows, width):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((i is None, i, tuple(lib.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in texts_of(frame))
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id is None, r.doc_id, r.doc_tokens), []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= width
    for absent, i, ids in want:
        pieces = by_doc[absent, i, len(ids)]
        whole = {(r.start, r.length, r.ids_crc32) for r in pieces}
        assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == crc for s, n, crc in whole)
        copies = sum(w[:2] == (absent, i) for w in want)
        assert sum(r.length for r in pieces) == copies * len(ids)
    sizes = [sum(r.length for r in p) for p in by_seq.values()]
    return sum(width - n for n in sizes if n & (n - 1)) / max(1, sum(sizes))


@pytest.mark.parametrize("width", [64, 2048])
def test_packing(odd_docs, sf_docs, width):
    for frame in (odd_docs.repartition(1), sf_docs):
        rows = packing.pack(frame, P.path("byte_bpe_50k.json"), P.PATTERN, width).collect()
        lost = check_packing(frame, rows, width)
        assert lost < (0.01 if width == 2048 else 0.2)


def test_packing_blocks(sf_docs, monkeypatch):
    """What is left of one block goes into the next."""
    frame = sf_docs.limit(60).coalesce(1)
    texts = [(r.doc_id, r.text) for r in frame.collect()]
    import pyarrow as pa
    from pyspark import TaskContext

    monkeypatch.setattr(packing, "BLOCK", 3000)
    seen = {}

    class Docs:
        def mapInArrow(self, run, schema):
            seen["run"] = run
            return self

    monkeypatch.setattr(packing, "documents", lambda d: Docs())
    monkeypatch.setattr(packing, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})())}))
    packing.pack(frame, P.path("byte_bpe_50k.json"), P.PATTERN, 512)
    out = [type("R", (), r)() for b in seen["run"]([pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in texts])]) for r in b.to_pylist()]
    assert check_packing(frame, out, 512) < 0.03
    assert TaskContext.get() is None


def test_plan_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        steps = [rng.randrange(1, 6) for _ in range(12)]
        places = np.concatenate(([0], np.cumsum(steps)))
        penalty = np.array([float(rng.randrange(4)) for _ in places])
        width = 8
        best = [0.0] + [1e9] * 12
        for j in range(1, 13):
            best[j] = min(best[i] + width - (places[j] - places[i]) + penalty[j] for i in range(j) if places[j] - places[i] <= width)
        ends = [0, *packing.plan(places, penalty, width)]
        assert ends[-1] == 12
        cost = sum(width - (places[b] - places[a]) + penalty[b] for a, b in zip(ends, ends[1:-1]))
        least = min(best[i] for i in range(12) if places[12] - places[i] <= width)
        assert abs(cost - least) < 1e-9 and all(places[b] - places[a] <= width for a, b in zip(ends, ends[1:]))


def test_empty_tables(no_docs):
    assert token_counts.count_tokens(no_docs, P.path("piece_bpe_32k.model")).count() == 0
    assert bpe.encode_documents(no_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert packing.pack(no_docs, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


@pytest.mark.parametrize("n", [1_000_000, 5_000_000])
def test_long_runs_are_packed_as_the_library_has_them(spark, n):
    """Runs of one character that the fast library gives up on."""
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [f"x{c * n}a" for c in (" ", "\n", "\t")] + (["\u3000" * n + "b"] if n == 1_000_000 else [])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    pieces = packing.pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN, 2048).collect()
    for k, text in enumerate(texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r.start, r.length, r.ids_crc32) for r in pieces if r.doc_id == k)
        assert own[0][0] == 0 and all(a + b == c for (a, b, _), (c, _, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] == len(ids)
        assert all(zlib.crc32(ids[a : a + b].tobytes()) == crc for a, b, crc in own)
