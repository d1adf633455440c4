"""Token files and piece ids: exact against the libraries, and round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitquarry.llm import pieces, token_files
from bitquarry.llm.common import fresh_path, shared_dir

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a", "a  b   c ", "a\n b\n\n c \n", "x<|endoftext|> y", "é  b　 c", "a \tb", "it's 12 don't", "\t a", "日本語テキスト\x01 x", "\n", " \n ", "x" * 700, "𝔘nk 𝔘 n\x00k", " " * 40 + "x"]


def test_words_are_exact():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(BPE), token_files.WordEncoder(BPE)
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(["ab", " ", "\n", "\t", "é", "9", ".", " the", "'s"]) for _ in range(rng.randrange(40))) for _ in range(500)]
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, e.encode(texts), strict=True):
            assert np.frombuffer(ids, e.dtype).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_word_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "WORDS_KEPT", 50)
    e, whole = token_files.WordEncoder(BPE), token_files.WordEncoder(BPE)
    for k in range(20):
        texts = [" ".join(f"w{i}" for i in range(k * 9, k * 9 + 30)) + "\n \n x" for _ in range(2)]
        assert e.encode(texts) == whole.encode(texts)
        assert len(e.known[True][0]) <= 50


def expected(rows):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(BPE), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("seq_len", [16, 2048])
def test_token_files(spark, make, seq_len):
    rows = [(3 * i % 101, TEXTS[i % len(TEXTS)] + f" doc {i}" * (i % 50)) for i in range(101)]
    got = token_files.token_table(make(rows), BPE, 2, seq_len).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == sorted(expected(rows))


def test_token_files_layout(spark, make):
    path = fresh_path(spark, "layout")
    rows = [(i, "some words here " * i) for i in range(40)]
    m = token_files.write_token_files(make(rows), path, BPE, 2, 8, partitions=3).collect()
    ids = []
    for r in sorted(m, key=lambda r: r["part"]):
        name = f"{path}/{r['ids_path']}".removeprefix("file:")
        with pa.ipc.open_file(pa.memory_map(name)) as f:
            n = sum(f.get_batch(k).num_rows for k in range(f.num_record_batches))
        both = [token_files.sequence(name, k) for k in range(n)]
        assert all(len(a) == len(b) == 8 for a, b in both) and both[0][0].base is not None
        ids += [x for a, b in both for x in a[b].tolist()]
        assert sum(b.sum() for _, b in both) == r["n_tokens"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    assert ids == [x for _, text in rows for x in [*t.encode(text, add_special_tokens=False).ids, 2]]


def test_files_are_read_in_parallel(spark, make, monkeypatch):
    path = fresh_path(spark, "parallel")
    m = token_files.write_token_files(make([(i, f"doc {i}") for i in range(400)]), path, BPE, 2, partitions=40)
    assert m.count() > 30
    for most, least in ((token_files.READ_TOKENS, spark.sparkContext.defaultParallelism), (1, m.count())):  # cores, or files
        monkeypatch.setattr(token_files, "READ_TOKENS", most)
        found = token_files.read_token_files(spark, path)
        assert found.count() == 400 and found.rdd.getNumPartitions() == least > 1
        assert found.select(F.spark_partition_id()).distinct().count() > least // 2


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_are_refused(name):
    with pytest.raises(ValueError):
        token_files.WordEncoder(public_tokenizers.path(name))


def test_word_memory_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(token_files, "WORD_BYTES", 20000)
    e, whole = token_files.WordEncoder(BPE), token_files.WordEncoder(BPE)
    for k in range(12):
        texts = [" ".join(f"{i:0200d}" for i in range(k * 9, k * 9 + 20))]
        assert e.encode(texts) == whole.encode(texts)
        assert e.size[True] <= 20000


def test_token_files_odd(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = token_files.token_table(odd, BPE, 2).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected(rows)))
    assert token_files.token_table(empty, BPE, 2).count() == 0


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_are_exact():
    m, sp = pieces.Model(PIECES), library()
    for text in TEXTS:
        ids = np.frombuffer(m.encode([m.prepared(text)])[0], "<i4")
        assert ids.tolist() == sp.encode(text) and m.decode(ids) == text


def scan(m, text, chunk):
    parts, product, values = pieces.chunks_of(m, text, chunk), np.zeros((1, 1), np.int64), []
    for t, low, high, s, e in parts:
        values.append(product[0].tolist())
        product = pieces.combine(product, m.transfer(t, s, e, low, high))
    want, out = 0, []
    for (t, low, high, s, e), v in reversed(list(zip(parts, values, strict=True))):
        want, ids = m.backtrace(t, s, e, low, high, v)[want]
        out.append(ids)
    return np.frombuffer(b"".join(reversed(out)), "<i4").tolist(), len(parts), int(product[0, 0])


def test_scan_is_exact():
    m, sp, rng, parts = pieces.Model(PIECES), library(), random.Random(5), 0
    syllables = ["th", "in", "er", "the", "ation", "re", "日", "語", "x", "1", "é", "tion"]
    for k in range(40):
        text = "".join(rng.choice(syllables + ["\n"] * (k % 2)) for _ in range(rng.randrange(60, 300)))
        if k % 4 == 0:
            text = " ".join(text[i : i + 90] for i in range(0, len(text), 90))
        ids, n, value = scan(m, m.prepared(text), 64)
        parts = max(parts, n)
        assert ids == sp.encode(text) and value == m.scores[ids].sum()
    assert parts > 4


@pytest.fixture(scope="session")
def unigram(tmp_path_factory):
    """A unigram model with scores set by hand, multiples of 1/8, so that sums of floats are exact."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.name, m.normalizer_spec.remove_extra_whitespaces = "identity", False
    rows = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256)]
    rows += [(c, -8 - i / 8, 1) for i, c in enumerate("abcdefgh\n▁")]
    rng = random.Random(1)
    seen = {r[0] for r in rows}
    for _ in range(400):
        piece = "▁" * rng.randrange(2) + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
        if piece not in seen:
            seen.add(piece)
            rows.append((piece, -9 - rng.randrange(100) / 8, 1))
    for piece, score, kind in rows:
        m.pieces.add(piece=piece, score=score, type=kind)
    path = tmp_path_factory.mktemp("unigram") / "m.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_unigram_scan_is_exact(unigram):
    import sentencepiece

    m, sp, rng = pieces.load(unigram), sentencepiece.SentencePieceProcessor(model_file=unigram), random.Random(7)
    assert isinstance(m, pieces.Unigram) and not isinstance(pieces.load(PIECES), pieces.Unigram)
    wide = 0
    for k in range(60):
        text = "".join(rng.choice("abcdefgh" + " \nxé日"[: k % 6]) for _ in range(rng.randrange(0, 400)))
        ids, n, value = scan(m, m.prepared(text), 32)
        assert ids == sp.encode(text), repr(text)
        assert m.decode(np.array(ids, "<i4")) == text
        values = m._best(m.prepared(text), 0, len(m.prepared(text)))[0]
        assert not text or value == values[len(m.prepared(text))]
        wide = max(wide, *(len(x[3]) for x in pieces.chunks_of(m, m.prepared(text), 32)))
    assert wide > 2  # cuts within words have several states, between which the scan decides


def test_unigram_documents(make, unigram, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "GROUP", 3)
    sp, rng = sentencepiece.SentencePieceProcessor(model_file=unigram), random.Random(8)
    rows = [(i, "".join(rng.choice("abcdefgh" + " " * (i % 2)) for _ in range(60 * i))) for i in range(12)]
    got = pieces.encode(make(rows), unigram, chunk=50)
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == {i: sp.encode(t) for i, t in rows}


def test_restored_is_honest(make):
    got = pieces.encode_checked(make([(1, "a b"), (2, "a▁b"), (3, "x▁" * 40000)]), PIECES)
    assert {r["doc_id"]: r["restored"] for r in got.collect()} == {1: True, 2: False, 3: False}


def test_max_plus():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(-50, 0, s) for s in ((2, 3), (3, 4), (4, 1)))
    assert (pieces.combine(pieces.combine(a, b), c) == pieces.combine(a, pieces.combine(b, c))).all()


def test_giant_documents(make, odd, empty):
    sp = library()
    rows = [(1, "the ration of things " * 300), (2, "therationofthings" * 80), (3, "short"), (4, "日本語" * 400), (5, " " * 3000 + "a")]
    docs = make(rows)
    got = pieces.encode(docs, PIECES, chunk=1000)
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == {i: sp.encode(t) for i, t in rows}
    assert {r["doc_id"]: r["text"] for r in pieces.decode(got.drop("text"), PIECES).collect()} == dict(rows)
    checked = pieces.encode_checked(docs, PIECES, chunk=1000)
    assert checked.filter("restored").count() == 5
    crc = {r["doc_id"]: r["c"] for r in checked.select("doc_id", F.crc32("ids").alias("c")).collect()}
    assert crc == {i: zlib.crc32(np.array(sp.encode(t), "<i4").tobytes()) for i, t in rows}
    o = pieces.encode(odd, PIECES)
    assert o.count() == odd.count() and set(o.columns) == set(odd.columns)
    assert pieces.encode_checked(odd, PIECES).filter("not restored").count() == 0
    assert pieces.encode(empty, PIECES).count() == 0 and pieces.encode_checked(empty, PIECES).count() == 0


def test_shared_dir(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
