import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pulseloom.llm import packing, piece_codec, wavelet, word_bpe
from pulseloom.llm.byte_tokens import byte_tokens
from pulseloom.llm.tables import new_path

MODEL, VOCAB = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
TEXT = st.text(st.sampled_from(list("ab'stZ9 .\n\t 　é日|<>")), max_size=60)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_byte_tokens_equal_the_library(text):
    want = byte_tokens(VOCAB).library.encode(text, add_special_tokens=False).ids
    assert byte_tokens(VOCAB).encode([text])[0].tolist() == want


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_pieces_equal_the_library_and_spans_tile_the_text(text):
    own = piece_codec.codec(MODEL)
    got = own.encode([text])[0]
    assert got.ids.tolist() == own.library.encode(text, add_bos=True, add_eos=True)
    raw = text.encode()
    spans = [raw[a:b] for a, b in zip(got.begin[1:-1], got.end[1:-1], strict=True)]
    assert b"".join(spans) == raw
    proto = own.library.encode(text, return_type="proto")
    if "�" not in "".join(p.surface for p in proto.pieces):
        assert [s.decode(errors="replace") for s in spans if s] == [p.surface for p in proto.pieces if p.surface]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_longest_prefix_normalisation_equals_the_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = next(v for n, _, v, _, _ in piece_codec._fields(library.serialized_model_proto()) if n == 3)
    spec = {n: v for n, _, v, _, _ in piece_codec._fields(spec)}
    own = piece_codec.Normalizer(piece_codec.Rules(bytes(spec[2]), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))))
    for text in ["", " ", "ＡＢＣ ﬁ ①  x ", "  é́ 　 Ⅳ", "½ ｶﾞ Straße", "​ a­b\r\n c", "가각 ｱ"]:
        got = own(text.encode())
        assert got.data.decode() == library.normalize(text)
        assert len(got.source) == len(got.data) + 1 and (np.diff(got.source) >= 0).all()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "none"])
def test_jumps_equal_prefix_steps(rule):
    """The query's path, for maps with entries and for an empty one."""
    if rule == "none":
        charsmap = b""
    else:
        spec = next(v for n, _, v, _, _ in piece_codec._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if n == 3)
        charsmap = bytes({n: v for n, _, v, _, _ in piece_codec._fields(spec)}[2])
    rng = np.random.default_rng(3)
    letters = list("ab  \n\tＡﬁ①éé́　Ⅳ½ｶﾞß가ᄀ\u200b\xad\U0001f600日")
    for prefix in (True, False):
        for escape in (True, False):
            own = piece_codec.Normalizer(piece_codec.Rules(charsmap, prefix, False, escape))
            for n in (1, 2, 5, 40, 40, 300):
                raw = "".join(rng.choice(letters, n)).encode()
                one, two = own._by_jumps(raw), own._by_prefix(raw)
                assert one.data == two.data and one.source.tolist() == two.source.tolist()


def test_piece_digests(spark, odd_documents, no_documents):
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = piece_codec.piece_digests(odd_documents, MODEL).collect()
    assert len(rows) == odd_documents.count()
    texts = {r.doc_id: r.text or "" for r in odd_documents.collect()}
    for r in rows:
        ids = own.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids).encode()).hexdigest()
    assert piece_codec.piece_digests(no_documents, MODEL).count() == 0
    back = {r.doc_id: r.text for r in piece_codec.decode_pieces(piece_codec.encode_pieces(odd_documents, MODEL), MODEL).collect()}
    assert all(back[k] == own.decode(own.encode(t)) for k, t in texts.items())


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    rng = random.Random(n)
    ids = np.array([rng.choice([0, 1, 5, 5, 5, 200, 50256]) for _ in range(n)], "<u2")
    m = wavelet.WaveletMatrix.build(ids, 16)
    assert m.decode().tolist() == ids.tolist()
    for at in rng.sample(range(n), min(n, 20)):
        assert m.access(at) == ids[at]
        assert m.count(5, 0, at) == (ids[:at] == 5).sum()
    for token in (0, 5, 7, 50256):
        assert m.occurrences(token) == np.flatnonzero(ids == token).tolist()
    assert m.count(1 << 16) == 0


def test_token_files(spark, odd_documents, no_documents):
    own = byte_tokens(VOCAB)
    wavelet.write_tokens(odd_documents, VOCAB, path := new_path(spark, "tokens"), block=5000)
    got = sorted(map(tuple, wavelet.token_digests(spark, path).collect()))
    at, want, places = 0, [], []
    for r in sorted(odd_documents.collect(), key=lambda r: r.doc_id):
        ids = [*own.library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        places += [(r.doc_id, k) for k, i in enumerate(ids) if i == 262]
        at += len(ids)
    assert got == sorted(want)
    assert sorted(map(tuple, wavelet.find_token(spark, path, 262).collect())) == sorted(places)
    wavelet.write_tokens(no_documents, VOCAB, path := new_path(spark, "tokens"))
    assert wavelet.token_digests(spark, path).count() == 0


def test_best_fit_equals_a_scan_over_open_windows():
    rng = np.random.default_rng(3)
    lengths = -np.sort(-rng.integers(1, 1025, 700))
    sequence, offset, n = packing.best_fit(lengths, 1024)
    fill: list[int] = []
    for length, s, o in zip(lengths.tolist(), sequence, offset, strict=True):
        fits = [1024 - f for f in fill if f + length <= 1024]
        if fits:
            assert fill[s] == o and 1024 - o == min(fits)
            fill[s] += length
        else:
            assert s == len(fill) and o == 0
            fill.append(length)
    assert len(fill) == n and sum(fill) > 0.97 * 1024 * n


def test_packing(spark, odd_documents, no_documents):
    own = byte_tokens(VOCAB)
    rows = packing.pack_documents(odd_documents, VOCAB).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and all(r.padded_to == (at if at & (at - 1) == 0 else 1024) for r in parts)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for d in odd_documents.collect():
        ids = np.array([*own.library.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        times = 2 if d.doc_id == 3 else 1
        assert sum(r.length for r in pieces[d.doc_id]) == times * len(ids)
        for r in pieces[d.doc_id]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.pack_documents(no_documents, VOCAB).count() == 0


def test_packing_pads_little_over_many_partitions(spark):
    docs = spark.createDataFrame([(k, "lamp stone " * (3 + k % 40)) for k in range(300)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = packing.pack_documents(docs, VOCAB).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.doc_id for r in rows} == set(range(300))
    n, tokens = len({r.sequence_id for r in rows}), sum(r.length for r in rows)
    assert n <= -(-tokens // 1024) + 1


@pytest.mark.parametrize("session", ["2", "50"])
def test_packing_in_several_shards(spark, monkeypatch, session):
    """Shards hold about PIECES remainders each, in any session, also if all rows are one document's."""
    monkeypatch.setattr(packing, "PIECES", 50)
    docs = spark.createDataFrame([(k if k < 100 else None, "lamp stone " * (3 + (k % 40 if k < 100 else 7))) for k in range(300)] + [(7, "lamp stone " * 3000)], "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", session)
    try:
        rows = packing.pack_documents(docs, VOCAB).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    held, shards = defaultdict(list), defaultdict(int)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
        if r.length < 1024:
            shards[r.sequence_id // 2 % 7] += 1
    assert sum(r.length < 1024 for r in rows) == 301 and len(rows) > 301
    assert len(shards) == 7 and max(shards.values()) <= 75
    for s, parts in held.items():
        ends = [0, *(a + b for a, b in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
        assert (s % 2 == 1) == (parts == [(0, 1024)])
    assert len(held) - sum(r.length == 1024 for r in rows) <= sum(r.length for r in rows if r.length < 1024) / 1024 * 1.3 + 7


@pytest.fixture(scope="module")
def word_codec():
    return word_bpe.WordCodec(P.path("word_bpe_49k.json"))


def word_ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_words_as_the_library_has_them(word_codec):
    library, r = word_codec.library, random.Random(4)
    plain = [chr(k) for k in range(0x2100) if re.match(f"[{word_bpe.PLAIN}]", chr(k))]
    texts = [f"a{c}b {c}{c} 1{c}. '{c}s" for c in plain]
    texts += ["".join(r.choice("abcdeinorstthheé .'!1<|>") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(r.choice("aab") for _ in range(r.randint(0, 90))) for _ in range(500)]
    texts += ["".join(chr(r.choice([r.randrange(0x300), r.randrange(0xD800), r.randrange(0x10000, 0x20000)])) for _ in range(30)) for _ in range(500)]
    texts += ["", "<|endoftext|>a<|startoftext|>", "<|ENDOFTEXT|>", "ΑΣ Σ İ", "é\u0301 日本語", "a" * 5000, "ab" * 3000, "x<|endoftext|"]
    for text, (ids, _, _) in zip(texts, word_codec.encode(texts), strict=True):
        assert ids.tolist() == word_ids(library, text), text
        assert word_codec.decode(ids.tolist()).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_only_failing_words_are_merged(word_codec):
    """Speculation stands just where the merges give the same; both ways of merging agree."""
    r = random.Random(5)
    words = ["".join(r.choice("aeinorsth") for _ in range(r.randint(1, 12))).encode() for _ in range(4000)] + [b"a" * k for k in range(1, 70)]
    m = word_codec.merges
    tokens, bounds = m.propose(words)
    exact, ends = m.merge(words)
    n_failed = 0
    for k, w in enumerate(words):
        guess = tokens[bounds[k] : bounds[k + 1]]
        assert exact[ends[k] : ends[k + 1]].tolist() == m.merge_one(w)
        assert m.compatible(guess[:-1], guess[1:]).all() == (guess.tolist() == m.merge_one(w))
        n_failed += guess.tolist() != m.merge_one(w)
    assert 0 < n_failed < len(words)


def test_word_cache_and_long_texts_change_nothing(word_codec, monkeypatch):
    small = word_bpe.WordCodec(P.path("word_bpe_49k.json"), kept=5)
    monkeypatch.setattr(word_bpe, "LOT", 40)
    texts = ["one two three don't " * 9, "four", "", "no" * 100, "five six <|endoftext|> seven " * 5, "naïve é\u0301 x " * 9]
    assert [(i.tolist(), n, w) for i, n, w in small.encode(texts)] == [(i.tolist(), n, w) for i, n, w in word_codec.encode(texts)]
    assert [i.tolist() for i, _, _ in small.encode(texts)] == [word_ids(word_codec.library, t) for t in texts]


def test_word_tables(spark, odd_documents, no_documents, word_codec):
    path = P.path("word_bpe_49k.json")
    want = sorted((r.doc_id, word_ids(word_codec.library, r.text or "")) for r in odd_documents.collect())
    coded = word_bpe.encode_words(odd_documents, path)
    assert sorted((r.doc_id, r.ids) for r in coded.collect()) == want
    back = sorted((r.doc_id, r.text) for r in word_bpe.decode_words(coded, path).collect())
    assert back == sorted((i, word_codec.library.decode(ids, skip_special_tokens=False)) for i, ids in want)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in word_bpe.word_digests(odd_documents, path).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(word_codec.library.decode(ids, skip_special_tokens=False).encode())) for i, ids in want)
    assert word_bpe.word_digests(no_documents, path).collect() == []
    null = spark.createDataFrame([(1, None), (2, [5, None, 999999])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in word_bpe.decode_words(null, path).collect()} == {1: "", 2: word_codec.library.decode([5], skip_special_tokens=False)}
