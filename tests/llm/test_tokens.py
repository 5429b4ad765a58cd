import json
import os
from collections import Counter, defaultdict

import hypothesis.strategies as st
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from tokenizers import Tokenizer

from motif_engine.llm import packing as P
from motif_engine.llm import token_files as TF
from motif_engine.llm import token_ids as T

WORD, BYTE = T.vocabulary_path("word_bpe_49k.json"), T.vocabulary_path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, source string, queue string, n int, ids int"
HARD = [
    "it's we've O'Reilly's don't  double  space\n\n\nnew", "\n lead", "x²3 a1b2 foo_bar", "trail \n", "tab\tsep a b   c", "éte café", "Привет мир Ünïcödé日本語 text",
    "<|endoftext|> hi", "a<|startoftext|>b <|endoftext|>", "a <|EndOfText|> b", "", "a\x1cb \x1d c", "…“quoted” — dash", "ΑΣ ΣΑΣ. İstanbul ß ŉ", "  ", " \n a", "a.\nB c,\n\nD", "a..b ,c _. d ._ e.,f", "A.B,C 3.14 $5,000.", ". , a", None,
]


@pytest.mark.parametrize("literal", [False, True])
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_the_tokenizers(path, literal):
    e, plain = T.Encoder(path, literal), Tokenizer.from_file(path)
    if literal:
        plain.encode_special_tokens = True
    assert e.by_chunks
    for _ in range(2):  # the second time from memory
        for text, ids in zip(HARD, e.encode(HARD), strict=True):
            assert np.frombuffer(ids, e.dtype).tolist() == (plain.encode(text, add_special_tokens=False).ids if text else []), text


def test_other_kinds_of_files_are_left_to_the_library(tmp_path):
    form = json.loads(Tokenizer.from_file(BYTE).to_str())
    form["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(form))
    e, plain = T.Encoder(f"{tmp_path}/other.json"), Tokenizer.from_file(f"{tmp_path}/other.json")
    assert not e.by_chunks and np.frombuffer(e.encode(["a b. c"])[0], e.dtype).tolist() == plain.encode("a b. c", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAbéÉİıΣσ12 \n\t.,'s_-!\xa0́日", max_size=25))
def test_ids_of_any_text(text):
    for path in (WORD, BYTE):
        e = T.encoder(path)
        assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == e._ids(text)


def test_forgetting(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 5)
    e = T.Encoder(BYTE)
    text = " ".join(f"word{chr(97 + i % 26)}x" for i in range(60)) + " alpha beta gamma delta epsilon zeta eta theta"
    assert np.frombuffer(e.encode([text, text])[1], e.dtype).tolist() == e._ids(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=300), max_size=5), st.integers(0, 2**40))
def test_chunks_round_trip(documents, start):
    arrays = [np.array(d, np.uint32) for d in documents]
    names = [None if i == 1 else i * 7 - 3 for i in range(len(arrays))]
    got, ids, at = TF.decode_chunk(TF.encode_chunk(names, arrays, start))
    assert got == names and at == start and [x.tolist() for x in ids] == documents


def test_blocks_by_index():
    rng = np.random.default_rng(0)
    ids = np.where(rng.random(1000) < 0.05, rng.integers(0, 2**32, 1000), rng.integers(1000, 1200, 1000)).astype(np.uint32)
    body, index = TF._pack(ids)
    assert len(index) == 8 and len(body) < 4 * 1000 * 0.6
    for b in range(8):
        size = min(128, 1000 - 128 * b)
        assert TF.unpack_block(body, int(index[b]), size).tolist() == ids[128 * b : 128 * b + size].tolist()
    with pytest.raises(ValueError):
        TF.decode_chunk(b"x" * 28)


@pytest.mark.parametrize("chunk", [1, 40, 1 << 18])
def test_token_files(spark, tmp_path, monkeypatch, chunk):
    rows = [(5, "b c", 0), (3, "a", 1), (9, None, 2), (1, "long " * 300, 3), (7, "", 4), (3, "z", 5), (None, "n", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    monkeypatch.setattr(TF, "CHUNK", chunk)
    TF.write_tokens(df, f"{tmp_path}/t", BYTE, 2)
    got = sorted(TF.read_tokens(spark, f"{tmp_path}/t").collect(), key=lambda r: r.start)
    e, n = T.Encoder(BYTE), 0
    for r, (d, t, _) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        want = [*(e._ids(t) if t else []), 2]
        assert (r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) == (d, n, want)
        n += len(want)
    TF.write_tokens(df.limit(0), f"{tmp_path}/e", BYTE, 2)
    assert TF.read_tokens(spark, f"{tmp_path}/e").count() == 0


def plain_round_robin(queues, quanta, slice_ids):
    """Deficit round-robin over lists of document sizes: (queue, document, start, size) in the order of service."""
    heads = {q: [(d, s, min(slice_ids, n - s)) for d, n in enumerate(sizes) for s in range(0, n, slice_ids)] for q, sizes in queues.items()}
    deficit = {q: xxhash.xxh64_intdigest(q, 42) % P._PHASES / P._PHASES * min(slice_ids, sum(n)) for q, n in queues.items()}
    out = []
    while any(heads.values()):
        for q in sorted(queues):
            deficit[q] += quanta[q]
            while heads[q] and heads[q][0][2] <= deficit[q]:
                d, s, n = heads[q].pop(0)
                deficit[q] -= n
                out.append((q, d, s, n))
    return out


@pytest.mark.parametrize(("length", "slice_ids", "segment"), [(64, 16, 50), (64, 64, 1 << 18), (8, 1000, 300)])
def test_packing_is_the_deficit_round_robin(spark, length, slice_ids, segment):
    rng = np.random.default_rng(length)
    sizes = {f"={q}": rng.integers(1, 60, n).tolist() for q, n in (("a", 30), ("b", 25), ("c", 4), ("d", 12))}
    rows = [(1000 * k + d, "w " * (n - 1), q[1:]) for k, q in enumerate(sorted(sizes)) for d, n in enumerate(sizes[q])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    got = P.pack(df, WORD, length=length, weights={"a": 4.0, "b": 2.0, "c": 1.0}, slice_ids=slice_ids, segment_ids=segment).collect()
    want = plain_round_robin(sizes, {"=a": length / 2, "=b": length / 4, "=c": length / 8, "=d": length / 8}, slice_ids)
    stream = [(1000 * sorted(sizes).index(q) + d, s + i) for q, d, s, n in want for i in range(n)]
    assert [(r.doc_id, r.start + i) for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) for i in range(r.length)] == stream
    assert all(r.offset + r.length <= length for r in got)


def test_packing(spark):
    texts = [("a b c " * (i % 40), f"s{i % 3}" if i % 7 else None) for i in range(200)] + [(None, "s0"), ("", None), ("word " * 9000, "s1")]
    df = spark.createDataFrame([(i, t, s, "q", i, 0) for i, (t, s) in enumerate(texts)] + [(None, "x y", "s2", "q", 0, 0), (0, texts[0][0], texts[0][1], "q", 0, 0)], DOCS)
    rows = P.pack(df, WORD).collect()
    total = sum(r.length for r in rows)
    by = Counter()
    for r in rows:
        by[r.sequence_id] += r.length
        assert len(r.ids) == 4 * r.length
    assert sorted(by) == list(range(-(-total // 2048))) and all(n == 2048 for k, n in by.items() if k < max(by))
    whole = defaultdict(bytes)
    for r in sorted(rows, key=lambda r: r.start):
        whole[r.doc_id] += r.ids
    e = T.Encoder(WORD)
    assert all(np.frombuffer(whole[i], "<u4").tolist() == [*(e._ids(t) if t else []), 1] for i, (t, _) in enumerate(texts) if i)
    # most documents stay whole: cut where a window ends, and where a slice does
    assert len(rows) <= len(texts) + 2 + len(by) + sum(-(-r.doc_tokens // P.SLICE) - 1 for r in rows if r.start == 0)
    assert P.pack(df.limit(0), WORD).count() == 0


def test_packing_to_target_weights_with_many_sources(spark):
    """However many sources there are, named ones get their targets over any run of windows, but for a slice."""
    big = [(i, "w " * 2000, s) for s in ("s0", "s1", "hot") for i in range(10)]
    small = [(i, "w " * 300, f"t{i}") for i in range(297)]
    df = spark.createDataFrame(big + small, "doc_id long, text string, source string")
    rows = P.pack(df, WORD, weights={"s0": 600.0, "s1": 300.0, "t0": 1.0}).collect()
    served = Counter()
    for r in rows:
        if r.sequence_id < 15:
            served[r.queue] += r.length
    assert sum(r.length for r in rows) == 30 * 2001 + 297 * 301 and len({r.queue for r in rows}) == 300
    total = 600 + 300 + 298
    for q, weight in (("=s0", 600), ("=s1", 300)):
        assert abs(served[q] - 15 * 2048 * weight / total) <= 3 * P.SLICE
    natural = Counter()
    for r in P.pack(df, WORD).collect():
        natural[r.queue] += r.length if r.sequence_id < 40 else 0
    share = 2048 * 40 * 20010 / (30 * 2001 + 297 * 301)
    assert all(abs(natural[q] - share) <= 3 * P.SLICE for q in ("=s0", "=s1", "=hot"))


def test_a_queue_that_ends_early_leaves_its_windows(spark):
    df = spark.createDataFrame([(i, "w " * 99, "short" if i < 10 else "long") for i in range(200)], "doc_id long, text string, source string")
    rows = P.pack(df, WORD, weights={"short": 3.0, "long": 1.0}, segment_ids=3000).collect()
    by = Counter()
    for r in rows:
        by[r.sequence_id] += r.length
    assert all(n == 2048 for k, n in by.items() if k < max(by)) and sum(by.values()) == 20000
    assert {r.queue for r in rows if r.sequence_id > 1} == {"=long"} and {r.queue for r in rows if r.sequence_id == 0} == {"=short", "=long"}


def test_vocabularies_are_where_the_library_says():
    assert os.path.isfile(WORD) and os.path.isfile(BYTE)
