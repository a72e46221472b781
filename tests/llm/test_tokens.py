"""Encoder, packing and Re-Pair shards: exact ids, exact round trips."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
from lumenfold.llm import packing, repair  # noqa: E402
from lumenfold.llm._tokens import ChunkEncoder  # noqa: E402
from lumenfold.llm.queries import tokenizer_path  # noqa: E402

PATH = tokenizer_path()
TOKENIZER = tokenizers.Tokenizer.from_file(PATH)


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_chunks_give_the_same_ids():
    r = random.Random(1)
    signs = "ab .\n\t  '  é😀1!s\x85\x1c\x00​　ſÄ"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["it's  a\n\nTest 's 're", " lead", "", "\n", "a", "  ", "x" * 5000]
    for text, got in zip(texts, ChunkEncoder(PATH, cap=500).encode(texts), strict=True):
        assert got.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_matched_in_text():
    end = "<|endoftext|>"
    texts = [end, f"a{end}b", f"a {end} b", f"{end}{end}", f"x\n{end}\n", "a <|endoftext| > b", "<|", "endoftext|>", None, "plain text", f"{end} plain text", "plain text|> <|endoftext"]
    for batch in (texts, [end], [f" {end}"] * 3):
        for text, got in zip(batch, ChunkEncoder(PATH).encode(batch), strict=True):
            assert got.tolist() == TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_added_tokens_reach_packing_and_shards(make_docs):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "no token")]
    got = repair.encode_documents(make_docs(rows), PATH).collect()
    assert {(g.doc_id, g.n_tokens, g.ids_crc32) for g in got} == {(d, len(ids(t)), crc(ids(t))) for d, t in rows}
    got = packing.pack(make_docs(rows), PATH, 256).collect()
    assert {(g.doc_id, g.length, g.ids_crc32) for g in got} == {(d, len(ids(t)), crc(ids(t))) for d, t in rows}


def test_plan_holds_every_length():
    r = np.random.default_rng(0)
    for n in (0, 1, 30, 5000):
        counts = np.bincount(np.minimum(r.lognormal(4.5, 1.2, n).astype(int) + 1, 256), minlength=257)
        patterns, bound, share = packing.plan(counts)
        held = Counter()
        for p, m in patterns.items():
            assert sum(p) <= 256 and m > 0
            for k in p:
                held[k] += m
        assert all(held[i] == c for i, c in enumerate(counts))
        used = sum(patterns.values())
        assert bound - 1e-6 <= used <= max(1.0, 1.02 * bound + 1)
        assert n < 5000 or (share >= 0.5 and used <= bound + 2)


def test_the_program_places_nearly_all_pieces_of_documents():
    import pyarrow.parquet as pq

    from lumenfold.llm._tokens import encoded

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).combine_chunks()
    counts = np.bincount([n for x in encoded(texts, PATH, 2) for _, n in packing.cut(len(x), 1024)], minlength=1025)
    patterns, bound, share = packing.plan(counts)
    used, plain = sum(patterns.values()), sum(packing.best_fit(counts).values())
    print(f"program {share:.3f} of short pieces, {used} sequences, bound {bound:.1f}, best fit alone {plain}")
    assert share >= 0.9 and used <= min(plain, 1.005 * bound)


def test_pack(make_docs, edge_rows):
    r = random.Random(2)
    rows = edge_rows + [(100 + i, " ".join(r.choice(["alpha", "beta", "gamma,"]) for _ in range(r.randint(0, 900)))) for i in range(150)]
    got = packing.pack(make_docs(rows), PATH, 256).collect()
    want = Counter()
    for doc, text in rows:
        x = ids(text)
        first = (len(x) - 1) % 256 + 1
        for k, (s, n) in enumerate([(0, first)] + [(s, 256) for s in range(first, len(x), 256)]):
            want[(doc, k, s, n, crc(x[s : s + n]))] += 1
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    at = {}
    for g in sorted(got, key=lambda g: (g.sequence_id, g.offset)):
        assert g.offset == at.get(g.sequence_id, 0)
        at[g.sequence_id] = g.offset + g.length
    assert max(at.values()) <= 256
    assert packing.pack(make_docs([]), PATH, 256).count() == 0


def test_repair_shards(make_docs, edge_rows):
    rows = edge_rows + [(50 + i, "the cat and the dog and the cat " * (i % 9 * 20)) for i in range(40)]
    got = repair.encode_documents(make_docs(rows), PATH).collect()
    assert Counter((g.doc_id, g.n_tokens, g.ids_crc32) for g in got) == Counter((d, len(ids(t)), crc(ids(t))) for d, t in rows)
    at = 0
    for g in sorted(got, key=lambda g: g.start):
        assert g.start == at
        at += g.n_tokens
    known = [g.doc_id for g in sorted(got, key=lambda g: g.start) if g.doc_id is not None]
    assert known == sorted(known)
    assert repair.encode_documents(make_docs([]), PATH).count() == 0


def test_rounds_go_on_until_no_pair_is_frequent():
    r = np.random.default_rng(4)
    passage = r.integers(0, 50_000, 600).astype(np.uint16)
    docs = [np.concatenate([r.integers(0, 50_000, 5).astype(np.uint16), passage]) for _ in range(100)] + [np.full(4096, 7, np.uint16)]
    shard = repair.Shard(repair.compress(docs, 50_257))
    assert all((shard.ids(k) == d).all() for k, d in enumerate(docs))
    assert max(np.diff(shard.starts.astype(np.int64))) < 40 and max(shard.rule_len) > 256
    left = Counter()
    for a, b in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist(), strict=True):
        own = shard.symbols[a:b].tolist()
        left.update(zip(own, own[1:], strict=False))
    assert max(left.values()) < repair.PAYS


def test_shard_random_access_and_size():
    r = np.random.default_rng(3)
    docs = [r.choice([5, 6, 7, 8, 50_000], n).astype(np.uint16) for n in (0, 1, 700, 3000, 2)]
    data = repair.compress(docs, 50_257, at_least=4)
    shard = repair.Shard(data)
    assert len(shard) == 5 and len(shard.left) > 0 and len(data) < 2 * sum(map(len, docs))
    for k, d in enumerate(docs):
        assert (shard.ids(k) == d).all()
        for a, b in ((0, 1), (5, 60), (690, 900)):
            assert (shard.ids(k, a, b) == d[a:b]).all()
    same = repair.Shard(repair.compress([np.full(101, 9, np.uint16)], 50_257, at_least=2))
    assert (same.ids(0) == 9).all() and len(same.ids(0)) == 101
