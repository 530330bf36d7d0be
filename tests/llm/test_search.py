"""Exact top-k search, cross-tokenizer alignment and whitening against brute force, with odd rows; and the fast encoder against the file's own."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from regioflux.llm import alignment, byte_level, impact_index, queries, whitening

VECTORS = "vec_id long, embedding array<double>, label string, score int, rank int"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "one", "  two  spaces ", "Ünï CÖDE  ß\x0bx 漢字 🙂", "a ▁ b", "<|endoftext|> and <s> </s> <unk>", "tab\tline\r\n\n\nend", "don't we'll 12,345.67",
    "\x00\x01", "   x", "x" * 3000, "näive é", "word " * 700,
]


# Exact top-k search


def vectors(seed: int, n: int, d: int, heavy: bool = False) -> list[tuple]:
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) / np.sqrt(d)
    if heavy:
        x[n // 3 : 2 * n // 3] = x[0]  # a third of the rows are copies
    return [(i, r.tolist(), "l", 1, 2) for i, r in enumerate(x)]


def brute_top(rows: list[tuple], k: int) -> dict[int, list[tuple[int, int]]]:
    known = {}
    for i, v, *_ in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v):
            known[i] = [int(np.floor(64 * c)) for c in v]
    out = {}
    for q, a in known.items():
        if q % 5 == 0:
            scores = [(-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in known.items() if i != q and len(b) == len(a)]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return {q: found for q, found in out.items() if found}


@pytest.mark.parametrize("shard,chunk,heavy", [(16, 4, False), (37, 500, True), (4096, 4096, False), (64, 16, True)])
def test_top_k_equals_brute_force(spark, shard, chunk, heavy):
    rows = vectors(shard, 300, 12, heavy) + [
        (1000, None, "", 0, 0), (1005, [None] * 12, "", 0, 0), (1010, [float("nan")] * 12, "", 0, 0), (1015, [float("inf")] + [0.0] * 11, "", 0, 0),
        (1020, [0.0] * 12, "", 0, 0), (1025, [-0.001] * 12, "", 0, 0), (None, [1.0] * 12, "", 0, 0), (1030, [1.0, 2.0], "", 0, 0), (1035, [3.0, -1.0], "", 0, 0),
        (1040, [], "", 0, 0), (1045, [1e6] * 12, "", 0, 0),
    ]
    table = spark.createDataFrame([*rows, rows[3], rows[5]], VECTORS)
    found = impact_index.top(table, F.col("vec_id") % 5 == 0, 7, shard=shard, chunk=chunk)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    got: dict = {}
    for r in sorted(found.collect()):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    wanted = brute_top(rows, 7)
    assert {q: [(i, s) for _, i, s in x] for q, x in got.items()} == wanted
    assert all([n for n, _, _ in x] == list(range(1, len(x) + 1)) for x in got.values())


def test_top_k_of_few_or_no_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    assert impact_index.top(none, F.col("vec_id") % 5 == 0, 3).count() == 0
    two = spark.createDataFrame([(0, [1.0], "", 0, 0), (1, [2.0], "", 0, 0)], VECTORS)
    assert [tuple(r) for r in impact_index.top(two, F.col("vec_id") % 5 == 0, 3).collect()] == [(0, 1, 1, 64 * 128)]
    assert impact_index.top(two, F.lit(False), 3).count() == 0
    assert impact_index.top(two.limit(1), F.col("vec_id") % 5 == 0, 3).count() == 0


def test_processing_stops_only_on_proof():
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((500, 24)) ** 3 * 30).astype(np.int32)
    made = impact_index.segments(x)
    heads = np.frombuffer(made["heads"], np.int64).reshape(-1, 3)
    assert (np.diff(heads[:, 0]) <= 0).all()
    ids = np.arange(500)
    shard = impact_index.Shard(24, ids.tobytes(), x.tobytes(), made["heads"], made["places"], made["rests"])
    query, row, score = shard.search(ids[:40], x[:40], np.full(40, np.iinfo(np.int64).min), 10)
    products = x[:40].astype(np.int64) @ x.T.astype(np.int64)
    for q in range(40):
        order = sorted((-products[q, i], i) for i in range(500) if i != q)[:10]
        assert [(-s, i) for s, i in zip(score[query == q].tolist(), row[query == q].tolist(), strict=True)] == order


# Cross-tokenizer alignment


def test_fast_encoder_gives_the_files_ids():
    for added in (False, True):
        own = Tokenizer.from_file(A)
        own.encode_special_tokens = not added
        fast = byte_level.ByteLevel(A, added)
        assert fast._fast is not None
        texts = [t or "" for t in TEXTS] + [" " * 300_000, "a" + "\n" * 20_000 + "b", "x<|endoftext|>y <|endoftext|>", "a" * 200_000]
        points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000][:: 1 if added else 7]
        texts += ["a{0}a 1{0}1 .{0}.  {0}{0} b".format(c) for c in points]
        for i in range(0, len(texts), 20_000):
            part = texts[i : i + 20_000]
            ids, counts = fast.encode_all(part)
            wanted = [e.ids for e in own.encode_batch(part, add_special_tokens=False)]
            assert counts.tolist() == [len(w) for w in wanted] and ids.tolist() == [x for w in wanted for x in w]


def brute_alignment(texts: list[str | None]) -> list[tuple]:
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of = byte_level.spelling()
    a_bytes = {i: bytes(of[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in of for c in t)}

    def b_bytes(i: int) -> bytes:
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    found: list = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids = a.encode(" " + text, add_special_tokens=False).ids if text else [], b.encode(text) if text else []
        parts = [a_bytes[i] for i in ids[0]], [b_bytes(i) for i in ids[1]]
        if not text or any(b"".join(p) != whole for p in parts):
            found.append(None)
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids[s], ends[s], strict=True) if low < e <= cut) for s in (0, 1)))
            low = cut
        pairs = [(ids[0][i], ids[1][j]) for i, x in enumerate(ends[0]) for j, y in enumerate(ends[1]) if x == y] if len(text) < 2000 else [
            (dict(zip(ends[0], ids[0], strict=True))[c], dict(zip(ends[1], ids[1], strict=True))[c]) for c in cuts
        ]
        found.append((len(ids[0]), len(ids[1]), ";".join(groups), pairs))
    counts = Counter(p for x in found if x for p in x[3])
    best: dict = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "", "") if x is None
        else (x[0], x[1], x[2].count("|"), len(x[3]), sum(counts[p] == best[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(x[2].encode()).hexdigest(), x[2])
        for x in found
    ]


@pytest.mark.parametrize("block", [1 << 23, 200])
def test_alignment_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    texts = [*TEXTS, *TEXTS[:6], "one"]
    rows = [(i % 19, t, "clash", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links string, block int").repartition(3)
    found = alignment.add_counts(alignment.aligned(docs, A, B, with_groups=True))
    wanted = sorted((i % 19, *w) for i, w in enumerate(brute_alignment(texts)))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    assert sorted(tuple(r) for r in found.select(*names).collect()) == wanted
    assert sum(w[1] == 0 for w in wanted) >= 5
    assert alignment.add_counts(alignment.aligned(docs.limit(0), A, B)).count() == 0


def test_lanes_lose_no_link():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 3000) for _ in range(20)]
    bounds = np.append(0, np.cumsum(sizes))
    ends = [np.array(sorted({*rng.sample(range(1, bounds[-1]), bounds[-1] // 3), *bounds[1:].tolist()})) for _ in range(2)]
    wanted = np.intersect1d(*ends)
    for lane in (1, 7, 512, 1 << 20):
        a, b = alignment.lockstep(*ends, bounds, lane)
        assert (ends[0][a] == wanted).all() and (ends[1][b] == wanted).all()
    none = np.zeros(0, np.int64)
    assert [len(x) for x in alignment.lockstep(none, none, np.zeros(1, np.int64))] == [0, 0]


# Embedding whitening


def whitened(table, **more):
    rows = sorted(whitening.whiten(table, **more).collect())
    return rows, np.array([r.whitened for r in rows])


@pytest.mark.parametrize("d,block", [(5, 16), (24, 8), (40, 16)])
def test_whitening_equals_dense_eigenvectors(spark, d, block):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((400, d)) * np.linspace(1, 3, d) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    x[100:230] = x[0]
    odd = [(900, None), (901, [None] * d), (902, [float("nan")] * d), (903, [float("-inf")] + [0.0] * (d - 1)), (904, [])]
    table = spark.createDataFrame([(i, r.tolist(), "x", 3) for i, r in enumerate(x)] + [(i, v, "x", 3) for i, v in odd], "vec_id long, embedding array<double>, component string, n int")
    rows, found = whitened(table.repartition(5), block=block)
    whole = np.floor(1024 * x).astype(np.int64) + 100_000
    n, sums = len(x), whole.sum(axis=0)
    centre = (n * whole - sums) / n
    values, turns = np.linalg.eigh(centre.T @ centre / n)
    count = min(8, d)
    values, turns = values[::-1][:count], turns[:, ::-1][:, :count]
    wanted = centre @ turns / np.sqrt(values)
    found = found.reshape(n, count)
    assert np.abs(found * np.sign((found * wanted).sum(axis=0)) - wanted).max() < 1e-9
    assert [(r.vec_id, r.component) for r in rows] == [(i, c) for i in range(n) for c in range(1, count + 1)]
    assert [int(r.deviation) for r in rows[::count]] == ((n * whole - sums) ** 2).sum(axis=1).tolist()
    trace = (centre**2).sum() / n
    assert np.allclose([r.explained for r in rows[:count]], values / trace, rtol=1e-9) and {r.n for r in rows} == {n}
    assert max(r.identity_error for r in rows) < 1e-9


def test_whitening_sees_repeated_eigenvalues(spark):
    # Two of each signed unit vector: all eigenvalues are equal.
    rows = [(i, (np.eye(12)[i % 12] * (1 if i < 12 else -1)).tolist()) for i in range(24)]
    found, values = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    values = values.reshape(24, 8)
    assert np.allclose(values.T @ values / 24, np.eye(8), atol=1e-9)
    assert np.allclose([r.explained for r in found], 1 / 12, rtol=1e-3)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    line = [(i, [float(i), float(i)]) for i in range(6)]
    found = whitening.whiten(spark.createDataFrame([*line, (7, [1.0]), (8, [2.0]), (None, [3.0])], schema)).collect()
    # Vectors of each length are fitted apart; a line has one component.
    assert Counter((r.n, r.component) for r in found) == {(6, 1): 6, (3, 1): 3}
    large = [(i, [float(i) * 1e9, 1.0]) for i in range(5)]
    found = sorted(whitening.whiten(spark.createDataFrame(large, schema)).collect())
    assert [int(r.deviation) for r in found] == [(5 * i - 10) ** 2 * int(1024 * 1e9) ** 2 for i in range(5)]


def test_queries_of_whole_tables(spark):
    rows = queries.op13_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert rows.schema["deviation"].dataType.simpleString() == "bigint"
    assert queries.op12_cross_tokenizer_alignment(spark, "/root/testdata/sf0.001").columns == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    ]
