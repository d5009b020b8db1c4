"""Vectors, links and archives against brute force."""

import base64
import hashlib
import random

import numpy as np


def test_components(spark):
    from modcall.llm.components import components

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    label = {x: x for e in edges for x in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    want = {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark):
    from modcall.llm.embedding_dedup import embedding_links

    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:20] + 0.1 * rng.standard_normal((20, 16)), base[:5], np.zeros((1, 16))])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(500, None), (501, [float("nan")] * 16), (502, [1.0] + [None] * 15), (503, [])]
    got = {r.vec_id: r for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    y = x[:-1].astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = (y @ y.T >= 0.95) & ~np.eye(len(y), dtype=bool)
    want, label = near.sum(1), np.arange(len(y))
    for _ in range(len(y)):
        label = np.minimum(label, np.where(near, label[None, :], len(y)).min(1))
    found = np.array([got[i].n_links for i in range(len(y))])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()
    assert [got[i].component_id for i in range(len(y))] == label.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in (85, 500, 501, 502, 503))


def _linked(y, threshold=0.95):
    y = y.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    return (y @ y.T >= threshold) & ~np.eye(len(y), dtype=bool)


def test_grid_recall(spark):
    """A grid of which a vector visits a part only, on vectors with noise along a few directions, against brute force."""
    from modcall.llm.embedding_dedup import Grid, embedding_links, unit

    rng = np.random.default_rng(6)
    base = rng.standard_normal((1500, 32)) * np.linspace(2, 0.5, 32)
    noise = np.zeros((1500, 32))
    noise[:, :6] = 0.55 * rng.standard_normal((1500, 6))
    x = np.concatenate([base, base + noise]).astype(np.float32)
    near = _linked(x)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert 2 * near.sum() > len(x) // 4 and Grid(unit(x.astype(float)), 32, 0.95, 0.999).visits < 32**2 // 2
    got = {r.vec_id: r.n_links for r in embedding_links(rows, k=32).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.98 * near.sum()


def test_one_id_with_several_vectors(spark):
    """Each row has the links of its own vector; an empty table gives an empty one."""
    from modcall.llm.embedding_dedup import embedding_links

    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a), (1, b), (2, [1.0, 0.1, 0.0]), (3, [1.0, 0.0, 0.1]), (4, [0.1, 1.0, 0.0]), (0, [0.0, 0.0, 1.0]), (0, [0.0, 0.05, 1.0]), (None, a)]
    got = sorted((r.vec_id or -1, r.embedding, r.n_links, r.component_id, r.kept) for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    want = {(1, tuple(a)): (3, 1, True), (1, tuple(b)): (1, 1, True), (2, (1.0, 0.1, 0.0)): (3, 1, False), (3, (1.0, 0.0, 0.1)): (3, 1, False), (4, (0.1, 1.0, 0.0)): (1, 1, False)}
    for i, v, *rest in got:
        if i > 0:
            assert tuple(rest) == want[i, tuple(v)], (i, v)
    zero = [r for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("vec_id = 0").collect()]
    assert [(r.n_links, r.component_id, r.kept) for r in zero] == [(1, 0, True)] * 2
    assert embedding_links(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_lengths_and_large_cells(spark):
    """Vectors of many lengths, and one cell with more members than a piece holds."""
    from modcall.llm import embedding_dedup
    from modcall.llm.embedding_dedup import embedding_links

    rows = [(100 * d + i, [float(i == 2)] * (d - 1) + [1.0 + i % 2]) for d in (1, 2, 5) for i in range(3)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {100: (2, 100), 101: (2, 100), 102: (2, 100), 200: (1, 200), 201: (1, 200), 202: (0, 202), 500: (1, 500), 501: (1, 500), 502: (0, 502)}
    rng = np.random.default_rng(2)
    x = (np.ones((embedding_dedup.PIECE + 300, 8)) + 0.3 * rng.standard_normal((embedding_dedup.PIECE + 300, 8))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embedding_links(rows, k=1).collect()}
    assert [got[i] for i in range(len(x))] == _linked(x).sum(1).tolist()


def test_warc(spark, tmp_path):
    from modcall.llm.warc import read_warc, read_warc_chunks, write_warc

    big = "Zeile ä\r\n\r\nWARC/1.0\r\n" * 5000
    rows = [(1, "u", "<p>a</p>"), (2, "u\r\nX: y", "<p>a</p>"), (3, None, None), (4, "v", ""), (5, "w", big), (6, "w", big), (6, "w", big), (7, "z", "once"), (None, "n", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = spark.createDataFrame(write_warc(pages, f"file://{tmp_path}/w", 0, 1000).collect())
    got = sorted(((r.page_id is None, r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_warc(files).collect())
    best = {"<p>a</p>": 2, "": 4, big: 6, "once": 7}
    want, used = [], set()
    for i, _, h in rows:
        data = (h or "").encode()
        top = best[h or ""] == i and i not in used
        used |= {i} if top else set()
        want.append(((i is None, i or 0), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if top else "revisit", None if top else best[h or ""]))
    assert sorted(want, key=str) == sorted(got, key=str)
    chunks = sorted((r.chunk, r.data) for r in read_warc_chunks(files, 1000).where("page_id = 6").collect())
    assert b"".join(d for _, d in chunks) == big.encode() and max(len(d) for _, d in chunks) <= 1000
    assert write_warc(pages.limit(0), f"file://{tmp_path}/e").count() == 0


def _archive(size, step=1 << 20):
    """One record of `size` zeros in a gzip member."""
    import io
    import zlib

    out, zipped = io.BytesIO(), zlib.compressobj(9, zlib.DEFLATED, 31)
    out.write(zipped.compress(f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {size}\r\n\r\n".encode()))
    for _ in range(size // step):
        out.write(zipped.compress(bytes(step)))
    out.write(zipped.compress(b"\r\n\r\n") + zipped.flush())
    return out.getvalue()


def test_compressible_payloads_are_read_in_bounded_memory():
    import io
    import time
    import tracemalloc

    from modcall.llm.warc import CHUNK, warc_records

    two = _archive(200 << 20) + _archive(3 << 20)
    began, sizes = time.time(), []
    tracemalloc.start()
    for _, pieces in warc_records(io.BytesIO(two)):
        sizes.append(0)
        for part in pieces:
            assert len(part) <= CHUNK
            sizes[-1] += len(part)
    assert sizes == [200 << 20, 3 << 20] and tracemalloc.get_traced_memory()[1] < 64 << 20 and time.time() - began < 30
    tracemalloc.stop()


def test_cut_archives_are_an_error():
    import io

    import pytest

    from modcall.llm.warc import warc_records

    whole = _archive(3 << 20)
    for cut in (30, len(whole) // 2, len(whole) - 12):
        with pytest.raises(ValueError, match="ends inside|does not end"):
            for _, pieces in warc_records(io.BytesIO(whole[:cut])):
                for _ in pieces:
                    pass


def test_long_pages_and_other_columns(spark, tmp_path):
    """Payloads of megabytes, and columns called like those made inside, through the registered query."""
    from pyspark.sql import functions as F

    from modcall.llm.warc import op4_warc

    rows = [(1, "u", "ä" * 3_000_000), (2, "v", "ä" * 3_000_000), (3, None, "x" * 2_500_001), (4, "w", None)]
    extra = {c: F.lit("x") for c in ("row", "chunk", "data", "carried", "copies", "best", "bucket", "file", "payload_bytes")}
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(extra).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in op4_warc(spark, str(tmp_path)).collect())
    assert got == [(1, 6_000_000, "revisit", 2), (2, 6_000_000, "response", None), (3, 2_500_001, "response", None), (4, 0, "response", None)]


def test_clashing_names(spark):
    """Columns called like those that operators make inside pass unchanged."""
    from modcall.llm.line_dedup import dedup_lines
    from modcall.llm.simhash import drop_similar, simhash_components
    from modcall.llm.substring_dedup import dedup_substrings

    names = ["__row", "row", "__drop", "__bucket", "__kind", "__body", "__k", "__ID", "rep", "v"]
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate([text, text, "other", None])], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for made in (dedup_lines(docs), dedup_substrings(docs), simhash_components(docs, 3, 2), drop_similar(docs)):
        rows = made.collect()
        assert len(rows) >= 3 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
