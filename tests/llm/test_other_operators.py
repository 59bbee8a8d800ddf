import base64
import hashlib
import io

import numpy as np
import pytest

from weftline.llm import embeddings, graph, warc
from weftline.llm.embeddings import hadamard


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (7, None)]
    root = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    linked = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(hadamard(hadamard(x)), x)


def test_near_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(30, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 3] + 0.05 * rng.normal(size=24)).tolist()) for i in range(60)]
    rows += [(200, rows[4][1]), (201, rows[4][1]), (201, rows[4][1]), (202, [3 * x for x in rows[4][1]])]
    rows += [(300, None), (301, [0.0] * 24), (302, [float("nan")] * 24), (303, [None] * 24), (304, []), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (None, rows[5][1]), (None, [float("inf")] * 24)]
    fine = [(k, np.array(v, np.float32).astype(float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: [j for j, w in fine if j != k and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95] for k, v in fine}
    want = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        want.append((i, len(links.get(k, [])), least, i == least))
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, node int, n_links int")
    block, embeddings.BLOCK = embeddings.BLOCK, 16  # so that buckets have several blocks
    try:
        got = [tuple(r) for r in embeddings.near_duplicates(df).collect()]
    finally:
        embeddings.BLOCK = block
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_buckets():
    rng = np.random.default_rng(2)
    a = embeddings.unit(rng.normal(size=(400, 64)))
    g = rng.normal(size=(400, 64))
    g -= (g * a).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * embeddings.unit(g)
    for n in (100, 50_000, 10**7):
        x, y = (embeddings.buckets(v, *embeddings.tables_for(n, 64)) for v in (a, b))
        assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= 0.99


PAGE = "page_id long, url string, html string, sha string, first int"


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", "<p>é</p>"), (4, "u", None), (5, "u", ""), (6, "u", "x" * 3_000), (7, "u", "long\r\n" * 60_000), (7, "u", "long\r\n" * 60_000), (None, "u", "lost"), (None, "u", "x" * 3_000)]
    df = spark.createDataFrame([(*p, "s", 1) for p in pages], PAGE)
    files = warc.write_archives(df, folder=f"file://{tmp_path}/w", file_bytes=5_000)
    got = sorted(((r["row_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.records(files, size=1000).collect()), key=repr)
    top = {}
    for i, _, h in pages:
        top[h or ""] = max([x for x in (top.get(h or ""), i) if x is not None], default=None)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        again = top[h or ""] is not None and i != top[h or ""]
        want.append((None if i is None else str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", str(top[h or ""]) if again else None))
    assert got == sorted(want, key=repr)
    parts = warc.chunks(files, size=1000, payload=True).where("row_id = '6'").orderBy("chunk").collect()
    assert [p["n_bytes"] for p in parts] == [1000, 1000, 1000] and parts[0]["digest"] == base64.b32encode(hashlib.sha1(b"x" * 1000).digest()).decode()
    assert [p["last"] for p in parts] == [False, False, True] and b"".join(p["payload"] for p in parts) == b"x" * 3000
    assert warc.records(warc.write_archives(df.limit(0))).count() == 0
    assert warc.records(warc.write_archives(df, least=10_000)).where("record_type = 'revisit'").count() == 0


def test_plain_and_cut_archives():
    out = io.BytesIO()
    warc.WarcWriter(out).add([("WARC-Type", "resource")], [b"abc"])
    raw = out.getvalue()
    import gzip

    for data in (raw, gzip.decompress(raw)):
        (c,) = warc.read_chunks(io.BytesIO(data))
        assert c.payload == b"abc" and c.last and c.headers["warc-type"] == "resource"
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_chunks(io.BytesIO(raw[:-20])))


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "contamination", "tokens"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert 0 < len(ids) == len(set(ids)) < 200
