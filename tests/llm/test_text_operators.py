"""Operators on documents against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import bpe, decontaminate, langid, minhash, quality, substring, tokencounts, tokenstore
from weftline.llm._text import NOT_SPACE, shingle_hashes, span_hashes, word_spans

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
DOC = "doc_id long, text string, ids string, component_id string, block string"


@pytest.fixture(scope="module")
def tiktoken_encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def sentence(rng, n):
    return " ".join("".join(rng.choice(["tha", "re", "in", "Ou", "éa", "x"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(60, 160)) for _ in range(8)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20, base[0]), (21, base[0]), (21, base[0]), (22, re.sub("[a-z]", lambda m: m[0].upper(), base[1]))]
    w = base[2].split()
    for k in range(4):
        v = list(w)
        v[10 * k + 5] = "changed"
        out.append((30 + k, " ".join(v)))
    out += [(40, sentence(rng, 30) + " " + " ".join(base[3].split()[:55]) + " " + sentence(rng, 40)), (50, None), (51, ""), (52, " \n\t "), (53, "one two"), (54, "one two"), (None, base[5]), (None, "lost words only here"), (60, "a " * 30_000), (61, "don't I'll we've  x\n\n y 's <|endoftext|> ²½ 漢字 🙂")]
    return out


def shared_words(a, b, least=50, k=5, similar=0.75):
    """Brute force: whether words a, b have in common a passage of `least` words, the 5-word shingles of which are similar."""
    grams = lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return len(grams(a) & grams(b)) >= similar * len(grams(a) | grams(b)) and min(len(a), len(b)) >= least


@pytest.mark.parametrize("changes", [0, 1, 2])
def test_passages_whose_parts_lie_in_smaller_documents(spark, changes):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows, want = [], {}
    for t in range(150):
        passage = [word() for _ in range(75)]
        other = list(passage)
        for c in range(changes):
            other[20 + 33 * c] = word()
        around = lambda n: [word() for _ in range(n)]
        thirds = [passage[25 * j : 25 * j + 25] + around(8) for j in (2, 1, 0)]
        assert shared_words(passage, other)
        rows += [(3 * t, " ".join(sum(thirds, []))), (3 * t + 1, " ".join(around(13) + passage + around(9))), (3 * t + 2, " ".join(around(30) + other + around(5)))]
        want[3 * t + 2] = set(range(30, 105))
    found = {}
    for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
        assert r["doc_id"] in want and r["source_id"] == r["doc_id"] - 1 and r["n_words"] <= 80
    caught = sum(len(found.get(d, set()) & words) >= 70 for d, words in want.items())
    assert caught == 150 if not changes else caught >= 149


@pytest.mark.parametrize("cells", [4, 1 << 20])
def test_alignments_cost_least(monkeypatch, cells):
    monkeypatch.setattr(substring, "CELLS", cells)
    rng = random.Random(1)

    def fewest(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, line[0] = line[:], i
            for j, y in enumerate(b, 1):
                line[j] = min(last[j] + 1, line[j - 1] + 1, last[j - 1] + (x != y))
        return line[-1]

    for _ in range(800):
        a = [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        b = list(a) if rng.random() < 0.5 else [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        if b:
            b[rng.randrange(len(b))] = 9
        i = j = cost = 0
        for u, v, n in [*substring.align(np.array(a, np.int64), np.array(b, np.int64)), (len(a), len(b), 0)]:
            assert u >= i and v >= j and a[u : u + n] == b[v : v + n]
            cost += max(u - i, v - j)
            i, j = u + n, v + n
        assert cost == fewest(a, b)


def test_lines_that_repeat_on_and_on(spark):
    rng = random.Random(12)
    line, tail = sentence(rng, 7), sentence(rng, 20)
    rows = [(1, " ".join([line] * 900 + [tail])), (2, " ".join([tail] + [line] * 700)), (3, " ".join([line] * 9 + [sentence(rng, 30)])), (4, " ".join([line] * 5))]
    got = {}
    n = 0
    for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        n += 1
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
    size = len(line.split())
    assert set(got) == {2, 3} and len(got[2]) >= 700 * size and len(got[3]) >= 9 * size and n < 12


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", None) for i, t in rows], DOC)


def by_text(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_bpe_as_tiktoken(docs, rows, tiktoken_encoding):
    out = bpe.encode(docs, RANKS, decoded="decoded")
    assert out.columns == ["doc_id", "text", "component_id", "block", "ids", "decoded"]
    want = sorted(((i, tiktoken_encoding.encode_ordinary(t or ""), bytearray((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in out.collect()), key=repr) == want
    again = bpe.decode(out.drop("decoded"), RANKS)
    assert by_text(again, "doc_id", "decoded") == by_text(out, "doc_id", "decoded")
    digest = out.where("doc_id = 53").select(bpe.ids_digest().alias("d")).head()["d"]
    assert digest == hashlib.sha256(",".join(map(str, tiktoken_encoding.encode_ordinary("one two"))).encode()).hexdigest()
    assert bpe.encode(docs.limit(0), RANKS).count() == 0


def test_merge_replay_on_odd_texts(tiktoken_encoding):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc '\n\t1.,sdtlrevem  éß漢²🙂́\x1c　") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["".join(chr(x) if not 0xD800 <= x < 0xE000 else "x" for x in (rng.randrange(0x110000) for _ in range(12))) for _ in range(200)]
    texts += ["".join(rng.choice(["ab", "aa", "b", "the", "ha", " "]) for _ in range(50)) for _ in range(300)] + ["a" * 5000, " " * 700, "ha" * 900]
    cache = bpe.WordCache(bpe.MergeReplay(bpe.read_ranks(RANKS)).encode_words)
    got = []
    for _, e in bpe.encode_blocks(iter([pa.array(texts)]), cache, block=4096, chunk=1000):
        got += [e.ids[a:b].tolist() for a, b in zip(e.offsets[:-1], e.offsets[1:], strict=True)]
    assert got == [tiktoken_encoding.encode_ordinary(t) for t in texts]


def test_invalid_utf8_is_replaced():
    data = np.frombuffer(b"ab\xff c", np.uint8)
    assert bpe.valid_utf8(data, np.array([0, 3, 5]))[2] == "ab� c"


def test_short_rows_have_one_shingle():
    data = np.frombuffer(b"a b c d e f g a b", np.uint8)
    at = np.array([0, 13, 17])
    s, e, r = word_spans(data, at, NOT_SPACE)
    h, of = shingle_hashes(span_hashes(data, s, e), r, 5)
    assert of.tolist() == [0, 0, 0, 1]


def test_contamination(spark, docs, rows):
    items = [("a", " ".join(rows[3][1].split()[5:40])), ("b", "ONE, two"), ("b", None), (None, "changed"), ("c", "..."), ("d", rows[0][1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        if i is not None and t is not None and (w := word.findall(lower(t))):
            k = min(13, len(w))
            for at in range(len(w) - k + 1):
                windows.setdefault(tuple(w[at : at + k]), set()).add(i)
    want = []
    for i, t in rows:
        w, hit, found = word.findall(lower(t)), set(), set()
        for k in {len(x) for x in windows}:
            for at in range(len(w) - k + 1):
                if own := windows.get(tuple(w[at : at + k])):
                    hit |= set(range(at, at + k))
                    found |= own
        want.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    columns = ["doc_id", "n_words", "n_hit", "items", "contaminated"]
    assert by_text(decontaminate.contamination(docs, bench), *columns) == sorted(want, key=repr)
    small, decontaminate.PART_BYTES = decontaminate.PART_BYTES, 300  # several parts
    try:
        assert by_text(decontaminate.contamination(docs, bench), *columns) == sorted(want, key=repr)
    finally:
        decontaminate.PART_BYTES = small
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((x[0] for x in want if not x[4]), key=repr)
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "the quick very brown fox"), (2, "brown dog and the quick"), (3, "fox")], "doc_id long, text string")
    from weftline.llm._text import column_bytes

    words = decontaminate.words_of(*column_bytes(pa.array(["quick brown fox"])))[0]
    index = decontaminate.build_index(docs)
    hits = lambda slop: {r["id"] for r in decontaminate.search(index, decontaminate.Phrases(["a"], words, np.array([0, len(words)])), slop).collect() if r["items"]}
    assert hits(0) == set() and hits(1) == {1}


def similar_components(rows):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((d, len(sets[i]), least, d == least))
    return out


def test_near_duplicates(docs, rows):
    got = by_text(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(similar_components(rows), key=repr)
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, _, k in similar_components(rows) if k and i is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert {i for i in ids if i is not None} == want and ids.count(None) <= 2 and len(ids) == len(set(ids)) + max(ids.count(None) - 1, 0)


@pytest.mark.parametrize("block", [4, 256])
def test_near_duplicates_of_a_family(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(8)
    lines = [sentence(rng, 12) for _ in range(14)]  # texts of common lines only have no shingle of their own
    words = sentence(rng, 90).split()
    some = [" ".join(lines[j] for j in sorted(rng.sample(range(14), 11))) for _ in range(70)]
    for _ in range(90):
        own = list(words)
        for j in range(rng.randint(1, 3)):
            own[rng.randrange(90)] = f"n{rng.randrange(40)}" if j % 2 else "same"
        some.append(" ".join(own))
    rows = [(1000 - 3 * i, t) for i, t in enumerate(some)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_text(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(similar_components(rows), key=repr)
    assert 10 < found.select("component_id").distinct().count() < 140


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b, both = np.unique(pool[:2000]), np.unique(pool[500:2500]), np.unique(pool[:2500])
    sketch = minhash.SetSketch()
    ra, rb, rab = (sketch.sketch(x, np.zeros(len(x), np.int64), 1) for x in (a, b, both))
    assert (sketch.merge(ra, rb) == rab).all()
    likely, doubt = sketch.similarity(ra, rb, np.array([2000.0]), np.array([2000.0]), 0.75)
    assert abs(likely[0] - 0.6) < 0.12 and doubt[0] > 0


def test_repeated_passages(spark, docs, rows):
    found = substring.repeated_passages(docs)
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
    assert {20, 21, 22, 30, 31, 32, 33, 40} <= set(got) and not {0, 1, 2, 3, 4, 50, 51, 52, 53, 54, 61, None} & set(got)
    assert set(range(30, 85)) <= got[40] and len(got[40]) < 65
    cut = substring.without_passages(docs.withColumn("n_chars", F.length("text").cast("long")), n_chars="n_chars")
    left = {r["doc_id"]: r for r in cut.collect()}
    assert {20, 21, 22}.isdisjoint(left) and left[0]["text"] == rows[0][1]
    assert len(words_of(left[40]["text"])) < 75 and left[40]["n_chars"] == len(left[40]["text"])
    assert substring.repeated_passages(docs.limit(0)).count() == 0


def test_chains_and_alignment():
    x, y = np.array([0, 10, 20, 30, 300]), np.array([5, 15, 900, 35, 305])
    assert [c.tolist() for c in substring.chain(x, y)][0] == [0, 1, 3]
    assert substring.align(np.array([1, 2, 3, 4, 5]), np.array([1, 3, 4, 5])) == [(0, 0, 1), (2, 1, 3)]


@pytest.mark.parametrize(("first", "between", "second"), [(200, 30, 60), (200, 30, 140), (200, 20, 90), (200, 11, 54), (60, 40, 200), (120, 10, 50)])
def test_two_passages_of_one_source(first, between, second):
    rng = np.random.default_rng(first + between)
    one, two, x, y = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (first, second, between, between))
    at = np.array([0, 40, first + between + 10, first + between + 40])
    found = substring.passages(np.r_[one, x, two], np.r_[one, y, two], at, at)
    got = {w for p in found for w in range(p[0], p[0] + p[1])}
    assert got >= {*range(first), *range(first + between, first + between + second)}


@pytest.mark.parametrize(("times", "words"), [(6, 10), (8, 10), (15, 6), (20, 5)])
def test_passages_of_repeated_lines(spark, times, words):
    rng = random.Random(times)
    word = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    out, begins = [], {}
    for k in range(12):
        line = word(words)
        for i in (2 * k, 2 * k + 1):
            begins[i] = rng.randint(30, 60)
            # the line also stands alone before the passage in the source
            before = word(begins[i]) if i % 2 else line + " " + word(begins[i])
            out.append((i, " ".join([before, *[line] * times, word(40)])))
    got = {}
    for r in substring.repeated_passages(spark.createDataFrame(out, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
    for i in range(1, 24, 2):
        assert set(range(begins[i], begins[i] + times * words)) <= got[i]


def test_one_seed_is_enough(spark):
    rng = random.Random(2)
    word = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    out = []
    for k in range(200):
        shared = word(51).split()
        out.append((2 * k, " ".join([word(30), *shared, word(30)])))
        shared[13] = word(1)
        out.append((2 * k + 1, " ".join([word(30), *shared, word(30)])))
    found = substring.repeated_passages(spark.createDataFrame(out, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == set(range(1, 400, 2))


def test_passages_whose_parts_lie_in_earlier_documents(spark):
    rng = random.Random(7)
    word = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    out = []
    for k in range(20):
        shared = word(rng.choice([50, 60, 75, 95]))
        half = len(shared) // 2
        cuts = [shared[:half], shared[half:], shared, shared]
        out += [(4 * k + j, [*word(rng.randint(0, 40)), *part, *word(rng.randint(0, 40))]) for j, part in enumerate(cuts)]
    wanted, seen = {}, set()
    for i, w in out:
        own = [" ".join(w[j : j + 50]) for j in range(len(w) - 49)]
        wanted[i] = {j + d for j, r in enumerate(own) if r in seen for d in range(50)}
        seen.update(own)
    got = {}
    for r in substring.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in out], "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
    assert all(got.get(i, set()) >= w for i, w in wanted.items())
    assert {i for i, w in wanted.items() if w} == set(got) == set(range(3, 80, 4))


def test_token_files(spark, docs, rows, tmp_path):
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    files = tokenstore.write_tokens(docs, path, end_id=2, folder=f"file://{tmp_path}/t", file_bytes=2000)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], list(r["ids"])) for r in tokenstore.read_tokens(files, ids=True).collect()), key=lambda r: r[1])
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for (i, t), g in zip(ordered, got, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert g == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    assert tokenstore.read_tokens(tokenstore.write_tokens(docs.limit(0), path, 2)).count() == 0


def test_added_tokens_in_texts(spark, rows, tmp_path):
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x", None, "<|endoftext|><|endoftext|> y\n", *[t for _, t in rows], "<|endoftext| >", "end <|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for end in (2, None):
        files = tokenstore.write_tokens(df, path, end_id=end, folder=f"file://{tmp_path}/{end}", file_bytes=2000, added_tokens=True)
        got = {r["doc_id"]: list(r["ids"]) for r in tokenstore.read_tokens(files, ids=True).collect()}
        assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [end] * (end is not None) for i, t in enumerate(texts)}
    assert 50256 in got[0]


def test_only_asked_frames_are_read(tmp_path):
    name = tmp_path / "x"
    with open(name, "wb") as f:
        w = tokenstore.TokenFileWriter(f, frame=64)
        w.add(pa.array([7, None, 9]), np.arange(100), np.array([40, 0, 60]))
        w.close()
    with open(name, "rb") as f:
        r = tokenstore.TokenFile(f)
        assert r.read(2).tolist() == list(range(40, 100)) and r.read(1).tolist() == [] and r.frames_read == 5
        assert r.index["id"].to_pylist() == [7, None, 9]
    raw = bytearray(name.read_bytes())
    import zstandard

    assert zstandard.ZstdDecompressor().decompressobj().decompress(bytes(raw)) == np.arange(16, dtype="<u4").tobytes()
    raw[-23] ^= 1  # the last frame's checksum
    name.write_bytes(raw)
    with open(name, "rb") as f, pytest.raises(ValueError, match="damaged"):
        list(tokenstore.TokenFile(f).pieces())


def test_token_counts(docs, rows, tiktoken_encoding):
    out = tokencounts.count_lines(docs, RANKS)
    for r in out.collect():
        assert r["n_tokens"] == len(tiktoken_encoding.encode_ordinary(r["text"] or "")) == sum(r["section_tokens"])
        assert len(r["section_tokens"]) == len(re.findall(r"[^\n]*\n|[^\n]+", r["text"] or ""))
    ends, sections = np.array([2, 5, 9]), np.array([3, 3, 7, 9])
    assert tokencounts.allocate(ends, sections, "start")[0].tolist() == [2, 0, 1, 0]
    assert tokencounts.allocate(ends, sections, "end")[0].tolist() == [1, 0, 1, 1]
    assert tokencounts.allocate(ends, sections, "majority")[0].tolist() == [1, 0, 2, 0]
    assert tokencounts.allocate(ends, sections, "split")[0].tolist() == pytest.approx([1 + 1 / 3, 0, 2 / 3 + 0.5, 0.5])
    with pytest.raises(ValueError, match="rule"):
        tokencounts.allocate(ends, sections, "x")


def test_language(spark):
    rng = random.Random(3)
    kinds = {"aa": ["ba", "do", "ki"], "bb": ["lu", "sté", "gri"]}
    make = lambda k: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 4))) for _ in range(30))
    train = spark.createDataFrame([(make(k), k) for k in kinds for _ in range(40)] + [(None, "aa"), ("ba", None)], "text string, lang string")
    model = langid.train(train)
    test = spark.createDataFrame([(i, make("aa" if i % 2 else "bb"), 1) for i in range(40)] + [(100, None, 1), (101, "123 !", 1), (102, "", 1), (103, "漢字", 1)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in langid.identify(test, model).collect()}
    assert all(got[i]["lang_pred"] == ("aa" if i % 2 else "bb") and 0.5 < got[i]["score"] <= 1 for i in range(40))
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[103]["lang_pred"] in kinds
    nothing = langid.identify(test, langid.train(train.limit(0)))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(300):
        text = sentence(rng, rng.randint(20, 80))
        toxic, poor = i % 10 == 0, i % 10 == 1
        docs.append((i, text + " vile" if toxic else re.sub(r"(\w+)", r"\1###", text) if poor else text))
        if i % 3 and i > 5:
            labels.append((i, 0 if poor else 1, int(toxic)))
    df = spark.createDataFrame([*docs, (400, None), (401, "")], "doc_id long, text string")
    ratings = spark.createDataFrame([*labels, (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.select(df, ratings).collect()}
    held = [i for i in range(300) if not i % 3]
    assert sum(got[i]["kept"] == (i % 10 > 1) for i in held) >= 0.95 * len(held)
    assert all(r["p_good"] <= r["p_harmless"] for r in got.values()) and len(got) == 302
    assert quality.select(df, ratings.limit(0)).where("kept").count() == 302


def test_rare_language_is_learnt(spark):
    common = spark.range(20_000).selectExpr("concat('tha rein ou ', id, ' inthe rathe') AS text", "'aa' AS lang")
    rare = spark.range(20).selectExpr("concat('lusté grilu ', id, ' stégri lulu') AS text", "'bb' AS lang")
    model = langid.train(common.unionByName(rare), sample_rows=400)
    assert model.languages == ["aa", "bb"]
    got = langid.identify(rare, model).where("lang_pred = 'bb'").count()
    assert got == 20
    rates = langid.sample_rates({"a": 10_000_000, "b": 300, "c": 5}, 20_000)
    assert rates["b"] == rates["c"] == 1 and 19_000 < rates["a"] * 10_000_000 + 305 <= 20_000
