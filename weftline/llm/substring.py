"""Repeated passages of documents, exact or with small changes, by collinear chaining.

Seeds are 5-word k-mers picked by winnowing: of any 20 consecutive k-mers of a document the one of the smallest hash, so
two documents with 24 words in common share a seed. A seed's source is the document of the smallest id;
every other document's occurrence of the seed is matched with its places there, and, where this gives no passage, with the
document of the next smaller id, so matches are linear in the documents however often a passage occurs. The matches of a document with one source are chained: the best sum of ordered matches, less a cost
for the words between them, found with prefix maxima in a Fenwick tree. The words of a chain are then aligned with those of
its source, within its gaps and beyond its ends, and what is long and similar enough is a repeated passage. As a seed's first
document may have only a part of a passage that two later ones share, all runs of as many words as a passage has at least
are compared too, where all their seeds are shared; these give the exact passages that the chains miss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._shared import FILTER_BITS, filter_of, lean, perhaps_listed, release, runs_of, small_batches, unused, written
from weftline.llm._text import LOWER, NOT_SPACE, column_bytes, row_ranges, shingle_hashes, span_hashes, word_spans

K, WINDOW = 5, 20
#: Texts that share a seed meet the next in groups of about so many where there are more of them.
GROUP = 500
#: Distance, in k-mers, of the two k-mers beside a seed that are looked at too.
BESIDE = 12
#: Words of a passage at least, and the Jaccard similarity of its 5-word shingles to those of its source.
LEAST, SIMILAR = 50, 0.75
#: Cost of each word between two matches, in either document; a match is worth its K words, so 50 words in both end a chain.
GAP = 0.05
#: Columns of a passage between its first mention and the result.
STRETCH = ["id", "h", "start", "n_words", "source", "source_start", "source_words", "similarity"]
#: Cells of the table that an alignment holds at most; larger ones are cut in halves.
CELLS = 1 << 20
#: In an alignment a word that differs costs as much as so many that agree gain.
EDIT = 5


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and hashes of the words [^\\x20\\x09-\\x0D]+, A-Z lower-cased."""
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets, NOT_SPACE)
    return starts, ends, rows, span_hashes(low, starts, ends)


def winnow(hashes: np.ndarray, rows: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash of each window of consecutive k-mers of a row (the last of equals); a row with fewer has one window."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    end = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
    begin = np.repeat(first, np.diff(np.r_[first, n]))
    at = np.arange(n)
    best, value = at.copy(), hashes.copy()
    # places that stay their window's smallest, the windows starting at each place; those beyond the row's end don't count
    for j in range(1, window):
        other = np.minimum(at + j, n - 1)
        better = (at + j < end) & (hashes[other] <= value)
        best = np.where(better, other, best)
        value = np.where(better, hashes[other], value)
    whole = (at + window <= end) | (at == begin)
    return np.unique(best[whole])


def _thinned(some: np.ndarray, kmers: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of seeds without those inside a run of equal seeds at equal distances of WINDOW k-mers at most (alignment from its
    ends passes over the run), and how many of the places that are left have an equal seed before them in their row."""
    order = np.lexsort((some, kmers, of))
    at, key, row = some[order], kmers[order], of[order]
    again = np.zeros(len(at), bool)
    again[1:] = (key[1:] == key[:-1]) & (row[1:] == row[:-1])
    inside = np.zeros(len(at), bool)
    step = np.diff(at)
    inside[1:-1] = again[1:-1] & again[2:] & (step[1:] == step[:-1]) & (step[1:] <= WINDOW)
    at, again = at[~inside], again[~inside]
    back = np.argsort(at, kind="stable")
    number = np.arange(len(at))
    return at[back], (number - np.maximum.accumulate(np.where(again, 0, number)))[back]


def _beside(kmers: np.ndarray, of: np.ndarray, some: np.ndarray, away: int = BESIDE) -> np.ndarray:
    """For places of k-mers: 32 bits of the k-mer `away` before it and of that after it in its row, 0 where the row has none."""
    half = []
    for at in (some - away, some + away):
        inside = np.clip(at, 0, len(of) - 1)
        half.append(np.where((at == inside) & (of[inside] == of[some]), kmers[inside] >> np.uint64(32), np.uint64(0)))
    return (half[0] << np.uint64(32) | half[1]).view(np.int64)


def seeds(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(seed, id, h, at, nth, beside): the seeds of each text with words at k-mer `at`; nth: how often the text has the seed before;
    beside: bits of the k-mers around it. Of a line that is repeated on and on only the seeds at its ends are given."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            for low, high in row_ranges(offsets, 1 << 20):
                _, _, rows, hashes = words_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                kmers, of = shingle_hashes(hashes, rows, k)
                if not len(kmers):
                    continue
                place = np.arange(len(of)) - np.searchsorted(of, of)
                some = winnow(kmers, of)
                some, nth = _thinned(some, kmers[some], of[some])
                part = pa.array(of[some] + low)
                yield pa.RecordBatch.from_arrays([pa.array(kmers[some].view(np.int64)), batch.column(0).take(part), batch.column(1).take(part), pa.array(place[some], pa.int32()), pa.array(nth, pa.int32()), pa.array(_beside(kmers, of, some))], ["seed", "id", "h", "at", "nth", "beside"])

    keyed = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"seed long, id {kind}, h long, at int, nth int, beside long")


def chain(x: np.ndarray, y: np.ndarray, k: int = K, gap: float = GAP) -> list[np.ndarray]:
    """Chains of matches (x, y), the best first: index arrays in ascending x and y. Every match is in one chain at most.

    f(i) = k + max(0, max over j with x_j < x_i and y_j < y_i of f(j) - gap * ((x_i - x_j) + (y_i - y_j))); as the cost is a
    difference of sums, the inner maximum is a prefix maximum over y of f(j) + gap * (x_j + y_j).
    """
    n = len(x)
    if n == 1 or ((np.diff(x) > 0).all() and (np.diff(y) > 0).all() and gap * (np.diff(x) + np.diff(y)).max() < k):
        return [np.arange(n)]
    order = np.lexsort((-y, x))
    ranks = np.searchsorted(np.unique(y), y) + 1
    size = int(ranks.max())
    tree, owner = [-np.inf] * (size + 1), [-1] * (size + 1)
    score, back = np.zeros(n), np.full(n, -1)
    for i in order.tolist():
        at, best, whose = int(ranks[i]) - 1, -np.inf, -1
        while at:
            if tree[at] > best:
                best, whose = tree[at], owner[at]
            at &= at - 1
        linked = best - gap * float(x[i] + y[i])
        score[i] = k + max(0.0, linked)
        # equal x can't precede: they come in falling y, so none of them is below
        back[i] = whose if linked > 0 else -1
        at, value = int(ranks[i]), score[i] + gap * float(x[i] + y[i])
        while at <= size:
            if value > tree[at]:
                tree[at], owner[at] = value, i
            at += at & -at
    out, used = [], np.zeros(n, bool)
    for i in np.argsort(-score, kind="stable").tolist():
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = int(back[i])
        if path:
            out.append(np.array(path[::-1]))
    return out


def _costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fewest insertions, deletions and changes from a to each beginning of b."""
    step = np.arange(len(b) + 1)
    line = step.astype(np.int32)
    for i in range(1, len(a) + 1):
        best = np.empty(len(b) + 1, np.int32)
        best[0] = i
        best[1:] = np.minimum(line[1:] + 1, line[:-1] + (b != a[i - 1]))
        line = (np.minimum.accumulate(best - step) + step).astype(np.int32)
    return line


def align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start in a, start in b, length) of equal words in an alignment of the fewest insertions, deletions and changes."""
    n, m = len(a), len(b)
    k = min(n, m)
    unequal = np.flatnonzero(a[:k] != b[:k])
    head = int(unequal[0]) if len(unequal) else k
    unequal = np.flatnonzero(a[n - k + head :][::-1] != b[m - k + head :][::-1])
    tail = int(unequal[0]) if len(unequal) else k - head
    # what both begin and end with is in some best alignment
    ends = [r for r in ((0, 0, head), (n - tail, m - tail, tail)) if r[2]]
    a, b = a[head : n - tail], b[head : m - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return ends
    if n * m > CELLS and n > 1:  # halves that meet where the costs of both add up to the least: the same cost in bounded memory
        half = n // 2
        at = int((_costs(a[:half], b) + _costs(a[half:][::-1], b[::-1])[::-1]).argmin())
        inner = align(a[:half], b[:at]) + [(i + half, j + at, k) for i, j, k in align(a[half:], b[at:])]
        return sorted([*ends, *((i + head, j + head, k) for i, j, k in inner)])
    lines = np.zeros((n + 1, m + 1), np.int32)
    lines[0] = np.arange(m + 1)
    step = np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.empty(m + 1, np.int32)
        best[0] = i
        best[1:] = np.minimum(lines[i - 1, 1:] + 1, lines[i - 1, :-1] + (b != a[i - 1]))
        lines[i] = np.minimum.accumulate(best - step) + step
    runs: list[tuple[int, int, int]] = []
    i, j = n, m
    while i and j:
        if a[i - 1] == b[j - 1] and lines[i, j] == lines[i - 1, j - 1]:
            i, j = i - 1, j - 1
            if runs and runs[-1][0] == i + 1 and runs[-1][1] == j + 1:
                runs[-1] = (i, j, runs[-1][2] + 1)
            else:
                runs.append((i, j, 1))
        elif lines[i, j] == lines[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
        elif lines[i, j] == lines[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return sorted([*ends, *((i + head, j + head, k) for i, j, k in runs)])


def _joined(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for a, b, n in runs:
        if out and out[-1][0] + out[-1][2] == a and out[-1][1] + out[-1][2] == b:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        elif n:
            out.append((a, b, n))
    return out


def _beyond(a: np.ndarray, b: np.ndarray, reach: int = 24) -> list[tuple[int, int, int]]:
    """Equal words from the beginnings of a and b on; a single change, insertion or deletion followed by 4 equal words is passed."""
    runs, i, j = [], 0, 0
    while True:
        n = min(len(a) - i, len(b) - j)
        if n <= 0:
            return runs
        unequal = np.flatnonzero(a[i : i + n] != b[j : j + n])
        same = int(unequal[0]) if len(unequal) else n
        if same:
            runs.append((i, j, same))
        i, j = i + same, j + same
        for p, q in ((1, 1), (1, 0), (0, 1)):
            if i + p + 4 <= len(a) and j + q + 4 <= len(b) and (a[i + p : i + p + 4] == b[j + q : j + q + 4]).all():
                i, j = i + p, j + q
                break
        else:
            return runs


def _apart(one: tuple[int, int, int], other: tuple[int, int, int]) -> int:
    """Words between two runs, in the text that has more of them."""
    return max(other[0] - one[0] - one[2], other[1] - one[1] - one[2])


def _similarity(a: np.ndarray, b: np.ndarray, k: int) -> float:
    x, y = (np.unique(shingle_hashes(w, np.zeros(len(w), np.int64), k)[0]) for w in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def passages(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int = K, least: int = LEAST, similar: float = SIMILAR) -> list[tuple[int, int, int, int, float]]:
    """Aligns a chain of matches (x, y) of words a and b: (start in a, words, start in b, words, similarity) of its passages."""
    runs: list[tuple[int, int, int]] = []
    head = _beyond(a[: x[0]][::-1], b[: y[0]][::-1])
    runs += [(int(x[0]) - i - n, int(y[0]) - j - n, n) for i, j, n in reversed(head)]
    for s, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        p, q = (int(x[s - 1]) + k, int(y[s - 1]) + k) if s else (i, j)
        over = max(p - i, q - j, 0)  # matches may overlap
        if over < k:
            if s and i + over > p or j + over > q:
                runs += [(u + p, v + q, n) for u, v, n in align(a[p : i + over], b[q : j + over])]
            runs.append((i + over, j + over, k - over))
    p, q = int(x[-1]) + k, int(y[-1]) + k
    runs += [(u + p, v + q, n) for u, v, n in _beyond(a[p:], b[q:])]
    runs = _joined(runs)
    out: list[tuple[int, int, int, int, float]] = []
    todo = [runs]
    while todo:
        waiting = todo.pop()
        # a stretch in which the words that agree outweigh those that differ; what follows it is a stretch of its own
        group, score = waiting[:1], waiting[0][2]
        for run in waiting[1:]:
            lost = EDIT * _apart(group[-1], run)
            if score <= lost:
                break
            group.append(run)
            score += run[2] - lost
        while len(group) > 1 and group[-1][2] < EDIT * _apart(*group[-2:]):
            group.pop()
        if len(group) < len(waiting):
            todo.append(waiting[len(group) :])
        for part in (group, *([r] for r in group if len(group) > 1)):
            i, j, (u, v, n) = part[0][0], part[0][1], part[-1]
            if u + n - i >= least:
                found = 1.0 if len(part) == 1 else _similarity(a[i : u + n], b[j : v + n], k)
                if found >= similar:
                    out.append((i, u + n - i, j, v + n - j, found))
                    if part is group:
                        break
    return out


def chains(matches: DataFrame, kind: str) -> DataFrame:
    """(id, h, source, source_h, xs, ys): all chains of matches of a text with a source in one row, but for chains without a match that is `near`
    (has an equal k-mer at the same distance before or after it, too): these can't be as long as a passage is, unless words beside
    all of their matches are changed. Alignment decides on the others."""
    schema = f"id {kind}, h long, source {kind}, source_h long, xs array<array<int>>, ys array<array<int>>"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            got = [list(x) for x in zip(*rows, strict=True)]
            rows.clear()
            kinds = [None, pa.int64(), None, pa.int64(), *[pa.list_(pa.list_(pa.int32()))] * 2]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(got, kinds, strict=True)], ["id", "h", "source", "source_h", "xs", "ys"])

        for own in runs_of(batches, ["id", "h", "source", "source_h"]):
            x, y, near = np.unique(np.stack([own[c].to_numpy().astype(np.int64) for c in ("at", "source_at", "near")], axis=1), axis=0).T
            if not near.any():
                continue
            key = [own[c][0].as_py() for c in ("id", "h", "source", "source_h")]
            own_chains = [c for c in chain(x, y) if near[c].any()]
            rows.append((*key, *([c[links].astype(np.int32) for links in own_chains] for c in (x, y))))
            if len(rows) >= 2000:
                yield out()
        if rows:
            yield out()

    dealt = matches.select("id", "h", "source", "source_h", "at", "source_at", "near").repartition("id", "h").sortWithinPartitions("id", "h", "source", "source_h", "at", "source_at")
    return dealt.mapInArrow(run, schema)


def exact_stretches(df: DataFrame, matches: DataFrame, aligned: DataFrame, id_col: str, text: str, least: int) -> DataFrame:
    """(id, h, start, n_words, source, source_start, source_words, similarity): the words of each text in runs of `least` words that a
    text of a smaller id has word for word, whichever it is: each run meets the smallest id that has all of it, so a text that
    has only a part of it hides nothing. Runs inside the aligned passages need no look, nor do those with a seed that isn't in matches."""
    kind = df.schema[id_col].dataType.simpleString()
    windows = least - K - WINDOW + 2
    # a run with a word outside a passage has no seed that lies `least` words inside; of repeated seeds not all are listed
    whole_text = (F.col("start") == 0) & (F.col("n_words") == F.col("total"))
    span = F.struct(F.when(whole_text, 0).otherwise(F.col("start") + least).alias("low"), F.when(whole_text, 2**40).otherwise(F.col("start") + F.col("n_words") - least - K).alias("high"))
    spans = aligned.groupBy("id", "h").agg(F.collect_set(span).alias("spans"))
    covered = F.exists("spans", lambda x: (F.col("at") >= x["low"]) & ((x["high"] == 2**40) | (F.col("first") & (F.col("at") <= x["high"]))))
    open_ = matches.select("id", "h", "seed", "at", "first").distinct().join(spans.hint("merge"), ["id", "h"], "left").where(~F.coalesce(covered, F.lit(False)))
    asked = filter_of(open_.select(F.col("h").bitwiseXOR(F.col("seed")).alias("key")), "key")

    # only texts with such a seed are looked through for runs, and only texts with a seed that two texts have can hold one of these
    with_open = filter_of(open_.select("h"), "h")
    with_shared = filter_of(matches.select("h").unionByName(matches.select(F.col("source_h").alias("h"))), "h")

    def listed(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        place = keys & np.uint64(FILTER_BITS - 1)
        return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def some_of(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(listed(bits, batch.column(1).to_numpy().view(np.uint64))))

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of words, words, places of runs, hashes of runs) of the texts that are long enough."""
        data, offsets = column_bytes(batch.column(2))
        for low, high in row_ranges(offsets, 1 << 20):
            _, _, rows, words = words_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            enough = (np.bincount(rows, minlength=high - low) >= max(least, K))[rows]
            rows, words = rows[enough], words[enough]
            if len(words):
                yield rows + low, words, np.flatnonzero(rows[: len(rows) - least + 1] == rows[least - 1 :]), shingle_hashes(words, rows, least)[0]

    @lean
    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_of(batches, with_open):
            texts = batch.column(1).to_numpy().view(np.uint64)
            for rows, words, whole, runs in parts(batch):
                n = len(words)
                if windows > 0:
                    smallest = np.full(n + WINDOW, 2**64 - 1, np.uint64)
                    smallest[np.flatnonzero(rows[: n - K + 1] == rows[K - 1 :])] = shingle_hashes(words, rows, K)[0]
                    picked = smallest[:n].copy()
                    for j in range(1, WINDOW):
                        np.minimum(picked, smallest[j : j + n], out=picked)
                    count = np.r_[0, np.cumsum(listed(asked, picked ^ texts[rows]), dtype=np.int64)]
                    some = count[whole + windows] - count[whole] == windows
                    whole, runs = whole[some], runs[some]
                at = whole - np.searchsorted(rows, rows)[whole]
                part = pa.array(rows[whole])
                yield pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), batch.column(0).take(part), batch.column(1).take(part), pa.array(at, pa.int32())], ["run", "id", "h", "at"])

    keyed = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    asking = written(keyed.mapInArrow(wanted, f"run long, id {kind}, h long, at int"), "asking-runs")
    inside = aligned.groupBy("id", "h").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n_words") - least).alias("end"))).alias("spans"))
    held = F.exists("spans", lambda x: F.col("at").between(x["start"], x["end"]))
    asking = asking.join(inside.hint("merge"), ["id", "h"], "left").where(~F.coalesce(held, F.lit(False))).select("run")
    with small_batches(df.sparkSession):
        looked_for = filter_of(asking, "run")

    @lean
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_of(batches, with_shared):
            for rows, _, whole, runs in parts(batch):
                some = listed(looked_for, runs)
                first, whole, runs = np.searchsorted(rows, rows), whole[some], runs[some]
                of, place = rows[whole], whole - first[whole]
                order = np.lexsort((place, runs, of))
                again = np.zeros(len(order), bool)
                again[order[1:]] = (runs[order][1:] == runs[order][:-1]) & (of[order][1:] == of[order][:-1])
                part = pa.array(of)
                yield pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), batch.column(0).take(part), batch.column(1).take(part), pa.array(place, pa.int32()), pa.array(~again)], ["run", "id", "h", "at", "first"])

    @lean
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs_of(batches, ["id", "h", "source", "source_h"]):
            x, y, first = (own[c].to_numpy() for c in ("at", "source_at", "first"))
            order = np.argsort(x, kind="stable")
            x, y, first = x[order].astype(np.int64), y[order].astype(np.int64), first[order]
            # a run that the text has before goes with the stretch that it touches; others begin a new one off their diagonal
            latest = np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
            off = np.r_[True, first[1:] & ((x - y)[1:] != (x - y)[latest[:-1]])]
            cut = np.flatnonzero(off | np.r_[True, np.diff(x) > least])
            last = np.r_[cut[1:], len(x)] - 1
            n = pa.array(x[last] - x[cut] + least)
            begin = np.minimum.reduceat(y, cut)
            source_n = pa.array(np.maximum.reduceat(y, cut) - begin + least)
            key = own.slice(0, 1).combine_chunks()
            repeat = lambda c: key[c].take(pa.array(np.zeros(len(cut), np.int64))).combine_chunks()
            yield pa.RecordBatch.from_arrays([repeat("id"), repeat("h"), pa.array(x[cut]), n, repeat("source"), pa.array(begin), source_n, pa.array(np.ones(len(cut)))], STRETCH)

    found = written(keyed.mapInArrow(grams, f"run long, id {kind}, h long, at int, first boolean"), "runs")
    of = F.when(F.col("first"), F.col("id"))
    source = found.groupBy("run").agg(F.min("id").alias("source"), F.max("id").alias("last"), F.min_by("at", of).alias("source_at"), F.min_by("h", of).alias("source_h")).where("source < last").drop("last")
    matches = found.join(source.hint("merge"), "run").where("id <> source").select("id", "h", "source", "source_h", "at", "source_at", "first")
    dealt = matches.repartition("id", "h").sortWithinPartitions("id", "h", "source", "source_h", "at")
    out = written(dealt.mapInArrow(joined, f"id {kind}, h long, start long, n_words long, source {kind}, source_start long, source_words long, similarity double"), "stretches")
    release(found)
    return out


def _outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligned passages, and those exact stretches of a text that lie in no passage of it."""
    for own in runs_of(batches, ["id", "h"]):
        start, n, exact = (own[c].to_numpy() for c in ("start", "n_words", "exact"))
        # the longest exact stretches first, so that each is held against all that could hold it
        keep = ~exact
        begins, ends = start[keep], (start + n)[keep]
        for i in sorted(np.flatnonzero(exact).tolist(), key=lambda i: (-n[i], start[i])):
            if not ((begins <= start[i]) & (ends >= start[i] + n[i])).any():
                keep[i] = True
                begins, ends = np.r_[begins, start[i]], np.r_[ends, start[i] + n[i]]
        yield from own.filter(pa.array(keep)).select(STRETCH).combine_chunks().to_batches()


def aligned_passages(df: DataFrame, matches: DataFrame, id_col: str, text: str, least: int, similar: float) -> DataFrame:
    """(id, h, start, n_words, source, source_start, source_words, similarity, total): the passages that aligning the chains of matches gives;
    total: words of the text."""
    kind = df.schema[id_col].dataType.simpleString()
    linked = written(chains(matches, kind), "chains")
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.xxhash64(text).alias("j"), F.col(text).alias("t"))
    keys = written(linked.select("id", "h").unionByName(linked.select(F.col("source").alias("id"), F.col("source_h").alias("h"))).distinct(), "chained")
    texts = perhaps_listed(texts, F.col("j"), keys, "h")
    texts = written(texts.join(keys.hint("merge"), (F.col("i") == F.col("id")) & (F.col("j") == F.col("h")), "left_semi").groupBy("i", "j").agg(F.first("t").alias("t")), "chained-texts")
    release(keys)
    own = linked.join(texts.select(F.col("i").alias("id"), F.col("j").alias("h"), F.col("t").alias("a")).hint("merge"), ["id", "h"])
    both = own.join(texts.select(F.col("i").alias("source"), F.col("j").alias("source_h"), F.col("t").alias("b")).hint("merge"), ["source", "source_h"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
            for at, end in row_ranges(np.r_[0, np.cumsum(sizes)], 1 << 20, 256):
                part = batch.slice(at, end - at)
                words = []
                for c in ("a", "b"):
                    data, offsets = column_bytes(part.column(c))
                    _, _, rows, hashes = words_of(data, offsets)
                    edge = np.searchsorted(rows, np.arange(len(part) + 1))
                    words.append([hashes[p:q] for p, q in zip(edge[:-1], edge[1:], strict=True)])
                place, rest = [], []
                for r in range(len(part)):
                    pair = set()
                    for x, y in zip(*(part.column(c)[r].as_py() for c in ("xs", "ys")), strict=True):
                        pair.update(passages(words[0][r], words[1][r], np.array(x), np.array(y), K, least, similar))
                    reached = -1
                    # those that lie in another passage of the same pair say nothing new
                    for p in sorted(pair, key=lambda p: (p[0], -p[1], -p[4], p[2])):
                        if p[0] + p[1] > reached:
                            reached = p[0] + p[1]
                            place.append(r)
                            rest.append((*p, len(words[0][r])))
                take = pa.array(place, pa.int64())
                columns = [pa.array([p[j] for p in rest], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("h").take(take), *columns[:2], part.column("source").take(take), *columns[2:]], [*STRETCH, "total"])

    schema = f"id {kind}, h long, start long, n_words long, source {kind}, source_start long, source_words long, similarity double"
    aligned = written(both.select("id", "h", "source", "xs", "ys", "a", "b").mapInArrow(run, schema + ", total long"), "aligned")
    release(linked, texts)
    return aligned


def with_predecessors(matches: DataFrame, aligned: DataFrame) -> DataFrame:
    """The seeds of matches that lie in no aligned passage of their text, matched with another such place of the seed: that in the text of
    the next smaller id. So texts meet that share a passage whose seeds have first places elsewhere. A seed of very many texts is
    dealt to groups, in each of which it meets that of the next smaller id."""
    spans = aligned.groupBy("id", "h").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n_words") - K).alias("end"))).alias("spans"))
    inside = F.exists("spans", lambda x: F.col("at").between(x["start"], x["end"]))
    rows = matches.where("first").select("seed", "id", "h", "at", "beside").join(spans.hint("merge"), ["id", "h"], "left").where(~F.coalesce(inside, F.lit(False))).drop("spans")
    rows = written(rows, "uncovered")
    shared = rows.groupBy("seed").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("seed", "n")
    group = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / GROUP))
    before = Window.partitionBy("seed", "group").orderBy("id", "h", "at")
    met = rows.join(shared.hint("merge"), "seed").withColumn("group", group)
    met = met.select("seed", "id", "h", "at", "beside", *(F.lag(c).over(before).alias(n) for c, n in (("id", "source"), ("h", "source_h"), ("at", "source_at"), ("beside", "source_beside"))))
    return met.where("source <> id").select("id", "h", "at", "source", "source_h", "source_at", _near().alias("near"))


def _near():
    """Whether a k-mer beside a seed is equal in both places."""
    halves = (lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1))), (lambda c: F.shiftrightunsigned(F.col(c), 32))
    return F.greatest(*((half("beside") != 0) & (half("beside") == half("source_beside")) for half in halves))


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """The passages of documents that repeat one of a document with a smaller id: id_col, text_hash (xxhash64 of the text),
    start and n_words (the passage's words, counted from 0), source_id, source_start, source_words, similarity.

    A passage has `least` words or more, and the 5-word shingles of it and of its source have a Jaccard similarity of `similar` or
    more. Each run of `least` words that is word for word in a document of a smaller id lies in a listed passage.
    The first document of a passage is not listed. Rows with a null id or without words take no part; rows of one
    id are never compared with each other, and repeated rows give the passage once. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    found = written(seeds(df, id_col, text), "seeds")
    # all tables here grow with the input: merge joins keep the plan the same at every size
    source = found.groupBy("seed").agg(F.min("id").alias("source"), F.max("id").alias("last"))
    source = written(source.where("source < last").drop("last"), "seed-sources")
    shared = written(perhaps_listed(found, F.col("seed"), source, "seed").join(source.hint("merge"), "seed"), "shared-seeds")
    release(found, source)
    # a seed meets its first place in its source, and its n-th place the n-th one there: no product of the places in both
    place = F.min(F.when((F.col("id") == F.col("source")) & (F.col("nth") == 0), F.struct("h", "at", "beside")))
    first = written(shared.groupBy("seed").agg(place.alias("p")).select("seed", *(F.col(f"p.{c}").alias(f"source_{c}") for c in ("h", "at", "beside"))), "seed-places")
    again = shared.where("nth > 0 AND id = source").join(first.select("seed", "source_h").hint("merge"), "seed").where("h = source_h")
    again = again.select("seed", "nth", "source_h", F.col("at").alias("source_at"), F.col("beside").alias("source_beside"))
    own = shared.where("id <> source")
    met = own.join(first.hint("merge"), "seed").unionByName(own.where("nth > 0").join(again.hint("merge"), ["seed", "nth"]))
    matches = written(met.select("seed", "id", "h", "at", (F.col("nth") == 0).alias("first"), "beside", "source", "source_h", "source_at", _near().alias("near")), "matches")
    release(shared, first)
    first = aligned_passages(df, matches, id_col, text, least, similar)
    again = written(with_predecessors(matches, first), "matches")
    aligned = first.unionByName(aligned_passages(df, again, id_col, text, least, similar))
    release(again)
    schema = f"id {kind}, h long, start long, n_words long, source {kind}, source_start long, source_words long, similarity double"
    exact = exact_stretches(df, matches, aligned, id_col, text, least)
    release(matches)
    aligned = aligned.drop("total")
    every = aligned.withColumn("exact", F.lit(False)).unionByName(exact.withColumn("exact", F.lit(True)))
    out = every.repartition("id", "h").sortWithinPartitions("id", "h").mapInArrow(lean(_outer), schema)
    return out.select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), "start", "n_words", F.col("source").alias("source_id"), "source_start", "source_words", "similarity").distinct()


def without_passages(df: DataFrame, id_col: str = "doc_id", text: str = "text", n_chars: str | None = None, **options) -> DataFrame:
    """The rows of df, with all their columns, without the words of their repeated passages: each passage stays in the document of
    the smallest id that has it. What is left of a text keeps its own white space; rows that lose all their words go.
    n_chars: a column that then gets the length of the text that is left."""
    found = repeated_passages(df, id_col, text, **options).groupBy(id_col, "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "n_words"))).alias("spans"))
    columns = df.columns
    i, h, spans = (unused(columns, c) for c in ("i", "h", "spans"))
    found = written(found.select(F.col(id_col).alias(i), F.col("text_hash").alias(h), F.col("spans").alias(spans)), "passages")
    at = columns.index(text)
    rows = df.join(found, (df[id_col] == found[i]) & (F.xxhash64(df[text]) == found[h]), "left").select(*(df[c] for c in columns), found[spans])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(len(columns))
            some = [i for i in range(len(batch)) if found[i].is_valid]
            texts, keep = {}, np.ones(len(batch), bool)
            for i in some:
                value = batch.column(at)[i].as_py()
                raw = value.encode()
                starts, ends, _, _ = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                gone = np.zeros(len(starts), bool)
                for s in found[i].as_py():
                    gone[s["start"] : s["start"] + s["n_words"]] = True
                if gone.all():
                    keep[i] = False
                    continue
                # each word goes with the white space after it
                after = np.r_[starts[1:], len(raw)]
                texts[i] = raw[: starts[0]].decode() + b"".join(raw[p:q] for p, q in zip(starts[~gone].tolist(), after[~gone].tolist(), strict=True)).decode("utf-8", "replace")
            out = batch.select(columns)
            if texts:
                changed = [texts.get(i, v) for i, v in enumerate(batch.column(at).to_pylist())]
                out = out.set_column(at, batch.schema.field(at), pa.array(changed, batch.schema.field(at).type))
            yield out.filter(pa.array(keep))

    out = rows.mapInArrow(run, df.schema)
    return out if n_chars is None else out.withColumn(n_chars, F.length(text).cast(df.schema[n_chars].dataType))
