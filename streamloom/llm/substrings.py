"""Repeated substrings of ``LENGTH`` bytes, by a hash-compared suffix sort.

A byte goes if a string of LENGTH bytes that covers it also starts earlier. The
windows (strings of that length) are dealt out by their minimizer, the least
hash among their ``GRAM``-byte substrings: equal windows have equal minimizers,
at equal offsets. Consecutive windows with one minimizer form a stretch.

1. Exact copies of documents are found by digest. The later ones go whole.
2. Chunks of documents count their minimizers; only those that occur twice in
   the corpus matter from here on.
3. Their stretches meet by minimizer. Windows of one minimizer and offset are
   suffixes of the stretches' joint text; they are put in order by a mergesort
   that compares two suffixes through prefix polynomial hashes, finding the common
   extension by binary search. Neighbours that agree over LENGTH bytes are
   compared byte by byte against hash collisions; all but a class's earliest go.

A minimizer with more than ``MOST`` stretches isn't put into one task: its
windows are exchanged as rows by a 128-bit hash, the earliest of each chunk
alone, with their bytes, and all but the first with the same bytes go as they
pass in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import pieces
from .kit import BYTE_B, MULT_B, Prefix, blocks, expand, mix, tune, utf8

LENGTH, GRAM = 100, 24
MOST = 6_000
#: Bytes of texts in a chunk, about.
CHUNK_BYTES = 16 << 20
#: Bytes of stretches that are sorted together.
SORTED_BYTES = 1 << 20
#: A place is a byte of a text, with the text's number among those of its doc_id above these bits.
ROW_BITS = 32


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours (van Herk's blocks)."""
    n = len(x)
    size = -(-n // w) * w
    full = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, w)
    left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(rows, axis=1).ravel()
    m = n - w + 1
    return np.minimum(left[:m], right[w - 1 : w - 1 + m])


def stretches(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, minimizer's place, its hash) of the stretches, in bytes of ``data``."""
    span = Prefix(data)
    rows, first, count, place, hashes = [], [], [], [], []
    low = np.uint64((1 << 24) - 1)
    n = len(data) - LENGTH + 1
    if n > 0 and len(data) < 1 << 24:
        at = np.arange(len(data) - GRAM + 1)
        h = mix(span(at, at + GRAM))
        best = sliding_min((h & ~low) | at.astype(np.uint64), LENGTH - GRAM + 1)  # ties go to the left
        where = (best & low).astype(np.int64)
        row = np.searchsorted(offs, np.arange(n), "right") - 1
        inside = np.arange(n) + LENGTH <= offs[row + 1]
        change = np.ones(n, bool)
        change[1:] = (where[1:] != where[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
        s = np.flatnonzero(change & inside)
        alive = np.append(np.flatnonzero(change | ~inside), n)
        e = alive[np.searchsorted(alive, s, "right")]
        return row[s], s, e - s, where[s], h[where[s]]
    for i in range(len(offs) - 1):  # one very long text: piece by piece, each with LENGTH - 1 bytes of the next
        for a in range(int(offs[i]), max(int(offs[i]), int(offs[i + 1]) - LENGTH + 1), 1 << 23):
            b = min(int(offs[i + 1]), a + (1 << 23) + LENGTH - 1)
            _, s, c, p, h = stretches(data[a:b], np.array([0, b - a]))
            rows.append(np.full(len(s), i))
            first.append(s + a)
            count.append(c)
            place.append(p + a)
            hashes.append(h)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([*x, none if k < 4 else none.astype(np.uint64)]) for k, x in enumerate((rows, first, count, place, hashes)))


class Suffixes:
    """Places in a text, ordered within groups by the LENGTH bytes that begin there."""

    def __init__(self, text: np.ndarray):
        self.text, self.hash = text, Prefix(text)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes, up to LENGTH, the suffixes have in common: the largest n with equal hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hash(a, a + mid) == self.hash(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, equal: bool) -> np.ndarray:
        """Whether a's bytes come before b's (``equal``: or are the same)."""
        n = self.extension(a, b)
        tie = n >= LENGTH
        last = len(self.text) - 1
        return np.where(tie, equal, self.text[np.minimum(a + n, last)] < self.text[np.minimum(b + n, last)])

    def sort(self, place: np.ndarray, group: np.ndarray) -> np.ndarray:
        """A stable order by group, and by content within each, from merges of runs that double in length."""
        order = np.argsort(group, kind="stable")
        g = group[order]
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(g)))
        begin, total = np.repeat(start, size), np.repeat(size, size)
        width = 1
        while True:
            on = np.flatnonzero(total > width)
            if not on.size:
                return order
            inside = on - begin[on]
            run = inside // width
            right = run % 2 == 1
            other = begin[on] + np.where(right, run - 1, run + 1) * width  # the sibling run
            length = np.clip(begin[on] + total[on] - other, 0, width)
            low, high = np.zeros(len(on), np.int64), length.copy()
            mine = place[order[on]]
            while True:
                open_ = np.flatnonzero(low < high)
                if not open_.size:
                    break
                mid = (low[open_] + high[open_]) // 2
                theirs = place[order[other[open_] + mid]]
                is_right = right[open_]
                less = np.empty(len(open_), bool)
                less[is_right] = self.before(theirs[is_right], mine[open_][is_right], True)
                less[~is_right] = self.before(theirs[~is_right], mine[open_][~is_right], False)
                low[open_] = np.where(less, mid + 1, low[open_])
                high[open_] = np.where(less, high[open_], mid)
            pair = np.where(right, other, begin[on] + run * width)
            to = pair + (inside - run * width) + low
            new = order.copy()
            new[to] = order[on]
            order = new
            width *= 2


def fresh(*columns: np.ndarray) -> np.ndarray:
    """Where a row of the sorted columns differs from the row before it."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def repeated(new: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which members of classes go, in the order of class, document and place (``new``: the first of a class): those of a later document than the class's first, and all but the first of a row. Rows of one document don't count as repeats of each other."""
    if not len(new):
        return np.zeros(0, bool)
    first = doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    return (doc != first) | ~(new | fresh(doc, start >> ROW_BITS))


def twins(left: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's text among the distinct texts of its doc_id, and whether the row is the same again."""
    ids, mark = left.column("doc_id").to_numpy(), left.column("mark").to_numpy()
    order = np.lexsort((mark, ids))
    head, step = fresh(ids[order]), fresh(ids[order], mark[order])
    at = np.cumsum(step)
    number, again = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    number[order] = at - np.maximum.accumulate(np.where(head, at, 0))
    again[order] = ~step
    return number, again


def repeats(text: np.ndarray, first: np.ndarray, windows: np.ndarray, key: np.ndarray, doc: np.ndarray, start: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Whether each window of the stretches equals an earlier one. Stretch i begins at ``first[i]`` in the text, with windows at document places ``start[i]``, ...; ``offset`` is its minimizer's distance from there."""
    size = windows + LENGTH - 1
    out = np.zeros(int(windows.sum()), bool)
    ends = np.cumsum(windows)
    # equal stretches: all windows of all that an earlier one stands before repeat
    digest = mix(Prefix(text, BYTE_B, MULT_B)(first, first + size) + (size * 128 + offset).astype(np.uint64))
    order = np.lexsort((start, doc, digest, key))
    same = np.zeros(len(order), bool)
    same[1:] = (key[order[1:]] == key[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]]) & (size[order[1:]] == size[order[:-1]])
    for i in np.flatnonzero(same):  # byte by byte, against collisions
        a, b = order[i], order[i - 1]
        same[i] = np.array_equal(text[first[a] : first[a] + size[a]], text[first[b] : first[b] + size[b]])
    same = repeated(~same, doc[order], start[order])
    out[expand(ends[order[same]] - windows[order[same]], windows[order[same]])] = True
    kept = np.sort(order[~same])
    _, back, number = np.unique(key[kept], return_inverse=True, return_counts=True)
    kept = kept[number[back] > 1]
    if not len(kept):
        return out
    n = windows[kept]
    window = expand(ends[kept] - n, n)
    step = window - np.repeat(ends[kept] - n, n)
    place = np.repeat(first[kept], n) + step
    at_doc, at_start = np.repeat(doc[kept], n), np.repeat(start[kept], n) + step
    group = np.repeat(back[number[back] > 1] * 128 + offset[kept], n) - step
    s = Suffixes(text)
    order = s.sort(place, group)
    a, b = order[:-1], order[1:]
    equal = np.zeros(len(order), bool)
    near = np.flatnonzero(group[a] == group[b])
    near = near[s.extension(place[a[near]], place[b[near]]) >= LENGTH]
    for i in range(0, len(near), 20_000):
        x = near[i : i + 20_000]
        equal[x + 1] = (text[place[a[x]][:, None] + np.arange(LENGTH)] == text[place[b[x]][:, None] + np.arange(LENGTH)]).all(1)
    klass = np.cumsum(~equal)
    rank = np.lexsort((at_start[order], at_doc[order], klass))
    later = repeated(fresh(klass[rank]), at_doc[order[rank]], at_start[order[rank]])
    out[window[order[rank[later]]]] = True
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whether the windows at a and b are the same byte by byte, where it is asked."""
    out = np.zeros(len(a), bool)
    on = np.flatnonzero(asked)
    for i in range(0, len(on), 20_000):
        x = on[i : i + 20_000]
        out[x] = (data[a[x][:, None] + np.arange(LENGTH)] == data[b[x][:, None] + np.arange(LENGTH)]).all(1)
    return out


def cuts(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Pieces of the bytes, as binaries."""
    ends = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[expand(start, size)].tobytes())])


def runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[False], mark, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def chunked(docs: DataFrame) -> tuple[DataFrame, int]:
    """The documents dealt into chunks of about CHUNK_BYTES, as many as there are input splits at least, and the number of chunks. The rows of one doc_id lie in one chunk."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-size // CHUNK_BYTES), docs.rdd.getNumPartitions())
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).withColumn("mark", F.xxhash64("doc_id", "text")), n


#: A row is a stretch (windows and text), one window of a frequent minimizer (h and two are its hash), or a run that is known to go.
ROW = "h long, two long, doc_id long, start long, windows int, offset int, text binary, kind int"
STRETCH, ONE, GONE = 0, 1, 2


def repeated_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The chunked documents, with the number of chunks last, and (doc_id, start, windows) of runs of windows that stand earlier too; for an exact copy start is null and windows the row's mark."""
    rows, n = chunked(docs)
    slim = rows.select("doc_id", "mark", F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").alias("size")).where(F.col("size") >= LENGTH)
    first = slim.groupBy("digest", "size").agg(F.min("doc_id").alias("first"))
    copies = slim.join(first, ["digest", "size"]).where(F.col("doc_id") > F.col("first")).select("doc_id", "mark")
    dealt = rows.repartitionById(n, F.col("chunk"))
    marks = chunked_like(copies, n)

    def originals(left: pa.Table, right: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        number, again = twins(left)
        gone = np.unique(right.column("own").to_numpy())
        left = left.append_column("base", pa.array(number << ROW_BITS)).filter(pa.array(~(again | np.isin(left.column("mark").to_numpy(), gone))))
        for batch in left.combine_chunks().to_batches():
            for part, data, offs in blocks(batch):
                ids, base = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("doc_id", "base"))
                yield ids, base, data, offs

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.uint64)]
        for _, _, data, offs in originals(left, right):
            found.append(stretches(data, offs)[4])
        keys, number = np.unique(np.concatenate(found), return_counts=True)
        chunk = left.column("chunk")[0].as_py() if left.num_rows else 0
        return pa.table({"h": keys.view(np.int64), "chunk": np.full(len(keys), chunk, np.int32), "n": number})

    seen = dealt.groupBy("chunk").cogroup(marks.groupBy("to")).applyInArrow(lambda a, b: count(a, b), "h long, chunk int, n long")
    # a minimizer has at most one row for each chunk here
    seen = seen.withColumn("all", F.sum("n").over(Window.partitionBy("h"))).where(F.col("all") > 1)
    wanted = seen.select(F.col("chunk").alias("to"), F.col("h").alias("own"), F.lit(True).alias("is_key"), (F.col("all") > MOST).alias("many"))
    both = wanted.union(marks.select("to", "own", F.lit(False), F.lit(False)))

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        keyed = right.column("is_key").to_numpy()
        values, many = right.column("own").to_numpy(), right.column("many").to_numpy()
        order = np.argsort(values[keyed].view(np.uint64))
        keys, often = values[keyed].view(np.uint64)[order], many[keyed][order]
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        texts: list[pa.Array] = []
        kinds: list[np.ndarray] = []
        places: list[tuple[np.ndarray, ...]] = []
        parts: list[np.ndarray] = []  # the texts that hold windows of frequent minimizers, one after another
        held = 0

        def add(kind: int, h: np.ndarray, two: np.ndarray, doc: np.ndarray, start: np.ndarray, windows: np.ndarray, offset: np.ndarray, text: pa.Array | None = None) -> None:
            for store, x in zip(out, (h.view(np.int64), two.view(np.int64), doc, start, windows.astype(np.int32), offset.astype(np.int32)), strict=True):
                store.append(x)
            texts.append(pa.nulls(len(h), pa.binary()) if text is None else text)
            kinds.append(np.full(len(h), kind, np.int32))

        for ids, base, data, offs in originals(left, pa.table({"own": values[~keyed]})):
            row, s, c, p, h = stretches(data, offs)
            at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            frequent = hit & often[at] if len(keys) else hit
            on, many_on = np.flatnonzero(hit & ~frequent), np.flatnonzero(frequent)
            for i in pieces(c[on] + LENGTH - 1, 1 << 28):  # a very long text has more bytes in its stretches than one array takes
                some = on[slice(*i)]
                add(STRETCH, h[some], np.zeros(len(some), np.int64), ids[row[some]], base[row[some]] + s[some] - offs[row[some]], c[some], p[some] - s[some], cuts(data, s[some], c[some] + LENGTH - 1))
            w = expand(s[many_on], c[many_on])
            one, two = mix(Prefix(data)(w, w + LENGTH)), mix(Prefix(data, BYTE_B, MULT_B)(w, w + LENGTH))
            own = np.repeat(row[many_on], c[many_on])
            places.append((one, two, ids[own], base[own] + w - offs[own], w + held))
            if len(w):
                parts.append(data)
                held += len(data)
        if held:
            one, two, doc, start, at = (np.concatenate(x) for x in zip(*places, strict=True))
            data = np.concatenate(parts)
            order = np.lexsort((start, doc, two, one))
            new = fresh(one[order], two[order])
            new[1:] |= ~same_bytes(data, at[order[1:]], at[order[:-1]], ~new[1:])
            again = repeated(new, doc[order], start[order])
            kept = order[~again]
            zero = np.zeros(len(kept), np.int64)
            for i in pieces(zero + LENGTH, 1 << 28):
                k = kept[slice(*i)]
                add(ONE, one[k], two[k], doc[k], start[k], zero[: len(k)] + 1, zero[: len(k)], cuts(data, at[k], zero[: len(k)] + LENGTH))
            later = order[again]
            later = later[np.lexsort((start[later], doc[later]))]
            head = np.ones(len(later), bool)
            head[1:] = (doc[later[1:]] != doc[later[:-1]]) | (start[later[1:]] != start[later[:-1]] + 1)
            first = np.flatnonzero(head)
            run = np.diff(np.append(first, len(later)))
            zero = np.zeros(len(first), np.int64)
            add(GONE, mix(doc[later[first]].view(np.uint64)), zero, doc[later[first]], start[later[first]], run, zero)
        columns = [pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(k)) for x, k in zip(out, (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32), strict=True)]
        return pa.table([*columns, pa.chunked_array(texts, pa.binary()), pa.array(np.concatenate([*kinds, np.zeros(0, np.int32)]))], names=["h", "two", "doc_id", "start", "windows", "offset", "text", "kind"])

    found = dealt.groupBy("chunk").cogroup(both.groupBy("to")).applyInArrow(lambda a, b: emit(a, b), ROW)
    return dealt, local_runs(found).union(copies.select("doc_id", F.lit(None).cast("long"), "mark")), n


def chunked_like(ids: DataFrame, n: int) -> DataFrame:
    return ids.select(F.col("mark").alias("own"), F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("to"))


def local_runs(found: DataFrame) -> DataFrame:
    """(doc_id, start, windows) of what goes. Minimizers' stretches lie side by side in a partition and are sorted a few groups at a time."""
    names = ["doc_id", "start", "windows"]

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.concat_batches(held)
        text, offs = utf8(t.column(6))
        h, doc, start, windows, offset = (t.column(i).to_numpy() for i in (0, 2, 3, 4, 5))
        windows = windows.astype(np.int64)
        gone = repeats(text, offs[:-1], windows, h.view(np.uint64), doc, start, offset.astype(np.int64))
        a, b = runs_in(gone, windows)
        owner = np.searchsorted(np.cumsum(windows), a, "right")
        inside = a - (np.cumsum(windows) - windows)[owner]
        return pa.RecordBatch.from_arrays([pa.array(doc[owner]), pa.array(start[owner] + inside), pa.array(b - a)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for whole in batches:
            kind = whole.column(7).to_numpy()
            gone = whole.filter(pa.array(kind == GONE))
            yield pa.RecordBatch.from_arrays([gone.column(2), gone.column(3), gone.column(4).cast(pa.int64())], names=names)
            single = whole.filter(pa.array(kind == ONE))
            if single.num_rows:  # in the order of hash, bytes, document and place, one at most of a row: all but those of the first document with these bytes go
                doc, start = (single.column(i).to_numpy() for i in (2, 3))
                text = utf8(single.column(6))[0].reshape(-1, LENGTH)
                new = np.append(True, (text[1:] != text[:-1]).any(1))
                first = doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
                if last is not None and (text[0] == last[0]).all():
                    first = np.where(np.cumsum(new) == 1, last[1], first)
                last = (text[-1].copy(), first[-1])
                later = doc != first
                yield pa.RecordBatch.from_arrays([pa.array(doc[later]), pa.array(start[later]), pa.array(np.ones(int(later.sum()), np.int64))], names=names)
            batch = whole.filter(pa.array(kind == STRETCH))
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            at = 0
            # a group is cut by no flush: flush at the last change of minimizer, once enough is held
            cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
            if held and held[-1].column(0)[-1].as_py() != h[0]:
                cuts = np.append(0, cuts)
            each = batch.nbytes / max(1, batch.num_rows)
            for c in cuts.tolist():
                if size + (c - at) * each >= SORTED_BYTES:
                    if c > at:
                        held.append(batch.slice(at, c - at))
                    if held:
                        yield flush(held)
                    held, size, at = [], 0, c
            if at < batch.num_rows:
                held.append(batch.slice(at))
                size += int((batch.num_rows - at) * each)
        if held:
            yield flush(held)

    window = F.when(F.col("kind") == ONE, F.col("text"))
    return found.repartition("h").sortWithinPartitions("h", "two", window, "doc_id", "start").mapInArrow(run, "doc_id long, start long, windows long")


def runs_in(mark: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marks, which also end where a piece of the given size ends."""
    if not len(mark):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.zeros(len(mark) + 1, bool)
    head[np.append(0, np.cumsum(sizes))] = True
    begin = mark & (np.append(True, ~mark[:-1]) | head[:-1])
    stop = mark & (np.append(~mark[1:], True) | head[1:])
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; with ``texts`` also the bytes that are left.

    Texts are UTF-8 bytes, null ones empty. Matches never cross documents; the
    earlier of two strings is that with the smaller doc_id, or in one document the
    earlier start. Texts under 100 bytes stay. Rows that repeat a doc_id count as
    one place in the order: none of them is earlier than the other, and each loses
    only what repeats an earlier document or itself. A null doc_id comes before all
    others. A very long text is gone through piece by piece. Further columns are not
    read; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    least = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").isNull().alias("none"))
    dealt, gone, n = repeated_runs(rows)
    gone = gone.select(F.col("doc_id").alias("own"), F.col("start").alias("from"), "windows", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("to"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own, start, windows = right.column("own").to_numpy(), right.column("from").fill_null(-1).to_numpy(), right.column("windows").to_numpy()
        copy = np.isin(left.column("mark").to_numpy(), windows[start < 0])
        order = np.lexsort((start, own))
        own, start, windows = own[order], start[order], windows[order]
        ids, none, number = left.column("doc_id").to_numpy(), left.column("none").to_pylist(), twins(left)[0]
        low, high = np.searchsorted(own, ids, "left"), np.searchsorted(own, ids, "right")
        out = []
        for i, text in enumerate(left.column("text").cast(pa.binary())):
            data = np.frombuffer(text.as_py(), np.uint8)
            edge = np.zeros(len(data) + 1, np.int64)
            a, b = low[i] + np.searchsorted(start[low[i] : high[i]], [number[i] << ROW_BITS, (number[i] + 1) << ROW_BITS])
            for s, w in zip((start[a:b] - (number[i] << ROW_BITS)).tolist(), windows[a:b].tolist(), strict=True):
                edge[s] += 1
                edge[s + w - 1 + LENGTH] -= 1
            mark = (np.cumsum(edge)[:-1] > 0) | copy[i]
            rest = data[~mark].tobytes()
            out.append((None if none[i] else int(ids[i]), len(data), int(mark.sum()), len(runs(mark)[0]), hashlib.sha256(rest).hexdigest(), *([rest] * texts)))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * texts]
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return dealt.groupBy("chunk").cogroup(gone.groupBy("to")).applyInArrow(lambda a, b: run(a, b), schema)
