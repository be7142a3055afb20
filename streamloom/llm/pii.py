"""Personal data: patterns, and a semi-Markov conditional random field beside them.

The patterns give the base spans. The field scores whole candidate spans by
features of the span (its shape, digits, separators, checks, neighbours), and a
dynamic program over spans of bounded length chooses boundaries and kinds
together. It learns from the base spans of a bounded sample, also in forms that
the patterns don't take (a telephone number without its plus and country, an
address with blanks around its @), and adds the spans that overlap no base span.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import blocks, numbered, tidy, tune

KINDS = ("email", "ip", "card", "phone")
# fixed patterns; possessive forms and the look-behind only save time, as no match can begin inside a run of digits
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' spans, by kind and start."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:  # an address has one @, so its first character is the first of the local characters before it
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > floor and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                floor = m.end()
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
ANCHOR = re.compile(r"[0-9]+|@")
#: Tokens in a span, characters in a span, and tokens on each side of a digit or @ that are looked at.
MOST, CHARS, REACH = 15, 64, 8
LABELS = ("other", *KINDS)
DIM = 1 << 14
#: Documents, and windows of these, from which the field learns, at most (longer windows are cut into ones of LONGEST tokens); passes and rates.
SAMPLE, WINDOWS, LONGEST, PASSES, RATE, DECAY = 4_000, 1_200, 60, 3, 0.2, 1e-4


def windows(text: str) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Tokens near digits and @, as runs of (start, end) that don't overlap."""
    low = high = -1
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - CHARS), m.end() + CHARS
        if low < 0:
            low, high = a, b
        elif a <= high:
            high = max(high, b)
        else:
            yield from cut(text, low, high)
            low, high = a, b
    if low >= 0:
        yield from cut(text, low, high)


def cut(text: str, low: int, high: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, low, min(high, len(text)))]
    hot = [i for i, (a, _) in enumerate(tokens) if text[a] == "@" or "0" <= text[a] <= "9"]
    i = 0
    while i < len(hot):
        j = i
        while j + 1 < len(hot) and hot[j + 1] - hot[j] <= REACH:
            j += 1
        yield low, tokens[max(0, hot[i] - REACH) : hot[j] + REACH + 1]
        i = j + 1


def shape(text: str) -> str:
    return re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "d", text))


def feature_ids(text: str, start: int, end: int) -> list[int] | None:
    """Features of the whole span, or None if no entity could be one."""
    span = text[start:end]
    d = digits_of(span)
    if len(span) < 5 or span[0] in " .,;:-)\n" or not span[-1].isalnum() or (len(d) < 4 and "@" not in span):
        return None
    before, after = text[start - 1 : start], text[end : end + 1]
    octets = re.split(r"\.", span)
    short = re.sub(r"d+", lambda m: f"d{min(len(m[0]), 5)}", shape(span))
    loose = re.sub(r"(.)\1+", r"\1", re.sub(r"d\d", "d", short))
    checks = 13 <= len(d) <= 19 and luhn(d)
    plain = set(span) <= set("0123456789 +().-")
    names = (
        "bias", f"len{min(len(span) // 4, 12)}", f"digits{min(len(d), 20)}", f"shape{short}", f"loose{loose}", f"luhn{checks}", f"at{span.count('@')}", f"dots{min(span.count('.'), 4)}",
        f"first{span[0] if not span[0].isalnum() else shape(span[0])}", f"octets{len(octets) == 4 and all(o.isdigit() and len(o) <= 3 and int(o) <= 255 for o in octets if o) and all(octets)}",
        f"before{before if not before.isalnum() else shape(before)}", f"after{after if not after.isalnum() else shape(after)}", f"space{min(span.count(' '), 4)}", f"plain{plain}", f"plain{plain}digits{len(d)}luhn{checks}",
        f"tail{after == '.' and text[end + 1 : end + 2].isalnum()}", f"letters{bool(re.search('[A-Za-z]', span))}at{span.count('@')}",
    )
    return [zlib.crc32(x.encode()) % DIM for x in names]


class Field:
    """Weights of span features for each kind, and of one label after another."""

    def __init__(self) -> None:
        self.w = np.zeros((len(KINDS), DIM))
        self.t = np.zeros((len(LABELS), len(LABELS)))

    def spans(self, text: str, tokens: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Candidate spans (first token, token after the last) and their features."""
        where, ids = [], []
        for i, (a, _) in enumerate(tokens):
            if text[a] in " \n\t":
                continue
            for j in range(i, min(i + MOST, len(tokens))):
                b = tokens[j][1]
                if b - a > CHARS or text[b - 1] == "\n":
                    break
                f = feature_ids(text, a, b)
                if f is not None:
                    where.append((i, j + 1))
                    ids.append(f)
        return where, np.array(ids, np.int64) if ids else np.zeros((0, 1), np.int64)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        return self.w[:, ids].sum(2).T if len(ids) else np.zeros((0, len(KINDS)))

    def gradient(self, text: str, tokens: list[tuple[int, int]], gold: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The candidates' features, the log-likelihood's slope by each candidate's kind and by each pair of labels, and the log-likelihood: what the true segmentation has less what is expected."""
        where, ids = self.spans(text, tokens)
        score, n, m = self.scores(ids).tolist(), len(tokens), len(LABELS)
        edges: list[list[tuple[int, int, int, float]]] = [[], *[[(-1, p, 0, 0.0)] for p in range(n)]]  # by end: candidate, start, label, score
        for k, (i, j) in enumerate(where):
            edges[j] += [(k, i, y, score[k][y - 1]) for y in range(1, m)]
        low, t = -1e30, self.t.tolist()

        def add(x: list[float]) -> float:
            top = max(x, default=low)
            return top if top <= low else top + math.log(sum(math.exp(v - top) for v in x))

        go = [[low] * m for _ in range(n + 1)]
        go[0][0] = 0.0
        for p in range(1, n + 1):
            parts: list[list[float]] = [[] for _ in range(m)]
            for _, i, y, s in edges[p]:
                parts[y].append(add([go[i][z] + t[z][y] for z in range(m) if go[i][z] > low]) + s)
            go[p] = [add(x) for x in parts]
        back: list[list[list[float]]] = [[[] for _ in range(m)] for _ in range(n + 1)]
        rest = [[0.0] * m for _ in range(n + 1)]
        whole = add(go[n])
        step, moves = np.zeros((len(where), len(KINDS))), np.zeros((m, m))
        for p in range(n, 0, -1):
            if p < n:
                rest[p] = [add(x) for x in back[p]]
            for k, i, y, s in edges[p]:
                for z in range(m):
                    back[i][z].append(t[z][y] + s + rest[p][y])
                    if go[i][z] > low:
                        share = math.exp(min(0.0, go[i][z] + t[z][y] + s + rest[p][y] - whole))
                        moves[z, y] -= share
                        if k >= 0:
                            step[k, y - 1] -= share
        at, z, truth = 0, 0, 0.0
        known = {span: k for k, span in enumerate(where)}
        begins = {i: (j, y) for (i, j), y in gold.items() if (i, j) in known}
        while at < n:
            j, y = begins.get(at, (at + 1, -1))
            truth += t[z][y + 1]
            moves[z, y + 1] += 1
            if y >= 0:
                step[known[at, j], y] += 1
                truth += score[known[at, j]][y]
            at, z = j, y + 1
        return ids, step, moves, truth - whole

    def learn(self, text: str, tokens: list[tuple[int, int]], gold: dict[tuple[int, int], int], rate: float) -> None:
        """One step up the log-likelihood, for the features and for the labels that follow each other. ``gold`` has spans that don't overlap."""
        ids, step, moves, _ = self.gradient(text, tokens, gold)
        if not len(ids):
            return
        self.w *= 1 - DECAY
        self.t *= 1 - DECAY
        for y in range(len(KINDS)):
            np.add.at(self.w[y], ids, rate * step[:, y : y + 1])
        self.t += rate / 10 * moves  # a pair of labels has many more occurrences in a window than a feature

    def best(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The best segmentation's entities."""
        where, ids = self.spans(text, tokens)
        score = self.scores(ids)
        # what a span can win over other tokens in its place, whatever stands around it
        gain = np.max(self.t[:, 1:] - self.t[:, :1], axis=0) + np.maximum(0, np.max(self.t[1:] - self.t[0], axis=1))
        length = np.array([j - i for i, j in where])
        keep = np.flatnonzero((score + gain - (length[:, None] - 1) * self.t[0, 0] > 0).any(1)) if len(where) else []
        if not len(keep):
            return []
        ends: dict[int, list[int]] = {}
        for k in keep:
            ends.setdefault(where[k][1], []).append(int(k))
        t, n, m = self.t.tolist(), len(tokens), len(LABELS)
        value = [[-1e30] * m for _ in range(n + 1)]
        came: list[list[tuple[int, int] | None]] = [[None] * m for _ in range(n + 1)]
        value[0][0] = 0.0
        for p in range(1, n + 1):
            for y, i, s in [(0, p - 1, 0.0), *((y, where[k][0], float(score[k, y - 1])) for k in ends.get(p, ()) for y in range(1, m))]:
                z = max(range(m), key=lambda z, i=i, y=y: value[i][z] + t[z][y])
                v = value[i][z] + t[z][y] + s
                if v > value[p][y]:
                    value[p][y], came[p][y] = v, (i, z)
        out, p = [], n
        y = max(range(m), key=lambda y: value[n][y])
        while p > 0:
            i, z = came[p][y]
            if y:
                out.append((y - 1, tokens[i][0], tokens[p - 1][1]))
            p, y = i, z
        return out


def variants(text: str, kind: int, start: int, end: int, turn: int) -> str:
    """The span as the patterns take it, or in a form that they don't."""
    span = text[start:end]
    if kind == 3 and turn % 2:
        return span[1:].lstrip("0123456789").strip(" -.") if re.search(r"^\+[0-9]{1,3}[ .-]", span) else span
    if kind == 0 and turn % 3 == 2:
        return span.replace("@", " @ ")
    return span


def examples(texts: list[str]) -> Iterator[tuple[str, list[tuple[int, int]], dict[tuple[int, int], int]]]:
    """Windows with base spans, in the written and in other forms, and windows without any."""
    for turn, text in enumerate(texts):
        base = base_spans(text)
        taken: list[tuple[int, int, int]] = []
        for k, a, b in sorted(base, key=lambda x: (x[1], -x[2])):
            if b - a <= CHARS and (not taken or a >= taken[-1][2]):
                taken.append((k, a, b))
        pieces, gold, at, size = [], [], 0, 0
        for k, a, b in taken:
            span = variants(text, k, a, b, turn)
            if sum(c.isalnum() for c in span) < 7:
                span = text[a:b]
            pieces += [text[at:a], span]
            size += a - at
            gold.append((k, size, size + len(span)))
            size += len(span)
            at = b
        text = "".join([*pieces, text[at:]])
        for _, tokens in windows(text):
            begin, end = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
            own = {(begin[a], end[b]): k for k, a, b in gold if a in begin and b in end}
            yield text, tokens, own


def learn(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from the base spans of at most ``sample`` documents, those of the smallest hashes of their ids.

    Only the windows around digits and @ travel, and the first ``WINDOWS`` of
    them in the order of the hashes and texts are learnt from, however the rows lie.
    """
    tune(docs.sparkSession)
    ids = docs.select(F.xxhash64("doc_id").alias("h"), "doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most ``sample`` narrow rows

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, out = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for low, tokens in windows(text or ""):
                    for k in range(0, len(tokens), LONGEST):
                        some = tokens[k : k + LONGEST]
                        h.append(i)
                        out.append(text[max(low, some[0][0] - 1) : some[-1][1] + 1])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(out, pa.string())], names=["h", "text"])

    near = rows.select("h", "text").mapInArrow(run, "h long, text string").orderBy("h", "text").limit(WINDOWS)
    field, texts = Field(), [r.text for r in near.collect()]
    for turn in range(PASSES):
        for text, tokens, gold in examples(texts[turn % 2 :] + texts[: turn % 2]):
            field.learn(text, tokens, gold, RATE / (1 + turn))
    return field


def added_spans(text: str, field: Field, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the field finds apart from the base spans."""
    out = []
    for _, tokens in windows(text):
        for k, a, b in field.best(text, tokens):
            if all(b <= s or e <= a for _, s, e in base) and all(b <= s or e <= a for _, s, e in out):
                out.append((k, a, b))
    return out


def suspects(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows with a digit or an @; others have no span at all."""
    hot = np.append(0, np.cumsum((data == 0x40) | ((data >= 48) & (data <= 57))))
    return np.diff(hot[offs]) > 0


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, the counts and digest of the base spans, and all spans, in code points, of every row."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # of a fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()
    empty = ([0, 0, 0, 0], hashlib.sha256(b"").hexdigest(), "")

    def one(text: str) -> tuple[list[int], str, str]:
        base = base_spans(text)
        more = added_spans(text, shared.value, base)
        return [sum(k == i for k, _, _ in base) for i in range(4)], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in blocks(batch):
                rows = [one(data[a:b].tobytes().decode()) if s else empty for a, b, s in zip(offs, offs[1:], suspects(data, offs), strict=False)]
                counts = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def find_documents(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learns, then finds: one row per input row.

    Null and empty texts have no spans. Every row is judged by itself and whole,
    so repeated rows are alike, and a very long text is read window by window;
    further columns are not read. An empty table gives no rows.
    """
    return find(docs, learn(docs, sample))


def mask(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; null texts stay null, other columns stay as they are."""
    field = learn(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    place = docs.columns.index("text")

    def one(text: str) -> str:
        base = base_spans(text)
        at, out = 0, []
        for k, a, b in sorted(base + added_spans(text, shared.value, base), key=lambda x: (x[1], -x[2])):
            if b <= at:
                continue
            out += [text[at:a], f"<{KINDS[k]}>" if a >= at else ""]
            at = b
        return "".join([*out, text[at:]])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in blocks(batch, f"c{place}"):
                texts = part.column(place).to_pylist()
                new = [one(t) if s else t for t, s in zip(texts, suspects(data, offs), strict=True)]
                columns = [*part.columns[:place], pa.array(new, part.schema.field(place).type), *part.columns[place + 1 :]]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    plain = numbered(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
