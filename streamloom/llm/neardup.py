"""Near-duplicate documents by MinHash.

1. A pass over the texts gives each document's set of word shingles, a digest of
   the set, and band keys of ``ROWS`` universal hash minima each. Rows with equal
   sets are one class from here on.
2. Classes that share a band key form a bucket. Buckets aren't expanded into
   pairs: each member is paired with the bucket's centre, the pair verified on
   the full sets, and the links joined to components. The centre is the member
   that meets most others over all its bands, so in a family of copies the one
   that they were made from.
3. What could still be missed are links between members of one bucket that lie
   in different components. Where the pairs left don't outnumber the members
   (up to ``FEW``) they are verified as they are. The members of all other such
   buckets get longer keys: fewer minima agree by chance, so that members that
   aren't near part, and those that may be linked share one of the many bands
   again. There too come first stars, and then the pairs of members that share
   a long key and lie in different components; of both only those whose
   signatures are as alike as the threshold asks go on to the full sets. A
   signature is an odd sketch: each shingle flips one of ``64 * WORDS`` bits, so
   two of them never differ in more bits than the sets in shingles. Of a set of
   over ``LARGE`` shingles a share chosen by hash is sketched, so that the bits
   don't fill up; it has a signature, and long keys, for each such share in which
   sets of a size that allows a link are sketched.

The number of bands follows from the threshold: a pair at the threshold itself
shares no band, short or long, with a probability under ``MISS`` each, and fails
by its signature with one under 3e-7 (sets of up to some hundred shingles: never). The pairs that are verified grow in
proportion to the members of a family, unless its texts lie just below the
threshold of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .decontaminate import word_hashes
from .kit import blocks, mix, tidy, tune
from .shared import release, stored

#: Minima in a band.
ROWS = 5
#: The greatest chance that a pair at the threshold shares no band.
MISS = 1e-6
#: The chance that such a pair agrees in all minima of one long key, about.
LONG = 0.04
#: Words of 64 bits in a signature, and the standard deviations by which it may fall short.
WORDS, SPARE = 24, 5.0
#: Shingles that are sketched whole; of up to twice as many a half is, and so on.
LARGE = 128 * WORDS
SKETCH = [f"w{i}" for i in range(WORDS)]
#: A bucket of up to FEW members has, beside its star, at most as many pairs as members.
FEW = 4


@cache
def family(rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of the universal hash functions; long and short keys share none."""
    rng = np.random.Generator(np.random.PCG64(31 + rows))
    return rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)


def bands_for(rows: int, percent: int) -> int:
    """Bands of which a pair at the threshold shares none with a probability of at most MISS."""
    hit = (percent / 100) ** rows
    return 1 if hit >= 1 else math.ceil(math.log(MISS) / math.log1p(-hit))


def long_rows(percent: int) -> int:
    """Minima in a long key."""
    return 20 if percent >= 100 else max(ROWS + 1, math.floor(math.log(LONG) / math.log(percent / 100)))


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes: of ``width`` words, or of all if there are fewer; without words the set is empty."""
    word, first = word_hashes(data, offs)
    size = np.diff(first)
    n = max(0, len(word) - width + 1)
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = mix(h + word[k : k + n])
    for i in range(len(size)):
        a = first[i]
        if size[i] >= width:
            yield np.unique(h[a : a + size[i] - width + 1])
        elif size[i]:
            x = np.full(1, size[i], np.uint64)
            for k in range(size[i]):
                x = mix(x + word[a + k : a + k + 1])
            yield x
        else:
            yield np.zeros(0, np.uint64)


def digests(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    return int(shingles.sum()), int(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum())


def minima(shingles: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """The universal hash minima of a set that isn't empty, a row for each band."""
    a, b = family(rows, bands)
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    step = max(16, (1 << 19) // len(a))
    for i in range(0, len(shingles), step):
        x = (a[:, None] * shingles[None, i : i + step] + b[:, None]) >> np.uint64(32)
        np.minimum(low, x.min(1), out=low)
    return low.reshape(bands, rows)


def band_keys(low: np.ndarray) -> np.ndarray:
    """A key for each band's minima."""
    key = np.arange(1, len(low) + 1, dtype=np.uint64)
    for j in range(low.shape[1]):
        key = mix(key + low[:, j])
    return key


def levels(n: int, percent: int) -> range:
    """The levels at which a set of ``n`` shingles meets others, one in ``2**level`` shingles being sketched: those of all sizes from its own up to the greatest that allow a link."""
    level = lambda size: ((size - 1) // LARGE).bit_length()
    return range(level(n), level(n * 100 // percent) + 1)


def sketch(shingles: np.ndarray, level: int) -> np.ndarray:
    """The parities of the shingles that fall on each bit."""
    h = mix(shingles ^ np.uint64(0x2D358DCCAA6C78A5))
    h = h[(h & np.uint64((1 << level) - 1)) == 0] >> np.uint64(32)
    odd = np.bincount((h % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def alike(n: Column, level: Column, percent: int) -> Column:
    """Bits in which the sketches of a pair at the threshold may differ, ``n`` being the sum of their sizes: at level 0 never more than the shingles do."""
    bits = 64 * WORDS
    share = F.pow(F.lit(0.5), level)
    z = n * ((100 - percent) / (100 + percent)) * share
    left = F.exp(z * (-2 / bits))
    spare = F.sqrt(bits / 4 * (1 - left * left) - share * z * left * left + 1e-6)
    limit = bits / 2 * (1 - left) + SPARE * spare
    return F.when(level == 0, F.least(z + 1e-6, limit)).otherwise(limit + SPARE * SPARE / 3)


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, d1, d2, bands) of every row; n is the set's size."""
    bands = bands_for(ROWS, percent)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in blocks(batch):
                n, sums, keys, ends = [], [], [], [0]
                for s in shingle_sets(data, offs, width):
                    n.append(len(s))
                    sums.append(digests(s))
                    if len(s):
                        keys.append(band_keys(minima(s, ROWS, bands)))
                    ends.append(ends[-1] + bands * (len(s) > 0))
                flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
                two = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    names=["doc_id", "n", "d1", "d2", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def class_sets(docs: DataFrame, named: DataFrame, width: int) -> DataFrame:
    """(id, s): the shingles of the classes ``named`` (id, first, d1, d2), from a row of doc_id ``first`` whose digests are the class's: a doc_id may stand on several rows."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in blocks(batch):
                sets = list(shingle_sets(data, offs, width))
                two = np.array([digests(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
                ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["first", "d1", "d2", "s"])

    own = docs.join(named.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    rows = own.mapInArrow(run, "first long, d1 long, d2 long, s array<long>").dropDuplicates(["first", "d1", "d2"])
    return rows.join(named.select("id", "first", "d1", "d2"), ["first", "d1", "d2"]).select("id", "s")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    b = sets.select(F.col("id").alias("b"), F.col("s").alias("s_b"))
    a = sets.select(F.col("id").alias("a"), F.col("s").alias("s_a"))
    both = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return pairs.select("a", "b").join(b, "b").join(a, "a").where(both * (100 + percent) >= percent * (F.size("s_a") + F.size("s_b"))).select("a", "b")


def near(n_a: str, n_b: str, percent: int) -> Column:
    """Whether the sizes of two sets allow a link."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def same_sketch(p: str, q: str, percent: int) -> Column:
    """Whether the signatures of two members of a long key are as alike as the threshold asks."""
    return sum(F.bit_count(F.col(f"{p}{w}").bitwiseXOR(F.col(f"{q}{w}"))) for w in SKETCH) <= alike(F.col(f"{p}n") + F.col(f"{q}n"), F.col(f"{p}level"), percent)


def members_of(keys: DataFrame) -> DataFrame:
    """(key, id, n, size): the buckets of two members or more."""
    several = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return keys.join(several, "key")


def star(members: DataFrame, percent: int, signed: bool = False) -> DataFrame:
    """(a, b): each member with its bucket's centre, the one that meets most others, where the sizes allow a link; ``signed``: in another component, and where the signatures allow it too."""
    more = ["component", "level", *SKETCH] if signed else []
    meets = members.groupBy("id").agg(F.sum("size").alias("meets"))
    ranked = members.join(meets, "id")
    centre = ranked.groupBy("key").agg(F.max(F.struct("meets", "id", "n", *more)).alias("c"))
    pairs = members.join(centre, "key").where((F.col("id") != F.col("c.id")) & near("n", "c.n", percent))
    if signed:
        pairs = pairs.where((F.col("component") != F.col("c.component")) & same_sketch("", "c.", percent))
    return pairs.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()


def mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members, with their components, of the buckets that hold more than one component."""
    placed = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    return placed.join(keys, "key", "left_semi")


def open_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): the members of one bucket that lie in different components, where the sizes allow a link."""
    p, q = members.alias("p"), members.alias("q")
    apart = (F.col("p.key") == F.col("q.key")) & (F.col("p.id") < F.col("q.id")) & (F.col("p.component") != F.col("q.component")) & near("p.n", "q.n", percent)
    return p.join(q, apart).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()


def signed_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): as ``open_pairs``, where the signatures allow a link too; the member of the smaller component looks for the other, so that those of the largest look for none."""
    own = members.select("id", "component").distinct()
    each = own.groupBy("component").agg(F.count("*").alias("all"))
    rows = members.join(own.join(each, "component").select("id", "all"), "id")
    largest = each.agg(F.max(F.struct("all", "component")).alias("m")).first().m
    p, q = rows.where(F.col("component") != (largest.component if largest else -1)).alias("p"), rows.alias("q")
    smaller = (F.col("p.all") < F.col("q.all")) | ((F.col("p.all") == F.col("q.all")) & (F.col("p.component") < F.col("q.component")))
    pairs = p.join(q, (F.col("p.key") == F.col("q.key")) & smaller & near("p.n", "q.n", percent) & same_sketch("p.", "q.", percent))
    return pairs.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()


def long_keys(sets: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """(id, n, level, keys, sketch): the long keys and the signatures of the sets with these ids, a row for each level."""
    rows = long_rows(percent)
    bands = bands_for(rows, percent)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.asarray(batch.column(1).offsets)
            flat = np.asarray(batch.column(1).values).view(np.uint64)
            own, at, keys, marks = [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                key = band_keys(minima(flat[a:b], rows, bands))
                for level in levels(int(b - a), percent):
                    own.append(i)
                    at.append(level)
                    keys.append(mix(key + np.uint64(level)))
                    marks.append(sketch(flat[a:b], level))
            step = np.arange(len(own) + 1, dtype=np.int32)
            many, words = pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(marks))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array(np.diff(ends).astype(np.int64)[own]), pa.array(at, pa.int32()), pa.ListArray.from_arrays(pa.array(step * bands), many), pa.ListArray.from_arrays(pa.array(step * WORDS), words)], names=["id", "n", "level", "keys", "sketch"])

    return sets.join(ids, "id", "left_semi").mapInArrow(run, "id long, n long, level int, keys array<long>, sketch array<long>")


def as_edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("a"), F.col("component").alias("b"))


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components with further links; without any they stay."""
    return found if links.isEmpty() else components(as_edges(found).union(links))


def linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their digests (doc_id, n, d1, d2), and classes with their components (n, d1, d2, first, component).

    ``docs`` has a long doc_id and text; rows with a null doc_id are in no class.
    """
    tune(docs.sparkSession)
    marks = stored(signatures(docs, width, percent), "shingle-sets")
    classes = marks.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "shingle-classes")
    members = stored(members_of(classes.select(F.explode("bands").alias("key"), "id", "n")), "buckets")
    involved = members.select("id").distinct()
    sets = stored(class_sets(docs, classes.select("id", "first", "d1", "d2").join(involved, "id", "left_semi"), width), "bucket-sets")

    links = stored(verified(star(members, percent), sets, percent), "links")
    found = components(links)
    unsettled = stored(mixed(members.where("size > 2"), found), "unsettled")
    few = open_pairs(unsettled.where(F.col("size") <= FEW), percent)
    more = stored(verified(few, sets, percent), "links")
    found = joined(found, more)
    used = [classes, members, sets, links, unsettled, more]

    crowd = unsettled.where(F.col("size") > FEW).select("id").distinct()
    if not crowd.isEmpty():
        long = stored(long_keys(sets, crowd, percent), "long-keys")
        deep = stored(members_of(long.select(F.explode("keys").alias("key"), "id", "n", "level")), "long-buckets")

        def placed(found: DataFrame) -> DataFrame:
            own = long.join(found, "id", "left").select("id", "level", F.coalesce("component", "id").alias("component"), *[F.col("sketch")[i].alias(w) for i, w in enumerate(SKETCH)])
            return deep.join(own, ["id", "level"])

        again = stored(verified(star(placed(found), percent, True), sets, percent), "links")
        found = joined(found, again)
        last = stored(verified(signed_pairs(placed(found), percent), sets, percent), "links")
        found = joined(found, last)
        used += [long, deep, again, last]

    groups = stored(classes.select("n", "d1", "d2", "first", "id").join(found, "id", "left").select("n", "d1", "d2", "first", F.coalesce("component", "id").alias("component")), "shingle-groups")
    release(*used)
    return marks.select("doc_id", "n", "d1", "d2"), groups


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Words are runs of non-blank bytes with A-Z in lower case. Documents with
    100 * intersection >= percent * union of their sets of ``width``-word shingles
    are linked; component_id is the smallest doc_id that links reach, and kept
    tells whether it is the document's own. Null, empty and blank texts have no
    shingle, are linked with nothing and kept. Rows with a null doc_id take no part:
    component null, kept. Rows that repeat a doc_id are judged by their own texts,
    each. A text of any length is one set. Further columns are not read.
    """
    marks, groups = linked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, percent)
    least = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    groups = groups.join(least, "component").select("n", "d1", "d2", "component_id")
    out = marks.join(groups, ["n", "d1", "d2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those that repeat another.

    Rows are grouped as by ``near_duplicates``, but each row for itself, whatever
    its doc_id: of every group one row stays, that of the smallest doc_id (null
    comes last), and of several such rows one of them. Rows without a word stay.
    """
    row = "row"
    while row in docs.columns:
        row += "_"
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    marks, groups = linked(keyed.select(F.col(row).alias("doc_id"), "text"), width, percent)
    ids = keyed.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    placed = marks.where("n > 0").join(groups, ["n", "d1", "d2"]).select(F.col("doc_id").alias("row"), "component").join(ids, "row")
    chosen = placed.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")).select(F.col("best.row").alias(row))
    stay = marks.where("n = 0").select(F.col("doc_id").alias(row)).union(chosen)
    return keyed.join(stay, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same rows for shingles of three words and 85 percent: candidates by prefixes of each set's rarest shingles, counted on the full sets, and reached by recursion.
ORACLE = r"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM t),
n AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(list_sort(s), chr(10))) AS h FROM g),
c AS MATERIALIZED (SELECT h, min(doc_id) AS id, any_value(n) AS n FROM n WHERE n > 0 GROUP BY h),
x AS MATERIALIZED (SELECT doc_id AS id, n, unnest(s) AS sh FROM g JOIN c ON c.id = g.doc_id),
y AS MATERIALIZED (SELECT id, n, sh, row_number() OVER (PARTITION BY id ORDER BY k, sh) AS r FROM (SELECT *, count(*) OVER (PARTITION BY sh) AS k FROM x)),
p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM y a JOIN y b ON a.sh = b.sh AND a.id < b.id WHERE a.r <= a.n - (85 * a.n + 99) // 100 + 1 AND b.r <= b.n - (85 * b.n + 99) // 100 + 1 AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
e AS MATERIALIZED (SELECT a, b FROM (SELECT p.a, p.b, any_value(u.n) AS na, any_value(v.n) AS nb, count(*) AS inter FROM p JOIN x u ON u.id = p.a JOIN x v ON v.id = p.b AND v.sh = u.sh GROUP BY p.a, p.b) WHERE 100 * inter >= 85 * (na + nb - inter)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT id, id AS low FROM c UNION SELECT d.b, r.low FROM r JOIN d ON d.a = r.id WHERE r.low < d.b),
m AS (SELECT id, min(low) AS low FROM r GROUP BY id)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.low, n.doc_id) AS component_id, n.doc_id = coalesce(m.low, n.doc_id) AS kept FROM n LEFT JOIN c ON c.h = n.h AND n.n > 0 LEFT JOIN m ON m.id = c.id"""
