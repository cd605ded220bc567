"""Near-duplicate documents by MinHash with tensored bands, confirmed on full shingle sets.

Two collections of `side` sketches, each of HALF minhashes, give side * side table keys: one sketch of
either collection. So 2 * side * HALF minhashes serve as many tables as side * side * 2 * HALF would
otherwise need. Two documents of similarity s miss each other in all tables with a chance of about
2 * (1 - s ** HALF) ** side. side follows from the least similarity, so that this is MISSED at most: 10
at 0.85, 13 at 0.80.

Candidates are verified on their whole texts, in steps that leave out what cannot matter: first each
document against a few centres of its buckets; then, in buckets that are not yet connected, those outside
the largest part against centres of that part; last, the pairs between different parts, within blocks of
a bucket. Documents with equal sets are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoom.llm.base import free_name, remove_tables, tables_so_far, written
from dialoom.llm.components import components
from dialoom.llm.hashing import ODD, mixed

WORDS = 5
PERCENT = 85
HALF, MISSED = 2, 7e-6
#: Minhashes of a document. The first make the sketches; of all a byte is kept, to leave out hopeless
#: pairs before verification: those with fewer equal ones than DEVIATIONS allow.
SLOTS, DEVIATIONS = 128, 6
#: Centres of its buckets that a document is compared with before all else, and how often again, with other
#: centres, where that leaves a bucket in parts.
STARS, AGAIN = 3, 2
BLOCK = 2048
REMEMBERED = 300_000


def side_of(percent: int) -> int:
    """The fewest sketches of either collection that miss a pair at the similarity MISSED times at most."""
    s = percent / 100
    side = ceil(log(MISSED / 2) / log(1 - s ** HALF)) if 0 < s < 1 else 1
    if not 0 < s <= 1 or 2 * side * HALF > SLOTS:
        raise ValueError(f"{SLOTS} minhashes do not find pairs of {percent} % as surely as promised")
    return side


def least_equal(percent: int) -> int:
    """Equal minhashes that a pair at the similarity has but for DEVIATIONS of the binomial distribution."""
    s = percent / 100
    return max(0, floor(SLOTS * s - DEVIATIONS * sqrt(SLOTS * s * (1 - s))))


class _Words(dict):
    """64-bit numbers of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = number = xxhash.xxh3_64_intdigest(word)
        return number


def shingle_set(text: str | None, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles, A-Z lower-cased; fewer words are one shingle."""
    found = (text or "").encode().lower().split()  # ASCII case and ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    numbers = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    size = min(WORDS, len(found))
    hashes = np.full(len(found) - size + 1, size, np.uint64)
    for i in range(size):
        hashes = mixed(hashes * ODD + numbers[i:len(found) - size + 1 + i])
    return np.unique(hashes)


def _family() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(85).integers(1, 1 << 63, size=(2, SLOTS), dtype=np.uint64)
    return mixed(draw[0]), draw[1] * np.uint64(2) + np.uint64(1)


FAMILY = _family()


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """SLOTS minhashes, computed in bounded pieces of the set."""
    flip, times = FAMILY
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[at:at + 2048, None] ^ flip) * times).min(0), out=least)
    return mixed(least)


def sketch(least: np.ndarray, side: int) -> np.ndarray:
    """2 * side sketches of HALF minhashes each: the left collection, then the right one."""
    out = np.arange(2 * side, dtype=np.uint64)
    for i in range(HALF):
        out = mixed(out * ODD + least[i:2 * side * HALF:HALF])
    return out.view(np.int64)


def slots(least: np.ndarray) -> bytes:
    """The last byte of every minhash."""
    return (least & np.uint64(255)).astype(np.uint8).tobytes()


SKETCHED = "rid long, doc_id long, n_shingles long, class string, sketches array<long>, slots binary"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for every row in a column of that name, written so that it stays the same."""
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def sketches(rows: DataFrame, side: int) -> DataFrame:
    """One row per row (rid, doc_id, text): set size, hash of the set, sketches and slots."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()),
                            ("class", pa.string()), ("sketches", pa.list_(pa.int64())),
                            ("slots", pa.binary())])
        for batch in source:
            found = []
            for rid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = shingle_set(text, words)
                if len(hashes):
                    least = minhashes(hashes)
                    found.append((rid, doc_id, len(hashes), xxhash.xxh3_128_hexdigest(hashes),
                                  sketch(least, side), slots(least)))
                else:
                    found.append((rid, doc_id, 0, None, None, None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(zip(*found) if found else [[]] * 6, schema)],
                schema=schema)

    return rows.select("rid", F.col("doc_id").cast("long"), "text").mapInArrow(batches, SKETCHED)


def _compatible(a: Column, b: Column, percent: int) -> Column:
    """Sizes that allow the similarity at all."""
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _texts(rows: DataFrame, classes: DataFrame, needed: DataFrame) -> DataFrame:
    """(c, packed): a compressed text of each needed class."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in source:
            packed = [press.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())],
                                             names=["rid", "packed"])

    of = classes.select("c", "rid").join(needed, "c", "left_semi")
    pressed = rows.select("rid", "text").mapInArrow(batches, "rid long, packed binary")
    return of.join(pressed, "rid").select("c", "packed")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the similarity."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, unpress = _Words(), zstandard.ZstdDecompressor()
        last: tuple = (None, None)

        def whole(packed: bytes) -> np.ndarray:
            return shingle_set(unpress.decompress(packed).decode(), words)

        for batch in source:
            found = []
            for a, b, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                if last[0] != b:
                    last = (b, whole(right))
                x, y = whole(left), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    found.append((a, b))
            yield _linked(found)

    one = texts.select(F.col("c").alias("a"), F.col("packed").alias("left"))
    two = texts.select(F.col("c").alias("b"), F.col("packed").alias("right"))
    return (pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right")
            .mapInArrow(batches, "u long, v long"))


def _in_parts(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of buckets (table, key, c, n) with the part they are connected in so far."""
    return buckets.join(parts, F.col("c") == F.col("u"), "left").withColumn(
        "part", F.coalesce("component", "c")).select("table", "key", "c", "n", "part")


def _open(members: DataFrame, seed: int) -> DataFrame:
    """(key, rows, strays, largest, centre) of the buckets in several parts.

    largest is the part with most members, strays counts the others; centre is a member of it, by a hash
    with the seed.
    """
    centre = F.min(F.struct(F.xxhash64(F.lit(seed), "c").alias("h"), F.col("c"), F.col("n"))).alias("centre")
    by_part = members.groupBy("key", "part").agg(F.count("*").alias("size"), centre)
    return (by_part.groupBy("key").agg(F.sum("size").alias("rows"), F.count("*").alias("parts"),
                                       F.max(F.struct("size", "part", "centre")).alias("top"))
            .where("parts > 1")
            .select("key", "rows", (F.col("rows") - F.col("top.size")).alias("strays"), F.col("top.part").alias("largest"),
                    F.col("top.centre.c").alias("centre"), F.col("top.centre.n").alias("centre_n")))


def _with_centres(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b): each document with those STARS centres that it meets in most buckets, of rows (c, n, centre, centre_n)."""
    nearest = Window.partitionBy("a").orderBy(F.desc("count"), "b")
    return (pairs.where((F.col("c") != F.col("centre")) & _compatible(F.col("n"), F.col("centre_n"), percent))
            .groupBy(F.col("c").alias("a"), F.col("centre").alias("b")).count()
            .withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= STARS)
            .select("a", "b"))


def _dealt(members: DataFrame, marks: DataFrame) -> DataFrame:
    """(key, x, y, side, ..): members of the buckets in several parts, dealt to pairs of blocks.

    Of two members of different parts one at least is a stray, outside the bucket's largest part. A
    bucket of up to BLOCK rows is one block. A larger one is cut into blocks x, and its strays are cut
    into blocks y as well; every x meets every y. Neither is gathered whole, and members of the largest
    part are copied only as often as there are blocks of strays. side tells where a row stands: LEFT as
    one of x, RIGHT as a stray of y, BOTH in a bucket of one block.
    """
    sizes = _open(members, 0).select(
        "key", "largest", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.col("strays") / BLOCK).cast("int").alias("stray_blocks"))
    placed = members.join(sizes, "key").join(marks, "c").withColumn("hash", F.xxhash64("c")).withColumn(
        "stray", F.col("part") != F.col("largest"))
    rest = ("table", "c", "n", "part", "stray", "sketches", "slots")

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    def own(blocks: str) -> Column:
        return F.pmod("hash", F.col(blocks)).cast("int")

    def at(rows: DataFrame, x: Column, y: Column, side: int) -> DataFrame:
        return rows.select("key", x.alias("x"), y.alias("y"), F.lit(side).alias("side"), *rest)

    large = placed.where("blocks > 1")
    return (at(placed.where("blocks = 1"), F.lit(0), F.lit(0), BOTH)
            .unionByName(at(large, own("blocks"), every("stray_blocks"), LEFT))
            .unionByName(at(large.where("stray"), every("blocks"), own("stray_blocks"), RIGHT)))


LEFT, RIGHT, BOTH = range(3)


def _open_blocks(members: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(key, x, y, members, pairs): per pair of blocks of a bucket, what may still be linked.

    Only members of different parts count, whose sizes and slots leave them a chance, and only in the
    first table that a pair shares. A row holds all pairs of its blocks (places in members, packed), so
    there are as many rows as blocks, however many pairs.
    """
    side, least = side_of(percent), least_equal(percent)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def compare() -> Iterator[tuple]:
            at, stray = np.array([r[3] for r in rows]), np.array([r[8] for r in rows], bool)
            c, n, part = (np.array([r[i] for r in rows], np.int64) for i in (5, 6, 7))
            sketch_rows = np.array([r[9] for r in rows], np.int64)
            slot_rows = np.frombuffer(b"".join(r[10] for r in rows), np.uint8).reshape(len(rows), SLOTS)
            found, lefts = [], np.flatnonzero(at != RIGHT)
            for i in np.flatnonzero((at != LEFT) & stray):
                rest = lefts[part[lefts] != part[i]]
                rest = rest[~stray[rest] | (c[rest] < c[i])]  # two strays meet both ways round
                rest = rest[100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])]
                if len(rest):
                    same = sketch_rows[rest] == sketch_rows[i]
                    first = same[:, :side].argmax(1) * side + same[:, side:].argmax(1)
                    equal = (slot_rows[rest] == slot_rows[i]).sum(1)
                    rest = rest[(first == rows[0][4]) & (equal >= least)]
                    found.append(np.column_stack([np.full(len(rest), i), rest]))
            pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            if len(pairs):
                used, places = np.unique(c[pairs], return_inverse=True)
                yield (*group, used.tolist(), places.reshape(-1).astype("<i4").tobytes())

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], kind) for i, kind in enumerate(
                    (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()))],
                names=["key", "x", "y", "members", "pairs"])

        for batch in source:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != group:
                    found += compare() if rows else ()
                    group, rows = row[:3], []
                rows.append(row)
            yield out(found)
        if rows:
            yield out(list(compare()))

    return (_dealt(members, marks).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
            .mapInArrow(batches, "key long, x int, y int, members array<long>, pairs binary"))


def _links_of_blocks(blocks: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(u, v): links that connect what the blocks' pairs link, on whole sets.

    Each block brings its members' texts together once. Members already connected within the block
    are not compared again, so it gives out fewer links than members.
    """
    asked = blocks.select("key", "x", "y", F.explode("members").alias("c")).join(texts, "c").select(
        "key", "x", "y", "c", "packed", F.lit(None).cast("array<long>").alias("members"))
    lists = blocks.select("key", "x", "y", F.lit(None).cast("long").alias("c"), F.col("pairs").alias("packed"), "members")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, unpress = _Words(), zstandard.ZstdDecompressor()
        group, held, pairs, order = None, {}, None, []

        def links() -> Iterator[tuple[int, int]]:
            sets = [held[c] for c in order]
            ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
            each = np.split(ids, np.cumsum([len(x) for x in sets])[:-1])
            above = list(range(len(order)))

            def top(a: int) -> int:
                while above[a] != a:
                    above[a] = a = above[above[a]]
                return a

            by_left = np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1)
            flags = np.zeros(int(ids.max()) + 1, bool)
            for some in by_left:
                a = int(some[0, 0])
                rest = [b for b in some[:, 1].tolist() if top(b) != top(a)]
                if not rest:
                    continue
                flags[each[a]] = True
                for b in rest:
                    if top(b) == top(a):
                        continue
                    both = int(flags[each[b]].sum())
                    if 100 * both >= percent * (len(each[a]) + len(each[b]) - both):
                        above[top(b)] = top(a)
                        yield order[a], order[b]
                flags[each[a]] = False

        for batch in source:
            found: list[tuple[int, int]] = []
            for key, x, y, c, packed, members in zip(*(col.to_pylist() for col in batch.columns)):
                if (key, x, y) != group:
                    found += links() if group else ()
                    group, held = (key, x, y), {}
                if c is None:  # sorted before the members
                    pairs, order = np.frombuffer(packed, "<i4").reshape(-1, 2), members
                else:
                    held[c] = shingle_set(unpress.decompress(packed).decode(), words)
            yield _linked(found)
        if group:
            yield _linked(list(links()))

    return (lists.unionByName(asked).repartition("key", "x", "y")
            .sortWithinPartitions("key", "x", "y", F.col("c").asc_nulls_first())
            .mapInArrow(batches, "u long, v long"))


def _linked(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[i] for p in found], pa.int64()) for i in range(2)], names=["u", "v"])


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Documents without words (null, empty or blank text) have no shingles and are linked with
    nothing. Others are linked from a similarity of percent hundredths on. Rows with equal sets are one
    class, repeated rows included. The component is named by its smallest doc_id; a null doc_id never
    names one unless alone, and is never kept. Other columns are not read; an empty table gives no rows.
    """
    rows = numbered(docs.select("doc_id", "text"), "rid")
    sketched, classes, parts = _classes_and_parts(rows, percent)
    # every class's number, and thereby the least of its component, stands for its least doc_id
    names = classes.select(F.col("c").alias("component"), F.col("least").alias("component_id"))
    by_class = classes.select("class", "c").join(parts, F.col("c") == F.col("u"), "left").withColumn(
        "component", F.coalesce("component", "c")).join(names, "component").select("class", "component_id")
    return (sketched.join(by_class, "class", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                    .alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


def _classes_and_parts(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (rid, doc_id, text): their sketches, the classes of equal sets, and (u, component) of linked classes.

    A class has a number c, its first row rid, and the least doc_id. Rows are taken by doc_id, nulls last,
    and classes are numbered by their first rows; so the least number of a component is its first class.
    """
    side = side_of(percent)
    sketched = written(sketches(rows, side), "sketches")
    by_id = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("rid"))
    classes = (sketched.where("n_shingles > 0").groupBy("class")
               .agg(F.min(by_id).alias("first"), F.first("n_shingles").alias("n"))
               .orderBy("first").withColumn("c", F.monotonically_increasing_id())
               .select("class", "c", F.col("first.rid").alias("rid"), F.col("first.doc_id").alias("least"), "n"))
    classes = written(classes, "classes")
    marks = classes.select("c", "rid", "n").join(sketched.select("rid", "sketches", "slots"), "rid").drop("rid")
    before = tables_so_far()
    order = F.xxhash64("c")
    keys = F.array(*[F.xxhash64(F.lit(i), F.lit(j), F.col("sketches")[i], F.col("sketches")[side + j])
                     for i in range(side) for j in range(side)])
    in_bucket = Window.partitionBy("key").orderBy("order", "c")
    buckets = (marks.select("c", "n", F.posexplode(keys).alias("table", "key"))
               .select("table", "key", "c", F.col("n").cast("int").alias("n"), order.alias("order"))
               .withColumn("centre", F.first(F.struct("c", "n")).over(
                   in_bucket.rowsBetween(Window.unboundedPreceding, 0)))
               .withColumn("next", F.lead("c").over(in_bucket))
               .where("next IS NOT NULL OR centre.c <> c")
               .select("table", "key", "c", "n", F.col("centre.c").alias("centre"),
                       F.col("centre.n").alias("centre_n")))
    buckets = written(buckets, "buckets")
    texts = written(_texts(rows, classes, buckets.select("c").distinct()), "texts")

    links = written(_confirmed(_with_centres(buckets, percent), texts, percent), "links")
    parts = written(components(links), "parts")
    for seed in range(1, AGAIN + 1):
        members = _in_parts(buckets, parts)
        strays = members.join(_open(members, seed), "key").where("part <> largest")
        found = written(_confirmed(_with_centres(strays, percent), texts, percent), "links")
        if found.isEmpty():
            break
        links = written(links.unionByName(found), "links")
        parts = written(components(links), "parts")
    blocks = written(_open_blocks(_in_parts(buckets, parts), marks.drop("n"), percent), "blocks")
    links = written(links.unionByName(_links_of_blocks(blocks, texts, percent)), "links")
    parts = components(links)
    remove_tables(rows.sparkSession, before, but=(parts,))
    return sketched, classes, parts


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest doc_id.

    Null ids come after all others, and of rows with the same doc_id the first of a scan stays. Documents
    without words (null, empty or blank text) all stay, repeated ones too. All columns stay, whatever
    their names; an empty table stays empty.
    """
    rid, before = free_name(docs, "rid"), tables_so_far()
    rows = numbered(docs, rid)
    sketched, classes, parts = _classes_and_parts(rows.select(F.col(rid).alias("rid"), "doc_id", "text"), percent)
    first = classes.select("c", "rid").join(parts, F.col("c") == F.col("u"), "left").where("component IS NULL OR component = c")
    staying = written(first.select("rid").unionByName(sketched.where("n_shingles = 0").select("rid")), "staying")
    remove_tables(docs.sparkSession, before, but=(rows, staying))
    return rows.join(staying.withColumnRenamed("rid", rid), rid, "left_semi").select(*docs.columns)


def oracle() -> str:
    """near_duplicates() for DuckDB, from all pairs of documents that share a shingle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE texts AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'),
        '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + {WORDS - 1}), ' ') AS s
      FROM texts, unnest(range(1, greatest(len(words) - {WORDS - 1}, 1) + 1)) AS t(i) WHERE len(words) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
      SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y
      ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
    links AS (
      SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
      WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
    least AS (SELECT a AS doc_id, min(b) AS other FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id,
      doc_id = least(doc_id, coalesce(other, doc_id)) AS kept
    FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)"""
