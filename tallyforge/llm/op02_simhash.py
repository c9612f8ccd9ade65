"""Near-duplicate documents by 64-bit SimHash fingerprints, linked through BK-trees of shards.

``near_duplicates`` links fingerprints that differ in few bits. ``drop_near_duplicates`` asks for texts that are similar: a similarity of 0.8
can cost a quarter of the bits, so there the trees propose and the shingles decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyforge.llm.common import batch_of, binary_cells, forget, grouped, hashable, named, stored, table, tidied, unused
from tallyforge.llm.graph import components

BITS, SEED, WORDS, RADIUS = 64, 42, 3, 2
#: A tree holds at most so many fingerprints; a shard that has more is split by further bits.
TREE_LIMIT = 2048
PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a block at a time: a very long text takes no more memory
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """Of each run of words, repeats included. A text of fewer words is one shingle, one without words has none."""
    found = text.lower().split() if text else []
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)] * bool(found)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Unsigned. Zero for null and for a text without words."""
    return majority(shingle_hashes(text, words))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [signed(fingerprint(t, words)) for t in binary_cells(batch.column(1))]
            yield batch_of(PRINTS, (batch.column(0).to_pylist(), prints))

    return docs.select(F.col("doc_id").cast("long"), named(text)).mapInArrow(tidied(made), "doc_id long, fp long")


class BKTree:
    """Children are keyed by their distance to the parent, so a search follows only the edges within the radius."""

    def __init__(self):
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def near(self, value: int, radius: int) -> list[int]:
        found, open_ = [], [self.root] if self.root else []
        while open_:
            at, children = open_.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                found.append(at)
            open_ += [child for edge, child in children.items() if d - radius <= edge <= d + radius]
        return found


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A link for each value that is near an earlier tree's root of its class: as many as join up all that are near."""
    if len(values) == 2:
        return [(values[0], values[1])] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree, up = BKTree(), {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for value in values:
        up[value] = value
        for other in tree.near(value, radius):
            up[top(other)] = top(value)
        tree.add(value)
    return [(x, r) for x in values if (r := top(x)) != x]


def _blocks(free: list[int], n: int) -> list[list[int]]:
    """free bit positions cut into n runs of nearly equal length."""
    edges = [round(i * len(free) / n) for i in range(n + 1)]
    return [free[a:b] for a, b in zip(edges, edges[1:])]


def _bits_at(fp: Column, block: list[int]) -> Column:
    mask = sum(1 << i for i in block)
    return fp.bitwiseAND(F.lit(signed(mask)))


def _shards(prints: DataFrame, radius: int, level: int) -> DataFrame:
    """Adds a shard to each row and repeats the row for each. Within the radius, two fingerprints agree in at least one of
    radius + 1 blocks of bits; ``shard`` names the block and holds its bits. At a further level the bits that are still
    free are cut into blocks again, which two near fingerprints of the shard agree in again."""
    ways: list[tuple[list[int], list[int]]] = [([], list(range(BITS)))]
    for _ in range(level):
        ways = [(held + block, [i for i in free if i not in block]) for held, free in ways for block in _blocks(free, radius + 1)]
    keys = F.array(*(F.struct(F.lit(k).alias("block"), _bits_at(F.col("fp"), held).alias("bits")) for k, (held, _) in enumerate(ways)))
    return prints.select("fp", F.explode(keys).alias("shard")).select("shard.block", "shard.bits", "fp")


def near_links(prints: DataFrame, radius: int = RADIUS, limit: int = TREE_LIMIT) -> DataFrame:
    """(a, b): links that join up all fingerprints of ``prints(fp)``, which are distinct, at ``radius`` or less.

    A shard's tree is built by the task that holds the shard; the fingerprints themselves never reach the driver. A shard
    with over ``limit`` fingerprints is split by the next level's blocks. After four levels a shard has so few free bits
    left that its size is bounded by them, so the last level takes shards of any size.
    """

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for _, rows in grouped(batches, 2):
            if len(rows) > 1:
                found += tree_links([r[0] & (2**64 - 1) for r in rows], radius)
            if len(found) >= 50_000:
                yield batch_of(LINKS, zip(*((signed(a), signed(b)) for a, b in found)))
                found = []
        if found:
            yield batch_of(LINKS, zip(*((signed(a), signed(b)) for a, b in found)))

    out, left, last = None, prints.select("fp"), 4
    for level in range(1, last + 1):
        rows = _shards(left, radius, level)
        sizes = rows.groupBy("block", "bits").agg(F.count("*").alias("n"))
        large = stored(sizes.filter(F.col("n") > limit).select("block", "bits")) if level < last else None
        if more := large is not None and not large.isEmpty():
            hot = rows.join(large, ["block", "bits"], "left_semi")
            rows = rows.join(large, ["block", "bits"], "left_anti")
        links = rows.repartition("block", "bits").sortWithinPartitions("block", "bits", "fp").mapInArrow(tidied(linked), "a long, b long")
        out = links if out is None else out.unionByName(links)
        if not more:
            return out
        left = stored(hot.select("fp").distinct())
    return out


def near_duplicates(docs: DataFrame, text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_prints: different fingerprints in the component) for every row of docs.

    Fingerprints at ``radius`` or fewer differing bits are linked; component_id is the smallest doc_id reachable through
    links, the document itself included. Null and empty texts have fingerprint zero, linked like any other; a repeated row
    appears as often as it does in docs. A null doc_id keeps its row and never names a component, unless its component has
    no other id: then component_id is null. Only doc_id and the text are read, so other columns cannot clash.
    """
    prints = stored(fingerprints(docs, text, words))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tied = components(near_links(classes, radius))
    roots = classes.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = stored(roots)
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_prints"))
    labels = roots.join(named, "root").select("fp", "component_id", "n_prints")
    out = prints.join(labels, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_prints")


# ---- texts that are similar ------------------------------------------------------------------------------------------------

COPY_WORDS, SIMILARITY = 5, 0.8
#: Differing bits within which similar texts are looked for. At a similarity of 0.8 ten are expected, and a standard deviation is three.
COPY_RADIUS = 26
#: A shard is of texts that agree in all MinHashes of a band. At a similarity of 0.8, (1 - 0.8 ** 5) ** 24 = 7 in 100,000 share none.
BANDS, ROWS = 24, 5
#: Different texts of a group that one task links; larger groups meet a block of so many of their own at a time, of so many bytes.
GROUP_LIMIT, PIVOTS, PIVOT_BYTES = 1024, 2048, 32 << 20
_rng = np.random.default_rng(SEED)
TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
COPIES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("set", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("group", pa.int64()), ("set", pa.int64()), ("fp", pa.int64()), ("hashes", pa.binary())])
SETS_DDL = "`group` long, `set` long, fp long, hashes binary"


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of MinHashes of the different shingles."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(least, (hashes[at : at + 256, None] * TIMES + PLUS).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).astype(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets of hashes is ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared >= least * (len(both) - shared) - 1e-9


def copy_links(sets: list[tuple[int, int, np.ndarray]], least: float = SIMILARITY, radius: int = COPY_RADIUS) -> list[tuple[int, int]]:
    """Links that join up all similar ones of (key, fingerprint, hashes). Each is looked up in a BK-tree of those before it; of those within the
    radius it is compared with the nearest first, until one of each class is similar."""
    tree, held, up, links = BKTree(), {}, list(range(len(sets))), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, (key, fp, hashes) in enumerate(sets):
        for other in sorted(tree.near(fp, radius), key=lambda o: (o ^ fp).bit_count()):
            for j in held[other]:
                if top(j) != top(i) and similar(hashes, sets[j][2], least):
                    links.append((sets[j][0], key))
                    up[top(i)] = top(j)
        tree.add(fp)
        held.setdefault(fp, []).append(i)
    return links


def _unsigned(x: int) -> int:
    return x & (2**64 - 1)


def _group_links(sets: DataFrame, least: float) -> DataFrame:
    """Links of small groups, each by one task."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, 1):
            kept = {key: (fp, h) for key, fp, h in rows}  # a text that is there more than once
            if found := copy_links([(key, _unsigned(fp), np.frombuffer(h, dtype="<u8")) for key, (fp, h) in kept.items()], least):
                yield batch_of(LINKS, zip(*found))

    return sets.repartition("group").sortWithinPartitions("group", "set").mapInArrow(tidied(linked), "a long, b long")


def _block_links(sets: DataFrame, least: float, pivots: int = PIVOTS) -> DataFrame:
    """Links of large groups, whose rows stay where they are. In each round a block of texts is broadcast as a BK-tree a group, and every text of
    the group is looked up there. Only texts outside their group's largest class are still asked about, so the copies of one
    text take a round or two: all pairs of texts of different classes have one end there, and each is asked about once."""
    sets = stored(sets.dropDuplicates(["group", "set"]))
    sizes = sets.select("group", "set", F.octet_length("hashes").alias("size"))
    links, done, turn = None, None, 16
    while True:
        labels = sizes.withColumn("label", F.col("set"))
        if links is not None:
            labels = stored(sizes.join(components(links), F.col("set") == F.col("node"), "left").select("group", "set", "size", F.coalesce("component", "set").alias("label")))
        most = labels.groupBy("group", "label").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
        left = labels.join(most, "group").filter("label <> most")
        left = left if done is None else left.join(done, "set", "left_anti")
        order = Window.partitionBy("group").orderBy(F.xxhash64(F.lit(SEED), "set"), "set")
        block = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= turn).orderBy("rank", "set").limit(pivots)
        asked, room = {}, PIVOT_BYTES
        for row in block.select("set", "size", "label").collect():  # `pivots` rows at most
            if not asked or row.size <= room:
                asked[row.set] = row.label
                room -= row.size
        if not asked:
            return sets.select(F.col("set").alias("a"), F.col("set").alias("b")).limit(0) if links is None else links
        trees: dict[int, tuple[BKTree, dict[int, list]]] = {}
        for row in sets.filter(F.col("set").isin(list(asked))).collect():  # PIVOT_BYTES, or one text
            tree, held = trees.setdefault(row.group, (BKTree(), {}))
            tree.add(fp := _unsigned(row.fp))
            held.setdefault(fp, []).append((row.set, asked[row.set], bytes(row.hashes)))
        shared = sets.sparkSession.sparkContext.broadcast(trees)

        def met(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for group, key, fp, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                    if group in shared.value:
                        tree, held = shared.value[group]
                        own, seen, fp = np.frombuffer(hashes, dtype="<u8"), set(), _unsigned(fp)
                        for pivot, label, theirs in (p for other in tree.near(fp, COPY_RADIUS) for p in held[other]):
                            if pivot != key and label not in seen and similar(own, np.frombuffer(theirs, dtype="<u8"), least):
                                seen.add(label)
                                found.append((pivot, key))
                if found:
                    yield batch_of(LINKS, zip(*found))

        new = stored(sets.mapInArrow(tidied(met), "a long, b long"))
        links = new if links is None else links.unionByName(new)
        asked_now = sets.sparkSession.createDataFrame([(k,) for k in asked], "`set` long")
        done = stored(asked_now if done is None else done.unionByName(asked_now))
        turn = min(8 * turn, pivots)


def drop_near_duplicates(docs: DataFrame, text: str = "text", least: float = SIMILARITY, limit: int = GROUP_LIMIT) -> DataFrame:
    """One row of docs for each group of near copies: texts that a chain of pairs, each of a similarity of ``least`` or more, ties.

    Similarity is Jaccard's, of the different five-word shingles of lower-cased texts; texts without words are alike. Shards of texts that
    share a band of MinHashes meet in BK-trees of their fingerprints, and what is within the radius is verified on the shingles.
    Rows are known by doc_id and text: of a group the one with the smallest doc_id stays, a null doc_id comes after all others, and of
    rows with one doc_id the text with the smallest hash. Of rows that are equal in both, one stays, whose
    other columns have the smallest hash. All columns pass through, whatever their names; an empty table stays empty.
    """
    key, mark = unused(docs.columns, "key", "mark")
    whole = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(mark, F.xxhash64(named(text)))
    source = whole.select(F.col(key).alias("doc_id"), F.col(mark).alias("text_hash"), named(text).alias("text"))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            rows = []
            for doc_id, text_hash, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_cells(batch.column(2))):
                hashes = np.unique(shingle_hashes(t, COPY_WORDS))
                rows.append((doc_id, text_hash, signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)), signed(majority(hashes)), band_keys(hashes)))
            if rows:
                yield batch_of(COPIES, zip(*rows))

    prints = stored(source.mapInArrow(tidied(printed), "doc_id long, text_hash long, `set` long, fp long, bands array<long>"))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    classes = stored(prints.groupBy("set").agg(F.min(row).alias("least"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    banded = classes.select("set", F.explode("bands").alias("band"))
    firsts = stored(banded.groupBy("band").agg(F.min("set").alias("a"), F.max("set").alias("z")).filter("a <> z").select("band", "a"))
    groups = stored(components(banded.join(firsts, "band").select("a", F.col("set").alias("b")).filter("a <> b")))
    forget(firsts)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.unique(shingle_hashes(t, COPY_WORDS)).tobytes() for t in binary_cells(batch.column(3))]
            yield batch_of(SETS, (*(c.to_pylist() for c in batch.columns[:3]), hashes))

    shown = classes.join(groups, F.col("set") == F.col("node")).select(F.col("component").alias("group"), "set", "fp", F.col("least.doc_id").alias("_id"), F.col("least.text_hash").alias("_text"))
    known = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_text"))
    large = stored(groups.groupBy(F.col("component").alias("group")).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("group"))
    sets = lambda shown: source.join(shown, known).select("group", "set", "fp", "text").mapInArrow(tidied(hashed), SETS_DDL)
    if large.isEmpty():
        links = _group_links(sets(shown), least)
    else:
        links = _group_links(sets(shown.join(large, "group", "left_anti")), least).unionByName(_block_links(sets(shown.join(large, "group", "left_semi")), least))
    tied = components(links)

    roots = stored(classes.join(tied, F.col("set") == F.col("node"), "left").select("set", "least", "n", F.coalesce("component", "set").alias("root")))
    best = roots.groupBy("root").agg(F.min("least").alias("best"))
    losing = stored(roots.join(best, "root").filter("n > 1 or least <> best").select("set", "best"))
    gone = stored(prints.join(losing, "set").filter(row != F.col("best")).select("doc_id", "text_hash").distinct())
    twice = stored(prints.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "text_hash"))
    for spent in (prints, classes, groups, roots, losing):
        forget(spent)
    mine = unused(whole.columns, "id", "text")

    def told(rows: DataFrame, which: DataFrame, how: str) -> DataFrame:
        which = which.toDF(*mine)
        return rows.join(which, rows[key].eqNullSafe(which[mine[0]]) & rows[mark].eqNullSafe(which[mine[1]]), how)

    columns, left = list(map(named, docs.columns)), told(whole, gone, "left_anti")
    if twice.isEmpty():
        return left.select(*columns)
    one, = unused(whole.columns, "one")
    single = told(left, twice, "left_semi").groupBy(key, mark).agg(F.min_by(F.struct(*columns), F.xxhash64(*hashable(docs))).alias(one))
    return told(left, twice, "left_anti").select(*columns).unionByName(single.select(F.col(f"{one}.*")))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
