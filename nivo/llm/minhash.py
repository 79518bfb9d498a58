"""Near-duplicate documents: fast similarity sketches, banding and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nivo.llm.shared import Scratch, fresh, workers_find_package
from nivo.llm.shingles import mix, shingle_set

#: Coordinates of a sketch (a power of two up to 128), cut into bands of ROWS. At a similarity of 0.8 a pair shares
#: no band once in 20 million.
COORDINATES, ROWS = 128, 4
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: How far the share of equal coordinates may fall below the similarity asked for (odds below 1e-5).
SLACK = 0.2
#: Times that buckets of several components are held against a hashed centre.
CENTRES = 1
#: Shingles of the documents that are compared in one group.
BLOCK_SHINGLES = 1 << 17
#: Shingles of decoded texts that a worker remembers.
REMEMBERED = 4 << 20


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES per set, by rounds of hashed bin placement.

    In each of the first COORDINATES rounds every element is hashed to a bin and a value, and a bin
    keeps the least value of the first round that reaches it. In the rounds after these every element goes to
    the one bin of that round, so that every bin of a set that is not empty fills. Rounds stop
    for a set once its bins are full: two or three for a long text. Round and value make the coordinate;
    two sets agree in it with the probability of their similarity, and the number
    of agreements is concentrated as for independent ones.
    """
    t = COORDINATES
    found = np.full(len(sets) * t, EMPTY, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64) * t, sizes)
    for turn in range(2 * t):
        if not len(values):
            break
        hashed = mix(values + mix(np.uint64([turn + 1])))
        coordinate = (hashed >> np.uint64(8)) | np.uint64(turn << 56)
        bins = (hashed & np.uint64(t - 1)).astype(np.int64) if turn < t else turn - t
        np.minimum.at(found, owner + bins, coordinate)
        open_sets = (found.reshape(-1, t) == EMPTY).any(axis=1)
        stay = open_sets[owner // t]
        values, owner = values[stay], owner[stay]
    return found.reshape(-1, t)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A hash per band."""
    bands = sketches.reshape(len(sketches), -1, ROWS)
    key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2])
    for row in range(ROWS):
        key = mix(key * np.uint64(3) + bands[:, :, row])
    return key.view(np.int64)


def brief(sets: list[np.ndarray]) -> list[bytes]:
    """Sketches for comparisons: 16 bits of each coordinate and 32 of each band's key."""
    rows = sketch(sets)
    coordinates, keys = rows.astype(np.uint16), band_keys(rows).astype(np.uint32)
    return [a.tobytes() + b.tobytes() for a, b in zip(coordinates, keys)]


def _in_parts(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices whose texts (the last column) have about ``most`` bytes."""
    texts = batch.column(batch.num_columns - 1)
    start, size = 0, 0
    for row, text in enumerate(texts):
        size += len(text.as_buffer()) if text.is_valid else 0
        if size >= most:
            yield batch.slice(start, row + 1 - start)
            start, size = row + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _in_parts(whole):
                sets = [shingle_set(text, width) for text in batch.column(2).to_pylist()]
                keys = band_keys(sketch(sets)) if sets else np.empty((0, COORDINATES // ROWS), np.int64)
                lists = pa.ListArray.from_arrays(
                    np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel())
                )
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(prints, pa.binary()),
                        lists,
                    ],
                    names=["id", "print", "n", "same", "bands"],
                )

    return run


def _packer(width: int):
    """Texts in compressed form, with their sketches: less than half of what their shingles take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for whole in batches:
            for batch in _in_parts(whole):
                texts = batch.column(1).to_pylist()
                sets = [shingle_set(text, width) for text in texts]
                raw = [text.encode("utf-8", "surrogatepass") for text in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([len(r) for r in raw], pa.int64()),
                        pa.array([codec.compress(r, asbytes=True) for r in raw], pa.binary()),
                        pa.array(brief(sets), pa.binary()),
                    ],
                    names=["id", "n", "bytes", "body", "sketch"],
                )

    return run


class Unpacker:
    """Shingle sets of packed texts; those of REMEMBERED shingles at most are kept by id."""

    def __init__(self, width: int):
        self.width, self.codec, self.held, self.size = width, pa.Codec("zstd"), {}, 0

    def __call__(self, id_: int, n_bytes: int, body: pa.Buffer) -> np.ndarray:
        if id_ not in self.held:
            raw = self.codec.decompress(body, n_bytes, asbytes=True)
            found = shingle_set(raw.decode("utf-8", "surrogatepass"), self.width)
            if self.size + len(found) > REMEMBERED:
                self.held.clear()
                self.size = 0
            self.held[id_] = found
            self.size += len(found)
        return self.held[id_]


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two shingle sets have a similarity of ``percent`` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmer(width: int, percent: int):
    """The pairs ``u, v`` whose full sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Unpacker(width)
        for batch in batches:
            u, v, bytes_u, bytes_v = [batch.column(i).to_numpy() for i in range(4)]
            body_u, body_v = batch.column(4), batch.column(5)
            good = [
                alike(
                    sets(int(u[i]), int(bytes_u[i]), body_u[i].as_buffer()),
                    sets(int(v[i]), int(bytes_v[i]), body_v[i].as_buffer()),
                    percent,
                )
                for i in range(batch.num_rows)
            ]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


class _Block:
    """Rows of one block, gathered from consecutive batches."""

    def __init__(self, unpack: Unpacker):
        self.unpack = unpack
        self.ids, self.components, self.owns, self.sizes, self.sketches, self.packed = [], [], [], [], [], []

    def add(self, batch: pa.RecordBatch) -> None:
        self.ids.append(batch.column("id").to_numpy())
        self.components.append(batch.column("component").to_numpy())
        self.owns.append(batch.column("own").to_numpy())
        self.sizes.append(batch.column("n").to_numpy())
        self.sketches += [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column("sketch")]
        bodies = [x.as_buffer() for x in batch.column("body")]
        self.packed += zip(batch.column("bytes").to_pylist(), bodies)

    def links(self, band: int, low: int, across: bool, percent: int) -> list[tuple[int, int]]:
        """Links between documents that are not in one component yet."""
        ids, own = np.concatenate(self.ids), np.concatenate(self.owns)
        component, sizes = np.concatenate(self.components), np.concatenate(self.sizes)
        packed = np.stack(self.sketches)
        rows = np.ascontiguousarray(packed[:, : 2 * COORDINATES]).view(np.uint16)
        keys = np.ascontiguousarray(packed[:, 2 * COORDINATES :]).view(np.uint32)
        found = []
        for at in range(len(rows)):
            if across and own[at] != low:
                continue
            may = (component != component[at]) & ((own != low) if across else (ids > ids[at]))
            may &= 100 * np.minimum(sizes, sizes[at]) >= percent * np.maximum(sizes, sizes[at])
            may = np.flatnonzero(may)
            # A pair is looked at in the first band it shares only.
            may = may[~(keys[may, :band] == keys[at, :band]).any(axis=1)]
            for other in may[(rows[may] == rows[at]).mean(axis=1) >= percent / 100 - SLACK]:
                if component[other] == component[at]:
                    continue
                mine, theirs = [self.unpack(int(ids[i]), *self.packed[i]) for i in (at, other)]
                if alike(mine, theirs, percent):
                    found.append((int(min(ids[at], ids[other])), int(max(ids[at], ids[other]))))
                    component[component == component[other]] = component[at]
        return found


def _linker(width: int, percent: int):
    """Links of the blocks of a partition sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, unpack = None, None, Unpacker(width)

        def done() -> pa.RecordBatch:
            band, _, low, high = held
            found = block.links(band, low, low != high, percent)
            u, v = ([u for u, _ in found], [v for _, v in found])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("band", "bucket", "low", "high")], axis=1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                now = tuple(keys[start].tolist())
                if now != held:
                    if held is not None:
                        yield done()
                    held, block = now, _Block(unpack)
                block.add(batch.slice(start, end - start))
        if held is not None:
            yield done()

    return run


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """``id`` and ``component``, the least id reachable over the links ``u, v``; roots have no row.

    Alternating large and small stars: each round hangs the neighbours of a node on its least
    one, until a round changes nothing. Rounds grow with the logarithm of the longest path; each is
    a written table, so neither lineage nor driver holds the graph.
    """
    ordered = links.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
    edges = scratch.write(ordered.where("a <> b").distinct(), f"{name}-0")
    state = F.struct(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a") % 1_000_003))
    last, turn = tuple(edges.agg(state.alias("s")).first()["s"]), 0
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = scratch.write(large, f"{name}-{turn}-large")
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(small_least, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small_least)
            .distinct()
        )
        turn += 1
        small = scratch.write(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}", f"{name}-{turn - 1}-large")
        now = tuple(small.agg(state.alias("s")).first()["s"])
        if now == last:
            return small.select(F.col("a").alias("id"), F.col("b").alias("component"))
        edges, last = small, now


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, text: Column | None = None, key: str = "doc_id"
) -> DataFrame:
    """A row per document: ``id, print, n_shingles, component_id, kept`` (``print``: hash of the text).

    Documents are linked if the sets of their ``width``-word shingles have a similarity of ``percent``
    or more; a component is all that links reach, and the document with its least id is kept.

    1. A pass sketches each text. Documents with equal sets become one node, the least id.
    2. Nodes that share a band form a bucket. Each node is verified against the least of its
       buckets' least nodes: one pair a node, which joins most groups.
    3. Buckets that still hold several components verify each node against a hashed centre,
       unless both are in one component; CENTRES times.
    4. In what then still holds several components, the largest one is compared with the others and these with
       each other, in blocks of bounded size: by sketches first, pairs that can be similar enough by
       their sets.

    What is verified moves as compressed texts, whose sets are built where a pair is looked at.

    So no bucket is ever gathered or expanded into all pairs, and none is cut short: pairs
    are left out only if they were verified before or their documents are in one component already.
    Verification intersects full shingle sets.

    NULL and blank texts have no shingles and are linked with nothing. Rows with NULL keys are
    not linked and kept. Repeated rows are one document, kept or dropped together. An empty
    table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    workers_find_package(spark)
    scratch = Scratch(spark, "minhash")
    body = F.col("text") if text is None else text
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(body).alias("print"), body.alias("body")
    )
    schema = "id long, print long, n long, same binary, bands array<long>"
    sketched = scratch.write(rows.mapInArrow(_sketcher(width), schema), "sketched")
    grouped = sketched.where("n > 0 AND id IS NOT NULL")
    nodes = scratch.write(
        grouped.groupBy("same")
        .agg(F.min(F.struct("id", "n", "bands")).alias("node"), F.count(F.lit(1)).alias("copies"))
        .select("same", "copies", "node.*"),
        "nodes",
    )
    banded = nodes.select("id", "n", F.posexplode("bands").alias("band", "bucket"))
    # Nodes that are alike share many bands; of buckets with the same members one is enough.
    contents = [F.bit_xor(F.xxhash64("id", F.lit(turn))).alias(f"x{turn}") for turn in (1, 2)]
    shared = (
        banded.groupBy("band", "bucket")
        .agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("centre"), *contents)
        .where("members > 1")
        .groupBy("members", "centre", "x1", "x2")
        .agg(F.min(F.struct("band", "bucket")).alias("one"))
        .select("members", "centre", "one.*")
    )
    members = scratch.write(banded.join(shared, ["band", "bucket"]), "members")

    # Written, so that Spark knows its size: where it is small, no text is shuffled to be picked out.
    wanted = scratch.write(members.select("id").distinct(), "wanted")
    bodies = scratch.write(
        rows.select("id", "body")
        .join(wanted, "id", "left_semi")
        .groupBy("id")
        .agg(F.min("body").alias("body"))
        .mapInArrow(_packer(width), "id long, n long, bytes long, body binary, sketch binary"),
        "bodies",
    )

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs u < v whose sets are similar enough."""
        sides = [
            bodies.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "bytes", "body")])
            for x in "uv"
        ]
        near = 100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")
        both = (
            pairs.select("u", "v")
            .join(sides[0], "u")
            .join(sides[1], "v")
            .where(near)
            .select("u", "v", "bytes_u", "bytes_v", "body_u", "body_v")
        )
        return scratch.write(both.mapInArrow(_confirmer(width, percent), "u long, v long"), name)

    def pair_of(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]

    first = members.where("id <> centre").groupBy("id").agg(F.min("centre").alias("centre"))
    tested = scratch.write(first.select(*pair_of("id", "centre")).distinct(), "tested-1")
    links = verified(tested, "links-1")
    found = components(scratch, links, "components-1")

    def mixed(turn: int, least: int = 2) -> DataFrame:
        """Members of buckets with several components, with the bucket's largest and a hashed centre."""
        now = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        now = scratch.write(now.drop("centre", "members"), f"labelled-{turn}")
        centre = F.min(F.struct(F.xxhash64("id", "band", F.lit(turn)).alias("h"), "id", "component"))
        parts = now.groupBy("band", "bucket", "component").agg(
            F.count(F.lit(1)).alias("members"), F.sum("n").alias("size"), centre.alias("centre")
        )
        buckets = (
            parts.groupBy("band", "bucket")
            .agg(
                F.max(F.struct("members", "component", "size")).alias("main"),
                F.sum("size").alias("size"),
                F.min("centre").alias("centre"),
                F.count(F.lit(1)).alias("components"),
                F.sum("members").alias("members"),
            )
            .where(f"components > 1 AND members >= {least}")
            .drop("components", "members")
        )
        return now.join(buckets, ["band", "bucket"])

    waves, tests = [links], [tested]
    for turn in range(2, 2 + CENTRES):
        pairs = (
            mixed(turn)
            .where(F.col("component") != F.col("centre.component"))
            .select(*pair_of("id", "centre.id"))
            .distinct()
        )
        for earlier in tests:
            pairs = pairs.join(earlier, ["u", "v"], "left_anti")
        tests.append(scratch.write(pairs, f"tested-{turn}"))
        waves.append(verified(tests[-1], f"links-{turn}"))
        found = components(scratch, reduce(DataFrame.union, waves), f"components-{turn}")

    # What is left is compared in blocks: the largest component's members with the others, and these
    # with each other. Blocks have a bounded number of shingles, or are one document's.
    # A bucket that fits a block is one.
    fits = F.col("size") <= BLOCK_SHINGLES
    main = (F.col("component") == F.col("main.component")) & ~fits
    n_main = F.when(fits, 0).otherwise(F.ceil(F.col("main.size") / BLOCK_SHINGLES))
    n_rest = F.when(fits, 1).otherwise(F.ceil((F.col("size") - F.col("main.size")) / BLOCK_SHINGLES))
    hashed = F.xxhash64("id")
    blocks = (
        mixed(0, least=3)  # The pair in a bucket of two was verified with its centre.
        .withColumn("n_main", n_main)
        .withColumn("n_rest", n_rest)
        .withColumn(
            "own",
            F.when(main, F.pmod(hashed, "n_main")).otherwise(F.col("n_main") + F.pmod(hashed, "n_rest")),
        )
        .withColumn(
            "other",
            F.explode(
                F.sequence(
                    F.when(main, F.col("n_main")).otherwise(F.lit(0).cast("long")), F.col("n_main") + F.col("n_rest") - 1
                )
            ),
        )
        .select(
            F.col("band").cast("long").alias("band"),
            "bucket",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            "own",
            "id",
            "component",
        )
        .join(bodies, "id")
    )
    block = ["band", "bucket", "low", "high"]
    last = (
        blocks.repartition(*block)
        .sortWithinPartitions(*block)
        .mapInArrow(_linker(width, percent), "u long, v long")
    )
    waves.append(scratch.write(last.distinct(), "links-0"))
    found = components(scratch, reduce(DataFrame.union, waves), "components-0")

    classes = scratch.write(
        nodes.select("same", "id", "copies")
        .join(found, "id", "left")
        .where("copies > 1 OR component IS NOT NULL")
        .select("same", F.coalesce("component", "id").alias("component_id")),
        "classes",
    )
    # Blank texts all have one fingerprint; without one they meet no class.
    labels = sketched.select(
        "id", "print", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("same")).alias("same")
    )
    lone = labels.where("same IS NULL").select("id", "print", "n", F.col("id").alias("component_id"))
    rest_of = labels.where("same IS NOT NULL").join(classes, "same", "left")
    linked = rest_of.select("id", "print", "n", F.coalesce("component_id", "id").alias("component_id"))
    turns = range(2 + CENTRES)
    scratch.drop("nodes", "members", "wanted", "bodies", *[f"{t}-{n}" for t in ("tested", "links", "labelled") for n in turns])
    return linked.union(lone).select(
        "id",
        "print",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def deduplicate(
    docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns."""
    found = near_duplicates(docs, width, percent, F.col(f"`{text}`"), key)
    id_, print_ = fresh("_id", docs), fresh("_print", docs)
    dropped = found.where(~F.col("kept")).select(F.col("id").alias(id_), F.col("print").alias(print_))
    same = (F.col(f"`{key}`").cast("long") == F.col(id_)) & (
        F.xxhash64(F.col(f"`{text}`")) == F.col(print_)
    )
    return docs.join(dropped, same, "left_anti")
