"""Near-duplicate documents by min-max hashing.

Under each permutation (a multiplication of 64-bit shingle hashes by an odd number) both the smallest and the largest
value are kept, so K permutations give 2K signature values at half the hash evaluations; minimum and maximum each agree
with a probability equal to the Jaccard similarity of the two sets. Signatures are cut into bands; documents that share
a band are candidates, and every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barquill.functions.components import connected_components
from barquill.functions.tables import materialize
from barquill.llm.words import LOWER, Words, chunks_of, mix, randoms

BANDS, ROWS = 32, 6
#: Members of a group that are held against its pivot in one task.
PART = 256


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, and their n + 1 bounds; a shorter text is one shingle, an empty none."""
    hashed = words.hashes(LOWER)
    counts = np.diff(words.bounds)
    keep = words.whole(k)
    long = words.windows(hashed, k)[keep]
    owner = words.text[: len(keep)][keep]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        long = np.concatenate([long, words.fingerprint(hashed, 5)[short]])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        long, owner = long[order], owner[order]
    return long, np.searchsorted(owner, np.arange(words.n_texts + 1))


def signatures(shingle: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit number for each band of each set; the sets must not be empty. rows is even: pairs of minimum and maximum."""
    out = np.empty((len(bounds) - 1, bands), np.uint64)
    multipliers = randoms(77, bands * rows // 2) | np.uint64(1)
    weights = randoms(78, rows) | np.uint64(1)
    at = bounds[:-1]
    for b in range(bands):
        total = np.full(len(at), b + 1, np.uint64)
        for r in range(rows // 2):
            values = shingle * multipliers[b * rows // 2 + r]
            total += mix(np.minimum.reduceat(values, at)) * weights[2 * r]
            total += mix(np.maximum.reduceat(values, at)) * weights[2 * r + 1]
        out[:, b] = mix(total)
    return out


def _sign(k: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks_of(batch.column(1)):
                ids = batch.column(0).slice(words.first, words.n_texts)
                shingle, bounds = shingles(words, k)
                size = np.array([len(np.unique(shingle[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.int64)
                hashed = words.hashes(LOWER)
                full = np.flatnonzero(size)
                values = signatures(shingle, np.append(bounds[full], len(shingle)), bands, rows) if len(full) else np.zeros((0, bands), np.uint64)
                at = np.zeros(words.n_texts + 1, np.int32)
                at[1:] = np.cumsum((size > 0) * bands)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(values.reshape(-1).view(np.int64)))
                keys = [pa.array(words.fingerprint(hashed, seed).view(np.int64)) for seed in (21, 22)]
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(size), *keys, lists], names=["doc_id", "n_shingles", "k1", "k2", "bands"])

    return sign


def _sets(k: int, column: pa.Array, keys: np.ndarray) -> Iterator[np.ndarray | None]:
    """The shingle set of each text, in order of hash; nothing for a text whose fingerprint is not the one looked for."""
    for words in chunks_of(column):
        shingle, bounds = shingles(words, k)
        own = words.fingerprint(words.hashes(LOWER), 21).view(np.int64)
        for i in range(words.n_texts):
            yield np.unique(shingle[bounds[i] : bounds[i + 1]]) if own[i] == keys[words.first + i] else None


def _confirm(k: int, percent: int):
    """Of rows (a, part, b, k1, text), in order of the first three, the pairs (a, b) whose sets are similar enough.

    The row of a part without b is that of a itself: its set is made once and held against those of the rows after it.
    """

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, None
        for batch in batches:
            a, part, b = (batch.column(i).to_pylist() for i in range(3))
            found: list[tuple[int, int]] = []
            for i, some in enumerate(_sets(k, batch.column(4), batch.column(3).to_numpy())):
                if some is None:
                    continue
                if b[i] is None:
                    head, held = (a[i], part[i]), some
                elif head == (a[i], part[i]):
                    both = len(np.intersect1d(held, some, assume_unique=True))
                    if 100 * both >= percent * (len(held) + len(some) - both):
                        found.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in range(2)], names=["a", "b"])

    return confirm


def _spread(k: int):
    """Of rows (node, n, component, k1, text), one for each distinct shingle of the text, if k1 is the text's key."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "n", "component"]
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held, at, size = [], [], 0
            for i, some in enumerate(_sets(k, batch.column(4), batch.column(3).to_numpy())):
                if some is not None:
                    held.append(some)
                    at.append(np.full(len(some), i))
                    size += len(some)
                if held and (size >= 1 << 18 or i == batch.num_rows - 1):
                    rows = np.concatenate(at)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[rows]) for x in columns), pa.array(np.concatenate(held).view(np.int64))], names=[*names, "shingle"])
                    held, at, size = [], [], 0

    return spread


def _prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may be similar enough; none that is similar enough is left out.

    A node's shingles are put in order of how many nodes have them. Two sets that are similar enough share one of the
    first (100 - percent) % of each, and from the first that they share on must have enough shingles left for the
    overlap that their sizes ask for. What is rare comes first, so a passage that very many nodes share does not pair
    those that differ elsewhere. Components are paired before nodes are, so what the members of one component share
    among themselves is never met pair by pair; both joins emit a row only if these bounds can hold.
    """
    sets = materialize(sets.distinct(), "sets")
    often = sets.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    rows = sets.join(often, "shingle")
    own = Window.partitionBy("node")
    rows = rows.withColumn("place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "shingle")) - 1)
    rows = rows.where(F.col("place") * 100 <= F.col("n") * (100 - percent)).select("shingle", "node", "n", "component", "place")
    rows = materialize(rows.withColumn("left", F.col("n") - F.col("place")).drop("place"), "prefixes", sets.count())
    cells = rows.groupBy("shingle", "component").agg(F.min("n").alias("n"), F.max("left").alias("left"))
    enough = F.least("a_left", "b_left") * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent
    named = lambda table, side, *others: table.select("shingle", *(F.col(c).alias(f"{side}_{c}") for c in (*others, "component", "n", "left")))
    met = named(cells, "a").join(named(cells, "b"), "shingle").where((F.col("a_component") < F.col("b_component")) & enough)
    met = met.select("shingle", "a_component", "b_component")
    pairs = met.join(named(rows, "a", "node"), ["shingle", "a_component"]).join(named(rows, "b", "node"), ["shingle", "b_component"]).where(enough)
    return pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def with_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with k1 and k2, the fingerprints of the words of its text, A-Z lower-cased."""
    at, names = docs.columns.index("text"), [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
            for words in chunks_of(batch.column(at)):
                hashed = words.hashes(LOWER)
                for keys, seed in zip(found, (21, 22), strict=True):
                    keys.append(words.fingerprint(hashed, seed).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.concatenate(x)) for x in found)], names=[*names, "k1", "k2"])

    plain = docs.toDF(*names)  # names that mapInArrow cannot read may be among them
    return plain.mapInArrow(run, StructType([*plain.schema, StructField("k1", LongType()), StructField("k2", LongType())])).toDF(*docs.columns, "k1", "k2")


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, bands: int = BANDS, rows: int = ROWS, keys: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents are linked if ``100 * |A and B| >= percent * |A or B|`` for their sets of k-word shingles, A-Z
    lower-cased; component_id is the smallest doc_id that links lead to, and kept says that it is the document's own.
    A text of fewer than k words is one shingle; null, empty and blank texts have none and are linked with nothing.
    Rows with a null doc_id come back with a null component, kept. Repeated rows come back as often as they came. With
    ``keys`` k1 and k2 (as of ``with_keys``) and ``group``, a number of the linked texts whatever their doc_id, are added.

    With 32 bands of 6 values a pair at similarity 0.85 shares no band with probability 3e-7, at 0.8 with 6e-5.

    Exact copies are folded into one node first. In each shared band all members are compared with one pivot, the one
    that meets most others over all its bands (most like what the group was copied from), so that a group of m members
    costs m comparisons; 256 of them at a time meet the pivot's set, which is made once for them. Links found give components. Among the nodes of
    bands that still hold several components, an exact filter on rare shingles and sizes then finds every further pair
    that can be similar enough, so that no link between components is lost; pairs inside one component need none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = docs.mapInArrow(_sign(k, bands, rows), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")
    signed = materialize(signed, "signed")
    nodes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2")
    nodes = nodes.agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    members = materialize(banded.join(shared, "band"), "members")
    known = members.groupBy("node").agg(F.sum("m").alias("met"))
    first = members.join(known, "node").groupBy("band").agg(F.max(F.struct("met", F.xxhash64("node"), "node", "n")).alias("pivot"))
    met = members.count()
    members = members.join(first.select("band", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "band")
    members = materialize(members.select("band", "node", "n", "pivot", "pivot_n"), "pivoted", met)
    alike = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    star = members.where(F.col("node") != F.col("pivot")).where(alike(F.col("n"), F.col("pivot_n")))
    star = materialize(star.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "star", met)

    who = nodes.select("node", "first_id", "k1")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("first_id"), "text")

    def links(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "pairs", met)
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        own = parts.join(who, parts["a"] == who["node"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "first_id", "k1")
        part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
        others = pairs.join(parts.where("parts > 1"), "a", "left").withColumn("part", F.coalesce(part, F.lit(0))).join(who, F.col("b") == who["node"]).select("a", "part", "b", "first_id", "k1")
        rows = own.union(others).join(texts, "first_id").select("a", "part", "b", "k1", "text")
        rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        return materialize(rows.mapInArrow(_confirm(k, percent), "a long, b long").distinct(), "links", met)

    def components(pairs: DataFrame) -> DataFrame:
        """(node, component, component_id): nodes are compared by first_id, so that a component is named by the smallest."""
        named = lambda c: who.select(F.col("node").alias(c), F.struct("first_id", "node").alias(f"{c}_named"))
        edges = pairs.join(named("b"), "b").join(named("a"), "a").select(F.col("a_named").alias("a"), F.col("b_named").alias("b"))
        return connected_components(edges).select("node.node", F.col("component.node").alias("component"), F.col("component.first_id").alias("component_id"))

    found = links(star)
    component = components(found)
    placed = members.join(component, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("component"))
    placed = materialize(placed, "placed", met)
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    open_nodes = materialize(placed.join(mixed, "band").select("node", "n", "component").distinct(), "open", met)
    sets = open_nodes.join(who, "node").join(texts, "first_id").select("node", "n", "component", "k1", "text")
    rest = _prefix_pairs(sets.mapInArrow(_spread(k), "node long, n long, component long, shingle long"), percent)
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = links(rest.join(tried, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        component = components(found.union(more))

    named = nodes.select("node", "k1", "k2", "first_id").join(component, "node", "left")
    named = named.select("k1", "k2", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("component", "node").alias("group"))
    named = materialize(named, "named")
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    of = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", of.alias("component_id"), *(("k1", "k2", "group") if keys else ())).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
