"""Passages that documents repeat, by prefix-partitioned suffix trees.

A suffix is a text from one of its words on, taken to the depth of a window, as deep as the rule for repeats asks. Two
rounds find those that meet another. The first leaves out, by fingerprints, every suffix that has no company at that
depth; equal words have equal fingerprints, so none that has company is lost. The second sends the others, with their
words, to groups by their first words: by one word where few suffixes begin with it, by two, four or more where many do,
so that a group fits in memory. In a group the suffixes are put in order of their words, and what each shares with the
one before (the depth of the node where they part) gives the tree's internal nodes; a node at the depth of a window is a
repeat. Nodes of neighbouring suffixes of a text join into its maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquill.llm.words import Words, chunks_of, words_of

#: Suffixes that begin with the prefixes of a group, at most about, before those without company are left out; windows
#: that are compared by fingerprint in one bucket, about; bytes of text that one chunk of documents holds, about.
GROUP_SUFFIXES, BUCKET_WINDOWS, CHUNK_BYTES = 1 << 19, 1 << 20, 8 << 20
#: Counters for each length of prefix: so many for each group, within these limits (powers of two), in so many parts.
CELLS_A_GROUP, LEAST_CELLS, MOST_CELLS, PARTS = 16, 12, 20, 16
#: Bits of a fingerprint, beside its bucket.
BITS = 28


def prefix_lengths(window: int) -> list[int]:
    return sorted({min(x, window) for x in (1, 2, 4, 8, window)})


def _cells(words: Words, hashed: np.ndarray, keep: np.ndarray, length: int, cells: int) -> np.ndarray:
    """The counter of the first ``length`` words of each suffix in ``keep``, of ``1 << cells``."""
    return (words.windows(hashed, length)[: len(keep)][keep] >> np.uint64(64 - cells)).astype(np.int64)


def _count(window: int, cells: int):
    """Suffixes by the counter of their first words, a part of the counters of one length to a row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = prefix_lengths(window)
        total = np.zeros((len(lengths), 1 << cells), np.int64)
        for batch in batches:
            for words in chunks_of(batch.column(0)):
                hashed, keep = words.hashes(), words.whole(window)
                for i, length in enumerate(lengths):
                    total[i] += np.bincount(_cells(words, hashed, keep, length, cells), minlength=1 << cells)
        parts = total.reshape(len(lengths) * PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "counts"])

    return count


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, total = None, 0
    for batch in batches:
        part = batch.column(0)[0].as_py()
        for x in batch.column(1).to_pylist():
            total = total + np.frombuffer(x, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])


def routes(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each prefix length and cell the group of suffixes, or -1 where the prefix is to be taken longer; and for each
    cell of the longest prefix the groups, from that one on, that its suffixes are dealt to by the whole of their words."""
    out = np.full(counts.shape, -1, np.int64)
    group = 0
    for level in range(len(counts) - 1):
        cells = np.flatnonzero(counts[level] <= most)
        out[level, cells] = group + np.cumsum(counts[level, cells]) // most
        group = int(out[level].max(initial=group)) + 1
    out[-1] = group + (np.cumsum(counts[-1]) - counts[-1]) // most
    return out.astype(np.int32), (1 + counts[-1] // most).astype(np.int32)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts; rows of a batch that are equal become one with a count."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            rows: dict[tuple, int] = {}
            for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                rows[row] = rows.get(row, 0) + 1
            chunk, ids, texts = zip(*rows, strict=True) if rows else ((), (), ())
            body = pa.array([pack.compress((x or "").encode()) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(ids, pa.int64()), pa.array(rows.values(), pa.int64()), body], names=["chunk", "doc_id", "n", "body"])


class Chunk:
    """Documents of one chunk in order of doc_id, then text, and the classes of equal windows in them."""

    def __init__(self, table: pa.Table, window: int):
        unpack = zstandard.ZstdDecompressor()
        rows = zip(table.column("doc_id").to_pylist(), (unpack.decompress(x) for x in table.column("body").to_pylist()), table.column("n").to_pylist(), strict=True)
        rows = sorted(rows)
        self.ids, self.n = np.array([x[0] for x in rows], np.int64), np.array([x[2] for x in rows], np.int64)
        at = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(x[1]) + 1 for x in rows], out=at[1:])
        data = np.frombuffer(b"".join(x[1] + b"\n" for x in rows), np.uint8)
        self.window, self.words = window, words_of(data, at)
        self.hashed = self.words.hashes()
        # every word followed by one space
        self.to = np.concatenate([[0], np.cumsum(self.words.end - self.words.start + 1)])
        keep = np.zeros(len(data) + 1, np.int8)
        keep[self.words.start] = 1
        keep[self.words.end + 1] -= 1
        flat = self.words.data[np.cumsum(keep[:-1]) > 0].copy()
        flat[self.to[1:] - 1] = 32
        self.flat = flat.tobytes()
        #: word at which each window starts; the class of each; and the window that is the first of each class
        self.at = np.flatnonzero(self.words.whole(window))
        full = self.words.windows(self.hashed, window)[self.at]
        self.fingerprint, self.first, index = np.unique(full, return_index=True, return_inverse=True)
        self.index = index.reshape(-1)
        self._part_unequal(full)

    def text(self, place: int) -> bytes:
        """The words of the window at a place, each followed by a space but the last."""
        return self.flat[self.to[place] : self.to[place + self.window] - 1]

    def _part_unequal(self, full: np.ndarray) -> None:
        """Windows are of one class only if their words are equal; what only has an equal hash gets a class of its own."""
        head = self.at[self.first[self.index]]
        later = np.flatnonzero(head != self.at)
        flat, to, window = self.flat, self.to.tolist(), self.window
        wrong = [i for i, a, b in zip(later.tolist(), self.at[later].tolist(), head[later].tolist(), strict=True) if flat[to[a] : to[a + window]] != flat[to[b] : to[b + window]]]
        more: dict[bytes, int] = {}
        heads = []
        for i in wrong:
            text = self.text(self.at[i])
            if text not in more:
                more[text] = len(self.first) + len(heads)
                heads.append(i)
            self.index[i] = more[text]
        if heads:
            self.fingerprint = np.append(self.fingerprint, full[heads])
            self.first = np.append(self.first, heads)


def _bucketed(chunk: Chunk, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and the classes of windows whose fingerprints are dealt to it, in order of their first bits."""
    bucket = ((chunk.fingerprint & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((chunk.fingerprint, bucket))
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=False):
        yield int(bucket[order[lo]]), order[lo:hi]


def _fingerprints(window: int, buckets: int):
    """One row for each bucket that a chunk has windows in: the first bits of each, once, whatever the chunk's repeats."""

    def fingerprints(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        rows = [(b, _small((chunk.fingerprint[x] >> np.uint64(64 - BITS)).astype(np.int64))) for b, x in _bucketed(chunk, buckets)]
        name = table.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array([x[0] for x in rows], pa.int64()), "chunk": pa.array([name] * len(rows), pa.int64()), "windows": pa.array([x[1] for x in rows], pa.binary())})

    return fingerprints


def _company(batch: pa.Table) -> pa.Table:
    """For each chunk of a bucket one bit for each of its windows: whether another chunk may have it."""
    batch = batch.combine_chunks()
    windows = [_large(x) for x in batch.column("windows").to_pylist()]
    every = np.concatenate(windows)
    order = np.argsort(every, kind="stable")
    equal = every[order[1:]] == every[order[:-1]]
    met = np.zeros(len(every), bool)
    met[order[1:][equal]] = True
    met[order[:-1][equal]] = True
    bits = np.split(met, np.cumsum([len(x) for x in windows])[:-1])
    some = [i for i, x in enumerate(bits) if x.any()]
    return pa.table({
        "chunk": batch.column("chunk").take(pa.array(some, pa.int64())), "bucket": batch.column("bucket").take(pa.array(some, pa.int64())),
        "bits": pa.array([np.packbits(bits[i]).tobytes() for i in some], pa.binary()),
    })


def _suffixes(window: int, buckets: int, table: np.ndarray, spread: np.ndarray, cells: int):
    """One row for each group that a chunk has suffixes with company in: their places, words, and smallest doc_ids."""

    def suffixes(docs: pa.Table, bits: pa.Table) -> pa.Table:
        names = ["group", "chunk", "places", "docs", "suffixes"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        if not bits.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        chunk = Chunk(docs, window)
        told = dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), strict=True))
        some = [x[np.unpackbits(np.frombuffer(told[b], np.uint8), count=len(x)).astype(bool)] for b, x in _bucketed(chunk, buckets) if b in told]
        place = np.sort(chunk.at[chunk.first[np.concatenate(some)]])
        words = chunk.words
        keep = np.zeros(max(0, len(words.text) - window + 1), bool)
        keep[place] = True
        group = np.full(len(place), -1, np.int64)
        for level, length in enumerate(prefix_lengths(window)):
            left = np.flatnonzero(group < 0)
            cell = _cells(words, chunk.hashed, keep, length, cells)[left]
            group[left] = table[level, cell]
            if level == len(table) - 1:
                full = words.windows(chunk.hashed, window)[place[left]]
                group[left] += ((full & np.uint64(0xFFFFFFFF)) % spread[cell].astype(np.uint64)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        group, place = group[order], place[order]
        owner = chunk.ids[words.text[place]]
        cut = np.flatnonzero(np.diff(group, prepend=-1))
        pack = zstandard.ZstdCompressor(level=3)
        flat, lo_at, hi_at = chunk.flat, chunk.to[place].tolist(), (chunk.to[place + window] - 1).tolist()
        columns: list[list] = [[], [], [], []]
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(group)], strict=False):
            columns[0].append(int(group[lo]))
            columns[1].append(_small(place[lo:hi]))
            columns[2].append(pack.compress(np.diff(owner[lo:hi], prepend=0).tobytes()))
            columns[3].append(pack.compress(b"\n".join([flat[a:b] for a, b in zip(lo_at[lo:hi], hi_at[lo:hi], strict=True)])))
        name = docs.column("chunk")[0].as_py()
        return pa.table([pa.array(columns[0], kinds[0]), pa.array([name] * len(cut), kinds[1]), *(pa.array(x, pa.binary()) for x in columns[1:])], names=names)

    return suffixes


_FULL = 0xFFFF


def _small(numbers: np.ndarray) -> bytes:
    """Ascending numbers as the steps between them in two bytes each, with a filler for each 65,535 on the way, or, if
    that would be longer, in eight; the first byte says which."""
    steps = np.diff(numbers, prepend=0)
    fill = steps // _FULL
    if fill.sum() > 3 * len(steps):
        return b"\10" + numbers.astype("<i8").tobytes() if numbers.max(initial=0) >> 32 else b"\4" + numbers.astype("<u4").tobytes()
    out = np.full(len(steps) + int(fill.sum()), _FULL, "<u2")
    out[np.cumsum(fill + 1) - 1] = steps % _FULL
    return b"\2" + out.tobytes()


def _large(packed: bytes) -> np.ndarray:
    """The numbers that ``_small`` was given."""
    if packed[0] != 2:
        return np.frombuffer(packed, "<u4" if packed[0] == 4 else "<i8", offset=1).astype(np.int64)
    steps = np.frombuffer(packed, "<u2", offset=1)
    return np.cumsum(steps, dtype=np.int64)[steps != _FULL]


def shared_words(ordered: list[bytes], slice_of: int = 1 << 14) -> np.ndarray:
    """For each of some texts in order, how many whole words it begins with that the one before begins with, too.

    That is the depth of the node where the two part in a tree of the texts; words are parted by one space.
    """
    out = np.zeros(len(ordered), np.int64)
    for lo in range(1, len(ordered), slice_of):
        some = ordered[lo - 1 : lo + slice_of]
        size = np.array([len(x) + 1 for x in some], np.int64)
        data = np.frombuffer(b" ".join(some) + b" ", np.uint8)
        at = np.concatenate([[0], np.cumsum(size)])
        n = np.minimum(size[:-1], size[1:])
        base = np.concatenate([[0], np.cumsum(n)])
        step = np.arange(base[-1]) - np.repeat(base[:-1], n)
        equal = data[np.repeat(at[:-2], n) + step] == data[np.repeat(at[1:-1], n) + step]
        same = np.minimum.reduceat(np.where(equal, np.repeat(n, n), step), base[:-1])
        spaces = np.concatenate([[0], np.cumsum(data == 32)])
        out[lo : lo + len(n)] = spaces[at[1:-1] + same] - spaces[at[1:-1]]
    return out


def tree_nodes(suffixes: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their words, and where the internal nodes of their tree begin in it that are ``least`` deep.

    Suffixes between one beginning and the next are under one node, which shares ``least`` words or more; a suffix that
    shares fewer with its neighbours is alone.
    """
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    depth = shared_words([suffixes[i] for i in order])
    return np.array(order, np.int64), np.flatnonzero(depth < least)


def _trees(window: int):
    """The suffixes of a group that a document with a smaller doc_id has too: a row for each chunk."""

    def trees(batch: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        suffixes: list[bytes] = []
        rows, places, owners = [], [], []
        for i in range(batch.num_rows):
            suffixes += unpack.decompress(batch.column("suffixes")[i].as_py()).split(b"\n")
            places.append(_large(batch.column("places")[i].as_py()))
            owners.append(np.cumsum(np.frombuffer(unpack.decompress(batch.column("docs")[i].as_py()), np.int64)))
            rows.append(np.full(len(places[-1]), i))
        row, place, owner = (np.concatenate(x) for x in (rows, places, owners))
        order, begin = tree_nodes(suffixes, window)
        lowest = np.repeat(np.minimum.reduceat(owner[order], begin), np.diff([*begin, len(order)]))
        again = order[owner[order] > lowest]
        again = again[np.lexsort((place[again], row[again]))]
        cut = np.flatnonzero(np.diff(row[again], prepend=-1))
        found = [(batch.column("chunk")[int(row[again[lo]])].as_py(), _small(place[again[lo:hi]])) for lo, hi in zip(cut, [*cut[1:], len(again)], strict=False)]
        return pa.table({"chunk": pa.array([x[0] for x in found], pa.int64()), "places": pa.array([x[1] for x in found], pa.binary())})

    return trees


def cover(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _rows(ids, n, words: Words, gone: np.ndarray, texts: bool) -> pa.Table:
    data = words.data.tobytes()
    removed, kept, spans = [], [], []
    for lo, hi in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        off = gone[lo:hi]
        stay = np.flatnonzero(~off) + lo
        kept.append(b" ".join([data[a:b] for a, b in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]))
        removed.append(int(off.sum()))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]).astype(np.int8)))
        spans.append(edge.reshape(-1, 2).tolist())
    out = {
        "doc_id": ids, "n": n, "n_words": pa.array(np.diff(words.bounds)), "n_removed": pa.array(removed, pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        "removed_spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
    }
    return pa.table(out | ({"kept_text": pa.array(kept, pa.binary()).cast(pa.string())} if texts else {}))


def _remove(window: int, texts: bool):
    def remove(docs: pa.Table, flags: pa.Table) -> pa.Table:
        chunk = Chunk(docs, window)
        earlier = np.zeros(len(chunk.first), bool)  # by class, whether a smaller doc_id of another chunk has it
        if flags.num_rows:
            met = np.concatenate([_large(x) for x in flags.column("places").to_pylist()])
            earlier[chunk.index[np.searchsorted(chunk.at, met)]] = True
        owner = chunk.ids[chunk.words.text[chunk.at]]
        again = earlier[chunk.index] | (owner > owner[chunk.first][chunk.index]) if len(chunk.at) else np.zeros(0, bool)
        return _rows(pa.array(chunk.ids), pa.array(chunk.n), chunk.words, cover(chunk.at[again], window, len(chunk.words.text)), texts)

    return remove


def _untouched(texts: bool):
    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks_of(batch.column(1)):
                n = pa.array(np.ones(words.n_texts, np.int64))
                yield from _rows(pa.nulls(words.n_texts, pa.int64()), n, words, np.zeros(len(words.text), bool), texts).to_batches()

    return untouched


def remove_repeats(docs: DataFrame, window: int = 13, texts: bool = True, most: int = GROUP_SUFFIXES, chunk_bytes: int = CHUNK_BYTES, bucket: int = BUCKET_WINDOWS) -> DataFrame:
    """Take out of each text of ``docs`` (doc_id, text; other columns are ignored) what a smaller doc_id's text has too.

    A word goes if it is covered by ``window`` consecutive words of its text that are also found, in that order, in a
    text with a smaller doc_id; texts are compared as they came. Returns doc_id, n_words, n_removed, kept_sha256 (of the
    words that stay, joined by one space), removed_spans (from and to, in words: the maximal repeats) and, with
    ``texts``, kept_text. Null, empty and short texts have no window and stay whole; an empty table stays empty. Rows
    with a null doc_id have no order, so they stay whole and take nothing from others. Rows with the same doc_id do not
    take from each other; repeated rows come back as often as they came. A text of any length is read whole, by one task.

    Texts are dealt once into chunks of like size by a hash of doc_id and text; repeated rows are counted before that. A
    chunk sends every window it has once, so a passage that all texts share costs one entry a chunk: two to four bytes
    in the first round, and its words in the second if another chunk may have it. Equality is decided on words, in chunks
    as in groups. What the driver holds are counts of prefixes by hash: 16 for each group, at most a million (8 MB) for
    each of five lengths; where that is too few to tell prefixes apart, longer ones do, and at last the window's own words.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, windows = max(1, -(-size // chunk_bytes)), size // 6
    buckets = max(1, -(-windows // bucket))
    cells = min(max(LEAST_CELLS, (CELLS_A_GROUP * windows // most).bit_length()), MOST_CELLS)
    counted = known.select("text").mapInArrow(_count(window, cells), "part int, counts binary").groupBy("part").applyInArrow(_sum, "part int, counts binary")
    counts = np.zeros((len(prefix_lengths(window)) * PARTS, (1 << cells) // PARTS), np.int64)
    for x in counted.collect():
        counts[x.part] = np.frombuffer(x.counts, np.int64)
    counts = counts.reshape(-1, 1 << cells)
    table, spread = routes(counts, most)

    dealt = known.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long").alias("chunk"), "doc_id", "text")
    placed = dealt.mapInArrow(_place, "chunk long, doc_id long, n long, body binary")
    windows_of = placed.groupBy("chunk").applyInArrow(_fingerprints(window, buckets), "bucket long, chunk long, windows binary")
    company = windows_of.groupBy("bucket").applyInArrow(_company, "chunk long, bucket long, bits binary")
    suffixes = placed.groupBy("chunk").cogroup(company.groupBy("chunk")).applyInArrow(_suffixes(window, buckets, table, spread, cells), "group long, chunk long, places binary, docs binary, suffixes binary")
    flags = suffixes.groupBy("group").applyInArrow(_trees(window), "chunk long, places binary")
    schema = "doc_id long, n long, n_words long, n_removed long, kept_sha256 string, removed_spans array<array<long>>" + ", kept_text string" * texts
    done = placed.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(_remove(window, texts), schema)
    done = done.union(docs.where("doc_id is null").mapInArrow(_untouched(texts), schema))
    return done.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
