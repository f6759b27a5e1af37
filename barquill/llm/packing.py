"""Documents packed, in order, into sequences of a fixed number of tokens."""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SIZE, END_ID = 2048, 1
#: What a cut inside a document costs, in tokens of padding: after a sentence, and elsewhere.
AFTER_SENTENCE, ELSEWHERE = 8, 128
#: Tokens that are planned together; what follows the last cut of a plan goes into the next one.
PLAN_TOKENS = 1 << 18
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_level(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """A byte-level BPE read from a tokenizers file, and for each id whether it ends a sentence.

    The ids are those of the ``tokenizers`` library (merges are numbered in the order of the vocabulary, which is
    checked); tiktoken applies them about four times as fast.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pairs = (x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"])
    merged = [spec["model"]["vocab"]["".join(x)] for x in pairs]
    if merged != sorted(merged):
        raise ValueError(f"{path}: ids don't follow the order of the merges")
    ends = np.zeros(max([*ranks.values(), *special.values(), END_ID]) + 1, bool)
    for token, i in ranks.items():
        ends[i] = b"\n" in token or token.strip().rstrip(b"\"')]").endswith((b".", b"!", b"?"))
    return tiktoken.Encoding("byte_level", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special), ends


@functools.cache
def encoder(path: str) -> tuple[Callable[[str], np.ndarray], np.ndarray]:
    """A function from texts to ids, and for each id whether it ends a sentence.

    A process makes it once, for all its tasks. tiktoken's regular expression gives up on about a million characters of white space in a row; such a text goes to the
    ``tokenizers`` library, whose ids are the same.
    """
    fast, ends = byte_level(path)
    slow: list[Tokenizer] = []

    def ids(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if not slow:
                slow.append(Tokenizer.from_file(path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return ids, ends


def cuts(pos: list[int], penalty: list[int], size: int = SIZE) -> list[int]:
    """Indices of the cuts, the last included, that cost least.

    ``pos`` are ascending places to cut, the first 0 and no two neighbours over ``size`` apart; ``penalty`` what each
    costs. A window of n tokens is padded to ``size`` unless n is a power of two. The best cost at place j is the least
    of best[i] + size - (pos[j] - pos[i]) over the places i in reach, so best[i] + pos[i] goes into a monotone queue;
    windows of a power of two are looked up besides.
    """
    at = np.asarray(pos)
    ours, theirs = [], []
    for k in range(int(size).bit_length()):
        if (1 << k) < size:
            i = np.searchsorted(at, at - (1 << k))
            j = np.flatnonzero(at[i] == at - (1 << k))
            ours.append(j)
            theirs.append(i[j])
    j = np.concatenate(ours) if ours else np.zeros(0, int)
    order = np.argsort(j, kind="stable")
    exact_j, exact_i = [*j[order].tolist(), -1], np.concatenate(theirs)[order].tolist() if len(j) else []
    best, key, back, queue, head, e = [0], [0], [0], [0], 0, 0
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[queue[head]] < p - size:
            head += 1
        i = queue[head]
        cost = key[i] + size - p
        while exact_j[e] == j:
            if best[exact_i[e]] < cost:
                i = exact_i[e]
                cost = best[i]
            e += 1
        cost += penalty[j]
        best.append(cost)
        back.append(i)
        cost += p
        key.append(cost)
        while len(queue) > head and key[queue[-1]] > cost:
            queue.pop()
        queue.append(j)
    out, j = [], len(pos) - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def plan(lengths: np.ndarray, sentence: np.ndarray, size: int = SIZE, final: bool = True) -> np.ndarray:
    """Ends of the windows of a stream of pieces of documents; ``sentence``: places after a sentence.

    With ``final``, a last window whose padding costs more than cutting it into powers of two is cut so.
    """
    total = int(lengths.sum())
    cost = {int(x): AFTER_SENTENCE for x in sentence} | {int(x): 0 for x in np.cumsum(lengths)}
    pos = np.array(sorted({0, *cost}))
    far = np.flatnonzero(np.diff(pos) > size)
    if len(far):
        more = np.concatenate([np.arange(pos[i] + size, pos[i + 1], size) for i in far])
        pos = np.sort(np.concatenate([pos, more]))
    places = pos.tolist()
    chosen = [places[j] for j in cuts(places, [cost.get(p, ELSEWHERE) for p in places], size)]
    if final and chosen:
        lo = chosen[-2] if len(chosen) > 1 else 0
        rest = total - lo
        powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        if rest < size and ELSEWHERE * (len(powers) - 1) < size - rest:
            chosen = [*chosen[:-1], *(lo + np.cumsum(powers)).tolist()]
    return np.array(chosen, np.int64)


def _pack(path: str, size: int, with_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = encoder(path)
        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, ids before these, all ids of the document, these

        def flush(final: bool) -> pa.RecordBatch:
            nonlocal held, sequence
            lengths = np.array([len(x[3]) for x in held], np.int64)
            stream = np.concatenate([x[3] for x in held])
            to = plan(lengths, np.flatnonzero(ends[stream]) + 1, size, final)
            keep = to if final else to[:-1]
            done = int(keep[-1]) if len(keep) else 0
            doc_at = np.concatenate([[0], np.cumsum(lengths)])
            edge = np.unique(np.concatenate([doc_at[doc_at <= done], keep, [0]]))
            lo, hi = edge[:-1], edge[1:]
            doc, window = np.searchsorted(doc_at, lo, "right") - 1, np.searchsorted(keep, lo, "right")
            first = np.concatenate([[0], keep])[:-1]
            filled = np.diff(np.concatenate([[0], keep]))
            raw = stream.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            before = np.array([x[1] for x in held], np.int64)
            columns = {
                "doc_id": pa.array([held[i][0] for i in doc.tolist()], pa.int64()), "start": pa.array(lo - doc_at[doc] + before[doc]), "length": pa.array(hi - lo),
                "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(np.array([x[2] for x in held], np.int64)[doc]),
                "sequence_id": pa.array(window + sequence), "offset": pa.array(lo - first[window] if len(lo) else lo),
                "padded_to": pa.array(np.where(filled & (filled - 1), size, filled)[window] if len(lo) else lo),
            }
            if with_ids:
                columns["ids"] = pa.array([stream[a:b].astype(np.int32) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.list_(pa.int32()))
            sequence += len(keep)
            rest = []
            if done < len(stream):
                i = int(np.searchsorted(doc_at, done, "right")) - 1
                skip = done - int(doc_at[i])
                rest = [(held[i][0], held[i][1] + skip, held[i][2], held[i][3][skip:]), *held[i + 1 :]]
            held = rest
            return pa.RecordBatch.from_pydict(columns)

        waiting = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), END_ID)
                    held.append((doc_id, 0, len(ids), ids))
                    waiting += len(ids)
                    if waiting >= PLAN_TOKENS:
                        yield flush(False)
                        waiting = sum(len(x[3]) for x in held)
        if held:
            yield flush(True)

    return pack


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Pack the texts of ``docs`` (doc_id, text) into sequences of at most ``size`` tokens.

    A document's ids are those of its text and then 1; a null text is as an empty one, so every row gives at least one
    id; a text of any length is read whole, and columns other than doc_id and text are ignored. Rows keep their order inside each partition, and repeated rows and null doc_ids are documents like any other.
    Cuts are chosen by dynamic programming at ends of documents or sentences (anywhere in a passage with neither for a
    whole sequence), so that padding plus a penalty for each cut inside a document is least.

    Returns a row for each piece: doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens,
    sequence_id, offset (in the sequence), padded_to (of the sequence; ``size``, or its length if a power of two) and,
    with ``with_ids``, the ids. No shuffle: each partition is one stream, planned a bounded number of tokens at a time,
    so a task that runs again gives the same sequences if the partition's rows come in the same order, as they do from
    files.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack(tokenizer, size, with_ids), schema + ", ids array<int>" * with_ids)
