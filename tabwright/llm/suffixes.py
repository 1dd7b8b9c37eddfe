"""Repeated passages by ranks of sparse positions, in place of prefix doubling from every position.

Doubling with one row per byte needs seven rounds of sorts over all bytes; measured, it
shuffles several hundred times its input (see the README).

The positions are first sparse. Closed syncmers (see ``syncmers``) are anchors that
depend on their own K bytes only, and every string of THRESHOLD bytes holds one. So
each start of such a string belongs to the family of the first anchor at or after it,
and two equal strings belong to families with equal anchors. Rounds of growing length:

1. The rank of an anchor is that of its K bytes. Anchors with a unique rank go: no
   string of their family is repeated.
2. The next rank is the pair of the THRESHOLD-byte ranks at the first and the last
   start of the family, at an offset of up to K - S. Where the pair is there earlier,
   the family is past the threshold as a whole: all its starts are repeated. Where a
   rank of round 1 has one pair only, the first family with it is settled too.
3. The few families left, mostly at the ends of repeats, are taken start by start,
   with the rank of the THRESHOLD bytes themselves.

A rank is a polynomial fingerprint, so that the rank of a doubled string follows from
those of its halves where the text is, and Spark only has to sort (rank, position)
rows. Two 64-bit fingerprints must agree for strings to count as equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..operators.ordered import null_safe_join
from ..session import shuffles_dropped
from .common import Scratch, fresh, numbered, text_of
from .syncmers import BASE, _mixed, _rolling, anchors

THRESHOLD = 100
K, S = 54, 8            # 2 * K - S <= THRESHOLD: a string of that length holds an anchor, wherever it is cut
CHUNK = 1 << 18         # bytes that are hashed at a time
BACK = 64               # bytes before a block in which the previous anchor lies
SECOND = np.uint64(0xD1342543DE82EF95)
ROW = "k1 long, k2 long, d long, q long"
SORTED = "part int, kind int, k1 long, k2 long, d long, q long"
REPEATED, OPEN, FIRST, LAST = 1, 2, 3, 4
ORDER = ["k1", "k2", "d", "q"]


def _pieces(d: int, data: bytes):
    """(d, first byte's position, bytes, kept from, kept to, length): a text, or its blocks with what they need around them."""
    n = len(data)
    if n < THRESHOLD:
        return
    for at in range(0, n, CHUNK):
        low, high = max(0, at - BACK), min(n, at + CHUNK + THRESHOLD)
        yield d, low, data[low:high], at, at + CHUNK, n


def _hashes(buffer: np.ndarray, length: int, base: np.uint64 = BASE) -> np.ndarray:
    return _mixed(_rolling(buffer.astype(np.uint64) + np.uint64(1), length, base))


def _families(pieces) -> list[np.ndarray]:
    """k1, k2, d, q of the families in some pieces; q = 64 * first start + number of starts."""
    d, low, data, kept, to, n = zip(*pieces)
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    shift = np.array(low) - starts                      # position in the text minus place in the buffer
    buffer = np.frombuffer(b"".join(data), np.uint8)
    at, rank = anchors(buffer, K, S)
    piece = np.searchsorted(starts, at, "right") - 1
    inside = at + K <= ends[piece]
    at, rank, piece = at[inside], rank[inside], piece[inside]
    same = np.concatenate([[False], piece[1:] == piece[:-1]])[:len(at)]
    first = np.where(same, np.concatenate([[0], at[:-1] + 1])[:len(at)], starts[piece])
    last = np.minimum(at, np.array(n)[piece] - THRESHOLD - shift[piece])
    where = at + shift[piece]
    keep = (where >= np.array(kept)[piece]) & (where < np.array(to)[piece]) & (last >= first)
    first, last, rank, piece = first[keep], last[keep], rank[keep], piece[keep]
    longer = _hashes(buffer, THRESHOLD)
    pair = _mixed(longer[first] * BASE + longer[last] * SECOND + (last - first).astype(np.uint64))
    return [rank.view(np.int64), pair.view(np.int64), np.array(d)[piece], (first + shift[piece]) * 64 + last - first + 1]


def _batch(columns, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _chunks(pieces):
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[2])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def families(texts: DataFrame) -> DataFrame:
    """Rounds 1 and 2: ranks and position of every family in the rows (d, data)."""
    def run(batches):
        for batch in batches:
            rows = zip(batch.column("d").to_pylist(), batch.column("data"))
            for some in _chunks(piece for d, data in rows for piece in _pieces(d, data.as_py())):
                yield _batch(_families(some), ORDER)
    return texts.select("d", "data").mapInArrow(run, ROW)


def _starts(d: int, data: bytes, q: np.ndarray) -> list[np.ndarray]:
    """k1, k2, d, q of every start in families of one text."""
    first, number = q >> 6, q & 63
    at = np.repeat(first, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    at.sort()
    k1, k2 = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
    buffer = np.frombuffer(data, np.uint8)
    for low in range(0, len(data), CHUNK):
        some = slice(*np.searchsorted(at, [low, low + CHUNK]))
        if some.stop > some.start:
            block = buffer[low:low + CHUNK + THRESHOLD - 1]
            k1[some] = _hashes(block, THRESHOLD)[at[some] - low]
            k2[some] = _hashes(block, THRESHOLD, SECOND)[at[some] - low]
    return [k1.view(np.int64), k2.view(np.int64), np.full(len(at), d), at * 64 + 1]


def single_starts(texts: DataFrame, still_open: DataFrame) -> DataFrame:
    """Round 3: ranks and position of every start of the open families (d, q)."""
    def run(batches):
        for batch in batches:
            for d, data, q in zip(batch.column("d").to_pylist(), batch.column("data"), batch.column("q").to_pylist()):
                yield _batch(_starts(d, data.as_py(), np.array(q, np.int64)), ORDER)
    listed = still_open.groupBy("d").agg(F.collect_list("q").alias("q"))   # at most one entry per byte of the text
    return texts.join(listed, "d").select("d", "data", "q").mapInArrow(run, ROW)


def _mark(batches):
    """Kinds of the rows of one sorted partition, see :func:`ranked`."""
    part = TaskContext.get().partitionId()
    names = ["part", "kind", *ORDER]
    waiting = previous = None    # the first row of the last run and whether it is open; the last row
    for batch in batches:
        k1, k2, d, q = (batch.column(c).to_numpy() for c in ORDER)
        if not len(k1):
            continue
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        if previous is not None:
            new[0] = (k1[0], k2[0]) != previous
        runs = np.flatnonzero(new)
        heads = k1[runs]
        near = np.zeros(len(runs), bool)     # runs next to another one with the same first rank
        if len(runs) > 1:
            alike = heads[1:] == heads[:-1]
            near[1:] |= alike
            near[:-1] |= alike
        kind = np.where(new, 0, REPEATED)
        extra = []
        if previous is None:
            extra.append((part, FIRST, int(k1[0]), int(k2[0]), int(d[0]), int(q[0])))
            runs, near = runs[1:], near[1:]   # the partition's first row waits for the partition before
        elif len(runs):
            alike = heads[0] == previous[0]
            near[0] |= alike
            if waiting and (alike or waiting[1]):
                extra.append((part, OPEN, 0, 0, *waiting[0]))
            waiting = None
        if len(runs):
            kind[runs[:-1][near[:-1]]] = OPEN
            waiting = ((int(d[runs[-1]]), int(q[runs[-1]])), bool(near[-1]))
        previous = (int(k1[-1]), int(k2[-1]))
        told = np.flatnonzero(kind)
        zeros = np.zeros(len(told), np.int64)
        yield _batch([np.full(len(told), part, np.int32), kind[told].astype(np.int32), zeros, zeros, d[told], q[told]], names)
        if extra:
            yield _rows(extra, names)
    if previous is not None:
        # what stands at the end may go on in the next partition
        yield _rows([*([(part, OPEN, 0, 0, *waiting[0])] if waiting else []), (part, LAST, *previous, 0, 0)], names)


def _rows(rows, names) -> pa.RecordBatch:
    part, kind, *rest = (np.array(c, np.int64) for c in zip(*rows))
    return _batch([part.astype(np.int32), kind.astype(np.int32), *rest], names)


def ranked(rows: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(repeated, open) positions (d, q) after a global sort of rank and position rows.

    Of rows with equal ranks all but the first are repeated; the first is open if
    another run has its first rank, and gone otherwise. The sort is cut by ranks and
    positions, so a rank that a third of all rows share is spread over many
    partitions; the two rows that stand at the ends of each partition go through the
    driver to tell whether a run goes on across it.
    """
    ordered = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    with shuffles_dropped(rows.sparkSession):     # before the next round writes its own
        marked = scratch.keep(ordered.mapInArrow(_mark, SORTED), name)
    ends = marked.where(F.col("kind").isin(FIRST, LAST)).select("part", "kind", "k1", "k2", "d", "q").collect()
    settled, before = [], None
    for r in sorted(ends, key=lambda r: (r["part"], r["kind"])):
        if r["kind"] == FIRST:
            settled.append((REPEATED if before == (r["k1"], r["k2"]) else OPEN, r["d"], r["q"]))
        else:
            before = (r["k1"], r["k2"])
    rest = rows.sparkSession.createDataFrame(settled, "kind int, d long, q long")
    every = marked.select("kind", "d", "q").where(F.col("kind").isin(REPEATED, OPEN)).unionByName(rest)
    return tuple(every.where(F.col("kind") == kind).select("d", "q") for kind in (REPEATED, OPEN))


def repeats(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(d, q): all starts of THRESHOLD bytes that stand earlier too, in ranges of ``q & 63`` starts from ``q >> 6``.

    ``texts`` has d, which is unique and gives the order, and data (bytes).
    """
    known, still_open = ranked(families(texts), scratch, "families")
    more, _ = ranked(single_starts(texts, still_open), scratch, "starts")
    return known.unionByName(more)


def covered(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the maximal runs of bytes under the strings at the given starts."""
    low, high = q >> 6, (q >> 6) + (q & 63) - 1 + THRESHOLD
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > high[:-1]])
    return low[new], high[np.concatenate([new[1:], [True]])]


def _sequence(docs: DataFrame, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """``row`` (the input's columns), d, data and copies: one row per distinct id and text.

    d is the id itself if no two rows share one and none is null; else the number of the
    row in the order of ids (nulls last) and text digests.
    """
    key = docs.select(F.col(doc_id).cast("long").alias("id"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("id"),
                       text_of(text).cast("binary").alias("data"))
    shared = key.groupBy("id").count().where("id is null or count > 1")
    if shared.isEmpty():
        return rows.select("row", F.col("id").alias("d"), "data", F.lit(1).cast("long").alias("copies"))
    digests = docs.select(F.col(doc_id).cast("long").alias("id"), F.md5(text_of(text)).alias("digest"))
    numbers = scratch.keep(numbered(digests.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("copies")),
                                    "id", ["digest"], "d"), "numbers")
    rows = null_safe_join(rows.withColumn("digest", F.md5("data")), numbers, ["id", "digest"])
    return rows.select("row", "d", "data", "copies").dropDuplicates(["d"])


def _with_spans(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``row``, data, copies and q (list or null) per distinct id and text."""
    scratch = Scratch(docs.sparkSession)
    texts = _sequence(docs, doc_id, text, scratch)
    found = repeats(texts, scratch).groupBy("d").agg(F.collect_list("q").alias("q"))
    return texts.join(found, "d", "left")


def remove_repeats(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans per row.

    Removed is every byte under a string of THRESHOLD bytes that also starts earlier:
    in a document with a smaller id (rows without an id come last, rows of one id in
    the order of their text digests), or earlier in the same one. Of identical rows all
    but one lose everything, if they have THRESHOLD bytes. ``spans`` lists the maximal
    removed runs as (start, end) in bytes. A null text is empty. An empty table gives
    an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    joined = _with_spans(rows, "doc_id", "text").select(F.col("row.doc_id").alias("doc_id"), "data", "copies", "q")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, data, copies, q in zip(*(batch.column(c) for c in ("doc_id", "data", "copies", "q"))):
                doc_id, data, copies, q = doc_id.as_py(), data.as_py(), copies.as_py(), q.as_py()
                low, high = covered(np.array(q, np.int64)) if q else ((), ())
                kept, at = hashlib.sha256(), 0
                for a, b in zip(low, high):
                    kept.update(data[at:a])
                    at = int(b)
                kept.update(data[at:])
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(low, high)]
                row = (doc_id, len(data), int(sum(b - a for a, b in zip(low, high))), len(spans), kept.hexdigest(), spans)
                out.append(row)
                if copies > 1:
                    whole = len(data) >= THRESHOLD
                    again = (doc_id, len(data), len(data), 1, hashlib.sha256().hexdigest(), [{"start": 0, "end": len(data)}])
                    out += [again if whole else row] * (copies - 1)
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), span]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                  "spans array<struct<start: long, end: long>>")


def without_repeats(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """``docs`` with the repeated passages cut out of the texts (and ``n_chars`` renewed if it is there).

    Where a cut goes through a character, what is left of it goes too. A document that
    is a repeat as a whole stays with an empty text; of identical rows one stays.
    """
    names, left = docs.columns, fresh(docs, "_left")
    joined = _with_spans(docs, doc_id, text).select("row", "data", "q")

    def run(batches):
        for batch in batches:
            out = []
            for data, q in zip(batch.column("data"), batch.column("q")):
                data, q = data.as_py(), q.as_py()
                low, high = covered(np.array(q, np.int64)) if q else ((), ())
                parts, at = [], 0
                for a, b in zip(low, high):
                    parts.append(data[at:a])
                    at = int(b)
                parts.append(data[at:])
                out.append("".join(p.decode(errors="ignore") for p in parts) if q else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", left])

    kind = joined.schema["row"].dataType.simpleString()
    rows = joined.mapInArrow(run, f"row {kind}, {left} string")
    cut = F.coalesce(left, F.col("row")[text])
    return rows.select(*[
        cut.alias(c) if c == text else F.when(F.col(left).isNull(), F.col("row")[c]).otherwise(F.length(left)).alias(c)
        if c == "n_chars" else F.col("row")[c].alias(c) for c in names])
