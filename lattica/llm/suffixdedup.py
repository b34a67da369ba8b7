"""Exact substring deduplication by column-wise construction over many fragments at once.

A byte goes if it is covered by a LENGTH-byte string that also starts earlier in the collection (a smaller doc_id, or the same
document and an earlier start), judged on the input.

Inserting one symbol of every whole document each round would take as many rounds as the longest document has bytes, over
files as large as the collection. So the collection is first cut where it can be cut without losing a match. Every
LENGTH-byte window has an anchor, the least of its SEED-byte strings by hash (the leftmost at a tie). It depends on the
window's bytes only, so two equal windows have equal anchors at the same place. Neighbouring windows with one anchor are a
run; only runs whose anchor hash occurs twice or more can hold a match, and each is a fragment of at most 168 bytes.

Fragments that share anchors meet in one partition, aligned on the anchor. There the collection is built column by column,
from the right: each round inserts one symbol of every fragment, sorts the fragments' suffixes by it (the symbols in the
order before the round are the transform's column) and updates the common prefixes of neighbours from the minima of the
prefixes between them. A neighbour run with common prefixes of LENGTH or more is a set of equal windows: all but the first
in document order go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import SLICE, arrow_map, slices, small, utf8
from lattica.llm.hashing import BASE, UNBASE, VALUE, Spans, mix, powers
from lattica.session import materialize

LENGTH = 100
SEED = 32
REACH = LENGTH - SEED  # the anchor stands 0 to REACH bytes after its window's start
COLUMNS = LENGTH + REACH
HALF = REACH // 2
POSITION = np.uint64((1 << 21) - 1)
#: Fragments that are built together at least, if a partition has so many. An anchor with more is split by the bytes beside it.
BLOCK = 40_000


def _least(keys: np.ndarray) -> np.ndarray:
    """The least of each REACH + 1 neighbouring keys."""
    size, least = 1, keys
    while 2 * size <= REACH + 1:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = REACH + 1 - size
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def anchor_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, windows, lead, hash) of every run: ``windows`` windows from ``start`` on, the anchor ``lead`` after it."""
    parts = []
    block = int(POSITION) // 2
    for at in range(0, max(len(data) - LENGTH + 1, 0), block):
        piece = data[at : at + block + LENGTH - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUE[piece] * powers(BASE, len(piece)), dtype=np.uint64)])
        hashes = mix((sums[SEED:] - sums[:-SEED]) * powers(UNBASE, len(piece))[: len(piece) - SEED + 1])
        keys = (hashes & ~POSITION) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (_least(keys) & POSITION).astype(np.int64)
        start = np.arange(at, at + len(anchor))
        row = np.searchsorted(offsets, start, side="right") - 1
        whole = start + LENGTH <= offsets[row + 1]
        edge = np.ones(len(anchor) + 1, dtype=bool)
        edge[1:-1] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]) | (row[1:] != row[:-1])
        cut = np.flatnonzero(edge)
        first, n = cut[:-1][whole[cut[:-1]]], np.diff(cut)[whole[cut[:-1]]]
        parts.append((row[first], start[first] - offsets[row[first]], n, anchor[first] - first, hashes[anchor[first]]))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _known(data: np.ndarray, offsets: np.ndarray, row, start, n, lead, hashes) -> np.ndarray:
    """Runs that repeat a run of their own text, by two 64-bit hashes of their bytes: they go whichever other texts there are."""
    known = np.zeros(len(row), dtype=bool)
    order = np.lexsort((start, hashes, row))
    again = np.flatnonzero((row[order][1:] == row[order][:-1]) & (hashes[order][1:] == hashes[order][:-1]))
    if len(again):
        some = np.unique(np.concatenate([order[again], order[again + 1]]))
        begin = offsets[row[some]] + start[some]
        end = begin + n[some] + LENGTH - 1
        whole = Spans(data).of(begin, end) + mix(lead[some].astype(np.uint64))
        again = Spans(data ^ 0x5A).of(begin, end)
        by = np.lexsort((start[some], again, whole, row[some]))
        same = (row[some][by][1:] == row[some][by][:-1]) & (whole[by][1:] == whole[by][:-1]) & (again[by][1:] == again[by][:-1])
        known[some[by[1:][same]]] = True
    return known


def _seeds(docs: DataFrame) -> DataFrame:
    """(hash, uid, place) of every run; place packs start, windows and lead.

    Runs that repeat one of their own text are no seeds: (start, end) of their bytes, neighbours joined, with a place below
    zero and a hash of their own, so that a phrase written a thousand times in a text is not a thousand rows of one hash.
    """

    def run(batch: pa.RecordBatch) -> dict:
        data, offsets = utf8(batch.column(1))
        row, start, n, lead, hashes = runs = anchor_runs(data, offsets)
        uid = np.asarray(batch.column(0))
        known, one = _known(data, offsets, *runs), np.zeros(len(uid), dtype=bool)
        one[np.unique(uid, return_index=True)[1]] = True  # copies of one row have the same runs
        k = np.flatnonzero(known & one[row])
        begin, end = start[k], start[k] + n[k] + LENGTH - 1
        cut = np.flatnonzero(np.concatenate([[True], (row[k][1:] != row[k][:-1]) | (begin[1:] > end[:-1])])) if len(k) else k
        last = np.append(cut[1:], len(k)) - 1 if len(k) else k
        spans = -((begin[cut] << 31) | (end[last] - begin[cut])) - 1
        rest = ~known & one[row]
        own = mix(uid[row[k][cut]].view(np.uint64) + begin[cut].astype(np.uint64))
        return {
            "hash": np.concatenate([hashes[rest], own]).view(np.int64), "uid": np.concatenate([uid[row[rest]], uid[row[k][cut]]]),
            "place": np.concatenate([(start[rest] << 16) | (n[rest] << 8) | lead[rest], spans]),
        }

    return arrow_map(docs.select("uid", "text"), run, "hash long, uid long, place long", text=1)


def _once(rows: pa.RecordBatch, columns: tuple[int, ...]) -> pa.RecordBatch:
    """Of neighbouring rows that agree in these columns of whole numbers, the first."""
    differ = [np.asarray(rows.column(i))[1:] != np.asarray(rows.column(i))[:-1] for i in columns]
    return rows.filter(pa.array(np.concatenate([[True], np.logical_or.reduce(differ)])))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (hash, uid, place), each once, those whose hash is also the next or the last row's, and known spans.

    Copies of one row (equal id and text) so stand once, and a hash that only they have is not repeated. One row is held back.
    """
    held, again = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = _once(batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0], (0, 1, 2))
        hashes = np.asarray(table.column(0))
        same = hashes[1:] == hashes[:-1]
        keep = np.concatenate([[again], same]) | np.concatenate([same, [False]]) | (np.asarray(table.column(2)) < 0)
        held, again = table.slice(table.num_rows - 1), bool(keep[-1])
        if keep[:-1].any():
            yield table.slice(0, table.num_rows - 1).filter(pa.array(keep[:-1]))
    if held is not None and again:
        yield held


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, uid, text, runs): the bytes of each run, once a uid.

    A fragment that the batch holds under a smaller doc_id needs no bytes: all of it is repeated, whatever else there is.
    """
    for batch in batches:
        for part in slices(batch, 2, 16 * SLICE):
            seen: dict[bytes, int | None] = {}
            sent: set[int] = set()
            out: tuple[list, ...] = ([], [], [], [], [])
            order = np.argsort(np.asarray(part.column(0).fill_null(-(1 << 63))), kind="stable")
            ids, uids, texts, runs = (part.column(i).take(pa.array(order)).to_pylist() for i in range(4))
            for doc, uid, text, listed in zip(ids, uids, texts, runs):
                if uid in sent:
                    continue
                sent.add(uid)
                text = (text or "").encode("utf-8")
                for key, place in (p for x in listed for p in (_halves(text, x["hash"], x["place"]) if x["hot"] else [(x["hash"], x["place"])])):
                    start = place >> 16
                    fragment = text[start : start + (place >> 8 & 255) + LENGTH - 1]
                    whole = fragment + bytes([place & 255])
                    known = seen.setdefault(whole, doc) != doc  # ids ascend; of rows with one id all are sent
                    for column, value in zip(out, (key, doc, uid, place, None if known else fragment)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["hash", "doc_id", "uid", "place", "fragment"])


def _halves(text: bytes, key: int, place: int) -> list[tuple[int, int]]:
    """A run of a hot anchor as one or two runs with keys of their own: (key, place) each.

    A window has HALF more bytes after its anchor, or before it. Those bytes are part of the key, as two equal windows have
    them alike; windows of the first kind are one run, the others another.
    """
    start, n, lead = place >> 16, place >> 8 & 255, place & 255
    anchor, out = start + lead, []
    after, before = range(max(start, anchor - REACH + HALF), start + n), range(start, min(start + n, anchor - REACH + HALF))
    for side, windows, low in ((0, after, anchor + SEED), (1, before, anchor - HALF)):
        if len(windows):
            more = xxhash.xxh64_intdigest(text[low : low + HALF], seed=key & 0xFFFFFFFF | side) ^ key & 0xFFFFFFFFFFFFFFFF
            out.append((more - (1 << 64) if more >> 63 else more, (windows[0] << 16) | (len(windows) << 8) | (anchor - windows[0])))
    return out


def repeated_windows(fragments: list[bytes], lead: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each fragment, aligned by its lead, which of the REACH + 1 window starts repeat a fragment of a lower rank.

    Column by column from the right: ``order`` sorts the suffixes inserted so far, ``common`` is each one's common prefix
    with the one before it in that order.
    """
    n = len(fragments)
    sizes = np.array([len(f) for f in fragments])
    base = REACH - lead
    table = np.zeros((COLUMNS, n), dtype=np.uint16)  # a column a row; 0: the fragment has no symbol there
    rows = np.repeat(np.arange(n), sizes)
    column = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + base[rows]
    table[column, rows] = np.frombuffer(b"".join(fragments), dtype=np.uint8).astype(np.uint16) + 1
    order, common = np.arange(n), np.zeros(n + 1, dtype=np.int32)
    found = np.zeros((REACH + 1, n), dtype=bool)
    for c in range(COLUMNS - 1, -1, -1):
        symbols = table[c][order]
        moved = np.argsort(symbols, kind="stable")
        symbols = symbols[moved]
        same = np.flatnonzero(symbols[1:] == symbols[:-1])
        low, high = moved[same], moved[same + 1]
        between = np.empty(2 * len(same), dtype=np.int64)
        between[0::2], between[1::2] = low + 1, high + 1
        fresh = np.zeros(n + 1, dtype=np.int32)
        if len(same):
            fresh[same + 1] = np.minimum.reduceat(common, between)[::2] + 1
        order, common = order[moved], fresh
        if c <= REACH:
            starts = np.flatnonzero(common[:-1] < LENGTH)
            if len(starts) < n:
                least = np.minimum.reduceat(rank[order], starts)
                found[c, order] = rank[order] > np.repeat(least, np.diff(np.append(starts, n)))
    windows = np.arange(REACH + 1)[:, None]
    return (found & (windows >= base) & (windows < base + sizes - LENGTH + 1)).T


def _intervals(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, start, end) of the repeated bytes of fragments (doc_id, uid, place, bytes), whole groups at a time."""
    place = np.array([r[2] for r in rows], dtype=np.int64)
    start, lead = place >> 16, place & 255
    doc = np.array([-(1 << 63) if r[0] is None else r[0] for r in rows], dtype=np.int64)
    uid = np.array([r[1] for r in rows], dtype=np.int64)
    by = np.lexsort((start + lead, doc))
    at = np.stack([doc[by], (start + lead)[by]])
    rank = np.empty(len(rows), dtype=np.int64)
    rank[by] = np.concatenate([[0], np.cumsum((at[:, 1:] != at[:, :-1]).any(axis=0))])  # equal places: texts under one id
    found = repeated_windows([r[3] for r in rows], lead, rank)
    change = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(change == 1)
    _, last = np.nonzero(change == -1)
    begin = start[row] - (REACH - lead[row])
    return uid[row], begin + first, begin + last - 1 + LENGTH


def _construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["uid", "start", "end"]
    held: list[tuple] = []
    hashes: list[int] = []
    open_ = 0  # where the last group, which may go on, begins
    for batch in batches:
        known = batch.filter(pa.compute.is_null(batch.column(4)))
        if known.num_rows:
            place = np.asarray(known.column(3))
            yield pa.RecordBatch.from_arrays([known.column(2), pa.array(place >> 16), pa.array((place >> 16) + (place >> 8 & 255) + LENGTH - 1)], names=names)
        fresh = batch.filter(pa.compute.is_valid(batch.column(4)))
        if not fresh.num_rows:
            continue
        fresh = _once(fresh, (0, 2, 3))
        if held and (hashes[-1], *held[-1][1:3]) == tuple(fresh.column(i)[0].as_py() for i in (0, 2, 3)):
            fresh = fresh.slice(1)
            if not fresh.num_rows:
                continue
        added = np.asarray(fresh.column(0))
        if not hashes or added[-1] != hashes[-1]:
            open_ = len(hashes) + int(np.searchsorted(added, added[-1]))
        hashes += added.tolist()
        held += zip(*(fresh.column(i).to_pylist() for i in range(1, 5)))
        if len(held) >= BLOCK and open_:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _intervals(held[:open_])], names=names)
            held, hashes, open_ = held[open_:], hashes[open_:], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _intervals(held)], names=names)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(uid, spans array<struct<start, end>>) of the documents (doc_id, uid, text) with repeated bytes; spans may overlap."""
    seeds = _seeds(docs).repartition("hash").sortWithinPartitions("hash", "uid", "place")
    shared = materialize(seeds.mapInArrow(_repeated, seeds.schema), "seeds")
    hot = shared.filter("place >= 0").groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("hash", F.lit(True).alias("hot"))
    marked = shared.filter("place >= 0").join(small(materialize(hot, "hot-anchors")), "hash", "left").select("hash", "uid", "place", F.coalesce("hot", F.lit(False)).alias("hot"))
    runs = marked.groupBy("uid").agg(F.collect_list(F.struct("hash", "place", "hot")).alias("runs"))
    texts = docs.join(runs, "uid").select("doc_id", "uid", "text", "runs")
    fragments = texts.mapInArrow(_fragments, "hash long, doc_id long, uid long, place long, fragment binary")
    built = fragments.repartition("hash").sortWithinPartitions("hash", "uid", "place").mapInArrow(_construct, "uid long, start long, end long")
    span = -(F.col("place") + 1)
    start = F.shiftright(span, 31)
    known = shared.filter("place < 0").select("uid", start.alias("start"), (start + span.bitwiseAND(F.lit((1 << 31) - 1))).alias("end"))
    return built.unionByName(known).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept binary, spans array<struct<start, end>>, n_bytes, n_removed) for every row, spans maximal and in order.

    Texts are UTF-8 bytes; null is empty; texts under LENGTH bytes lose nothing. Rows with equal id and text are one document
    that stands several times: neither copy comes earlier, and both lose the same. Different texts under one id are one document
    too: of two equal strings that with the earlier start in its text comes first, at equal starts neither does, so the result is
    the same however the rows are dealt. A null id comes before all others.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text_col, F.octet_length(text_col)).alias("uid"), F.col(text_col).alias("text"))
    joined = keyed.join(repeated_spans(keyed), "uid", "left").select("doc_id", "text", "spans")

    def run(batch: pa.RecordBatch) -> dict:
        kept, spans, sizes = [], [], []
        for text, listed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text = (text or "").encode("utf-8")
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in listed or []):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            edges = [0, *(x for s in merged for x in s), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append([{"start": a, "end": b} for a, b in merged])
            sizes.append(len(text))
        return {id_col: batch.column(0), "kept": kept, "spans": spans, "n_bytes": sizes, "n_removed": [n - len(k) for n, k in zip(sizes, kept)]}

    return arrow_map(joined, run, f"{id_col} long, kept binary, spans array<struct<start: long, end: long>>, n_bytes long, n_removed long", text=1)


def digests(cleaned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return cleaned.select(id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
