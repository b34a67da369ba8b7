"""SentencePiece BPE: vectorised merge rounds over flat symbol arrays, and decoding with byte fallback.

A text is cut where no piece of the vocabulary can reach across (two neighbouring characters that stand together in no piece),
which gives short words. The new words of a batch become one flat numpy array of symbols. In each round every word finds the
least rank among its pairs, all its leftmost non-overlapping pairs of that rank are merged at once, and the array is compacted;
words without a pair that the vocabulary knows leave it. The library merges one pair at a time and looks again. That makes a
difference only where a merge creates a pair that ranks before, or equal to, the one just merged; such words are found in each
round and merge their first pair alone, so ids are those of the library for any vocabulary.

The model file is parsed here: identity normalisation, pieces of the normal, unknown, control and byte types. A model with
another normalisation, or with user-defined or unused pieces, is refused.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.bpe import ids_column
from lattica.llm.common import arrow_map

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Words of a generation that a Python worker remembers, the longest of them, and characters of a text handled at once.
REMEMBERED = 200_000
LONGEST = 200
WINDOW = 1 << 20
#: Bytes of text whose words are merged together.
BATCH = 1 << 20
NONE = np.iinfo(np.int32).max


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a serialised message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """The vocabulary as arrays: characters to symbols, pairs of symbols to the piece they make, symbols to ids."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self._read(file.read())
        names = [p for p, _, kind in self.pieces if kind == NORMAL]
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.byte_ids = [next(i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE and p == f"<0x{b:02X}>") for b in range(256)]
        self.unknown = next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        # symbols: the pieces, then characters that stand only inside of pieces
        inner = sorted({c for p in names for c in p} - set(names))
        self.symbols = names + inner
        number = {s: k for k, s in enumerate(self.symbols)}
        order = sorted({-s for _, s, kind in self.pieces if kind == NORMAL})
        rank = {s: r for r, s in enumerate(order)}
        score = {p: rank[-s] for p, s, kind in self.pieces if kind == NORMAL}
        found = sorted(
            (number[p[:k]] * len(self.symbols) + number[p[k:]], number[p], score[p])
            for p in names for k in range(1, len(p)) if p[:k] in number and p[k:] in number
        )
        self.pair_keys = np.array([f[0] for f in found], dtype=np.int64)
        self.pair_made = np.array([f[1] for f in found], dtype=np.int32)
        self.pair_rank = np.array([f[2] for f in found], dtype=np.int32)
        chars = sorted((ord(s), k) for s, k in number.items() if len(s) == 1)
        self.chars = np.array([c for c, _ in chars], dtype=np.int64)
        self.char_symbol = np.array([k for _, k in chars], dtype=np.int32)
        self.joined = np.array(sorted({ord(a) << 21 | ord(b) for p in names for a, b in zip(p, p[1:])}), dtype=np.int64)
        self.spaced = not any(SPACE in p.lstrip(SPACE) for p in names)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.symbol_id = np.array([self.ids.get(x, -1) for x in self.symbols], dtype=np.int64)
        self.said = [str(i) for i in range(len(self.pieces))]
        self.known: dict[str, tuple[bytes, str, str]] = {}
        self.former: dict[str, tuple[bytes, str, str]] = {}
        self.spelled = [p.replace(SPACE, " ") for p, _, _ in self.pieces]

    def _read(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normal = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        other = {kind for _, _, kind in self.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}
        if SPACE not in {p for p, _, kind in self.pieces if kind == NORMAL}:
            raise ValueError("the space is a piece of its own in every vocabulary that is served")
        if trainer.get(3) != 2 or not trainer.get(35) or normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24) or other:
            raise ValueError("only BPE with byte fallback, identity normalisation, a leading space and all white space kept is served")

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; NONE where the vocabulary has none."""
        key = left.astype(np.int64) * len(self.symbols) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        ok = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.pair_rank[at], NONE), self.pair_made[at]

    def merge(self, words: list[str]) -> list[list[int]]:
        """The symbols of each word; -1 - c stands for a character c that no piece has."""
        symbols, ends = self.merged(words)
        flat = symbols.tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def merged(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """The symbols of all words, one after the other, and where each word's end."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        if not len(points):
            return points, [0] * len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        symbols = np.where(self.chars[at] == points, self.char_symbol[at], -1 - points).astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        # segments: within a word, cut where two characters stand together in no piece
        near = points[:-1] << 21 | points[1:]
        place = np.minimum(np.searchsorted(self.joined, near), max(len(self.joined) - 1, 0))
        cut = ((self.joined[place] != near) if len(self.joined) else np.ones(len(near), bool)) | (word[1:] != word[:-1])
        segment, order = np.concatenate([[0], np.cumsum(cut)]), np.arange(len(points))
        rank, made = self.pairs(symbols[:-1], symbols[1:])
        rank, made = np.append(np.where(cut, NONE, rank), NONE), np.append(made, 0)  # of the pair that begins here
        done = []
        while len(symbols):
            symbols, segment, order, rank, made, left = self._round(symbols, segment, order, rank, made)
            done.append(left)
        symbols, order = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        by = np.argsort(order)
        return symbols[by], np.searchsorted(order[by], np.cumsum(sizes)).tolist()

    def _round(self, symbols: np.ndarray, segment: np.ndarray, order: np.ndarray, rank: np.ndarray, made: np.ndarray):
        """One round: segments without a pair leave, the others merge all their leftmost pairs of least rank."""
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
        over = least == NONE
        left = symbols[over], order[over]
        pick = ~over
        symbols, segment, order, rank, made, least = (x[pick] for x in (symbols, segment, order, rank, made, least))
        if not len(symbols):
            return symbols, segment, order, rank, made, left
        chosen = rank == least
        # of overlapping neighbours every second one stays, counted from the left
        n = np.arange(len(chosen))
        began = np.maximum.accumulate(np.where(chosen & ~np.concatenate([[False], chosen[:-1]]), n, 0))
        chosen &= (n - began) % 2 == 0
        picked = np.flatnonzero(chosen)
        first = np.concatenate([[True], segment[picked[1:]] != segment[picked[:-1]]])
        several = ~first
        several[:-1] |= ~first[1:]
        if several.any():
            early = self._early(symbols, segment, made, least, chosen, picked[several])
            if len(early):
                alone = np.isin(segment[picked], segment[early])
                chosen[picked[alone & ~first]] = False
        symbols = np.where(chosen, made, symbols)
        stay = ~np.concatenate([[False], chosen[:-1]])
        fresh = np.flatnonzero(chosen[stay])
        symbols, segment, order, rank, made = (x[stay] for x in (symbols, segment, order, rank, made))
        # pairs that begin at a merged symbol or end at one are new
        touched = np.zeros(len(symbols), bool)
        touched[fresh] = touched[fresh[fresh > 0] - 1] = True
        again = np.flatnonzero(touched)
        ahead = np.minimum(again + 1, len(symbols) - 1)
        inside = (segment[ahead] == segment[again]) & (again + 1 < len(symbols))
        found, piece = self.pairs(symbols[again], symbols[ahead])
        rank[again], made[again] = np.where(inside, found, NONE), piece
        return symbols, segment, order, rank, made, left

    def _early(self, symbols: np.ndarray, segment: np.ndarray, made: np.ndarray, least: np.ndarray, chosen: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the chosen pairs ``at`` those whose merge makes a pair that the library would merge before the next chosen one."""
        after = at[at + 2 < len(symbols)]
        after = after[segment[after] == segment[after + 2]]
        ahead, _ = self.pairs(made[after], symbols[after + 2])
        before = at[at > 0]
        before = before[segment[before] == segment[before - 1]]
        lefts = np.where((before >= 2) & chosen[before - 2], made[before - 2], symbols[before - 1])
        behind, _ = self.pairs(lefts, made[before])
        return np.concatenate([after[ahead <= least[after]], before[behind <= least[before]]])

    def ids_of(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            text = chr(-1 - s) if s < 0 else self.symbols[s]
            if (found := self.ids.get(text)) is not None:
                out.append(found)
            else:
                out += [self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")]
        return out

    def split(self, text: str) -> Iterator[list[str]]:
        """The words of a normalised text, some at a time."""
        if not self.spaced:
            yield [text]
            return
        at = 0
        while at < len(text):
            end = at + WINDOW
            if end < len(text):  # go on to the end of a word
                found = self.words.match(text, text.rfind(SPACE, at + 1, end) if text.rfind(SPACE, at + 1, end) > at else end)
                end = found.end() if found else len(text)
            yield self.words.findall(text, at, end)
            at = end

    def encode(self, texts: list[str]) -> list[tuple[bytes, str, str]]:
        """(ids as little-endian int32, ids as text, text that they decode to) of each text.

        The new words of all short texts are merged together. A word's ids are decoded once: as a word begins with a piece, not
        with a byte, a text decodes to what its words do, without the leading space.
        """
        out: list[tuple[bytes, str, str]] = []
        brief = [[w for words in self.split(normalised(t)) for w in words] if len(t) < WINDOW else None for t in texts]
        found = iter(self.look_up([w for words in brief if words for w in words]))
        for text, words in zip(texts, brief):
            if words is None:
                parts = [p for some in self.split(normalised(text)) for p in self.look_up(some)]
            else:
                parts = list(itertools.islice(found, len(words)))
            ids, said, spelled = zip(*parts) if parts else ((), (), ())
            spelled = "".join(spelled)
            out.append((b"".join(ids), ",".join(said), spelled[1:] if spelled.startswith(" ") else spelled))
        return out

    def look_up(self, words: list[str]) -> list[tuple[bytes, str, str]]:
        """What is remembered of each word; the others are merged now.

        Two generations are kept: when the younger one is full it takes the place of the older one, and words that are met
        again come over.
        """
        known = self.known
        new = {w for w in words if w not in known}
        if not new:
            return list(map(known.__getitem__, words))
        back = {w: self.former[w] for w in new if w in self.former}
        known.update(back)
        known.update(self.described([w for w in new if w not in back]))
        out = list(map(known.__getitem__, words))
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        if len(known) > REMEMBERED:
            self.known, self.former = {}, known
        return out

    def described(self, words: list[str]) -> Iterator[tuple[str, tuple[bytes, str, str]]]:
        """(word, (ids as bytes, ids as text, what they decode to)) of new words, merged together."""
        symbols, ends = self.merged(words)
        ids = np.where(symbols >= 0, self.symbol_id[np.maximum(symbols, 0)], -1)
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(ids < 0), side="right"))  # words with characters that become bytes
        odd = set(odd.tolist())
        whole, flat = ids.astype("<i4").tobytes(), np.maximum(ids, 0).tolist()
        said, spelled = [self.said[i] for i in flat], [self.spelled[i] for i in flat]
        begin = 0
        for k, (word, end) in enumerate(zip(words, ends)):
            if k in odd:
                own = self.ids_of(symbols[begin:end].tolist())
                yield word, (np.array(own, dtype="<i4").tobytes(), ",".join(map(str, own)), self.decode(own, begun=True))
            else:
                yield word, (whole[4 * begin : 4 * end], ",".join(said[begin:end]), "".join(spelled[begin:end]))
            begin = end

    def decode(self, ids, begun: bool = False) -> str:
        """The text of a list of ids, as the library gives it: bytes that are no UTF-8 become U+FFFD one by one.

        ``begun``: they stand inside of a text, so that a space in front stays.
        """
        out: list[str] = []
        held = bytearray()

        def flush() -> None:
            if held:
                out.append(held.decode("utf-8", "one by one"))
                held.clear()

        for i in ids:
            piece, _, kind = self.pieces[i]
            if kind == BYTE:
                held.append(int(piece[3:5], 16))
                begun = True
                continue
            flush()
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            else:
                out.append(self.spelled[i][1:] if not begun and piece.startswith(SPACE) else self.spelled[i])
            begun = True
        flush()
        return "".join(out)


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


@functools.cache
def model(path: str) -> Model:
    import codecs

    codecs.register_error("one by one", _one_by_one)
    return Model(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary, ids_text) for every row; decoded is what the ids decode to, in UTF-8.

    Null and empty texts have no ids; repeated rows each get a row, null ids stay; other columns are ignored. A very long text is
    read in windows of a million characters, a very long word (one without a place to cut) is one array.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        m = model(model_path)
        got = m.encode(batch.column("text").to_pylist())
        decoded = [g[2].encode("utf-8", "surrogatepass") for g in got]
        return {"id": batch.column("id"), "ids": ids_column([g[0] for g in got]), "decoded": decoded, "ids_text": [g[1] for g in got]}

    out = arrow_map(rows, run, f"id {kind}, ids array<int>, decoded binary, ids_text string", text=1, limit=BATCH)
    return out.withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """``rows`` with the text that an array of ids decodes to; null where the array is null, empty for an empty one."""

    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        m = model(model_path)
        return ids.map(lambda row: None if row is None else m.decode(row))

    return rows.withColumn(name, texts(F.col(ids_col)))
