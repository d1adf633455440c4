"""SentencePiece encoding and decoding by a max-plus parallel scan.

A giant text is cut into chunks of about ``CHUNK`` characters.  A state at a
cut says how the path through the pieces crosses it, or "between pieces".  A
chunk yields the transfer matrix ``M[s, t]``: the value (sum of scores) of the
chunk's best path from state s to state t, or minus infinity where there is
none.  Matrices combine associatively in max-plus algebra (``combine``): groups
of ``GROUP`` chunks are multiplied in tasks of their own, then the groups' products,
which gives the values that can be reached at every cut.  With these each chunk
is backtraced on its own, for each end state to its start state and ids, and the
chain of states from the text's end picks among them.  Values are whole numbers,
so any order of products gives the same path.

With a unigram model (``Unigram``) the path is the lattice's best: a state is how far the piece that
crosses the cut reaches beyond it.  Scores count as multiples of 2**-24, and ties go to the
longer last piece; the library adds single-precision floats, so where it rounds, its path can differ.

With a BPE model (``Model``) pieces merge by score, and a row of pieces is the encoding of its text
exactly if every two neighbours are the encoding of theirs.  So an encoding can
be put together from stretches that overlap in one piece: a state is the piece that covers the cut
(any that matches the text there), and an entry is minus infinity where the encoding of that
stretch does not begin with s and end with t.  The ids are those of the library on the whole text.

Within a stretch, words separate: no piece crosses the start of a space-led
word, nor a character that no piece holds, so every distinct word goes through
the library once.  Texts are normalised as the model states for the identity
normaliser: spaces are U+2581, and one is put in front.  Characters without a
piece become byte pieces.  Decoding joins the pieces, drops the first space and
is exact.  A run of spaces is never cut, however long.

Results for odd input: a null or empty text has no ids; repeated rows each get
their ids; a null id stays null; an empty table gives an empty result; a text
with the letter U+2581 decodes to a space there, so it is not ``restored``; columns that are added
replace equally named ones.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, give_back, small_batches, text_or_empty, tidy, worker_state

SPACE = "▁"
CHUNK = 1 << 15
#: Chunks whose matrices one task multiplies.
GROUP = 64
#: Words in a generation of those that a worker remembers, and about how many bytes they take at most.
WORDS_KEPT = 100_000
WORD_BYTES = 32 << 20
LEAST = -(1 << 62)

#: A state: the covering piece's (start, end) from the cut, or (0, 0) between words.
State = tuple[int, int]
BETWEEN: State = (0, 0)


class Model:
    """Pieces and scores of a BPE model, and the encoding of words, chunks and texts."""

    KIND, NAME, UNIT = 2, "BPE", 1.0

    def __init__(self, path: str):
        import sentencepiece

        proto = _proto(path)
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with the identity normaliser can be cut here")
        if trainer.model_type != self.KIND or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError(f"only {self.NAME} models with byte fallback and space-led words can be cut here")
        self.pieces = [p.piece for p in proto.pieces]
        known = [(i, p) for i, p in enumerate(proto.pieces) if p.type == 1]
        self.normal = frozenset(p.piece for _, p in known)
        if any(SPACE in p.lstrip(SPACE) for p in self.normal):
            raise ValueError("a piece crosses the start of a word")
        self.scores = np.zeros(len(self.pieces), np.int64)
        for i, p in known:
            self.scores[i] = round(p.score * self.UNIT)
        self.byte_of = {i: bytes([int(p.piece[3:5], 16)]) for i, p in enumerate(proto.pieces) if p.type == 6}
        self.raw = [self.byte_of.get(i) or x.encode() for i, x in enumerate(self.pieces)]
        self.longest = max(map(len, self.normal))
        self.letters = frozenset("".join(self.normal))
        self.prefix = spec.add_dummy_prefix
        spec.add_dummy_prefix = False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.size = 0

    @functools.cached_property
    def begins(self) -> set[str]:
        """Substrings that begin a piece, to stop looking early."""
        return {p[:n] for p in self.normal for n in range(1, len(p) + 1)}

    def prepared(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    # Words.

    def words(self, text: str) -> list[str]:
        """The string cut before every run of spaces and, where no piece holds one, around line ends."""
        if SPACE * 2 not in text and "\n" not in text:
            head, *rest = text.split(SPACE)
            return ([head] if head else []) + [SPACE + w for w in rest]
        if "\n" in self.letters:
            return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)
        return re.findall(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+", text)

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words that are not among those met lately; of two generations the older one is forgotten when the other is full."""
        known, old = self.known
        size = 200 * len(words) + 6 * sum(map(len, words))
        if len(known) + len(words) > WORDS_KEPT or self.size + size > WORD_BYTES:
            known, old = {}, known
            self.known, self.size = (known, old), 0
        self.size += size
        found = {w: old[w] for w in words if w in old} if old else {}
        unseen = list(words.difference(found))
        ids = self.library.encode(unseen, num_threads=1) if unseen else []
        found.update((w, array("i", x).tobytes()) for w, x in zip(unseen, ids, strict=True))
        known.update(found)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian int32) of prepared strings."""
        get = self.known[0].get
        rows: list[tuple[list[str], list[bytes | None], list[int]]] = []
        missing: set[str] = set()
        for text in texts:
            words = self.words(text)
            ids = list(map(get, words))
            gaps = [k for k, i in enumerate(ids) if i is None] if None in ids else []
            missing.update(map(words.__getitem__, gaps))
            rows.append((words, ids, gaps))
        found = self._learn(missing) if missing else {}
        for words, ids, gaps in rows:
            for k in gaps:
                ids[k] = found[words[k]]
        return [b"".join(ids) for _, ids, _ in rows]

    # Cuts, states and transfer matrices.

    def between(self, text: str, cut: int) -> bool:
        """Can no piece cross here?"""
        a, b = text[cut - 1], text[cut]
        return (b == SPACE and a != SPACE) or a not in self.letters or b not in self.letters

    def states(self, text: str, cut: int) -> list[State]:
        """The pieces that can cover the letter before the cut."""
        if self.between(text, cut):
            return [BETWEEN]
        out = [(-1, 0)]
        for low in range(max(0, cut - self.longest), cut):
            for high in range(low + 1, min(len(text), low + self.longest) + 1):
                piece = text[low:high]
                if piece not in self.begins:
                    break
                if high >= cut and piece in self.normal:
                    out.append((low - cut, high - cut))
        return sorted(set(out))

    def cuts(self, text: str, chunk: int) -> list[int]:
        """About every ``chunk`` letters: at a word's start nearby, else anywhere but in a run of spaces."""
        out, step = [], max(chunk, 4 * self.longest)
        at = step
        while at < len(text):
            near = text.rfind(SPACE, at - step // 4, at + 1)
            cut = near if near > 0 else at
            while cut > 0 and text[cut - 1] == SPACE:
                cut -= 1
            if cut > (out[-1] + 2 * self.longest if out else 2 * self.longest) and cut < len(text) - 2 * self.longest:
                out.append(cut)
            at += step
        return out

    def stretch(self, text: str, s: State, t: State, start: int, end: int) -> tuple[int, bytes] | None:
        """Value and ids of the encoding from piece s at ``start`` to piece t at ``end``, without s itself; None if it has not both."""
        raw = self.encode([text[start + s[0] : end + t[1]]])[0]
        ids = np.frombuffer(raw, "<i4")
        skip = 0
        if s != BETWEEN:
            skip = self._covers(ids, s[1] - s[0])
        if skip is None or t != BETWEEN and self._covers(ids[::-1], t[1] - t[0]) is None:
            return None
        return int(self.scores[ids[skip:]].sum()), raw[4 * skip :]

    def _covers(self, ids: np.ndarray, letters: int) -> int | None:
        """How many ids the first piece has (bytes of one letter count as one), if it has so many letters."""
        first = int(ids[0])
        if first not in self.byte_of:
            return 1 if len(self.pieces[first]) == letters else None
        return None  # a letter without a piece is never a state

    def transfer(self, text: str, starts: list[State], ends: list[State], start: int, end: int) -> np.ndarray:
        """The chunk's matrix, through two inner cuts: few states get past the first, so few long stretches are encoded."""
        near = 4 * self.longest
        low, high = start + near, end - near
        if starts == ends == [BETWEEN] or high - low < near or SPACE in (text[low - 1], text[high - 1]):
            return self._direct(text, starts, ends, start, end)
        inner, outer = self.states(text, low), self.states(text, high)
        head = self._direct(text, starts, inner, start, low)
        tail = self._direct(text, outer, ends, high, end)
        body = self._direct(text, inner, outer, low, high, head.max(0) > LEAST, tail.max(1) > LEAST)
        return combine(combine(head, body), tail)

    def _direct(self, text: str, starts: list[State], ends: list[State], start: int, end: int, rows: np.ndarray | None = None, columns: np.ndarray | None = None) -> np.ndarray:
        out = np.full((len(starts), len(ends)), LEAST, np.int64)
        for i, s in enumerate(starts):
            for j, t in enumerate(ends):
                if (rows is None or rows[i]) and (columns is None or columns[j]) and (found := self.stretch(text, s, t, start, end)) is not None:
                    out[i, j] = found[0]
        return out

    def backtrace(self, text: str, starts: list[State], ends: list[State], start: int, end: int, reached: list[int]) -> list[tuple[int, bytes]]:
        """Of each end state: the best reached start state and the ids in between; (-1, b"") if there is none."""
        out = []
        for t in ends:
            best, came, ids = LEAST, -1, b""
            for i, s in enumerate(starts):
                if reached[i] > LEAST and (found := self.stretch(text, s, t, start, end)) is not None and reached[i] + found[0] > best:
                    best, came, ids = reached[i] + found[0], i, found[1]
            out.append((came, ids))
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Unigram(Model):
    """Pieces and scores of a unigram model: paths of the greatest sum of scores."""

    KIND, NAME, UNIT = 1, "unigram", float(1 << 24)

    def __init__(self, path: str):
        super().__init__(path)
        proto = _proto(path)
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("a unigram model with pieces defined by hand cannot be cut here")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.unknown = round((min(p.score for p in proto.pieces if p.type == 1) - 10) * self.UNIT)  # as the library does
        self.bytes = {raw[0]: i for i, raw in self.byte_of.items()}

    def states(self, text: str, cut: int) -> list[State]:
        """How far pieces that start before the cut reach beyond it."""
        if self.between(text, cut):
            return [BETWEEN]
        out = {BETWEEN}
        for low in range(max(0, cut - self.longest + 1), cut):
            for high in range(cut + 1, min(len(text), low + self.longest) + 1):
                if text[low:high] in self.ids:
                    out.add((0, high - cut))
        return sorted(out)

    def _best(self, text: str, begin: int, end: int) -> tuple[list[int], list[tuple[int, int]]]:
        """Per place from ``begin`` on: the best value of a path to it whose pieces all start before ``end``, and its last piece's start and id (-1: bytes)."""
        size = min(len(text), end + self.longest) - begin + 1
        best, came = [LEAST] * size, [(-1, -1)] * size
        best[0] = 0
        ids, scores, begins = self.ids, self.scores, self.begins
        for low in range(end - begin):
            if best[low] == LEAST:
                continue
            at, single = begin + low, False
            for n in range(1, min(self.longest, size - 1 - low) + 1):
                piece = text[at : at + n]
                if piece not in begins:
                    break
                i = ids.get(piece)
                if i is None:
                    continue
                single |= n == 1
                value = best[low] + int(scores[i])
                if value > best[low + n]:
                    best[low + n], came[low + n] = value, (low, i)
            if not single and best[low] + self.unknown > best[low + 1]:
                best[low + 1], came[low + 1] = best[low] + self.unknown, (low, -1)
        return best, came

    def transfer(self, text: str, starts: list[State], ends: list[State], start: int, end: int) -> np.ndarray:
        out = np.full((len(starts), len(ends)), LEAST, np.int64)
        for i, s in enumerate(starts):
            best, _ = self._best(text, start + s[1], end)
            out[i] = [best[end + t[1] - start - s[1]] for t in ends]
        return out

    def backtrace(self, text: str, starts: list[State], ends: list[State], start: int, end: int, reached: list[int]) -> list[tuple[int, bytes]]:
        paths = {i: self._best(text, start + s[1], end) for i, s in enumerate(starts) if reached[i] > LEAST}
        out = []
        for t in ends:
            options = [(reached[i] + best[p], -i) for i, (best, _) in paths.items() if best[p := end + t[1] - start - starts[i][1]] > LEAST]
            if not options:
                out.append((-1, b""))
                continue
            i = -max(options)[1]
            begin, came = start + starts[i][1], paths[i][1]
            place, ids = end + t[1] - begin, []
            while place:
                low, piece = came[place]
                ids += [piece] if piece >= 0 else [self.bytes[b] for b in reversed(text[begin + low : begin + place].encode("utf-8", "surrogatepass"))]
                place = low
            out.append((i, np.array(ids[::-1], "<i4").tobytes()))
        return out


def _proto(path: str):  # noqa: ANN202
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return proto


def load(path: str) -> Model:
    """The model of a file, by its kind."""
    return (Unigram if _proto(path).trainer_spec.model_type == Unigram.KIND else Model)(path)


def unit(n: int) -> np.ndarray:
    """What leaves a matrix as it is in max-plus products."""
    out = np.full((n, n), LEAST, np.int64)
    np.fill_diagonal(out, 0)
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices."""
    return np.maximum((a[:, :, None] + b[None]).max(1), LEAST)


def model_of(path: str) -> Model:
    """One model per worker process, kept for its later tasks."""
    return worker_state(("pieces", path), lambda: load(path))


_CHUNKS = "row long, part int, text string, start int, end int, starts array<int>, ends array<int>"


def _pairs(flat: list[int]) -> list[State]:
    return list(zip(flat[::2], flat[1::2], strict=True))


def chunks_of(m: Model, text: str, chunk: int) -> list[tuple[str, int, int, list[State], list[State]]]:
    """The text's chunks: their letters with those that the states reach, where the cuts are in these, and the states."""
    cuts = [0, *m.cuts(text, chunk), len(text)]
    states = [[BETWEEN], *(m.states(text, c) for c in cuts[1:-1]), [BETWEEN]]
    out = []
    for low, high, starts, ends in zip(cuts, cuts[1:], states, states[1:], strict=False):
        first = low + min(s[0] for s in starts)
        out.append((text[first : high + max(t[1] for t in ends)], low - first, high - first, starts, ends))
    return out


def _groups(texts: Iterable[str], most: int = 250_000) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """Add ``ids`` (array of int), the text's piece ids."""

    @F.pandas_udf("array<int>")
    def whole(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([np.frombuffer(x, "<i4") for x in _encoded(model, texts)], dtype=object)

    small, giant = _encode(docs, model, chunk, ["ids"], "array<int>")
    return small.withColumn("ids", whole(text_or_empty())).unionAll(giant)


def encode_checked(docs: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """Add ``ids`` as little-endian int32 bytes and ``restored``: does decoding them give the text?

    Each branch has one Python step, so a task has one worker.
    """

    @F.pandas_udf("ids binary, restored boolean")
    def whole(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        ids = list(_encoded(model, texts))
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "restored": [_restores(model, x, t) for x, t in zip(ids, texts, strict=True)]})

    @F.pandas_udf("boolean")
    def check(ids, texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([_restores(model, x, t) for x, t in zip(ids, texts, strict=True)], dtype=bool)

    small, giant = _encode(docs, model, chunk, ["ids", "restored"], "binary")
    base = small.columns
    first = small.withColumn("__bq_e", whole(text_or_empty())).select(*base, F.col("__bq_e")["ids"].alias("ids"), F.col("__bq_e")["restored"].alias("restored"))
    return first.unionAll(giant.withColumn("restored", check("ids", text_or_empty())))


def _encoded(model: str, texts: Iterable[str]) -> Iterator[bytes]:
    m = model_of(model)
    for g in _groups((m.prepared(t) for t in texts)):
        yield from m.encode(g)
    give_back()  # before the next batch


def _restores(model: str, ids: bytes, text: str) -> bool:
    return model_of(model).decode(np.frombuffer(ids, "<i4")) == text


def _encode(docs: DataFrame, model: str, chunk: int, added: list[str], kind: str) -> tuple[DataFrame, DataFrame]:
    """The rows of texts of one chunk, which is its own scan, and those of giant ones with ``ids``."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[c for c in docs.columns if c.lower() not in added])
    text = text_or_empty()
    giant = F.length(text) > chunk
    numbered = checkpoint(rows.filter(giant).withColumn("__bq_row", F.monotonically_increasing_id()))
    scanned = _scan(numbered.select("__bq_row", text.alias("text")), model, chunk, kind)
    return rows.filter(~giant), numbered.join(scanned, "__bq_row").drop("__bq_row")


def _scan(giants: DataFrame, model: str, chunk: int, kind: str) -> DataFrame:
    """``__bq_row, ids`` of giant texts, each in many tasks."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = m.prepared(value)
                for k, (piece, start, end, starts, ends) in enumerate(chunks_of(m, text, chunk)):
                    flat = {n: pa.array([[x for s in states for x in s]], pa.list_(pa.int32())) for n, states in (("starts", starts), ("ends", ends))}
                    places = {n: pa.array([x], pa.int32()) for n, x in (("start", start), ("end", end))}
                    yield pa.RecordBatch.from_pydict({"row": [row], "part": pa.array([k], pa.int32()), "text": [piece]} | places | flat)

    chunks = checkpoint(giants.mapInArrow(lambda it: tidy(split(it)), _CHUNKS).repartition("row", "part"))

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            for r in batch.to_pylist():
                starts = _pairs(r["starts"])
                matrix = m.transfer(r["text"], starts, _pairs(r["ends"]), r["start"], r["end"])
                yield pa.RecordBatch.from_pydict({"row": [r["row"]], "part": pa.array([r["part"]], pa.int32()), "starts": pa.array([len(starts)], pa.int32()), "m": [matrix.tobytes()]})

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each group's matrices in order: the product of those before each, and at last (part -1) of all."""
        now, product, width = None, None, 0

        def out(part: int) -> pa.RecordBatch:
            columns = {"row": pa.array([now[0]], pa.int64()), "group": pa.array([now[1]], pa.int32()), "part": pa.array([part], pa.int32())}
            return pa.RecordBatch.from_pydict(columns | {"width": pa.array([width], pa.int32()), "m": [product.tobytes()]})

        for batch in batches:
            for row, group, part, n, raw in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if (row, group) != now:
                    if now is not None:
                        yield out(-1)
                    now, product, width = (row, group), unit(n), n
                yield out(part)
                product = combine(product, np.frombuffer(raw, np.int64).reshape(n, -1))
        if now is not None:
            yield out(-1)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text's groups in order: the best values at their first cuts."""
        now, value = None, np.zeros((1, 1), np.int64)
        for batch in batches:
            for row, group, n, raw in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if row != now:
                    now, value = row, np.zeros((1, 1), np.int64)
                yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "group": pa.array([group], pa.int32()), "value": pa.array([value[0].tolist()], pa.list_(pa.int64()))})
                value = combine(value, np.frombuffer(raw, np.int64).reshape(n, -1))

    def backtraces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            for r in batch.to_pylist():
                value = combine(np.array([r["value"]], np.int64), np.frombuffer(r["m"], np.int64).reshape(r["width"], -1))
                paths = m.backtrace(r["text"], _pairs(r["starts"]), _pairs(r["ends"]), r["start"], r["end"], value[0].tolist())
                for j, (came, ids) in enumerate(paths):
                    yield pa.RecordBatch.from_pydict({"row": [r["row"]], "part": pa.array([r["part"]], pa.int32()), "end": pa.array([j], pa.int32()), "from": pa.array([came], pa.int32()), "ids": [ids]})

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the last chunk's end backwards: the state that the path takes at each cut."""
        now, want, parts = None, 0, []
        for batch in batches:
            for row, end, came, ids in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if row[0] != now:
                    if parts:
                        yield _joined(now, parts, kind)
                    now, want, parts, last = row[0], 0, [], None
                if row[1] != last and end == want:
                    parts.append(ids)
                    want, last = came, row[1]
        if parts:
            yield _joined(now, parts, kind)

    group = F.floor(F.col("part") / GROUP).cast("int")
    matrices = chunks.mapInArrow(lambda it: tidy(transfers(it)), "row long, part int, starts int, m binary").select("row", group.alias("group"), "part", "starts", "m")
    inner = matrices.repartition("row", "group").sortWithinPartitions("row", "group", "part")
    inner = checkpoint(inner.mapInArrow(lambda it: tidy(within(it)), "row long, group int, part int, width int, m binary"))
    products = inner.filter("part < 0").select("row", "group", "width", "m")
    firsts = products.repartition("row").sortWithinPartitions("row", "group").mapInArrow(lambda it: tidy(across(it)), "row long, group int, value array<bigint>")
    reached = inner.filter("part >= 0").join(firsts, ["row", "group"]).drop("group")
    traced = chunks.join(reached, ["row", "part"]).mapInArrow(lambda it: tidy(backtraces(it)), "row long, part int, end int, from int, ids binary")
    ordered = traced.repartition("row").sortWithinPartitions("row", F.desc("part"), "end").select(F.array(F.col("row"), F.col("part").cast("long")).alias("at"), "end", "from", "ids")
    return ordered.mapInArrow(lambda it: tidy(chains(it)), f"__bq_row long, ids {kind}")


def _joined(row: int, parts: list[bytes], kind: str) -> pa.RecordBatch:
    raw = b"".join(reversed(parts))
    ids = pa.array([raw], pa.binary()) if kind == "binary" else pa.ListArray.from_arrays(pa.array([0, len(raw) // 4], pa.int32()), pa.array(np.frombuffer(raw, "<i4")))
    return pa.RecordBatch.from_arrays([pa.array([row]), ids], names=["__bq_row", "ids"])


def decode(encoded: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add ``out``: the text of the ids; null ids give null."""

    @F.pandas_udf("string")
    def text(rows):  # noqa: ANN001, ANN202
        import pandas as pd

        m = model_of(model)
        return pd.Series([None if r is None else m.decode(np.asarray(r)) for r in rows], dtype=object)

    return encoded.withColumn(out, text(ids))
