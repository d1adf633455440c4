"""Token ids as Arrow IPC files of fixed-size-list batches.

Each task of a range-partitioned, sorted corpus writes one Arrow file whose
record batches hold equal-length sequences (``ids: fixed_size_list<uint16 or
uint32>[seq_len]``, ``mask: fixed_size_list<bool>[seq_len]``; the mask is false
on the padding of a file's last sequence), and beside it an index file with
``doc_id, start, n_tokens`` per document.  All sequences are full but the last
one of a file, so token ``p`` of a file is at row ``p // seq_len``, place
``p % seq_len``: a reader maps the file and reaches any sequence without
copying or decoding.  Files are named by task attempt, and only the attempts
that Spark accepted are listed in the manifest, so retried or speculative
tasks never mix.

Results for odd input: a null text is an empty document (its end id alone); a
null ``doc_id`` sorts first and stays null; repeated rows are separate
documents, ordered by id and then text; an empty table gives no file and no
row; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, small_batches, text_or_empty, worker_state

SEQ_LEN = 2048
BATCH_ROWS = 256
#: Words in a generation of those that a worker remembers, and about how many bytes they take at most.
WORDS_KEPT = 800_000
WORD_BYTES = 192 << 20
#: Tokens that a task reads back, about.
READ_TOKENS = 1 << 23
#: Bytes of text that are encoded together.
CHUNK_BYTES = 4 << 20

MANIFEST = "part int, ids_path string, docs_path string, n_docs long, n_tokens long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class WordEncoder:
    """Ids of whole texts by a byte-level BPE tokenizer, remembering words.

    The pre-tokenizer always has a boundary before a space that follows no
    white space, so a text's ids are the ids of its space-led words in a row.
    Every distinct word goes through the tokenizers library, many words to a
    call; texts with runs of white space go through it whole.  Tokenizers for
    which this does not hold are refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        _check(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        top = max(vocabulary.values()) + 1
        self.dtype = "<u2" if top <= 1 << 16 else "<u4"
        #: Ids that begin with a space: in a row of words each word has one, its first.
        self.leads = np.zeros(top, bool)
        self.leads[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True
        #: By whether a space leads the word: words met lately, and before; and those that a space must not follow.
        self.known: dict[bool, tuple[dict[str, bytes], dict[str, bytes]]] = {False: ({}, {}), True: ({}, {})}
        self.odd: dict[bool, dict[str, bytes]] = {False: {}, True: {}}
        self.size = {False: 0, True: 0}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _encode_led(self, words: list[str]) -> list[bytes]:
        """Ids of each word after a space; no word is empty or has white space at its ends."""
        out: list[bytes] = []
        rows = [" " + " ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        width = np.dtype(self.dtype).itemsize
        for row in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False):
            ids = np.array(row.ids, self.dtype)
            starts = (np.flatnonzero(self.leads[ids]) * width).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]
        return out

    def _learn(self, words: set[str], led: bool) -> dict[str, bytes]:
        """The ids of words that are not among those met lately.

        Words come in two generations: a full one becomes the old one, from
        which words that are met again move on, so rare words are forgotten.
        Odd words, empty or with white space at their end, have a memory of their own.
        """
        strange = {w for w in words if not w or w[-1].isspace()}
        plain = words - strange if strange else words
        known, old = self.known[led]
        size = 200 * len(plain) + 3 * sum(map(len, plain))
        if len(known) + len(plain) > WORDS_KEPT or self.size[led] + size > WORD_BYTES:
            known, old = {}, known
            self.known[led], self.size[led] = (known, old), 0
        self.size[led] += size
        found = {w: old[w] for w in plain if w in old} if old else {}
        new = plain.difference(found)
        alone = [w for w in new if w[0].isspace()] if led else list(new)
        found.update(zip(alone, self._encode([" " + w for w in alone] if led else alone), strict=True))
        if led:
            row = list(new.difference(alone))
            found.update(zip(row, self._encode_led(row), strict=True))
        known.update(found)
        if strange:
            odd = self.odd[led]
            if sum(map(len, odd)) + 200 * len(odd) > WORD_BYTES // 8:
                odd.clear()
            new = [w for w in strange if w not in odd]
            odd.update(zip(new, self._encode([" " + w if led else w for w in new]), strict=True))
            found.update((w, odd[w]) for w in strange)
        return found

    def _ids(self, words: list[str], led: bool) -> list[bytes]:
        ids = list(map(self.known[led][0].get, words))
        gaps = [k for k, i in enumerate(ids) if i is None]
        found = self._learn({words[k] for k in gaps}, led) if gaps else {}
        for k in gaps:
            ids[k] = found[words[k]]
        return ids

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has.

        Arrow cuts the texts and finds the distinct words; only these are
        looked up, and their ids are gathered by place.
        """
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.dictionary_encode()
        words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        head = np.zeros(len(place), bool)
        head[offsets[:-1]] = True
        ids: list[bytes] = []
        slots = []
        for led, used in ((True, place[~head]), (False, place[head])):
            mine = np.zeros(len(words), bool)
            mine[used] = True
            mine = np.flatnonzero(mine)
            slot = np.zeros(len(words), np.int64)
            slot[mine] = len(ids) + np.arange(len(mine))
            ids += self._ids([words[k] for k in mine.tolist()], led)
            slots.append(slot)
        row = np.frombuffer(b"".join(ids), self.dtype)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.dtype).itemsize
        starts = np.cumsum(sizes) - sizes
        slot = np.where(head, slots[1][place], slots[0][place])
        sizes, starts = sizes[slot], starts[slot]
        tokens = row[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        counts = np.add.reduceat(sizes, offsets[:-1])
        # A space after white space: there the pre-tokenizer may keep both together.
        long = pc.binary_length(coded.dictionary).to_numpy()
        odd = ((pc.binary_length(pc.utf8_rtrim_whitespace(coded.dictionary)).to_numpy() < long) | (long == 0))[place]
        odd[offsets[1:] - 1] = False
        whole = np.flatnonzero(np.logical_or.reduceat(odd, offsets[:-1]))
        if len(whole):
            parts = np.split(tokens, np.cumsum(counts)[:-1])
            for n, own in zip(whole.tolist(), self._encode([texts[n].as_py() for n in whole.tolist()]), strict=True):
                parts[n] = np.frombuffer(own, self.dtype)
                counts[n] = len(parts[n])
            tokens = np.concatenate(parts)
        return tokens, counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        tokens, counts = self.flat(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        return [tokens[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)]


def _check(tokenizer) -> None:  # noqa: ANN001
    """Only byte-level BPE that cuts texts before a space, and added tokens that take no space, can go word by word."""
    from tokenizers import models, pre_tokenizers

    cutter = tokenizer.pre_tokenizer
    if not isinstance(tokenizer.model, models.BPE) or not isinstance(cutter, pre_tokenizers.ByteLevel) or cutter.add_prefix_space or not cutter.use_regex:
        raise ValueError("only byte-level BPE tokenizers without a space put in front can go word by word")
    if tokenizer.normalizer is not None or tokenizer.truncation or tokenizer.padding:
        raise ValueError("a normalizer, truncation or padding needs whole texts")
    if any(any(c.isspace() for c in t.content) or t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values()):
        raise ValueError("added tokens that take white space need whole texts")


def encoder_of(path: str) -> WordEncoder:
    """One encoder per worker process, kept for its later tasks."""
    return worker_state(("token files", path), lambda: WordEncoder(path))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of about CHUNK_BYTES at a time."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        chunk = np.cumsum(pc.binary_length(texts).to_numpy()) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield ids.slice(a, b - a), texts.slice(a, b - a)


class _Writer:
    """Packs ids into one file's sequences."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: str, seq_len: int):
        self.dtype, self.seq_len, self.rest = dtype, seq_len, b""
        self.width = np.dtype(dtype).itemsize
        kind = pa.uint16() if self.width == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.sink = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)

    def _rows(self, data: bytes, real: int) -> None:
        values = pa.array(np.frombuffer(data, self.dtype))
        mask = np.ones(len(values), bool)
        mask[real:] = False
        arrays = [pa.FixedSizeListArray.from_arrays(x, self.seq_len) for x in (values, pa.array(mask))]
        self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def add(self, data: bytes) -> None:
        data = self.rest + data
        step = BATCH_ROWS * self.seq_len * self.width
        end = len(data) // step * step
        for at in range(0, end, step):
            self._rows(data[at : at + step], step // self.width)
        self.rest = data[end:]

    def close(self) -> None:
        if self.rest:
            real = len(self.rest) // self.width
            self._rows(self.rest + bytes(-real % self.seq_len * self.width), real)
        self.file.close()
        self.sink.close()


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, seq_len: int = SEQ_LEN, partitions: int | None = None
) -> DataFrame:
    """Write the documents' ids in ascending ``doc_id`` order; the manifest, one row per file.

    ``tokenizer`` is a tokenizers file that every executor can open.  Each
    document's ids end with ``end_id``.  The manifest is written beside the
    files, so reading it never writes them again.
    """
    spark = docs.sparkSession
    small_batches(spark)
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(f"{root}/data", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"data/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        writer, index, at, n_docs, encoder = None, None, 0, 0, encoder_of(tokenizer)
        store, folder = pafs.FileSystem.from_uri(path)
        for ids, texts in _chunks(batches):
            if writer is None:
                writer = _Writer(store, f"{folder}/{name}.arrow", encoder.dtype, seq_len)
                docs_sink = store.open_output_stream(f"{folder}/{name}.docs.arrow")
                index = pa.ipc.new_file(docs_sink, DOCS)
            tokens, counts = encoder.flat(texts)
            sizes = counts + 1
            starts = at + np.cumsum(sizes) - sizes
            writer.add(np.insert(tokens, np.cumsum(counts), end_id).tobytes())
            index.write_batch(pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(starts), pa.array(sizes)], schema=DOCS))
            at += int(sizes.sum())
            n_docs += len(ids)
        if writer is not None:
            writer.close()
            index.close()
            docs_sink.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([context.partitionId()], pa.int32()), "ids_path": [f"{name}.arrow"], "docs_path": [f"{name}.docs.arrow"], "n_docs": [n_docs], "n_tokens": [at]}
            )

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    keys = ["doc_id", F.xxhash64("text")]  # the hash parts rows of one frequent id
    placed = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    placed.sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32, padding``.

    ``start`` counts the ids of all documents before it over all files;
    ``ids_crc32`` is computed from the ids read back; ``padding`` is the number
    of masked places in the document's file.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_file(fs, f"{folder}/{row['ids_path']}", f"{folder}/{row['docs_path']}", row["before"])

    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    # One row per file, so this window is over a list of files.
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("part", "ids_path", "docs_path", F.coalesce(before, F.lit(0)).alias("before"))
    # By the manifest's own size one task would read all files: a task for so many tokens, and for every core at least.
    n, tokens = manifest.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-tokens // READ_TOKENS))))
    return files.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, padding long")


def _open(fs: pafs.FileSystem, path: str):
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path)  # zero-copy
    return fs.open_input_file(path)


def _read_file(fs: pafs.FileSystem, ids_path: str, docs_path: str, before: int) -> Iterator[pa.RecordBatch]:
    with _open(fs, ids_path) as f, _open(fs, docs_path) as d:
        ids, docs = pa.ipc.open_file(f), pa.ipc.open_file(d)
        step = BATCH_ROWS * ids.schema.field("ids").type.list_size
        padding = 0
        if ids.num_record_batches:
            padding = int((~ids.get_batch(ids.num_record_batches - 1).column("mask").flatten().to_numpy(zero_copy_only=False)).sum())
        held, values = -1, None
        for k in range(docs.num_record_batches):
            part = docs.get_batch(k)
            crcs = []
            for start, n in zip(part.column("start").to_numpy(), part.column("n_tokens").to_numpy(), strict=True):
                crc, at, end = 0, int(start), int(start + n)
                while at < end:
                    if held != at // step:
                        held = at // step
                        values = ids.get_batch(held).column("ids").flatten().to_numpy()
                    low = at - held * step
                    high = min(end - held * step, step)
                    crc = zlib.crc32(values[low:high].astype("<u4").tobytes(), crc)
                    at = held * step + high
                crcs.append(crc)
            start = pa.array(part.column("start").to_numpy() + before)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), start, part.column("n_tokens"), pa.array(crcs, pa.int64()), pa.array([padding] * len(crcs), pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "padding"],
            )


def sequence(path: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``row`` of one local file and its mask; the ids are a view of the mapped file."""
    with pa.ipc.open_file(pa.memory_map(path)) as f:
        batch = f.get_batch(row // BATCH_ROWS)
        pair = batch.column("ids")[row % BATCH_ROWS].values, batch.column("mask")[row % BATCH_ROWS].values
        return pair[0].to_numpy(), pair[1].to_numpy(zero_copy_only=False)


def token_table(docs: DataFrame, tokenizer: str, end_id: int, seq_len: int = SEQ_LEN) -> DataFrame:
    """Write the files below the shared folder and read every document back from them."""
    path = fresh_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id, seq_len)
    return read_token_files(docs.sparkSession, path)
