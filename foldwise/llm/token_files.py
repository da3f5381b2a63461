"""Token ids in Arrow stream files of equal-length sequences, written by tasks and read back without copying."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from foldwise.kernels.scan import value_scan
from foldwise.kernels.store import materialize, shared_folder
from foldwise.llm.columns import id_type, pair

#: Sequences in one record batch of a file.
BATCH_SEQUENCES = 256
#: Records handed to Spark at once when files are read.
READ_ROWS = 1000
#: Ids read at once: a bunch of records ends before it would hold more, so only a longer record is larger.
READ_IDS = 1 << 20
#: Words in one generation of a worker's memory: a full one becomes the old generation, words met again come back from it.
KNOWN_WORDS = 400_000


#: Marks that a pre-token of their own holds after a word; an apostrophe may begin a contraction and is none.
MARKS = "!#$%&()*+,-./:;<=>?@[]^`{|}~"
MOST_ENDINGS = 10_000


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary spells bytes above ASCII, as published with such vocabularies: printable Latin-1 as it is,
    the other bytes from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Whole-text ids from a byte-level BPE file of the tokenizers library, with a memory of words.

    Such a tokenizer never merges across a single space between two other characters and gives the space to what follows.
    So a text is cut at those spaces, each piece is encoded once by the library, and its ids are reused. A piece of plain
    letters is one pre-token and goes straight to the library's model; any other piece is encoded as text. The memory has two
    generations, so a vocabulary of words beyond its bound costs the rare words, not all of them.
    """

    def __init__(self, path: str, known: int = KNOWN_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.spelling = _byte_letters()
        self.limit = known
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.endings: dict[str, bytes] = {}

    def _text(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _plain(self, piece: str) -> str | None:
        """A piece of letters only, as the vocabulary spells it; None for any other."""
        if piece.isascii():
            return piece if piece.isalpha() else None
        if not piece.isalpha() or max(piece) >= "ɐ":
            return None
        return "".join([self.spelling[b] for b in piece.encode()])

    def _letters(self, spelt: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(spelt)], self.type).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a space and the piece after it; of the piece alone if it begins with a space, which no split text does. A single line break between other characters and the marks at the end of a
        word are pre-tokens of their own, so the words around them are remembered alone."""
        plain = self._plain(piece)
        if plain is not None:
            return self._letters("Ġ" + plain)
        if piece[0] == " ":
            return self._line(piece[1:])
        first, *lines = piece.split("\n")
        if lines and first and all(line and not line[0].isspace() and not line[-1].isspace() for line in [first, *lines]):
            return self._known(first) + b"".join([self._ending("\n") + self._known(" " + line) for line in lines])
        word = piece.rstrip(MARKS)
        if word and len(word) < len(piece) and word.isalpha():
            return self._known(word) + self._ending(piece[len(word) :])
        return self._text(" " + piece)

    def _line(self, piece: str) -> bytes:
        """Ids of a piece at the beginning of a line."""
        plain = self._plain(piece)
        if plain is not None:
            return self._letters(plain)
        word = piece.rstrip(MARKS)
        if word and len(word) < len(piece) and word.isalpha():
            return self._known(" " + word) + self._ending(piece[len(word) :])
        return self._text(piece)

    def _ending(self, marks: str) -> bytes:
        found = self.endings.get(marks)
        if found is None:
            if len(self.endings) > MOST_ENDINGS:
                self.endings.clear()
            found = self.endings[marks] = self._text(marks)
        return found

    def _known(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is None:
                found = self._piece(piece)
            if "\n" not in piece:
                self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian integers of ``self.type``."""
        if not text:
            return b""
        if len(self.known) > self.limit:
            self.old, self.known = self.known, {}
        first, *pieces = text.split(" ")
        if not pieces or not first or first[-1].isspace():
            return self._awkward(text)
        get = self.known.get
        found = [get(p) for p in pieces]
        if None in found:
            for at, ids in enumerate(found):
                if ids is None:
                    piece = pieces[at]
                    if not piece or piece[0].isspace() or piece[-1].isspace():
                        return self._awkward(text)
                    found[at] = self._known(piece)
        return self._text(first) + b"".join(found)

    def _awkward(self, text: str) -> bytes:
        """Texts with other or repeated white space around a space: cut only where both neighbours are no white space."""
        parts, held = [], ""
        for n, piece in enumerate(text.split(" ")):
            if n and held and not held[-1].isspace() and piece and not piece[0].isspace():
                parts.append(held)
                held = piece
            else:
                held = f"{held} {piece}" if n else piece
        parts.append(held)
        return self._text(parts[0]) + b"".join(
            [self._known(p) if " " not in p and p == p.strip() else self._text(" " + p) for p in parts[1:]]
        )


#: One encoder per worker process and file: its memory of words outlives a task.
ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]


def file_schema(type: np.dtype, length: int) -> pa.Schema:
    ids = pa.list_(pa.from_numpy_dtype(type), length)
    return pa.schema([pa.field("ids", ids), pa.field("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Packs a stream of ids into equal-length sequences; the mask is false on the padding of the last one."""

    def __init__(self, sink, type: np.dtype, length: int):
        self.length, self.type = length, type
        self.schema = file_schema(type, length)
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[bytes] = []
        self.size = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        block = BATCH_SEQUENCES * self.length * self.type.itemsize
        if self.size >= block:
            data = b"".join(self.held)
            whole = len(data) // block * block
            for at in range(0, whole, block):
                self._write(np.frombuffer(data, self.type, BATCH_SEQUENCES * self.length, at), None)
            self.held, self.size = [data[whole:]], len(data) - whole

    def _write(self, ids: np.ndarray, real: int | None) -> None:
        mask = np.ones(len(ids), bool)
        if real is not None:
            mask[real:] = False
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.held), self.type)
        if len(ids):
            self._write(np.concatenate([ids, np.zeros(-len(ids) % self.length, self.type)]), len(ids))
        self.writer.close()


def write_token_files(
    records: DataFrame,
    folder: str,
    tokenizer: str,
    id: str = "entry_id",
    body: str = "body",
    end_id: int = 2,
    length: int = 2048,
) -> DataFrame:
    """Encode every text, append ``end_id``, and write all ids in ascending id order as Arrow files in ``folder``.

    Records are range-partitioned by id; each task writes one ``ids-*.arrow`` file of fixed-size-list batches (sequences of
    ``length`` ids and their mask) and one ``entries-*.arrow`` file with the records' ids and lengths. Any sequence of a
    mapped file is a slice of it, see ``sequence``. Returns the stored manifest ``(shard, path, entries_path, n_entries,
    n_tokens, start)``, one row per file pair in id order, ``start`` counting the ids of earlier files. ``folder`` must be
    shared by all executors and name a store that Arrow can open. A repeated task writes files of new names; only those in
    the manifest count, so a lost executor costs its own files.

    A NULL text is empty: its record is ``end_id`` alone. NULL ids come first; rows that share an id are ordered by text. No
    rows give an empty manifest.
    """
    source = pair(records, id, body)
    ordered = source.repartitionByRange("entry_id").sortWithinPartitions("entry_id", "body")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder = word_encoder(tokenizer)
        store, base = pafs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name = f"{shard:07d}-{uuid.uuid4().hex}.arrow"
        end = np.array([end_id], encoder.type).tobytes()
        entries_schema = pa.schema([first.schema.field(0), pa.field("n_tokens", pa.int64())])
        n_entries = n_tokens = 0
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/ids-{name}") as sink, store.open_output_stream(f"{base}/entries-{name}") as other:
            writer = SequenceWriter(sink, encoder.type, length)
            entries = pa.ipc.new_file(other, entries_schema)
            batch = first
            while batch is not None:
                sizes = []
                for text in batch.column(1):
                    ids = encoder.encode(text.as_py() or "") + end
                    writer.add(ids)
                    sizes.append(len(ids) // encoder.type.itemsize)
                columns = [batch.column(0), pa.array(sizes, pa.int64())]
                entries.write_batch(pa.RecordBatch.from_arrays(columns, schema=entries_schema))
                n_entries += len(sizes)
                n_tokens += sum(sizes)
                batch = next(batches, None)
            writer.close()
            entries.close()
        prefix = folder.rstrip("/")
        row = [[shard], [f"{prefix}/ids-{name}"], [f"{prefix}/entries-{name}"], [n_entries], [n_tokens]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[0], pa.int32()), pa.array(row[1]), pa.array(row[2]), *[pa.array(r, pa.int64()) for r in row[3:]]],
            ["shard", "path", "entries_path", "n_entries", "n_tokens"],
        )

    manifest = ordered.mapInArrow(write, "shard int, path string, entries_path string, n_entries bigint, n_tokens bigint")
    return materialize(value_scan(manifest, [], "shard", {"start": F.col("n_tokens")}))


def open_tokens(path: str) -> pa.ipc.RecordBatchFileReader:
    """Random access to a file; a local one is mapped, not read."""
    store, place = pafs.FileSystem.from_uri(path)
    local = isinstance(store, pafs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(place) if local else store.open_input_file(place))


def sequence(reader: pa.ipc.RecordBatchFileReader, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view of the file) and mask of sequence number ``at``."""
    batch = reader.get_batch(at // BATCH_SEQUENCES)
    row, length = at % BATCH_SEQUENCES, batch.schema.field(0).type.list_size
    ids = batch.column(0).values.to_numpy(zero_copy_only=True)[row * length : (row + 1) * length]
    return ids, batch.column(1).values[row * length : (row + 1) * length].to_numpy(zero_copy_only=False)


def read_records(path: str, entries_path: str, start: int) -> Iterator[pa.RecordBatch]:
    """``(entry_id, start, n_tokens, ids)`` of one file pair in bunches of at most ``READ_ROWS`` records and about ``READ_IDS`` ids,
    however many records share a batch of the file; what is held does not grow with the files."""
    reader, entries = open_tokens(path), open_tokens(entries_path)
    at_batch, held = 0, np.zeros(0, np.uint32)
    for n in range(entries.num_record_batches):
        whole = entries.get_batch(n)
        upto, first = np.cumsum(whole.column(1).to_numpy()), 0
        while first < len(upto):
            before = int(upto[first - 1]) if first else 0
            fitting = int(np.searchsorted(upto, before + READ_IDS, "right")) - first
            part = whole.slice(first, min(READ_ROWS, max(1, fitting)))
            sizes = part.column(1).to_numpy()
            ends = np.cumsum(sizes)
            need, blocks, have = int(ends[-1]), [held], len(held)
            while have < need:
                stored = reader.get_batch(at_batch)
                blocks.append(stored.column(0).values.to_numpy(zero_copy_only=True).astype("<u4"))
                have += len(blocks[-1])
                at_batch += 1
            ids = np.concatenate(blocks)
            held = ids[need:].copy()
            offsets = (np.concatenate(([0], ends)) * 4).astype(np.int64)
            data = [None, pa.py_buffer(offsets), pa.py_buffer(ids[:need].tobytes())]
            binary = pa.Array.from_buffers(pa.large_binary(), len(sizes), data).cast(pa.binary())
            starts = pa.array(start + ends - sizes, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), starts, part.column(1), binary], ["entry_id", "start", "n_tokens", "ids"])
            start += need
            first += len(sizes)


def read_token_files(manifest: DataFrame, kind: str = "bigint") -> DataFrame:
    """``(entry_id, start, n_tokens, ids)`` from the files of a manifest: per record its place in the whole stream, its length
    and its ids as little-endian unsigned 32-bit integers. ``kind`` is the Spark type of the ids of records."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ENCODERS.clear()  # a worker that reads has written its files: the memory of words is free for the ids
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield from read_records(*row)

    files = max(1, manifest.count())
    dealt = manifest.select("path", "entries_path", "start").repartition(files, "path")
    return dealt.mapInArrow(read, f"entry_id {kind}, start bigint, n_tokens bigint, ids binary")


def token_round_trip(
    records: DataFrame, tokenizer: str, id: str = "entry_id", body: str = "body", end_id: int = 2, length: int = 2048
) -> DataFrame:
    """Write the files into a new place of the shared folder and return ``read_token_files`` of them."""
    folder = f"{shared_folder(records.sparkSession).rstrip('/')}/tokens/{uuid.uuid4().hex}"
    manifest = write_token_files(records, folder, tokenizer, id, body, end_id, length)
    return read_token_files(manifest, records.select(id).schema[0].dataType.simpleString())
