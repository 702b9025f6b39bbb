"""Token ids as fixed-width packed binary files.

Each id takes the minimum number of bits of the vocabulary.  A file holds the
documents of one range of ids, in ascending order:

    header     magic ``FWBP1``, then version, width in bits, ids in a block,
               number of documents, number of ids, number of blocks (uint64)
    payload    blocks of ``BLOCK`` ids; a block is a whole number of 32-bit words
    doc_id     int64 for each document
    first id   uint64 for each document and one more: where its ids begin
    blocks     uint64 for each block and one more: byte where it begins
    null ids   uint8 for each document: 1 if its doc_id is null
    footer     byte where the payload ends (uint64), magic

Thirty-two ids of w bits are w words exactly, so packing and unpacking are a few
vector operations for each of 32 lanes, and any block can be read on its own.

Texts are encoded where they are read; only packed ids are shuffled.  A file is
written under a temporary name and then renamed, and depends on nothing but its
documents, so a task that runs again makes the same file.  Files go to the
folder that driver and executors share, through any file system that pyarrow
knows.

Defined results: a null or empty text has the end id alone; a very long text is
encoded whole, by one task; equal doc_ids (ties, repeated rows) are in the order of
their ids' bytes and each row is a document; null doc_ids come first; an empty
table gives no files and no rows; columns besides doc_id and text are neither read
nor returned.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm._shared import RangeBuckets, give_back, short_batches, slice_hashes, work_path

MAGIC = b"FWBP1\0\0\0"
BLOCK = 4096
#: Blocks that a writer packs together.
BLOCKS_AT_ONCE = 64
END_ID = 2
#: Distinct pieces of text seen again that a worker keeps, and three quarters as many
#: new ones.  More take memory, fewer take time.
PIECES = 400_000
#: Bytes of text that are cut together, for each piece that is kept.
GROUP = 8
#: New pieces that are encoded together.
TOGETHER = 2000
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_ASCII_SPACE = [c for c in _OTHER_SPACE if c.isascii()]
# Bytes: 1 blank or line end, 2 ASCII letter or digit, 3 other visible ASCII, 0 the rest.
_KIND = np.array([1 if c in b" \n" else 2 if chr(c).isalnum() and c < 128 else 3 if 32 < c < 127 else 0 for c in range(256)], np.uint8)


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, filled up to a multiple of 32 ids."""
    lanes = np.zeros((len(ids) + 31) // 32 * 32, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(-1, 32)
    words = np.zeros((len(lanes), width + 1), np.uint64)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        moved = lanes[:, i] << np.uint64(shift)
        words[:, word] |= moved & np.uint64(0xFFFFFFFF)
        words[:, word + 1] |= moved >> np.uint64(32)
    return words[:, :width].astype("<u4").tobytes()


def unpack(data: bytes | memoryview, n: int, width: int) -> np.ndarray:
    words = np.frombuffer(data, "<u4").reshape(-1, width).astype(np.uint64)
    words = np.concatenate((words, np.zeros((len(words), 1), np.uint64)), axis=1)
    out = np.empty((len(words), 32), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        out[:, i] = (words[:, word] | words[:, word + 1] << np.uint64(32)) >> np.uint64(shift) & mask
    return out.reshape(-1)[:n]


class Encoder:
    """Ids of whole texts, as uint32.

    The tokenizer splits a text into words before anything else.  A word never
    goes on past a letter or digit into other signs, nor past a visible character
    into a blank or line end, so texts are cut there; the pieces are told apart by
    vectorised hashes, which are checked byte by byte, and each piece that is new
    is encoded by the tokenizers library.  A text with other white space, or with
    the string of a special token, is encoded uncut.

    That holds for byte-level BPE without a normalizer alone, so the tokenizer's own
    description is asked; with any other, every text is encoded uncut.

    Pieces that have been seen in one group of texts wait among the ``young``;
    those seen again are ``known``, as most distinct pieces occur once.
    """

    def __init__(self, path: str, pieces: int = PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = self._cuts(json.loads(self.tokenizer.to_str()))
        self.pieces = pieces
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes_of = np.zeros(self.vocabulary, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            # A byte-level token has a character for each byte.
            self.bytes_of[i] = len(token)
        self.known: dict[bytes, bytes] = {}
        self.young: dict[bytes, bytes] = {}

    @staticmethod
    def _cuts(said: dict) -> bool:
        """Whether a tokenizer's description is that of plain byte-level BPE."""
        before, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        return (
            not any(said.get(x) for x in ("normalizer", "truncation", "padding"))
            and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
            and model.get("type") == "BPE"
            and not any(model.get(x) for x in odd)
            and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") for x in said.get("added_tokens", ()))
        )

    def many(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(index, ids) of all texts, not in order."""
        held, size = [], 0
        for i, text in enumerate(texts):
            if not text:
                yield i, np.zeros(0, np.uint32)
            elif self._uncut(text):
                yield i, self._whole(text)
            else:
                data = text.encode("utf-8", "surrogatepass")
                held.append((i, data))
                size += len(data)
                if size >= GROUP * self.pieces:
                    yield from self._group(held)
                    held, size = [], 0
        if held:
            yield from self._group(held)

    def _uncut(self, text: str) -> bool:
        return not self.cuts or any(c in text for c in (_ASCII_SPACE if text.isascii() else _OTHER_SPACE)) or any(x in text for x in self.special)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _group(self, held: list[tuple[int, bytes]]) -> Iterator[tuple[int, np.ndarray]]:
        data = b"".join(x for _, x in held)
        raw = np.frombuffer(data, np.uint8)
        kinds = _KIND[raw]
        cut = np.empty(len(raw), bool)
        cut[1:] = (kinds[1:] == 1) & (kinds[:-1] != 1) | (kinds[1:] == 3) & (kinds[:-1] == 2)
        ends = np.cumsum([len(x) for _, x in held])
        cut[[0, *ends[:-1]]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(raw))
        h = slice_hashes(raw.astype(np.uint64) + np.uint64(1), start, end)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        lengths = end - start
        same = np.array_equal(lengths, lengths[first][which]) and np.array_equal(raw, raw[np.repeat(start[first][which] - start, lengths) + np.arange(len(raw))])
        if not same:  # two pieces have one hash
            for i, x in held:
                yield i, self._whole(x.decode("utf-8", "surrogatepass"))
            return
        found = self._looked_up([data[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(sizes) - sizes
        own = sizes[which]
        upto = np.cumsum(own)
        ids = flat[np.repeat(begin[which] - (upto - own), own) + np.arange(upto[-1])]
        last = upto[np.searchsorted(start, ends) - 1]
        for (i, _), a, b in zip(held, [0, *last], last):
            yield i, ids[a:b]

    def _looked_up(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces, as bytes."""
        young, known = self.young, self.known
        got = list(map(known.get, pieces))
        fresh = []
        for i, x in enumerate(got):
            if x is None:
                p = pieces[i]
                x = young.pop(p, None)
                if x is None:
                    fresh.append(i)
                else:
                    got[i] = known[p] = x
        for i, x in zip(fresh, self._encoded([pieces[i] for i in fresh])):
            got[i] = x
        if len(known) > self.pieces:
            known.clear()
        if len(young) + len(fresh) > self.pieces * 3 // 4:
            young.clear()
        young.update((pieces[i], got[i]) for i in fresh)
        return got

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of new pieces.  They are encoded many at a time, with a line end
        after each, and told apart by the bytes that the ids stand for."""
        out: list[bytes] = []
        for a in range(0, len(pieces), TOGETHER):
            some = pieces[a : a + TOGETHER]
            # A line end would join white space at the beginning of a piece, but for one blank.
            plain = [p for p in some if p[0] != 10 and p[:2] not in (b"  ", b" \n", b" ")]
            joined = b"\n".join([*plain, b""])
            ids = np.array(self.tokenizer.encode_batch_fast([joined.decode("utf-8", "surrogatepass")], add_special_tokens=False)[0].ids, np.uint32) if plain else np.zeros(0, np.uint32)
            until = np.cumsum(self.bytes_of[ids])
            ends = np.cumsum([len(p) + 1 for p in plain]) if plain else np.zeros(0, np.int64)
            # The id of each line end, which must end where the line end does.
            last = np.searchsorted(until, ends)
            if len(plain) and (last[-1] != len(ids) - 1 or not np.array_equal(until[last], ends) or (self.bytes_of[ids[last]] != 1).any()):
                plain, last = [], last[:0]
            first = np.concatenate(([0], last[:-1] + 1)) if len(plain) else last
            data = ids.astype("<u4").tobytes()
            made = {p: data[4 * x : 4 * y] for p, x, y in zip(plain, first.tolist(), last.tolist())}
            out += [made[p] if p in made else self._whole(p.decode("utf-8", "surrogatepass")).astype("<u4").tobytes() for p in some]
        return out

    def __call__(self, text: str | None) -> bytes:
        return next(self.many([text]))[1].astype("<u4").tobytes()


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, pieces: int = PIECES) -> Encoder:
    """One for each worker process; it lives as long as the worker."""
    key = path, pieces
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


class FileWriter:
    """Streams one file: some blocks are written when they are full."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.docs: list[int | None] = []
        self.first: list[int] = [0]
        self.waiting, self.held, self.blocks, self.at = [], 0, [], len(MAGIC) + 48
        out.write(MAGIC + bytes(48))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.first.append(self.first[-1] + len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK * BLOCKS_AT_ONCE:
            self._write(self.held // BLOCK * BLOCK)

    def _write(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        # A block is a whole number of words, so blocks packed together are blocks.
        data = pack(ids[:n], self.width)
        self.blocks += range(self.at, self.at + len(data), BLOCK // 8 * self.width)
        self.out.write(data)
        self.at += len(data)
        self.waiting, self.held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._write(self.held)
        self.blocks.append(self.at)
        for values, kind in (([x or 0 for x in self.docs], "<i8"), (self.first, "<u8"), (self.blocks, "<u8"), ([x is None for x in self.docs], "u1")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(struct.pack("<Q", self.at) + struct.pack("<6Q", 1, self.width, BLOCK, len(self.docs), self.first[-1], len(self.blocks) - 1) + MAGIC)
        self.out.close()


class FileReader:
    """Random access to a file: reads the blocks that are asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 64)
        end = source.read(64)
        if end[-8:] != MAGIC:
            raise ValueError("not a packed id file, or one that is incomplete")
        self.payload_end, _, self.width, self.block, n, self.n_ids, blocks = struct.unpack("<7Q", end[:56])
        source.seek(self.payload_end)
        tail = source.read(size - 64 - self.payload_end)
        self.doc_ids = np.frombuffer(tail, "<i8", n)
        self.first = np.frombuffer(tail, "<u8", n + 1, 8 * n).astype(np.int64)
        self.blocks = np.frombuffer(tail, "<u8", blocks + 1, 16 * n + 8).astype(np.int64)
        self.null = np.frombuffer(tail, "u1", n, 16 * n + 8 * blocks + 16)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids from the begin-th up to the end-th of the file."""
        if begin >= end:
            return np.zeros(0, np.uint32)
        a, b = begin // self.block, (end - 1) // self.block + 1
        self.source.seek(int(self.blocks[a]))
        data = self.source.read(int(self.blocks[b] - self.blocks[a]))
        found = unpack(data, min(self.n_ids, b * self.block) - a * self.block, self.width)
        return found[begin - a * self.block : end - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.first[i]), int(self.first[i + 1]))

    def documents(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, some blocks at a time."""
        i, n = 0, len(self.doc_ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.first, self.first[i] + ids_at_once, "right")) - 1)
            j, base = min(j, n), int(self.first[i])
            held = self.ids(base, int(self.first[j]))
            for k in range(i, j):
                yield (None if self.null[k] else int(self.doc_ids[k])), held[self.first[k] - base : self.first[k + 1] - base]
            i = j


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, rows_each: int = 250, pieces: int = PIECES) -> list[tuple[int, str, int, int]]:
    """Encode ``docs`` and write the files.  Returns (part, path, documents, ids)
    of each file in ascending order, one for each range of ids."""
    short_batches(docs.sparkSession)
    ranges = RangeBuckets.of(docs, "doc_id", rows_each)
    width = width_of(Encoder(tokenizer_path).vocabulary)
    narrow = "<u2" if width <= 16 else "<u4"

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made, end = encoder(tokenizer_path, pieces), np.array([end_id], narrow).tobytes()
        for texts in batches:
            out = [b""] * len(texts)
            for i, ids in made.many(list(texts)):
                out[i] = ids.astype(narrow).tobytes() + end
            yield pd.Series(out, dtype=object)
        give_back()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        files.create_dir(root, recursive=True)
        part, writer, names, told = None, None, ("", ""), []

        def done():
            writer.close()
            files.move(*names)
            told.append((part, names[1], len(writer.docs), writer.first[-1]))

        for batch in batches:
            for p, d, x in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                if p != part:
                    if writer:
                        done()
                    part, names = p, (f"{root}/.{p:05d}-{os.urandom(8).hex()}", f"{root}/{p:05d}.fwb")
                    writer = FileWriter(files.open_output_stream(names[0]), width)
                writer.add(d, np.frombuffer(x, narrow).astype(np.uint32))
        if writer:
            done()
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*told) if told else [()] * 4, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "path", "docs", "n"])
        give_back()

    encoded = docs.select("doc_id", ranges.index(F.col("doc_id")).alias("part"), encode(F.coalesce("text", F.lit(""))).alias("ids"))
    dealt = encoded.repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    found = dealt.mapInArrow(store, "part int, path string, docs bigint, n bigint").collect()
    return sorted((r["part"], r["path"], r["docs"], r["n"]) for r in found)


def read(spark: SparkSession, files: list[tuple[int, str, int, int]], folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    rows, start = [], 0
    for part, path, _, n in files:
        rows.append((part, path, start))
        start += n

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_file(path) as source:
                    out, at = [], base
                    for doc_id, ids in FileReader(source).documents():
                        out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One task for some files each; the list has 1024 rows at most.
    listed = spark.createDataFrame(rows, "part int, path string, base long").repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)), "part")
    return listed.mapInArrow(scan, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenised(docs: DataFrame, tokenizer_path: str, pieces: int = PIECES) -> DataFrame:
    spark = docs.sparkSession
    folder = work_path(spark, "ids")
    return read(spark, write(docs, tokenizer_path, folder, pieces=pieces), folder)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
