"""Sorted-string-table shards of token ids, and the operator that writes and reads them.

A shard is one immutable file:

    magic | block ... | index | Bloom filter | footer (fixed length) | magic

*Block*: entries in ascending key order. An entry is ``varint(shared) varint(rest) varint(size)
key[shared:] value``; ``shared`` bytes are taken from the key before. Every 16th entry is a restart
point (shared = 0); the block ends with the restart offsets and their number, so a lookup searches
the restarts by bisection and then scans at most 16 entries. The body is zstd-compressed and
followed by its crc32. *Index*: one record a block (last key, offset, length, entries before, ids
before), the sparse index that is searched by bisection. *Bloom filter*: over the keys, by double
hashing. *Footer*: offsets and totals.

A key is a tag byte and the document id as eight big-endian bytes with the sign bit flipped, so byte
order is id order; a null id has a tag of its own and comes last. A value is the ids as little-endian
unsigned integers, of two bytes where the vocabulary permits, else four.

Defined cases: null text is empty text (only the end id is written); null ids sort last; repeated ids
stay as repeated entries in the order of their texts' hashes; a very long text is one entry, read and written
as a whole, and alone in its batch; an empty table gives no shard and no row; other columns are not read. Files are written under a temporary name and moved into place, so a
task that is run again after a lost executor leaves whole files only.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import held, raw_texts, scratch_uri, slices, unsigned_crc

MAGIC = b"QUILSST1"
FOOTER = struct.Struct("<QQQQQQBI")
INDEX = struct.Struct("<9sQIQQ")
RESTART = 16
MANIFEST = "path string, entries long, ids long, low binary, high binary, bytes long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters whose lower case is one letter and which compose with nothing, ASCII and Latin-1, as UTF-8.
_LETTERS = rb"(?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++"
#: What the tokenizer's splitter makes of words of these letters, ASCII digits and ASCII marks without the apostrophe.
_PIECE = re.compile(_LETTERS + rb"|[0-9]|[!-&(-/:-@\[-`{-~]++")
_PLAIN = re.compile(rb"(?:[!-&(-~]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++")
_LATIN = re.compile(_LETTERS)


def byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(others)}


_BYTES = byte_letters()


class WordEncoder:
    """Ids of whole texts by the tokenizers library, remembering words.

    The tokenizer of ``path`` parts text at white space before its merges, so a text's ids are its
    words' ids in order. Words are put into lower case first where the tokenizer would do so anyway and
    the text has neither combining marks (which could compose) nor its special tokens' brackets. A word of
    Latin letters, digits and marks needs no normaliser or splitter: it is cut into its pieces, runs of letters, single digits and runs
    of marks, which are remembered like words, and the letters go straight to the library's merges. Both short cuts are taken only if the
    tokenizer is seen to agree with them. The memory holds at most ``limit`` words (about 200 MB); what it forgets changes no result.
    """

    def __init__(self, path: str, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.width = "H" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "I"
        probe = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("Ab CD.\nx", "Ab", "CD.", "x", "ab")]
        self.by_word, self.by_lower = probe[0] == probe[1] + probe[2] + probe[3], probe[1] == probe[4]
        self.known = Words(self._word, limit)
        tests = ("Straße", "École", "abcdefgh", "été", "ÀÿÞ", "word", "Ñandú")
        self.by_letters = self.by_word and self.by_lower and all(self._letters(x.encode()) == self._whole(x) for x in tests)
        for x in tests if self.by_letters else ():
            mixed = f"{x}.,12{x}%%%{x}#-3"
            self.by_letters &= self._whole(mixed) == b"".join(self._whole(p.decode()) for p in _PIECE.findall(mixed.encode()))

    def _whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letters(self, word: bytes) -> bytes:
        """The ids of a word of Latin letters by the merges alone."""
        text = word.lower().decode() if word.isascii() else word.decode().lower().encode().decode("latin-1").translate(_BYTES)
        return array(self.width, [t.id for t in self.merges(text)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        """The ids of a word that is not known."""
        if self.by_letters:
            if word.isalpha() or _LATIN.fullmatch(word):
                return self._letters(word)
            if b"<|" not in word and _PLAIN.fullmatch(word):
                pieces = _PIECE.findall(word)
                if len(pieces) > 1:
                    return b"".join(map(self.known.__getitem__, pieces))
        return self._whole(word.decode())

    def pack(self, ids) -> bytes:
        return array(self.width, ids).tobytes()

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [self.pack(x.ids) for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        known, out = self.known.__getitem__, []
        for t in texts:
            if self.by_lower and b"<|" not in t and b"\xcc" not in t and b"\xcd" not in t:
                t = t.lower()
            out.append(b"".join(map(known, t.split())))
        return out


class Words(dict):
    """What ``make`` gives for a word, remembered. With half of ``limit`` words new, those of the half before that were not asked for since are forgotten."""

    def __init__(self, make, limit: int):
        self.make, self.half, self.before = make, max(1, limit // 2), {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.make(word)
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


def encoder_of(path: str) -> WordEncoder:
    """The worker process's encoder, whose memory of words serves all of its tasks."""
    return held(("encoder", path), lambda: WordEncoder(path))


def encode_key(doc_id: int | None) -> bytes:
    return b"\x02" + bytes(8) if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def decode_key(key: bytes) -> int | None:
    return None if key[0] == 2 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_positions(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key) * 0x9E3779B1 + zlib.crc32(key[::-1]) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """Streams entries that come in ascending key order into one file."""

    def __init__(self, out, width: int, block_bytes: int = 1 << 16, bits_per_key: int = 10):
        self.out, self.width, self.block_bytes, self.bits_per_key = out, width, block_bytes, bits_per_key
        self.at = out.write(MAGIC) and len(MAGIC)
        self.zip = zstandard.ZstdCompressor(level=1)
        self.index, self.keys = [], []
        self.entries = self.ids = 0
        self._open_block()

    def _open_block(self):
        self.block, self.restarts, self.in_block, self.last = bytearray(), [], 0, b""
        self.before = (self.entries, self.ids)

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        for n in (shared, len(key) - shared, len(value)):
            _varint(self.block, n)
        self.block += key[shared:]
        self.block += value
        self.last = key
        self.keys.append(key)
        self.in_block += 1
        self.entries += 1
        self.ids += len(value) // self.width
        if len(self.block) >= self.block_bytes:
            self._close_block()

    def _put(self, data: bytes) -> int:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    def _close_block(self):
        if self.in_block:
            body = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            body = self.zip.compress(body)
            body += struct.pack("<I", zlib.crc32(body))
            self.index.append(INDEX.pack(self.last, self._put(body), len(body), *self.before))
        self._open_block()

    def finish(self) -> None:
        self._close_block()
        index_at = self._put(b"".join(self.index))
        bits = max(64, len(self.keys) * self.bits_per_key + 7 & ~7)
        bloom = np.zeros(bits, bool)
        for k in set(self.keys):
            bloom[bloom_positions(k, bits, 7)] = True
        bloom_at = self._put(np.packbits(bloom, bitorder="little").tobytes())
        self._put(FOOTER.pack(index_at, len(self.index), bloom_at, bits, self.entries, self.ids, self.width, 7) + MAGIC)


class ShardReader:
    """Reads one shard through any seekable file; holds its index and Bloom filter only."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = self._get(size - FOOTER.size - len(MAGIC), FOOTER.size + len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a shard: bad magic at the end")
        index_at, n, bloom_at, self.bits, self.entries, self.ids, self.width, self.hashes = FOOTER.unpack(tail[: FOOTER.size])
        self.index = list(INDEX.iter_unpack(self._get(index_at, n * INDEX.size)))
        self.last_keys = [x[0] for x in self.index]
        self.bloom = self._get(bloom_at, self.bits // 8)

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> tuple[bytes, list[int]]:
        _, at, n, _, _ = self.index[i]
        data = self._get(at, n)
        if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError(f"block {i}: checksum differs")
        body = zstandard.ZstdDecompressor().decompress(data[:-4])
        (count,) = struct.unpack("<I", body[-4:])
        return body[: -4 - 4 * count], list(struct.unpack(f"<{count}I", body[-4 - 4 * count : -4]))

    @staticmethod
    def walk(body: bytes, at: int = 0):
        key = b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            rest, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest
            yield key, body[at : at + size]
            at += size

    def scan(self):
        for i in range(len(self.index)):
            yield from self.walk(self.block(i)[0])

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_positions(key, self.bits, self.hashes))

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key: Bloom filter, bisection of the index, bisection of the restarts."""
        if not self.may_hold(key):
            return []
        out = []
        for i in range(bisect.bisect_left(self.last_keys, key), len(self.index)):
            body, restarts = self.block(i)
            lo, hi = 0, len(restarts)
            while lo < hi:
                mid = (lo + hi) // 2
                if next(self.walk(body, restarts[mid]))[0] < key:
                    lo = mid + 1
                else:
                    hi = mid
            for k, v in self.walk(body, restarts[max(lo - 1, 0)]):
                if k > key:
                    return out
                if k == key:
                    out.append(v)
        return out


def write_shards(docs: DataFrame, uri: str, tokenizer_path: str | None = None, end_id: int = 1, block_bytes: int = 1 << 16) -> list:
    """Write (doc_id, text) as shards in ascending id order; gives one manifest row a shard, in order.

    The rows are range-partitioned on (doc_id, hash of the text), so an id with very many rows is
    split as well. What comes to the driver is one small row a shard file.
    """
    path = tokenizer_path or default_tokenizer()
    tie = F.xxhash64("text")
    ordered = (
        docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_last(), tie.asc()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), tie.asc())
    )

    def write(batches):
        encoder, writer, low, high = None, None, b"", b""
        fs, folder = pafs.FileSystem.from_uri(uri)
        for batch in slices(batches):
            if writer is None:
                encoder = encoder_of(path)
                end = encoder.pack([end_id])
                fs.create_dir(folder, recursive=True)
                part = f"{folder}/_{uuid.uuid4().hex}.tmp"
                stream = fs.open_output_stream(part)
                writer = ShardWriter(stream, len(end), block_bytes)
            ids = batch.column(0).to_pylist()
            for doc_id, value in zip(ids, encoder.encode_batch(raw_texts(batch))):
                high = encode_key(doc_id)
                low = low or high
                writer.add(high, value + end)
        if writer is not None:
            writer.finish()
            stream.close()
            done = f"{folder}/{uuid.uuid4().hex}.sst"
            fs.move(part, done)
            yield pa.RecordBatch.from_pydict({"path": [done], "entries": [writer.entries], "ids": [writer.ids], "low": [low], "high": [high], "bytes": [writer.at]}, pa.schema([("path", pa.string()), ("entries", pa.int64()), ("ids", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("bytes", pa.int64())]))

    return sorted(ordered.mapInArrow(write, MANIFEST).collect(), key=lambda r: (bytes(r.low), bytes(r.high)))


def read_shards(spark: SparkSession, uri: str, manifest: list) -> DataFrame:
    """Each document of the shards: doc_id, start, n_tokens, ids_crc32; a task a shard."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string"
    start, rows = 0, []
    for r in manifest:
        rows.append((r.path, start))
        start += r.ids
    todo = spark.createDataFrame(rows, "path string, start long")
    if rows:
        todo = todo.repartition(min(len(rows), 4096))

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(path) as f:
                    shard = ShardReader(f)
                    kind = "<u2" if shard.width == 2 else "<u4"
                    for i in range(len(shard.index)):
                        out = []
                        for key, value in shard.walk(shard.block(i)[0]):
                            ids = np.frombuffer(value, kind)
                            out.append((decode_key(key), at, len(ids), unsigned_crc(ids.astype("<u4").tobytes()), os.path.basename(path)))
                            at += len(ids)
                        cols = list(zip(*out))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return todo.mapInArrow(read, schema)


def lookup(uri: str, manifest: list, doc_id: int | None) -> list[np.ndarray]:
    """The ids of one document, by search: shard by key range, then the shard's own index."""
    fs, _ = pafs.FileSystem.from_uri(uri)
    key, out = encode_key(doc_id), []
    for r in manifest:
        if bytes(r.low) <= key <= bytes(r.high):
            with fs.open_input_file(r.path) as f:
                shard = ShardReader(f)
                out += [np.frombuffer(v, "<u2" if shard.width == 2 else "<u4") for v in shard.get(key)]
    return out


def token_shards(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, uri: str | None = None) -> DataFrame:
    """Write the documents' ids as shards and give what is read back from them."""
    uri = uri or scratch_uri(spark, "sst")
    return read_shards(spark, uri, write_shards(docs, uri, tokenizer_path, end_id))
