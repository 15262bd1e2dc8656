"""Token ids as binary files: one zstandard frame per document over a shared dictionary.

A dictionary is trained once on the id arrays of a bounded sample.  Documents are dealt to
ranges of their ids in ascending order; the task of a range encodes them, compresses each by
itself with the dictionary and writes blocks through Spark's text writer, whose line
separator closes every block.  A block is

    magic, head (HEAD), dictionary hash (32 bytes), index (INDEX, a row per document), frames

in little-endian numbers, so a file is a sequence of blocks that say how long they are, and a
document is read by its row of the index alone, without the frames before it.  The dictionary
is a block of its own in the folder ``dictionary``; the hash in each block says which one its
frames need.  Ids take two bytes where the vocabulary allows it, else four.

A document's first id counts from its range; the totals of the ranges, one row each, make it
count from the start of the table.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from stratalog.llm.bpe import byte_letters
from stratalog.llm.common import bounded_batches, new_path, pick, spread, written

MAGIC, CLOSE = b"IDBLOCK1", "\r\n<end>\r\n"
# Documents, bytes of an id, range, number of the block there, first id in the range, bytes of frames.
HEAD = struct.Struct("<IIIIQQ")
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("start", "<u8"), ("n_tokens", "<u8"),
                  ("offset", "<u8"), ("length", "<u8")])
BLOCK_BYTES = 1 << 20
BLOCKS_PER_FILE = 64
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 2_000, 16 << 20, 64 << 10
CACHED = 1 << 18  # chunks of text, and pieces of chunks, whose ids a worker keeps
# The parts of a tokenizer file whose effect on PLAIN text is known here: lower case, then
# these pieces, each for itself.  Fixed values of the file.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
# Printable ASCII, its white space, and the letters of Latin-1, which composition leaves alone.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
PLACE = "doc_id long, range int, start long, n_tokens long, file string, at long, length long"
_PLACE = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


class Kept(dict):
    """Values by key, made on demand; the last two generations of ``limit`` keys are kept."""

    def __init__(self, make: Callable, limit: int = CACHED):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str | bytes) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def separable(tokenizer: Tokenizer) -> bool:
    """Whether white space between chunks leaves no trace in the ids, for any pair of samples."""
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    samples = ["ab", "'s", "12", "é", "é", "́a", "漢", "!?", "Σ", "ΑΣ", "İ", " x"]
    return (encode("") == [] == encode(" \t\r\n\x0b\f ")
            and all(encode(f"{w}{a}{w}{b}{w}") == encode(a) + encode(b)
                    for w in (" ", "\n", "\t ", "\r\n", "\x0b", "\f")
                    for a in samples for b in samples))


def width_of(tokenizer: Tokenizer) -> int:
    return 2 if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


@lru_cache(maxsize=1)
def encoder(content: bytes, end_id: int) -> Callable[[str | None], bytes]:
    """Text -> its ids and the end id, serialised; all encoding is the tokenizers library's.

    Where white space only separates, each distinct chunk between ASCII white space is encoded
    once and kept; where the file splits text as known here, ``PLAIN`` texts and chunks are put
    together from pieces that the library's model has encoded.  Other files get whole texts.
    """
    tokenizer, spec = Tokenizer.from_buffer(content), json.loads(content)
    width = width_of(tokenizer)
    end, number = end_id.to_bytes(width, "little"), np.dtype(f"<u{width}")

    def library(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, number).tobytes()

    if not separable(tokenizer):
        return lambda text: library(text or "") + end
    chunks = Kept(lambda chunk: library(chunk.decode()))
    if spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != PRE_TOKENIZER:
        return lambda text: b"".join(map(chunks.__getitem__, (text or "").encode().split())) + end
    model, letters = tokenizer.model, {b: c for c, b in byte_letters().items()}
    pieces = Kept(lambda piece: b"".join([
        t.id.to_bytes(width, "little") for t in model.tokenize(
            piece if piece.isascii() else "".join([letters[b] for b in piece.encode()]))]))
    added = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")

    def plain(text: str) -> bool:
        return bool(PLAIN.fullmatch(text)) and not added.search(text)

    def joined(text: str) -> bytes:
        return b"".join(map(pieces.__getitem__, PIECES.findall(text.lower())))

    def encode(text: str | None) -> bytes:
        text = text or ""
        if plain(text):
            return joined(text) + end
        return b"".join(joined(part) if plain(part := chunk.decode()) else chunks[chunk]
                        for chunk in text.encode().split()) + end

    return encode


def block(rows: list[tuple[int | None, int, bytes]], width: int, key: bytes, part: int, number: int,
          first: int) -> bytes:
    """The bytes of documents (id, number of ids, frame) as a block that starts at id ``first``."""
    index = np.zeros(len(rows), INDEX)
    index["doc_id"] = [r[0] or 0 for r in rows]
    index["known"] = [r[0] is not None for r in rows]
    index["n_tokens"] = [r[1] for r in rows]
    index["length"] = [len(r[2]) for r in rows]
    for name, by in (("start", "n_tokens"), ("offset", "length")):
        index[name][1:] = np.cumsum(index[by])[:-1]
    frames = b"".join(r[2] for r in rows)
    return b"".join((MAGIC, HEAD.pack(len(rows), width, part, number, first, len(frames)), key,
                     index.tobytes(), frames))


def read_blocks(data: memoryview) -> Iterator[tuple[int, int, bytes, int, np.ndarray, int]]:
    """range, id width, dictionary hash, first id, index, place of the frames of each block."""
    at, close = 0, CLOSE.encode()
    while at < len(data):
        if bytes(data[at:at + len(MAGIC)]) != MAGIC:
            raise ValueError(f"no block at {at}")
        n, width, part, _, first, size = HEAD.unpack_from(data, at + len(MAGIC))
        at += len(MAGIC) + HEAD.size
        key = bytes(data[at:at + 32])
        index = np.frombuffer(data, INDEX, n, at + 32)
        frames = at + 32 + index.nbytes
        at = frames + size + len(close)
        if bytes(data[frames + size:at]) != close:
            raise ValueError(f"a block does not end at {frames + size}")
        yield part, width, key, first, index, frames


def _key(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()


def _held(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _save(blocks: DataFrame, path: str) -> None:
    """Rows of binary blocks as they are, each closed by the line separator."""
    (blocks.select(F.col("block").cast("string").alias("value")).write
     .option("lineSep", CLOSE).option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path))


def train_dictionary(docs: DataFrame, content: bytes, end_id: int, sample_rows: int = SAMPLE_ROWS,
                     dictionary_bytes: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for doc, text rows, from about ``sample_rows`` documents chosen by a hash of
    the id, at most ``SAMPLE_BYTES`` of them; empty where they are too few to train on."""
    total = docs.count()
    chosen = F.pmod(F.xxhash64("doc"), F.lit(1 << 30))
    sample = docs.filter(chosen * max(total, 1) < F.lit(sample_rows << 30))

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, arrays, size = encoder(content, end_id), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if size < SAMPLE_BYTES:
                    arrays.append(encode(text))
                    size += len(arrays[-1])
        try:
            made = zstandard.train_dictionary(min(dictionary_bytes, max(256, size // 8)), arrays,
                                              k=64, d=8).as_bytes()
        except zstandard.ZstdError:
            made = b""
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["dictionary"])

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc"), "text")
    made = ordered.select("text").mapInArrow(trained, "dictionary binary").collect()
    return bytes(made[0][0]) if made else b""


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, text: str = "text",
                 doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> str:
    """Write the documents' ids, each with ``end_id`` at its end, in ascending order of the ids.

    Null and empty texts are ``end_id`` alone.  A null id comes first; rows with one id are
    ordered by a hash of their text and kept each for itself.  An empty table writes a
    dictionary and no documents.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    content = Path(tokenizer).read_bytes()
    dictionary = train_dictionary(rows, content, end_id, sample_rows)
    _save(spark.createDataFrame([(bytearray(dictionary),)], "block binary"), f"{path}/dictionary")
    sent = spark.sparkContext.broadcast((content, dictionary))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, dictionary = sent.value
        encode = encoder(content, end_id)
        width = len(encode(None))  # an empty text is the end id alone
        pack = zstandard.ZstdCompressor(level=3, dict_data=_held(dictionary)).compress
        key, part = _key(dictionary), TaskContext.get().partitionId()
        held, size, first, number = [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal held, size, first, number
            out = block(held, width, key, part, number, first)
            first += sum(r[1] for r in held)
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([out], pa.large_binary())], names=["block"])

        for batch in batches:
            for doc, value in zip(*(batch.column(i).to_pylist() for i in range(2))):
                ids = encode(value)
                held.append((doc, len(ids) // width, pack(ids)))
                size += len(held[-1][2]) + INDEX.itemsize
                if size >= BLOCK_BYTES:
                    yield closed()
        if held:
            yield closed()

    # Rows of one id may be many: their texts' hashes and places split them.
    order = [F.col("doc").asc_nulls_first(), F.col("hash"), F.col("row")]
    dealt = (rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
             .repartitionByRange(spread(rows), *order).sortWithinPartitions(*order))
    _save(dealt.select("doc", "text").mapInArrow(blocks, "block binary"), f"{path}/blocks")
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    """The dictionary of a written folder, at most ``DICTIONARY_BYTES``."""
    return bytes(_files(spark, f"{path}/dictionary").select("content").first()[0])[:-len(CLOSE)]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, range, start (in its range), n_tokens, file, at, length: where each document lies."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part, _, _, first, index, frames in read_blocks(memoryview(data.as_buffer())):
                    n = len(index)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip((
                            np.ma.MaskedArray(index["doc_id"], index["known"] == 0),
                            np.full(n, part), index["start"].astype(np.int64) + first,
                            index["n_tokens"].astype(np.int64), [name] * n,
                            index["offset"].astype(np.int64) + frames,
                            index["length"].astype(np.int64)), _PLACE)],
                        names=[c.split()[0] for c in PLACE.split(", ")])

    return _files(spark, f"{path}/blocks").select("path", "content").mapInArrow(places, PLACE)


class Frames:
    """Opens frames of one dictionary."""

    def __init__(self, dictionary: bytes):
        self.key = _key(dictionary)
        self.open = zstandard.ZstdDecompressor(dict_data=_held(dictionary)).decompress

    def ids(self, frame: bytes | memoryview, width: int, key: bytes) -> np.ndarray:
        if key != self.key:
            raise ValueError("the frame needs another dictionary")
        return np.frombuffer(self.open(frame), f"<u{width}").astype("<u4")


def read_tokens(spark: SparkSession, path: str, wanted: DataFrame | None = None,
                ids: bool = True) -> DataFrame:
    """doc_id, range, start (in its range), n_tokens, ids_crc32, ids, read back from the files.

    With ``wanted`` (a table with doc_id) only those documents' frames are opened, in the
    files that hold one of them; without ``ids`` the arrays are left out.
    """
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(read_dictionary(spark, path))
    files = _files(spark, f"{path}/blocks").select("path", "content")
    if wanted is None:
        files = files.withColumn("chosen", F.lit(None).cast("array<long>"))
    else:
        chosen = pick(read_index(spark, path), wanted).groupBy("file").agg(
            F.collect_set("at").alias("chosen"))
        files = files.join(chosen, files["path"] == chosen["file"]).select("path", "content", "chosen")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = Frames(sent.value)
        for batch in batches:
            for data, chosen in zip(batch.column(0), batch.column(1)):
                view = memoryview(data.as_buffer())
                asked = None if chosen.as_py() is None else set(chosen.as_py())
                for part, width, key, first, index, begin in read_blocks(view):
                    held, size = [], 0
                    for r in index:
                        at = begin + int(r["offset"])
                        if asked is not None and at not in asked:
                            continue
                        array = frames.ids(view[at:at + int(r["length"])], width, key)
                        if len(array) != r["n_tokens"]:
                            raise ValueError(f"document {r['doc_id']} has not the ids of its index")
                        data32 = array.tobytes()
                        held.append((int(r["doc_id"]) if r["known"] else None, part,
                                     first + int(r["start"]), len(array), zlib.crc32(data32),
                                     data32 if ids else None))
                        size += len(data32) if ids else 0
                        if size >= 1 << 22 or len(held) >= 4096:
                            yield _batch(held)
                            held, size = [], 0
                    yield _batch(held)

    types = "doc_id long, range int, start long, n_tokens long, ids_crc32 long, ids binary"
    found = files.select("content", "chosen").mapInArrow(opened, types)
    return found if ids else found.drop("ids")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)],
        names=["doc_id", "range", "start", "n_tokens", "ids_crc32", "ids"])


def placed(rows: DataFrame) -> DataFrame:
    """The rows of all documents with ``start`` counted from the first id of the table."""
    ends = rows.groupBy("range").agg(F.max(F.col("start") + F.col("n_tokens")).alias("total"))
    # One row per range: as many as the session has shuffle partitions, whatever the table's size.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    kept = [c for c in rows.columns if c not in ("range", "start")]
    return rows.join(F.broadcast(bases), "range").select(
        *kept, (F.col("base") + F.col("start")).alias("start"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, text: str = "text",
               doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from files written anew."""
    spark = docs.sparkSession
    at = write_tokens(docs, tokenizer, path or new_path(spark, "tokens"), end_id, text, doc_id)
    return placed(written(read_tokens(spark, at, ids=False), "token_rows", True))
