"""Binary token files: one array of ids, and Elias-Fano coded document boundaries and document numbers.

A store is a folder of shards and a manifest. A shard holds, in ascending order of doc_id, the concatenated ids as
little-endian unsigned integers (two bytes each if the vocabulary allows, else four), then the ends of its documents and
their doc_ids as Elias-Fano sequences, and a footer. Of n values below u a sequence keeps about 2 + log2(u / n) bits each:
the low bits as they are, the high bits in unary, and the place of every 256th one, relative to the sequence and in 32
bits. `select(i)` goes to the sample and counts on from there, and `run(i, j)` gives the values from i on by reading the
unary part once, so that no table of 64-bit offsets is needed. The manifest has each shard's first token, so that a document's
global start is that plus a select. A shard holds about SHARD_BYTES of text, however large the corpus.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ARROW_ROWS, filesystem, materialise, pieces, prepare, put_file, shared_dir, take_memory, text_or_empty
from .bpe import MARKS, Memo
from .bpe import held as transducer

MAGIC = b"EFTOK001"
#: Distinct words that a worker remembers before it starts anew (about 300 MB).
MEMO_WORDS = 1_500_000
#: Bytes of text that are encoded at once.
ENCODED = 8 << 20
#: Letters of a word from which the transducer encodes it.
STREAMED = 1 << 16
#: Ones between two samples of a select structure.
EVERY = 256
#: Ids read from a shard at once, values that are coded at once (a multiple of 8), and bytes of text for a shard.
READ_IDS, CODED, SHARD_BYTES = 1 << 20, 1 << 15, 1 << 30
#: Shards that one range partitioning makes at most, where an estimate of the size is far off.
MOST_SHARDS = 200_000
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of integers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        if np.any(values[1:] < values[:-1]):
            raise ValueError("values must not decrease")
        k = max(0, int((int(values[-1]) + 1) // n).bit_length() - 1)
        low = []
        for at in range(0, n if k else 0, CODED):
            bits = (values[at : at + CODED, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
            low.append(np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little"))
        high = np.zeros((int(values[-1] >> np.uint64(k)) + n) // 8 + 1, np.uint8)
        samples = np.zeros(-(-n // EVERY), np.uint32)
        for at in range(0, n, CODED):
            ones = (values[at : at + CODED] >> np.uint64(k)).astype(np.int64) + np.arange(at, min(at + CODED, n))
            np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
            samples[at // EVERY : at // EVERY + len(ones[::EVERY])] = ones[::EVERY]
        return cls(n, k, np.concatenate(low) if low else np.zeros(0, np.uint8), high, samples)

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        chunk = self.low[at // 8 : (at + self.low_bits + 7) // 8].tobytes()
        return (int.from_bytes(chunk, "little") >> (at % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // EVERY]), i % EVERY
        byte = at // 8
        left += int(_POP[int(self.high[byte]) & ((1 << (at % 8)) - 1)])
        while True:
            counts = np.cumsum(_POP[self.high[byte : byte + 64]])
            if counts[-1] > left:
                break
            left -= int(counts[-1])
            byte += 64
        k = int(np.searchsorted(counts, left, side="right"))
        left -= int(counts[k - 1]) if k else 0
        bit = [b for b in range(8) if int(self.high[byte + k]) >> b & 1][left]
        return (((byte + k) * 8 + bit - i) << self.low_bits) | self._low(i)

    def run(self, i: int, j: int) -> np.ndarray:
        """The values from the i-th to before the j-th: a select of the first, then as much of the unary part as they take."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.int64)
        first = int(self.samples[i // EVERY])
        last = int(self.samples[-(-j // EVERY)]) if -(-j // EVERY) < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[first // 8 : last // 8 + 1], bitorder="little")
        bits[: first % 8] = 0
        skip = i % EVERY
        ones = np.flatnonzero(bits)[skip : skip + j - i] + first // 8 * 8
        out = (ones - np.arange(i, j)) << self.low_bits
        if self.low_bits:
            at = i * self.low_bits
            bits = np.unpackbits(self.low[at // 8 : (j * self.low_bits + 7) // 8], bitorder="little")[at % 8 :]
            out |= bits[: (j - i) * self.low_bits].reshape(j - i, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, k, low, high, samples = struct.unpack_from("<QBQQQ", data)
        at = struct.calcsize("<QBQQQ")
        u8 = np.frombuffer(data, np.uint8)
        return cls(n, k, u8[at : at + low], u8[at + low : at + low + high], np.frombuffer(data, "<u4", samples, at + low + high))


def shard_uri(store: str, number: int) -> str:
    return f"{store}/shard-{number:06d}.tok"


class Shard:
    """Random access to one shard: only its index is held, ids are read as asked for."""

    def __init__(self, uri: str) -> None:
        system, path = filesystem(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 12)
        length, magic = struct.unpack("<I8s", self.file.read(12))
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a token shard")
        self.file.seek(size - 12 - length)
        foot = json.loads(self.file.read(length))
        self.width, self.n_docs, self.n_ids, self.nulls, self.base = (foot[k] for k in ("width", "n_docs", "n_ids", "nulls", "base"))
        self.file.seek(foot["ends"][0])
        self.ends = EliasFano.from_bytes(self.file.read(foot["ends"][1]))
        self.file.seek(foot["docs"][0])
        self.docs = EliasFano.from_bytes(self.file.read(foot["docs"][1]))

    def span(self, i: int) -> tuple[int, int]:
        """First and end token of the i-th document, within the shard."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def read(self, start: int, end: int) -> np.ndarray:
        self.file.seek(start * self.width)
        return np.frombuffer(self.file.read((end - start) * self.width), f"<u{self.width}").astype("<u4")

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        """Those of the documents from the i-th to before the j-th; null ones come first."""
        known = self.docs.run(max(i - self.nulls, 0), max(j - self.nulls, 0)) + self.base
        return [None] * (j - i - len(known)) + known.tolist()

    def close(self) -> None:
        self.file.close()


@lru_cache(maxsize=2)
def _library(path: str):
    # A task has one core; the library's threads would only wait for each other.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    library = _library(path)
    one = lambda w: library.encode(w, add_special_tokens=False).ids
    folds = all(one("Abcé" + m) == one("abcé") + one(m) for m in MARKS) and one("Abcé") == one("abcé")

    suffix = json.loads(library.to_str())["model"].get("end_of_word_suffix")
    last = np.array([bool(suffix) and (library.id_to_token(i) or "").endswith(suffix) for i in range(library.get_vocab_size() + 1)])

    def encode(words: list[str]) -> Iterator[list[int]]:
        out: list[list[int] | None] = [None] * len(words)
        # A word of Latin letters is one pre-token: many go to the library as one text, and their last tokens part its ids.
        plain = [i for i, w in enumerate(words) if len(w) <= 100 and w.isalpha() and (w.isascii() or max(w) < "\u0250")]
        for at in range(0, len(plain) if suffix else 0, 10_000):
            some = plain[at : at + 10_000]
            ids = library.encode_batch_fast([" ".join([words[i] for i in some])], add_special_tokens=False)[0].ids
            ends = (np.flatnonzero(last[ids]) + 1).tolist()
            if len(ends) == len(some):
                for i, a, b in zip(some, [0, *ends[:-1]], ends, strict=True):
                    out[i] = ids[a:b]
        # Words of many thousand letters would take the library memory by their length: they are streamed.
        rest = [i for i, x in enumerate(out) if x is None]
        short = [i for i in rest if len(words[i]) <= STREAMED]
        for i, e in zip(short, library.encode_batch_fast([words[i] for i in short], add_special_tokens=False), strict=True):
            out[i] = e.ids
        for i in rest:
            if len(words[i]) > STREAMED:
                out[i] = [*transducer(path)[0].stream(words[i])]
        return iter(out)

    return Memo(encode, folds, MEMO_WORDS)


def library_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The texts' ids as the tokenizers library gives them, one after the other, and where each text's begin and end.

    None of the tokenizer's pre-tokens or special tokens crosses white space, so that words are encoded once and
    remembered; where the file doesn't show that, whole texts are encoded."""
    if splits_at_space(path):
        return _memo(path).many(texts)
    found = [np.array(_library(path).encode(x or "", add_special_tokens=False).ids, np.uint32) for x in texts.to_pylist()]
    return np.concatenate([np.zeros(0, np.uint32), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)


@lru_cache(maxsize=2)
def splits_at_space(path: str) -> bool:
    """Whether the file's own splitting drops white space and cuts words there, which makes words independent."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
    marks = [x["content"] for x in spec.get("added_tokens", [])]
    return bool(split) and split[0].get("behavior") == "Removed" and split[0].get("invert") is True and not any(c.isspace() for m in marks for c in m) and not any(x.get("lstrip") or x.get("rstrip") for x in spec.get("added_tokens", []))


def write_store(docs: DataFrame, tokenizer: str, store: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> dict:
    """Encode every text, append end_id to each, and write the ids as a store in ascending order of doc_id.

    Rows of one doc_id stay one after another, ordered by their text; null doc_ids come first; a null text is empty and
    gives the end id alone; an empty table gives a store without shards. Other columns are ignored. Texts, not ids, are
    shuffled, by ranges of doc_id, so that a shard is one task's rows and a lost executor costs only its own shards.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    # Catalyst's estimate: the size of the files, or a number beyond all sizes if it knows none.
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    shards = -(-size // SHARD_BYTES) if size < 1 << 60 else 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(shards, MOST_SHARDS))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    width = 2 if max(_library(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        take_memory("token_store", _memo.cache_clear)
        number, ends, keys, nulls, total, docs = TaskContext.get().partitionId(), [], [], 0, 0, 0
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def write(stream) -> None:
            nonlocal nulls, total, docs
            for whole in (x for part in ([first], batches) for x in part):
                for batch in pieces(whole, "text", ENCODED):
                    flat, edges = library_ids(batch.column("text"), tokenizer)
                    stream.write(np.insert(flat.astype(f"<u{width}"), edges[1:], end_id).tobytes())
                    ends.append(total + edges[1:] + np.arange(1, len(edges)))
                    total = int(ends[-1][-1])
                    ids = batch.column("doc_id")
                    nulls += ids.null_count
                    keys.append(ids.drop_null().to_numpy(zero_copy_only=False))
            known = np.concatenate(keys)
            base = int(known[0]) if len(known) else 0
            docs = nulls + len(known)
            parts = [EliasFano.of(np.concatenate(ends)).to_bytes(), EliasFano.of(known - base).to_bytes()]
            at = total * width
            foot = {"width": width, "n_docs": docs, "n_ids": total, "nulls": nulls, "base": base, "ends": [at, len(parts[0])], "docs": [at + len(parts[0]), len(parts[1])]}
            data = json.dumps(foot).encode()
            stream.write(parts[0] + parts[1] + data + struct.pack("<I8s", len(data), MAGIC))

        put_file(shard_uri(store, number), write)
        yield pa.RecordBatch.from_pydict({"shard": [number], "n_docs": [docs], "n_ids": [total]}, schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    # One row a shard: as many as there are partitions, whatever the documents.
    found = sorted(materialise(rows.mapInArrow(run, "shard int, n_docs long, n_ids long"), "token-shards").collect())
    shards, start = [], 0
    for r in found:
        shards.append({"shard": r["shard"], "n_docs": r["n_docs"], "n_ids": r["n_ids"], "start": start})
        start += r["n_ids"]
    manifest = {"width": width, "end_id": end_id, "n_ids": start, "shards": shards}
    put_file(f"{store}/manifest.json", lambda s: s.write(json.dumps(manifest).encode()))
    return manifest


def read_manifest(store: str) -> dict:
    system, path = filesystem(f"{store}/manifest.json")
    with system.open_input_stream(path) as s:
        return json.loads(s.read())


def read_store(spark: SparkSession, store: str, ids: bool = True) -> DataFrame:
    """A store's documents: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.

    ids_crc32 is the unsigned CRC-32 of the document's ids as little-endian unsigned 32-bit integers.
    """
    prepare(spark)
    manifest = read_manifest(store)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame([(s["shard"], s["start"]) for s in manifest["shards"]], "shard int, start long")
    shards = shards.repartition(len(manifest["shards"]), "shard") if len(manifest["shards"]) > 1 else shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(shard_uri(store, number))
                i, first = 0, 0
                while i < shard.n_docs:
                    ends = shard.ends.run(i, min(i + ARROW_ROWS, shard.n_docs))
                    ends = ends[: max(1, int(np.searchsorted(ends, first + READ_IDS, side="right")))]
                    j = i + len(ends)
                    block = shard.read(first, int(ends[-1]))
                    edges = np.concatenate([[first], ends]) - first
                    view = memoryview(block).cast("B")
                    out = {
                        "doc_id": pa.array(shard.doc_ids(i, j), pa.int64()),
                        "start": pa.array(edges[:-1] + first + start, pa.int64()),
                        "n_tokens": pa.array(np.diff(edges), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.int64()),
                    }
                    if ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(block.astype(np.int64)))
                    yield pa.RecordBatch.from_pydict(out)
                    i, first = j, int(ends[-1])
                shard.close()

    return shards.mapInArrow(run, schema)


def store_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write a store of docs in the shared folder and read it back: doc_id, start, n_tokens, ids_crc32.

    Rows are those of docs in ascending order of doc_id, null ones first, rows of one doc_id by their text; a null or empty
    text has the end id alone; an empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    store = shared_dir(spark, "token-store")
    write_store(docs, tokenizer, store, end_id)
    return read_store(spark, store, ids=False)
