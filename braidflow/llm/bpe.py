"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list is proper when every merge's parts come from earlier merges. Then whether a boundary q survives depends,
to the right of q, on a bounded number of symbols, which `sufficient_lookahead` derives from the list itself. While q is
a boundary, the text on either side evolves as if it stood alone; q falls at the first merge (x, y) of which x is then
the last token on the left and y the first on the right. To know that y stands there, one asks the same of y's own end,
with y as the whole left side: what ends there is then a token of y's right spine, and the merge comes earlier. The
recursion over merges gives the symbols to look at. The transducer keeps a window from the last certain boundary on,
merges it, emits each token behind which as many symbols stand as its own end needs, and slides: its memory does not
depend on the text's length. A pre-token's end settles all that is held. No token crosses white space, so that words reach
the transducer one by one, and a bounded memo keeps what it gave for the last ones; a run without white space is normalised
and split part by part. The decoder turns tokens into bytes and these, block by block, into text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import give_back, own, pieces, prepare, take_memory, tidied

#: Distinct words, and their mean tokens, that a worker remembers before it starts anew (about 50 MB); words beyond LONG_WORD never are.
MEMO_WORDS, MEMO_TOKENS_A_WORD, LONG_WORD = 250_000, 8, 200
#: Bytes of text that are encoded at once, and characters of a run without white space that are.
CHUNK, BLOCK = 1 << 20, 1 << 16
#: Bytes that the decoder's machine takes at once.
DECODED = 1 << 16
_SPACE = re.compile(r"[ \t\n\r\x0b\f]")
#: Marks that a word can end in, and words of Latin letters with one of them or none.
MARKS = [*".,!?;:"]
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u024f]+[.,!?;:]?$"
_PLAIN = re.compile(r"([a-z]+)([.,!?]?)")
_BITS, _NONE = 24, 1 << 60


def lookaheads(merges: list[tuple[str, str]], suffix: str = "") -> dict[str, int]:
    """For each token that merges name, the symbols right of its end that settle whether that end is final, for a proper
    merge list without repeated results."""
    rank: dict[str, int] = {}
    right: dict[str, str] = {}
    for i, (a, b) in enumerate(merges):
        if a + b in rank:
            raise ValueError(f"two merges give {a + b!r}")
        rank[a + b], right[a + b] = i, b
    made: dict[str, tuple[list[int], list[int]]] = {}

    def length(token: str) -> int:
        return len(token) - len(suffix) if suffix and token.endswith(suffix) and token != suffix else len(token)

    def beyond(token: str, before: int) -> int:
        """Symbols after the token that decide whether its end holds until the merge of rank `before`."""
        most, limit = 0, before
        while True:
            if token in made:
                ranks, highest = made[token]
                if n := bisect_left(ranks, limit):
                    most = max(most, highest[n - 1])
            if token not in rank:
                return most
            limit, token = rank[token], right[token]

    for i, (a, b) in enumerate(merges):
        if any(rank.get(x, -1) >= i for x in (a, b)):
            raise ValueError(f"merge {i} uses a later one: the list isn't proper")
        need = length(b) + beyond(b, i)
        ranks, highest = made.setdefault(a, ([], []))
        ranks.append(i)
        highest.append(max(need, highest[-1] if highest else 0))
    return {t: beyond(t, len(merges)) for t in {x for m in merges for x in (*m, "".join(m))}}


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """Symbols right of any boundary that settle whether it is final."""
    return max(lookaheads(merges, suffix).values(), default=0)


class Transducer:
    """Encoder of a tokenizers-style BPE file; the library splits words into pre-tokens, the merging is done here."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE models are supported")
        # For normalising and splitting alone: without the model's tables.
        library = Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None, "decoder": None}))
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str if library.pre_tokenizer else lambda x: [(x, (0, len(x)))]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        needs = lookaheads(merges, self.suffix)
        self.lookahead = max(needs.values(), default=0)
        self.window = 2 * self.lookahead + max(len(x) for x in self.vocab)
        #: What two tokens that merge give: the merge's rank in the upper bits and the new token in the lower ones.
        self.pairs = {(self.vocab[a], self.vocab[b]): i << _BITS | self.vocab[a + b] for i, (a, b) in enumerate(merges)}
        k, size = len(self.suffix), max(self.vocab.values()) + 1
        #: By id: symbols of the token, and symbols to see after it before it is final.
        self.sizes, self.needs = array("i", bytes(4 * size)), array("i", bytes(4 * size))
        for t, i in self.vocab.items():
            self.sizes[i] = len(t) - k if k and t.endswith(self.suffix) and len(t) > k else len(t)
            self.needs[i] = needs.get(t, 0)
        self.plain = {c: self.vocab[c] for c in map(chr, range(33, 127)) if c in self.vocab}
        self.final = {c: self.vocab[c + self.suffix] for c in map(chr, range(33, 127)) if c + self.suffix in self.vocab}
        self.lower = any(x.get("type") == "Lowercase" for x in (spec.get("normalizer") or {}).get("normalizers", []))
        self.quick = self.lower and bool(self.suffix) and self._letters_stand_alone()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.longest_special = max(map(len, self.special), default=0)
        self.byte_level = "ByteLevel" in json.dumps(spec.get("decoder"))

    def _letters_stand_alone(self) -> bool:
        """Whether the library's splitting leaves ASCII letters and a following mark as two pre-tokens."""
        return [x for x, _ in self.split("abc.")] == ["abc", "."] and [x for x, _ in self.split("zq")] == ["zq"]

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a short list: the lowest rank first, the leftmost of equals."""
        if len(ids) > 200:
            return self._merge_long(ids)
        get = self.pairs.get
        found = [get(x, _NONE) for x in zip(ids, ids[1:], strict=False)]
        while found and (least := min(found)) < _NONE:
            i = found.index(least)
            new = least & ((1 << _BITS) - 1)
            ids[i : i + 2] = [new]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], new), _NONE)
            if i < len(found):
                found[i] = get((new, ids[i + 1]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of what can merge; stale entries are passed over."""
        pairs, n = self.pairs, len(ids)
        ids, after, before = ids[:], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            found, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            new = found & ((1 << _BITS) - 1)
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := pairs.get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (found, i, new, ids[k]))
            if (h := before[i]) >= 0 and (found := pairs.get((ids[h], new))) is not None:
                heapq.heappush(heap, (found, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def piece(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of one pre-token's symbols, each emitted once no later symbol can change it: at the latest when twice the
        list's lookahead is held, or when the pre-token ends."""
        window: list[int] = []
        for s in symbols:
            window.append(s)
            if len(window) >= self.window:
                yield from self._settled(window)
        yield from self.merge(window)

    def _settled(self, window: list[int]) -> list[int]:
        """Takes from the window the tokens behind which enough symbols stand."""
        left, out = len(window), []
        for token in self.merge(window[:]):
            if left - self.sizes[token] < self.needs[token]:
                break
            left -= self.sizes[token]
            out.append(token)
        del window[: len(window) - left]
        return out

    def word(self, word: str) -> list[int]:
        """Ids of a text without ASCII white space."""
        if self.quick and len(word) <= LONG_WORD:
            if (m := _PLAIN.fullmatch(word if word.islower() else word.lower() if word.isascii() else "")) is not None:
                letters, mark = m.groups()
                # Shorter than the window: all of it is settled by the end of the word.
                out = self.merge([*map(self.plain.__getitem__, letters[:-1]), self.final[letters[-1]]])
                if mark:
                    out.append(self.final[mark])
                return out
        return [*self.stream(word)]

    def stream(self, text: str, size: int = BLOCK) -> Iterator[int]:
        """Ids of any text, token by token. Only some `size` characters are normalised and split at once; a pre-token may go
        on from one part to the next."""
        run: Run | None = None
        for joined, found in self._parts(text, size):
            for p in found:
                if run is not None and not joined:
                    yield from run.end()
                    run = None
                joined = False
                if isinstance(p, int):
                    yield p
                    continue
                run = run or Run(self)
                yield from run.feed(p)
        if run is not None:
            yield from run.end()

    def _parts(self, text: str, size: int) -> Iterator[tuple[bool, list[str | int]]]:
        """Pre-tokens of parts of the text, or a special token's id, and whether the first goes on with the last one before."""
        start, before = 0, ""
        while start < len(text):
            end = self._end(text, start + size)
            for part in self.cut.split(text[start:end]) if self.cut else [text[start:end]]:
                if part in self.special:
                    before = ""
                    yield False, [self.special[part]]
                elif part:
                    normal = self.normalise(part)
                    a, b = before[-1:], normal[:1]
                    joined = bool(a and b) and (a.isalpha() and b.isalpha() or _other(a) and _other(b))
                    if found := [p for p, _ in self.split(normal) if p]:
                        yield joined, found
                    before = normal
            start = end

    def _end(self, text: str, at: int) -> int:
        """The first place from `at` on where the text can be parted: at white space, or inside a run of letters or of ASCII
        marks, where nothing composes, no contraction is near and no special token stands."""
        for i in range(at, len(text)):
            a, b = text[i - 1], text[i]
            if a in " \t\n\r" or b in " \t\n\r":
                return i
            letters = a.isalpha() and b.isalpha() and not "\u1160" <= b <= "\u11ff"
            marks = a.isascii() and b.isascii() and _other(a) and _other(b) and b != "'"
            digits = a.isascii() and b.isascii() and a.isdigit() and b.isalnum()
            if (letters or marks or digits) and "'" not in text[i - 4 : i]:
                k = self.longest_special
                if self.cut is None or not any(m.start() < min(i, k) < m.end() for m in self.cut.finditer(text[max(0, i - k) : i + k])):
                    return i
        return len(text)


def _other(c: str) -> bool:
    """Neither a letter, a number nor white space."""
    return not c.isspace() and not c.isalnum()


class Run:
    """A pre-token's characters as they come. The last one's symbol has the suffix, so that each waits for the next."""

    def __init__(self, transducer: Transducer) -> None:
        self.of, self.window, self.held = transducer, [], ""

    def feed(self, characters: str) -> Iterator[int]:
        for c in characters:
            if self.held and (s := self.of.vocab.get(self.held)) is not None:
                self.window.append(s)
                if len(self.window) >= self.of.window:
                    yield from self.of._settled(self.window)
            self.held = c

    def end(self) -> list[int]:
        if (s := self.of.vocab.get(self.held + self.of.suffix)) is not None:
            self.window.append(s)
        return self.of.merge(self.window)


class Decoder:
    """Ids to text. Each token stands for bytes: with a byte-level decoder those that its characters stand for; without any
    decoder the library joins the tokens by one space, and so a token's bytes are a space and its characters, the first
    one's less the space. The bytes go, some thousand at a time, through an incremental UTF-8 machine, which holds what is
    left of a character. Ids outside the vocabulary give nothing."""

    def __init__(self, transducer: Transducer) -> None:
        surface = {i: t for t, i in transducer.vocab.items()} | {i: t for t, i in transducer.special.items()}
        self.size, self.joined = max(surface) + 1, not transducer.byte_level
        table = byte_table()

        def token(t: str | None) -> bytes:
            if t is None:
                return b""
            return b" " + t.encode() if self.joined else t.encode() if t in transducer.special else bytes(table[c] for c in t if c in table)

        self.tokens = pa.array([*(token(surface.get(i)) for i in range(self.size)), b""], pa.binary())
        self.numbers = pa.array([f" {i}".encode() for i in range(self.size)], pa.binary())

    def bytes_of(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The tokens' bytes one after the other, and where each token's begin and end."""
        return _buffer(self.tokens.take(pa.array(np.minimum(ids, self.size))))

    def decimals(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The ids as decimals, each after a space, and where each begins and ends."""
        return _buffer(self.numbers.take(pa.array(ids)))

    def run(self, blocks: Iterable[memoryview]) -> Iterator[str]:
        """Text of one sequence of tokens, given as the bytes of block after block."""
        machine, first = codecs.getincrementaldecoder("utf-8")("replace"), self.joined
        for block in blocks:
            if first and len(block):
                block, first = block[1:], False
            for at in range(0, len(block), DECODED):
                yield machine.decode(block[at : at + DECODED])
        yield machine.decode(b"", True)

    def text(self, ids: np.ndarray) -> str:
        return "".join(self.run([self.bytes_of(np.asarray(ids))[0]]))


def _buffer(taken: pa.Array) -> tuple[memoryview, np.ndarray]:
    offsets = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
    data = taken.buffers()[2]
    return memoryview(data) if data is not None else memoryview(b""), offsets


@lru_cache(maxsize=1)
def byte_table() -> dict[str, int]:
    """Bytes by the printable characters that stand for them in byte-level vocabularies: those that print stand for
    themselves, the others follow from 256 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    for n, b in enumerate(x for x in range(256) if x not in set(shown)):
        table[chr(256 + n)] = b
    return table


def slices(text: str, size: int = CHUNK) -> Iterator[str]:
    """A text in parts of some hundred thousand characters that end at ASCII white space."""
    start = 0
    while start < len(text):
        end = start + size
        m = _SPACE.search(text, end) if end < len(text) else None
        end = m.start() if m else len(text)
        yield text[start:end]
        start = end


class Memo(dict):
    """Word to row of a bounded table of token ids. encode gives the ids of a list of words. With folds, a word of Latin
    letters and a mark or none is its lower-cased letters and the mark: the tokenizer must lower-case and part them there."""

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]], folds: bool = False, words: int = MEMO_WORDS) -> None:
        super().__init__()
        self.encode, self.folds, self.words = encode, folds, words
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.ids, self.starts, self.sizes = array("I"), array("q"), array("i")
        self.hold([""], [[]])
        if self.folds:
            self.hold(MARKS, list(self.encode(MARKS)))

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an array of texts, one after the other, as unsigned 32-bit integers, and where each text's begin
        and end. Splitting, folding and finding the distinct words is Arrow's; Python sees each of those once."""
        texts = pc.fill_null(texts, "")
        if len(texts) == 1 and texts.nbytes > 2 * CHUNK:
            parts = [self.many(pa.array([x], pa.string()))[0] for x in slices(texts[0].as_py())]
            flat = np.concatenate(parts)
            return flat, np.array([0, len(flat)])
        if len(self.starts) > self.words or len(self.ids) > MEMO_TOKENS_A_WORD * self.words:
            self.reset()
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        stems, marks = words.dictionary, np.zeros(len(words.dictionary), np.int64)
        if self.folds:
            plain = pc.match_substring_regex(stems, LETTERS)
            last = pc.index_in(pc.utf8_slice_codeunits(stems, -1), pa.array(MARKS))
            marks = np.where(plain.to_numpy(zero_copy_only=False), pc.fill_null(last, -1).to_numpy() + 1, 0)
            stems = pc.if_else(plain, pc.utf8_rtrim(pc.utf8_lower(stems), "".join(MARKS)), stems)
        stems = stems.dictionary_encode()
        distinct = stems.dictionary.to_pylist()
        found = list(map(self.get, distinct))
        new = [i for i, row in enumerate(found) if row is None]
        if new:
            fresh = [distinct[i] for i in new]
            first = len(self.starts)
            self.hold(fresh, list(self.encode(fresh)))
            for row, i in enumerate(new, first):
                found[i] = row
            for w in fresh:
                if len(w) > LONG_WORD:
                    del self[w]
        # Two rows for each word: its stem's and its mark's, or the empty one.
        both = np.stack([np.array(found, np.int64)[stems.indices.to_numpy()], marks], 1)
        rows = both[words.indices.to_numpy()].reshape(-1)
        sizes = np.frombuffer(self.sizes, np.int32)[rows]
        ends = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        # Where each row's ids are held, less where they go: added to every place they go to.
        shift = (np.frombuffer(self.starts, np.int64)[rows] - ends[:-1]).astype(np.int32)
        at = np.repeat(shift, sizes)
        at += np.arange(len(at), dtype=np.int32)
        return np.frombuffer(self.ids, np.uint32)[at], ends[2 * lists.offsets.to_numpy().astype(np.int64)]

    def hold(self, words: list[str], lists: list[list[int]]) -> None:
        first, end = len(self.starts), len(self.ids)
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        self.ids.extend(chain.from_iterable(lists))
        self.sizes.frombytes(sizes.tobytes())
        self.starts.frombytes((end + np.cumsum(sizes, dtype=np.int64) - sizes).tobytes())
        self.update(zip(words, range(first, first + len(words)), strict=True))


_HELD: dict[str, tuple[Transducer, Memo, Decoder]] = {}


def held(path: str) -> tuple[Transducer, Memo, Decoder]:
    """This worker's transducer, the words that it remembers and the decoder."""
    if path not in _HELD:
        t = Transducer(path)
        folds = t.word("Abcé") == t.word("abcé") and all(t.word("Abcé" + m) == t.word("abcé") + t.word(m) for m in MARKS)
        _HELD[path] = t, Memo(lambda words: map(t.word, words), folds), Decoder(t)
        give_back()  # what building the tables took
    return _HELD[path]


def encode_text(text: str | None, path: str) -> np.ndarray:
    return held(path)[1].many(pa.array([text], pa.string()))[0]


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with their texts' ids, one after the other, and where each text's begin and end."""
    take_memory("bpe", _HELD.clear)
    memo = held(tokenizer)[1]
    for whole in batches:
        for batch in pieces(whole, text, CHUNK):
            yield batch, *memo.many(batch.column(text))


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with its tokens' ids as array<int>, and their decoding as text if a column for it is named.

    Rows, their order and all other columns stay. A null text counts as empty: no ids, empty decoding. Repeated rows stay
    repeated. A column that already has one of the new names is replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(ids, *([decoded] if decoded else []))
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if decoded:
        schema.add(decoded, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, edges in encoded(batches, tokenizer, text):
            arrays = [*batch.columns, pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.astype(np.int32)))]
            if decoded:
                decoder = held(tokenizer)[2]
                data, at = decoder.bytes_of(flat)
                arrays.append(pa.array(["".join(decoder.run([data[a:b]])) for a, b in spans(at, edges)], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.mapInArrow(tidied(run), schema)


def spans(at: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each text's bytes begin and end, given where its tokens do."""
    ends = at[edges].tolist()
    return zip(ends[:-1], ends[1:], strict=True)


def decode(tokens: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """tokens with the text of its array of ids, by the incremental machine; null ids give the empty text."""
    prepare(tokens.sparkSession)
    tokens = tokens.drop(text)
    schema = T.StructType([*tokens.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("bpe", _HELD.clear)
        decoder = held(tokenizer)[2]
        for batch in batches:
            rows = batch.column(ids).to_pylist()
            # Ids beyond the vocabulary, negative ones too, give nothing.
            texts = [decoder.text(np.array([i if i >= 0 else decoder.size for i in x or [] if i is not None], np.int64)) for x in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return tokens.mapInArrow(tidied(run), schema)


def digest_rows(docs: DataFrame, tokenizer: str, keep: list[str], ids: str | None = None, text: str = "text") -> DataFrame:
    """The columns `keep` of docs, n_tokens, SHA-256 of the decimal ids and of the decoded text, and, if a column for them is
    named, the ids. Digests are made where the tokens are, so that neither decimals nor decodings leave the worker."""
    prepare(docs.sparkSession)
    docs = docs.select(*keep, F.col(text).alias(own("text")))
    more = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        more.insert(1, T.StructField(ids, T.ArrayType(T.IntegerType())))
    schema = T.StructType([*docs.schema.fields[:-1], *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, edges in encoded(batches, tokenizer, own("text")):
            decoder = held(tokenizer)[2]
            data, at = decoder.decimals(flat)
            numbers = [hashlib.sha256(data[min(a + 1, b) : b]).hexdigest() for a, b in spans(at, edges)]
            data, at = decoder.bytes_of(flat)
            texts = []
            for a, b in spans(at, edges):
                sha = hashlib.sha256()
                for part in decoder.run([data[a:b]]):
                    sha.update(part.encode())
                texts.append(sha.hexdigest())
            arrays = [*batch.columns[:-1], pa.array(np.diff(edges), pa.int64()), pa.array(numbers, pa.string()), pa.array(texts, pa.string())]
            if ids:
                arrays.insert(-2, pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.mapInArrow(tidied(run), schema)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of its decimal ids and of its decoded text.

    A null or empty text has no tokens and the digests of the empty text; rows that repeat a doc_id each have their own;
    an empty table gives an empty one; other columns are ignored.
    """
    return digest_rows(docs, tokenizer, ["doc_id"])
