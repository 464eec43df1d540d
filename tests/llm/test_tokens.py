import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from braidflow.llm import bpe, token_store

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, start string"
ROWS = [
    (5, "The and attion to thanedble the, anea.", "x", "y"),
    (3, None, None, None),
    (3, "again", None, None),
    (None, "no number", "x", "y"),
    (9, "", "x", "y"),
    (7, "a" * 30_000 + " Straße ΣΑΣ <|endoftext|>x\x1c\u0085 é́ 中文", "x", "y"),
    (5, "The and attion to thanedble the, anea.", "x", "y"),
    (2**40, "far away", "x", "y"),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n):
    rng = random.Random(4)
    alphabets = ["AbÉñß.,!?;: ", "ĲǅŉİΣɐ. a,", "ab ", "etaoin shrdlu", "thand ering.", "é̈añ Σς", "a1 \x1c　.-́'st", "<|endoftext|> a", "aaaa"]
    return ["".join(rng.choice(a) for _ in range(rng.randint(0, 900))) for a in (rng.choice(alphabets) for _ in range(n))]


def test_transducer_equals_library(library):
    machine, _, decoder = bpe.held(PATH)
    for text in random_texts(150):
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode_text(text, PATH).tolist() == ids
        assert list(machine.stream(text)) == list(machine.stream(text, 7)) == ids
        assert decoder.text(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)
        assert token_store.library_ids(pa.array([text]), PATH)[0].tolist() == ids


def test_streaming_emits_early_and_keeps_a_bounded_window():
    machine, _, _ = bpe.held(PATH)
    fed = 0

    def symbols():
        nonlocal fed
        for c in "thandering" * 2000:
            fed += 1
            yield machine.vocab[c]

    out = machine.piece(symbols())
    next(out)
    assert fed <= machine.window
    whole = machine.merge([machine.vocab[c] for c in "thandering" * 300])
    assert list(machine.piece(machine.vocab[c] for c in "thandering" * 300)) == whole


def test_lookahead_is_sufficient_on_a_small_list():
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("c", "d"), ("bc", "d"), ("d", "a")]
    need = bpe.sufficient_lookahead(merges)
    rank = {m: i for i, m in enumerate(merges)}

    def merge(s):
        s = list(s)
        while best := min(((rank[p], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in rank), default=None):
            s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]
        return s

    def edges(tokens):
        return set(np.cumsum([len(t) for t in tokens]).tolist())

    rng = random.Random(1)
    for _ in range(2000):
        head = "".join(rng.choice("abcd") for _ in range(12 + need))
        one, two = (edges(merge(head + "".join(rng.choice("abcd") for _ in range(6)))) for _ in range(2))
        assert {e for e in one if e <= 12} == {e for e in two if e <= 12}
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead([("ab", "c"), ("a", "b")])


@pytest.mark.parametrize("text", ["a" * 150_000, "Zé" * 90_000, "中文字" * 60_000, "!-" * 90_000 + "'s", "don't" * 40_000, "ab1" * 50_000, "İ" * 40_000 + "x" * 40_000, "e\u0301" * 50_000, "x<|endoftext|>" * 12_000, "각" * 30_000])
def test_long_runs_are_streamed(library, text):
    """Texts without white space beyond a block: the same ids, whatever the place of the cuts."""
    machine, _, _ = bpe.held(PATH)
    assert list(machine.stream(text)) == library.encode(text, add_special_tokens=False).ids


def test_a_tokens_own_lookahead_is_sufficient():
    """Each token that a window settles stays, whatever follows."""
    rng = random.Random(3)
    for _ in range(40):
        tokens, merges = ["a", "b", "c"], []
        while len(merges) < 12:
            x, y = rng.choice(tokens), rng.choice(tokens)
            if x + y not in tokens and len(x + y) < 12:
                tokens.append(x + y)
                merges.append((x, y))
        need, rank = bpe.lookaheads(merges), {m: i for i, m in enumerate(merges)}

        def merge(s, rank=rank):
            s = list(s)
            while best := min(((rank[p], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in rank), default=None):
                s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]
            return s

        for _ in range(60):
            head = "".join(rng.choice("abc") for _ in range(30))
            settled, done = [], 0
            for t in merge(head):
                if len(head) - done - len(t) < need.get(t, 0):
                    break
                settled.append(t)
                done += len(t)
            for _ in range(5):
                assert merge(head + "".join(rng.choice("abc") for _ in range(9)))[: len(settled)] == settled


def test_byte_level_decoding_is_incremental(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, decoder = Tokenizer.from_file(path), bpe.held(path)[2]
    text = "naïve 中文 text 🙂 " * 9
    ids = np.array(library.encode(text, add_special_tokens=False).ids)
    for size in (1, 2, 3, 1 << 16):
        monkeypatch.setattr(bpe, "DECODED", size)
        assert decoder.text(ids) == text
    one = [decoder.bytes_of(ids[i : i + 1])[0] for i in range(len(ids))]
    assert "".join(decoder.run(one)) == text
    # Half a character at the end, and ids that no token has.
    assert decoder.text(ids[:2]) == library.decode(ids[:2].tolist()) and decoder.text(np.array([10**6, 15])) == library.decode([15])


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 2, 3], list(range(0, 10**6, 997)), [2**40, 2**41], [7] * 3000 + list(range(8, 900_000, 131))])
def test_elias_fano(values, monkeypatch):
    monkeypatch.setattr(token_store, "CODED", 512)
    ef = token_store.EliasFano.from_bytes(token_store.EliasFano.of(np.array(values, np.int64)).to_bytes())
    rng = random.Random(1)
    for i, j in [(0, len(values))] + [tuple(sorted((rng.randint(0, len(values)), rng.randint(0, len(values))))) for _ in range(40)]:
        assert ef.run(i, j).tolist() == values[i:j]
    with pytest.raises(IndexError):
        ef.run(0, len(values) + 1)
    assert [ef.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_store_round_trip(spark, library, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    store = f"file://{tmp_path}/store"
    manifest = token_store.write_store(docs, PATH, store, 2)
    rows = sorted(token_store.read_store(spark, store).collect(), key=lambda r: r["start"])
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for got, (doc_id, text, *_) in zip(rows, want, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got["doc_id"], got["start"], got["n_tokens"], got["ids"], got["ids_crc32"]) == (doc_id, start, len(ids), ids, crc)
        start += len(ids)
    assert manifest["n_ids"] == start
    for s in manifest["shards"]:
        shard = token_store.Shard(token_store.shard_uri(store, s["shard"]))
        spans = [shard.span(i) for i in range(shard.n_docs)]
        assert spans[-1][1] == s["n_ids"] and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_store.store_digest(empty, PATH).collect() == []
    assert bpe.digests(empty, PATH).collect() == []


def test_digests(spark, library):
    rows = bpe.digests(spark.createDataFrame(ROWS, SCHEMA), PATH).collect()
    want = []
    for doc_id, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.append((doc_id, len(ids), *sha))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_encode_replaces_clashing_columns_and_decodes_back(spark, library):
    out = bpe.decode(bpe.encode(spark.createDataFrame(ROWS, SCHEMA), PATH), PATH)
    assert out.columns == ["doc_id", "text", "start", "ids", "decoded"]
    for r in out.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)


def test_memo_with_and_without_folding(library):
    """The same ids whether words share what they are made of or not, and when the memo starts anew."""
    encode = lambda words: [library.encode(w, add_special_tokens=False).ids for w in words]
    texts = [". , Word word. WORD! wörd; Wörd? word.. 'S it's", None, "", "ªº µm İstanbul ŉ ABC: x", "a." * 300]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for memo in (bpe.Memo(encode), bpe.Memo(encode, folds=True), bpe.Memo(encode, folds=True, words=2)):
        for _ in range(3):
            flat, edges = memo.many(pa.array(texts))
            assert [flat[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == want
