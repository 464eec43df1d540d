"""Language identification by error-correcting output codes.

Each language has a codeword of plus and minus ones. For each bit a binary classifier on hashed character n-grams tells
the languages with +1 from those with -1; its loss on a text, weighted by how well it separates the fitting texts, is added up for
each codeword, and the codeword of the least loss names the language. Texts of which the two best codewords are nearly as
near are flagged as ambiguous.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import crc32_mod, own, pieces, prepare

#: Hashed n-grams, texts of each language to fit on (their expected number), and the gap in loss that flags ambiguity.
DIMENSIONS, FIT_DOCS, GAP = 1 << 13, 3000, 0.05
#: Characters of a text that are counted at once.
SLICE = 1 << 20
_ODD = np.array([2654435761, 40503, 2246822519, 3266489917], np.uint32)


def grams(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of the whole lower-cased text; ASCII other than letters counts as a space."""
    counts = np.zeros(DIMENSIONS, np.int64)
    shift = np.uint32(32 - (DIMENSIONS.bit_length() - 1))
    for at in range(0, len(text), SLICE):
        c = np.frombuffer((" " + text[at : at + SLICE].lower() + " ").encode("utf-32-le", "replace"), np.uint32)
        c = np.where((c < 97) | (c > 122) & (c < 128), np.uint32(32), c)
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        one = c * _ODD[0]
        two = (c[:-1] * _ODD[2]) ^ (c[1:] * _ODD[3])
        three = (two[:-1] * _ODD[1]) + c[2:] * _ODD[0] if len(c) > 2 else two[:0]
        for h in (one, two, three):
            counts += np.bincount((h * _ODD[0]) >> shift, minlength=DIMENSIONS)
    return counts


def grams_of(gram: str) -> int:
    """The dimension of one n-gram."""
    c = np.frombuffer(gram.encode("utf-32-le"), np.uint32)
    h = c * _ODD[0]
    if len(c) > 1:
        h = (c[:-1] * _ODD[2]) ^ (c[1:] * _ODD[3])
    if len(c) > 2:
        h = h[:-1] * _ODD[1] + c[2:] * _ODD[0]
    return int((h * _ODD[0])[0] >> np.uint32(32 - (DIMENSIONS.bit_length() - 1)))


def codewords(n: int) -> np.ndarray:
    """n codewords: all partitions for up to seven languages, else dense ones from a keyed digest, all distinct."""
    if not n:
        return np.zeros((0, 0), int)
    if n <= 7:
        bits = [[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for i in range(n)] for b in range((1 << max(n - 1, 0)) - 1)]
        return np.array(bits or [[1] * n]).T.reshape(n, -1)
    length = 10 * int(np.ceil(np.log2(n)))
    code = np.array([[1 if zlib.crc32(f"{i}:{b}".encode()) & 1 else -1 for b in range(length)] for i in range(n)])
    own_bits = (np.arange(n)[:, None] >> np.arange(int(np.ceil(np.log2(n))))) & 1
    code = np.hstack([code, 2 * own_bits - 1])
    return code[:, np.abs(code.sum(0)) < n]


class Model:
    """languages in order, their codewords, and a weight for each bit and n-gram."""

    def __init__(self, sums: dict[str, np.ndarray]) -> None:
        self.languages = sorted(sums)
        self.code = codewords(len(self.languages))
        share = np.array([(sums[x] + 0.5) / (sums[x].sum() + 0.5 * DIMENSIONS) for x in self.languages])
        weights, trust = [], []
        for bit in self.code.T:
            yes, no = share[bit > 0].mean(0), share[bit < 0].mean(0) if (bit < 0).any() else share.mean(0)
            w = np.log(yes) - np.log(no)
            margins = share @ w * bit
            weights.append(w)
            trust.append(max(float(margins.min()), 1e-3))
        self.weights = np.array(weights, np.float32).T
        self.trust = np.array(trust) / max(sum(trust), 1e-9)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, a score from 0 to 1, and whether another is nearly as near."""
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        counts = grams(text)
        # A margin is the sum of a text's log odds, tempered, as neighbouring n-grams aren't independent.
        margins = (counts.astype(np.float32) @ self.weights) / 3
        loss = (np.logaddexp(0, -np.clip(margins * self.code, -50, 50)) * self.trust).sum(1)
        order = np.argsort(loss, kind="stable")
        p = np.exp(-(loss - loss[order[0]]))
        gap = float(loss[order[1]] - loss[order[0]]) if len(order) > 1 else 1.0
        return self.languages[order[0]], float(p[order[0]] / p.sum()), gap < GAP


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = FIT_DOCS) -> Model:
    """A model from the rows given, of which about per_language a language, chosen by a digest of doc_id, are read.

    Rows without text or language are left out; without any the model knows no language and answers `und`.
    """
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(1_000_000 * min(1.0, per_language / n)))) for k, n in sizes.items()]) if sizes else F.lit(0)
    rows = rows.filter(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(1_000_000)) < rate)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for x, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                # Long texts weigh as 2000 n-grams, so that none of them is a language by itself.
                c = grams(t)
                sums[x] = sums.get(x, 0) + c * min(1.0, 2000 / max(1, c.sum()))
        for x, c in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [x], "counts": [c.tolist()]}, schema=pa.schema([("lang", pa.string()), ("counts", pa.list_(pa.float64()))]))

    parts = rows.mapInArrow(count, "lang string, counts array<double>").select("lang", F.posexplode("counts").alias("i", "n")).filter("n > 0")
    sums: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "i").agg(F.sum("n").alias("n")).collect():  # languages times DIMENSIONS rows at most
        sums.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["i"]] = round(r["n"], 6)
    return Model(sums)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous, from whole texts; `und` with score 0 for a text that is null or has no
    letter. Columns of these names are replaced, repeated rows stay."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    held = prepare(docs.sparkSession).sparkContext.broadcast(model)
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for whole in batches:
            for b in pieces(whole, text):
                found = [model.predict(t) for t in b.column(text).to_pylist()]
                more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], schema.names)

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous; learned from rows whose crc32(doc_id as text) mod 3 is not 1.

    A text that is null or has no letter, and every text where no language was learned, is `und` with score 0; of languages
    that are equally near the first by code point is named; a null doc_id's digest is that of the empty text; repeated rows
    stay, an empty table gives an empty one, other columns are ignored.
    """
    out_of_fit = crc32_mod("doc_id", 3) == 1
    model = fit(docs.filter(~out_of_fit))
    rows = predict(docs.select("doc_id", out_of_fit.alias(own("held_out")), "text"), model)
    return rows.select("doc_id", F.col(own("held_out")).alias("held_out"), "lang_pred", "score", "ambiguous")
