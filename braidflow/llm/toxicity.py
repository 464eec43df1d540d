"""Toxicity from a learned lexicon that also catches misspellings.

The lexicon holds whole words and word beginnings (stems with varying endings) that mark the fitting texts labelled toxic.
A word is looked up by running its Levenshtein automaton along the lexicon's trie: branches on which the automaton has no
state left are cut, and at a stem's end any ending is accepted. Every hit weighs what it was worth in the fitting texts, exact and misspelled ones apart, and its window of
neighbouring words changes that: quotation marks and words of reporting lower it, a direct address raises it. The hits
of a text are joined as independent pieces of evidence.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import crc32_mod, own, pieces, prepare, take_memory, tidied

#: Labelled texts of each class to fit on at most, the log-likelihood ratio and the share of toxic texts that an entry needs,
#: lengths of stems, and the score from which a text is taken as toxic.
FIT_ROWS, LEAST_RATIO, LEAST_SHARE, STEMS, THRESHOLD = 4000, 12.0, 0.985, (4, 5, 6, 7), 0.3
#: What a misspelled hit is worth, as a share of an exact one, until the fitting texts tell: of longer entries and of others.
GUESS, SHORT_GUESS = 0.5, 0.25
#: Different words before an entry in the toxic fitting texts, at least.
LEAST_CONTEXTS = 5
#: In few texts: an entry that stood after so many different words, and so many times its texts, and in no other text, needs
#: only this share.
MANY_CONTEXTS, CONTEXTS_A_TEXT, RARE_SHARE = 8, 2.5, 0.95
#: Words on either side of a hit that make its context, and the characters among which they are looked for.
WINDOW, REACH = 4, 1024
#: Distinct words that a worker remembers, features that one counts before it hands them on, and characters scored at once.
MEMO, COUNTED, SLICE = 250_000, 500_000, 1 << 20
_WORD, _BREAK = re.compile(r"[^\W_]+"), re.compile(r"[\W_]")
# Words of reporting and of direct address in the four languages, and quotation marks.
REPORTING = frozenset("said says called calls wrote quoted quote sagte nannte schrieb dijo llamó escribió dit appelé écrit".split())
ADDRESS = frozenset("you your yourself du dich dein ihr tu te vous toi votre usted tú".split())
QUOTES = frozenset("\"“”„«»‹›")


class Automaton:
    """Levenshtein automaton of a word: its states are sets of (characters read, errors)."""

    def __init__(self, word: str, errors: int) -> None:
        self.word, self.errors = word, errors

    def start(self) -> frozenset[tuple[int, int]]:
        return self._closed({(0, 0)})

    def _closed(self, state: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        todo = list(state)
        while todo:
            i, e = todo.pop()
            if i < len(self.word) and e < self.errors and (i + 1, e + 1) not in state:
                state.add((i + 1, e + 1))
                todo.append((i + 1, e + 1))
        return frozenset(state)

    def step(self, state: frozenset[tuple[int, int]], c: str) -> frozenset[tuple[int, int]]:
        after = set()
        for i, e in state:
            if i < len(self.word) and self.word[i] == c:
                after.add((i + 1, e))
            if e < self.errors:
                after.add((i, e + 1))
                if i < len(self.word):
                    after.add((i + 1, e + 1))
        return self._closed(after)

    def accepted(self, state: frozenset[tuple[int, int]]) -> int | None:
        return min((e for i, e in state if i == len(self.word)), default=None)


def _lacking(words: list[str]) -> set[str]:
    """The words, and what is left of each without one of its characters."""
    return {x for w in words for x in (w, *(w[:i] + w[i + 1 :] for i in range(len(w))))}


class Lexicon:
    """Whole words and stems with their weights, exact and misspelled."""

    def __init__(self, words: dict[str, tuple[float, float]], stems: dict[str, tuple[float, float]], base: float = 0.0) -> None:
        self.words, self.stems, self.base = words, stems, base
        self.lengths = sorted({len(s) for s in stems})
        self.trie: dict = {}
        for end, entries in (("", words), ("*", stems)):
            for w in entries:
                if self.errors(w):
                    node = self.trie
                    for c in w:
                        node = node.setdefault(c, {})
                    node[end * 2] = w  # longer than a character, or empty
        # A word at distance 1 keeps the first or the last half of the entry whole: only then is the automaton run.
        fuzzy, stems_ = [w for w in words if self.errors(w)], [w for w in stems if self.errors(w)]
        self.heads = {w[: len(w) // 2] for w in (*fuzzy, *stems_)}
        self.tails = {w[len(w) // 2 :] for w in fuzzy}
        self.inner = {(len(w) // 2, w[len(w) // 2 :]) for w in stems_}
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})
        self.places = sorted({(at + d, at, len(t)) for at, t in self.inner for d in (-1, 0, 1)})
        self.sizes = {len(w) + d for w in fuzzy for d in (-1, 0, 1)}
        # At distance 1 the two are equal once each has lost a character or none.
        self.lacking, self.lacking_stems = _lacking(fuzzy), _lacking(stems_)
        self.prefixes = sorted({len(w) + d for w in stems_ for d in (-1, 0, 1)})
        self.least = min((len(w) - 1 for w in stems_), default=1 << 30)

    @staticmethod
    def errors(entry: str) -> int:
        """Misspellings are looked for at one edit, in entries of which that leaves three characters."""
        return int(len(entry) >= 4)

    def misspelled(self, word: str) -> tuple[str, int] | None:
        """The entry at distance 1, words before stems, ties by code point; an exact one is found otherwise."""
        machine = Automaton(word, 1)
        best, todo = None, [(self.trie, machine.start())]
        while todo:
            node, state = todo.pop()
            for c, below in node.items():
                if c == "":
                    if machine.accepted(state) is not None and (best is None or (0, below) < best):
                        best = (0, below)
                elif c == "**":
                    if best is None or (1, below) < best:
                        best = (1, below)
                elif after := machine.step(state, c):
                    todo.append((below, after))
        return (best[1], 1 + 2 * best[0]) if best else None

    def look_up(self, word: str) -> tuple[str, int]:
        """The entry that a lower-cased word hits, or "", and its kind: 0 exact, 1 misspelled, 2 stem, 3 misspelled stem."""
        if word in self.words:
            return word, 0
        n = len(word)
        for k in self.lengths:
            if n >= k and word[:k] in self.stems:
                return word[:k], 2
        if self._halves(word, n) and self.plausible(word) and (found := self.misspelled(word)):
            return found
        return "", 0

    def _halves(self, word: str, n: int) -> bool:
        """Whether the word keeps a half of an entry where one edit can leave it."""
        whole, stem = n in self.sizes, n >= self.least
        if whole or stem:
            for k in self.head_sizes:
                if word[:k] in self.heads:
                    return True
        if whole:
            for k in self.tail_sizes:
                if word[-k:] in self.tails:
                    return True
        if stem:
            for at, half, k in self.places:
                if at >= 0 and (half, word[at : at + k]) in self.inner:
                    return True
        return False

    def plausible(self, word: str) -> bool:
        if len(word) in self.sizes and not _lacking([word]).isdisjoint(self.lacking):
            return True
        return any(not _lacking([word[:k]]).isdisjoint(self.lacking_stems) for k in self.prefixes if k <= len(word))

    def weight(self, word: str) -> float:
        entry, kind = self.look_up(word)
        if not entry:
            return 0.0
        return (self.stems if kind >= 2 else self.words)[entry][kind % 2]


class Scorer:
    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.memo = lexicon, {}

    def hits(self, text: str) -> Iterator[float]:
        """What each hit is worth in its context."""
        memo, weight = self.memo, self.lexicon.weight
        text = text.replace("İ", "I")  # whose lower case alone is longer
        start = 0
        while start < len(text):
            m = _BREAK.search(text, start + SLICE) if start + SLICE < len(text) else None
            end = m.start() if m else len(text)
            low = text[start:end].lower()
            words = _WORD.findall(low)
            if len(memo) > MEMO:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = weight(w)
            if any(map(memo.__getitem__, words)):
                for m in _WORD.finditer(low):
                    if v := memo[m[0]]:
                        yield v * self.context(text, start + m.start(), start + m.end())
            start = end

    @staticmethod
    def context(text: str, start: int, end: int) -> float:
        """Below 1 for quotation: marks around the hit within the window, or a word of reporting before it."""
        for reach in (REACH // 8, REACH):
            before, after = text[max(0, start - reach) : start], text[end : end + reach]
            left, right = [*_WORD.finditer(before)], [*_WORD.finditer(after)]
            if (len(left) > WINDOW or len(before) < reach) and (len(right) > WINDOW or len(after) < reach):
                break
        left, right = left[-WINDOW:], right[:WINDOW]
        words = [m[0].lower() for m in left]
        factor = 1.0
        marks_before = before[left[0].start() if len(left) == WINDOW else 0 :]
        marks_after = after[: right[-1].end() if len(right) == WINDOW else len(after)]
        if any(c in QUOTES for c in marks_before) and any(c in QUOTES for c in marks_after):
            factor *= 0.4
        if any(w in REPORTING for w in words):
            factor *= 0.6
        if any(w in ADDRESS for w in (*words, *(m[0].lower() for m in right))):
            factor = min(1.0, factor * 1.5)
        return factor

    def score(self, text: str | None) -> float:
        left = 1.0 - self.lexicon.base
        for p in self.hits(text or ""):
            left *= 1.0 - p
        return 1.0 - left


def features(text: str) -> dict[str, int]:
    """Distinct words of a text, marked by a final space, and beginnings of its longer words; for each a 64-bit map of the
    words that go before it, by their digest."""
    out: dict[str, int] = {}
    before = 0
    for w in _WORD.findall(text.lower()):
        bit = 1 << before
        key = w + " "
        out[key] = out.get(key, 0) | bit
        for k in STEMS:
            if len(w) > k:
                out[w[:k]] = out.get(w[:k], 0) | bit
        before = zlib.crc32(w.encode()) & 63
    return out


def ratio(a: int, b: int, n: int, m: int) -> float:
    """Log-likelihood ratio of a of n toxic and b of m other texts having a feature."""

    def part(k: float, of: float, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((of - k) * math.log(1 - p) if of > k else 0.0)

    p = (a + b) / (n + m)
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, p) - part(b, m, p)) if 0 < a + b < n + m else 0.0


def choose(found: dict[str, tuple[int, int, int]], n: int, m: int) -> Lexicon:
    """Entries by ratio: a whole word rather than a stem that it makes up, one stem of those that extend each other."""

    def share(a: int, b: int) -> float:
        return (a / n) / ((a / n) + (b + 0.5) / max(m, 1))

    good = []
    for k, (a, b, contexts) in found.items():
        often = not b and contexts >= max(MANY_CONTEXTS, CONTEXTS_A_TEXT * a)
        if share(a, b) >= (RARE_SHARE if often else LEAST_SHARE) and (r := ratio(a, b, n, m)) >= LEAST_RATIO:
            good.append((r, k, a, b))
    whole = {k[:-1]: (a, b) for _, k, a, b in good if k.endswith(" ")}
    words: dict[str, tuple[float, float]] = {}
    stems: dict[str, tuple[float, float]] = {}
    good.sort(key=lambda x: (-x[0], -len(x[1]), x[1]))
    for _, k, a, b in good:
        name = k.rstrip(" ")
        if any(name[:i] in stems or name[:i] in words for i in range(4, len(name) + 1)) or any(s.startswith(name) for s in (*stems, *words)):
            continue
        if not k.endswith(" "):
            top = max(((x[0], w) for w, x in whole.items() if w.startswith(name)), default=(0, ""))
            if top[0] >= 0.8 * a:  # one word makes the stem
                k, name, (a, b) = top[1] + " ", top[1], whole[top[1]]
        guess = (GUESS if len(name) >= (5 if k.endswith(" ") else 6) else SHORT_GUESS) * share(a, b)
        (words if k.endswith(" ") else stems)[name] = (share(a, b), guess)
    return Lexicon(words, stems)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from at most `rows` labelled texts of each class, chosen by a digest of doc_id.

    A doc_id with both labels counts as toxic. Without texts of both classes the lexicon is empty and scores are 0.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias(own("id"))).agg((F.max(label) > 0).alias(own("toxic")))
    digest = F.xxhash64(own("id"))
    chosen = known.filter(own("toxic")).orderBy(digest, own("id")).limit(rows).unionByName(known.filter(~F.col(own("toxic"))).orderBy(digest, own("id")).limit(rows))
    read = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # At most twice `rows` pairs of an id and a flag.
    read = read.join(F.broadcast(chosen), F.col("id") == F.col(own("id"))).select("text", F.col(own("toxic")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in read.groupBy("toxic").count().collect()}
    n, m = sizes.get(True, 0), sizes.get(False, 0)
    if not n or not m:
        return Lexicon({}, {})

    def count(toxic: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[str, list[int]] = {}

            def part() -> pa.RecordBatch:
                out = pa.RecordBatch.from_pydict({"feature": [*seen], "n": [v[0] for v in seen.values()], "bits": [v[1] - (v[1] >> 63 << 64) for v in seen.values()]}, schema=pa.schema([("feature", pa.string()), ("n", pa.int64()), ("bits", pa.int64())]))
                seen.clear()
                return out

            for b in batches:
                for t in b.column("text").to_pylist():
                    for k, bits in features(t).items():
                        if k in seen:
                            seen[k][0] += 1
                            seen[k][1] |= bits
                        else:
                            seen[k] = [1, bits]
                    if len(seen) > COUNTED:
                        yield part()
            yield part()

        return read.filter("toxic" if toxic else "NOT toxic").mapInArrow(tidied(run), "feature string, n long, bits long").groupBy("feature").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("bits")).alias("contexts"))

    # Copies of one text all have the same words: an entry must have stood after different words.
    toxic = count(True).filter((F.col("n") >= max(3, int(0.002 * n))) & (F.col("contexts") >= LEAST_CONTEXTS) & (F.col("contexts") >= 0.4 * F.least("n", F.lit(50))))
    others = count(False).select(F.col("feature").alias("f"), F.col("n").alias("b"))
    both = toxic.join(others, F.col("feature") == F.col("f"), "left").select("feature", F.col("n").alias("a"), F.coalesce("b", F.lit(0)).alias("b"), "contexts")
    # What alone can be chosen comes to the driver: features that mark toxic texts.
    marks = both.filter(F.col("a") / n >= RARE_SHARE / (1 - RARE_SHARE) * (F.col("b") + 0.5) / m).collect()
    return weigh_misspellings(choose({r["feature"]: (r["a"], r["b"], r["contexts"]) for r in marks}, n, m), read, n, m)


def weigh_misspellings(lexicon: Lexicon, read: DataFrame, n: int, m: int) -> Lexicon:
    """The lexicon with what misspelled hits are worth for each entry among the fitting texts; what was never seen keeps the
    guess."""
    held = read.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, seen = held.value, Counter()
        for b in batches:
            for t, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                found = {lexicon.look_up(w) for w in set(_WORD.findall(t.lower()))}
                seen.update((entry, kind, toxic) for entry, kind in found if kind % 2)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in seen], t) for i, t in enumerate((pa.string(), pa.int32(), pa.bool_()))] + [pa.array(list(seen.values()), pa.int64())], ["entry", "kind", "toxic", "n"])

    rows = read.mapInArrow(tidied(run), "entry string, kind int, toxic boolean, n long").groupBy("entry", "kind", "toxic").agg(F.sum("n").alias("n")).collect()  # entries at most
    seen = {(r["entry"], r["kind"], r["toxic"]): r["n"] for r in rows}
    for entries, kind in ((lexicon.words, 1), (lexicon.stems, 3)):
        for w, (exact, guess) in entries.items():
            a, b = seen.get((w, kind, True), 0), seen.get((w, kind, False), 0)
            if b:
                # Words that others use too are no misspellings of it, unless nearly all are in toxic texts.
                rate = (a / n) / (a / n + b / m)
                entries[w] = (exact, rate if rate >= RARE_SHARE else 0.0)
            elif a:
                entries[w] = (exact, (a * exact + 2 * guess) / (a + 2))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on), from whole texts; a null or empty text has the
    lexicon's base score. Columns of these names are replaced, repeated rows stay."""
    docs = docs.drop("score", "predicted")
    held = prepare(docs.sparkSession).sparkContext.broadcast(lexicon)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("toxicity", _SCORERS.clear)
        scorer = _scorer(held.value)
        for whole in batches:
            for b in pieces(whole, text):
                found = [scorer.score(t) for t in b.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())], schema.names)

    return docs.mapInArrow(tidied(run), schema)


_SCORERS: dict[tuple, Scorer] = {}


def _scorer(lexicon: Lexicon) -> Scorer:
    """This worker's scorer of the lexicon, with what it remembers."""
    key = (tuple(sorted(lexicon.words.items())), tuple(sorted(lexicon.stems.items())), lexicon.base)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(lexicon)
    return _SCORERS[key]


def learned(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """From labels of rows whose crc32(doc_id as text) mod 4 is not 2."""
    return fit(docs, labels.filter(crc32_mod("doc_id", 4) != 2))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A null or empty text has the lexicon's base score, 0; without labels of both classes all have; a null doc_id's digest is
    that of the empty text; repeated rows stay, an empty table gives an empty one, other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias(own("held_out")), "text")
    return score(rows, learned(docs, labels)).select("doc_id", F.col(own("held_out")).alias("held_out"), "score", "predicted")
