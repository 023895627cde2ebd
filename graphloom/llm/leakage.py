"""Evaluation texts leaking into training text (problem 6).

Spaced-seed hashing: a mask is laid on every run of words and the words at its open positions are
hashed, so that a word may differ where the mask ignores it. The seeds of test passages and of
documents are joined; pairs whose hits cover enough of a passage are verified word by word.
Test material of a bounded size is broadcast, and a document meets it where it is read, so that
neither seeds nor texts are shuffled; beyond that size both sides are shuffled by seed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import joins, words
from graphloom.plans.runtime import cut, parallelism, spread

#: Masks over words: 1 counts, 0 is ignored. Every stretch that is a case has six words in a row
#: intact, so each mask of span six or less is hit in it.
MASKS = ("111011", "110111")
#: Words of a passage in a row that make a case; words of a stretch with at most one edit in EDIT_RATE.
EXACT_WORDS, STRETCH_WORDS, EDIT_RATE = 16, 30, 8
#: Words of a passage that the hits of a pair in one band of diagonals cover at least, before it is
#: verified. A stretch with n edits that has runs of five words, which no seed may hit, has a run
#: of eight at least; it shifts by less than BAND words.
COVERED_WORDS, BAND = 8, 8
#: Test passages are broadcast while they have at most so many characters in all.
TEST_CHARS = 4 << 20
#: Words of texts whose seeds are looked up together.
PART_WORDS = 20_000
#: Passages are broadcast to the verification while they have at most so many.
BROADCAST_CHARS = 64 << 20
#: Words broken by line breaks are joined with the help of the test words. Up to so many different
#: ones are broadcast; beyond, each document gets those it may look up by a join.
VOCABULARY_WORDS = 500_000


#: Odd multipliers of the hash of a run, and of its mask.
_STEP, _MASK_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def seed_arrays(tokens: list[str], masks: tuple[str, ...] = MASKS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes as signed 64-bit values, positions) of every mask at every position.

    Each word is hashed once; the hashes at the open positions of a mask are mixed in order."""
    return _laid(np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens)), masks)


def _laid(hashed: np.ndarray, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The masks laid on hashed words. The places of a mask's hits are those of its first word."""
    values, places = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int32)]
    for number, mask in enumerate(masks, 1):
        n = len(hashed) - len(mask) + 1
        if n <= 0:
            continue
        mixed = np.full(n, number, dtype=np.uint64) * _MASK_STEP
        for i, open_ in enumerate(mask):
            if open_ == "1":
                mixed = (mixed ^ hashed[i : i + n]) * _STEP
                mixed ^= mixed >> np.uint64(29)
        values.append(mixed.view(np.int64))
        places.append(np.arange(n, dtype=np.int32))
    return np.concatenate(values), np.concatenate(places)


def repaired(tokens: list[str], vocabulary: frozenset[str] | set[str]) -> list[str]:
    """tokens with the parts of a vocabulary word joined, and two run together set apart."""
    out: list[str] = []
    for token in tokens:
        if out and token not in vocabulary and joins(out[-1], token, vocabulary) or out and out[-1] not in vocabulary and out[-1] + token in vocabulary:
            out[-1] += token
        elif token not in vocabulary and (cut := next((i for i in range(1, len(token)) if token[:i] in vocabulary and token[i:] in vocabulary), 0)):
            out += [token[:cut], token[cut:]]
        else:
            out.append(token)
    return out


def lookups(text: str | None, longest: int) -> set[str]:
    """All strings of up to `longest` characters that words() and repaired() may look up in a
    vocabulary for a text: what starts anywhere in a word, or as a part of it, and ends with that
    word or one of those after it, and the beginnings of words."""
    tokens, out = words(text), set()
    for at, token in enumerate(tokens):
        out.update(token[:i] for i in range(1, min(len(token), longest) + 1))
        after, length = [], 0  # the words after it, as far as one more character leaves room
        for following in tokens[at + 1 :]:
            length += len(following)
            if length >= longest:
                break
            after.append(following)
        for i in range(max(0, len(token) - longest), len(token)):
            joined = token[i:]
            out.add(joined)
            for following in after:
                joined += following
                if len(joined) > longest:
                    break
                out.add(joined)
    return out


def places_of(passage: list[str]) -> dict[str, list[int]]:
    places: dict[str, list[int]] = {}
    for i, word in enumerate(passage):
        places.setdefault(word, []).append(i)
    return places


def may_hold(there: set[str], passage: list[str]) -> bool:
    """Whether the words of a document could hold a case, whatever their order: EXACT_WORDS in a
    row of the passage that it has, or a stretch of STRETCH_WORDS or more, of any length, of which
    at most one in EDIT_RATE is missing. A missing word is an edit, so no case is refused."""
    bits = bytes(map(there.__contains__, passage))
    if b"\1" * EXACT_WORDS in bits:
        return True
    if bits.count(1) * EDIT_RATE < (EDIT_RATE - 1) * STRETCH_WORDS:
        return False
    # EDIT_RATE times the missing words up to each place, less all words up to it.
    score = np.concatenate(([0], np.cumsum(EDIT_RATE - 1 - EDIT_RATE * np.frombuffer(bits, dtype=np.int8).astype(np.int64))))
    return bool((score[STRETCH_WORDS:] <= np.maximum.accumulate(score)[:-STRETCH_WORDS]).any())


def matching_runs(document: list[str], passage: list[str], places: dict[str, list[int]] | None = None) -> list[tuple[int, int, int]]:
    """Maximal runs of words in both: (start in passage, start in document, length)."""
    places = places_of(passage) if places is None else places
    runs: list[tuple[int, int, int]] = []
    open_runs: dict[int, int] = {}
    for j, word in enumerate([*document, None]):
        now = {i: open_runs.get(i - 1, 0) + 1 for i in places.get(word, ())}
        runs += [(i - n + 1, j - n, n) for i, n in open_runs.items() if i + 1 not in now]
        open_runs = now
    return runs


def holds(document: list[str], passage: list[str], places: dict[str, list[int]] | None = None) -> bool:
    """Whether a document holds EXACT_WORDS words in a row of the passage, or a stretch of it of
    STRETCH_WORDS or more in which at most one in EDIT_RATE is replaced, added or dropped. The
    first and last words of a stretch may be edits too: a shorter chain of runs is filled up to
    STRETCH_WORDS with words of the passage beside it, each an edit."""
    runs = matching_runs(document, passage, places)
    if any(n >= EXACT_WORDS for _, _, n in runs):
        return True
    for core in (r for r in runs if r[2] >= 5):
        reach = len(passage) // EDIT_RATE + 1
        band = sorted(r for r in runs if abs((r[1] - r[0]) - (core[1] - core[0])) <= reach)
        for first in range(len(band)):
            edits = {first: 0}
            for b in range(first, len(band)):
                start_p, start_d, n = band[b]
                for a in range(first, b):
                    if a not in edits:
                        continue
                    gap_p, gap_d = start_p - band[a][0] - band[a][2], start_d - band[a][1] - band[a][2]
                    overlap = max(0, -min(gap_p, gap_d))
                    if overlap >= n:
                        continue
                    cost = edits[a] + max(gap_p, gap_d) + overlap
                    if cost <= reach and cost < edits.get(b, reach + 1):
                        edits[b] = cost
                if b in edits:
                    span = start_p + n - band[first][0]
                    length = max(span, STRETCH_WORDS)
                    if length <= len(passage) and (edits[b] + length - span) * EDIT_RATE <= length:
                        return True
    return False


def _line(tokens: list[str]) -> str:
    """Words as one text in which a run of words is found as text."""
    return "\0" + "\0".join(tokens) + "\0"


class TestIndex:
    """Test passages with their seeds in order, so that a document's seeds are looked up at once."""

    __test__ = False  # no test case

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...]):
        self.masks, self.span = masks, min(map(len, masks))
        self.items = [(key, found, places_of(found)) for key, passage in items if len(found := words(passage)) >= EXACT_WORDS]
        whole = lambda found: [_line(found[i : i + EXACT_WORDS]) for i in range(len(found) - EXACT_WORDS + 1)]
        self.exact = [whole(found) for _, found, _ in self.items]
        self.vocabulary = frozenset(w for _, found, _ in self.items for w in found)
        self.numbers = {w: i for i, w in enumerate(sorted(self.vocabulary))}
        longest = max((len(found) for _, found, _ in self.items), default=0)
        self.words = np.full((len(self.items), longest), len(self.numbers), dtype=np.int32)
        for row, (_, found, _) in zip(self.words, self.items):
            row[: len(found)] = [self.numbers[w] for w in found]
        self.reach = longest + self.span
        arrays = [seed_arrays(found, masks) for _, found, _ in self.items]
        seeds = np.concatenate([np.empty(0, dtype=np.int64), *(s for s, _ in arrays)])
        order = np.argsort(seeds, kind="stable")
        self.seeds = seeds[order]
        self.item = np.repeat(np.arange(len(arrays)), [len(s) for s, _ in arrays])[order]
        self.at = np.concatenate([np.empty(0, dtype=np.int64), *(p for _, p in arrays)])[order].astype(np.int64)

    def candidates(self, texts: list[list[str]]) -> list[list[int]]:
        """For each text the items of which hits in one band of diagonals cover COVERED_WORDS words.
        Each hit enters two half-shifted bands, so that diagonals less than BAND apart share one."""
        near: list[list[int]] = [[] for _ in texts]
        sizes = np.array([len(t) for t in texts])
        hashed = np.fromiter((xxhash.xxh64_intdigest(w) for t in texts for w in t), dtype=np.uint64, count=int(sizes.sum()))
        of_text = np.repeat(np.arange(len(texts)), sizes)
        seeds, place = _laid(hashed, self.masks)
        low = np.searchsorted(self.seeds, seeds, "left")
        met = np.flatnonzero(self.seeds[np.minimum(low, len(self.seeds) - 1)] == seeds) if len(self.seeds) else np.empty(0, dtype=np.int64)
        met = met[of_text[place[met]] == of_text[np.minimum(place[met] + self.span - 1, len(of_text) - 1)]]  # within one text
        if not len(met):
            return near
        low, high = low[met], np.searchsorted(self.seeds, seeds[met], "right")
        times = high - low
        hit = np.repeat(low - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
        item, at, place = self.item[hit], self.at[hit], np.repeat(place[met], times).astype(np.int64)
        pair = of_text[place] * len(self.items) + item
        band = (place - at) // BAND
        band -= band.min()
        bands = int(band.max()) + 2
        group, at = np.concatenate([pair * bands + band, pair * bands + band + 1]), np.concatenate([at, at])
        _, inverse, counts = np.unique(group, return_inverse=True, return_counts=True)
        often = counts[inverse] * self.span >= COVERED_WORDS
        covered = np.unique((group[often][:, None] * self.reach + at[often][:, None] + np.arange(self.span)).ravel())
        groups, counts = np.unique(covered // self.reach, return_counts=True)
        for p in np.unique(groups[counts >= COVERED_WORDS] // bands).tolist():
            near[p // len(self.items)].append(p % len(self.items))
        return near

    def plausible(self, there: set[str], near: list[int]) -> list[int]:
        """Those of the items `near` that may_hold() lets through, all at once."""
        known = np.zeros(len(self.numbers) + 1, dtype=bool)
        known[[self.numbers[w] for w in there if w in self.numbers]] = True
        bits = known[self.words[near]]  # beyond a passage's end nothing is known
        counts = np.concatenate([np.zeros((len(near), 1), dtype=np.int32), np.cumsum(bits, axis=1, dtype=np.int32)], axis=1)
        found = (counts[:, EXACT_WORDS:] - counts[:, :-EXACT_WORDS] == EXACT_WORDS).any(axis=1)
        if counts.shape[1] > STRETCH_WORDS:
            score = (EDIT_RATE - 1) * np.arange(counts.shape[1], dtype=np.int32) - EDIT_RATE * counts
            found |= (score[:, STRETCH_WORDS:] <= np.maximum.accumulate(score, axis=1)[:, :-STRETCH_WORDS]).any(axis=1)
        return [i for i, f in zip(near, found.tolist()) if f]

    def leaks(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """For each text the ids of the items of which it holds a part."""
        for part in self._parts(texts):
            for tokens, near in zip(part, self.candidates(part)):
                if near:
                    tokens = repaired(tokens, self.vocabulary)
                    near = self.plausible(set(tokens), near)
                    line = _line(tokens)
                # A run of EXACT_WORDS is seen at once; the rest is aligned.
                yield [self.items[i][0] for i in near if any(run in line for run in self.exact[i]) or holds(tokens, *self.items[i][1:])]

    def _parts(self, texts: Iterable[str]) -> Iterator[list[list[str]]]:
        """The words of some texts at a time, so that their seeds are looked up together."""
        part, size = [], 0
        for text in texts:
            part.append(words(text, self.vocabulary))
            size += len(part[-1])
            if size >= PART_WORDS or len(part) >= PART_WORDS:
                yield part
                part, size = [], 0
        if part:
            yield part


def leaked_items(documents: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(doc_id, eval_id) of every document that holds a part of an item, without repeated rows.

    `documents` has doc_id and text, `items` eval_id and passage; other columns are ignored. NULL
    and blank texts and passages of under EXACT_WORDS words match nothing. Whole texts are read;
    repeated documents are each reported. Up to TEST_CHARS characters of passages the documents
    meet the broadcast test material; beyond, both sides are shuffled, with the same result.
    """
    items = items.select("eval_id", "passage").where("passage is not null and eval_id is not null").distinct()
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("passage"))).first()[0] or 0
    if chars > TEST_CHARS:
        return _shuffled(texts, items, masks, chars)
    context = documents.sparkSession.sparkContext
    known = context.broadcast(([tuple(r) for r in items.collect()], masks))  # bounded by TEST_CHARS

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = TestIndex(*known.value)
        for batch in batches:
            found = [(doc, key) for doc, keys in zip(batch["doc_id"], index.leaks(batch["text"])) for key in keys]
            yield pd.DataFrame(found, columns=["doc_id", "eval_id"], dtype="int64")

    return spread(texts).mapInPandas(search, "doc_id bigint, eval_id bigint").distinct()


def _shuffled(texts: DataFrame, items: DataFrame, masks: tuple[str, ...], chars: int) -> DataFrame:
    """leaked_items for test material of any size.

    Seeds of both sides are shuffled, and adaptive execution splits hot ones. Test words are
    broadcast while few; beyond, what a document may look up is joined to them."""
    spark, span = texts.sparkSession, min(map(len, masks))

    def passage_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, passage in zip(batch["eval_id"], batch["passage"]):
                found, at = seed_arrays(words(passage), masks)
                yield pd.DataFrame({"eval_id": key, "seed": found, "at": at}).astype({"eval_id": "int64"})

    tests = items.mapInPandas(passage_seeds, "eval_id bigint, seed bigint, at int")

    def passage_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"word": sorted({w for p in batch["passage"] for w in words(p)})}, dtype=object)

    distinct = items.mapInPandas(passage_words, "word string").distinct()
    listed = distinct.limit(VOCABULARY_WORDS + 1).collect()
    few = len(listed) <= VOCABULARY_WORDS
    known = spark.sparkContext.broadcast(frozenset(r["word"] for r in listed) if few else frozenset())
    if few:
        texts = texts.withColumn("words", F.lit(None).cast("array<string>"))
    else:
        longest = distinct.agg(F.max(F.length("word"))).first()[0]

        def document_lookups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key, text in zip(batch["doc_id"], batch["text"]):
                    yield pd.DataFrame({"doc_id": key, "word": sorted(lookups(text, longest))}).astype({"doc_id": "int64", "word": object})

        asked = spread(texts).mapInPandas(document_lookups, "doc_id bigint, word string")
        own = asked.join(distinct, "word", "left_semi").groupBy("doc_id").agg(F.collect_set("word").alias("words"))
        texts = texts.join(cut(own), "doc_id", "left")

    def vocabulary(own: list[str] | None) -> frozenset[str]:
        return known.value if own is None else frozenset(own)

    def document_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, found, places = [], [], []
            for key, text, own in zip(batch["doc_id"], batch["text"], batch["words"]):
                tokens = words(text, vocabulary(own))
                if len(tokens) >= EXACT_WORDS:
                    hashed, at = seed_arrays(tokens, masks)
                    keys.append(key)
                    found.append(hashed)
                    places.append(at)
            yield pd.DataFrame({"doc_id": pd.Series(keys, dtype="int64"), "seed": pd.Series(found, dtype=object), "place": pd.Series(places, dtype=object)})

    trained = spread(texts).mapInPandas(document_seeds, "doc_id bigint, seed array<bigint>, place array<int>")
    trained = trained.select("doc_id", F.explode(F.arrays_zip("seed", "place")).alias("s")).select("doc_id", "s.seed", "s.place")
    # Each hit enters two half-shifted bands, so that diagonals less than BAND apart share one.
    band = F.floor((F.col("place") - F.col("at")) / BAND)
    met = trained.join(tests, "seed").select("doc_id", "eval_id", "at", F.explode(F.array(band, band + 1)).alias("band"))
    hits = met.groupBy("doc_id", "eval_id", "band").agg(F.collect_set("at").alias("at"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (span - 1))))))
    pairs = hits.where(covered >= COVERED_WORDS).select("doc_id", "eval_id").distinct()
    # One row per document meets its text, so that a text is moved and read once for all its items;
    # the partitioning by number keeps all cores busy.
    wanted = pairs.repartition(parallelism(spark), "doc_id").groupBy("doc_id").agg(F.collect_list("eval_id").alias("ids"))
    with_text = wanted.join(texts, "doc_id").select("doc_id", "text", "words", F.explode("ids").alias("eval_id"))
    candidates = with_text.join(F.broadcast(items) if chars <= BROADCAST_CHARS else items, "eval_id").select("doc_id", "eval_id", "text", "words", "passage")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, None, None)
        tested: dict[int, tuple[str, list[str], dict[str, list[int]]]] = {}
        for batch in batches:
            kept = []
            for doc, key, text, own, passage in batch[["doc_id", "eval_id", "text", "words", "passage"]].itertuples(index=False, name=None):
                if key not in tested or tested[key][0] != passage:
                    whole = words(passage)
                    tested[key] = (passage, whole, places_of(whole))
                _, whole, places = tested[key]
                if last[0] != text:
                    tokens = repaired(words(text, vocabulary(own)), vocabulary(own))
                    last = (text, tokens, set(tokens))
                if may_hold(last[2], whole) and holds(last[1], whole, places):
                    kept.append((doc, key))
            yield pd.DataFrame(kept, columns=["doc_id", "eval_id"], dtype="int64")

    return candidates.mapInPandas(verify, "doc_id bigint, eval_id bigint").distinct()


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """(eval_id, suite, lang, documents): every item with the number of documents that hold it."""
    counts = leaks.groupBy("eval_id").agg(F.countDistinct("doc_id").alias("documents"))
    return items.select("eval_id", "suite", "lang").distinct().join(counts, "eval_id", "left").fillna(0, ["documents"])
