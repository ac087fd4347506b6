"""Phrase collocations: n-gram counts of each language as sorted streams of all orders, in prefix and in suffix order,
read in lockstep for left counts, right counts and the counts of extensions.

Counting goes level by level: phrases of n words are counted only where both phrases of n-1 words in them are
frequent, as no other can be. Which ones are frequent is told by a bitmap of hashes in the shared folder; it may say
yes too often (more rows to count then), never no, so counts stay exact. Texts are counted in chunks before anything
is shuffled, and the phrases themselves are the keys of Spark's aggregation.

The frequent phrases of all orders make one table. Sorted by words, each phrase follows its beginnings, so one pass
with a stack as high as the longest phrase reads the orders in lockstep: the stack has the counts of all beginnings,
and a phrase that leaves it has met all its extensions. Sorted by words from the last to the first the same pass has
the ends. Streams are cut at sampled keys, within a first word too; the beginnings of a cut's key are copied to the
part behind it, so that parts stand alone.

Cases: null text is empty; null language is `und`; punctuation, and words of one piece alone, make no phrase; equal
texts count each time; equal scores go by count, then by the phrase's bytes; an empty table gives no rows; very long
texts are counted whole; counts may go up to 10^16 (products are decimals of 38 digits); of the table only text and
lang are read, so other columns can't clash.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, byte_table, chunks, flat, mapped, mix, pair, put, shared_path, small_batches, spans, word_hashes, written

UNKNOWN_LANG = "und"
#: Bytes of text that are counted together, and phrases that a task hands over at once.
CHUNK_TEXT, HANDED_ROWS = 4 << 20, 20_000
#: Bits of the bitmap for each frequent phrase, and at most (64 MB). Beyond that it lets more phrases be counted.
BITS_EACH, MOST_BITS = 16, 1 << 29
#: Bits of a file of the bitmap.
SLICE_BITS = 1 << 20
#: Rows of a part of a stream at most (there are as many parts as shuffle partitions at least), and sampled keys for each part.
PART_ROWS, SAMPLED_EACH = 200_000, 40

#: Words `[^\x20\x09]+` of pieces between `[.,;:!?\x0A-\x0D]`.
_ENDS = byte_table([*b".,;:!?", *range(10, 14)], lower=False)
_WORD = ~(_ENDS | byte_table(b" \t", lower=False))


class Words:
    """The words of a chunk of texts: number of each word within the chunk, its language, whether the next word follows in its piece, and the distinct words."""

    def __init__(self, table: pa.Table) -> None:
        raw, offs = flat(table.column("text"))
        raw = LOWER[raw]
        starts, ends, first = spans(raw, offs, _WORD)
        langs = table.column("lang").combine_chunks().dictionary_encode()
        langs = langs.chunk(0) if isinstance(langs, pa.ChunkedArray) else langs
        self.langs = langs.dictionary
        self.lang = np.repeat(langs.indices.to_numpy(), np.diff(first))
        ended = np.searchsorted(np.flatnonzero(_ENDS[raw]), starts)
        self.follows = np.append(ended[1:] == ended[:-1], False) if len(starts) else np.zeros(0, bool)
        last = first[1:][np.diff(first) > 0] - 1
        self.follows[last] = False
        bounds = np.append(0, np.cumsum(ends - starts))
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(raw[_WORD[raw]])).dictionary_encode()
        self.words, self.word = words.dictionary, words.indices.to_numpy()

    def grams(self, longest: int, passes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For n = 1 to longest: n, language and words (a row each) of the distinct phrases, and how often each stands here. Phrases of n+1 words are those of which both ends pass."""
        ids, n_words = self.word + self.lang * np.int64(len(self.words)), max(len(self.words), 1)
        valid = np.ones(len(ids), bool)
        rows = np.zeros((0, 0), np.int64)
        for n in range(1, longest + 1):
            at = np.flatnonzero(valid)
            distinct, code, count = np.unique(ids[at], return_inverse=True, return_counts=True)
            where = np.zeros(len(distinct), np.int64)
            where[code] = at
            rows = self.word[where[:, None] + np.arange(n)]
            yield n, self.lang[where], rows, count
            if n == longest:
                return
            fine = np.zeros(len(ids), bool)
            fine[at] = passes(n, self.lang[where], rows)[code]
            # The numbers of the phrases here and one word on make the number of the longer phrase.
            number = np.zeros(len(ids), np.int64)
            number[at] = code
            valid = np.append(fine[:-1] & fine[1:] & self.follows[:-1], False) if len(fine) else fine
            ids = number * max(len(distinct), n_words) + np.append(number[1:], 0)

    def phrases(self, rows: np.ndarray) -> pa.Array:
        parts = [self.words.take(pa.array(rows[:, k])) for k in range(rows.shape[1])]
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if len(parts) > 1 else parts[0]


def _hashes(strings: pa.Array) -> np.ndarray:
    raw, offs = flat(strings)
    return word_hashes(raw, offs[:-1], offs[1:])


def _phrase_hash(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    return reduce(pair, words, mix(lang + np.uint64(len(words))))


@lru_cache(4)
def _bitmap(path: str, bits: int) -> np.ndarray:
    return np.concatenate([np.asarray(mapped(f"{path}/{k}", "u1")) for k in range(max(1, bits // SLICE_BITS))])


def _marked(frequent: DataFrame, n: int) -> tuple[str, int]:
    """Place and size of a bitmap of the hashes of frequent phrases (lang, phrase) of n words. Each file of it is made by one task from at most as many places as it has bits."""
    spark = frequent.sparkSession
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * frequent.count()).bit_length()))
    path, shift = shared_path(spark, f"frequent-{n}"), 64 - (bits.bit_length() - 1)
    each = min(SLICE_BITS, bits)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.split_pattern(batch.column("phrase"), " ").flatten()
            words = _hashes(words).reshape(-1, n)
            place = (_phrase_hash(_hashes(batch.column("lang")), list(words.T)) >> np.uint64(shift)).astype(np.int64)
            place = np.unique(place)
            yield pa.RecordBatch.from_arrays([pa.array(place // each), pa.array(place % each)], ["slice", "place"])

    def write(key: tuple, table: pa.Table) -> pa.Table:
        marks = np.zeros(each, bool)
        marks[table.column("place").drop_null().to_numpy()] = True
        put(f"{path}/{key[0].as_py()}", np.packbits(marks).tobytes())
        return pa.table({"slice": [key[0].as_py()]})

    # Each slice has a row of its own besides, so that slices without marks are written too.
    empty = spark.range(max(1, bits // SLICE_BITS)).select(F.col("id").alias("slice"), F.lit(None).cast("long").alias("place"))
    marks = frequent.select("lang", "phrase").mapInArrow(places, "slice long, place long").distinct().union(empty)

    marks.groupBy("slice").applyInArrow(write, "slice long").write.format("noop").mode("overwrite").save()
    return path, bits


def counts(docs: DataFrame, longest: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of up to `longest` words that stand `least` times or more in a language, and (lang, n): all its words. Both are written to the shared folder."""
    docs = docs.select("text", F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("lang"))
    small_batches(docs.sparkSession)
    levels, maps, totals = [], [], None
    for n in range(1, longest + 1):
        known = list(maps)

        def run(batches: Iterator[pa.RecordBatch], n: int = n, known: list = known) -> Iterator[pa.RecordBatch]:
            bitmaps = [(_bitmap(*at), 64 - (at[1].bit_length() - 1)) for at in known]
            for table in chunks(batches, CHUNK_TEXT, most=1 << 30):
                words = Words(table)
                own = _hashes(words.words) if bitmaps else None
                of_lang = _hashes(words.langs)

                def passes(k: int, lang: np.ndarray, rows: np.ndarray) -> np.ndarray:
                    bitmap, shift = bitmaps[k - 1]
                    place = _phrase_hash(of_lang[lang], [own[c] for c in rows.T]) >> np.uint64(shift)
                    return bitmap[place >> np.uint64(3)] >> (7 - (place & np.uint64(7)).astype(np.uint8)) & 1 > 0

                for k, lang, rows, count in words.grams(n, passes):
                    for at in range(0, len(rows) if k == n else 0, HANDED_ROWS):
                        part = slice(at, at + HANDED_ROWS)
                        yield pa.RecordBatch.from_arrays([words.langs.take(pa.array(lang[part])), words.phrases(rows[part]).cast(pa.string()), pa.array(count[part])], ["lang", "phrase", "f"])
                if n == 1 and len(words.lang):
                    size = np.bincount(words.lang, minlength=len(words.langs))
                    yield pa.RecordBatch.from_arrays([words.langs, pa.nulls(len(size), pa.string()), pa.array(size)], ["lang", "phrase", "f"])

        summed = docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        level = written(summed.filter(F.col("phrase").isNull() | (F.col("f") >= least)), f"phrases-{n}")
        if n == 1:
            totals = level.filter(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
            level = level.filter(F.col("phrase").isNotNull())
        levels.append(level)
        if n < longest:
            maps.append(_marked(level, n))
    return reduce(DataFrame.union, levels), totals


def _cuts(stream: DataFrame) -> list[list[str]]:
    """Keys that cut a stream into parts of about equal numbers of rows, from a sample of a few keys for each part."""
    rows = stream.count()
    parts = max(rows // PART_ROWS + 1, int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not rows:
        return []
    sample = sorted(r["key"] for r in stream.sample(min(1.0, SAMPLED_EACH * parts / rows), seed=7).select("key").collect())
    return [list(key) for key in sorted({tuple(sample[len(sample) * k // parts]) for k in range(1, parts)})] if sample else []


def lockstep(levels: DataFrame, from_end: bool) -> DataFrame:
    """(lang, phrase, a, beginnings, longer) of phrases of two words or more: the counts of its beginnings from one word on (with from_end: of its ends), and the most that one word more behind it (before it) has. A phrase may have several rows, one of which has its counts."""
    words = F.split("phrase", " ")
    stream = levels.select(F.concat(F.array("lang"), F.reverse(words) if from_end else words).alias("key"), "f")
    cuts = _cuts(stream)
    copies: dict[tuple, list[int]] = {}
    for k, cut in enumerate(cuts):
        for n in range(2, len(cut)):
            copies.setdefault(tuple(cut[:n]), []).append(k + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, own, at = [], [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                home = bisect_right(cuts, key)
                for p in [home, *(x for x in copies.get(tuple(key), ()) if x != home)]:
                    part.append(p)
                    own.append(p == home)
                    at.append(i)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column("key").take(at), batch.column("f").take(at), pa.array(own, pa.bool_())], ["part", "key", "f", "own"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # [key, count, most of an extension, own]
        out: list[tuple] = []
        part = None

        def leave(depth: int) -> None:
            while len(stack) > depth:
                key, f, longer, own = stack.pop()
                if len(key) > 2 and (own or longer):
                    phrase = " ".join(reversed(key[1:]) if from_end else key[1:])
                    out.append((key[0], phrase, f if own else None, [x[1] for x in stack] if own else None, longer))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["lang", "phrase", "a", "beginnings", "longer"])

        for batch in batches:
            for p, key, f, own in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "f", "own")), strict=True):
                depth = len(stack) if p == part else 0
                while depth and (len(stack[depth - 1][0]) >= len(key) or key[: len(stack[depth - 1][0])] != stack[depth - 1][0]):
                    depth -= 1
                leave(depth)
                part = p
                if stack and len(stack[-1][0]) == len(key) - 1:
                    stack[-1][2] = max(stack[-1][2] or 0, f)
                stack.append([key, f, None, own])
            yield batch_of()
            out = []
        leave(0)
        yield batch_of()

    dealt = stream.mapInArrow(deal, "part int, key array<string>, f long, own boolean").repartitionByRange(len(cuts) + 1, "part").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(read, "lang string, phrase string, a long, beginnings array<long>, longer long")


def mine(docs: DataFrame, longest: int = 3, least: int = 10, drop_share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score (and k, the cut's words) of each language's `top` phrases of 2 to `longest` words that stand `least` times or more and of which no longer one has drop_share percent. The score is the least of all cuts' floor(1000000 a^2 / (l r))."""
    levels, totals = counts(docs, longest, least)
    none = F.lit(None).cast("array<long>")
    left = lockstep(levels, False).select("lang", "phrase", "a", F.col("beginnings").alias("l"), none.alias("r"), "longer")
    right = lockstep(levels, True).select("lang", "phrase", "a", none.alias("l"), F.col("beginnings").alias("r"), "longer")
    both = left.union(right).groupBy("lang", "phrase").agg(*(F.max(c).alias(c) for c in ("a", "l", "r", "longer")))
    kept = both.filter(F.coalesce(100 * F.col("longer"), F.lit(0)) < drop_share * F.col("a"))
    whole = lambda c: c.cast("decimal(17,0)")
    squared = whole(F.col("a")) * whole(F.col("a")) * F.lit(1_000_000)

    def cut(k: Column) -> Column:
        # Beginnings go from one word on, ends too: the one behind a cut after k words is the k-th from the last.
        l, r = F.element_at("l", k), F.element_at("r", -k)
        return F.struct(F.call_function("div", squared, whole(l) * whole(r)).alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    worst = F.array_min(F.transform(F.sequence(F.lit(1), F.size("l")), cut))
    scored = kept.select("lang", "phrase", "a", worst.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "cut.k")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored.withColumn("rank", rank).filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "k")


#: What `mine` gives with its defaults, in DuckDB's SQL over the table documents.
MINE_SQL = """WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM words, range(1, 4) AS ks(k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM grams WHERE k > 1 AND f >= 10),
dropped AS (SELECT DISTINCT s.lang, s.phrase FROM candidates s JOIN candidates t ON t.lang = s.lang AND t.k = 3 AND s.k = 2
    AND (s.phrase = array_to_string(t.w[1:2], ' ') OR s.phrase = array_to_string(t.w[2:3], ' ')) AND 100 * t.a >= 50 * s.a),
cuts AS (SELECT c.lang, c.phrase, c.a, i AS k, array_to_string(w[1:i], ' ') AS first, array_to_string(w[i + 1 : c.k], ' ') AS rest
    FROM candidates c, range(1, 3) AS cut(i) WHERE i < c.k AND NOT EXISTS (FROM dropped d WHERE d.lang = c.lang AND d.phrase = c.phrase)),
scored AS (SELECT c.*, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM cuts c JOIN grams l ON l.lang = c.lang AND l.phrase = c.first JOIN grams r ON r.lang = c.lang AND r.phrase = c.rest),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score, CAST(k AS INTEGER) AS k FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
