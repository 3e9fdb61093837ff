"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of PASSAGE words that begin every STRIDE words;
terms are lower-cased words without marks, hashed to TERM_BINS, and weighted by
inverse document frequency over all documents.  A randomised SVD of the
benchmark's TF-IDF passages gives as many directions as it has passages, so that
each keeps its whole length, up to MOST_LATENT, or LATENT if there are so many
terms that matrices would be larger than TERM_BINS by LATENT: products of the
passages' Gram matrix with a random matrix are summed over the cluster, and only
matrices with a row for each term of the benchmark come to the driver.

Every passage of every document is projected and compared by cosine with every
benchmark passage, in blocks of BLOCK_ITEMS items.  It is also compared with the
benchmark passages' own TF-IDF vectors: whatever else it says, it is a candidate
if it has terms that make CONTAINED of a benchmark passage's squared weight, which
finds copies of short items and of those that the directions keep poorly.  (Their
cosine is still that of the latent space.)  Candidates are confirmed on the words: the longest common subsequence of item and neighbourhood must hold
VERBATIM of the item's words, or PARAPHRASE of them together with ANSWER of the
item's last words (its answer).

Documents that are null or wordless match nothing, nor do such items.  Rows
with the same doc_id are searched one by one and may give equal lines; items
with the same item_id are told apart by their text.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.llm.core import LOWER, docs_table, map_arrow, mix, ranges, span_hashes, text_groups
from rankfield.llm.tokens import CUTS, cut_pieces

PASSAGE = 32
STRIDE = 16
TERM_BINS = 1 << 16
LATENT = 128
MOST_LATENT = 512
POWER_STEPS = 2
#: Terms of less weight (in a tenth of all documents) are left to the comparison of words, if an item has at least TELLING others.
LEAST_WEIGHT = 2.3
TELLING = 3
#: Of a passage's squared length, terms that the benchmark has must make this share; a passage with a third of its words from an item has more.
LEAST_SHARE = 0.15
CANDIDATE = 0.6
CONTAINED = 0.5
VERBATIM = 0.8
PARAPHRASE = 0.6
ANSWER = 0.5
ANSWER_WORDS = 8
BLOCK_ITEMS = 4096
#: Pairs of a passage and a benchmark passage whose shared weight is summed at once.
BLOCK_PAIRS = 1 << 21
#: Texts are searched about so many bytes at a time.
GROUP_BYTES = 1 << 19


#: First bytes of characters that may have another case, beyond those of Latin-1.
OTHER_CASES = np.zeros(256, bool)
OTHER_CASES[[*range(0xC4, 0xE0), 0xE1, 0xE2, 0xEA, 0xEF, 0xF0]] = True


class Terms(NamedTuple):
    """Words of texts: 64-bit hashes, and index of each text's first word, with the end."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def bins(self) -> np.ndarray:
        return (mix(self.hashes) & np.uint64(TERM_BINS - 1)).astype(np.int64)


def lowered(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lower case: A-Z and the accented capitals of Latin-1 in place; groups with other alphabets character by character."""
    low = LOWER[buf]
    if not len(low):
        return low, off
    lead = np.flatnonzero(low[:-1] == 0xC3)
    second = low[lead + 1]
    low[lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)] + 1] += 0x20
    if not OTHER_CASES[low].any():
        return low, off
    raw = low.tobytes()
    each = [raw[a:b].decode("utf-8").lower().encode() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    return np.frombuffer(b"".join(each), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


def terms(buf: np.ndarray, off: np.ndarray) -> Terms:
    low, start, end, first = cut_pieces(*lowered(buf, off))
    word = ~CUTS[low[start]] if len(start) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(word)])
    return Terms(span_hashes(low, start[word], end[word]), kept[first])


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end word of each passage; a text's last passage ends with it."""
    size = np.diff(first)
    many = np.where(size > 0, 1 + np.maximum(-(-(size - PASSAGE) // STRIDE), 0), 0)
    text = np.repeat(np.arange(len(size)), many)
    begin = first[text] + ranges(np.zeros(len(size), np.int64), many) * STRIDE
    return text, begin, np.minimum(begin + PASSAGE, first[text + 1])


def inverse_frequency(docs: DataFrame) -> np.ndarray:
    """log(documents / documents that have the term), by bin; a bin that none has weighs most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(TERM_BINS, np.int64), 0
        for batch in batches:
            for a, b, buf, off in text_groups(batch.column("text")):
                t = terms(buf, off)
                doc = np.repeat(np.arange(b - a), np.diff(t.first))
                total += np.bincount(np.unique(doc * TERM_BINS + t.bins) % TERM_BINS, minlength=TERM_BINS)
                rows += b - a
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1]])), pa.array(np.concatenate([total[some], [rows]]))], ["bin", "n"])

    found = map_arrow(docs.select(F.col("text").cast("string").alias("text")), count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    bins, n = (found.column(c).to_numpy() for c in ("bin", "n"))
    out = np.zeros(TERM_BINS)
    out[bins[bins >= 0]] = n[bins >= 0]
    return np.log((n[bins < 0].sum() + 1) / (out + 0.5)).clip(0.01).astype(np.float32)


def vocabulary(items: DataFrame, weight: np.ndarray) -> np.ndarray:
    """The row of each term bin among the items' telling ones, in order; -1 for others."""

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in text_groups(batch.column("text")):
                t = terms(buf, off)
                bins, found = t.bins, [np.zeros(0, np.int64)]
                for a, b in zip(t.first[:-1].tolist(), t.first[1:].tolist()):
                    own = np.unique(bins[a:b])
                    heavy = own[weight[own] >= LEAST_WEIGHT]
                    found.append(heavy if len(heavy) >= TELLING else own)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], ["bin"])

    bins = np.sort(map_arrow(items, used, "bin long").distinct().toArrow().column("bin").to_numpy())  # at most TERM_BINS
    out = np.full(TERM_BINS, -1, np.int32)
    out[bins] = np.arange(len(bins))
    return out


def _gram(items: DataFrame, weight: np.ndarray, rows_of: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A'A times matrix, A being the unit TF-IDF passages of items."""
    shared = items.sparkSession.sparkContext.broadcast((weight, rows_of, matrix))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, row, m = shared.value
        total = np.zeros_like(m)
        for batch in batches:
            for _, _, buf, off in text_groups(batch.column("text")):
                t = terms(buf, off)
                bins = t.bins
                for a, b in zip(*(x.tolist() for x in passages(t.first)[1:])):
                    at, tf = np.unique(bins[a:b], return_counts=True)
                    at, tf = at[row[at] >= 0], tf[row[at] >= 0]
                    v = w[at] * tf
                    v /= max(np.linalg.norm(v), 1e-12)
                    at = row[at]
                    total[at] += v[:, None] * (v @ m[at])
        some = np.flatnonzero(total.any(axis=1))
        for k in range(0, len(some), 4096):
            part = some[k : k + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([x.tobytes() for x in total[part]], pa.binary())], ["bin", "v"])

    def sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:  # at most TERM_BINS vectors
            for k, v in zip(batch.column("bin").to_pylist(), batch.column("v").to_pylist()):
                v = np.frombuffer(v, np.float64)
                held[k] = held[k] + v if k in held else v
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["bin", "v"])

    rows = map_arrow(map_arrow(items, add, "bin long, v binary").repartition("bin"), sum_rows, "bin long, v binary").toArrow()
    out = np.zeros_like(matrix)
    if rows.num_rows:
        out[rows.column("bin").to_numpy()] = np.frombuffer(b"".join(rows.column("v").to_pylist()), np.float64).reshape(-1, matrix.shape[1])
    return out


def count_passages(items: DataFrame) -> int:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(len(passages(terms(buf, off).first)[0]) for _, _, buf, off in text_groups(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return map_arrow(items, count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def latent_directions(items: DataFrame, weight: np.ndarray, rows_of: np.ndarray) -> np.ndarray:
    """Right singular vectors of the benchmark's passages, a row a term that it has."""
    size = int(rows_of.max()) + 1
    latent = min(max(LATENT, count_passages(items)), MOST_LATENT, max(LATENT, LATENT * TERM_BINS // size))
    basis = np.random.default_rng(5).standard_normal((size, min(latent, max(size, 1))))
    for _ in range(POWER_STEPS):
        basis = np.linalg.qr(_gram(items, weight, rows_of, basis))[0]
    values, vectors = np.linalg.eigh(basis.T @ _gram(items, weight, rows_of, basis))
    return (basis @ vectors[:, ::-1] * (values[::-1] > 1e-9)).astype(np.float32)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit a word of a."""
    at: dict[int, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class Queries:
    """Benchmark items and their passages in the latent space."""

    def __init__(self, ids: list, texts: pa.Array, weight: np.ndarray, rows_of: np.ndarray, directions: np.ndarray):
        self.ids, self.words, rows, self.item = ids, [], [], []
        held, square = [], weight.astype(np.float64) ** 2
        for _, _, buf, off in text_groups(texts):
            t = terms(buf, off)
            base = len(self.words)
            self.words += [t.hashes[a:b].tolist() for a, b in zip(t.first[:-1], t.first[1:])]
            bins = t.bins
            for item, a, b in zip(*(x.tolist() for x in passages(t.first))):
                telling = bins[a:b][rows_of[bins[a:b]] >= 0]
                rows.append(weight[telling] @ directions[rows_of[telling]])
                own = np.unique(telling)
                held.append((rows_of[own], square[own] / max(square[own].sum(), 1e-12)))
                self.item.append(base + item)
        table = np.array(rows, np.float32).reshape(-1, directions.shape[1])
        norm = np.linalg.norm(table, axis=1)
        self.item = np.array(self.item, np.int64)
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.known = np.unique(np.array([w for x in self.words for w in x], np.uint64))
        bins = (mix(self.known) & np.uint64(TERM_BINS - 1)).astype(np.int64)
        telling = rows_of[bins] >= 0
        number = [np.searchsorted(self.known, np.array(x, np.uint64)) for x in self.words]
        self.own = [np.unique(x[telling[x]]) for x in number]
        #: Telling words that must be there if PARAPHRASE of all are: the others may all be.
        self.least = np.array([max(1, np.ceil(PARAPHRASE * len(x)) - (~telling[x]).sum()) for x in number])
        self.table = np.ascontiguousarray((table / np.maximum(norm[:, None], 1e-12)).T)
        # benchmark passages by term, with the share of their squared weight that it makes
        row = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in held)]).astype(np.int64)
        order = np.argsort(row, kind="stable")
        self.holder = np.repeat(np.arange(len(held)), [len(x) for x, _ in held])[order]
        self.share = np.concatenate([np.zeros(0), *(x for _, x in held)])[order]
        self.begins = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(directions)))])

    def contained(self, row: np.ndarray, of: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        """Passage and benchmark passage where the first has CONTAINED of the second's weight; row, of: each known term of many passages, ascending in of."""
        terms_, width = len(self.begins) - 1, len(self.item)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if not width:
            return found[0]
        key = np.unique(of * terms_ + row)
        of, row = key // terms_, key % terms_
        step = max(1, BLOCK_PAIRS // width)
        for k in range(0, many, step):
            a, b = np.searchsorted(of, [k, k + step])
            n = np.diff(self.begins)[row[a:b]]
            at = ranges(self.begins[row[a:b]], n)
            size = min(step, many - k) * width
            total = np.bincount(np.repeat(of[a:b] - k, n) * width + self.holder[at], self.share[at], size)
            hit = np.flatnonzero(total >= CONTAINED)
            found.append((hit // width + k, hit % width))
        return tuple(np.concatenate(x) for x in zip(*found))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word among the items' words; -1 for others."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1)

    def confirm(self, item: int, words: np.ndarray) -> tuple[float, str] | None:
        own = self.words[item]
        near = words.tolist()
        share = common_subsequence(own, near) / len(own)
        if share >= VERBATIM:
            return share, "verbatim"
        if share >= PARAPHRASE:
            answer = own[-ANSWER_WORDS:]
            if common_subsequence(answer, near) >= ANSWER * len(answer):
                return share, "paraphrase"
        return None


def leaks(texts: pa.Array, space, block) -> list[tuple[int, int, float, float, str]]:
    """Row, item_id, cosine, overlap and kind of each leak in texts.  space and block: broadcast weights, rows and directions; and Queries."""
    (weight, rows_of, directions), queries = space.value, block.value
    known = rows_of >= 0
    square = weight.astype(np.float64) ** 2
    out = []
    for a, _, buf, off in text_groups(texts, GROUP_BYTES):
        t = terms(buf, off)
        text, begin, end = passages(t.first)
        if not len(text):
            continue
        bins = t.bins
        mass = square[bins]
        energy = np.concatenate([[0.0], np.cumsum(mass)])
        near = np.concatenate([[0.0], np.cumsum(mass * known[bins])])
        own = np.concatenate([[0], np.cumsum(known[bins])])
        some = own[end] > own[begin]
        text, begin, end = text[some], begin[some], end[some]
        if not len(text):
            continue
        worth = near[end] - near[begin] >= LEAST_SHARE * (energy[end] - energy[begin])
        size = end - begin
        at = ranges(begin, size)
        of = np.repeat(np.arange(len(text)), size)
        some = known[bins[at]]
        at, of = bins[at[some]], of[some]
        held_in, held = queries.contained(rows_of[at].astype(np.int64), of, len(text))
        worth[held_in] = True
        if not worth.any():
            continue
        place = np.cumsum(worth) - 1
        some = worth[of]
        at, of, held_in = at[some], place[of[some]], place[held_in]
        text, begin, end = text[worth], begin[worth], end[worth]
        vector = weight[at, None] * directions[rows_of[at]]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))  # each passage has known terms
        p = np.add.reduceat(vector, first, axis=0)
        norm = np.linalg.norm(p, axis=1)
        best: dict[tuple[int, int], list[tuple[float, int]]] = {}
        number = queries.numbers(t.hashes)
        common_at = np.flatnonzero(number >= 0)
        number, belongs = number[common_at], np.zeros(len(queries.known), bool)
        for k in range(0, len(text), 2048):
            cosine = (p[k : k + 2048] / np.maximum(norm[k : k + 2048, None], 1e-12)) @ queries.table
            hit = cosine >= CANDIDATE
            x, y = np.searchsorted(held_in, [k, k + 2048])
            hit[held_in[x:y] - k, held[x:y]] = True
            i, j = np.nonzero(hit)
            value, i, item = cosine[i, j], i + k, queries.item[j]
            # no more telling words can stand in common order than are there at all
            low = np.maximum(begin[i] - queries.size[item], t.first[text[i]])
            high = np.minimum(begin[i] + PASSAGE + queries.size[item], t.first[text[i] + 1])
            for one in np.unique(item).tolist():
                mine = np.flatnonzero(item == one)
                belongs[queries.own[one]] = True
                shared_words = np.concatenate([[0], np.cumsum(belongs[number])])
                belongs[queries.own[one]] = False
                common = shared_words[np.searchsorted(common_at, high[mine])] - shared_words[np.searchsorted(common_at, low[mine])]
                for x in mine[common >= queries.least[one]].tolist():
                    best.setdefault((int(text[i[x]]), one), []).append((float(value[x]), int(begin[i[x]])))
        for (doc, item), hits in best.items():
            size = len(queries.words[item])
            for cosine_, place in sorted(hits, reverse=True):
                x, y = max(place - size, t.first[doc]), min(place + PASSAGE + size, t.first[doc + 1])
                if said := queries.confirm(item, t.hashes[x:y]):
                    out.append((a + doc, queries.ids[item], cosine_, *said))
                    break
    return out


FOUND = "doc_id long, item_id long, cosine double, overlap double, kind string"


def _searches(texts: DataFrame, benchmark: DataFrame) -> list[tuple]:
    """What the search of texts needs: the latent space, broadcast once, and with it each block of items."""
    spark = texts.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    weight = inverse_frequency(texts)
    rows_of = vocabulary(items.select("text"), weight)
    if rows_of.max() < 0:
        return []
    directions = latent_directions(items.select("text"), weight, rows_of)
    space = spark.sparkContext.broadcast((weight, rows_of, directions))
    blocks = max(1, -(-items.count() // (BLOCK_ITEMS // 2)))
    out = []
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        out.append((space, spark.sparkContext.broadcast(Queries(part.column("item_id").to_pylist(), part.column("text"), weight, rows_of, directions))))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine of the best candidate passage, share of the item's words in common order, and kind, of each leak."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    searches = _searches(texts, benchmark)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for space, block in searches:
                if found := leaks(batch.column("text"), space, block):
                    row, *rest = zip(*found)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *(pa.array(c, k) for c, k in zip(rest, (pa.int64(), pa.float64(), pa.float64(), pa.string())))], ["doc_id", "item_id", "cosine", "overlap", "kind"])

    return map_arrow(texts, search, FOUND)


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leak, with docs's columns; texts pass through without a shuffle."""
    searches = _searches(docs.select(F.col("text").cast("string").alias("text")), benchmark)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for space, block in searches:
                clean[[row for row, *_ in leaks(batch.column("text"), space, block)]] = False
            yield batch.filter(pa.array(clean))

    return map_arrow(docs, search, docs.schema)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(docs_table(spark, sf_dir), docs_table(spark, sf_dir, "benchmark"))
