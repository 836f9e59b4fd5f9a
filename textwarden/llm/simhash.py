"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint is embedded as the numbers of ones in its segments. One differing bit changes one
number by one, so the Manhattan distance of two embeddings is at most the Hamming distance of
the fingerprints: a grid over the embedding finds every pair within a radius, the Manhattan
distance drops most others, and the exact distance decides.

For a small radius the grid is exact: the segments form ``radius + 4`` groups, of which two
fingerprints within the radius agree in at least four, so they meet in a cell of some four
groups. For the similarity of whole texts (``near_groups``) longer fingerprints and a wide
radius are needed, where such a grid would meet almost everything, and texts with a common
passage everything of their kind; there a text's rarest shingles make the cells. Within them the
Manhattan distance, then the exact distance drop most pairs, and the others are verified by
their shingles.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm import cells
from textwarden.llm.repeats import range_hashes
from textwarden.llm.skew import near, spread_join
from textwarden.llm.token_ids import small_batches
from textwarden.runtime import materialise

SEED = 42
SEGMENT_BITS = 2
#: Words whose shingles are hashed at once.
BLOCK_WORDS = 2**17
#: Classes of shingles that are counted, to tell rare from frequent ones, and distinct shingles from which fingerprints can rule out a pair.
SLOTS, SMALL_SET = 2**20, 32
#: Longs of a set's parities.
PARITIES = 8
_EVEN = 0x5555555555555555


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words (blanks are U+0020 and U+0009 to U+000D, A-Z lower-cased), with repeats; of all words if there are fewer; none without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, "u8")
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), "i8", len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    last = ends[-n:] if len(parts) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)), "u8", n)


def majority(hashes: np.ndarray) -> int:
    """A signed 64-bit fingerprint: a bit is 1 if it is in more than half of the hashes."""
    ones = np.zeros(64, "i8")
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].astype(">u8").view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def again(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, by a multiply-shift finaliser."""
    x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprint(text: Column, words: int) -> Column:
    """The 64-bit fingerprint as a signed long; zero for null and for texts without words."""

    @F.pandas_udf("bigint")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([majority(shingle_hashes(t, words)) for t in texts], dtype="int64")

    return prints(text)


def embed(fp: Column) -> Column:
    """How many ones each two-bit segment has, in unary (0: 00, 1: 01, 2: 11), so that the Manhattan distance of two embeddings is the number of bits that differ."""
    low, high = fp.bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def distance(x: Column, y: Column) -> Column:
    """Bits in which two longs differ; of embeddings: their Manhattan distance."""
    return F.bit_count(x.bitwiseXOR(y))


def grid_cells(fp: Column, radius: int) -> Column:
    """Names of the grid's cells of a fingerprint: one for every choice of four of ``radius + 4`` groups of segments. Cells that share a name are one cell."""
    groups = np.array_split(np.arange(64 // SEGMENT_BITS), radius + 4)
    masks = [sum(3 << (2 * int(s)) for g in chosen for s in g) for chosen in itertools.combinations(groups, 4)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    return F.transform(F.from_json(F.lit(str(signed)), "array<bigint>"), lambda m, i: F.xxhash64(i, embed(fp).bitwiseAND(m)))


def bit_links(prints: DataFrame, radius: int) -> DataFrame:
    """``node``, ``root`` over the distinct fingerprints ``fp``, linked at ``radius`` or fewer differing bits."""
    members, sizes = cells.shared(prints.select(F.explode(grid_cells(F.col("fp"), radius)).alias("key"), F.col("fp").alias("id"), F.lit(True).alias("first"), F.lit(0).alias("at")))
    members = members.select("key", "size", "least", F.struct("id", "first", "at").alias("m"))

    def alike(x: Column, y: Column) -> Column:
        return (distance(embed(x["id"]), embed(y["id"])) <= radius) & (distance(x["id"], y["id"]) <= radius)

    return cells.linked(members, sizes, alike)


def two_bit_components(df: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest key reachable over fingerprints that differ in two bits or fewer.

    Every row comes back, repeated rows too; null and wordless texts have fingerprint zero and
    link like any other. Null keys can be linked but are never a ``component_id`` unless nothing
    else is in reach (then it is null). Extra columns are not read.
    """
    small_batches(df.sparkSession)
    rows = materialise(df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), fingerprint(F.col(f"`{text}`"), words).alias("fp")), "simhash")
    sizes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    prints = materialise(sizes, "simhash-distinct")
    roots = bit_links(prints.select("fp"), 2)
    linked = roots.join(prints, roots["node"] == prints["fp"]).select("fp", "root", "least")
    found = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    named = materialise(prints.join(found, "fp", "left").select("fp", "size", F.coalesce("component_id", "least").alias("component_id")), "simhash-components")
    return spread_join(rows, named.drop("size"), "fp", named.select("fp", "size")).select("doc_id", "fp", "component_id")


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``words`` words, as in ``shingle_hashes``, ascending: polynomials of their bytes from running sums, mixed."""
    parts = (text or "").encode().lower().split()
    found = [np.zeros(0, "u8")]
    for at in range(0, max(1, len(parts) - words + 1), BLOCK_WORDS):
        data = np.frombuffer(b" ".join([*parts[at : at + BLOCK_WORDS + words - 1], b""]), "u1")
        if len(data):
            ends = np.flatnonzero(data == 32)
            starts = np.concatenate([[0], ends[:-1] + 1])
            last = ends[words - 1 :] if len(ends) >= words else ends[-1:]
            found.append(range_hashes(data, starts[: len(last)], last))
    return np.unique(np.concatenate(found))


def order_counts(texts: DataFrame, words: int) -> np.ndarray:
    """In how many texts the shingles of each of ``SLOTS`` classes of hashes stand, as quarter logarithms, so that a frequent shingle makes its class stand out. A megabyte, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(SLOTS, "i8")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(found, slot(shingles(text, words)), 1)
        at = np.flatnonzero(found)
        for part in range(0, len(at), 65_536):
            own = at[part : part + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(found[own])], ["slot", "n"])

    level = F.least(F.lit(255), F.floor(4 * F.log2(F.sum("n") + 1))).cast("short")
    totals = texts.mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(level.alias("level")).toArrow()  # SLOTS rows at most
    found = np.zeros(SLOTS, "u1")
    found[totals["slot"].to_numpy()] = totals["level"].to_numpy()
    return found


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype("i8")


def rarest(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """Of a text's distinct shingles, the rarest first, as many as a pair of the similarity can't have all on one side; and how many of them do if the text is the one with fewer shingles.

    Two sets of the similarity share a shingle that is among the latter of the smaller and among
    the former of the larger set, whichever order all sets follow (prefix filtering).
    """
    n = len(hashes)
    wide, narrow = (n - math.ceil(part * n - 1e-9) + 1 for part in (similarity, 2 * similarity / (1 + similarity)))
    return hashes[np.lexsort((hashes, counts[slot(hashes)]))[:wide]], narrow


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether each of ``64 * PARITIES`` classes has an odd number of the hashes, as longs. Those of two sets differ in no more bits than the sets in members."""
    odd = np.bincount((hashes % np.uint64(64 * PARITIES)).astype("i8"), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype("u1")).view("i8")


def sketches(text: Column, words: int, similarity: float, counts: np.ndarray) -> Column:
    """``struct<a, b, n, narrow, keys, p0, p1, ...>``: two fingerprints of the text's distinct shingles, how many they are, the rarest of them, and their parities."""
    names = [f"p{i}" for i in range(PARITIES)]

    @F.pandas_udf("a bigint, b bigint, n int, narrow int, keys array<bigint>, " + ", ".join(f"{p} bigint" for p in names))
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                h = shingles(t, words)
                keys, narrow = rarest(h, counts, similarity)
                rows.append((majority(h), majority(again(h)), len(h), narrow, keys.view("i8"), *parities(h).tolist()))
            yield pd.DataFrame(rows, columns=["a", "b", "n", "narrow", "keys", *names])

    return sketch(text)


def likely(x: Column, y: Column, similarity: float) -> Column:
    """Whether two members of a cell may reach the similarity: what either has from the key on is as much as it demands in common, the sizes allow it, and the fingerprints are no further apart than it makes likely (mean and four deviations; not asked of small sets, whose spread is wider). The Manhattan distance of their embeddings, a lower bound, is asked first.

    All that two sets have in common stands from the first key they share on (positional
    filtering), so a pair of the similarity passes in the cell of that key, if not in others.
    Parities, asked last, drop most pairs of sets of up to some 800 shingles that differ in more
    than it allows, as copies of a text that is not there do from each other.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = math.ceil(128 * p + 4 * math.sqrt(128 * p * (1 - p)))
    few, many = F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"])
    met = F.least(x["n"] - x["at"], y["n"] - y["at"]) >= similarity / (1 + similarity) * (x["n"] + y["n"]) - 1e-9
    bound = distance(embed(x["a"]), embed(y["a"])) + distance(embed(x["b"]), embed(y["b"]))
    exact = distance(x["a"], y["a"]) + distance(x["b"], y["b"])
    odd = sum((distance(x[f"p{i}"], y[f"p{i}"]) for i in range(1, PARITIES)), distance(x["p0"], y["p0"]))
    differ = (1 - similarity) / (1 + similarity) * (x["n"] + y["n"]) + 1e-9
    return met & (few >= similarity * many - 1e-9) & ((few < SMALL_SET) | ((bound <= radius) & (exact <= radius))) & (odd <= differ)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """``a``, ``b``: the pairs (``x``, ``y``) whose texts' sets of shingles reach the similarity. Each text of a pair is cut into shingles once; their hashes are compared."""

    @F.pandas_udf("binary")
    def packed(ts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).tobytes() for t in ts])

    @F.pandas_udf("boolean")
    def reach(ps: pd.Series, qs: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(ps, qs, strict=True):
            x, y = np.frombuffer(p, "u8"), np.frombuffer(q, "u8")
            both = len(x) + len(y) - len(np.union1d(x, y))
            out.append(both >= similarity * (len(x) + len(y) - both))
        return pd.Series(out, dtype="bool")

    wanted = materialise(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct(), "near-wanted")
    sets = materialise(texts.join(near(wanted, wanted.count()), "doc_id", "left_semi").select("doc_id", packed("text").alias("set")), "near-sets")
    sides = pairs.join(sets.select(F.col("doc_id").alias("y"), F.col("set").alias("q")), "y")
    sides = spread_join(sides, sets.select(F.col("doc_id").alias("x"), F.col("set").alias("p")), "x", pairs.groupBy("x").agg(F.count("*").alias("size")))
    return sides.filter(reach("p", "q")).select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_groups(df: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``group_id``, the smallest key of the group, for rows whose texts are near-duplicates of others.

    Two texts are near-duplicates if the Jaccard similarity of their shingle sets reaches
    ``similarity``, and a group is a component of such links. Texts that share one of their
    rarest shingles, as many as the similarity demands, share a cell, so every pair of the
    similarity does, at any size of the input; a passage that many texts have makes no cells as
    long as it is not what makes them similar. Pairs whose 128-bit fingerprints are near enough
    are decided by their shingles, equal fingerprints too; ``cells.linked`` sees to it that no
    link is lost in large cells. Rows without a near-duplicate don't come back. Null keys are
    left out, and null and wordless texts, which have no shingles to compare. Rows with one key
    are one document, near to what any of its texts is near to.
    """
    small_batches(df.sparkSession)
    rows = df.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"))
    texts = rows.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    counts = order_counts(texts.select("text"), words)
    prints = texts.select("doc_id", sketches(F.col("text"), words, similarity, counts).alias("s")).select("doc_id", "s.*")
    prints = materialise(prints, "near-prints")
    found = prints.select("narrow", F.col("doc_id").alias("id"), F.posexplode("keys").alias("at", "key")).select("key", "id", (F.col("at") < F.col("narrow")).alias("first"), "at")
    members, sizes = cells.shared(found)
    compared = ["a", "b", "n", *(f"p{i}" for i in range(PARITIES))]
    members = members.join(prints.select(F.col("doc_id").alias("id"), *compared), "id").select("key", "size", "least", F.struct("id", "first", "at", *compared).alias("m"))
    roots = cells.linked(members, sizes, lambda x, y: likely(x, y, similarity), lambda pairs: verified(pairs, texts, similarity, words))
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))


def drop_near_copies(df: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row, the one with the smallest key, of each group of near-duplicates."""
    lost = near_groups(df, words, similarity, key=key, text=text).filter("doc_id != group_id").select(F.col("doc_id").alias("lost"))
    lost = materialise(lost, "near-lost")
    return df.join(near(lost, lost.count()), df[f"`{key}`"] == lost["lost"], "left_anti")
