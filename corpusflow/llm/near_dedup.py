"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct word runs. Each of ``BANDS * ROWS``
registers holds the minimum of one hash over the set, turned into an exponential
variate and truncated on an exponential scale, so registers of two sets merge by
maximum and agree with a probability close to the Jaccard similarity. Four
registers side by side fill one 64-bit band value; documents that share a band
value are candidates.

1. Equal sets are collapsed first, so thousands of copies are one node.
2. Every band value draws a hub, and every node is compared with the hub it
   shares most band values with. The similarity is estimated from all registers
   by maximum likelihood, and links that are not hopeless are confirmed on the
   full sets. Stars, not pairs, so a group of n near copies costs n comparisons.
   A few turns with new hubs follow among band values that still hold different
   components.
3. What is left are nodes that may be alike but have no link so far. All their
   pairs across components that share a band value are compared, so no link
   between candidates is lost: as rows, each pair once, where few nodes share the
   value, else block by block inside the tasks.

At the similarity of 0.8 a linked pair shares a band with probability
1 - (1 - 0.8^4)^32, about 1 - 5e-8; the likelihood filter lies more than five
standard deviations below. Lower thresholds take the same registers in more bands
of two or one, so that a pair at the threshold is missed with probability ``MISS``
at most; where even bands of one register miss more, the threshold is refused.

Defined results: null, empty and blank texts have no shingle and are linked with
nothing; texts shorter than a shingle are one shingle; rows without an id are
linked like all others and take the least id of their component, null if it holds
none; rows with one id and different texts are separate documents until a link
joins them. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import columns
from corpusflow.llm.components import components
from corpusflow.llm.grams import shingles
from corpusflow.session import join_checked, settled

BANDS, ROWS = 32, 4
#: A pair at the threshold shares no band with this probability at most.
MISS = 1e-6
BASE, RATE, TOP = 1.001, 20.0, 65_534
#: Turns of stars, and hubs per node and turn, before the remaining pairs are compared.
TURNS, HUBS = 2, 2
#: Rounds of joining stars between the turns.
ROUNDS = 2
#: Nodes of one band value up to which the remaining pairs are compared as rows.
FEW = 256
#: Nodes and shingles of one block beyond that, and steps over which such band values are gathered.
BLOCK, BLOCK_SET, REACH = 2048, 2_000_000, 2
#: Estimates this far below the threshold are hopeless, or ``DEVIATIONS`` standard deviations of 128 registers.
MARGIN, DEVIATIONS = 0.2, 5
_DRAW = np.random.default_rng(8_128).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_FACTOR, _SHIFT = _DRAW[0] * np.uint64(2) + np.uint64(1), _DRAW[1]


def sketch(values: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes: truncated exponential minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 2048):
        part = values[at : at + 2048]
        least = np.minimum(least, (part[None, :] * _FACTOR[:, None] + _SHIFT[:, None]).min(axis=1))
    return registers(least)


def registers(least: np.ndarray) -> np.ndarray:
    share = (least.astype(np.float64) + 1.0) / 2.0**64
    wait = -np.log1p(-np.minimum(share, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(wait) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def likely_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate from registers (one row per pair) and set sizes.

    With u and v the sizes' shares, a register of the first set is the larger with
    probability p(u - vJ), of the second with p(v - uJ), p(x) = -log_b(1 - x(b-1)/b),
    and both agree otherwise. The log likelihood is concave in J; its slope is
    bisected.
    """
    u = n_a / (n_a + n_b)
    more, fewer = (a > b).sum(axis=1), (a < b).sum(axis=1)
    low, high = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(40):
        j = (low + high) / 2
        up = _slope(j, u, more, fewer, a.shape[1]) > 0
        low, high = np.where(up, j, low), np.where(up, high, j)
    return (low + high) / 2


def _slope(j: np.ndarray | float, u: np.ndarray, more: np.ndarray, fewer: np.ndarray, held: int) -> np.ndarray:
    """Slope of the log likelihood at J = j; the estimate lies above j where it is positive."""
    v = 1.0 - u
    c = (BASE - 1) / BASE
    tiny = 1e-12

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * c) / np.log(BASE)

    def rise(x: np.ndarray) -> np.ndarray:
        return c / (np.log(BASE) * (1 - np.clip(x, 0, 1) * c))

    x, y = u - v * j, v - u * j
    more, fewer = more.astype(float), fewer.astype(float)
    return (
        -more * v * rise(x) / np.maximum(p(x), tiny)
        - fewer * u * rise(y) / np.maximum(p(y), tiny)
        + (held - more - fewer) * (v * rise(x) + u * rise(y)) / np.maximum(1 - p(x) - p(y), tiny)
    )


def hopeful(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Of all rows of ``a`` against all rows of ``b``: whether the estimate is not hopeless."""
    found = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(a), 256):
        part, size = a[at : at + 256], n_a[at : at + 256, None].astype(float)
        more, fewer = (np.zeros((len(part), len(b)), np.uint8) for _ in range(2))
        for place in range(a.shape[1]):
            more += part[:, place, None] > b[None, :, place]
            fewer += part[:, place, None] < b[None, :, place]
        near = 100 * np.minimum(size, n_b) >= percent * np.maximum(size, n_b)
        found[at : at + 256] = near & (
            _slope(percent / 100 - margin(percent), size / (size + n_b), more, fewer, a.shape[1]) >= 0
        )
    return found


def _shingle_set(data: bytes | None, words: int) -> np.ndarray:
    return shingles((data or b"").lower(), words)  # lower() of bytes changes A-Z only


def band_rows(percent: int) -> int:
    """Registers of a band: the most of ``ROWS``, 2 and 1 that keep to ``MISS`` at the threshold."""
    share = percent / 100
    for held in (ROWS, 2, 1):
        if 0 < share <= 1 and (1 - share**held) ** (BANDS * ROWS // held) <= MISS:
            return held
    raise ValueError(f"at {percent} percent {BANDS * ROWS} registers miss more than {MISS} of the pairs at the threshold")


def margin(percent: int) -> float:
    share = percent / 100
    return max(MARGIN, DEVIATIONS * (share * (1 - share) / (BANDS * ROWS)) ** 0.5)


def _sketches(docs: DataFrame, words: int, held_rows: int) -> DataFrame:
    """Per row: id, hash of its text, size of its set, digest of the set, band values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                held = _shingle_set(text.as_py(), words)
                sizes.append(len(held))
                digests.append(hashlib.blake2b(held.tobytes(), digest_size=16).digest())
                bands.append(sketch(held).view(f"<i{2 * held_rows}").astype("<i8") if len(held) else np.zeros(0, "<i8"))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "text_hash": batch.column("text_hash"),
                    "n_shingles": pa.array(sizes, pa.int64()),
                    "node": pa.array(digests, pa.binary()),
                    "bands": pa.array(bands, pa.list_(pa.int64())),
                }
            )

    return _texts(docs).mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>"
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose estimated similarity is not hopeless."""
    width, least = 2 * band_rows(percent), percent / 100 - margin(percent)

    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        if a.empty:
            return pd.Series([], dtype="float64")
        left, right = (np.stack(list(x)).astype(f"<i{width}").view("<u2").reshape(len(x), -1) for x in (a, b))
        return pd.Series(likely_jaccard(left, right, n_a.to_numpy(float), n_b.to_numpy(float)))

    info = nodes.select("node", "bands", "n_shingles")
    one = info.select(F.col("node").alias("u"), F.col("bands").alias("a"), F.col("n_shingles").alias("n_a"))
    two = info.select(F.col("node").alias("v"), F.col("bands").alias("b"), F.col("n_shingles").alias("n_b"))
    return (
        pairs.join(one, "u").join(two, "v")
        # Sizes alone rule a pair out when the smaller is below the threshold's share.
        .filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (percent / 100) - 1e-9)
        .filter(estimate("a", "b", "n_a", "n_b") >= least)
        .select("u", "v")
    )


def _full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The whole shingle sets of the wanted nodes, from the texts of their representatives."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_shingle_set(t.as_py(), words).view("<i8") for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_pydict(
                {"node": batch.column("node"), "s": pa.array(sets, pa.list_(pa.int64()))}
            )

    ids = settled(
        wanted.join(nodes.select("node", "rep"), "node")
        .select("node", F.col("rep.doc_id").alias("__id"), F.col("rep.text_hash").alias("__hash"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    # Repeated rows of a representative give equal sets; one of them is kept.
    return settled(
        join_checked(_texts(docs), ids, same).select("node", "text")
        .mapInArrow(sets_of, "node binary, s array<long>").dropDuplicates(["node"])
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v"
    )
    shared = F.size(F.array_intersect("a", "b"))
    return both.filter(100 * shared >= percent * (F.size("a") + F.size("b") - shared)).select("u", "v")


def _ordered(one: str, two: str) -> list:
    return [F.greatest(one, two).alias("u"), F.least(one, two).alias("v")]


def _mixed(held: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with their components' labels, of the band values that hold different components."""
    if labels is None:
        return held.withColumn("label", F.col("node"))
    named = labels.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("l"))
    placed = held.join(named, "node", "left").select("band", "value", "n", "node", F.coalesce("l", "node").alias("label"))
    ends = placed.groupBy("band", "value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    return placed.join(ends.filter("lo <> hi").select("band", "value"), ["band", "value"])


def _stars(members: DataFrame, turn: int) -> DataFrame:
    """Each node with the hubs, of other components, that it shares most band values with."""
    draw = F.struct(F.xxhash64("node", "band", F.lit(turn)).alias("h"), "node", "label")
    hubs = members.groupBy("band", "value").agg(F.min(draw).alias("hub"))
    votes = (
        members.join(hubs, ["band", "value"])
        .filter(F.col("label") != F.col("hub.label"))
        .groupBy("node", F.col("hub.node").alias("hub"))
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    # One draw per band, so a node has at most BANDS hubs to choose from.
    ranked = votes.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("votes", "hub")), False).alias("all"))
    best = ranked.select("node", F.explode(F.slice("all", 1, HUBS)["hub"]).alias("hub"))
    return best.select(*_ordered("node", "hub")).distinct()


def _crowds(members: DataFrame) -> DataFrame:
    """Band values with very many nodes, gathered under one crowd where they share nodes: distinct (crowd, node, label).

    A crowd is named by the least hash of the nodes its values reach in ``REACH``
    steps. Any grouping of values is right, since all nodes of a value stay together;
    a good one lets a node that holds many of the values take part once. There is
    one value per ``FEW`` rows at most.
    """
    key = ["band", "value"]
    named = members.select(*key, "node", F.xxhash64("node").alias("crowd"))
    for _ in range(REACH):
        of_value = settled(named.groupBy(*key).agg(F.min("crowd").alias("crowd")))
        of_node = join_checked(members, of_value, key).groupBy("node").agg(F.min("crowd").alias("crowd"))
        named = members.select(*key, "node").join(of_node, "node")
    of_value = settled(named.groupBy(*key).agg(F.min("crowd").alias("crowd")))
    return join_checked(members, of_value, key).select("crowd", "node", "label").distinct()


def _by_blocks(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside band values with very many nodes.

    The values are gathered to crowds, the nodes of a crowd dealt to blocks of about
    ``BLOCK`` nodes and ``BLOCK_SET`` shingles; every two blocks of a crowd meet in one
    task. There the registers of all pairs are estimated, what is not hopeless is
    confirmed on the full sets by matrix products, and one link per pair of components
    at most is returned. No pair is left out and no row is made for a pair; a set
    travels once per block of its crowd, however many band values it shares.
    """
    width = 2 * band_rows(percent)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["s"].map(len).to_numpy()
        _, label = np.unique(rows["label"].to_numpy(), return_inverse=True)
        left = np.flatnonzero((rows["own"] == rows["lo"]).to_numpy())
        right = np.flatnonzero((rows["own"] == rows["hi"]).to_numpy())
        held = np.stack(list(rows["bands"])).astype(f"<i{width}").view("<u2").reshape(len(rows), -1)
        open_ = hopeful(held[left], held[right], sizes[left], sizes[right], percent)
        open_ &= label[left][:, None] != label[right][None, :]
        one, two = open_.any(axis=1), open_.any(axis=0)
        left, right, open_ = left[one], right[two], open_[np.ix_(one, two)]
        linked = _alike(rows["s"], left, right, sizes, percent) & open_
        a, b = np.nonzero(linked)
        one, two = label[left][a].astype(np.int64), label[right][b].astype(np.int64)
        _, first = np.unique(np.minimum(one, two) * (len(rows) + 1) + np.maximum(one, two), return_index=True)
        node = rows["node"].to_numpy()
        u, v = node[left[a[first]]], node[right[b[first]]]
        return pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)}, dtype=object)

    placed = settled(_crowds(members).join(nodes.select("node", "n_shingles"), "node"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SET)).cast("int")
    dealt = (
        join_checked(placed, settled(placed.groupBy("crowd").agg(blocks.alias("blocks"))), "crowd")
        .withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("crowd", "node", "label", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    whole = sets.join(nodes.select("node", "bands"), "node")
    return dealt.join(whole, "node").groupBy("crowd", "lo", "hi").applyInPandas(meet, "u binary, v binary")


def _alike(sets: pd.Series, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Of all pairs of the rows at ``left`` and ``right``: whether the full sets reach the threshold."""
    shared = np.zeros((len(left), len(right)), np.float32)
    rows = np.union1d(left, right)
    if not len(rows):
        return shared > 0
    flat = np.concatenate([np.asarray(sets.iloc[at], np.int64) for at in rows])
    kinds, code = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(rows)), sizes[rows])
    often = np.bincount(code, minlength=len(kinds)) > 1  # a shingle of one node is shared with none
    place = np.cumsum(often) - 1
    row, code = row[often[code]], place[code[often[code]]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    at_left, at_right = np.searchsorted(rows, left), np.searchsorted(rows, right)
    for first in range(0, int(often.sum()), 2048):
        low, high = np.searchsorted(code, [first, first + 2048])
        part = np.zeros((len(rows), 2048), np.float32)
        part[row[low:high], code[low:high] - first] = 1
        shared += part[at_left] @ part[at_right].T
    every = sizes[left][:, None] + sizes[right][None, :] - shared
    return 100 * shared >= percent * every


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept, text_hash.

    ``component_id`` is the least id that can be reached over links, the document's
    own included; ``kept`` marks the documents that are their component's least id,
    all rows of a component without ids among them.
    """
    return _placed(docs, words, percent).drop("label")


def _placed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows of ``near_duplicates`` with their component's label, null for texts without shingles."""
    rows = settled(_sketches(docs, words, band_rows(percent)))
    nodes = settled(
        rows.filter("n_shingles > 0")
        .groupBy("node")
        .agg(
            # Ids first, null last.
            F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_hash")).alias("rep"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
        )
    )
    members = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    shared = members.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = settled(members.join(shared, ["band", "value"]))
    sets = _full_sets(held.select("node").distinct(), nodes, docs, words)

    labels = None
    for turn in range(TURNS):
        stars = _stars(_mixed(held, labels), turn)
        new = settled(_confirmed(_likely(stars, nodes, percent), sets, percent))
        # Stars not yet joined only cost comparisons; the last call below joins all of them.
        labels = components(new if labels is None else labels.unionAll(new), ROUNDS)

    rest = settled(
        _mixed(held, labels).join(nodes.select("node", "bands", "n_shingles"), "node")
        # A pair meets in its first shared band only: none of the bands before agrees.
        .select("band", "value", "n", "node", "label", "n_shingles", F.slice("bands", F.lit(1), F.col("band")).alias("earlier"))
    )
    agree = F.exists(F.zip_with("x.earlier", "y.earlier", lambda a, b: a == b), lambda same: same)
    few = rest.filter(F.col("n") <= FEW)
    across = (
        few.alias("x").join(
            few.alias("y"),
            (F.col("x.band") == F.col("y.band")) & (F.col("x.value") == F.col("y.value"))
            & (F.col("x.label") < F.col("y.label"))
            & (100 * F.least("x.n_shingles", "y.n_shingles") >= percent * F.greatest("x.n_shingles", "y.n_shingles"))
            & ~agree,
        )
        .select(*_ordered("x.node", "y.node"))
    )
    one_by_one = _confirmed(_likely(across, nodes, percent), sets, percent)
    many = rest.filter(F.col("n") > FEW).select("band", "value", "node", "label")
    more = settled(one_by_one.unionAll(_by_blocks(many, nodes, sets, percent)))
    labels = components(labels.unionAll(more))

    named = nodes.select("node", "rep.doc_id").join(
        labels.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left"
    ).withColumn("label", F.coalesce("label", "node"))
    least_id = named.groupBy("label").agg(F.min("doc_id").alias("component"))
    component = named.join(least_id, "label").select("node", "component", "label")
    own = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"))
    return (
        rows.select("doc_id", "text_hash", "n_shingles", "node")
        .join(component, "node", "left")
        .select(
            "doc_id", "n_shingles", own.alias("component_id"),
            F.col("doc_id").eqNullSafe(own).alias("kept"), "text_hash", "label",
        )
    )


def keep_one(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, all columns unchanged.

    Of a group's rows with the kept id, or of all its rows if none has an id, those
    with the least text hash are chosen; of rows that repeat that id and text, one
    stays. Texts are shuffled for such rows only, and only if there are any.
    """
    alone = F.col("label").isNull()  # without shingles: each id and text is a group
    chosen = F.struct(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "n")
    kept = settled(
        _placed(docs, words, percent)
        .filter("kept")
        .groupBy("label", "doc_id", "text_hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("label", F.when(alone, F.col("doc_id")), F.when(alone, F.col("text_hash")))
        .agg(F.min(chosen).alias("one"))
        .select("one.__id", "one.__hash", (F.col("one.n") > 1).alias("__again"))
    )
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    found = join_checked(docs, kept, same)
    once = found.filter(~F.col("__again")).select(*columns(docs))
    if kept.filter("__again").isEmpty():
        return once
    return once.unionAll(found.filter("__again").dropDuplicates(["__id", "__hash"]).select(*columns(docs)))
