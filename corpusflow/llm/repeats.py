"""Repeated passages by prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of one document; a window is repeated when
the same words start anywhere else, in the same document or another. Windows are
the suffixes of all texts cut at that depth. They are split by variable-length
prefixes into groups of bounded size: a prefix of one word, or of 2, 4, 8 ... words
where a shorter one is too frequent. Each group holds whole subtrees of the
suffix tree; its nodes at the full depth with two or more leaves are the repeats,
and neighbouring repeats merge to maximal ones.

What keeps this affordable:

* Equal texts are collapsed first, so copies are one row with a count; a text that
  occurs twice is covered as a whole.
* Two equal windows agree in the least hash among their runs of ``gram`` words
  (their anchor). Only anchors that occur twice can belong to repeats, about one
  in ten positions is an anchor, and only windows around repeated anchors become
  suffixes. Nothing is lost by it.
* Entries travel packed, many to a row, and repeats inside one batch are settled
  there, so a passage that a third of all documents share sends one entry per
  batch.

Every task holds one Arrow batch or one group, whose size is bounded by the split
of the prefixes. No step collects more than the frequent prefixes (at most
``8 * groups`` numbers per level) to the driver.

Windows are compared by word hashes of 64 bits combined to 96 bits.

Defined results: null, empty and blank texts have no word; texts shorter than a
window lose nothing; repeated rows are copies of each other; equal texts get equal
results whatever their id, null ids included. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import partitions
from corpusflow.llm.grams import mix, word_hashes

WINDOW = 35
GROUP_WINDOWS = 4_000_000
FEW = 1_000
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
NOWHERE = np.uint32(0xFFFFFFFF)
ANCHORS = np.dtype([("code", "<u8"), ("own", "<u4")])
SUFFIXES = np.dtype([("code", "<u8"), ("more", "<u4"), ("own", "<u4"), ("at", "<u4")])
PLACES = np.dtype([("own", "<u4"), ("at", "<u4")])
PACKED = "kind int, part int, key binary, keys binary, body binary, n_words long, n_removed long, kept_sha256 string, spans array<int>"


def doubled(words: np.ndarray, longest: int) -> list[tuple[int, np.ndarray]]:
    """Hashes of all runs of 1, 2, 4 ... words, at most ``longest``."""
    out, size = [(1, words)], 1
    while 2 * size <= longest:
        a = out[-1][1]
        keep = max(len(a) - size, 0)
        out.append((2 * size, mix(a[:keep] * _SPREAD + a[size : size + keep] + np.uint64(size))))
        size *= 2
    return out


def slid(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (least or largest) over every stretch of ``width`` values."""
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[: len(values) - (width - size)], values[width - size :])


@dataclass
class Text:
    """Hashed view of one text that has at least one window."""

    levels: list[tuple[int, np.ndarray]]
    runs: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, data: bytes, window: int) -> Text | None:
        words = word_hashes(data)
        if len(words) < window:
            return None
        levels = doubled(words, max(1, (window + 1) // 2))
        gram, runs = levels[-1]
        return cls(levels, runs, slid(runs, window - gram + 1, np.minimum))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes and how often each occurs in the text.

        A run is an anchor when it is the least of some window: when the largest of
        the minima of the windows that hold it is its own hash.
        """
        width = len(self.runs) - len(self.least) + 1
        edge = np.zeros(width - 1, np.uint64)
        highest = slid(np.concatenate([edge, self.least, edge]), width, np.maximum)
        return np.unique(self.runs[highest == self.runs], return_counts=True)

    def signatures(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """96 bits for each window that starts at one of ``at``."""
        gram = self.levels[-1][0]
        one, two = np.full(len(at), np.uint64(window)), np.full(len(at), np.uint64(~window & 0xFFFF))
        for start in [*range(0, window - gram + 1, gram), window - gram]:
            part = self.runs[at + start]
            one = mix(one * _SPREAD + part)
            two = mix(two + part * _SPREAD) * np.uint64(0x9E3779B97F4A7C15)
        return one, (two >> np.uint64(32)).astype(np.uint32)

    def prefixes(self, level: int, at: np.ndarray) -> np.ndarray:
        return mix(self.levels[level][1][at] + np.uint64(level))


def is_in(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(held):
        return np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(held, values), len(held) - 1)
    return held[place] == values


def groups_of(text: Text, at: np.ndarray, signature: np.ndarray, frequent: list[np.ndarray], groups: int) -> np.ndarray:
    """Group of each window: by its shortest prefix that is not too frequent, by all of it when every one is."""
    code, open_ = signature.copy(), np.ones(len(at), bool)
    for level, heavy in enumerate(frequent):
        prefix = text.prefixes(level, at[open_])
        light = ~is_in(prefix, heavy)
        where = np.flatnonzero(open_)
        code[where[light]] = prefix[light]
        open_[where[light]] = False
    return (mix(code) % np.uint64(groups)).astype(np.int64)


def _blobs(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (v.as_py() for v in batch.column("text").cast(pa.binary()))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.unhex(F.md5(text)).alias("key"), text.alias("text"))


# -- variable-length prefixes ------------------------------------------------------------


def frequent_prefixes(docs: DataFrame, window: int, group_windows: int) -> tuple[int, list[np.ndarray]]:
    """Number of groups, and per level the hashes of the prefixes that are too frequent to be one group."""
    texts, known, groups, limit = _texts(docs).select("text"), [], partitions(docs.sparkSession), 0
    level = 0
    while True:
        counts = _prefix_counts(texts, window, level, known).persist()
        try:
            if level == 0:
                total = counts.agg(F.sum("n")).first()[0] or 0
                groups = max(groups, -(-total // group_windows))
                limit = max(FEW, total // (8 * groups))
            rows = counts.filter(F.col("n") > limit).select("prefix").collect()
        finally:
            counts.unpersist()
        if not rows:
            return groups, known
        known.append(np.sort(np.array([r["prefix"] for r in rows], "<i8").view("<u8")))
        level += 1
        if 2**level > max(1, (window + 1) // 2):
            return groups, known


def _prefix_counts(texts: DataFrame, window: int, level: int, known: list[np.ndarray]) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in _blobs(batch):
                text = Text.of(data, window)
                if text is None:
                    continue
                at = np.arange(len(text.least))
                for shorter, heavy in enumerate(known):
                    at = at[is_in(text.prefixes(shorter, at), heavy)]
                found.append(text.prefixes(level, at))
            prefix, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"prefix": prefix.view("<i8"), "n": n.astype("<i8")})

    return texts.mapInArrow(count, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))


# -- anchors -----------------------------------------------------------------------------


def _rows(**columns) -> pa.RecordBatch:
    """Packed rows; columns that are not given are null."""
    size = len(next(iter(columns.values())))
    kinds = {
        "kind": pa.int32(), "part": pa.int32(), "key": pa.binary(), "keys": pa.binary(), "body": pa.binary(),
        "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.int32()),
    }
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(name, [None] * size), kind) for name, kind in kinds.items()], names=list(kinds)
    )


def _split(entries: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    entries, part = entries[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for chunk, first in zip(np.split(entries, cuts), np.concatenate([[0], cuts]), strict=True):
        if len(chunk):
            yield int(part[first]), chunk


def _packed(entries: np.ndarray, part: np.ndarray, keys: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """Entries by part, each with the keys it speaks of."""
    for number, chunk in _split(entries, part):
        used, own = np.unique(chunk["own"], return_inverse=True)
        chunk = chunk.copy()
        chunk["own"] = own
        yield number, b"".join(keys[u] for u in used), chunk.tobytes()


def _several(codes: np.ndarray) -> np.ndarray:
    """For sorted codes: whether the neighbour on either side is the same."""
    same = np.zeros(len(codes) + 1, bool)
    same[1:-1] = codes[1:] == codes[:-1]
    return same[1:] | same[:-1]


def _repeated_anchors(docs: DataFrame, window: int, groups: int) -> DataFrame:
    """key, codes: the anchors of a text that occur at two places or more."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, seen, parts, known = [], set(), [], []
            for key, data in zip(batch.column("key").to_pylist(), _blobs(batch), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                text = Text.of(data, window)
                if text is None:
                    continue
                codes, n = text.anchors()
                entry = np.empty(len(codes), ANCHORS)
                entry["code"], entry["own"] = codes, len(keys)
                parts.append(entry)
                known.append(n > 1)
                keys.append(key)
            if not parts:
                continue
            entries, inside = np.concatenate(parts), np.concatenate(known)
            order = np.argsort(entries["code"], kind="stable")
            entries, inside = entries[order], inside[order]
            inside |= _several(entries["code"])
            settled_ = entries[inside]
            own = np.argsort(settled_["own"], kind="stable")
            if len(own):
                rows = list(_packed(settled_[own], settled_["own"][own], keys))
                yield _rows(kind=[0] * len(rows), part=[0] * len(rows), key=[k for _, k, _ in rows],
                            body=[np.frombuffer(b, ANCHORS)["code"].tobytes() for _, _, b in rows])
            first = np.concatenate([[True], entries["code"][1:] != entries["code"][:-1]])
            entries = entries[first]
            rows = list(_packed(entries, (mix(entries["code"]) % np.uint64(groups)).astype(np.int64), keys))
            yield _rows(kind=[1] * len(rows), part=[p for p, _, _ in rows], keys=[k for _, k, _ in rows],
                        body=[b for _, _, b in rows])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, held in _grouped(batches):
            if kind == 0:
                yield from held.select(["key", "body"]).rename_columns(["key", "codes"]).to_batches()
                continue
            keys, entries = _unpacked(held, ANCHORS)
            entries = entries[np.lexsort((entries["own"], entries["code"]))]
            # One text in several batches is one place.
            new = np.concatenate([[True], (np.diff(entries["own"].astype(np.int64)) != 0) | (entries["code"][1:] != entries["code"][:-1])])
            entries = entries[new]
            entries = entries[_several(entries["code"])]
            entries = entries[np.argsort(entries["own"], kind="stable")]
            rows = list(_split(entries, entries["own"].astype(np.int64)))
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array([keys[k] for k, _ in rows], pa.binary()),
                    "codes": pa.array([e["code"].tobytes() for _, e in rows], pa.binary()),
                }
            )

    sent = _texts(docs).mapInArrow(spread, PACKED)
    # Settled rows need no meeting; they are dealt by key.
    dealt = F.when(F.col("kind") == 0, F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")).otherwise(F.col("part"))
    met = (
        sent.withColumn("part", dealt)
        .repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("kind", "part")
        .mapInArrow(meet, "key binary, codes binary")
    )
    return met.groupBy("key").agg(F.collect_list("codes").alias("codes"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows sorted by kind and part: rows to pass on as they come, rows to meet one part at a time."""
    waiting: list[pa.RecordBatch] = []

    def flush() -> Iterator[tuple[int, pa.Table]]:
        if waiting:
            yield 1, pa.Table.from_batches(waiting)
            waiting.clear()

    for batch in batches:
        kind = batch.column("kind").to_numpy()
        part = batch.column("part").to_numpy()
        cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(part)]]), strict=True):
            if a == b:
                continue
            piece = batch.slice(a, b - a)
            if kind[a] != 1:
                yield from flush()
                yield int(kind[a]), pa.Table.from_batches([piece])
                continue
            if waiting and waiting[0].column("part")[0].as_py() != part[a]:
                yield from flush()
            waiting.append(piece)
    yield from flush()


def _unpacked(held: pa.Table, kind: np.dtype) -> tuple[list[bytes], np.ndarray]:
    """All entries of one part, their own keys numbered through."""
    numbers: dict[bytes, int] = {}
    out = []
    for keys, body in zip(held.column("keys").to_pylist(), held.column("body").to_pylist(), strict=True):
        own = np.array([numbers.setdefault(keys[k : k + 16], len(numbers)) for k in range(0, len(keys), 16)], "<u4")
        entries = np.frombuffer(body, kind).copy()
        entries["own"] = own[entries["own"]]
        out.append(entries)
    return list(numbers), np.concatenate(out)


# -- subtrees ----------------------------------------------------------------------------


def cover(at: np.ndarray, window: int) -> np.ndarray:
    """Start, stop, start, stop ... of the words covered by windows at sorted places; touching ones merge."""
    if not len(at):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], np.diff(at) > window])
    last = np.concatenate([new[1:], [True]])
    return np.stack([at[new], at[last] + window], axis=1).ravel()


def _result(data: bytes, spans: np.ndarray) -> tuple[int, int, str]:
    words = data.split()
    kept, at = [], 0
    for start, stop in spans.reshape(-1, 2):
        kept += words[at:start]
        at = stop
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _suffixes(contents: DataFrame, window: int, groups: int, frequent: list[np.ndarray]) -> DataFrame:
    """Rows of four kinds: 0 finished texts, 1 suffixes by group, 2 texts that wait, 3 places already known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            done, wait, keys, found, parts = [], [], [], [], []
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "packed", "copies", "codes")), strict=True):
                key, packed, copies, codes = row
                data = unpack.decompress(packed) if packed else b""
                whole = copies > 1
                text = Text.of(data, window) if whole or codes else None
                if text is None or not codes:
                    n = len(data.split())
                    spans = np.array([0, n] if whole and text is not None else [], np.int64)
                    done.append((key, *_result(data, spans), spans))
                    continue
                heavy = np.unique(np.frombuffer(b"".join(codes), "<u8"))
                at = np.flatnonzero(is_in(text.least, heavy))
                entry = np.empty(len(at), SUFFIXES)
                entry["code"], entry["more"] = text.signatures(at, window)
                entry["own"], entry["at"] = len(keys), NOWHERE if whole else at
                parts.append(groups_of(text, at, entry["code"], frequent, groups))
                found.append(entry)
                keys.append(key)
                if whole:
                    spans = np.array([0, len(data.split())], np.int64)
                    done.append((key, *_result(data, spans), spans))
                else:
                    wait.append((key, packed))
            if done:
                k, n, r, s, spans = zip(*done, strict=True)
                yield _rows(kind=[0] * len(k), part=home_of(k, groups), key=k, n_words=n, n_removed=r, kept_sha256=s, spans=spans)
            if wait:
                k, packed = zip(*wait, strict=True)
                yield _rows(kind=[2] * len(k), part=home_of(k, groups), key=k, body=packed)
            if not found:
                continue
            entries, part = np.concatenate(found), np.concatenate(parts)
            order = np.lexsort((entries["more"], entries["code"]))
            entries, part = entries[order], part[order]
            new = np.concatenate([[True], (entries["code"][1:] != entries["code"][:-1]) | (entries["more"][1:] != entries["more"][:-1])])
            inside = ~(new & np.concatenate([new[1:], [True]]))
            yield from _places(entries[inside], keys, groups)
            entries, part = entries.copy()[new], part[new]
            entries["at"][inside[new]] = NOWHERE
            rows = list(_packed(entries, part, keys))
            yield _rows(kind=[1] * len(rows), part=[p for p, _, _ in rows], keys=[k for _, k, _ in rows],
                        body=[b for _, _, b in rows])

    return contents.mapInArrow(run, PACKED)


def home_of(keys: Sequence[bytes], groups: int) -> np.ndarray:
    """Where what is known of a text meets; keys are digests, so any of their bytes are spread."""
    return (np.frombuffer(b"".join(k[:8] for k in keys), "<u8") % np.uint64(groups)).astype(np.int32)


def _places(entries: np.ndarray, keys: list[bytes], groups: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows by the home of their text, as kind 3 rows."""
    entries = entries[entries["at"] != NOWHERE]
    if not len(entries):
        return
    found = np.empty(len(entries), PLACES)
    found["own"], found["at"] = entries["own"], entries["at"]
    rows = list(_packed(found, home_of(keys, groups)[found["own"]], keys))
    yield _rows(kind=[3] * len(rows), part=[p for p, _, _ in rows], keys=[k for _, k, _ in rows],
                body=[b for _, _, b in rows])


def _subtrees(groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by signature, a group is its subtrees' leaves in order; equal neighbours are a node at full depth."""
        for kind, held in _grouped(batches):
            if kind != 1:
                yield from held.to_batches()
                continue
            keys, entries = _unpacked(held, SUFFIXES)
            entries = entries[np.lexsort((entries["more"], entries["code"]))]
            same = np.zeros(len(entries) + 1, bool)
            same[1:-1] = (entries["code"][1:] == entries["code"][:-1]) & (entries["more"][1:] == entries["more"][:-1])
            yield from _places(entries[same[1:] | same[:-1]], keys, groups)

    return run


def _finish(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by home, places before the texts they speak of."""
        unpack = zstandard.ZstdDecompressor()
        home, packed, places = None, [], {}
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "key", "keys", "body")), range(batch.num_rows), strict=True):
                part, kind, key, keys, body, at = row
                if part != home:
                    home, packed, places = part, [], {}
                if kind == 3:
                    packed.append({"keys": keys, "body": body})
                elif kind == 2:
                    if packed:
                        places, packed = _by_text(packed), []
                    spans = cover(places.get(key, np.zeros(0, np.int64)), window)
                    out.append((key, *_result(unpack.decompress(body), spans), spans))
                else:
                    out.append((key, *(batch.column(c)[at].as_py() for c in ("n_words", "n_removed", "kept_sha256", "spans"))))
            k, n, r, digest, spans = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(k, pa.binary()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(digest, pa.string()),
                 pa.array(spans, pa.list_(pa.int32()))],
                names=["key", "n_words", "n_removed", "kept_sha256", "spans"],
            )

    return run


def _by_text(packed: list[dict]) -> dict[bytes, np.ndarray]:
    """Sorted distinct places of each text."""
    keys, entries = _unpacked(pa.Table.from_pylist(packed), PLACES)
    entries = entries[np.lexsort((entries["at"], entries["own"]))]
    return {keys[own]: np.unique(e["at"]).astype(np.int64) for own, e in _split(entries, entries["own"].astype(np.int64))}


def repeats(
    docs: DataFrame, *, window: int = WINDOW, group_windows: int = GROUP_WINDOWS
) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, kept_sha256 and the repeated spans.

    ``spans`` holds start, stop, start, stop ... in words, stops exclusive: the maximal
    stretches covered by repeated windows. ``kept_sha256`` is of the other words,
    joined by one blank.
    """
    spark = docs.sparkSession
    groups, frequent = frequent_prefixes(docs, window, group_windows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_pydict(
                {"key": batch.column("key"), "packed": pa.array([tool.compress(t) for t in _blobs(batch)], pa.binary())}
            )

    contents = (
        _texts(docs).mapInArrow(pack, "key binary, packed binary")
        .groupBy("key").agg(F.first("packed").alias("packed"), F.count(F.lit(1)).alias("copies"))
        .join(_repeated_anchors(docs, window, groups), "key", "left")
    )
    count = partitions(spark)
    met = (
        _suffixes(contents, window, groups, frequent)
        .repartition(count, "part").sortWithinPartitions("kind", "part")
        .mapInArrow(_subtrees(groups), PACKED)
    )
    judged = (
        met.repartition(count, "part").sortWithinPartitions("part", F.col("kind").desc())
        .mapInArrow(_finish(window), "key binary, n_words long, n_removed long, kept_sha256 string, spans array<int>")
    )
    named = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    return named.join(judged, "key").select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")


def without(words: Column, spans: Column) -> Column:
    """The words outside the spans, joined by one blank."""

    def inside(i: Column) -> Column:
        # Past the last span the bounds are null, which is outside.
        pairs = F.sequence(F.lit(0), F.floor(F.size(spans) / 2).cast("int"))
        held = F.exists(pairs, lambda k: (F.get(spans, 2 * k) <= i) & (i < F.get(spans, 2 * k + 1)))
        return F.coalesce(held, F.lit(False))

    return F.array_join(F.filter(words, lambda _, i: ~inside(i)), " ")
