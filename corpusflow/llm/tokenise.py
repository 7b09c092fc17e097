"""Whole texts to token ids, piece by piece with a memory of pieces already seen.

A tokenizer of the ``tokenizers`` library splits a text before it merges, so the
ids of a text are the ids of its pieces in a row, as long as the text is cut
where the tokenizer itself always cuts. Two such cuts are known here, each for
the pre-tokenizer it holds for; every other tokenizer, and every text that
contains an added token or unusual white space, is encoded whole. Equality with
whole encoding is tested.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import sys
from array import array
from collections.abc import Iterable

import pyarrow as pa

#: Bytes of pieces remembered per process, in two generations of this size each.
REMEMBERED = 64 << 20
# What a piece and its ids take besides their characters and ids: two objects and two places in a dict.
EACH = 190
#: Longer pieces are encoded each time.
LONGEST = 256
# White space other than blank, tab, line feed and carriage return.
UNUSUAL = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
# Cuts before a blank that leads a word; runs of blanks end before it.
LED = re.compile(r" ?[^ \n\t\r]+|[ \n\t\r]+(?![^ \n\t\r])|[ \n\t\r]+")


# A plain word, and what may follow it; the pre-tokenizers below always cut between letters and signs.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Remembered runs of signs; others are encoded each time.
TAILS = 4_096
# How byte-level vocabularies spell bytes: printable ones as themselves, the others in order from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELT = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def process_store(name: str) -> dict:
    """A dict that lives as long as this Python process, across tasks of one worker.

    The package's code travels with each task, so its own module variables do not.
    """
    return sys.__dict__.setdefault("_corpusflow_store", {}).setdefault(name, {})


class Encoder:
    """Token ids of whole texts as the tokenizer gives them, without special tokens added."""

    def __init__(self, definition: str, digest: str, remembered: int | None = None) -> None:
        # Tasks are the parallelism; threads inside one would wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.new, self.old = process_store(f"new-{digest}"), process_store(f"old-{digest}")
        self.held = self._size(self.new)
        self.remembered = REMEMBERED if remembered is None else remembered
        rules = json.loads(definition)
        self.added = [t["content"] for t in rules.get("added_tokens") or []]
        plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in rules.get("added_tokens") or [])
        self.tails: dict[str, bytes] = {}
        self.lower = False
        self.cut = self._cut(rules) if plain else None
        bare = rules.get("model", {}).get("type") == "BPE" and not rules["model"].get("dropout")
        self.model = self.tokenizer.model if self.cut and bare else None

    def _cut(self, rules: dict):
        before, change = rules.get("pre_tokenizer") or {}, rules.get("normalizer") or {}
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        if byte_level and not change:
            return LED.findall
        steps = [s.get("type") for s in change.get("normalizers", [])] if change.get("type") == "Sequence" else []
        parts = before.get("pretokenizers", []) if before.get("type") == "Sequence" else []
        drops_blanks = (
            len(parts) == 2
            and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert")
            and not re.search(r"\\s\+|\\s\*| ", parts[0]["pattern"].get("Regex", " "))
            and parts[1].get("type") == "ByteLevel" and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space")
        )
        if drops_blanks and steps == ["NFC", "Replace", "Lowercase"]:
            self.lower = True
            return str.split
        return None

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            text = text or ""
            if self.cut is None or UNUSUAL.search(text) or any(a in text for a in self.added):
                out.append(array("I", self.whole([text])[0]).tobytes())
                continue
            parts = self.cut(text)
            found = list(map(self.new.get, parts))
            if None in found:
                # What this text needs stays in ``learnt``, also where a generation ends in between.
                learnt = self._learn({p for p, ids in zip(parts, found, strict=True) if ids is None})
                found = [learnt[p] if ids is None else ids for p, ids in zip(parts, found, strict=True)]
            out.append(b"".join(found))
        return out

    @staticmethod
    def _size(pieces: dict[str, bytes]) -> int:
        return EACH * len(pieces) + sum(map(len, pieces)) + sum(map(len, pieces.values()))

    def _keep(self, learnt: dict[str, bytes]) -> None:
        """Remembers pieces; when the newer generation is full it becomes the older one, which goes."""
        if max(map(len, learnt)) > LONGEST:
            learnt = {p: ids for p, ids in learnt.items() if len(p) <= LONGEST}
        size = self._size(learnt)
        if size > self.remembered:
            return
        if self.held + size > self.remembered:
            self.new, self.old, self.held = self.old, self.new, 0
            self.new.clear()
        self.new.update(learnt)
        self.held += size

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the newer generation lacks: from the older one, or encoded."""
        learnt, rest, old = {}, [], self.old.get
        for part in missing:
            ids = old(part)
            if ids is None and self.model:
                ids = self._plain(part)
            if ids is None:
                rest.append(part)
            else:
                learnt[part] = ids
        for part, ids in zip(rest, self.whole(rest), strict=True):
            learnt[part] = array("I", ids).tobytes()
        self._keep(learnt)
        return learnt

    def _plain(self, part: str) -> bytes | None:
        """Ids of a plain word and the signs behind it; None for any other piece."""
        word = part.rstrip(SIGNS)
        bare = word[1:] if word[:1] == " " else word
        if not (bare.isalpha() and bare.isascii() or LATIN.fullmatch(bare)):
            return None
        return self._word(word) if len(word) == len(part) else self._word(word) + self._tail(part[len(word) :])

    def _word(self, word: str) -> bytes:
        """Ids of a plain word straight from the merges, spelt as the pre-tokenizer would hand it over."""
        spelt = word.lower() if self.lower else word
        known = self.new.get(word) or self.old.get(word) or self.new.get(spelt) or self.old.get(spelt)
        if known:
            return known
        if not spelt.isascii():
            spelt = spelt.encode().decode("latin-1").translate(SPELT)
        elif spelt[0] == " ":
            spelt = chr(SPELT[32]) + spelt[1:]
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _tail(self, tail: str) -> bytes:
        ids = self.tails.get(tail)
        if ids is None:
            ids = array("I", self.whole([tail])[0]).tobytes()
            if len(tail) <= 4 and len(self.tails) < TAILS:
                self.tails[tail] = ids
        return ids


def encoder(definition: str, digest: str, remembered: int | None = None) -> Encoder:
    """One encoder per process and tokenizer; ``remembered`` bytes of pieces a generation, the module's bound by default."""
    held = process_store("encoders")
    if digest not in held or remembered not in (None, held[digest].remembered):
        # What another tokenizer, or another bound, left behind goes with it.
        sys.__dict__["_corpusflow_store"] = {"encoders": held}
        held.clear()
        held[digest] = Encoder(definition, digest, remembered)
    return held[digest]


def forget() -> None:
    """Drops encoders and pieces of this process and hands freed memory back to the machine."""
    sys.__dict__.pop("_corpusflow_store", None)
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
