from __future__ import annotations

from corpusflow.llm import tokenise
from array import array
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusflow.llm import token_counts, token_files
from corpusflow.llm.common import shared_folder
from corpusflow.llm.elias_fano import EliasFano
from corpusflow.llm.tokenise import Encoder
from tests.llm.cases import SCHEMA, awkward, prose, table

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
BITS = [
    "a", "b's", "'s", "'", "É", "é", "́", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\xa0", " ",
    "<|endoftext|>", "<|startoftext|>", "<|", "İ", "ß", "ΑΣ", "12", "...", "日本", "\x1c", "\x85", "​", "🙂", "don't", "ﬁ", "﻿",
]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_ids_of_whole_texts(path, monkeypatch):
    monkeypatch.setattr("corpusflow.llm.tokenise.REMEMBERED", 500)  # generations change many times
    rng = random.Random(1)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + [None, ""]
    texts += [prose(rng, rng.randint(0, 300)) for _ in range(50)]
    known = Encoder(Path(path).read_text(), f"test-{path}")
    assert known.cut is not None
    plain = Tokenizer.from_file(path)
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert known.encode(texts) == want


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_signs_behind_words_are_cut_off_and_learnt_once(path, monkeypatch):
    rng = random.Random(3)
    signs = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    words = ["".join(rng.choice("abcdeÉßñ") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    text = " ".join(w + "".join(rng.choice(signs) for _ in range(rng.randint(0, 6))) for w in words)
    known = Encoder(Path(path).read_text(), f"signs-{path}")
    assert known.encode([text])[0] == array("I", known.whole([text])[0]).tobytes()
    sent, whole = [], known.whole
    monkeypatch.setattr(known, "whole", lambda texts: sent.extend(texts) or whole(texts))
    known.encode([" ".join(f"{w}x***" for w in words)])
    assert len([t for t in sent if any(c.isalpha() for c in t)]) <= 1  # a first word without its blank


def test_elias_fano_gives_back_every_value():
    rng = np.random.default_rng(1)
    for n, gap in ((0, 1), (1, 1), (1, 10**9), (5000, 1), (5000, 2), (5000, 700), (3000, 10**6), (2000, 3)):
        values = np.cumsum(rng.integers(0, gap, n, endpoint=True))
        code = EliasFano.encode(values)
        again = EliasFano.decode(code.n, code.width, *code.sections())
        assert again.slice(0, n).tolist() == values.tolist()
        for i in range(0, n, 97):
            assert again.select(i) == values[i]
            assert again.slice(i, min(n, i + 300)).tolist() == values[i : i + 300].tolist()
        if n > 1000:
            assert sum(map(len, code.sections())) * 8 < n * (2.5 + np.log2(max(values[-1] / n, 1) + 1) + 1)


def test_files_hold_the_ids_in_order(spark):
    rows = awkward(random.Random(2))
    files, manifest = token_files.write(table(spark, rows), WORD, files=3)
    got = sorted(
        ((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read(spark, manifest).collect())
    )
    plain = Tokenizer.from_file(WORD)
    ids = [plain.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows]
    want = sorted((r[0] is not None, r[0] or 0, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, ids, strict=True))
    assert [g[0] for g in got] == [sum(g[2] for g in got[:k]) for k in range(len(got))]
    assert [g[1] for g in got] == [w[1] if w[0] else None for w in want]
    assert sorted((g[1] is not None, g[1] or 0, *g[2:]) for g in got) == want
    # Random access without reading a table of offsets.
    for row in spark.read.parquet(manifest).collect():
        held = token_files.TokenFile(row["path"])
        bounds = held.bounds(0, held.documents)
        for k in range(held.documents):
            start, stop = held.ends.select(k - 1) if k else 0, held.ends.select(k)
            assert (start, stop) == (bounds[k], bounds[k + 1]) and held.tokens(start, stop)[-1] == 1
        held.close()


def test_counts_come_from_the_cache(spark):
    rows = awkward(random.Random(3))
    cache = shared_folder(spark, "cache")
    plain = Tokenizer.from_file(BYTE)
    want = sorted(
        (str(r[0]), len((r[1] or "").encode()), len(plain.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows
    )

    def count(some, path=BYTE):
        return sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(table(spark, some), path, cache).collect())

    assert count(rows) == want
    first = spark.read.parquet(cache).count()
    assert first == len({r[1] or "" for r in rows})
    assert count(rows) == want and spark.read.parquet(cache).count() == first
    more = [*rows, (99, "a new text", None, None, None, 0, "", "", "")]
    assert len(count(more)) == len(more) and spark.read.parquet(cache).count() == first + 1
    # Another tokenizer has its own counts.
    assert count(rows, WORD) != want and spark.read.parquet(cache).count() == 2 * first + 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_files.write_and_read(empty, WORD).count() == 0
    assert token_counts.count_tokens(empty, BYTE, shared_folder(spark, "cache")).count() == 0


def test_the_memory_of_pieces_stays_below_its_bound(monkeypatch):
    """Over two tokenizers, many short and some very long words; ids stay those of whole encoding."""
    monkeypatch.setattr(tokenise, "REMEMBERED", 200_000)
    rng = random.Random(5)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        definition = Path(public_tokenizers.path(name)).read_text(encoding="utf-8")
        known = tokenise.encoder(definition, f"bounded-{name}")
        for turn in range(30):
            text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 9, 400 if turn % 5 == 0 else 5]))) for _ in range(300))
            assert known.encode([text])[0] == array("I", known.whole([text])[0]).tobytes()
            for held in (known.new, known.old):
                assert known._size(held) <= 200_000 and max(map(len, held), default=0) <= tokenise.LONGEST
        assert known.old


def test_a_stage_bounds_its_pieces_and_drops_them(spark, tmp_path):
    """A bound of the caller's holds, what is forgotten is learnt anew, and the files stay the same."""
    definition = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
    known = tokenise.encoder(definition, "own-bound", 5_000)
    text = " ".join(f"word{i}" for i in range(2_000))
    before = known.encode([text])[0]
    assert known.remembered == 5_000 and known._size(known.new) <= 5_000
    assert tokenise.encoder(definition, "own-bound") is known and tokenise.encoder(definition, "own-bound", 9_000) is not known
    tokenise.forget()
    again = tokenise.encoder(definition, "own-bound", 5_000)
    assert again is not known and not again.new and again.encode([text])[0] == before
    docs = spark.createDataFrame([(i, f"word{i % 7} " * (i % 50)) for i in range(300)], "doc_id bigint, text string")
    plain, bounded = token_files.write_and_read(docs, WORD), token_files.write_and_read(docs, WORD, remembered=2_000)
    assert sorted(plain.collect()) == sorted(bounded.collect())
