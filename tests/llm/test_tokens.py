import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.corpus import ROWS, by_key, documents
from tidemark.llm import perfect_hash, token_shards
from tidemark.llm.pretokens import LONGEST_PIECE, encoder, vocabulary_path
from tidemark.llm.token_counts import token_counts

TEXTS = [
    "", "a  b", "Don't STOP!'s 3²4¼ ªº", "İstanbul", "naïve é", "<|endoftext|> a", "x y\u0085z", "中文 字", "'''s",
    "ß ẞ ſ ŉ ǆ", "\x1ca b\x1f", "co‑op … — ‘x’ “y” • € ™ ½", "I'LL we've 'tis", "a b c", "Ω ΑΣ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def test_pieces_give_the_library_ids(library):
    own, rng = encoder(vocabulary_path()), random.Random(5)
    letters = "aeiourstlnA'.,!?0123 \t\néüß²<|>́中"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.count(text) == len(ids)
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == ids


def test_tables_keep_no_long_pieces(library):
    own, rng = encoder(vocabulary_path()), random.Random(6)
    for text in ["".join(rng.choice("abc0'.,") for _ in range(5_000)), "k" * 300 + " " + "=" * 200, "a" * 64 + " " + "a" * 65]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.count(text) == len(ids)
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == ids
    assert max(map(len, own.counts)) == max(map(len, own.ids)) == LONGEST_PIECE


def test_other_tokenizers_go_through_their_libraries(spark):
    docs = documents(spark)
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        own = encoder(vocabulary_path(name))
        rows = by_key(token_counts(docs, vocabulary_path(name)), "n_tokens")
        assert rows[1] == own.count(ROWS[0][1]) and rows[2] == rows[3] == 0


def test_counts_of_awkward_rows(spark, library):
    found = token_counts(documents(spark), vocabulary_path()).collect()
    known = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in found)
    expected = []
    for key, text, _, _ in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected.append((key or -1, len((text or "").encode()), n, n > 2048))
    assert known == sorted(expected)
    assert token_counts(documents(spark, []), vocabulary_path()).count() == 0


def test_perfect_hash_is_perfect_and_refuses_strangers():
    for n in (0, 1, 2, 5, 100, 5000):
        keys = np.random.default_rng(n).choice(10**12, n, replace=False).astype(np.uint64)
        moves, place = perfect_hash.build(keys)
        marks = perfect_hash.fingerprints(keys)[place]
        slots = perfect_hash.look_up(keys, moves, marks)
        assert sorted(place.tolist()) == list(range(n))
        assert (place[slots] == np.arange(n)).all()
        assert (perfect_hash.look_up(keys + np.uint64(10**13), moves, marks) < 0).all()


def test_shards_give_back_what_was_written(spark, tmp_path, monkeypatch, library):
    monkeypatch.setattr(token_shards, "SHARD_DOCS", 4)
    path = f"{tmp_path}/shards"
    token_shards.write_shards(documents(spark), path, vocabulary_path())
    found = token_shards.read_index(spark, path).collect()
    ids = {}
    for key, text, _, _ in ROWS:
        ids.setdefault(key, []).append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    sums = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    expected = sorted((k or -1, len(x), sums(x)) for k, own in ids.items() for x in own)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in found) == expected
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    assert [r.doc_id for r in ordered] == sorted((r[0] for r in ROWS), key=lambda k: -1 if k is None else k)
    asked = token_shards.look_up(spark, path, [7, 9, 555, -3]).collect()
    assert sorted((r.doc_id, r.ids) for r in asked) == sorted((k, x) for k in (7, 9) for x in ids[k])
    assert token_shards.look_up(spark, path, []).count() == 0
    assert token_shards.shard_documents(documents(spark, []), vocabulary_path(), f"{tmp_path}/none").count() == 0
