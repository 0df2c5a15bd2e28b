import json
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tagweave.llm import bpe, token_files
from tagweave.llm.queries import VOCABULARY
from tests.llm.brute import digest

ODD = [
    None, "", " \n ", "a", "I'm don't they'll x's 's", "<|startoftext|>Hello<|endoftext|>x <|ENDOFTEXT|>", "ΑΣ Σ ΣΑΣ. İstanbul ẞ", "x\x1cy \x1d z\xa0q w​v",
    "é ́a Å ﬁ ½ ٣4 12,3.4%", "日本語テスト 🙂🙂 🏳️‍🌈", "a" * 3000, "!" * 999, "\u0085x", "word " * 20_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def drawn(seed: int) -> list[str]:
    rng = random.Random(seed)
    near = lambda: rng.choice("aeiouthns' \n\t.!<|>ÄßéΣ1३\x1cć日")
    far = lambda: chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0x3000), rng.randrange(0xA000, 0xD7FF), rng.randrange(0x1F300, 0x1FAFF)]))
    return ["".join(rng.choice((near, far))() for _ in range(rng.randint(1, 40))) for _ in range(1500)]


def test_pieces_equal_the_library(library):
    texts = [t or "" for t in ODD] + drawn(1)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ours, theirs = bpe.backtracking_pieces(VOCABULARY), bpe.library_pieces(VOCABULARY)
    table = bpe.OffsetTable(VOCABULARY)
    for text, ids in zip(texts, want):
        assert np.frombuffer(ours.text(text), "<u4").tolist() == ids
        assert np.frombuffer(theirs.text(text), "<u4").tolist() == ids
        assert table(np.array(ids, "<u4"), 7).decode() == library.decode(ids, skip_special_tokens=False)


def test_backtracking_alone_equals_the_library(library):
    """Without the short way for words whose longest matches all stand."""
    encode = bpe.backtracking_pieces(VOCABULARY).encode
    word_ids = next(c.cell_contents for c in encode.__closure__ if isinstance(c.cell_contents, bpe.WordEncoder))
    rng = random.Random(2)
    for _ in range(1500):
        word = "".join(rng.choice("theingraouslyd") for _ in range(rng.randint(1, 24)))
        assert word_ids.backtrack(word, word + bpe.MARK) == library.encode(word, add_special_tokens=False).ids == word_ids(word)


def test_a_small_table_of_pieces_changes_nothing(library, monkeypatch):
    pieces = bpe.Pieces(lambda piece: library.encode(piece, add_special_tokens=False).ids, {})
    monkeypatch.setattr(bpe, "KEPT_PIECES", 5)
    for text in drawn(3)[:100]:
        assert np.frombuffer(pieces.text(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(pieces) <= 5


def test_operator(spark, library):
    given = [(i if i else None, t) for i, t in enumerate(ODD)] + [(4, ODD[4])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in given], "doc_id long, text string, ids string, decoded int").repartition(3)
    got = bpe.digests(bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)).collect()
    want = []
    for i, t in given:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids, skip_special_tokens=False).encode())))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, bpe.digests(bpe.round_trip(docs, VOCABULARY)).collect()), key=key) == sorted(want, key=key)
    assert bpe.round_trip(docs.limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("id_type", ["<u2", "<u4"])
def test_files(spark, library, id_type):
    given = [(100 - i if i else None, t) for i, t in enumerate(ODD)] + [(96, "again")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in given], "doc_id long, text string, start int").repartition(3)
    got = token_files.tokens_on_disk(docs, lambda: bpe.library_pieces(VOCABULARY), id_type=id_type).collect()
    want, start = [], 0
    for i, t in sorted(given, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.tokens_on_disk(docs.limit(0), lambda: bpe.library_pieces(VOCABULARY)).count() == 0


def test_words_are_cut_without_the_vocabulary_as_with_it():
    with open(VOCABULARY, encoding="utf-8") as f:
        normalizer, pre_tokenizer = bpe._cutters(json.load(f))
    library = Tokenizer.from_file(VOCABULARY)
    for text in ("Plain words, here.", "Ein \u00dcbel\u2014\u0130\u03a3 \u8a9e\u8a9e x1 <|end|>", "e\u0301 \ufb01 \u00a0 tab\tand\nline", ""):
        own = normalizer.normalize_str(text)
        assert own == library.normalizer.normalize_str(text)
        assert pre_tokenizer.pre_tokenize_str(own) == library.pre_tokenizer.pre_tokenize_str(own)


def test_a_worker_keeps_and_holds_few_texts_and_units():
    steps = []
    pieces = bpe.backtracking_pieces(VOCABULARY)
    assert 2 * (bpe.KEPT_PIECES // pieces.share) <= 100_000  # 300,000 units and steps of 1,000 texts before
    plain = type(pieces).batch
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1_200)), "text": pa.array(["ein Wort"] * 1_200)})

    class Watched:
        def batch(self, texts):
            steps.append(len(texts))
            return plain(pieces, texts)

    held = bpe.backtracking_pieces
    frame = SimpleNamespace(mapInArrow=lambda run, schema: run)
    try:
        bpe.backtracking_pieces = lambda path: Watched()
        made = list(bpe._in_tasks(frame, VOCABULARY, True, True)([rows]))
    finally:
        bpe.backtracking_pieces = held
    assert steps == [500, 500, 200] and sum(b.num_rows for b in made) == 1_200
