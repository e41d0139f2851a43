import numpy as np
import pytest
from llm_brute import sha

from brindle.llm import bpe
from brindle.llm.token_count import default_tokenizer, token_counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=repr)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_encoding_matches_the_library(docs, texts, library):
    assert rows_of(bpe.encoded(docs, digests=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected(library, texts.items())


def test_encoding_odd(odd, empty, library):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert rows_of(bpe.encoded(odd, digests=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected(library, rows)
    assert bpe.encoded(empty).count() == 0


def test_round_trip(docs, texts):
    back = bpe.decoded(bpe.encoded(docs))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == texts


def test_lexicon_is_minimal_and_exact():
    words = sorted([b"cat", b"cats", b"rat", b"rats", b"car", b"bar"])
    ids, counts = np.arange(12), np.full(6, 2)
    lex = bpe.build_lexicon(words, ids, counts)
    assert len(lex["accepts"]) < sum(map(len, words)) and list(lex["place"]) == [0, 2, 4, 6, 8, 10, 12]
    raw = b"".join(words) + b"catx" + b"\0" * 8
    ends = np.cumsum([*map(len, words), 4])
    starts = ends - np.array([*map(len, words), 4])
    machine = bpe.Lexicon.__new__(bpe.Lexicon)
    for k, v in lex.items():
        setattr(machine, k, v)
    assert list(machine.find(np.frombuffer(raw, np.uint8), starts, ends)) == [0, 1, 2, 3, 4, 5, -1]


def test_counts_match_the_library(spark, docs, odd, empty, texts, library):
    want = sorted(((i, len((t or "").encode()), n, n > 512) for (i, t), (_, n) in ((x, (x[0], len(library.encode(x[1] or "", add_special_tokens=False).ids))) for x in texts.items())), key=repr)
    assert rows_of(token_counts(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)
    assert rows_of(token_counts(odd), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts(empty).count() == 0


def test_pretokens_of_random_texts(spark, library):
    rng = np.random.default_rng(3)
    alphabet = list("ab 'stmdrevl \n\t  é½1٣中😀<|>_-.") + ["<|endoftext|>", "'re", "'ll", "  "]
    rows = [(i, "".join(rng.choice(alphabet, rng.integers(0, 60)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(bpe.encoded(df, digests=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected(library, rows)
    assert rows_of(token_counts(df), "doc_id", "n_tokens") == [(i, n) for i, n, _, _ in sorted(expected(library, rows), key=lambda r: repr((r[0], r[1])))]
