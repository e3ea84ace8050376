import numpy as np
import pytest

from duecheck.llm import queries, token_counts

ODD = [None, "", " ", "  two  spaces ", "a\n b \n\nc", "don't they'll", "<|endoftext|>", "é🙂 ü x", "x" * 5000, "tab\t x", "end "]
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def encoder():
    return token_counts.FlatEncoder(token_counts.read_ranks())


def test_word_by_word_is_exact(spark, encoder):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts:
        assert encoder.encode(t or "") == encoder.plain(t or "")


def test_pattern_is_the_public_one():
    import public_tokenizers

    encoder = token_counts.FlatEncoder(token_counts.read_ranks())
    other = token_counts.tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_counts.read_ranks(), special_tokens={}
    )
    for t in ODD:
        assert encoder.encoding.encode_ordinary(t or "") == other.encode_ordinary(t or "")


def test_query_against_plain_encoding(spark, encoder, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 1 << 12)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.queries()["op10_token_counts"](spark, SMALL).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {
        i: len(encoder.encoding.encode_ordinary(t or "")) for i, t in texts.items()
    }
    assert len(rows) == len(texts)


def test_odd_rows(spark, encoder):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(None, "a b", 1), (3, "a b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bytes int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in token_counts.document_tokens(docs).collect())
    assert got == sorted((i is None, i or 0, len(encoder.plain(t or "")) // 2) for i, t, _ in rows)
    assert token_counts.document_tokens(docs.limit(0)).collect() == []


def test_blocks_of_every_kind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 8)
    rng, files, wanted = np.random.default_rng(1), [], {}
    for n in range(12):
        tokens = rng.choice([7, 8, 50256], int(rng.integers(0, 60)), p=[0.45, 0.45, 0.1])
        path = str(tmp_path / f"{n}.tokens")
        tokens.astype("<u2").tofile(path)
        files.append((path, 2 * len(tokens)))
        text = "".join("|" if t == 50256 else "x" for t in tokens)
        parts = text.split("|")
        for i, p in enumerate(parts if parts[-1] else parts[:-1]):
            wanted[path, i] = len(p)
    df = spark.createDataFrame(files, "file string, bytes long")
    got = token_counts.count_tokens(df).collect()
    assert {(r.file, r.ordinal): r.n_tokens for r in got} == wanted and len(got) == len(wanted)


def test_cut_token_is_an_error(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    df = spark.createDataFrame([(str(tmp_path / "x"), 3)], "file string, bytes long")
    with pytest.raises(Exception, match="cut off"):
        token_counts.count_tokens(df).collect()
