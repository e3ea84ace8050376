import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from duecheck.llm import queries, sentencepiece_nbest
from duecheck.llm.sentencepiece_nbest import MODEL, SPACE, Lattice, Vocabulary, decode_ids

SMALL = "/root/testdata/sf0.01"
ODD = [
    None, "", " ", "  a  b ", "hello world", "x\ny\n\n z", "▁ literal▁mark", "🙂 ☃ \u0000 é", "a" * 300, "<s> </s> <0x41>",
    "word " * 30_000, "Ünï çødé", "tab\tsep",
]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read()


def every(vocabulary, marked):
    """All segmentations by plain recursion."""
    if not marked:
        return [(0.0, ())]
    out = []
    for end in range(1, len(marked) + 1):
        piece = vocabulary.pieces.get(marked[:end])
        if piece is not None:
            head = (piece[1], (piece[0],))
        elif end == 1:
            head = (vocabulary.unknown, tuple(vocabulary.byte_ids[b] for b in marked[0].replace(SPACE, " ").encode()))
        else:
            continue
        out += [(head[0] + s, head[1] + ids) for s, ids in every(vocabulary, marked[end:])]
    return out


@settings(max_examples=60, deadline=None)
@given(text=st.text("the anor. ☃", min_size=1, max_size=9), n=st.integers(1, 6))
def test_against_all_segmentations(vocabulary, text, n):
    wanted = sorted((-s for s, _ in every(vocabulary, SPACE + text.replace(" ", SPACE))))[:n]
    got = Lattice(vocabulary, n).encode(text)
    assert np.allclose([-s for s, _ in got], wanted)
    assert len({ids for _, ids in got}) == len(got)
    scored = dict((ids, s) for s, ids in every(vocabulary, SPACE + text.replace(" ", SPACE)))
    for score, ids in got:
        ids = tuple(np.frombuffer(ids, "<i4").tolist())
        assert np.isclose(scored[ids], score) and decode_ids(vocabulary, ids) == text


def test_decoding_agrees_with_the_library(spark, vocabulary):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [t for t in ODD if t] + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()]
    for t in texts:
        ids = model.encode(t)
        assert decode_ids(vocabulary, ids) == model.decode(ids)


def test_round_trip_of_all_segmentations(spark, vocabulary):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(None, "a b", 1), (1, "a b", 1), (1, "a b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sentencepiece_nbest.encode(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        scores = [s.score for s in r.segmentations]
        assert scores == sorted(scores, reverse=True) and 1 <= len(scores) <= 3
        assert all(decode_ids(vocabulary, s.ids) == (r.text or "") for s in r.segmentations)
    assert sentencepiece_nbest.encode(docs.limit(0)).collect() == []


def test_query_on_whole_table(spark, vocabulary):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.queries()["op3_sentencepiece"](spark, SMALL).collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    lattice = Lattice(vocabulary)
    for r in rows[:100]:
        whole = lattice.solve(SPACE + texts[r.doc_id][:400].replace(" ", SPACE), 3)
        short = lattice.encode(texts[r.doc_id][:400])
        assert np.allclose([s for s, _ in whole], [s for s, _ in short])
        assert decode_ids(vocabulary, r.ids) == texts[r.doc_id] and len(r.ids) == r.n_pieces


def test_decoding_whole_arrays(spark, vocabulary):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [t for t in ODD if t] + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(30).collect()]
    lists = [model.encode(t) for t in texts] + [[], [5], [vocabulary.byte_ids[0xC3]], [1, 2], [vocabulary.byte_ids[32]]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lists, None])], "i int, ids array<int>")
    got = [r.decoded for r in sentencepiece_nbest.decode(df, "ids").orderBy("i").collect()]
    assert got == [decode_ids(vocabulary, x) for x in lists] + [None]


def test_round_trip_is_told(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sentencepiece_nbest.encode(docs, round_trip="back", without=["text"])
    assert got.columns == ["doc_id", "segmentations", "back"] and all(r.back for r in got.collect())
    held = sentencepiece_nbest.pa.array(["ab", "a", None, ""])
    data = np.frombuffer(b"abb", np.uint8)
    assert sentencepiece_nbest._same(data, np.array([0, 2, 3, 3]), np.array([2, 3, 3, 3]), held).tolist() == [True, False, True, True]


def test_decode_frames(spark):
    df = spark.createDataFrame([([1, 2],), ([],), (None,)], "ids array<int>")
    assert [r.decoded for r in sentencepiece_nbest.decode(df, "ids").collect()] == ["", "", None]


def test_words_of_many_lengths_are_solved_in_few_arrays(vocabulary, monkeypatch):
    letters = "internationalisation☃ofthequickerbrown\u0000étude"
    words = {letters[i : i + size] for size in range(1, 45) for i in range(0, len(letters) - size + 1, 3)}
    calls, solve = [], Lattice._solve_together
    monkeypatch.setattr(Lattice, "_solve_together", lambda self, *a: (calls.append(len(a[0])), solve(self, *a))[1])
    lattice, plain = Lattice(vocabulary), Lattice(vocabulary)
    lattice._learn(words)
    assert len(calls) <= 9 and sum(calls) == len([w for w in words if len(w) < 40])
    for w in words:
        ids, score, gap, marked = lattice.words[w]
        wanted = plain._word(SPACE + w)
        assert marked == wanted[3] and np.allclose([score, gap], wanted[1:3])
        assert ids == wanted[0] or gap < 1e-9
