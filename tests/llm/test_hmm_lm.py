import math
import os
import re
import tracemalloc
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from duecheck.llm import hmm_lm, queries
from duecheck.sources.tables import noted

SMALL = "/root/testdata/sf0.01"


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def small_model(states=3, seed=1):
    rng = np.random.default_rng(seed)
    share = rng.random(hmm_lm.KINDS)
    return hmm_lm.Hmm(
        rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(share, states).T + 1e-9
    )


def all_paths(model, seq):
    """Probability and expected counts by summing over every path of states."""
    states = len(model.start)
    total, first, move = 0.0, np.zeros(states), np.zeros((states, states))
    for path in product(range(states), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for a, b, x in zip(path, path[1:], seq[1:]):
            p *= model.move[a, b] * model.emit[x, b]
        total += p
        first[path[0]] += p
        for a, b in zip(path, path[1:]):
            move[a, b] += p
    return total, first / total, move / total


def test_forward_and_baum_welch_against_all_paths():
    model, rng = small_model(), np.random.default_rng(2)
    seqs = [rng.integers(0, 50, n) for n in (1, 2, 5, 6, 3)]
    flat, sizes = np.concatenate(seqs), np.array([len(s) for s in seqs])
    wanted = [all_paths(model, s) for s in seqs]
    for chunk in (1, 2, 4, 100):
        assert np.allclose(hmm_lm.log_likelihoods(model, flat, sizes, chunk), [math.log(w[0]) for w in wanted])
    first, move, emit, logs = hmm_lm.expected_counts(model, flat, np.cumsum(sizes) - sizes, sizes)
    assert np.allclose(first, sum(w[1] for w in wanted)) and np.allclose(move, sum(w[2] for w in wanted))
    assert np.isclose(logs, sum(math.log(w[0]) for w in wanted))
    assert np.allclose(emit.sum(1), np.bincount(flat, minlength=hmm_lm.KINDS))


def test_long_sequences_do_not_underflow():
    model, rng = small_model(), np.random.default_rng(3)
    seq = rng.integers(0, hmm_lm.KINDS, 30_000)
    whole = hmm_lm.log_likelihoods(model, seq, np.array([30_000]))
    once = hmm_lm.log_likelihoods(model, seq, np.array([30_000]), 30_000)
    assert np.isfinite(whole).all() and np.allclose(whole, once)


def test_query_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "REQUESTS", 5000)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(t for i, x in texts.items() if not held[i] for t in tokens_of(x))
    n, v = sum(counts.values()), len(counts)
    rows = queries.queries()["op5_hmm_lm"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    gain = 0.0
    for r in rows:
        own = tokens_of(texts[r.doc_id])
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(own), n)
        assert r.n_known == sum(counts[t] > 0 for t in own)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
        gain += (r.score - r.base_score) if r.held_out else 0
    assert gain > 0  # states help on texts never seen


def test_the_model_is_a_distribution(spark):
    """Over all words and the end, probabilities of a next token add up to one."""
    unigram = hmm_lm.Unigram(100, 4, 10, np.zeros(hmm_lm.CLASSES), np.zeros(hmm_lm.CLASSES))
    unigram.tokens[[3, 9]], unigram.types[[3, 9]] = [60, 30], [2, 1]
    assert np.isclose(unigram.class_share.sum(), 1)
    model = hmm_lm.Hmm.first(unigram.class_share)
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "A a\ta", 3), (3, "A a\ta", 3), (None, "b", 4), (5, "w " * 50_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, trained int")
    got = hmm_lm.score_texts(docs, docs.doc_id.isNotNull() & (docs.doc_id < 5)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == Counter(
        [(1, 1, 1, 10), (2, 1, 1, 10), (3, 4, 4, 10), (3, 4, 4, 10), (None, 2, 1, 10), (5, 50_001, 1, 10)]
    )
    assert all(np.isfinite(r.score) for r in got)
    none = hmm_lm.score_texts(docs, docs.doc_id > 100).collect()
    assert {(r.train_tokens, r.n_known) for r in none} == {(0, 0)} and all(np.isfinite(r.score) for r in none)
    assert hmm_lm.score_texts(docs.limit(0), docs.doc_id > 0).collect() == []


def test_words_of_one_hash_class_are_told_apart(spark, monkeypatch):
    """Two topics, all words in a class of their own or all in one: states learn each word by itself."""
    monkeypatch.setattr(hmm_lm, "_class", lambda keys: (keys % np.uint64(2)).astype(np.int64))
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        topic = "ab"[i % 2]
        rows.append((i, " ".join(f"{topic}{n}" for n in rng.integers(0, 40, 60)), i >= 40))
    docs = spark.createDataFrame(rows, "doc_id long, text string, trained boolean")
    got = hmm_lm.score_texts(docs, docs.trained).where("not trained").toPandas()
    # knowing the topic halves the vocabulary: log10(2) a token
    assert ((got.score - got.base_score) / got.n_tokens).mean() > 0.2


def test_block_models_make_one_distribution():
    """The emissions of all words, of the unseen ones and the end add up to one in each state."""
    rng = np.random.default_rng(6)
    counts, ends = rng.integers(1, 30, 50), 9
    unigram = hmm_lm.Unigram(int(counts.sum()) + ends, 51, ends, np.zeros(hmm_lm.CLASSES), np.zeros(hmm_lm.CLASSES))
    expected = rng.dirichlet(np.ones(3), 50) * counts[:, None]
    end = rng.dirichlet(np.ones(3)) * ends
    share = counts / (counts + hmm_lm.WORD_PRIOR)
    sums = [np.ones(3), np.ones(9), expected.sum(0) + end, end, (expected * share[:, None]).sum(0), [share.sum()]]
    model = hmm_lm.WordModel.from_sums(np.concatenate(sums), unigram, 3)
    assert np.allclose(model.hmm([expected[:20], expected[20:]], counts).emit.sum(0), 1)


def test_the_session_is_left_as_it_was(spark):
    names = [hmm_lm._CLEANUP, hmm_lm._ARROW_ROWS]
    before = [spark.conf.get(n, None) for n in names]
    docs = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string")
    assert hmm_lm.score_texts(docs, F.col("doc_id") > 0).count() == 2
    assert [spark.conf.get(n, None) for n in names] == before
    with pytest.raises(Exception):
        hmm_lm.score_texts(docs.withColumn("text", F.raise_error(F.lit("lost"))), F.col("doc_id") > 0)
    assert [spark.conf.get(n, None) for n in names] == before


def test_training_holds_one_posterior_of_few_segments():
    """Before, posteriors were held twice, of twice as many segments at once."""
    model, rng = small_model(8), np.random.default_rng(7)
    count, long = 4096, hmm_lm.SEGMENT
    tokens = rng.integers(0, hmm_lm.KINDS, count * long).astype("<u4")
    starts, sizes = np.arange(count) * long, np.full(count, long)
    tracemalloc.start()
    *_, emit, _ = hmm_lm.expected_counts(model, tokens, starts, sizes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(emit.sum(1), np.bincount(tokens, minlength=hmm_lm.KINDS))
    assert peak < 0.9 * len(tokens) * 8 * 8  # less than the posteriors of all of them


def test_blocks_lie_in_row_groups_of_their_own(spark, monkeypatch):
    """Before, a writer kept up to 100 blocks, and a reader took a whole file of them into one batch."""
    monkeypatch.setattr(hmm_lm, "BLOCK_TOKENS", 1)
    monkeypatch.setitem(hmm_lm._ROW_GROUPS, "parquet.block.size", "1")
    docs = spark.range(0, 6, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    before = spark.conf.get(hmm_lm._ARROW_ROWS)
    spark.conf.set(hmm_lm._ARROW_ROWS, "1")
    with noted() as folders:
        hmm_lm._blocks(docs, F.lit(True))
    spark.conf.set(hmm_lm._ARROW_ROWS, before)
    folder = folders[0].removeprefix("file:")
    files = [pq.ParquetFile(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".parquet")]
    assert sum(f.metadata.num_rows for f in files) == 6 == sum(f.metadata.num_row_groups for f in files)
